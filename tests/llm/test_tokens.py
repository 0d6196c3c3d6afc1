import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from factloom.llm import bpe, byte_bpe, packing, word_bpe
from factloom.llm import text_kernels as tk
from factloom.llm.vocabularies import vocabulary
from hypothesis import given, settings
from hypothesis import strategies as st

RANKS, WORDS = vocabulary("byte_bpe_multi_50k.tiktoken"), vocabulary("word_bpe_49k.json")
EDGES = ["", " ", "don't 's  's !'s\n\n 's 12345 x", " " * 60 + "a", "日本語 🎉 é é́", "a" * 3000, "x\u0085y z\x1c", "<|endoftext|> It's we'll 'LL", "\n\n", "İstanbul ΣΑΣ ﬁ Å 12,5%", "ab" * 700 + "!" * 200]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(WORDS)
    found.encode_special_tokens = True
    return found


def encoded(encoder, texts):
    out = []
    for chunk in tk.text_chunks(pa.array(texts, pa.string()), 1000):
        ids, offsets = encoder.encode_chunk(chunk)
        out += [ids[offsets[i] : offsets[i + 1]].tolist() for i in range(len(chunk))]
    return out


def test_byte_level_ids_are_the_library_s(reference):
    rng = random.Random(4)
    texts = EDGES + ["".join(rng.choice(" \n'sdtlvre1é中🎉. A") for _ in range(rng.randint(0, 300))) for _ in range(150)]
    encoder = bpe.byte_level_encoder(RANKS)
    for text, ids in zip(texts, encoded(encoder, texts), strict=True):
        assert ids == reference.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_word_level_ids_are_the_library_s(words):
    rng = random.Random(5)
    texts = EDGES + ["".join(rng.choice(" \n'sdtlvre1éÜß中.,-A") for _ in range(rng.randint(0, 200))) for _ in range(100)]
    for text, ids in zip(texts, encoded(word_bpe.word_encoder(WORDS), texts), strict=True):
        assert ids == words.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40))
def test_vectorised_and_scalar_trees_merge_alike(symbols):
    pairs = bpe.PairTable([0, 1, 4, 2, 5], [1, 0, 4, 3, 5], [0, 1, 2, 3, 4], [4, 5, 6, 7, 8])
    ids, _ = bpe.merge_segments(np.array(symbols, np.int32), np.array([0, len(symbols)]), pairs)
    assert ids.tolist() == bpe.merge_long(symbols, pairs)


def test_encode_and_decode_tables(spark, reference):
    rows = [(i, t) for i, t in enumerate(EDGES)] + [(0, EDGES[0]), (None, "null key"), (99, None)]
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], "doc_id long, text string, ids string, decoded string")
    encoded_rows = byte_bpe.encode(df, "doc_id", "text", RANKS, decoded=True)
    found = byte_bpe.digests(encoded_rows, "doc_id").collect()
    expected = []
    for key, text in rows:
        ids = reference.encode_ordinary(text or "")
        expected.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    back = byte_bpe.decode(encoded_rows.select("doc_id", "ids"), "doc_id", "ids", RANKS)
    assert sorted(bytes(r.decoded).decode() for r in back.collect()) == sorted(t or "" for _, t in rows)
    assert byte_bpe.encode(df.limit(0), "doc_id", "text", RANKS).count() == 0


def naive_best_fit(lengths, size):
    bins = []
    for length in sorted(lengths, reverse=True):
        fits = [b for b in bins if b >= length]
        if fits:
            bins[bins.index(min(fits))] -= length
        else:
            bins.append(size - length)
    return sorted(bins)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80), st.just(20))
def test_plan_is_best_fit_decreasing(lengths, size):
    histogram = {x: lengths.count(x) for x in set(lengths)}
    used, placed = {}, {x: [] for x in histogram}
    for length, ordinal, count, first, offset in packing.plan(histogram, size):
        placed[length] += range(ordinal, ordinal + count)
        for b in range(first, first + count):
            used.setdefault(b, []).append((offset, length))
    assert all(sorted(v) == list(range(histogram[k])) for k, v in placed.items())
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(size - sum(n for _, n in s) for s in used.values()) == naive_best_fit(lengths, size)


def test_capacity_tree_finds_the_tightest():
    tree = packing.CapacityTree(10)
    tree.put(3, True), tree.put(7, True)
    assert [tree.tightest(x) for x in (1, 3, 4, 7, 8)] == [3, 3, 7, 7, None]


def test_packing_of_a_table(spark, words):
    rows = [(i, t) for i, t in enumerate(EDGES)] + [(1, " "), (None, "null key"), (50, None), (60, "word " * 9000)]
    df = spark.createDataFrame([(a, b, 1, "z") for a, b in rows], "doc_id long, text string, length int, offset string")
    found = packing.tokenise_and_pack(df, "doc_id", "text", WORDS, 4096).collect()
    expected = []
    for key, text in rows:
        ids = [*words.encode(text or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            expected.append((key, n, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted([tuple(r)[:5] for r in found], key=repr) == sorted(expected, key=repr)
    spans = {}
    for r in found:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.tokenise_and_pack(df.limit(0), "doc_id", "text", WORDS).count() == 0


def test_equal_hashes_do_not_mix_up_segments(reference, monkeypatch):
    monkeypatch.setattr(tk, "segment_hashes", lambda data, starts, ends: ((ends - starts) % 3).astype(np.uint64))
    encoder, rng = bpe.ByteLevelEncoder(RANKS), random.Random(9)
    for _ in range(3):
        texts = EDGES + ["".join(rng.choice("ab c'sé1") for _ in range(80)) for _ in range(20)]
        for text, ids in zip(texts, encoded(encoder, texts), strict=True):
            assert ids == reference.encode_ordinary(text)


def test_the_cache_is_dropped_when_full(reference):
    encoder, rng = bpe.ByteLevelEncoder(RANKS), random.Random(10)
    encoder.segments.most = 30
    for _ in range(5):
        texts = ["".join(rng.choice("abcde fgh") for _ in range(60)) for _ in range(20)]
        for text, ids in zip(texts, encoded(encoder, texts), strict=True):
            assert ids == reference.encode_ordinary(text)
    assert len(encoder.segments.runs) <= 8
