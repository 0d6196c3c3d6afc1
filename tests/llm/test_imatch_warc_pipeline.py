import hashlib
import itertools
import math
import random
import re
import struct
import sys
from collections import Counter

import corpus_pipeline
import pytest
import regex
import xxhash
from factloom.llm import imatch, storage, warc
from factloom.llm.vocabularies import vocabulary
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rpartition("/")[0])
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def prints(spark):
    texts = [f"alpha{i} beta{i % 5} gamma{i % 3} " * 6 + " ".join(f"t{(i * 7 + k) % 90}" for k in range(40)) for i in range(30)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(200, None), (201, ""), (202, texts[0]), (203, texts[1]), (204, "é日本🎉 x" * 3), (None, "null key"), (205, "ab")]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, _text string, n_chars int")
    return rows, imatch.compare_with_edits(df).collect(), df


def test_edited_text_and_counts(prints):
    rows, found, _ = prints
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    after = {r[0]: ordered[(k + 1) % len(ordered)][1] or "" for k, r in enumerate(ordered)}
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    for key, text in rows:
        text = text or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + after[key][:n]
        assert (by[key].n_chars, by[key].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= by[key].near_edited <= 1 and 0 <= by[key].near_next <= 1


def test_equal_texts_have_equal_fingerprints(prints):
    by = {r.doc_id: r for r in prints[1]}
    assert by[202].fingerprint == by[0].fingerprint and by[203].fingerprint == by[3].fingerprint
    assert by[200].fingerprint == by[201].fingerprint
    assert by[200].near_next == 1.0
    assert len({r.fingerprint for r in prints[1]}) >= 30


def test_edits_are_nearer_than_neighbours(prints):
    rows = [r for r in prints[1] if r.doc_id is not None and r.doc_id < 90]
    assert sum(r.near_edited for r in rows) > sum(r.near_next for r in rows)


def test_fingerprints_run_no_python_and_take_empty_tables(prints):
    df = prints[2]
    assert not re.search("Python|Pandas|Arrow", imatch.compare_with_edits(df)._jdf.queryExecution().executedPlan().toString())
    assert imatch.compare_with_edits(df.limit(0)).count() == 0
    assert imatch.compare_with_edits(df.where("doc_id = 3")).first().near_next == 1.0


def test_lexicon_leaves_out_terms_of_too_many_texts(spark):
    df = spark.createDataFrame([(f"common r{i} pair{i // 2}",) for i in range(64)], "text string")
    common = imatch.common_terms(df, "text", (0.25, 1.0))
    terms = spark.createDataFrame([("common pair3 r5",)], "text string").select(imatch.term_hashes(F.col("text")).alias("t"))
    assert len(common) == 1 and terms.select(F.size(imatch.lexicon_terms(F.col("t"), common)).alias("n")).first().n == 2


def xx(value, seed=42):
    data = value.encode() if isinstance(value, str) else value
    return xxhash.xxh64_intdigest(data, seed)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_print(terms, common):
    """A fingerprint in plain Python, from sets of terms."""
    found = sorted(signed(xx(t)) for t in terms if t not in common)
    out = []
    for g in range(imatch.SUBSETS // 4):
        draws = [xx(struct.pack("<i", g), xx(struct.pack("<q", h))) for h in found]
        for d in range(4):
            places = sorted((r << 16 * d) % (1 << 64) >> 16 for r in draws)
            if not places:
                out.append(None)
                continue
            h = 42
            for v in [v for v in places if v.bit_length() <= max(1, places[0].bit_length())][: imatch.MOST_TERMS]:
                h = xx(struct.pack("<q", v), h)
            out.append(h)
    whole = 42
    for h in sorted(signed(xx(t)) for t in terms):
        whole = xx(struct.pack("<q", h), whole)
    return out + [whole]


def test_fingerprints_and_likeness_match_brute_force(prints):
    rows, found, _ = prints
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    sets, n = [], len(ordered)
    for k, (_, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % n][1] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        sets.append([set(regex.findall(r"[\p{L}\p{N}]+", x.lower())) for x in (t, edited)])
    counts = Counter(w for own, _ in sets for w in own)
    common = {w for w, c in counts.items() if math.log(n / c) / math.log(n) < imatch.BAND[0]}
    assert common
    prints_ = [[brute_print(x, common) for x in pair] for pair in sets]

    def alike(a, b):
        s = sum(x is not None and x == y for x, y in zip(a[:-1], b[:-1], strict=True)) / imatch.SUBSETS
        return 1.0 if a[-1] == b[-1] else 2 * s / (1 + s)

    shown = lambda p: " ".join("-" if h is None else f"{h:016x}"[:8] for h in p)
    by = {r.doc_id: r for r in found}
    for k, (key, _) in enumerate(ordered):
        own, edited, after = *prints_[k], prints_[(k + 1) % n][0]
        assert (by[key].fingerprint, by[key].edited_fingerprint) == (shown(own), shown(edited))
        assert by[key].near_edited == pytest.approx(alike(own, edited)) and by[key].near_next == pytest.approx(alike(own, after))


def test_very_long_texts_are_fingerprinted(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    found = imatch.compare_with_edits(spark.createDataFrame([(1, long), (2, long), (3, "short text")], "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in found}
    assert by[1].fingerprint == by[2].fingerprint and by[1].near_next == 1.0 and by[2].near_edited > 0.5


PAGES = [(5, "http://b.example.com/x?q=1", "A" * 200), (2, "http://a.example.org:8080/y z", "A" * 200), (9, "HTTP://B.example.com/x?q=1", "é" * 60), (7, "bad url\n", "é" * 60), (1, None, "short"), (3, "http://c.d/", "short"), (4, "http://c.d/", None), (None, "http://c.d/", "A" * 200), (8, "http://c.d/", "")]


def test_records_come_back_through_the_index(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    df = spark.createDataFrame([(a, b, c, "k", "d") for a, b, c in PAGES], "page_id long, url string, html string, key string, digest string")
    folder, files = warc.archive(spark, df)
    found = {r.key: r for r in warc.read_captures(df, folder, files).collect()}
    assert len(found) == len(PAGES)
    for key, _, html in PAGES:
        r, body = found[None if key is None else str(key)], (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        first = min((k for k, _, h in PAGES if k is not None and h == html), default=None) if len(body) >= 100 else None
        if first is None or first == key:
            assert r.record_type == "response" and r.refers_to is None and bytes(r.payload) == body
        else:
            assert r.record_type == "revisit" and r.refers_to == str(first) and r.payload is None
    empty, none = warc.archive(spark, df.limit(0))
    assert none == [] and warc.read_captures(df.limit(0), empty, none).count() == 0


def test_lines_are_found_in_sorted_blocks(spark):
    rows = spark.createDataFrame([(f"com,h{i:04d})/", str(i), "f", i * 10, 5) for i in range(500)] + [("com,h0007)/", "7", "g", 1, 2)], warc._CAPTURE)
    folder = warc.storage.scratch(spark, "cdx")
    files = warc.write_index(rows, folder, lines=7)
    assert [x[1] for x in warc.find(folder, files, b"com,h0123)/ 123")] == [1230]
    assert sorted(x[0] for x in warc.find(folder, files, b"com,h0007)/ 7")) == ["f", "g"]
    assert list(warc.find(folder, files, b"com,zzz)/ 1")) == [] and list(warc.find(folder, files, b"a")) == []


def test_url_keys():
    assert warc.url_key("https://WWW.Example.com:81/A b?c=d") == "com,example,www:81)/A%20b?c=d"
    assert warc.url_key(None) == ")" and warc.url_key("http://x.y") == "y,x)/"


def test_a_record_is_a_gzip_member_with_its_payload():
    import gzip

    raw = gzip.decompress(warc.record("1", "http://x/", b"\r\n\r\nbody", "d", None))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response") and raw.endswith(b"body\r\n\r\n")
    assert warc.parse(warc.record("1", "http://x/", b"\r\n\r\nbody", "d", None))[2] == b"\r\n\r\nbody"


def test_stages_chain_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = storage.written(stage(spark, seen, SF), name)
        assert after.columns == docs.columns, name
        assert after.join(seen, "doc_id", "left_anti").count() == 0
        if name in ("line_dedup", "substring_dedup"):
            assert after.count() == seen.count()
        assert after.where("n_chars <> length(text)").count() == 0 or name in ("quality", "near_dedup")
        seen = after
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    assert packed.select("doc_id").distinct().count() == seen.count()
    assert seen.count() < docs.count()


def test_empty_documents_go_through_all_stages(spark):
    seen = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        seen = stage(spark, seen, SF)
    assert seen.count() == 0


def near_brute(rows):
    """Ids that near-duplicate removal drops, by comparing all sets."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i for i in sets if find(i) != i}


def windows_brute(rows):
    """Kept words of each text after the removal of repeated windows."""
    first, out = {}, {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_pipeline_equals_brute_force(spark, tmp_path, monkeypatch):
    """Stages 2 to 5 on what the classifier kept, with odd rows, clashing columns and without n_chars."""
    from test_dedup import brute_lines

    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(5000)}"
    passage, lines = [word() for _ in range(70)], [" ".join(word() for _ in range(6)) for _ in range(12)]
    texts = ["\n".join(" ".join(word() for _ in range(rng.randint(5, 30))) for _ in range(rng.randint(1, 8))) for _ in range(60)]
    texts += [t + " tail" for t in texts[:10]] + texts[:5]
    texts += [" ".join([*(word() for _ in range(60)), *passage, *(word() for _ in range(60))]) for _ in range(8)] + ["\n".join([word(), *lines, word()]) for _ in range(8)]
    texts += ["", None, "one", " ".join(word() for _ in range(60_000))]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    frame = spark.createDataFrame([(i, t, "mine", 3, "n") for i, t in rows], "doc_id long, text string, _score string, n_lines int, n_words string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = corpus_pipeline.keep_good(spark, frame, str(tmp_path))  # one class only: all are kept
    assert seen.columns == frame.columns and seen.count() == len(rows)
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    cut = brute_lines(rows)
    after = [(i, cut[i][0] if i in cut else None) for i, _ in rows]
    gone = near_brute(after)
    kept = windows_brute([r for r in after if r[0] not in gone])
    assert gone and sum(map(len, kept.values())) < sum(len(WORD.findall(t or "")) for i, t in after if i not in gone)
    from tokenizers import Tokenizer

    words = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    expected = {i: len(words.encode(" ".join(w), add_special_tokens=False).ids) + 1 for i, w in kept.items()}
    sums = Counter()
    for r in found:
        sums[r.doc_id] += r.length
    assert dict(sums) == expected
    bins = Counter()
    for r in found:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 4096


def test_null_and_repeated_ids_go_through_the_pipeline(spark, tmp_path):
    rows = [(None, "no id " * 30), (None, None), (1, "a b c\nd e"), (1, "a b c\nd e"), (1, "other text"), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in found), key=repr) == sorted((r[0] for r in rows), key=repr)
