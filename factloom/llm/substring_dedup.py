"""Removal of long word sequences that an earlier document has too (operator 9).

Prefix-partitioned suffix trees. Every window of SPAN words has an anchor: the place
in it at which the prefix of so many words has the least hash. Suffixes are
sampled at anchors and partitioned by those prefixes, so that equal windows meet
and neighbouring ones travel together as one stretch of text. Partitions in which
only one text occurs have no repeats and are dropped before any text moves. A partition
of more than GROUP stretches is split by longer prefixes (PREFIXES, in words), step by
step, until its parts fit in memory. Of each part a suffix tree is built, as a suffix array with
its longest common prefixes; the internal nodes at a depth of SPAN words or more whose leaves are
of two or more documents are the deep ones, and runs of them along a text its maximal repeats.

What is still too large beyond the longest prefix is a passage with more copies than
fit. It is aggregated, never gathered: its windows are joined to chains that end
where a window's hash says so, equal chains count once, by their smallest document, and only
the chain of that one is taken apart into its nodes.

Exact copies of a text are represented by the one of smallest key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import arrow, storage
from factloom.llm import text_kernels as tk

SPAN = 50
PREFIXES = (20, 30, 40)
#: Stretches of one partition that a task holds at once: about 2 MB of text, and some 40 MB of arrays.
GROUP = 4_096
#: A chain of nodes ends at one window in so many.
CHAIN = 8
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` consecutive values, by doubling."""
    out, size = values, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def partitions(hashes: np.ndarray, per_text: np.ndarray, span: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every suffix with ``span`` words in its text: its position, text and partition."""
    lengths = np.diff(per_text)
    counts = np.maximum(lengths - span + 1, 0)
    at = tk.ragged_index(per_text[:-1], counts)
    text = np.repeat(np.arange(len(lengths)), counts)
    if not len(at):
        return at, text, np.zeros(0, np.uint64)
    return at, text, _least(tk.ngram_hashes(hashes, prefix), span - prefix + 1)[at]


def stretches(text: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last suffix (indexes) of each run of one text with one partition."""
    new = np.ones(len(part), bool)
    new[1:] = (part[1:] != part[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(part)) - 1


def _tally(text: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text and partition that occur together, and how often."""
    order = np.lexsort((part, text))
    text, part = text[order], part[order]
    new = np.ones(len(part), bool)
    new[1:] = (part[1:] != part[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], part[first], np.diff(np.append(first, len(part))).astype(np.int32)


def suffix_tree(hashes: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of word sequences and, for each of its entries, the longest common
    prefix in words with the entry before it (exact below ``depth``, at least ``depth`` beyond). ``left``: the
    words from each position to the end of its text. Neighbours with a common prefix of d words
    or more are leaves of one internal node at depth d or more.

    Suffixes get numbers in the order of their first 1, 2, 4, ... words; the
    common prefix of two neighbours is found by going back through these numbers.
    """
    n = len(hashes)
    levels, size = [np.unique(hashes, return_inverse=True)[1].astype(np.int64) + 1], 1
    while size < depth:
        own = levels[-1]
        behind = np.zeros(n, np.int64)
        there = np.flatnonzero(left > size)
        behind[there] = own[there + size]
        levels.append(np.unique(own * (int(own.max()) + 1) + behind, return_inverse=True)[1].astype(np.int64) + 1)
        size *= 2
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1], order[1:]
    common = np.zeros(n, np.int64)
    found = common[1:]
    least = np.minimum(left[a], left[b])
    for numbers in reversed(levels):
        at = np.flatnonzero(least - found >= size)
        at = at[numbers[a[at] + found[at]] == numbers[b[at] + found[at]]]
        found[at] += size
        size //= 2
    return order, common


def repeats(chunk: tk.TextChunk, keys: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeats in whole partitions of stretches: (stretch, first word, end word)
    of the words covered by suffixes whose deep node has a smaller key among its leaves."""
    starts, ends, per_text = tk.words(chunk)
    hashes = tk.segment_hashes(chunk.data, starts, ends)
    none = np.zeros(0, np.int64)
    if len(hashes) < span:
        return none, none, none
    lengths = np.diff(per_text)
    own = np.repeat(np.arange(len(chunk)), lengths)
    left = np.repeat(per_text[1:], lengths) - np.arange(len(hashes))
    order, common = suffix_tree(hashes, left, span)
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(common < span)
    at = np.flatnonzero(left >= span)
    node, own = node[at], own[at]
    order = np.lexsort((keys[own], node))
    head = np.ones(len(order), bool)
    head[1:] = node[order][1:] != node[order][:-1]
    least = np.empty(len(order), keys.dtype)
    least[order] = np.repeat(keys[own][order][head], np.diff(np.append(np.flatnonzero(head), len(order))))
    hit = np.flatnonzero(least < keys[own])
    if not len(hit):
        return none, none, none
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) != 1) | (own[hit][1:] != own[hit][:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hit)) - 1
    base = per_text[own[hit[first]]]
    return own[hit[first]], at[hit[first]] - base, at[hit[last]] - base + span


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _inside(part: np.ndarray, text: np.ndarray, wanted: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each (part, text) is among the wanted parts of texts."""
    return np.isin(tk.mix(part + _SALT * text.astype(np.uint64)), tk.mix(wanted + _SALT * of.astype(np.uint64)))


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The flat values of a list column (null: empty), and the row of each."""
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.repeat(np.arange(len(column)), counts)


def _shared_partitions(texts: DataFrame, span: int, prefixes: tuple[int, ...], group: int) -> DataFrame:
    """For each text fingerprint the partitions that another text has too: structs (level,
    part, large), where a large one has more than ``group`` stretches, of which copies of a text count once and
    a text that passes through the partition several times counts each of them. Large partitions of a
    level are split again at the next."""
    spark = texts.sparkSession

    def split(level: int):
        def run(chunk, keys):
            starts, ends, per_text = tk.words(chunk)
            hashes = tk.segment_hashes(chunk.data, starts, ends)
            _, text, part = partitions(hashes, per_text, span, prefixes[level])
            first, _ = stretches(text, part)
            if level:
                above = partitions(hashes, per_text, span, prefixes[level - 1])[2]
                flat, of = _lists(keys.field("above"))
                kept = np.flatnonzero(_inside(above, text, flat.to_numpy().view(np.uint64), of))
                first = kept[stretches(text[kept], part[kept])[0]] if len(kept) else kept
            who, own, n = _tally(text[first], part[first])
            yield [_signed(own), keys.field("fp").take(pa.array(who)), n]

        return run

    docs = texts.select(F.struct(F.col("_fp").alias("fp"), F.array().cast("array<bigint>").alias("above")).alias("_keys"), "_text")
    levels = []
    for level in range(len(prefixes)):
        found = storage.written(arrow.map_columns(docs, "_keys", "_text", "part long, fp long, n int", split(level)), "partitions")
        sums = found.groupBy("part").agg(F.min("fp").alias("_a"), F.max("fp").alias("_b"), F.sum("n").alias("_n")).where("_a <> _b")
        # written, so that the joins with it have two plain exchanges and may split a hot partition
        sums = storage.written(sums.select("part", "_n"), "shared")
        big = sums.where(F.col("_n") > group)
        if big.isEmpty():
            shared = sums.select("part", F.lit(False).alias("large"))
        else:  # copies of one text have the same stretches and count once
            several = found.join(big.select("part"), "part").distinct().groupBy("part").agg(F.sum("n").alias("_m"))
            shared = storage.written(sums.join(several, "part", "left").select("part", F.coalesce(F.col("_m") > group, F.lit(False)).alias("large")), "large")
        own = storage.written(found.join(shared, "part").groupBy("fp").agg(F.collect_set(F.struct(F.lit(level).alias("level"), "part", "large")).alias("groups")), "groups")
        storage.release(spark, found)
        levels.append(own)
        large = own.select(F.col("fp").alias("_fp"), F.transform(F.filter("groups", lambda g: g["large"]), lambda g: g["part"]).alias("above")).where(F.size("above") > 0)
        if level + 1 == len(prefixes) or big.isEmpty() or large.isEmpty():
            break
        once = texts.join(large, "_fp").groupBy("_fp").agg(F.min("_text").alias("_text"), F.first("above").alias("above"))
        docs = once.select(F.struct(F.col("_fp").alias("fp"), "above").alias("_keys"), "_text")
    if len(levels) == 1:
        return levels[0]
    every = levels[0]
    for own in levels[1:]:
        every = every.unionByName(own)
    return every.groupBy("fp").agg(F.flatten(F.collect_list("groups")).alias("groups"))


def _chains(hashes: np.ndarray, at: np.ndarray, text: np.ndarray, pick: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Runs of picked windows that end where a window's hash says so: first and last window
    (places in ``pick``), and for two kinds of hash those of the windows and of the whole chain."""
    kinds = [hashes, tk.mix(hashes ^ _SALT)]
    windows = [tk.ngram_hashes(h, span)[at[pick]] for h in kinds]
    new = np.ones(len(pick), bool)
    new[1:] = (np.diff(pick) != 1) | (text[pick][1:] != text[pick][:-1]) | (windows[0][:-1] % np.uint64(CHAIN) == 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(pick)) - 1
    whole = []
    for h in windows:
        up, down = tk._word_powers.upto(len(h) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
        whole.append(tk.mix((sums[last + 1] - sums[first]) * down[first] + (last - first + 1).astype(np.uint64)))
    return first, last, np.append(first, len(pick)), windows, whole


def _stretch_rows(candidates: DataFrame, span: int, prefixes: tuple[int, ...]) -> DataFrame:
    """Stretches of partitions to be held in memory (``text`` is set), and chains of windows
    of larger ones (``text`` is null) by two hashes of the whole, with two hashes of each window."""

    def run(chunk, keys):
        starts, ends, per_text = tk.words(chunk)
        hashes = tk.segment_hashes(chunk.data, starts, ends)
        flat, of = _lists(keys.field("groups"))
        level, wanted = flat.field("level").to_numpy(), flat.field("part").to_numpy().view(np.uint64)
        large = flat.field("large").to_numpy(zero_copy_only=False).astype(bool)
        raw = chunk.data.tobytes()
        for k in np.unique(level).tolist():
            at, text, part = partitions(hashes, per_text, span, prefixes[k])
            first, last = stretches(text, part)
            small = (level == k) & ~large
            pick = np.flatnonzero(_inside(part[first], text[first], wanted[small], of[small]))
            a, b = first[pick], last[pick]
            who = text[a]
            begin, end = starts[at[a]], ends[at[b] + span - 1]
            texts = pa.array([raw[x:y].decode() for x, y in zip(begin.tolist(), end.tolist(), strict=True)], pa.string())
            none = pa.nulls(len(a), pa.list_(pa.int64()))
            yield [_signed(part[a]), np.full(len(a), k), keys.field("key").take(pa.array(who)), keys.field("fp").take(pa.array(who)), (at[a] - per_text[who]).astype(np.int32), texts, none, none]
            deep = (level == k) & large
            if k + 1 == len(prefixes) and deep.any():
                pick = np.flatnonzero(_inside(part, text, wanted[deep], of[deep]))
                a, b, offsets, windows, whole = _chains(hashes, at, text, pick, span)
                own = pick[a]
                who = text[own]
                lists = [arrow.list_array(_signed(w), offsets, pa.int64()) for w in windows]
                yield [_signed(whole[0]), _signed(whole[1]), keys.field("key").take(pa.array(who)), keys.field("fp").take(pa.array(who)), (at[own] - per_text[who]).astype(np.int32), pa.nulls(len(own), pa.string()), *lists]

    kind = candidates.schema["_keys"].dataType["key"].dataType.simpleString()
    return arrow.map_columns(candidates, "_keys", "_text", f"part long, more long, key {kind}, fp long, start int, text string, one array<long>, two array<long>", run)


def _tree_repeats(rows: DataFrame, span: int) -> DataFrame:
    """Repeats (key, fp, first, end) of partitions that each fit in memory. Partitions of
    different levels have different numbers in all likelihood; where not, they are compared together."""
    kind = rows.schema["key"].dataType
    ranged = rows.repartition("part").sortWithinPartitions("part")
    schema = f"key {kind.simpleString()}, fp long, first int, end int"

    def whole(batches):
        """Tables that end where a partition ends."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0).to_numpy()
            cut = int(np.searchsorted(part, part[-1]))
            if cut or (held and held[-1].column(0)[-1].as_py() != part[0]):
                if cut:
                    held.append(batch.slice(0, cut))
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(cut))
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches):
        for table in whole(batches):
            part = table.column("part").to_numpy()
            keys = table.column("key").to_numpy(zero_copy_only=False)
            start = table.column("start").to_numpy()
            # a chunk of texts per call, cut between partitions
            column = table.column("text").combine_chunks()
            sizes = np.cumsum(np.asarray(pc.binary_length(column)))
            edges = np.append(np.flatnonzero(np.diff(part)) + 1, len(part))
            at = 0
            while at < len(part):
                limit = (sizes[at - 1] if at else 0) + tk.CHUNK_BYTES
                fit = edges[(edges > at) & (sizes[edges - 1] <= limit)]
                end = int(fit[-1]) if len(fit) else int(edges[edges > at][0])
                for chunk in tk.text_chunks(column.slice(at, end - at), 1 << 60):
                    who, first, last = repeats(chunk, keys[at:end], span)
                    who = who + at
                    yield pa.RecordBatch.from_arrays([table.column("key").take(pa.array(who)).combine_chunks(), table.column("fp").take(pa.array(who)).combine_chunks(), pa.array(start[who] + first, pa.int32()), pa.array(start[who] + last, pa.int32())], names=["key", "fp", "first", "end"])
                at = end

    return arrow.mapped(ranged, run, schema)


def _deep_repeats(rows: DataFrame, span: int) -> DataFrame:
    """Repeats (key, fp, first, end) of chains of windows: a chain that a smaller key has too is
    one; of the others every window is looked up by itself."""
    # written, so that the joins have two plain exchanges and may split a hot node
    least = storage.written(rows.groupBy("part", "more").agg(F.min("key").alias("_least")), "least")
    known = rows.join(least, ["part", "more"])
    gone = known.where(F.col("key") > F.col("_least")).select("key", "fp", F.col("start").alias("first"), (F.col("start") + F.size("one") - 1 + span).alias("end"))
    heads = known.where(F.col("key") == F.col("_least")).select("key", "fp", "start", F.posexplode(F.arrays_zip("one", "two")).alias("_i", "_w"))
    nodes = storage.written(heads.select("key", "fp", (F.col("start") + F.col("_i")).alias("first"), "_w.one", "_w.two"), "nodes")
    lowest = storage.written(nodes.groupBy("one", "two").agg(F.min("key").alias("_least")), "least")
    hit = nodes.join(lowest, ["one", "two"]).where(F.col("key") > F.col("_least"))
    return gone.unionByName(hit.select("key", "fp", "first", (F.col("first") + span).alias("end")))


def repeated_words(df: DataFrame, key: str, text: str, span: int = SPAN, prefixes: tuple[int, ...] = PREFIXES, group: int = GROUP) -> DataFrame:
    """(key, fp, spans): the word ranges of each text that windows of ``span`` words cover
    which also start in a text with a smaller key. The whole text, for a copy, is
    the range from 0 to 2**31 - 1; texts without such windows are left out."""
    spark = df.sparkSession
    base = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).where(F.col("key").isNotNull()).withColumn("fp", F.xxhash64("_text"))
    shared = _shared_partitions(base.select(F.col("fp").alias("_fp"), "_text"), span, prefixes, group)
    prints = base.select("key", "fp", F.sha2("_text", 256).alias("sha"))
    firsts = storage.written(prints.groupBy("fp", "sha").agg(F.min("key").alias("_least")), "firsts")
    copies = prints.join(firsts, ["fp", "sha"]).where(F.col("key") > F.col("_least"))
    wanted = firsts.join(shared, "fp").select(F.col("_least").alias("key"), "fp", "groups")
    candidates = base.join(wanted, ["key", "fp"]).select(F.struct("key", "fp", "groups").alias("_keys"), "_text")
    rows = storage.written(_stretch_rows(candidates, span, prefixes), "stretches")
    storage.release(spark, shared)
    storage.release_shuffles(spark)
    found = _tree_repeats(rows.where("text IS NOT NULL").select("part", "key", "fp", "start", "text"), span)
    chains = rows.where("text IS NULL").drop("text")
    if not chains.isEmpty():
        found = found.unionByName(_deep_repeats(chains, span))
    full = copies.select("key", "fp", F.lit(0).alias("first"), F.lit(2**31 - 1).alias("end"))
    spans = found.unionByName(full).groupBy("key", "fp").agg(F.collect_set(F.struct("first", "end")).alias("spans"))
    result = storage.written(spans, "repeats")
    storage.release(spark, rows)
    storage.release_shuffles(spark)
    return result


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, prefixes: tuple[int, ...] = PREFIXES, group: int = GROUP) -> DataFrame:
    """Every row and column of ``df`` with the words of repeated windows cut from the text,
    and ``n_words``, ``n_removed`` beside them (columns of these names are replaced).

    Words are runs of bytes other than 0x20 and 0x09-0x0D; white space before a kept
    word that followed a removed one goes too. A text of fewer than ``span`` words, a null text
    (no words) and a row with a null key stay as they are and are not compared. Among rows of equal
    keys none is smaller. A task holds a chunk of texts (512 KB, or one longer text with about 200 bytes a
    word) and one partition of up to ``group`` stretches.
    """
    spans = repeated_words(df, key, text, span, prefixes, group)
    kept = [c for c in df.columns if c not in ("n_words", "n_removed")]
    others = [c for c in kept if c != text]
    rows = df.select(F.struct(*others).alias("_row"), F.col(key).alias("_key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_fp"), F.col(text).alias("_text"))
    joined = rows.join(spans.select(F.col("key").alias("_key"), F.col("fp").alias("_fp"), "spans"), ["_key", "_fp"], "left")
    packed = joined.select(F.struct("_row", F.col("_text").isNull().alias("null"), "spans").alias("_keys"), "_text")

    def run(chunk, keys):
        starts, _, per_text = tk.words(chunk)
        n_words = np.diff(per_text)
        cover = np.zeros(len(starts) + 1, np.int64)
        lists = keys.field("spans")
        offsets, flat = lists.offsets.to_numpy(), lists.values
        lo, hi = offsets[0], offsets[-1]
        if hi > lo:
            at = np.repeat(np.arange(len(chunk)), np.diff(offsets))
            first = flat.field("first").to_numpy(zero_copy_only=False)[lo:hi].astype(np.int64)
            end = np.minimum(flat.field("end").to_numpy(zero_copy_only=False)[lo:hi].astype(np.int64), n_words[at])
            real = n_words[at] >= span
            np.add.at(cover, (per_text[at] + first)[real], 1)
            np.add.at(cover, (per_text[at] + end)[real], -1)
        gone = np.cumsum(cover[:-1]) > 0
        sums = np.concatenate([[0], np.cumsum(gone)])
        removed = sums[per_text[1:]] - sums[per_text[:-1]]
        nulls, row = keys.field("null").to_pylist(), keys.field("_row")
        texts: list[bytes | None] = []
        for k in range(len(chunk)):
            if nulls[k]:
                texts.append(None)
            elif not removed[k]:
                texts.append(chunk.text(k))
            else:
                a, b = per_text[k], per_text[k + 1]
                own, begin = gone[a:b], np.append(starts[a:b], chunk.offsets[k + 1])
                edge = np.flatnonzero(np.diff(own.astype(np.int8))) + 1
                cuts = np.concatenate([[0], edge, [b - a]])
                states = own[cuts[:-1]]
                pieces = [] if own[0] else [chunk.data[chunk.offsets[k] : begin[0]].tobytes()]
                pieces += [chunk.data[begin[x] : begin[y]].tobytes() for x, y, g in zip(cuts[:-1], cuts[1:], states, strict=True) if not g]
                texts.append(b"".join(pieces))
        yield [*(row.field(c) for c in others), tk.strings(texts), n_words, removed]

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)
    out = arrow.map_columns(packed, "_keys", "_text", f"{fields}{', ' if fields else ''}`{text}` string, n_words long, n_removed long", run)
    return out.select(*kept, "n_words", "n_removed")


def digests(cleaned: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The kept words joined by one space, as a digest, beside the counts."""
    words = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return cleaned.select(key, "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))
