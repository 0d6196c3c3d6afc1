"""Near-duplicate documents by SuperMinHash, banding and exact verification (operator 7).

1. Every text becomes the set of its distinct word shingles. Texts of equal word
   sequences are one class, which its smallest key represents from here on.
2. Bands of SuperMinHash signatures put representatives into buckets.
3. Each member of a bucket is compared with the smallest one on full sets, and
   confirmed links are joined into components.
4. A bucket that still holds several components is compared completely: its sets
   meet in blocks of bounded size, every pair across components is confirmed or
   refused inside the task, and only links that join components leave it.

No pair within a settled group is formed and no bucket or candidate is capped.
With the default 32 bands of 4 slots, a pair at the threshold shares no
bucket with probability 5e-6.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import arrow, storage, superminhash
from factloom.llm import text_kernels as tk
from factloom.llm.components import UnionFind, components

SLOTS = 128
BANDS = 32
WORDS = 5
#: Links have 100 * |A and B| >= PERCENT * |A or B|.
PERCENT = 75
#: A block of a bucket holds about so many texts, or shingles, at most.
BLOCK_TEXTS = 500
BLOCK_SHINGLES = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_SALT = np.uint64(0xA24BAED4963EE407)


def _sequence_hashes(hashes: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    up, down = tk._word_powers.upto(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return tk.mix((sums[per_text[1:]] - sums[per_text[:-1]]) * down[per_text[:-1]] + np.diff(per_text).astype(np.uint64))


def shingles(chunk: tk.TextChunk, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes sorted by text, the text of each, and two hashes of each
    text's word sequence. A text of fewer words is one shingle; one of none is empty."""
    starts, ends, per_text = tk.words(chunk)
    hashes = tk.segment_hashes(_LOWER[chunk.data], starts, ends)
    lengths = np.diff(per_text)
    parts, owners = [], []
    for n in range(1, words + 1):
        which = np.flatnonzero(lengths == n if n < words else lengths >= n)
        counts = np.where(lengths[which] > 0, lengths[which] - n + 1, 0)
        if len(which):
            parts.append(tk.ngram_hashes(hashes, n)[tk.ragged_index(per_text[:-1][which], counts)])
            owners.append(np.repeat(which, counts))
    if not parts:
        none = np.zeros(0, np.uint64)
        elements, owner = none, none.astype(np.int64)
    else:
        elements, owner = np.concatenate(parts), np.concatenate(owners)
        order = np.lexsort((elements, owner))
        elements, owner = elements[order], owner[order]
        new = np.ones(len(elements), bool)
        new[1:] = (elements[1:] != elements[:-1]) | (owner[1:] != owner[:-1])
        elements, owner = elements[new], owner[new]
    return elements, owner, _sequence_hashes(hashes, per_text), _sequence_hashes(tk.mix(hashes ^ _SALT), per_text)


def signed_texts(df: DataFrame, key: str, text: str, words: int = WORDS, slots: int = SLOTS, bands: int = BANDS) -> DataFrame:
    """Key, ``n_shingles``, two class hashes and the band hashes (none for an empty set)."""

    def run(chunk, keys):
        elements, owner, one, two = shingles(chunk, words)
        sizes = np.bincount(owner, minlength=len(chunk))
        bits = superminhash.band_hashes(superminhash.signatures(elements, owner, len(chunk), slots), bands).view(np.int64)
        offsets = np.zeros(len(chunk) + 1, np.int64)
        np.cumsum(np.where(sizes > 0, bands, 0), out=offsets[1:])
        yield [keys, sizes, one.view(np.int64), two.view(np.int64), arrow.list_array(bits[sizes > 0].ravel(), offsets, pa.int64())]

    return arrow.map_texts(df, key, text, "n_shingles long, class1 long, class2 long, bands array<long>", run, "key")


def shingle_sets(df: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows (key, shingles) of rows (key, _text)."""

    def run(chunk, keys):
        elements, owner, _, _ = shingles(chunk, words)
        yield [keys, arrow.list_array(elements.view(np.int64), np.searchsorted(owner, np.arange(len(chunk) + 1)), pa.int64())]

    return arrow.map_texts(df, "key", "_text", "shingles array<long>", run)


def _alike(percent: int):
    both = F.size(F.array_intersect("left", "right"))
    return both * 100 >= F.lit(percent) * (F.size("left") + F.size("right") - both)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those pairs (a, b) whose full sets are alike enough."""
    left = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("left")), "a")
    right = left.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("right")), "b")
    return right.where(_alike(percent)).select("a", "b")


def links_in_block(keys: list, marks: list, sides: np.ndarray, flat: np.ndarray, offsets: np.ndarray, percent: int) -> list[tuple]:
    """Links between texts of different components (``marks``) that join them, checked on
    full sets. Sides 0 and 1: pairs across them; side 2: pairs among all."""
    number, size = np.unique(flat, return_inverse=True)[1], np.diff(offsets)
    sets, found = UnionFind(), []
    here = np.zeros(int(number.max()) + 1 if len(number) else 1, bool)
    cross = not (sides == 2).all()
    roots = np.unique(np.array(marks), return_inverse=True)[1]
    last = np.flatnonzero(sides == 1) if cross else None
    for a in range(len(keys)):
        if cross and sides[a] != 0:
            continue
        other = last if cross else np.arange(a + 1, len(keys))
        if not len(other):
            continue
        fits = (roots[other] != roots[a]) & (np.minimum(size[other], size[a]) * 100 >= percent * np.maximum(size[other], size[a]))
        other = other[fits]
        if not len(other):
            continue
        own = number[offsets[a] : offsets[a + 1]]
        here[own] = True
        members = here[number[tk.ragged_index(offsets[other], size[other])]]
        both = np.add.reduceat(members, np.concatenate([[0], np.cumsum(size[other])[:-1]]), dtype=np.int64)
        here[own] = False
        for b in other[both * 100 >= percent * (size[other] + size[a] - both)].tolist():
            if sets.union(marks[a], marks[b]):
                found.append((keys[a], keys[b]))
                low, high = sorted((roots[a], roots[b]))
                roots[roots == high] = low
    return found


def _mixed_buckets(members: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows (group, side, key, mark) of the buckets of three or more texts with two or more
    components, split into pairs of blocks; buckets of equal members count once."""
    marked = members.where("n > 2").join(labels.select(F.col("node").alias("key"), "component"), "key", "left").join(sizes, "key")
    marked = marked.select("band", "key", F.coalesce("component", "key").alias("mark"), "n_shingles")
    sums = marked.groupBy("band").agg(
        F.min("mark").alias("low"), F.max("mark").alias("high"), F.count("*").alias("n"), F.sum("n_shingles").alias("total"),
        F.expr("bit_xor(xxhash64(key))").alias("x1"), F.expr("bit_xor(xxhash64(key, 1))").alias("x2"),
    )
    mixed = sums.where("low <> high").groupBy("n", "x1", "x2").agg(F.min("band").alias("band"), F.first("total").alias("total"))
    mixed = mixed.select("band", F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rows = marked.join(mixed, "band").withColumn("own", F.pmod(F.xxhash64("key", F.lit(5)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return rows.select(F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other")).alias("group"), side.alias("side"), "key", "mark")


def _block_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found by comparing each group of rows with its sets completely."""
    kind = rows.schema["key"].dataType.simpleString()
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCK_TEXTS))
    full = rows.join(sets, "key").select("group", "side", "key", "mark", "shingles")
    full = full.repartition("group").sortWithinPartitions("group")

    def solve(held: list[pa.RecordBatch]) -> list[tuple]:
        table = pa.Table.from_batches(held).combine_chunks()
        column = table.column("shingles").combine_chunks()
        offsets = column.offsets.to_numpy()
        return links_in_block(table.column("key").to_pylist(), table.column("mark").to_pylist(), table.column("side").to_numpy(), column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0], percent)

    def run(batches):
        held, last, out = [], None, []
        schema = None
        for batch in batches:
            schema = batch.schema
            group = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                if x == y:
                    continue
                if held and group[x] != last:
                    out += solve(held)
                    held = []
                held.append(batch.slice(x, y - x))
                last = group[x]
        if held:
            out += solve(held)
        if out:
            key = schema.field("key").type
            yield pa.RecordBatch.from_arrays([pa.array(c, key) for c in zip(*out, strict=True)], names=["a", "b"])

    return arrow.mapped(full, run, f"a {kind}, b {kind}")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, slots: int = SLOTS, bands: int = BANDS) -> DataFrame:
    """One row for each row of ``df``: the key, ``n_shingles``, ``component_id`` (smallest key
    reachable by links, its own included) and ``kept`` (whether it is the smallest).

    Null and empty texts have no shingles and no links. Rows with a null key are not
    compared: their component is null and they are kept. Rows that repeat a key share its links.
    A task holds the words of one chunk of texts (512 KB, or one longer text with about
    100 bytes a word), the permutations of 65,536 shingles, and in a block of a bucket the
    sets of 500 texts or 500,000 shingles a side, or of one longer text.
    """
    spark = df.sparkSession
    signed = storage.written(signed_texts(df, key, text, words, slots, bands), "signatures")
    full = signed.where("key IS NOT NULL AND n_shingles > 0")
    # written, so that joins with it have two plain exchanges and may split a hot class
    classes = storage.written(full.groupBy("class1", "class2").agg(F.min("key").alias("_rep")), "classes")
    leaders = full.join(classes, ["class1", "class2"]).where(F.col("key") == F.col("_rep")).dropDuplicates(["key", "class1", "class2"])
    banded = leaders.select("key", F.explode("bands").alias("band"))
    shared = storage.written(banded.groupBy("band").agg(F.min("key").alias("root"), F.count("*").alias("n")).where("n > 1"), "shared")
    members = storage.written(banded.join(shared, "band"), "members")
    stars = members.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")).distinct()
    wanted = members.select("key").distinct()
    texts = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(wanted, "key", "left_semi")
    texts = texts.groupBy("key", F.xxhash64("_text").alias("_h")).agg(F.min("_text").alias("_text"))
    sets = storage.written(shingle_sets(texts, words), "sets")
    links = storage.written(confirmed(stars, sets, percent), "links")
    storage.release_shuffles(spark)
    labels = storage.written(components(links), "labels")
    sizes = sets.groupBy("key").agg(F.max(F.size("shingles")).alias("n_shingles"))
    more = storage.written(_block_links(_mixed_buckets(members, labels, sizes), sets, percent), "links")
    storage.release(spark, members, sets)
    if not more.isEmpty():
        labels = storage.written(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "labels")
    own = signed.where("key IS NOT NULL AND n_shingles > 0").join(classes, ["class1", "class2"]).select("key", "_rep").groupBy("key").agg(F.collect_set("_rep").alias("_reps"))
    own = own.select("key", F.explode("_reps").alias("node")).join(labels, "node", "left").groupBy("key").agg(F.min(F.coalesce("component", "node")).alias("_c"))
    out = signed.select("key", "n_shingles").join(own, "key", "left")
    found = F.when(F.col("key").isNotNull(), F.coalesce("_c", "key"))
    return out.select(F.col("key").alias(key), "n_shingles", found.alias("component_id"), F.coalesce(F.col("key") == found, F.lit(True)).alias("kept"))
