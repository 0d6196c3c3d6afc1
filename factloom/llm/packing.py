"""Best-fit-decreasing packing of tokenised documents (operator 10).

Pieces of equal length are interchangeable, so the packing is computed on the
histogram of lengths, which has at most ``size`` rows however many pieces there
are. A segment tree over remaining capacities finds the tightest open bin for a
length; bins of equal capacity are kept as runs of consecutive numbers, and a run
is filled at once. The result is the one that placing document after document in
descending length would give, as runs (length, first ordinal, count, first bin,
offset) that the pieces look up by their ordinal among those of their length.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import arrow, storage
from factloom.llm.word_bpe import word_encoder


class CapacityTree:
    """Which capacities have open bins; finds the least such capacity >= x in O(log n)."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.any = [False] * (2 * self.width)

    def put(self, capacity: int, there: bool) -> None:
        i = self.width + capacity
        self.any[i] = there
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = self.width + least
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return None


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first ordinal, count, first bin, offset) of best-fit decreasing."""
    tree, open_bins, bins = CapacityTree(size), defaultdict(list), 0
    runs: list[tuple[int, int, int, int, int]] = []

    def keep(capacity: int, first: int, count: int) -> None:
        if capacity and count:
            open_bins[capacity].append((first, count))
            tree.put(capacity, True)

    for length in sorted(histogram, reverse=True):
        left, ordinal = histogram[length], 0

        def fill(capacity: int, first: int, count: int, each: int, length: int = length) -> None:
            """Puts ``each`` pieces into each of ``count`` bins, bin by bin in BFD order."""
            nonlocal left, ordinal
            for k in range(each):
                runs.append((length, ordinal, count, first, size - capacity + k * length))
                ordinal += count
            left -= each * count
            keep(capacity - each * length, first, count)

        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity = size
                each = capacity // length
                first, count = bins, -(-left // each)
                bins += count
            else:
                each = capacity // length
                first, count = open_bins[capacity].pop()
                if not open_bins[capacity]:
                    tree.put(capacity, False)
            full = min(count, left // each)
            rest = left - full * each
            if full:
                fill(capacity, first, full, each)
            if full < count and rest:
                fill(capacity, first + full, 1, rest)
                full += 1
            keep(capacity, first + full, count - full)
    return runs


def token_pieces(df: DataFrame, key: str, text: str, path: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenises whole texts (null: empty), appends ``end_id`` and cuts into pieces of ``size``.

    Returns the key, ``piece``, ``start``, ``length`` and ``ids``: the piece's ids as
    little-endian unsigned 32-bit numbers. An empty text has one piece, the end id.
    """

    def run(chunk, keys):
        ids, offsets = word_encoder(path).encode_chunk(chunk)
        row, piece, start, length, packed = [], [], [], [], []
        end = np.array([end_id], "<u4")
        ids = ids.astype("<u4")
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            own = np.concatenate([ids[a:b], end])
            for n, at in enumerate(range(0, len(own), size)):
                part = own[at : at + size]
                row.append(k), piece.append(n), start.append(at), length.append(len(part)), packed.append(part.tobytes())
        yield [keys.take(pa.array(row, pa.int64())), piece, start, length, packed]

    return arrow.map_texts(df, key, text, "piece int, start long, length long, ids binary", run)


def pack(pieces: DataFrame, key: str, size: int = 4096) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have ``length`` (1 to ``size``).

    ``pieces`` is read twice and should be a written table. Rows of any key, also
    null and repeated ones, are packed. An empty table gives an empty table. Ordinals within a
    length are counted in salted groups, so that no length lands in one task. The
    runs that are broadcast depend on ``size`` alone, not on the number of pieces.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    runs = plan(histogram, size)
    salts = min(4096, max(16, math.ceil(max(histogram.values(), default=0) / 1000)))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(F.col(key), "piece", "start"), F.lit(salts)).cast("int"))
    sums = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = sums.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(key, "piece", "start")) - 1)
    ordinal = ranked.join(before, ["length", "_salt"]).withColumn("_ordinal", F.col("_before") + F.col("_rank"))
    table = spark.createDataFrame(runs or [(0, 0, 0, 0, 0)], "length long, _first long, _count long, _bin long, offset long")
    inside = (ordinal["length"] == table["length"]) & (F.col("_ordinal") >= F.col("_first")) & (F.col("_ordinal") < F.col("_first") + F.col("_count"))
    placed = ordinal.join(F.broadcast(table), inside).drop(table["length"])
    return placed.select(*pieces.columns, (F.col("_bin") + F.col("_ordinal") - F.col("_first")).alias("sequence_id"), "offset")


def tokenise_and_pack(df: DataFrame, key: str, text: str, path: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with the CRC of their ids and their place."""
    pieces = token_pieces(df, key, text, path, size, end_id).select(key, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(storage.written(pieces, "pieces"), key, size)
