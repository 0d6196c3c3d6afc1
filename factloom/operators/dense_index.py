"""Exact dense top-k that leaves out vectors which cannot be among the best.

Each vector belongs to its nearest pivot, and to a ring of those about as far from it. Angles obey the
triangle inequality: a vector is at least as far from a question as the difference of their angles to a pivot.
So the rings bound the scores of what they hold, and only rings that may hold one of the best are compared.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import numbers
from factloom.session import dealt
from factloom.storage import written

DIGITS = 10
#: Documented bound: so many vectors, chosen by a hash, are pivots. They are all that every task has.
PIVOTS = 64
#: Width of a ring in radians.
RING = 0.05
#: Vectors compared first for each of the best ones asked for.
FIRST = 8
#: Vectors of a ring, and questions, that a task compares at a time, at most about; of the questions so many in one product.
VECTORS, QUESTIONS, STEP = 8192, 4096, 512
#: What angles and scores may differ by in the last digits.
ANGLE, SLACK = 1e-6, 1e-9


class Index(NamedTuple):
    """``vectors``: evidence_id, source_id, block_id, v (unit), pivot, ring, angle. ``rings``: pivot, ring, low, high, n. ``pivots``: one row."""

    vectors: DataFrame
    rings: DataFrame
    pivots: DataFrame


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def build(rows: DataFrame) -> Index:
    """The index of records (evidence_id, source_id, block_id, vector); vectors that are null, zero or not finite are left out."""
    own = written(rows.select("evidence_id", "source_id", "block_id", numbers.unit(F.col("vector")).alias("v")).where("v IS NOT NULL"), "vectors")
    chosen = own.orderBy(F.xxhash64("evidence_id"), "evidence_id").limit(PIVOTS)
    pivots = written(chosen.agg(F.transform(F.sort_array(F.collect_list(F.struct("evidence_id", "v"))), lambda p, i: F.struct(i.alias("pivot"), p["v"].alias("p"))).alias("pivots")), "pivots")
    nearest = F.array_max(F.transform("pivots", lambda p: F.struct(numbers.dot(F.col("v"), p["p"]).alias("c"), p["pivot"].alias("pivot"))))
    placed = own.crossJoin(F.broadcast(pivots)).select("evidence_id", "source_id", "block_id", "v", nearest.alias("_n"))  # one row of PIVOTS vectors
    placed = placed.select("evidence_id", "source_id", "block_id", "v", F.col("_n.pivot").alias("pivot"), _angle(F.col("_n.c")).alias("angle"))
    vectors = written(placed.withColumn("ring", F.floor(F.col("angle") / RING).cast("int")), "placed")
    rings = vectors.groupBy("pivot", "ring").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n"))
    return Index(vectors, written(rings, "rings"), pivots)


def bounds(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, q, pivot, ring, n, most): what the vectors of each ring score at most for each question (qid, vector)."""
    asked = queries.select("qid", numbers.unit(F.col("vector")).alias("q")).where("q IS NOT NULL").crossJoin(F.broadcast(index.pivots))
    far = asked.select("qid", "q", F.explode("pivots").alias("p")).select("qid", "q", F.col("p.pivot").alias("pivot"), _angle(numbers.dot(F.col("q"), F.col("p.p"))).alias("_a"))
    rows = far.join(index.rings, "pivot")
    apart = F.greatest(F.col("_a") - F.col("high"), F.col("low") - F.col("_a"), F.lit(ANGLE)) - ANGLE
    return rows.select("qid", "q", "pivot", "ring", "n", (F.cos(apart) + SLACK).alias("most"))


def _matrices(column: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a column, as (places, matrix) for each length."""
    lists = column.combine_chunks()
    ends = lists.offsets.to_numpy()
    sizes, values = np.diff(ends), lists.values.to_numpy(zero_copy_only=False)
    return [(at, values[ends[at][:, None] + np.arange(n)]) for n in np.unique(sizes) for at in [np.flatnonzero(sizes == n)]]


def _best(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of questions (qid, q, least) and vectors of a ring: the k best of each question, of those that score ``least``."""

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = ["evidence_id", "source_id", "block_id"]
        held = held.sort_by([(n, "ascending") for n in ("source_id", "block_id")])  # so that a place settles ties
        least = np.nan_to_num(asked["least"].to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
        vectors, found = _matrices(held["v"]) if held.num_rows else [], []
        for places, matrix in _matrices(asked["q"]) if asked.num_rows and vectors else []:
            for begin in range(0, len(places), STEP):
                of, q = places[begin : begin + STEP], matrix[begin : begin + STEP]
                scores = np.full((len(of), held.num_rows), -np.inf)  # vectors of another length have no score
                for at, v in vectors:
                    if v.shape[1] == q.shape[1]:
                        scores[:, at] = q @ v.T
                low = least[of]
                if held.num_rows > k:
                    low = np.maximum(low, np.partition(scores, -k, axis=1)[:, -k])
                i, j = np.nonzero(scores >= low[:, None] - SLACK)
                score = scores[i, j]
                for at, v in vectors:
                    if v.shape[1] == q.shape[1]:
                        row = np.full(held.num_rows, -1)
                        row[at] = np.arange(len(at))
                        same = row[j] >= 0
                        a, b, total = i[same], row[j[same]], np.zeros(int(same.sum()))
                        for d in range(q.shape[1]):  # in the order of ``numbers.dot``, so that copies have one score
                            total += q[a, d] * v[b, d]
                        score[same] = np.round(total, DIGITS)
                order = np.lexsort((j, -score, i))
                i, j, score = i[order], j[order], score[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                found.append((of[i[keep]], j[keep], score[keep]))
        i, j, score = (np.concatenate([f[n] for f in found]) if found else np.array([], kind) for n, kind in enumerate((int, int, float)))
        columns = [asked["qid"].take(pa.array(i, pa.int64())), *[held[n].take(pa.array(j, pa.int64())) for n in names]]
        return pa.table([*columns, pa.array(score, mask=np.isinf(score))], names=["qid", *names, "score"])

    return best


def _scored(index: Index, rings: DataFrame, k: int, questions: int) -> DataFrame:
    """The k best of each question in each ring that it asks (qid, q, least, pivot, ring), or part of one. Vectors and questions meet
    as matrices, in groups that grow neither with the rings nor with the number of questions."""
    chunks, on = max(1, -(-questions // QUESTIONS)), ["pivot", "ring", "part", "chunk"]
    parts = index.rings.select("pivot", "ring", F.ceil(F.col("n") / VECTORS).cast("int").alias("parts"))
    asked = rings.join(parts, ["pivot", "ring"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.select("qid", "q", "least", "pivot", "ring", "part", F.pmod(F.xxhash64("qid"), F.lit(chunks)).cast("int").alias("chunk"))
    held = index.vectors.join(parts, ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("evidence_id"), F.col("parts")).cast("int"))
    held = held.select("evidence_id", "source_id", "block_id", "v", "pivot", "ring", "part", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    kinds = T.StructType([T.StructField("qid", rings.schema["qid"].dataType), *[index.vectors.schema[n] for n in ("evidence_id", "source_id", "block_id")], T.StructField("score", T.DoubleType())])
    return dealt(asked, *on).groupBy(*on).cogroup(dealt(held, *on).groupBy(*on)).applyInArrow(_best(k), kinds)


def kept_rings(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """The rings of ``bounds`` that may hold one of the k best of their question, and what these score at ``least``."""
    every = written(bounds(index, queries), "bounds")
    order = Window.partitionBy("qid").orderBy(F.col("most").desc(), "pivot", "ring")  # of the rings, which the pivots bound
    first = every.withColumn("_before", F.sum("n").over(order) - F.col("n")).where(F.col("_before") < FIRST * k)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))
    scored = _scored(index, first.withColumn("least", F.lit(None).cast("double")), k, queries.count())
    kth = written(scored.withColumn("_n", place).where(F.col("_n") == k).select("qid", F.col("score").alias("least")), "least")
    return every.join(kth, "qid", "left").where(F.col("most") >= F.coalesce("least", F.lit(-2.0)) - SLACK)


def candidates(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(qid, evidence_id, source_id, block_id, score): cosines among which are the k best of each question, ties by source_id, then block_id."""
    return _scored(index, kept_rings(index, queries, k), k, queries.count())
