"""Complete lexical scores of parts of the records, of which only what is asked for leaves a task.

Records are counted as they are read and fall into parts of bounded size on the way. A part knows its own words; how many
records of all parts have a word is summed by word and goes back to the parts that have it, so that what is exchanged is a
row for each word of a part, not for each posting. Of a record that leaves its norm and the counts of the words that
questions have. Parts then meet chunks of the questions as matrices of scores: all records are scored, also those
without a common word. Hashes of 64 bits stand for words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import text
from factloom.session import dealt
from factloom.storage import written

#: Score digits; scores are rounded, so that the order of partial sums cannot swap near-ties.
DIGITS = 10
#: Records and postings of a part, questions of a chunk, at most about.
RECORDS, POSTINGS, QUESTIONS = 8192, 1 << 21, 256
#: Records of a part that are multiplied at a time.
ROWS = 512
ID = ["evidence_id", "source_id", "block_id"]


class Index(NamedTuple):
    """``records``: evidence_id, source_id, block_id, part, norm, hs array<long>, tfs array<int>, the words that are asked for in the order of
    their hashes. ``asked``: qid, ys array<struct<h, y>>, chunk. A score is the sum of tf * y over the norm."""

    records: DataFrame
    asked: DataFrame
    chunks: int


def _lists(offsets: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    at = pa.array(offsets, pa.int32())
    return [pa.ListArray.from_arrays(at, pa.array(v)) for v in values]


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and values of a column of arrays without nulls."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[0], lists.flatten().to_numpy()


def _count(batches: Iterator[pa.RecordBatch], records: int, postings: int) -> Iterator[pa.RecordBatch]:
    """Counts of the sorted hashes of each record. A task begins a part where the one before is full."""
    task, size = TaskContext.get().partitionId() << 32, 0.0
    for batch in batches:
        offsets, h = _flat(batch.column("hs"))
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        new[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(new)
        ends = np.concatenate([[0], np.cumsum(new)])[offsets]
        sizes = size + np.cumsum(np.diff(ends) / postings + 1 / records)
        size = float(sizes[-1]) if len(sizes) else size
        hs, tfs = _lists(ends, h[starts], np.diff(starts, append=len(h)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ID], pa.array(task + sizes.astype(np.int64)), hs, tfs], names=[*ID, "part", "hs", "tfs"])


def _words(batches: Iterator[pa.RecordBatch], postings: int) -> Iterator[pa.RecordBatch]:
    """(part, h, n): in how many records of a part a word is, perhaps in several rows."""
    held, own, size = [], None, 0

    def summed():
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), own)), pa.array(h), pa.array(n)], names=["part", "h", "n"])

    for batch in batches:
        offsets, h = _flat(batch.column("hs"))
        part = batch.column("part").to_numpy()
        begins = np.flatnonzero(np.diff(part, prepend=part[:1] - 1))
        for begin, end in zip(begins, [*begins[1:], len(part)]):
            if held and (part[begin] != own or size > postings):
                yield summed()
                held, size = [], 0
            own = part[begin]
            held.append(h[offsets[begin] : offsets[end]])
            size += len(held[-1])
    if held:
        yield summed()


def _normed(held: pa.Table, words: pa.Table, n: int) -> pa.Table:
    """The norms of the records of a part, and what they have of the words that are asked for."""
    offsets, h = _flat(held["hs"])
    tf = _flat(held["tfs"])[1]
    words = words.sort_by("h")
    at = np.searchsorted(words["h"].to_numpy(), h)
    idf = np.log((n + 1) / (words["df"].to_numpy() + 1)) + 1
    row = np.repeat(np.arange(held.num_rows), np.diff(offsets))
    norm = np.sqrt(np.bincount(row, weights=(tf * idf[at]) ** 2, minlength=held.num_rows))
    keep = words["asked"].to_numpy()[at]
    hs, tfs = _lists(np.concatenate([[0], np.cumsum(keep)])[offsets], h[keep], tf[keep])
    return pa.table([*[held[c] for c in [*ID, "part"]], pa.array(norm), hs, tfs], names=[*ID, "part", "norm", "hs", "tfs"])


def build(rows: DataFrame, queries: DataFrame) -> Index:
    """The index of records (evidence_id, source_id, block_id, text), whose ids name one row each, for questions (qid, text)."""
    hashes = lambda t: F.transform(text.terms(t), lambda w: F.xxhash64(w))
    own = rows.select(*ID, F.coalesce(F.sort_array(hashes(F.col("text"))), F.array().cast("array<bigint>")).alias("hs"))
    kinds = T.StructType([*own.schema.fields[:3], *T.StructType.fromDDL("part long, hs array<long>, tfs array<int>").fields])
    records = written(own.mapInArrow(partial(_count, records=RECORDS, postings=POSTINGS), kinds), "records")
    n = records.count()
    words = records.select("part", "hs").mapInArrow(partial(_words, postings=POSTINGS), "part long, h long, n long")
    counts = written(queries.select("qid", F.explode(hashes(F.col("text"))).alias("h")).groupBy("qid", "h").agg(F.count("*").alias("tf")), "asked")
    terms = counts.select("h").distinct().withColumn("asked", F.lit(True))
    df = F.sum("n").over(Window.partitionBy("h")).alias("df")  # about as many rows as there are parts
    known = words.select("part", "h", df).join(terms, "h", "left").select("part", "h", "df", F.coalesce("asked", F.lit(False)).alias("asked"))
    found = dealt(records, "part").groupBy("part").cogroup(dealt(known, "part").groupBy("part"))
    kinds = T.StructType([*own.schema.fields[:3], *T.StructType.fromDDL("part long, norm double, hs array<long>, tfs array<int>").fields])
    normed = written(found.applyInArrow(partial(_normed, n=n), kinds), "normed")
    df = records.select(F.explode("hs").alias("h")).join(terms.select("h"), "h", "left_semi").groupBy("h").agg(F.count("*").alias("df"))
    return Index(normed, *_asked(queries, counts, df, n))


def _asked(queries: DataFrame, counts: DataFrame, known: DataFrame, n: int) -> tuple[DataFrame, int]:
    weighted = counts.join(known, "h").withColumn("idf", F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1).withColumn("q", F.col("tf") * F.col("idf"))
    each = weighted.groupBy("qid").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qnorm"), F.collect_list(F.struct("h", "idf", "q")).alias("ws"))
    ys = F.transform("ws", lambda w: F.struct(w["h"].alias("h"), (w["q"] * w["idf"] / F.col("qnorm")).alias("y"))).alias("ys")
    every = queries.select("qid").distinct()
    chunks = max(1, -(-every.count() // QUESTIONS))
    return written(every.join(each.select("qid", ys), "qid", "left").withColumn("chunk", F.pmod(F.xxhash64("qid"), F.lit(chunks)).cast("int")), "questions"), chunks


def _by_term(asked: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The words of the questions in the order of their hashes, and their weights as a row for each word."""
    lists = asked["ys"].combine_chunks()
    flat = lists.flatten()
    terms, place = np.unique(flat.field("h").to_numpy(), return_inverse=True)
    weights = np.zeros((len(terms), asked.num_rows))
    weights[place, lists.value_parent_indices().to_numpy()] = flat.field("y").to_numpy()
    return terms, weights


def scores(asked: pa.Table, held: pa.Table) -> np.ndarray:
    """Scores of records with questions. The products of a record are summed in the order of its words, so that copies have one score."""
    found = np.zeros((held.num_rows, asked.num_rows))
    terms, weights = _by_term(asked)
    if not len(terms):
        return found
    offsets, h = _flat(held["hs"])
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    keep = terms[at] == h
    at, tf = at[keep], _flat(held["tfs"])[1][keep].astype(float)
    offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    for begin in range(0, int(np.count_nonzero(sizes)), ROWS):  # the n-th word of several records at a time
        rows = order[begin : begin + ROWS]
        total, first, size = np.zeros((len(rows), asked.num_rows)), offsets[rows], sizes[rows]
        for word in range(size[0]):
            some = first[: np.searchsorted(-size, -word)] + word
            product = weights[at[some]]
            product *= tf[some, None]
            total[: len(some)] += product
        rows = rows[size > 0]
        found[rows] = np.round(total[: len(rows)] / held["norm"].to_numpy()[rows, None], DIGITS)
    return found


def placed(held: pa.Table) -> pa.Table:
    """Records in the order that settles ties."""
    return held.take(pc.sort_indices(held, sort_keys=[("source_id", "ascending"), ("block_id", "ascending")], null_placement="at_start"))


def _met(records: DataFrame, asked: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], kinds: T.StructType) -> DataFrame:
    """Records with the questions of their part and chunk."""
    on = ["part", "chunk"]
    return dealt(asked, *on).groupBy(*on).cogroup(dealt(records, *on).groupBy(*on)).applyInArrow(kernel, kinds)


def _everywhere(index: Index, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of every part with every chunk, and the questions with every part."""
    records = index.records.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(index.chunks - 1))))
    return records, asked.crossJoin(index.records.select("part").distinct().select(F.col("part").alias("part")))  # a column of its own


def _kinds(index: Index, columns: list[str], more: str) -> T.StructType:
    known = {f.name: f for f in [*index.asked.schema.fields, *index.records.schema.fields]}
    return T.StructType([*[known[c] for c in columns], *T.StructType.fromDDL(more).fields])


def _first(asked: pa.Table, held: pa.Table, k: int) -> pa.Table:
    """The first k records of the part for each question."""
    held = placed(held)
    score = scores(asked, held).T
    k = min(k, held.num_rows)
    least = np.partition(score, held.num_rows - k, axis=1)[:, held.num_rows - k] if k else np.zeros(asked.num_rows)
    rows, places = [np.array([], np.int64)], [np.array([], np.int64)]
    for n in range(asked.num_rows if k else 0):
        able = np.flatnonzero(score[n] >= least[n])
        places.append(able[np.argsort(-score[n][able], kind="stable")[:k]])
        rows.append(np.full(k, n))
    i, j = np.concatenate(rows), np.concatenate(places)
    return pa.table([asked["qid"].take(pa.array(i)), *[held[c].take(pa.array(j)) for c in ID], pa.array(score[i, j])], names=["qid", *ID, "score"])


def topk(index: Index, k: int) -> DataFrame:
    """(qid, rank, evidence_id, score) of the k best of all records for each question; ties go by source_id, then block_id."""
    kernel = partial(_first, k=k)
    first = _met(*_everywhere(index, index.asked), kernel, _kinds(index, ["qid", *ID], "score double"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "source_id", "block_id"))  # k of each part
    return first.withColumn("rank", place).where(F.col("rank") <= k).select("qid", "rank", "evidence_id", "score")


def _wanted(asked: pa.Table, held: pa.Table) -> pa.Table:
    """The scores of the records that a question names."""
    score = scores(asked, held)
    lists = asked["wanted"].combine_chunks()
    i, j = lists.value_parent_indices(), pc.index_in(lists.flatten(), value_set=held["evidence_id"].combine_chunks())
    return pa.table([asked["qid"].take(i), *[held[c].take(j) for c in ID], pa.array(score[j.to_numpy(), i.to_numpy()])], names=["qid", *ID, "score"])


def before(names: list[tuple], name: tuple) -> int:
    """How many of the sorted names are less; by their bytes and nulls first, as Spark orders them."""
    key = lambda n: tuple((x is not None, x.encode() if isinstance(x, str) else x) for x in n)
    low, high = 0, len(names)
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if key(names[middle]) < key(name) else (low, middle)
    return low


def _ahead(asked: pa.Table, held: pa.Table) -> pa.Table:
    """How many records of the part stand before the best one of each question."""
    held = placed(held)
    score = scores(asked, held).T
    best = asked["score"].to_numpy()
    ahead = np.count_nonzero(score > best[:, None], axis=1)
    names = list(zip(held["source_id"].to_pylist(), held["block_id"].to_pylist()))
    for n, name in enumerate(zip(asked["source_id"].to_pylist(), asked["block_id"].to_pylist())):
        ahead[n] += np.count_nonzero(score[n, : before(names, name)] == best[n])
    return pa.table([asked["qid"], pa.array(ahead)], names=["qid", "ahead"])


def first_ranks(index: Index, expected: DataFrame) -> DataFrame:
    """(qid, first_rank): the best rank of a record of (qid, evidence_id) in the complete ranking, which is not made: the records
    before it are counted. Null if none of them is among the records."""
    expected = expected.select("qid", "evidence_id").distinct()
    pairs = written(expected.join(index.asked.select("qid", "chunk"), "qid").join(index.records.select("evidence_id", "part"), "evidence_id"), "pairs")
    own = pairs.select("evidence_id", "chunk").distinct().join(index.records, "evidence_id")
    named = pairs.groupBy("qid", "part").agg(F.collect_list("evidence_id").alias("wanted")).join(index.asked, "qid")
    found = _met(own, named, _wanted, _kinds(index, ["qid", *ID], "score double"))
    place = F.struct((0 - F.col("score")).alias("s"), "source_id", "block_id")
    best = written(found.groupBy("qid").agg(F.min(place).alias("b")).select("qid", (0 - F.col("b.s")).alias("score"), "b.source_id", "b.block_id"), "best")
    ahead = _met(*_everywhere(index, index.asked.join(best, "qid")), _ahead, _kinds(index, ["qid"], "ahead long"))
    ranks = ahead.groupBy("qid").agg((F.sum("ahead") + 1).alias("first_rank"))
    return expected.select("qid").distinct().join(ranks, "qid", "left")
