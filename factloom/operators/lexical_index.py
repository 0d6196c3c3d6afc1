"""Lexical retrieval with an index whose blocks are skipped where they cannot matter.

Records are kept twice: forward, a row a record with the weights of its terms, and inverted, as blocks of
postings. A block holds postings of one term whose impacts (weight over the record's norm) are alike, and
knows the greatest of them. A question that needs all records of at least some score splits that score
into limits, one for each of its terms: a record that stays below every limit stays below the score, so
only blocks that reach their term's limit are read. What they hold is bounded again record by record, and what
is left is scored exactly.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.functions.frames import settled
from factloom.session import dealt
from factloom.storage import written

#: Score digits; scores are rounded, so that the order of partial sums cannot swap near-ties.
DIGITS = 10
#: Postings of a block, at most about.
BLOCK = 2048
#: So many levels of impact to a factor of two.
STEPS = 2
#: Records looked at first for each of the best ones asked for, to learn what these score at least.
FIRST = 6
#: Part of a score that is split into limits. What is left over a record must reach with the blocks that are read.
SPLIT = 0.15
#: What bounds and scores may differ by in the last digits.
SLACK = 1e-9


class Index(NamedTuple):
    """``records``: evidence_id, source_id, block_id, counts array<struct<term, tf>>. ``norms``: evidence_id, norm. ``terms``: term, df, idf.
    ``parts``: how many blocks the postings of a term and level are dealt to."""

    records: DataFrame
    norms: DataFrame
    terms: DataFrame
    parts: int


def _counts(records: DataFrame) -> DataFrame:
    return records.select("evidence_id", F.explode("counts").alias("c")).select("evidence_id", "c.term", "c.tf")


def counted(rows: DataFrame) -> DataFrame:
    """Records with the counts of their terms, made inside each text: runs of its sorted terms."""
    rows = settled(rows, {"_sorted": F.sort_array(text.terms(F.col("text")))})
    size = F.size("_sorted")
    begins = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get("_sorted", i) != F.get("_sorted", i - 1)))
    rows = settled(rows, {"_begins": F.when(size > 0, begins).otherwise(F.array().cast("array<int>"))})
    run = lambda i, k: F.struct(F.get("_sorted", i).alias("term"), (F.coalesce(F.get("_begins", k + 1), size) - i).alias("tf"))
    return rows.select("evidence_id", "source_id", "block_id", F.transform("_begins", run).alias("counts"))


def build(rows: DataFrame) -> Index:
    """The index of records (evidence_id, source_id, block_id, text), whose ids name one row each. Nothing of the
    texts is exchanged; (term, n) rows, summed in each task, are for the vocabulary, and the postings once
    for the norms, unless the vocabulary is small enough for Spark to broadcast."""
    records = written(counted(rows), "records")
    n = records.count()
    terms = written(_counts(records).groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1), "terms")
    weight = F.col("tf") * F.col("idf")
    norms = written(_counts(records).join(terms, "term").groupBy("evidence_id").agg(F.sqrt(F.sum(weight * weight)).alias("norm")), "norms")
    return Index(records, norms, terms, max(1, -(-n // BLOCK)))


def ask(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, term, idf, q, qnorm): the weights of the known terms of questions (qid, text)."""
    counts = queries.select("qid", F.explode(text.terms(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("tf"))
    weighted = counts.join(index.terms, "term").select("qid", "term", "idf", (F.col("tf") * F.col("idf")).alias("q"))
    norms = weighted.groupBy("qid").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qnorm"))
    return written(weighted.join(norms, "qid"), "asked")


def blocks(index: Index, asked: DataFrame) -> DataFrame:
    """(term, level, part, most, n, postings) of the terms asked for. The postings of a common term are dealt to
    ``parts`` blocks a level, so that none grows with the records."""
    known = asked.groupBy("term").agg(F.max("idf").alias("idf"))
    postings = _counts(index.records).join(known, "term").join(index.norms, "evidence_id").select("evidence_id", "term", (F.col("tf") * F.col("idf") / F.col("norm")).alias("x"))
    level = F.floor(-STEPS * F.log2(F.col("x"))).cast("int")
    part = F.pmod(F.xxhash64("evidence_id"), F.lit(index.parts)).cast("int")
    grouped = dealt(postings.select("*", level.alias("level"), part.alias("part")), "term", "level", "part").groupBy("term", "level", "part")
    return written(grouped.agg(F.max("x").alias("most"), F.count("*").alias("n"), F.collect_list(F.struct("evidence_id", "x")).alias("postings")), "blocks")


def exact(index: Index, asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(qid, evidence_id, score) of the given pairs (qid, evidence_id)."""
    own = dealt(pairs, "evidence_id").join(index.records.select("evidence_id", "counts"), "evidence_id").select("qid", "evidence_id", F.explode("counts").alias("c")).select("qid", "evidence_id", "c.term", "c.tf")
    sums = own.join(asked, ["qid", "term"]).groupBy("qid", "evidence_id", "qnorm").agg(F.sum(F.col("tf") * F.col("idf") * F.col("q")).alias("s"))
    return sums.join(index.norms, "evidence_id").select("qid", "evidence_id", F.round(F.col("s") / (F.col("norm") * F.col("qnorm")), DIGITS).alias("score"))


def _bound(asked: DataFrame) -> DataFrame:
    return asked.select("qid", "term", (F.col("q") / F.col("qnorm")).alias("y"))


def limits(asked: DataFrame, held: DataFrame, least: DataFrame) -> DataFrame:
    """(qid, term, y, least, limit, rest): how the part ``SPLIT`` of the score ``least`` of each question (qid, least) is
    split among its terms, and the sum of the limits. The limits that come first are those of terms that
    have many postings for the most they can give: a term whose whole range fits under its limit is
    not read at all."""
    sums = held.groupBy("term").agg(F.max("most").alias("most"), F.sum("n").alias("n"))
    rows = _bound(asked).join(sums, "term").join(least, "qid").withColumn("most", F.col("y") * F.col("most") * (1 + SLACK) + SLACK)
    order = Window.partitionBy("qid").orderBy((F.col("n") / F.col("most")).desc(), "term")  # as many rows as the question has terms
    before = F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("limit", F.greatest(F.lit(0.0), F.least(F.col("most"), SPLIT * F.col("least") - SLACK - F.coalesce(before, F.lit(0.0)))))
    return rows.withColumn("rest", F.sum("limit").over(Window.partitionBy("qid"))).select("qid", "term", "y", "least", "limit", "rest")


def kept_heads(split: DataFrame, held: DataFrame) -> DataFrame:
    """The blocks, without their postings, that reach the limit of a question's term."""
    heads = held.select("term", "level", "part", "most", "n")
    return split.join(heads, "term").where(F.col("y") * F.col("most") * (1 + SLACK) + SLACK > F.col("limit"))


def at_least(index: Index, asked: DataFrame, held: DataFrame, least: DataFrame) -> DataFrame:
    """(qid, evidence_id, score) of all records that share a term with a question and have at least its score
    ``least`` (qid, least); questions without one are not answered.

    A block is read once for all questions that keep it. All blocks of a record have one ``part``, so that
    records are summed where the blocks of their part are, and only what may be good enough goes on.
    """
    need = F.col("least") - F.col("rest")  # the terms whose blocks are not read give less than their limits
    by = F.collect_list(F.struct("qid", "y", "limit", need.alias("need"))).alias("by")
    kept = kept_heads(limits(asked, held, least), held).groupBy("term", "level", "part").agg(by)
    read = dealt(held.select("term", "level", "part", "postings").join(kept, ["term", "level", "part"]), "part")
    each = read.select("part", "by", F.explode("postings").alias("p")).select("part", "p", F.explode("by").alias("q"))
    found = each.groupBy("part", F.col("q.qid").alias("qid"), F.col("p.evidence_id").alias("evidence_id")).agg(F.sum(F.col("q.y") * F.col("p.x") - F.col("q.limit")).alias("over"), F.max("q.need").alias("need"))
    able = found.where(F.col("over") >= F.col("need") - SLACK).select("qid", "evidence_id")
    return exact(index, asked, able).join(least, "qid").where(F.col("score") >= F.col("least") - SLACK).drop("least")


def least_of_best(index: Index, asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """(qid, least): a score that the k best records of a question have at least, learned from the records of
    its blocks of the highest bounds; 0 where those are fewer than k."""
    first = FIRST * k
    levels = held.groupBy("term", "level").agg(F.max("most").alias("most"), F.sum("n").alias("n"))
    rows = _bound(asked).join(levels, "term").withColumn("most", F.col("y") * F.col("most"))
    order = Window.partitionBy("qid").orderBy(F.col("most").desc(), "term", "level")  # terms times levels
    best = rows.withColumn("before", F.sum("n").over(order) - F.col("n")).where(F.col("before") < first)
    parts = F.ceil(F.lit(index.parts * first) / F.col("n"))
    seeds = best.select("qid", "term", "level", parts.alias("parts")).join(held.select("term", "level", "part", F.slice("postings", 1, first).alias("postings")), ["term", "level"])
    pairs = seeds.where(F.col("part") < F.col("parts")).select("qid", F.explode("postings.evidence_id").alias("evidence_id")).distinct()
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))  # of the seeds
    kth = exact(index, asked, pairs).withColumn("_n", place).where(F.col("_n") == k).select("qid", F.col("score").alias("least"))
    return written(asked.select("qid").distinct().join(kth, "qid", "left").select("qid", F.coalesce("least", F.lit(0.0)).alias("least")), "least")


def candidates(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(qid, evidence_id, score): scores of records among which are the k best of each question, ties of the last included."""
    asked = ask(index, queries)
    held = blocks(index, asked)
    return at_least(index, asked, held, least_of_best(index, asked, held, k))
