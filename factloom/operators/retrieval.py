"""Lexical, dense and hybrid retrieval for batches of queries.

Records have evidence_id, source_id, block_id and text (or vector); queries have
qid and text (or vector). Scores are rounded before ranking, so that the order of
partial sums cannot swap near-ties; ties go by source_id, then block_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import numbers, text
from factloom.operators import dense_index, fusion, lexical_parts, ordinals
from factloom.storage import written

DIGITS = lexical_parts.DIGITS
RRF_K = 60
#: How deep rankings are looked at first for an expected record: enough where it is the first of one.
FIRST_DEPTH = 128
#: Rows of a question are joined to what is known of the question in so many pieces.
PIECES = 64


def records(blocks: DataFrame) -> DataFrame:
    """Retrieval records of blocks; blank ones are left out."""
    keep = blocks.where(~text.is_blank(F.col("text")))
    return keep.select(F.concat_ws(":", "source_id", "block_id").alias("evidence_id"), "source_id", "block_id", "text")


def restrict(rows: DataFrame, sources: list[str]) -> DataFrame:
    """Only the given sources; before an index is made, so that idf follows the restriction."""
    return rows.where(F.col("source_id").isin(sources))


def weights(rows: DataFrame, key: str = "evidence_id") -> DataFrame:
    """Unit-length TF-IDF rows (key, term, weight) with smooth idf ln((1+n)/(1+df)) + 1.

    Term counts are made inside each text before anything is shuffled; the number of
    texts is a scalar subquery, not a collected value.
    """
    counted = _counts(rows, key)
    texts = rows.agg(F.count("*").alias("n")).scalar()
    idf = counted.groupBy("term").agg(F.count("*").alias("df")).select("term", (F.log((texts + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    raw = counted.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("raw"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("raw") / F.col("norm")).alias("weight"), F.col("raw"))


def _counts(rows: DataFrame, key: str) -> DataFrame:
    found = rows.select(key, F.explode(text.terms(F.col("text"))).alias("term"))
    return found.groupBy(key, "term").agg(F.count("*").alias("tf"))


def lexical_scores(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, evidence_id, score) of records that share a term with a query. Query vectors
    use the idf of the records and ignore other terms."""
    counted = _counts(rows, "evidence_id")
    texts = rows.agg(F.count("*").alias("n")).scalar()
    idf = counted.groupBy("term").agg(F.count("*").alias("df")).select("term", (F.log((texts + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    asked = _counts(queries, "qid").join(idf, "term").select("qid", "term", (F.col("tf") * F.col("idf")).alias("q"), "idf")
    qnorm = asked.groupBy("qid").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qnorm"))
    weighted = counted.join(idf, "term").select("evidence_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = weighted.groupBy("evidence_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    hits = weighted.join(asked.select("qid", "term", "q"), "term").groupBy("qid", "evidence_id").agg(F.sum(F.col("w") * F.col("q")).alias("s"))
    scored = hits.join(norm, "evidence_id").join(qnorm, "qid")
    return scored.select("qid", "evidence_id", F.round(F.col("s") / (F.col("norm") * F.col("qnorm")), DIGITS).alias("score"))


def dense_scores(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, evidence_id, score): cosine of every query with every record that has a usable vector."""
    own = rows.select("evidence_id", numbers.unit(F.col("vector")).alias("v")).where("v IS NOT NULL")
    asked = queries.select("qid", numbers.unit(F.col("vector")).alias("q")).where("q IS NOT NULL")
    return own.crossJoin(asked).select("qid", "evidence_id", F.round(numbers.dot(F.col("v"), F.col("q")), DIGITS).alias("score"))


def _order(score: str = "score") -> list[Column]:
    return [F.col(score).desc(), F.col("source_id"), F.col("block_id")]


def top(scores: DataFrame, rows: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """The k best records of each query, with their rank. The limit is applied in each task
    before the shuffle by query. With ``queries`` (qid), queries with fewer scored records are
    filled up with records of score 0 in their order, for which the first 2k records suffice."""
    joined = scores.join(rows.select("evidence_id", "source_id", "block_id"), "evidence_id").select("qid", "evidence_id", "source_id", "block_id", "score")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(*_order())).alias("rank")
    best = joined.select("*", place).where(F.col("rank") <= k)
    if queries is not None:
        first = rows.select("evidence_id", "source_id", "block_id").orderBy("source_id", "block_id").limit(2 * k)
        other = queries.select("qid").distinct().crossJoin(F.broadcast(first)).join(best.select("qid", "evidence_id"), ["qid", "evidence_id"], "left_anti")
        every = best.drop("rank").unionByName(other.withColumn("score", F.lit(0.0)))
        best = every.select("*", place).where(F.col("rank") <= k)
    return best.select("qid", "rank", "evidence_id", "score")


def of_question(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (qid, evidence_id, ...) with what is known of each question (qid, ...). A question's rows are as
    many as the records, so they are joined in pieces, not by qid alone."""
    pieces = known.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    return rows.withColumn("_piece", F.pmod(F.xxhash64("evidence_id"), F.lit(PIECES)).cast("int")).join(pieces, ["qid", "_piece"]).drop("_piece")


def full_ranks(scores: DataFrame, rows: DataFrame, queries: DataFrame, name: str) -> DataFrame:
    """Ranks of all records for each query; records without a score count as 0."""
    every = rows.select("evidence_id", "source_id", "block_id").crossJoin(queries.select("qid"))
    joined = every.join(scores, ["qid", "evidence_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return ordinals.positions(joined, ["qid"], _order(), name).select("qid", "evidence_id", "source_id", "block_id", name)


def fuse(lexical: DataFrame, dense: DataFrame, k: int | None = 10, constant: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two complete rankings."""
    both = lexical.join(dense.select("qid", "evidence_id", "dense_rank"), ["qid", "evidence_id"])
    score = 1 / (F.lit(constant) + F.col("lexical_rank")) + 1 / (F.lit(constant) + F.col("dense_rank"))
    scored = both.withColumn("score", F.round(score, 12))
    if k is None:
        return ordinals.positions(scored, ["qid"], _order(), "rank").select("qid", "rank", "evidence_id", "score")
    # limited in each task before the exchange
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*_order()))).where(F.col("rank") <= k)
    return ranked.select("qid", "rank", "evidence_id", "score")


def hybrid(rows: DataFrame, queries: DataFrame, k: int | None = 10) -> DataFrame:
    """Hybrid top-k of both complete rankings, fused by ranks. With a limit neither is made: a record of the k best is among
    the first 60 + 2k of one, for the first k of one leg are fused to more than any other record. Evidence ids are unique."""
    if k is not None:
        held = fusion.build(rows, queries)
        ranked = fusion.ranks(held, held.asked.select("qid", F.lit(RRF_K + 2 * k).alias("depth"), F.array().cast("array<string>").alias("wanted")))
        return fuse(ranked.select("qid", "evidence_id", "source_id", "block_id", "lexical_rank"), ranked, k)
    lexical = full_ranks(lexical_scores(rows, queries), rows, queries, "lexical_rank")
    dense = full_ranks(dense_scores(rows, queries), rows, queries, "dense_rank")
    return fuse(lexical, dense, k)


def first_ranks(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """(qid, first_rank): the best rank of an expected record, null if none was found."""
    hit = ranked.join(expected, ["qid", "evidence_id"]).groupBy("qid").agg(F.min("rank").alias("first_rank"))
    return expected.select("qid").distinct().join(hit, "qid", "left")


def complete_first_ranks(scores: DataFrame, rows: DataFrame, expected: DataFrame) -> DataFrame:
    """``first_ranks`` over the complete ranking of all records (those without a score count as
    0), which is not made: the records before the best expected one are counted. ``scores`` may leave
    out records that come behind the best expected one."""
    named = rows.select("evidence_id", "source_id", "block_id")
    expected = expected.select("qid", "evidence_id").distinct()
    place = F.struct((0 - F.coalesce("score", F.lit(0.0))).alias("s"), "source_id", "block_id")
    hits = expected.join(named, "evidence_id").join(scores, ["qid", "evidence_id"], "left")
    best = written(hits.groupBy("qid").agg(F.min(place).alias("best")), "best")
    ahead = of_question(scores.join(named, "evidence_id"), best)
    at, least = F.struct("source_id", "block_id"), F.struct("best.source_id", "best.block_id")
    counts = ahead.groupBy("qid").agg(F.count_if(place < F.col("best")).alias("ahead"), F.count_if(at < least).alias("scored"))
    # of a best record without a score: all records before it, less those with a score
    every = named.crossJoin(best.where("best.s = 0").select("qid", least.alias("least"))).groupBy("qid").agg(F.count_if(at < F.col("least")).alias("every"))
    found = best.join(counts, "qid", "left").join(every, "qid", "left").na.fill(0, ["ahead", "scored", "every"])
    unscored = F.when(F.col("best.s") == 0, F.col("every") - F.col("scored")).otherwise(0)
    ranked = found.select("qid", (1 + F.col("ahead") + unscored).alias("first_rank"))
    return expected.select("qid").distinct().join(ranked, "qid", "left")


def dense_topk(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``top`` of all cosines, of which only those are made that can be among the best."""
    found = dense_index.candidates(dense_index.build(rows), queries, k)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(*_order()))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("qid", "rank", "evidence_id", "score")


def lexical_topk(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``top`` of all lexical scores, with the records without one; only the best of each part of the records leave their task."""
    return lexical_parts.topk(lexical_parts.build(rows, queries), k)


def lexical_first_ranks(rows: DataFrame, queries: DataFrame, expected: DataFrame) -> DataFrame:
    """``complete_first_ranks`` of the lexical scores, which stay in their tasks: numbers of records ahead leave them."""
    return lexical_parts.first_ranks(lexical_parts.build(rows, queries), expected)


def hybrid_first_ranks(rows: DataFrame, queries: DataFrame, expected: DataFrame) -> DataFrame:
    """``first_ranks`` over the complete hybrid ranking, which is not made. What the best expected record is fused to says how
    deep a record before it can be; questions for which the first look was not as deep get another."""
    held = fusion.build(rows, queries)
    wanted = written(expected.join(held.asked.select("qid"), "qid", "left_semi").groupBy("qid").agg(F.collect_set("evidence_id").alias("wanted")), "wanted")
    ranked = _fused(written(fusion.ranks(held, wanted.select("qid", F.lit(FIRST_DEPTH).alias("depth"), "wanted")), "fused"))
    place = F.struct((0 - F.col("score")).alias("s"), "source_id", "block_id")
    best = ranked.where("wanted").groupBy("qid").agg(F.min(place).alias("best"))
    best = written(best.withColumn("depth", F.floor(2 / (0 - F.col("best.s") - 1e-11)).cast("int") - RRF_K + 1), "best")
    deep = best.where(F.col("depth") > FIRST_DEPTH).join(wanted, "qid").select("qid", "depth", "wanted")
    if not deep.isEmpty():
        ranked = ranked.join(deep, "qid", "left_anti").unionByName(_fused(written(fusion.ranks(held, deep), "fused")))
    counts = ranked.join(best, "qid").groupBy("qid").agg((F.count_if(place < F.col("best")) + 1).alias("first_rank"))
    return expected.select("qid").distinct().join(counts, "qid", "left")


def _fused(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("score", F.round(1 / (F.lit(RRF_K) + F.col("lexical_rank")) + 1 / (F.lit(RRF_K) + F.col("dense_rank")), 12))


def evaluate(first: DataFrame) -> DataFrame:
    """One row: number of questions, hit rates at 1, 3 and 5, and mean reciprocal rank."""

    def hit(k: int) -> Column:
        return F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_at_{k}")

    return first.agg(F.count("*").alias("questions"), hit(1), hit(3), hit(5), F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias("mrr"))


def evidence(rows: DataFrame, evidence_id: str) -> DataFrame:
    """The one record with an id; no row where it is unknown."""
    return rows.where(F.col("evidence_id") == evidence_id)
