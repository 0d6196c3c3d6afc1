"""Fact search, grounded answers and agent traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import numbers, text


def search_facts(facts: DataFrame, fact_type: str | None = None, query: str | None = None) -> DataFrame:
    """Facts of a type whose subject, statement and value contain the query, case apart; a
    blank query and no type let every fact through."""
    if fact_type is not None:
        facts = facts.where(F.col("fact_type") == fact_type)
    wanted = (query or "").casefold().strip()
    return facts.where(F.contains(F.lower(F.concat_ws(" ", "subject", "statement", "value")), F.lit(wanted))) if wanted else facts


def hydrate(facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Facts with their evidence records in the order of their ids; unknown ids stand in ``unknown``."""
    cited = facts.select("fact_id", F.posexplode("evidence_ids").alias("pos", "evidence_id"))
    joined = cited.join(catalog, "evidence_id", "left")
    known = F.col("text").isNotNull()
    record = F.struct("pos", "evidence_id", "source_id", "block_id", "text")
    rows = joined.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.when(known, record))).alias("evidence"), F.array_sort(F.collect_list(F.when(~known, F.col("evidence_id")))).alias("unknown"))
    return facts.join(rows, "fact_id", "left")


def check_citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """For each answer (answer_id, qid, answer, cited array): ids cited in its text, those that
    were not retrieved for its question, and whether all is in order."""
    shown = hits.groupBy("qid").agg(F.collect_set("evidence_id").alias("_hits"))
    rows = answers.join(shown, "qid", "left").withColumn("in_text", F.array_sort(F.array_distinct(text.citations(F.col("answer")))))
    rows = rows.withColumn("unknown", F.array_sort(F.array_except("in_text", F.coalesce("_hits", F.array().cast("array<string>")))))
    same = F.col("in_text") == F.array_sort(F.array_distinct("cited"))
    return rows.withColumn("valid", (F.size("unknown") == 0) & same & (F.size("in_text") > 0)).drop("_hits")


def task_success(expected_status: Column, status: Column, expected: Column, cited: Column) -> Column:
    """The status is the expected one and, for an answer, some expected evidence is cited."""
    return status.eqNullSafe(expected_status) & ((status != "answered") | F.arrays_overlap(expected, cited))


def tool_sequence_ok(acceptable: Column, actual: Column) -> Column:
    return F.exists(acceptable, lambda a: a == actual)


def unnecessary_calls(acceptable: Column, actual: Column) -> Column:
    """Calls beyond the best common subsequence with an acceptable sequence."""
    return F.size(actual) - F.coalesce(F.array_max(F.transform(acceptable, lambda a: numbers.common_subsequence(a, actual))), F.lit(0))


def budget_gate(attempts: DataFrame, most_calls: int, most_cost: str) -> DataFrame:
    """Attempts in order, with the running calls and cost of their run and whether the next was allowed."""
    order = Window.partitionBy("run_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0)
    rows = attempts.withColumns({"calls": F.count("*").over(order), "spent": F.sum("cost").over(order)})
    return rows.withColumn("allowed", (F.col("calls") <= most_calls) & (F.col("spent") <= F.lit(most_cost).cast("decimal(38,9)")))
