"""Gold annotations: what contradicts the split, the registry or the blocks, and the dataset's report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import numbers, text
from factloom.operators import containment, registry, reports

# What can be wrong with a gold fact or case, in this order.
PROBLEMS = [
    "source is absent from the split", "split does not match", "document_family does not match", "source is not a PDF", "subject_type is not allowed for predicate", "value_type is not allowed for predicate",
    "normalized_value does not match value_type", "evidence block does not exist", "evidence block is not page text", "evidence block is not page-located", "evidence page does not match block page",
    "evidence excerpt does not occur in block text",
]
LONG_VALUE = 40


def value_fits() -> Column:
    """Whether the typed value columns (value_text, value_number, value_currency, value_list) have what the type asks for."""
    kind = F.col("value_type")
    return (
        F.when(kind == "money", F.col("value_number").isNotNull() & F.col("value_currency").isNotNull())
        .when(kind.isin("number", "percentage"), F.col("value_number").isNotNull())
        .when(kind == "boolean", F.lower("value_text").isin("true", "false"))
        .when(kind == "list", F.col("value_list").isNotNull() & ~F.exists("value_list", lambda v: v.isNull()))
        .when(kind == "date", F.coalesce(numbers.iso_date(F.col("value_text")), F.lit(False)))
        .otherwise(~text.is_blank(F.col("value_text")))
    )


def fact_problems(gold: DataFrame, split: DataFrame, blocks: DataFrame) -> DataFrame:
    """(annotation_id, ordinal, problem): everything that is wrong with each gold fact, all of it.

    Gold is joined with the split by source and with its one evidence block by (source, block);
    the registry is small and constant.
    """
    s = split.select("source_id", F.col("split").alias("_split"), F.col("document_family").alias("_family"), F.col("source_format").alias("_format"), F.lit(True).alias("_listed"))
    r = registry.predicates(gold.sparkSession).select("predicate", "subject_types", "value_types")
    b = blocks.select("source_id", F.col("block_id").alias("evidence_block_id"), F.col("block_type").alias("_type"), F.col("location_type").alias("_place"), F.col("location_value").alias("_page"), F.col("text").alias("_text"))
    rows = gold.join(s, "source_id", "left").join(F.broadcast(r), "predicate", "left").join(b, ["source_id", "evidence_block_id"], "left")
    listed, there = F.col("_listed").isNotNull(), F.col("_type").isNotNull()
    tests = [
        ~listed, listed & (F.col("split") != F.col("_split")), listed & (F.col("document_family") != F.col("_family")), listed & (F.col("_format") != "PDF"),
        ~F.coalesce(F.array_contains("subject_types", F.col("subject_type")), F.lit(False)), ~F.coalesce(F.array_contains("value_types", F.col("value_type")), F.lit(False)), ~value_fits(),
        ~there, there & (F.col("_type") != "page_text"), there & (F.col("_place") != "page"), there & (F.col("_page") != F.col("evidence_location_value")), there & ~F.contains("_text", F.col("evidence_excerpt")),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(i).alias("ordinal"), F.lit(p).alias("problem"))) for i, (t, p) in enumerate(zip(tests, PROBLEMS, strict=True), 1)]))
    return rows.select("annotation_id", F.inline(found))


def case_problems(cases: DataFrame, split: DataFrame, blocks: DataFrame) -> DataFrame:
    """(case_id, problem, block_id) of challenge cases; their block ids and pages stand side by side in two arrays."""
    s = split.select("source_id", F.col("split").alias("_split"), F.col("source_format").alias("_format"), F.lit(True).alias("_listed"))
    rows = cases.join(s, "source_id", "left")
    listed = F.col("_listed").isNotNull()
    own = F.array_compact(F.array(F.when(~listed, PROBLEMS[0]), F.when(listed & (F.col("split") != F.col("_split")), PROBLEMS[1]), F.when(listed & (F.col("_format") != "PDF"), PROBLEMS[3])))
    own = rows.select("case_id", F.explode(own).alias("problem"), F.lit(None).cast("string").alias("block_id"))
    cited = cases.select("case_id", "source_id", F.explode(F.arrays_zip(F.col("evidence_block_ids").alias("block_id"), F.col("evidence_location_values").alias("page"))).alias("_e")).select("case_id", "source_id", "_e.block_id", "_e.page")
    b = blocks.select("source_id", "block_id", ((F.col("block_type") == "page_text") & (F.col("location_type") == "page")).alias("_page_text"), F.col("location_value").alias("_page"))
    joined = cited.join(b, ["source_id", "block_id"], "left")
    wrong = F.when(F.col("_page_text").isNull(), PROBLEMS[7]).when(~F.col("_page_text") | (F.col("_page") != F.col("page")), "evidence block or page mismatch")
    return own.unionByName(joined.select("case_id", wrong.alias("problem"), "block_id").where("problem IS NOT NULL"))


def leaks(gold: DataFrame, documents: DataFrame) -> DataFrame:
    """(annotation_id, document, what): held-out ids, and held-out values of 40 characters or
    more, that stand in public documents (document, text). Both are looked up by their rarest inner words."""
    held = gold.where("split = 'held_out'")
    ids = held.select("annotation_id", F.lit("annotation_id").alias("what"), F.col("annotation_id").alias("passage"))
    values = held.where(F.length("raw_value") >= LONG_VALUE).select("annotation_id", F.lit("raw_value").alias("what"), F.col("raw_value").alias("passage"))
    passages = ids.unionByName(values).select(F.struct("annotation_id", "what").alias("passage_id"), "passage")
    found = containment.containing(documents.select(F.col("document").alias("text_id"), "text"), passages)
    return found.select("passage_id.annotation_id", F.col("text_id").alias("document"), "passage_id.what")


def counted(rows: DataFrame, column: str) -> DataFrame:
    """One row: counts by a column as a map in the order of its names."""
    sums = rows.groupBy(column).agg(F.count("*").alias("_n"))
    return sums.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(column), "_n")))).alias(column))


def dataset_report(gold: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: facts and cases, by split and review status, and how many ids repeat."""
    state = lambda s, name: F.count_if(F.col("review_status") == s).alias(name)
    states = ("draft_ai_assisted", "owner_verified", "rejected")
    facts = gold.agg(F.count("*").alias("fact_count"), F.count_if(F.col("split") == "development").alias("development_fact_count"), F.count_if(F.col("split") == "held_out").alias("held_out_fact_count"), *[state(s, f"{s}_count") for s in states])
    own = cases.agg(F.count("*").alias("challenge_case_count"), *[state(s, f"{s}_case_count") for s in states])
    ids = gold.select(F.col("annotation_id").alias("id")).unionByName(cases.select(F.col("case_id").alias("id")))
    return facts.crossJoin(own).crossJoin(reports.duplicated(ids, "id").agg(F.count("*").alias("duplicate_ids")))  # one row each


def distribution_problems(rows: DataFrame, column: str, expected: dict[str, int]) -> DataFrame:
    """(value, expected, found) of every value whose count is not the expected one; values that are not expected count 0 there."""
    wanted = rows.sparkSession.createDataFrame(list(expected.items()), f"{column} string, expected long")
    found = rows.groupBy(column).agg(F.count("*").alias("found"))
    both = found.join(F.broadcast(wanted), column, "full").select(column, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
    return both.where("expected <> found")


def inventory(records: DataFrame) -> DataFrame:
    """Counts of records (kind, source_id, split) by kind, split and source."""
    return records.groupBy("kind", "split", "source_id").agg(F.count("*").alias("n"))


def inventory_differences(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of the inventory that the manifest (kind, split, source_id, n) does not have, and the reverse, by side."""
    found, wanted = inventory(records), manifest.select("kind", "split", "source_id", F.col("n").cast("long").alias("n"))
    return found.exceptAll(wanted).withColumn("side", F.lit("found")).unionByName(wanted.exceptAll(found).withColumn("side", F.lit("manifest")))
