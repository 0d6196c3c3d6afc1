"""Invariants of documents, blocks, facts and evidence as tables of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions import text


def _listed(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(key, violation) of every check that is true."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in checks.items()]))
    return rows.select(key, F.explode(found).alias("violation"))


def block_violations(blocks: DataFrame) -> DataFrame:
    """Unknown types, blank texts without a warning, page and slide locators that are no numbers."""
    kind = F.col("location_type")
    return _listed(blocks, "block_id", {
        "unknown_block_type": ~F.col("block_type").isin(list(schemas.BLOCK_TYPES)),
        "blank_without_warning": text.is_blank(F.col("text")) & (F.coalesce(F.size("warnings"), F.lit(0)) == 0),
        "bad_locator": kind.isin("page", "slide") & ~F.col("location_value").rlike("^[1-9][0-9]*$"),
    })


def sequence_violations(blocks: DataFrame) -> DataFrame:
    """Documents whose block ids repeat or whose sequences are not exactly 1..N."""
    rows = blocks.groupBy("document_id").agg(F.count("*").alias("n"), F.count_distinct("block_id").alias("ids"), F.count_distinct("sequence").alias("places"), F.min("sequence").alias("low"), F.max("sequence").alias("high"))
    return _listed(rows, "document_id", {"repeated_block_id": F.col("ids") < F.col("n"), "broken_sequence": (F.col("places") < F.col("n")) | (F.col("low") != 1) | (F.col("high") != F.col("n"))})


def document_violations(documents: DataFrame) -> DataFrame:
    """Status against warnings, format, checksum."""
    warned = F.coalesce(F.size("warnings"), F.lit(0)) > 0
    return _listed(documents, "document_id", {
        "status_without_warnings": (F.col("parse_status") == "success_with_warnings") & ~warned,
        "warnings_without_status": (F.col("parse_status") == "success") & warned,
        "unknown_format": ~F.col("source_format").isin(list(schemas.SOURCE_FORMATS)),
        "bad_checksum": ~F.col("checksum_sha256").rlike("^[0-9A-F]{64}$"),
    })


def fact_violations(facts: DataFrame) -> DataFrame:
    """Confidence out of range, review not asked for, no evidence."""
    return _listed(facts, "candidate_id", {
        "bad_confidence": ~F.col("confidence").between(0.0, 1.0),
        "review_required": (F.col("confidence") == 0.5) & (F.col("review_status") != "required"),
        "no_evidence": F.coalesce(F.size("evidence_ids"), F.lit(0)) == 0,
    })


def dangling_evidence(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(candidate_id, evidence_id) of citations that no evidence of the same source has."""
    cited = facts.select("candidate_id", "source_id", F.explode("evidence_ids").alias("evidence_id"))
    return cited.join(evidence.select("evidence_id", "source_id"), ["evidence_id", "source_id"], "left_anti").select("candidate_id", "evidence_id")


def unresolved_evidence(evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """Evidence whose block is missing, has another locator, or does not contain the excerpt."""
    b = blocks.select("source_id", "block_id", F.col("location_type").alias("_lt"), F.col("location_value").alias("_lv"), F.col("text").alias("_text"))
    rows = evidence.join(b, ["source_id", "block_id"], "left")
    return _listed(rows, "evidence_id", {
        "missing_block": F.col("_text").isNull(),
        "other_locator": (F.col("_lt") != F.col("location_type")) | (F.col("_lv") != F.col("location_value")),
        "not_in_block": ~F.contains(F.col("_text"), F.col("text_excerpt")),
    })


def hash_violations(rows: DataFrame, key: str, stored: str, computed: Column) -> DataFrame:
    """Rows whose stored hash is not that of their content."""
    return rows.where(~F.col(stored).eqNullSafe(computed)).select(key, F.lit("hash_mismatch").alias("violation"))
