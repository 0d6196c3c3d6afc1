"""Manifests: which sources are active, what is wrong with them, and how a batch went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions import keys, text


def unsafe_path(path: Column) -> Column:
    """Absolute paths, drive letters and paths with a ``..`` part."""
    return path.rlike(r"^([\\/]|[A-Za-z]:)") | path.rlike(r"(^|[\\/])\.\.([\\/]|$)") | (F.length(F.trim(path)) == 0) | path.isNull()


def active_sources(split: DataFrame, register: DataFrame, chosen: str | None = None) -> DataFrame:
    """Sources of a split with their register rows and ``problems``: not registered, not
    approved, another format, a bad checksum, an unsafe path."""
    if chosen is not None and chosen not in schemas.SPLITS:
        raise ValueError(f"unknown split: {chosen}")
    wanted = split if chosen is None else split.where(F.col("split") == chosen)
    r = register.select("source_id", F.col("source_format").alias("_format"), "local_filename", F.upper("sha256").alias("sha256"), "corpus_status", F.lit(True).alias("_known"))
    rows = wanted.join(r, "source_id", "left")
    known = F.col("_known").isNotNull()
    problems = F.array_compact(F.array(
        F.when(~known, "not_registered"),
        F.when(known & ~F.col("corpus_status").eqNullSafe("approved"), "not_approved"),
        F.when(known & ~F.col("_format").eqNullSafe(F.col("source_format")), "format_mismatch"),
        F.when(known & ~F.coalesce(F.col("sha256").rlike("^[0-9A-F]{64}$"), F.lit(False)), "bad_checksum"),
        F.when(known & unsafe_path(F.col("local_filename")), "unsafe_path"),
    ))
    return rows.withColumn("problems", problems).drop("_known", "_format")


def with_checksums(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Joins observed files (filename, content) and says whether their checksum is the expected one."""
    seen = files.select(F.col("filename").alias("local_filename"), keys.sha256_upper(F.col("content")).alias("observed_sha256"))
    return sources.join(seen, "local_filename", "left").withColumn("checksum_match", F.coalesce(F.col("sha256") == F.col("observed_sha256"), F.lit(False)))


def document_identity(files: DataFrame) -> DataFrame:
    """document_id and checksum of rows (source_id, content)."""
    rows = files.withColumn("checksum_sha256", keys.sha256_upper(F.col("content")))
    return rows.withColumn("document_id", keys.document_id(F.col("source_id"), F.col("checksum_sha256")))


def failure_message(error_class: Column, message: Column) -> Column:
    return F.concat_ws(": ", text.error_code(error_class), text.safe_message(message))
