"""The predicate registry as a small table, and its use contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text

_SUBJECT = {"I": "initiative", "P": "programme", "L": "policy", "O": "organisation", "C": "recommendation", "R": "risk", "D": "decision", "M": "metric", "X": "other"}
# Predicate, subject kinds, value types, required and optional qualifiers, aliases.
PREDICATES = [
    ("primary_name", "IPLOCRDMX", "string", "", "", ""),
    ("alias", "IPLOX", "string", "", "", "project_alias"),
    ("status", "IPLOX", "status string", "", "", "programme_status project_status"),
    ("owner", "IPLCRDX", "person organisation string", "", "", "programme_owner project_owner"),
    ("approved_budget", "IPLO", "money", "", "", ""),
    ("budget", "IPLO", "money", "", "budget_status", ""),
    ("procurement_ceiling", "IPOD", "money", "", "", ""),
    ("target_date", "IPLCDX", "date", "", "date_type", "target_launch_date target_migration_date"),
    ("reporting_date", "IPLOMX", "date string", "", "", ""),
    ("review_date", "IPLDX", "date", "", "", "go_no_go_review_date"),
    ("date_resolution_status", "IPDX", "status string", "", "", "final_launch_date_status"),
    ("risk", "IPLORX", "string list", "", "risk_id owner rating", ""),
    ("risk_status", "IPLRX", "status string", "", "risk_id", "vendor_assurance_risk"),
    ("decision", "IPLODX", "string boolean", "", "", ""),
    ("recommendation", "LOCX", "string", "", "recommendation_id", ""),
    ("commitment", "IPLOX", "string", "", "", ""),
    ("requirement", "IPLOCX", "string boolean", "", "", ""),
    ("finding", "LOMX", "string number percentage", "", "", ""),
    ("metric", "IPLOMX", "number percentage money", "metric_name", "unit population period", ""),
    ("action_status", "IPLOCX", "status string", "", "action_id", ""),
]


def predicates(spark: SparkSession) -> DataFrame:
    """One row a predicate: allowed subject and value types, required and optional qualifiers."""
    rows = [(name, [_SUBJECT[c] for c in subjects], values.split(), required.split(), optional.split(), aliases.split()) for name, subjects, values, required, optional, aliases in PREDICATES]
    return spark.createDataFrame(rows, "predicate string, subject_types array<string>, value_types array<string>, required array<string>, optional array<string>, aliases array<string>")


def canonical(df: DataFrame, column: str = "predicate") -> DataFrame:
    """Replaces aliases and spellings of a predicate by its canonical name; unknown ones stay."""
    aliases = predicates(df.sparkSession).select(F.explode("aliases").alias("_alias"), F.col("predicate").alias("_name"))
    plain = df.withColumn("_plain", text.predicate_name(F.col(column)))
    joined = plain.join(F.broadcast(aliases), F.col("_plain") == F.col("_alias"), "left")
    return joined.withColumn(column, F.coalesce("_name", "_plain")).drop("_plain", "_alias", "_name")


def contract_violations(facts: DataFrame) -> DataFrame:
    """(candidate_id, violation): each way in which a fact breaks its predicate's contract."""
    rows = facts.join(F.broadcast(predicates(facts.sparkSession)), "predicate", "left")
    names = F.map_keys(F.col("qualifiers"))
    filled = F.map_keys(F.map_filter("qualifiers", lambda k, v: ~text.is_blank(v)))
    found = F.concat(
        F.when(F.col("subject_types").isNull(), F.array(F.lit("unknown_predicate"))).otherwise(F.array().cast("array<string>")),
        F.when(~F.array_contains("subject_types", F.col("subject_type")), F.array(F.lit("subject_type"))).otherwise(F.array().cast("array<string>")),
        F.when(~F.array_contains("value_types", F.col("value_type")), F.array(F.lit("value_type"))).otherwise(F.array().cast("array<string>")),
        F.transform(F.coalesce(F.array_sort(F.array_except("required", filled)), F.array().cast("array<string>")), lambda q: F.concat(F.lit("missing_qualifier:"), q)),
        F.transform(F.coalesce(F.array_sort(F.array_except(names, F.concat("required", "optional"))), F.array().cast("array<string>")), lambda q: F.concat(F.lit("unknown_qualifier:"), q)),
    )
    return rows.select("candidate_id", F.explode(found).alias("violation"))
