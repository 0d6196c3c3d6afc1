"""Gates of a run that is to be frozen as a baseline: all of them are judged, and all that fail are named.

What the gates look at is measured from the run's own tables: two passes over its sources, the
owner's assessments, automated diagnostics, and single checks that passed or did not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The gates in order. Those of CHECKS are single checks of the same name, which must be there and
# have passed; those of ABSENT must be there and must not have.
GATES = [
    "required_commit_ancestry_valid", "repository_clean_before_finalization", "exact_development_source_inventory", "exact_development_challenge_inventory", "protected_v0_4_hashes_valid", "owner_preparation_hashes_valid",
    "completed_owner_assessment_hash_valid", "owner_validation_report_hash_valid", "independent_review_record_valid", "parsed_document_hashes_valid", "all_sources_complete_both_passes", "zero_unhandled_extraction_exceptions",
    "candidate_schema_valid", "repeat_outputs_byte_identical", "candidate_output_hashes_match_preparation", "candidate_counts_reconciled", "strict_matches_reconciled", "exact_metrics_reconciled", "owner_assessments_complete",
    "owner_and_machine_provenance_separate", "automated_challenge_diagnostics_reconciled", "no_post_v0_4_semantic_change", "source_independent_rules", "sparse_gold_limitation_preserved", "held_out_semantics_not_loaded",
    "held_out_execution_not_authorized", "output_transaction_complete", "artifact_identities_agree",
]
ABSENT = {"source_independent_rules": "source_specific_rule_detected", "held_out_semantics_not_loaded": "held_out_semantic_content_loaded", "held_out_execution_not_authorized": "held_out_execution_authorized"}
MEASURED = ["all_sources_complete_both_passes", "zero_unhandled_extraction_exceptions", "candidate_schema_valid", "repeat_outputs_byte_identical", "owner_assessments_complete", "automated_challenge_diagnostics_reconciled"]
CHECKS = [g for g in GATES if g not in MEASURED and g not in ABSENT]
#: So many runs to a partition at most about, however many there are.
RUNS = 16384


def _by_run(runs: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The tables dealt by run, alike, so that every grouping and join by run stays in its partition and a task holds few runs. None is
    broadcast: Spark takes what is made of runs for as small as the files they come from."""
    parts = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RUNS))
    return [t.repartition(parts, "run_id") for t in (runs, *tables)]


def evidence(runs: DataFrame, passes: DataFrame, assessments: DataFrame, diagnostics: DataFrame, checks: DataFrame) -> DataFrame:
    """One row a run (run_id): counts of its passes (run_id, source_id, pass: 1 or 2, succeeded, schema_valid, exception, output_sha256),
    assessments (run_id, case_id, status: pass, fail or pending) and diagnostics (run_id, case_id, passed), and its single checks
    (run_id, name, passed) as a map; of a check that is there twice all must have passed."""
    count = lambda c, name: F.count_if(c).alias(name)
    ok = lambda c, n: F.col(c) & (F.col("pass") == n)
    runs, passes, assessments, diagnostics, checks = _by_run(runs, passes, assessments, diagnostics, checks)
    per_source = passes.groupBy("run_id", "source_id").agg(
        F.bool_or(ok("succeeded", 1)).alias("first"), F.bool_or(ok("succeeded", 2)).alias("second"), F.bool_or(ok("schema_valid", 1)).alias("valid_first"), F.bool_or(ok("schema_valid", 2)).alias("valid_second"), count(F.col("exception").isNotNull(), "thrown"),
        # both passes and one digest; by extremes, for distinct counts would deal the rows out anew
        ((F.min("pass") < F.max("pass")) & (F.count("output_sha256") == F.count("*")) & (F.min("output_sha256") == F.max("output_sha256"))).alias("identical"),
    )
    of_passes = per_source.groupBy("run_id").agg(count(F.col("first"), "primary"), count(F.col("second"), "repeat"), count(F.col("valid_first"), "valid_primary"), count(F.col("valid_second"), "valid_repeat"), F.sum("thrown").alias("exceptions"), count(F.col("identical"), "identical"))
    of_owner = assessments.groupBy("run_id").agg(*[count(F.col("status") == s, f"owner_{s}") for s in ("pass", "fail", "pending")])
    of_cases = diagnostics.groupBy("run_id").agg(count(F.col("passed"), "diagnosed"))
    one = checks.groupBy("run_id", "name").agg(F.bool_and(F.coalesce("passed", F.lit(False))).alias("passed")).groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "passed"))).alias("checks"))
    rows = runs.select("run_id").distinct()
    for part in (of_passes, of_owner, of_cases, one):
        rows = rows.join(part.hint("merge"), "run_id", "left")
    return rows


def _held(sources: int, cases: int) -> dict[str, Column]:
    check = lambda name: F.try_element_at("checks", F.lit(name))
    measured = dict(
        zip(
            MEASURED,
            [
                (F.col("primary") == sources) & (F.col("repeat") == sources), F.col("exceptions") == 0, (F.col("valid_primary") == sources) & (F.col("valid_repeat") == sources), F.col("identical") == sources,
                (F.col("owner_pass") == cases) & (F.col("owner_fail") == 0) & (F.col("owner_pending") == 0), F.col("diagnosed") == cases,
            ],
            strict=True,
        )
    )
    return {g: measured[g] if g in measured else ~check(ABSENT[g]) if g in ABSENT else check(g) for g in GATES}


def judge(found: DataFrame, sources: int = 5, cases: int = 3) -> DataFrame:
    """(run_id, passed, failed): whether a run may be frozen, and the gates that fail, in order. What was not
    measured fails."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(held, F.lit(False)), gate) for gate, held in _held(sources, cases).items()]))
    return found.select("run_id", (F.size(failed) == 0).alias("passed"), failed.alias("failed"))
