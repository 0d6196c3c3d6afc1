import re

from factloom.operators import freeze
from pyspark.sql import functions as F


def test_a_gate_fails_for_what_was_not_measured(spark):
    runs = spark.createDataFrame([("good",), ("bare",), ("twice",)], "run_id string")
    passes = spark.createDataFrame([(r, s, p, True, True, None, "h") for r in ("good", "twice") for s in "abcde" for p in (1, 2)], "run_id string, source_id string, pass int, succeeded boolean, schema_valid boolean, exception string, output_sha256 string")
    cases = [(r, c) for r in ("good", "twice") for c in "xyz"]
    assessments = spark.createDataFrame([(*c, "pass") for c in cases], "run_id string, case_id string, status string")
    diagnostics = spark.createDataFrame([(*c, True) for c in cases], "run_id string, case_id string, passed boolean")
    checks = [(r, n, True) for r in ("good", "twice") for n in freeze.CHECKS] + [(r, n, False) for r in ("good", "twice") for n in freeze.ABSENT.values()] + [("twice", freeze.CHECKS[3], False)]
    found = freeze.judge(freeze.evidence(runs, passes, assessments, diagnostics, spark.createDataFrame(checks, "run_id string, name string, passed boolean")))
    assert {r.run_id: (r.passed, r.failed) for r in found.collect()} == {"good": (True, []), "bare": (False, freeze.GATES), "twice": (False, [freeze.CHECKS[3]])}
    assert len(freeze.GATES) == len(set(freeze.GATES)) == 28 and len(freeze.CHECKS) == 19


def test_runs_are_dealt_to_more_tasks_the_more_there_are(spark, monkeypatch):
    monkeypatch.setattr(freeze, "RUNS", 10)
    runs = spark.range(200).select(F.col("id").alias("run_id"))
    passes = runs.select("run_id", F.lit("a").alias("source_id"), F.lit(1).alias("pass"), F.lit(True).alias("succeeded"), F.lit(True).alias("schema_valid"), F.lit(None).cast("string").alias("exception"), F.lit("h").alias("output_sha256"))
    cases = runs.select("run_id", F.lit("x").alias("case_id"), F.lit("pass").alias("status"), F.lit(True).alias("passed"))
    found = freeze.evidence(runs, passes, cases, cases, runs.select("run_id", F.lit(freeze.CHECKS[0]).alias("name"), F.lit(True).alias("passed")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\(\w+#\d+L?, (\d+)\)", plan)) == {"20"} and "Broadcast" not in plan
    assert found.where("identical = 0 AND primary = 1 AND owner_pass = 1").count() == 200
