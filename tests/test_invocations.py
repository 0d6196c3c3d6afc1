import hashlib
from datetime import datetime

from factloom.operators import invocations

BASE = {"run_id": "r", "sequence": 0, "source_id": "S1", "attempt": 1, "provider": "p", "model": "m", "cost": "0.1", "mode": "live", "cache_path": "a/b", "error": None, "status": "completed", "refused": False, "input_tokens": 1, "output_tokens": 1, "output": "{}"}
ROWS = "run_id string, invocation_id string, sequence int, request_sha256 string, source_id string, attempt int, provider string, model string, cost string, mode string, cache_path string, error string, status string, refused boolean, input_tokens long, output_tokens long, output string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest().upper()


def test_every_code_has_its_row(spark):
    faults = {
        "invalid_manifest": {"run_id": "none"}, "manifest_hash_mismatch": {"run_id": "broken"}, "provider_configuration_mismatch": {"provider": "q"}, "model_configuration_mismatch": {"model": None}, "prohibited_source": {"source_id": "S9"},
        "retry_not_permitted": {"attempt": 2}, "cache_path_escape": {"mode": "cache", "cache_path": "../x"}, "cache_miss": {"mode": "cache"}, "cache_conflict": {"mode": "cache"}, "cache_record_invalid": {"mode": "cache"}, "cache_hash_mismatch": {"mode": "cache"},
        "mock_response_not_found": {"mode": "mock", "output": None}, **{code: {"error": name} for name, code in invocations.ERRORS.items()}, "incomplete_response": {"status": "incomplete"}, "failed_response": {"status": "failed"}, "response_not_completed": {"status": None},
        "provider_refusal": {"refused": True}, "missing_provider_metadata": {"input_tokens": None}, "missing_output_text": {"output": " "},
    }
    rows = [{**BASE, "invocation_id": code, "request_sha256": code, "sequence": 10 + i, **fault} for i, (code, fault) in enumerate(faults.items())]
    rows += [{**BASE, "invocation_id": f"ok{i}", "request_sha256": f"ok{i}", "sequence": i, "mode": mode} for i, mode in enumerate(["live", "mock", "cache"])]
    rows += [{**BASE, "invocation_id": "duplicate_invocation", "request_sha256": "ok0", "sequence": 5}, {**BASE, "invocation_id": "ok after timeout", "request_sha256": "timeout", "sequence": 90, "attempt": 2, "error": None}]
    rows += [{**BASE, "run_id": "tries", "invocation_id": f"try{i}", "request_sha256": "x", "sequence": i, "attempt": i, "error": "timeout"} for i in (1, 2)] + [{**BASE, "run_id": "tries", "invocation_id": "attempt_budget_exceeded", "request_sha256": "x", "sequence": 3, "attempt": 3}]
    rows += [{**BASE, "run_id": "few", "invocation_id": f"few{i}", "request_sha256": f"f{i}", "sequence": i} for i in (1, 2)] + [{**BASE, "run_id": "few", "invocation_id": "request_budget_exceeded", "request_sha256": "f3", "sequence": 3}]
    rows += [{**BASE, "run_id": "dear", "invocation_id": "dear1", "request_sha256": "d1", "sequence": 1, "cost": "1.5"}, {**BASE, "run_id": "dear", "invocation_id": "cost_budget_exceeded", "request_sha256": "d2", "sequence": 2, "cost": "0.500000001"}]
    names = [f.split()[0] for f in ROWS.split(", ")]
    table = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ROWS)
    manifest = lambda run, requests=99, attempts=2, cost=2: (run, "body", "0" if run == "broken" else sha("body"), "p", "m", ["S1"], requests, attempts, cost)
    manifests = spark.createDataFrame([manifest("r", cost=99), manifest("broken"), manifest("tries"), manifest("few", requests=2), manifest("dear")], "run_id string, body string, body_sha256 string, provider string, model string, sources array<string>, most_requests int, most_attempts int, most_cost int")
    at = datetime(2026, 1, 1)
    cache = [("ok2", "y", sha("y"), at), ("ok2", "y", sha("y"), at), ("cache_conflict", "y", sha("y"), at), ("cache_conflict", "z", sha("z"), at), ("cache_record_invalid", "y", sha("y"), None), ("cache_hash_mismatch", "y", sha("z"), at)]
    found = {r.invocation_id: r.code for r in invocations.codes(table, manifests, spark.createDataFrame(cache, "request_sha256 string, response string, response_sha256 string, recorded_at timestamp")).collect()}
    every = invocations.RUN_CODES + invocations.CACHE_CODES + invocations.PROVIDER_CODES
    assert {i: c for i, c in found.items() if i in every} == {c: c for c in every}
    assert {c for i, c in found.items() if i not in every} == {None, "timeout"} and found["ok2"] is None and found["ok after timeout"] is None
