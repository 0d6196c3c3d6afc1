"""Invocations of a model in order: one stable code for each that its run, the cache or the provider refuses.

What a run may do is counted over its invocations in sequence. These counts are running sums over
ranges of the run (``ordinals``), so that a run of any length is spread over tasks; earlier attempts and cache
records are looked up by equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import keys, text
from factloom.operators import ordinals

# Fixed values, in the order in which they are looked for.
RUN_CODES = [
    "invalid_manifest", "manifest_hash_mismatch", "provider_configuration_mismatch", "model_configuration_mismatch", "prohibited_source", "duplicate_invocation", "retry_not_permitted", "attempt_budget_exceeded",
    "request_budget_exceeded", "cost_budget_exceeded",
]
CACHE_CODES = ["cache_path_escape", "cache_miss", "cache_conflict", "cache_record_invalid", "cache_hash_mismatch"]
PROVIDER_CODES = [
    "mock_response_not_found", "invalid_provider_request", "timeout", "rate_limit", "transport_error", "provider_api_failure", "execution_failed", "incomplete_response", "failed_response", "response_not_completed", "provider_refusal",
    "missing_provider_metadata", "missing_output_text",
]
#: What a provider's error is called, and what an invocation of that kind becomes.
ERRORS = {"bad_request": "invalid_provider_request", "timeout": "timeout", "rate_limit": "rate_limit", "connection": "transport_error", "api": "provider_api_failure", "other": "execution_failed"}
#: Errors after which another attempt is allowed.
RETRYABLE = ["timeout", "rate_limit", "connection"]


def _first(tests: list[tuple[str, Column]]) -> Column:
    out = None
    for code, test in tests:
        test = F.coalesce(test, F.lit(False))
        out = F.when(test, code) if out is None else out.when(test, code)
    return out


def cache_states(cache: DataFrame) -> DataFrame:
    """(request_sha256, responses, record, complete, intact): what the records of a request (request_sha256, response,
    response_sha256, recorded_at) are: how many different responses, and whether the one is whole."""
    whole = F.col("response").isNotNull() & F.col("response_sha256").isNotNull() & F.col("recorded_at").isNotNull()
    intact = F.col("response_sha256").eqNullSafe(keys.sha256_upper(F.col("response")))
    return cache.groupBy("request_sha256").agg(F.count_distinct(F.coalesce("response", F.lit(""))).alias("responses"), F.bool_and(whole).alias("complete"), F.bool_and(intact).alias("intact"))


def codes(invocations: DataFrame, manifests: DataFrame, cache: DataFrame) -> DataFrame:
    """(run_id, invocation_id, code) of each invocation, null for those that went well.

    ``invocations``: run_id, invocation_id, sequence, request_sha256, source_id, attempt, provider, model, cost, mode (live,
    mock or cache), cache_path, error, status, refused, input_tokens, output_tokens, output. ``manifests``: run_id,
    body, body_sha256, provider, model, sources array, most_requests, most_attempts, most_cost; one row a run.
    An invocation counts for its run's budgets whatever becomes of it; of equal (request, attempt) the first counts
    and the others are repetitions.
    """
    order = F.struct("sequence", "invocation_id")
    firsts = invocations.groupBy("run_id", "request_sha256").agg(F.min(order).alias("_first_of_request"))
    attempts = invocations.groupBy("run_id", "request_sha256", "attempt").agg(F.min(order).alias("_first_of_attempt"), F.min_by(F.coalesce("error", F.lit("none")), order).alias("_error"))
    before = attempts.select("run_id", "request_sha256", (F.col("attempt") + 1).alias("attempt"), F.col("_error").alias("_before"))
    rows = invocations.join(firsts, ["run_id", "request_sha256"]).join(attempts.drop("_error"), ["run_id", "request_sha256", "attempt"]).join(before, ["run_id", "request_sha256", "attempt"], "left")
    rows = rows.withColumns({"_again": order != F.col("_first_of_attempt"), "_new": (order == F.col("_first_of_request")).cast("int"), "_cost": F.coalesce(F.col("cost").cast("decimal(24,9)"), F.lit(0))}).drop("_first_of_request", "_first_of_attempt")
    rows = ordinals.running_sums(rows, ["run_id"], [F.col("sequence"), F.col("invocation_id")], "_place", {"_requests": "_new", "_spent": "_cost"})
    known = manifests.select("run_id", F.lit(True).alias("_there"), (F.col("body_sha256").eqNullSafe(keys.sha256_upper(F.col("body")))).alias("_sound"), F.col("provider").alias("_provider"), F.col("model").alias("_model"), "sources", "most_requests", "most_attempts", "most_cost")
    rows = rows.join(known, "run_id", "left").join(cache_states(cache), "request_sha256", "left")
    cached, mock = F.col("mode") == "cache", F.col("mode") == "mock"
    live = ~cached
    path = F.coalesce("cache_path", F.lit(""))
    tests = [
        F.col("_there").isNull() | F.col("most_requests").isNull() | F.col("most_attempts").isNull() | F.col("most_cost").isNull(), ~F.col("_sound"), ~F.col("provider").eqNullSafe(F.col("_provider")), ~F.col("model").eqNullSafe(F.col("_model")),
        ~F.coalesce(F.array_contains("sources", F.col("source_id")), F.lit(False)), F.col("_again"), (F.col("attempt") > 1) & ~F.coalesce(F.col("_before").isin(RETRYABLE), F.lit(False)), F.col("attempt") > F.col("most_attempts"),
        F.col("_requests") > F.col("most_requests"), F.col("_spent") > F.col("most_cost"),
    ]
    in_cache = [cached & (path.startswith("/") | path.rlike(r"(?:^|/)\.\.(?:/|$)")), cached & F.col("responses").isNull(), cached & (F.col("responses") > 1), cached & ~F.col("complete"), cached & ~F.col("intact")]
    error, status = F.col("error"), F.col("status")
    of_provider = [mock & F.col("output").isNull() & error.isNull(), *[live & (error == name) for name in ERRORS], live & (status == "incomplete"), live & (status == "failed"), live & ~status.eqNullSafe(F.lit("completed")), live & F.col("refused"), live & (F.col("input_tokens").isNull() | F.col("output_tokens").isNull()), live & (F.col("output").isNull() | text.is_blank(F.col("output")))]
    code = _first([*zip(RUN_CODES, tests, strict=True), *zip(CACHE_CODES, in_cache, strict=True), *zip(PROVIDER_CODES, of_provider, strict=True)])
    return rows.select("run_id", "invocation_id", code.alias("code"))
