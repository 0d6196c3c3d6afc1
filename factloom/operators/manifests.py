"""Requests to models: output schemas, prompt and request identities, routes, measures, budgets, the run loop.

An identity is the digest of canonical JSON: names sorted, nulls kept, LF line ends in prompts.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import keys, numbers, text
from factloom.operators import comparison, model_calls, registry

# Fixed values.
EVIDENCE_ID = "llm-evidence-v0.4-%s-%s"
RETRYABLE = ["timeout", "rate_limit", "transport_error"]


# ------------------------------------------------------------------ output schemas


def _closed(properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


def fact_variant(row) -> dict:
    """The closed schema of one predicate's facts: its name is constant, kinds and value types are
    enumerations, required qualifiers are texts and optional ones texts or null."""
    text_, words = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
    qualifiers = {n: text_ for n in row["required"]} | {n: {"anyOf": [text_, {"type": "null"}]} for n in row["optional"]}
    return _closed({
        "candidate_id": text_, "subject_text": text_, "subject_type": {"type": "string", "enum": list(row["subject_types"])}, "predicate": {"type": "string", "const": row["predicate"]}, "raw_value": text_,
        "value_type": {"type": "string", "enum": list(row["value_types"])}, "normalized_value": text_, "qualifiers": _closed(qualifiers), "evidence_ids": words, "confidence": {"type": "number"},
    })


#: The properties of a fact, all of which a reply must have.
FACT_FIELDS = ["candidate_id", "subject_text", "subject_type", "predicate", "raw_value", "value_type", "normalized_value", "qualifiers", "evidence_ids", "confidence"]


def output_schema(spark: SparkSession) -> dict:
    """The closed schema of a reply, with one variant of a fact for each predicate of the registry."""
    variants = [fact_variant(r) for r in registry.predicates(spark).orderBy("predicate").collect()]  # the registry is constant
    words = {"type": "array", "items": {"type": "string"}}
    return _closed({"schema_version": {"type": "string"}, "batch_id": {"type": "string"}, "candidate_facts": {"type": "array", "items": {"anyOf": variants}}, "warnings": words})


def schema_problems(schema: dict) -> list[str]:
    """Places at which a schema is not strict: open objects, properties not required, defaults."""
    found, todo = [], [("#", schema)]
    if schema.get("type") != "object":
        found.append("#: no object")
    while todo:
        place, node = todo.pop()
        if isinstance(node, list):
            todo += [(f"{place}/{i}", x) for i, x in enumerate(node)]
        if not isinstance(node, dict):
            continue
        if "default" in node:
            found.append(f"{place}: default")
        if node.get("type") == "object":
            names = node.get("properties")
            if not isinstance(names, dict) or node.get("required") != list(names):
                found.append(f"{place}: required")
            if node.get("additionalProperties") is not False:
                found.append(f"{place}: open")
        todo += [(f"{place}/{k}", x) for k, x in node.items()]
    return sorted(found)


def schema_fields(spark: SparkSession) -> DataFrame:
    """(predicate, field, allowed): the enumerations and qualifiers of each variant, as a table."""
    rows = []
    for variant in output_schema(spark)["properties"]["candidate_facts"]["items"]["anyOf"]:
        own = variant["properties"]
        name = own["predicate"]["const"]
        rows += [(name, f, ",".join(own[f]["enum"])) for f in ("subject_type", "value_type")]
        rows += [(name, f"qualifier:{q}", "optional" if "anyOf" in kind else "required") for q, kind in own["qualifiers"]["properties"].items()]
    return spark.createDataFrame(rows, "predicate string, field string, allowed string")


def reply_problems(replies: DataFrame) -> DataFrame:
    """(id, problem) of replies (id, reply: the JSON text of one fact) that the closed schema of their predicate
    does not allow: what is missing, what is unknown, what is not among the values allowed, and what has another
    type. A reply that is no object, or whose predicate is unknown, has that one problem."""
    known = registry.predicates(replies.sparkSession).select("predicate", "subject_types", "value_types", "required", "optional")
    read = lambda c: F.from_json(c, "map<string,string>")
    rows = replies.select("id", F.try_parse_json("reply").alias("_v"), read(F.when(F.col("reply").rlike(r"\A\s*\{"), F.col("reply"))).alias("_own"))
    rows = rows.withColumn("_own", F.when(F.col("_v").isNotNull(), F.col("_own")))
    rows = rows.withColumns({"predicate": F.try_element_at("_own", F.lit("predicate")), "_q": read(F.try_element_at("_own", F.lit("qualifiers")))})
    rows = rows.join(F.broadcast(known), "predicate", "left")  # the registry is constant
    fields = F.array(*map(F.lit, FACT_FIELDS))
    none = F.array().cast("array<string>")
    given, allowed = F.map_keys("_own"), F.concat("required", "optional")
    held = F.coalesce(F.map_keys("_q"), none)
    list_of = lambda names, kind: F.transform(F.array_sort(names), lambda n: F.concat(F.lit(kind), n))
    one = lambda test, name: F.when(F.coalesce(test, F.lit(False)), F.array(F.lit(name))).otherwise(none)
    at = lambda name: F.try_element_at("_own", F.lit(name))
    empty = F.filter("required", lambda q: F.map_contains_key("_q", q) & F.try_element_at("_q", q).isNull())
    number = F.try_variant_get("_v", "$.confidence", "double")
    found = F.concat(
        list_of(F.array_except(fields, given), "missing:"), list_of(F.array_except(given, fields), "unknown:"),
        one(F.array_contains(given, F.lit("subject_type")) & ~F.coalesce(F.array_contains("subject_types", at("subject_type")), F.lit(False)), "enum:subject_type"),
        one(F.array_contains(given, F.lit("value_type")) & ~F.coalesce(F.array_contains("value_types", at("value_type")), F.lit(False)), "enum:value_type"),
        one(F.array_contains(given, F.lit("confidence")) & (number.isNull() | F.schema_of_variant(F.variant_get("_v", "$.confidence", "variant")).eqNullSafe("STRING")), "type:confidence"),
        F.when(F.array_contains(given, F.lit("qualifiers")), F.concat(list_of(F.array_except(allowed, held), "missing:qualifiers."), list_of(F.array_except(held, allowed), "unknown:qualifiers."), list_of(empty, "type:qualifiers."))).otherwise(none),
    )
    problems = F.when(F.col("_own").isNull(), F.array(F.lit("no_object"))).when(F.col("required").isNull(), F.array(F.lit("unknown_predicate"))).otherwise(found)
    return rows.select("id", F.explode(problems).alias("problem"))


# --------------------------------------------------------------- prompts and requests


def plain_asset(value: str) -> str:
    """A prompt's text with LF line ends; blank texts and byte-order marks are errors."""
    if value.startswith("﻿") or not value.strip():
        raise ValueError("a prompt must not be blank or start with a byte-order mark")
    return value.replace("\r\n", "\n").replace("\r", "\n")


def route_blocks(blocks: DataFrame, routes: DataFrame) -> DataFrame:
    """Blocks of each route (request_id, source_id, start, end: sequences), with their evidence id.

    An equi-join by source with the range as a residual; routes are few for each source.
    """
    wanted = routes.select("request_id", "source_id", "start", "end")
    rows = blocks.join(wanted, "source_id").where(F.col("sequence").between(F.col("start"), F.col("end")))
    return rows.select("request_id", "source_id", "block_id", "sequence", "location_type", "location_value", "text", F.format_string(EVIDENCE_ID, "source_id", "block_id").alias("evidence_id"))


def route_problems(routes: DataFrame, selected: DataFrame) -> DataFrame:
    """(request_id, problem) of routes whose blocks are not complete, or blank in part."""
    seen = selected.groupBy("request_id").agg(F.count_distinct("sequence").alias("_n"), F.count_if(text.is_blank(F.col("text"))).alias("_blank"))
    rows = routes.join(seen, "request_id", "left")
    incomplete = F.coalesce("_n", F.lit(0)) != F.col("end") - F.col("start") + 1
    found = F.array_compact(F.array(F.when(incomplete, "incomplete_blocks"), F.when(F.coalesce("_blank", F.lit(0)) > 0, "blank_block")))
    return rows.select("request_id", F.explode(found).alias("problem"))


def identities(selected: DataFrame, system: str, extraction: str, configuration: str, prompt_version: str, contract: str) -> DataFrame:
    """One row a request: its evidence in sequence, canonical prompt and request with their
    digests and sizes. A request is bounded by its route, so is the array of its blocks."""
    item = F.struct("sequence", "block_id", "evidence_id", "location_type", "location_value", "source_id", "text")
    rows = selected.groupBy("request_id", "source_id").agg(F.array_sort(F.collect_list(item)).alias("_blocks"))
    shown = F.transform("_blocks", lambda b: F.struct(b["block_id"].alias("block_id"), b["evidence_id"].alias("evidence_id"), F.struct(b["location_type"].alias("location_type"), b["location_value"].alias("location_value")).alias("location"), b["sequence"].alias("sequence"), b["source_id"].alias("source_id"), b["text"].alias("text")))
    system, extraction = plain_asset(system), plain_asset(extraction)
    prompt = F.struct(
        F.lit(extraction).alias("extraction_prompt"), keys.sha256_upper(F.lit(extraction)).alias("extraction_prompt_sha256"), F.lit(configuration).alias("model_configuration_id"), shown.alias("ordered_evidence_blocks"),
        F.lit(contract).alias("output_contract_id"), F.lit(prompt_version).alias("prompt_version"), F.lit(system).alias("system_prompt"), keys.sha256_upper(F.lit(system)).alias("system_prompt_sha256"),
    )
    canonical = {"ignoreNullFields": "false"}
    rows = rows.withColumn("prompt", F.to_json(prompt, canonical)).withColumn("prompt_sha256", keys.sha256_upper(F.col("prompt")))
    request = F.struct(shown.alias("evidence_blocks"), F.lit(configuration).alias("model_configuration_id"), F.lit(contract).alias("output_contract_id"), "prompt_sha256", F.lit(prompt_version).alias("prompt_version"), "request_id", "source_id")
    rows = rows.withColumn("payload", F.to_json(request, canonical)).withColumn("request_sha256", keys.sha256_upper(F.col("payload")))
    evidence = F.transform("_blocks", lambda b: F.struct(b["evidence_id"].alias("evidence_id"), b["source_id"].alias("source_id"), b["block_id"].alias("block_id"), b["location_type"].alias("location_type"), b["location_value"].alias("location_value"), b["text"].alias("text")))
    return rows.select("request_id", "source_id", evidence.alias("evidence"), "prompt", "prompt_sha256", "payload", "request_sha256")


def measures(requests: DataFrame, per_million: str) -> DataFrame:
    """Bytes, planned tokens and their cost by request."""
    price = F.lit(per_million).cast("decimal(18,9)")
    tokens = numbers.planning_tokens(F.col("payload"))
    return requests.select("request_id", "source_id", F.octet_length("prompt").cast("long").alias("prompt_bytes"), F.octet_length("payload").cast("long").alias("payload_bytes"), tokens.alias("planned_tokens"), numbers.token_cost(tokens, price).alias("planned_cost"), "prompt_sha256", "request_sha256")


def identity_drift(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Requests whose stored digests are not those of their content now, or that one side lacks."""
    fields = ["prompt_sha256", "request_sha256"]
    return comparison.reconciled(stored.select("request_id", *fields), recomputed.select("request_id", *fields), ["request_id"])


def repeat_choice(sizes: DataFrame) -> DataFrame:
    """The request of the largest payload of each source, ties by id: the one that is asked again."""
    best = F.min_by(F.struct("request_id", "payload_bytes"), F.struct(-F.col("payload_bytes"), "request_id"))
    return sizes.groupBy("source_id").agg(best.alias("_b")).select("source_id", F.col("_b.request_id").alias("request_id"), F.col("_b.payload_bytes").alias("payload_bytes"))


def inventory_problems(invocations: DataFrame, routes: DataFrame, most_bytes: int) -> DataFrame:
    """(request_id, problem) of a manifest's invocations (request_id, source_id, document_sha256,
    payload_bytes, invocation_order): repeated ids, sources without a route, another document,
    payloads over the limit, and orders that are not 1..N."""
    r = routes.select("source_id", F.col("document_sha256").alias("_sha"), F.lit(True).alias("_known"))
    every = invocations.agg(F.count("*").alias("n"), F.count_distinct("invocation_order").alias("places"), F.min("invocation_order").alias("low"), F.max("invocation_order").alias("high"))
    broken = every.where((F.col("n") > 0) & ((F.col("places") < F.col("n")) | (F.col("low") != 1) | (F.col("high") != F.col("n")))).select(F.lit(None).cast("string").alias("request_id"), F.lit("order_not_1_to_n").alias("problem"))
    again = invocations.groupBy("request_id").agg(F.count("*").alias("_n")).where("_n > 1").select("request_id", F.lit("repeated_request").alias("problem"))
    rows = invocations.join(r, "source_id", "left")
    known = F.col("_known").isNotNull()
    found = F.array_compact(F.array(F.when(~known, "no_route"), F.when(known & (F.col("document_sha256") != F.col("_sha")), "other_document"), F.when(F.col("payload_bytes") > most_bytes, "payload_too_large")))
    return rows.select("request_id", F.explode(found).alias("problem")).unionByName(again).unionByName(broken)


def prepare(blocks: DataFrame, routes: DataFrame, prompts: dict[str, str], per_million: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A manifest: requests with their identities, their measures, and what is wrong with the routes.
    ``prompts``: system, extraction, configuration, prompt_version, contract."""
    selected = route_blocks(blocks, routes)
    requests = identities(selected, **prompts)
    return requests, measures(requests, per_million), route_problems(routes, selected)


# ------------------------------------------------------------------------- run loop


def run_with_cache(requests: DataFrame, cache: DataFrame, responder: Callable[[str], str], validate: Callable[[DataFrame], DataFrame], now: str, most_attempts: int = 2, checkpoint: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Each request once: from the cache, else asked, and asked again while the error's class
    may be retried, up to ``most_attempts`` rounds in all; then judged.

    Result: the request's columns, response, error_class, cache (hit or miss), attempts, the
    columns of ``validate`` and ``recorded_at``, which is the given time. ``checkpoint`` cuts the lineage
    between rounds (a written table on a cluster), so that no request is asked twice.
    """
    looked = model_calls.cached(requests, cache)
    hits = looked.where("cache = 'hit'").withColumns({"error_class": F.lit(None).cast("string"), "attempts": F.lit(0)})
    waiting, done = looked.where("cache = 'miss'").drop("response"), hits
    for attempt in range(1, most_attempts + 1):
        replies = checkpoint(model_calls.respond(waiting, responder))
        asked = waiting.join(replies, "request_sha256").withColumn("attempts", F.lit(attempt))
        again = F.coalesce(_error_name(F.col("error_class")).isin(RETRYABLE), F.lit(False)) if attempt < most_attempts else F.lit(False)
        done = done.unionByName(asked.where(~again).select(*done.columns))
        waiting = asked.where(again).select(*waiting.columns)
    return validate(done).withColumn("recorded_at", F.lit(now).cast("timestamp"))


def _error_name(error_class: Column) -> Column:
    """timeout for TimeoutError, rate_limit for RateLimitError, and so on."""
    return F.regexp_replace(text.error_code(error_class), "_error$", "") if error_class is not None else error_class


def cache_records(replies: DataFrame) -> DataFrame:
    """Self-hashed cache records of replies (request_sha256, configuration, response, attempts, cost, at):
    a name from the identity, the canonical JSON, and its digest."""
    identity = F.to_json(F.struct("configuration", "request_sha256"), {"ignoreNullFields": "false"})
    body = F.struct("at", "attempts", "configuration", F.col("cost").cast("string").alias("cost"), "request_sha256", "response", keys.sha256_upper(F.col("response")).alias("response_sha256"))
    rows = replies.withColumns({"name": keys.sha256_upper(identity), "record": F.to_json(body, {"ignoreNullFields": "false"})})
    return rows.select("name", "record", keys.sha256_upper(F.col("record")).alias("record_sha256"))


_RECORD = "at string, attempts int, configuration string, cost string, request_sha256 string, response string, response_sha256 string"


def read_cache_records(records: DataFrame) -> DataFrame:
    """The fields of cache records, with ``problem``: a record that is not what its digest says, not canonical,
    not named by its identity, or whose response is another."""
    rows = records.withColumn("_r", F.from_json("record", _RECORD))
    r = F.col("_r")
    name = keys.sha256_upper(F.to_json(F.struct(r["configuration"].alias("configuration"), r["request_sha256"].alias("request_sha256")), {"ignoreNullFields": "false"}))
    problem = (
        F.when(~F.col("record_sha256").eqNullSafe(keys.sha256_upper(F.col("record"))), "cache_hash_mismatch")
        .when(r.isNull() | ~F.col("record").eqNullSafe(F.to_json(r, {"ignoreNullFields": "false"})), "cache_record_invalid")
        .when(~F.col("name").eqNullSafe(name), "cache_path_escape")
        .when(~r["response_sha256"].eqNullSafe(keys.sha256_upper(r["response"])), "cache_record_invalid")
    )
    return rows.select("name", "_r.*", problem.alias("problem"))


def provenance(rows: DataFrame) -> DataFrame:
    """A self-hashed record of each request that was run."""
    fields = ["request_id", "request_sha256", "cache", "attempts", "error_class", "recorded_at"]
    kept = rows.select(*fields, F.sha2("response", 256).alias("response_sha256"))
    return kept.withColumn("record_sha256", keys.fields_digest(*[F.col(c) for c in sorted(kept.columns)]))


def run_report(rows: DataFrame) -> DataFrame:
    """All counters of a run: rows (role, status, cache, attempts, valid, abstained, review_candidates,
    input_tokens, output_tokens, cost); cost of cache misses alone."""
    n = lambda c, name: F.count_if(c).alias(name)
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    col = F.col
    cost = F.sum(F.when(col("cache") == "miss", F.coalesce("cost", F.lit(0).cast("decimal(38,9)"))))
    return rows.agg(
        F.count("*").alias("invocation_total"), n(col("role") == "primary", "primary_invocation_count"), n(col("role") == "repeat", "repeat_invocation_count"), n(col("cache") == "hit", "cache_hit_count"),
        n(col("cache") == "miss", "cache_miss_count"), total("attempts", "provider_call_count"), total("attempts", "attempt_count"), n(col("status") == "success", "successful_terminal_response_count"),
        n(col("status") == "failure", "provider_failure_count"), n(col("status") == "timeout", "timeout_outcome_count"), n(col("valid"), "validation_success_count"), n(~col("valid"), "validation_failure_count"),
        n(col("abstained"), "abstention_count"), n(col("review_candidates") > 0, "review_required_output_count"), total("input_tokens", "total_reported_input_tokens"), total("output_tokens", "total_reported_output_tokens"),
        F.coalesce(cost, F.lit(0).cast("decimal(38,9)")).cast("decimal(38,9)").alias("total_estimated_cost"),
    )


def payload(prompt: str, schema: dict, model: str) -> str:
    """The JSON body of one call: model, input and the strict schema of the reply."""
    return json.dumps({"input": prompt, "model": model, "text": {"format": {"name": "facts", "schema": schema, "strict": True, "type": "json_schema"}}}, sort_keys=True, ensure_ascii=False)
