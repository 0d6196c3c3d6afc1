"""Model replies against their requests: one stable code for each that is refused.

A reply is judged inside its own row: the request's evidence is an array that the
size of a request bounds, and the predicate registry is a constant, so nothing is joined.
Only the strictness of the JSON itself (names given twice, NaN, text behind the
object), which no built-in function tells, runs in Arrow batches.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from factloom.functions import keys, text
from factloom.operators import registry

# Fixed values.
CODES = [
    "canonical_request_hash_mismatch", "prompt_hash_mismatch", "response_request_mismatch", "provider_not_successful", "invalid_json", "invalid_output_shape", "source_mismatch", "missing_evidence_reference",
    "cross_source_evidence_reference", "invalid_predicate", "invalid_qualifier", "schema_invalid", "unknown_evidence_reference",
]
MOST_EXCERPT = 240

_ENTITIES = "entities array<struct<entity_id string, name string, entity_type string>>"
_FACT = "candidate_id string, subject_text string, subject_type string, predicate string, raw_value string, value_type string, normalized_value string, qualifiers map<string,string>, evidence_ids array<string>, confidence double"
REPLY = f"schema_version string, batch_id string, source_ids array<string>, {_ENTITIES}, evidence_references array<struct<evidence_id string, source_id string, block_id string, location_type string, location_value string, text_excerpt string, evidence_status string>>, candidate_facts array<struct<{_FACT}, source_id string, extraction_method string>>, warnings array<string>"
SEMANTIC = f"schema_version string, batch_id string, {_ENTITIES}, candidate_facts array<struct<{_FACT}>>, warnings array<string>"


class _Strict(json.JSONDecoder):
    """Standard JSON only, each name of an object once."""

    def __init__(self):
        super().__init__(object_pairs_hook=self._object, parse_constant=self._constant)

    @staticmethod
    def _object(items):
        found = dict(items)
        if len(found) != len(items):
            raise ValueError("a name stands twice")
        return found

    @staticmethod
    def _constant(name):
        raise ValueError(name)


@F.pandas_udf(StringType())
def strict_json_code(raw: pd.Series) -> pd.Series:
    """Null for one strict JSON object, else the code of what is wrong."""
    decoder = _Strict()

    def code(value) -> str | None:
        try:
            return None if isinstance(decoder.decode(value), dict) else "invalid_output_shape"
        except (TypeError, ValueError, RecursionError):
            return "invalid_json"

    return raw.map(code, na_action=None).astype(object)


def _exists(items: Column, test) -> Column:
    return F.coalesce(F.exists(items, test), F.lit(False))


def _blank(value: Column) -> Column:
    return value.isNull() | text.is_blank(value)


def _contracts() -> Column:
    """The registry as a constant: predicate to its subject kinds, value types and qualifiers."""
    words = lambda items: F.array(*[F.lit(x) for x in items]).cast("array<string>")
    pairs = []
    for name, subjects, values, required, optional, _ in registry.PREDICATES:
        kinds = [registry._SUBJECT[c] for c in subjects]
        pairs += [F.lit(name), F.struct(words(kinds).alias("subjects"), words(values.split()).alias("types"), words(required.split()).alias("required"), words([*required.split(), *optional.split()]).alias("known"))]
    return F.create_map(*pairs)


def _contract_code(facts: Column) -> Column:
    """The first that holds of any fact: unknown predicate, wrong qualifiers, no evidence, another breach."""
    contracts = _contracts()
    rule = lambda f: F.try_element_at(contracts, f["predicate"])
    qualifiers = lambda f: F.coalesce(f["qualifiers"], F.create_map().cast("map<string,string>"))
    filled = lambda f: F.map_keys(F.map_filter(qualifiers(f), lambda k, v: ~_blank(v)))
    wrong = lambda f: (F.size(F.array_except(F.map_keys(qualifiers(f)), rule(f)["known"])) > 0) | (F.size(F.array_except(rule(f)["required"], filled(f))) > 0)
    broken = lambda f: (
        _blank(f["candidate_id"])
        | _blank(f["subject_text"])
        | _blank(f["raw_value"])
        | ~F.coalesce(F.array_contains(rule(f)["subjects"], f["subject_type"]), F.lit(False))
        | ~F.coalesce(F.array_contains(rule(f)["types"], f["value_type"]), F.lit(False))
        | ~F.coalesce(f["confidence"].between(0.0, 1.0), F.lit(False))
    )
    return (
        F.when(_exists(facts, lambda f: rule(f).isNull()), "invalid_predicate")
        .when(_exists(facts, wrong), "invalid_qualifier")
        .when(_exists(facts, lambda f: F.coalesce(F.size(f["evidence_ids"]), F.lit(0)) <= 0), "missing_evidence_reference")
        .when(_exists(facts, broken), "schema_invalid")
    )


def _envelope_code() -> Column:
    """What is wrong before the reply is read: identity of the request, of the response, its status, its JSON."""
    return (
        F.when(~F.col("request_sha256").eqNullSafe(keys.sha256_upper(F.col("payload"))), "canonical_request_hash_mismatch")
        .when(~F.col("prompt_sha256").eqNullSafe(keys.sha256_upper(F.col("prompt"))), "prompt_hash_mismatch")
        .when(~F.col("response_request_id").eqNullSafe(F.col("request_id")), "response_request_mismatch")
        .when(~F.col("terminal_status").eqNullSafe(F.lit("success")), "provider_not_successful")
    )


def _read(exchanges: DataFrame, schema: str) -> DataFrame:
    """Adds ``_early``, the code of what is wrong so far, and ``_reply``, the parsed object."""
    rows = exchanges.withColumn("_early", _envelope_code())
    rows = rows.withColumn("_early", F.coalesce("_early", strict_json_code(F.when(F.col("_early").isNull(), F.col("raw_response")))))
    return rows.withColumn("_reply", F.when(F.col("_early").isNull(), F.from_json("raw_response", schema)))


def _finish(rows: DataFrame, late: Column, result: Column) -> DataFrame:
    rows = rows.withColumn("error_code", F.coalesce("_early", late))
    rows = rows.withColumn("result", F.when(F.col("error_code").isNull(), result))
    digest = F.when(F.col("result").isNotNull(), keys.sha256_upper(F.to_json("result", {"ignoreNullFields": "false"})))
    return rows.withColumn("output_sha256", digest).drop("_early", "_reply", "_late")


def validate(exchanges: DataFrame) -> DataFrame:
    """Adds ``error_code`` (null: accepted), ``result`` and ``output_sha256`` to rows of a request and its
    reply: request_id, source_id, payload, request_sha256, prompt, prompt_sha256, evidence
    (array of evidence_id, source_id, block_id, location_type, location_value, text), response_request_id,
    terminal_status, raw_response. Nothing is repaired; the first code that applies stays."""
    rows = _read(exchanges, REPLY)
    reply, source = F.col("_reply"), F.col("source_id")
    references, facts = reply["evidence_references"], reply["candidate_facts"]
    approved = F.transform("evidence", lambda e: e["evidence_id"])
    place = lambda e: F.struct(e["evidence_id"].alias("evidence_id"), e["block_id"].alias("block_id"), e["location_type"].alias("location_type"), e["location_value"].alias("location_value"))
    places = F.transform("evidence", place)
    late = (
        F.when(reply["source_ids"].isNotNull() & (reply["source_ids"] != F.array(source)), "source_mismatch")
        .when(_exists(references, lambda r: text.is_blank(r["evidence_id"])), "missing_evidence_reference")
        .when(_exists(references, lambda r: r["source_id"] != source), "cross_source_evidence_reference")
        .when(_exists(facts, lambda f: (F.size(f["evidence_ids"]) == 0) | _exists(f["evidence_ids"], _blank)), "missing_evidence_reference")
        .when(facts.isNull() | references.isNull() | reply["source_ids"].isNull(), "schema_invalid")
    )
    late = F.coalesce(late, _contract_code(facts))
    beyond = (
        F.when(_exists(references, lambda r: ~F.array_contains(places, place(r))), "unknown_evidence_reference")
        .when(_exists(facts, lambda f: F.size(F.array_except(f["evidence_ids"], approved)) > 0), "unknown_evidence_reference")
        .when(_exists(facts, lambda f: ~f["extraction_method"].eqNullSafe(F.lit("llm"))), "schema_invalid")
    )
    return _finish(rows, F.coalesce(late, beyond), reply)


def hydrate(exchanges: DataFrame) -> DataFrame:
    """As ``validate`` for replies that name evidence by id only: source, locator and an excerpt of
    at most 240 characters come from the request's own evidence, in its order."""
    rows = _read(exchanges, SEMANTIC)
    reply = F.col("_reply")
    facts = reply["candidate_facts"]
    approved = F.transform("evidence", lambda e: e["evidence_id"])
    late = F.coalesce(
        F.when(facts.isNull(), "schema_invalid"),
        _contract_code(facts),
        F.when(_exists(facts, lambda f: _exists(f["evidence_ids"], _blank)), "missing_evidence_reference"),
        F.when(_exists(facts, lambda f: F.size(F.array_except(f["evidence_ids"], approved)) > 0), "unknown_evidence_reference"),
    )
    used = F.array_distinct(F.flatten(F.transform(facts, lambda f: f["evidence_ids"])))
    chosen = F.filter("evidence", lambda e: F.array_contains(used, e["evidence_id"]))
    excerpt = lambda e: F.regexp_replace(F.substring(text.strip(e["text"]), 1, MOST_EXCERPT), r"(?U)\s+\z", "")
    references = F.transform(chosen, lambda e: F.struct(e["evidence_id"].alias("evidence_id"), e["source_id"].alias("source_id"), e["block_id"].alias("block_id"), e["location_type"].alias("location_type"), e["location_value"].alias("location_value"), excerpt(e).alias("text_excerpt"), F.lit("supported").alias("evidence_status")))
    own = F.transform(facts, lambda f: f.withField("source_id", F.col("source_id")).withField("extraction_method", F.lit("llm")))
    result = F.struct(reply["schema_version"].alias("schema_version"), reply["batch_id"].alias("batch_id"), F.array("source_id").alias("source_ids"), reply["entities"].alias("entities"), references.alias("evidence_references"), own.alias("candidate_facts"), reply["warnings"].alias("warnings"))
    return _finish(rows, late, result)


def numbered(facts: DataFrame, key: str, items: str) -> DataFrame:
    """One row an item of an array, with its ordinal from 1."""
    return facts.select(key, F.posexplode(items).alias("ordinal", "item")).withColumn("ordinal", F.col("ordinal") + 1)
