"""Queries of replies, gold data, comparisons, agents and manifests over tables made from the star schema.

Each row's fault, if it has one, follows from its number, so that the oracle can name
what has to be found without any of the engine's patterns or joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import keys, metadata, numbers, text
from factloom.operators import agents, comparison, evaluation, freeze, goldset, manifests, matching, outputs, registry, reports, validation
from factloom.operators import invocations as invocations_
from factloom.plans.rule_queries import _facts
from factloom.session import spread, table

def _key() -> Column:
    return F.col("o_orderkey")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


# ------------------------------------------------------------------------- replies

#: The code of each kind of fault, by order number modulo 16; none: accepted.
FAULTS = [
    None, "canonical_request_hash_mismatch", "prompt_hash_mismatch", "response_request_mismatch", "provider_not_successful", "invalid_json", "invalid_json", "invalid_output_shape", "source_mismatch",
    "missing_evidence_reference", "cross_source_evidence_reference", "missing_evidence_reference", "invalid_predicate", "invalid_qualifier", "schema_invalid", "unknown_evidence_reference",
]


def _exchanges(spark: SparkSession, sf_dir: str, semantic: bool) -> DataFrame:
    """A request and its reply for every order, with the fault of its number."""
    o = table(spark, sf_dir, "orders")
    fault = _key() % 16
    source = _text("S", F.col("o_custkey") % 7)
    own = lambda n: _text("E", _key(), f"-{n}")
    passage = _text("  Order ", _key(), " ", F.repeat(F.col("o_orderpriority"), 30), "  ")
    item = lambda n, words: F.struct(own(n).alias("evidence_id"), source.alias("source_id"), F.lit(f"B{n}").alias("block_id"), F.lit("page").alias("location_type"), F.lit(str(n)).alias("location_value"), words.alias("text"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    cited = F.when(fault == 15, F.lit("E-none")).otherwise(own(2))
    evidence_ids = F.when(fault == 11, F.lit("[]")).otherwise(F.concat(F.lit("["), quoted(cited), F.lit("]")))
    fact = _text(
        '{"candidate_id":"C', _key(), '","subject_text":"Order ', _key(), '","subject_type":"programme","predicate":"', F.when(fault == 12, "bugdet").otherwise(F.lit("budget")), '","raw_value":"GBP ', F.floor("o_totalprice"),
        '","value_type":"money","normalized_value":"', F.floor("o_totalprice"), '","qualifiers":{"', F.when(fault == 13, "unit").otherwise(F.lit("budget_status")), '":"approved"},"evidence_ids":', evidence_ids,
        ',"confidence":', F.when(fault == 14, "2.0").otherwise(F.lit("0.9")), "" if semantic else ',"extraction_method":"llm"', "}",
    )
    named = F.when(fault == 9, F.lit(" ")).otherwise(own(2))
    reference = _text('{"evidence_id":', quoted(named), ',"source_id":', quoted(F.when(fault == 10, "S9").otherwise(source)), ',"block_id":"B2","location_type":"page","location_value":"2","text_excerpt":"x","evidence_status":"supported"}')
    sources = F.concat(F.lit('["'), F.when(fault == 8, "S8").otherwise(source), F.lit('"]'))
    body = _text('{"schema_version":"0.1","batch_id":"B","entities":[],"candidate_facts":[', fact, '],"warnings":[]', "" if semantic else F.concat(F.lit(',"source_ids":'), sources, F.lit(',"evidence_references":['), reference, F.lit("]")))
    raw = F.when(fault == 5, F.concat(body, F.lit("} x"))).when(fault == 6, F.concat(body, F.lit(',"batch_id":"B"}'))).when(fault == 7, F.concat(F.lit("["), body, F.lit("}]"))).otherwise(F.concat(body, F.lit("}")))
    payload, prompt = _text("payload ", _key()), _text("prompt ", _key())
    return o.select(
        _key().alias("request_id"), source.alias("source_id"), payload.alias("payload"), prompt.alias("prompt"),
        F.when(fault == 1, "0" * 64).otherwise(keys.sha256_upper(payload)).alias("request_sha256"), F.when(fault == 2, "0" * 64).otherwise(keys.sha256_upper(prompt)).alias("prompt_sha256"),
        F.when(fault == 3, _key() + 1).otherwise(_key()).alias("response_request_id"), F.when(fault == 4, "timeout").otherwise(F.lit("success")).alias("terminal_status"), raw.alias("raw_response"),
        F.array(item(1, F.lit("first")), item(2, passage)).alias("evidence"),
    )


def output_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every reply; accepted ones have their facts and a digest."""
    found = outputs.validate(_exchanges(spark, sf_dir, False))
    return found.select("request_id", F.coalesce("error_code", F.lit("accepted")).alias("code"), F.coalesce(F.size("result.candidate_facts"), F.lit(0)).cast("long").alias("facts"), F.col("output_sha256").isNotNull().alias("digest"))


def output_hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of accepted semantic replies, taken from the request."""
    found = outputs.hydrate(_exchanges(spark, sf_dir, True)).where("error_code IS NULL")
    rows = found.select("request_id", F.explode("result.evidence_references").alias("e"), F.element_at("result.candidate_facts", 1).alias("f"))
    return rows.select("request_id", "e.evidence_id", "e.source_id", "e.block_id", "e.location_value", "e.text_excerpt", F.col("f.extraction_method").alias("method"))


def hydration_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outputs.hydrate(_exchanges(spark, sf_dir, True))
    return found.groupBy(F.coalesce("error_code", F.lit("accepted")).alias("code")).agg(F.count("*").alias("n"))


def fact_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document"), F.array(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("facts"))
    return outputs.numbered(o, "document", "facts").select("document", F.col("ordinal").cast("long").alias("ordinal"), F.col("item").alias("fact"))


# ----------------------------------------------------------------------- gold data


def _gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Gold facts and cases of orders, with customers as sources and orders as pages."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    source = _text("C", F.col("o_custkey"))
    n = _key()
    split = c.select(_text("C", F.col("c_custkey")).alias("source_id"), F.when(F.col("c_custkey") % 3 == 0, "held_out").otherwise(F.lit("development")).alias("split"), F.col("c_mktsegment").alias("document_family"), F.when(F.col("c_custkey") % 10 == 0, "EML").otherwise(F.lit("PDF")).alias("source_format"))
    blocks = o.where(n % 13 != 0).select(source.alias("source_id"), _text("B", n).alias("block_id"), F.when(n % 17 == 0, "table").otherwise(F.lit("page_text")).alias("block_type"), F.lit("page").alias("location_type"), F.when(n % 19 == 0, "2").otherwise(F.lit("1")).alias("location_value"), _text("Order ", n, " is ", F.col("o_orderpriority"), ".").alias("text"))
    kind = F.when(n % 4 == 0, "date").when(n % 4 == 1, "money").otherwise(F.lit("string"))
    gold = o.select(
        _text("G", n).alias("annotation_id"), source.alias("source_id"), F.when(F.col("o_custkey") % 3 == 0, "held_out").otherwise(F.lit("development")).alias("split"), F.when(n % 7 == 0, "OTHER").otherwise(F.lit("AUTOMOBILE")).alias("document_family"),
        F.lit("programme").alias("subject_type"), F.when(n % 4 == 0, "target_date").when(n % 4 == 1, "budget").otherwise(F.lit("recommendation")).alias("predicate"), kind.alias("value_type"), F.when(n % 8 == 0, "soon").when(n % 4 == 0, "2024-02-29").otherwise(F.lit("word")).alias("value_text"),
        F.lit(5).cast("decimal(38,9)").alias("value_number"), F.when(n % 5 != 0, "GBP").alias("value_currency"), F.lit(None).cast("array<string>").alias("value_list"), _text("B", n).alias("evidence_block_id"), F.lit("1").alias("evidence_location_value"),
        F.when(n % 23 == 0, "nowhere").otherwise(_text("Order ", n)).alias("evidence_excerpt"), _text("Order ", n, " has a long value that nobody should know ahead").alias("raw_value"), F.when(n % 2 == 0, "owner_verified").when(n % 3 == 0, "rejected").otherwise(F.lit("draft_ai_assisted")).alias("review_status"),
    )
    cases = o.where(n % 6 == 0).select(
        F.when(n % 60 == 0, "CASE-X").otherwise(_text("CASE-", n)).alias("case_id"), source.alias("source_id"), F.lit("development").alias("split"), F.array(_text("B", n), _text("B", n + 1)).alias("evidence_block_ids"), F.array(F.lit("1"), F.lit("1")).alias("evidence_location_values"),
        F.when(n % 4 == 0, "ambiguous").otherwise(F.lit("unsupported")).alias("case_type"), F.when(n % 2 == 0, "owner_verified").otherwise(F.lit("rejected")).alias("review_status"),
    )
    return gold, cases, split, blocks


def gold_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, _, split, blocks = _gold(spark, sf_dir)
    found = goldset.fact_problems(gold, split, blocks)
    return found.groupBy("ordinal", "problem").agg(F.count("*").alias("n")).select(F.col("ordinal").cast("long").alias("ordinal"), "problem", "n")


def gold_case_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cases, split, blocks = _gold(spark, sf_dir)
    return goldset.case_problems(cases, split, blocks).groupBy("problem").agg(F.count("*").alias("n"))


def gold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, cases, _, _ = _gold(spark, sf_dir)
    return goldset.dataset_report(gold, cases)


def gold_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, _, _, _ = _gold(spark, sf_dir)
    return goldset.distribution_problems(gold, "predicate", {"target_date": 1, "budget": 2, "owner": 3})


def gold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, _, _, _ = _gold(spark, sf_dir)
    return goldset.counted(gold, "predicate").select(F.to_json("predicate").alias("counts"))


def gold_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory of records against a manifest that is wrong for some sources."""
    o = table(spark, sf_dir, "orders")
    records = o.select(F.lit("fact").alias("kind"), (F.col("o_custkey") % 10).cast("string").alias("source_id"), F.when(_key() % 3 == 0, "held_out").otherwise(F.lit("development")).alias("split"))
    manifest = goldset.inventory(records).withColumn("n", F.when(F.col("source_id") == "4", F.col("n") + 1).otherwise(F.col("n"))).where("source_id <> '7'")
    return goldset.inventory_differences(records, manifest).select("side", "split", "source_id", "n")


def gold_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out values in public documents, here one document a region."""
    gold, _, _, _ = _gold(spark, sf_dir)
    docs = table(spark, sf_dir, "region").select(F.col("r_name").alias("document"), _text("See G", F.col("r_regionkey") * 3, ", and: Order ", F.col("r_regionkey") * 3 + 1, " has a long value that nobody should know ahead!").alias("text"))
    return goldset.leaks(gold, docs)


# --------------------------------------------------------------------- comparisons


def _linked_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact for most orders, with the block of its order and that of the next."""
    o = table(spark, sf_dir, "orders").where(_key() % 5 != 0)
    n = _key()
    qualifiers = F.when(n % 4 == 0, F.create_map(F.lit("recommendation_id"), F.lit("1"), F.lit("effective_date"), F.lit("x"))).otherwise(F.create_map(F.lit("recommendation_id"), F.lit("1")))
    return o.select(
        F.lit("S").alias("source_id"), F.concat(F.lit("K"), F.lpad(n.cast("string"), 8, "0")).alias("candidate_id"), F.when(n % 3 == 0, "metric").otherwise(F.lit("recommendation")).alias("predicate"), qualifiers.alias("qualifiers"),
        F.when(n % 6 == 0, "required").otherwise(F.lit("not_required")).alias("review_status"), F.when(n % 9 == 0, F.array(F.lit("ambiguous_metric_value_relationship"))).otherwise(F.array(F.lit("other"))).alias("warnings"),
        F.array(_text("B", n), _text("B", n + 1)).alias("block_ids"), _text("Order ", n).alias("subject_text"), F.col("o_orderpriority").alias("raw_value"),
    )


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    behavior = F.element_at(F.array(F.lit("preserve_missing"), F.lit("do_not_extract"), F.lit("route_to_review")), (_key() % 3 + 1).cast("int"))
    return o.where(_key() % 2 == 0).select(_text("CASE-", _key()).alias("case_id"), F.lit("S").alias("source_id"), behavior.alias("expected_behavior"), F.array(_text("B", _key())).alias("evidence_block_ids"))


def challenge_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = comparison.challenge_outcomes(_cases(spark, sf_dir), _linked_facts(spark, sf_dir))
    return found.select("case_id", "expected_behavior", "outcome", F.array_join("related_candidate_ids", ",").alias("related"))


def review_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = comparison.review_packet(_cases(spark, sf_dir), _linked_facts(spark, sf_dir))
    return found.select("case_id", F.array_join(F.transform("candidates", lambda c: F.concat_ws("|", c["candidate_id"], c["subject_text"])), ";").alias("candidates"))


def _pairable(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two candidates an order, of which the second has another subject, and gold with some other values."""
    candidates = _facts(spark, sf_dir, False)
    block = F.substring_index(F.col("candidate_id"), "-", -1).cast("long")
    candidates = candidates.withColumn("block_ids", F.array(block.cast("string")))
    second = candidates.withColumn("candidate_id", F.concat(F.col("candidate_id"), F.lit("b"))).withColumn("subject_text", F.lit("Another"))
    gold = _facts(spark, sf_dir, True)
    gold = gold.withColumn("evidence_block_id", F.substring_index(F.col("annotation_id"), "-", -1).cast("long").cast("string"))
    return candidates.unionByName(second), gold


def nearest_in_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, gold = _pairable(spark, sf_dir)
    found = comparison.nearest_in_block(gold, candidates)
    return found.select("annotation_id", "closest_candidate_id", F.array_join("mismatch_fields", ",").alias("mismatch_fields"))


def _part_facts(spark: SparkSession, sf_dir: str, source: Column) -> tuple[DataFrame, DataFrame]:
    """Parts as candidates and as gold, with their size as value, of the given source: a part compares with all of its source."""
    p = spread(table(spark, sf_dir, "part"))
    n = F.col("p_partkey")
    rows = p.select(n.alias("_n"), source.alias("source_id"), F.lit("metric").alias("predicate"), F.lit("number").alias("value_type"), F.lit(None).cast("string").alias("value_text"), F.lit(None).cast("string").alias("value_currency"), F.col("p_size").cast("decimal(38,9)").alias("value_number"))
    candidates = rows.select("*", F.format_string("K%08d", "_n").alias("candidate_id"), F.when(F.col("_n") % 2 == 0, "part").otherwise(F.lit("other")).alias("subject_text"), F.when(F.col("_n") % 3 == 0, "risk").otherwise(F.lit("metric")).alias("subject_type"), F.create_map(F.lit("unit"), F.when(F.col("_n") % 5 == 0, "kg").otherwise(F.lit("m"))).alias("qualifiers")).drop("_n")
    gold = rows.select("*", F.format_string("A%08d", "_n").alias("annotation_id"), F.lit("Part").alias("subject_text"), F.lit("metric").alias("subject_type"), F.create_map(F.lit("unit"), F.lit("m")).alias("qualifiers")).drop("_n")
    return candidates, gold


def _gold_sample(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as facts, cut into sources of equal brand, size and remainder of the key, which are few: what the oracles of
    pair_scores and failure_categories compare."""
    return _part_facts(spark, sf_dir, F.concat_ws("-", "p_brand", F.col("p_size").cast("string"), (F.col("p_partkey") % 211).cast("string")))


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each annotation the candidates that agree with it in the most respects, and why they do not match."""
    candidates, gold = _gold_sample(spark, sf_dir)
    found = comparison.closest_by_score(candidates, gold)
    return found.select("annotation_id", "candidate_id", F.col("score").cast("long").alias("score"), F.array_join("reasons", ",").alias("reasons"))


def nearest_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest of all candidates of an annotation's brand, with the failure category of each."""
    candidates, gold = _part_facts(spark, sf_dir, F.coalesce("p_brand", F.lit("")))
    found = matching.closest(candidates, gold)
    return found.select("annotation_id", F.col("rank").cast("long").alias("rank"), "candidate_id", F.col("mismatches").cast("long").alias("mismatches"), "category")


def failure_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, gold = _gold_sample(spark, sf_dir)
    return matching.category_counts(matching.closest(candidates, gold))


def evidence_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched pairs with what their evidence agrees in."""
    o = table(spark, sf_dir, "orders")
    name = lambda p: _text(p, _key())
    pairs = o.select(name("K").alias("candidate_id"), name("A").alias("annotation_id"))
    gold = o.select(name("A").alias("annotation_id"), F.lit("S").alias("source_id"), name("B").alias("evidence_block_id"), F.lit("page").alias("evidence_location_type"), F.lit("1").alias("evidence_location_value"), _text("The Order ", _key(), ".").alias("evidence_excerpt"))
    cited = o.where(_key() % 5 != 0).select(name("K").alias("candidate_id"), F.when(_key() % 2 == 0, "S").otherwise(F.lit("T")).alias("source_id"), name("B").alias("block_id"), F.lit("page").alias("location_type"), F.when(_key() % 3 == 0, "1").otherwise(F.lit("2")).alias("location_value"), F.when(_key() % 7 == 0, "x").otherwise(_text("the  ORDER ", _key())).alias("text_excerpt"))
    return matching.with_evidence_checks(pairs, cited, gold)


def candidate_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with the annotation it strictly matches."""
    candidates, gold = _facts(spark, sf_dir, False), _facts(spark, sf_dir, True)
    return comparison.trace_with_matches(candidates.select("candidate_id"), matching.strict_matches(candidates, gold))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    n = _key()
    before = {"subject_text": F.lit("We"), "subject_type": F.lit("other"), "raw_value": _text("publish it ", n), "normalized_value": F.lit("a")}
    after = {
        "subject_text": F.when(n % 2 == 0, "We").otherwise(F.lit("The Office")), "subject_type": F.when(n % 3 == 0, "other").otherwise(F.lit("organisation")),
        "raw_value": F.when(n % 4 == 0, before["raw_value"]).when(n % 4 == 1, F.concat(F.lit("Publish  it "), n.cast("string"), F.lit(" soon"))).otherwise(F.lit("other")), "normalized_value": F.when(n % 5 == 0, "a").otherwise(F.lit("our plan")),
    }
    operation = F.when(n % 6 == 0, "safe_recommendation_wrapper_collapsed").otherwise(F.lit("capitalisation_only"))
    modifiers = F.when(n % 7 == 0, F.array(F.lit("now"), F.lit("also"))).otherwise(F.array().cast("array<string>"))
    return o.select("o_orderkey", comparison.transformation_flags(before, after, operation, modifiers).alias("flags"), operation.alias("operation"))


def transformation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("o_orderkey", F.array_join("flags", ",").alias("flags"))


def trace_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.trace_counts(_changes(spark, sf_dir), ["flags", "operation"])


def attempt_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(_key().alias("id"))
    seen = o.where("id % 4 <> 0").unionByName(o.where("id % 6 = 1")).unionByName(o.where("id % 50 = 2").select((0 - F.col("id")).alias("id")))
    return comparison.inventory_problems(o, seen, "id")


def case_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and warning codes that cases name and no run has."""
    o = table(spark, sf_dir, "orders")
    cases = o.select(_text("CASE-", _key()).alias("case_id"), F.array(_text("K", _key())).alias("candidate_ids"), F.array(F.col("o_orderpriority")).alias("warning_codes"))
    facts = o.where(_key() % 3 != 0).select(_text("K", _key()).alias("candidate_id"))
    codes = o.select(F.col("o_orderpriority").alias("code")).where("code <> '5-LOW'")
    return comparison.reference_problems(cases, facts, codes)


def manifest_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored sums by customer against recomputed ones; some are wrong, some rows lack."""
    sums = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"))
    stored = sums.where("o_custkey % 10 <> 3").withColumn("n", F.when(F.col("o_custkey") % 10 == 4, F.col("n") + 1).otherwise(F.col("n")))
    return comparison.reconciled(stored, sums, ["o_custkey"])


def metric_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = table(spark, sf_dir, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "none").alias("none"), F.count("*").alias("n"))
    found = comparison.fractions(report, {"finished": (F.col("f"), F.col("n")), "none_of_none": (F.col("none"), F.col("none"))})
    return found.withColumn("value", F.round("value", 6))


def process_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("low"), F.count_distinct("o_orderstatus").alias("kinds"))
    checks = {"any_rows": F.col("n") > 0, "negative_price": F.col("low") < 0, "three_kinds": F.col("kinds") == 3, "no_rows": F.col("n") == 0}
    found = comparison.all_failing(reports.gates(report, checks))
    return found.select("gates", "passed", F.array_join("failing", ",").alias("failing"))


def freeze_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of five sources and three cases for each customer; most have one fault or two."""
    c = spread(table(spark, sf_dir, "customer")).select(F.col("c_custkey").alias("run_id"))
    m, part = F.col("run_id") % 41, F.col("run_id") % 5
    passes = c.select("run_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("s")).select("run_id", "s", F.explode(F.array(F.lit(1), F.lit(2))).alias("pass"))
    here = (F.col("s") == part) & (F.col("pass") == 2)
    passes = passes.select("run_id", F.col("s").cast("string").alias("source_id"), "pass", (~(here & (m == 30))).alias("succeeded"), (~(here & (m == 31))).alias("schema_valid"), F.when(here & (m == 32), "KeyError").alias("exception"), F.when(here & (m == 33), "x").when(here & (m == 34), F.lit(None)).otherwise(F.lit("y")).alias("output_sha256"))
    cases = c.select("run_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("case_id"))
    last = F.col("case_id") == 2
    assessments = cases.select("run_id", "case_id", F.when(last & (m == 35), "pending").when(last & (m == 36), "fail").otherwise(F.lit("pass")).alias("status"))
    diagnostics = cases.select("run_id", "case_id", (~(last & (m == 37))).alias("passed"))
    names = F.array(*map(F.lit, freeze.CHECKS))
    checks = c.where(m != 39).select("run_id", F.posexplode(names).alias("k", "name")).select("run_id", "name", (F.col("k") != m).alias("passed")).unionByName(c.select("run_id", F.explode(F.array(*map(F.lit, freeze.ABSENT.values()))).alias("name"), (m == 38).alias("passed")))
    found = freeze.judge(freeze.evidence(c, passes, assessments, diagnostics, checks))
    return found.select("run_id", "passed", F.array_join("failed", ",").alias("failed"))


def run_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of two runs by meaning: other ids and orders of qualifiers make no difference."""
    first = _facts(spark, sf_dir, False)
    second = first.withColumn("candidate_id", F.lit("other")).withColumn("raw_value", F.when(F.col("source_id") == "SRC3", F.lit("changed")).otherwise(F.col("raw_value")))
    second = second.withColumn("qualifiers", F.map_from_entries(F.reverse(F.map_entries("qualifiers"))))
    return comparison.parity(first, second, ["source_id", "subject_text", "predicate", "raw_value", "qualifiers"])


def nested_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of an order's lines without those that begin inside an earlier one."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10).cast("long").alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).cast("long").alias("end")).distinct()
    return comparison.non_overlapping(li, "l_orderkey")


# -------------------------------------------------------------------------- agents


def _routing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases of orders, records of their lines, and ranked hits that hold the expected line for some."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    kinds = F.array(F.lit("direct_retrieval"), F.lit("insufficient_retrieval"), F.lit("no_match_fact_search"), F.lit("structured_fact_search"), F.lit("evidence_inspection"))
    category = F.element_at(kinds, (_key() % 5 + 1).cast("int"))
    searching = _key() % 5 >= 3
    wanted = _text("S:", _key(), "-1")
    fixture = F.when(searching, F.struct(_text("risk", _key() % 997).alias("fact_type"), _text("ORDER ", _key(), "!").alias("query"), _text("Order ", _key(), "!").alias("subject"), F.lit("is late").alias("statement"), F.lit(None).cast("string").alias("value"), wanted.alias("evidence_id")))
    tool = lambda *t: F.array(*map(F.lit, t))
    acceptable = F.when(searching, F.array(tool(*agents.TOOLS[1:]))).when(_key() % 5 == 2, F.array(tool(agents.TOOLS[1]))).otherwise(F.array(tool(agents.TOOLS[0])))
    expected = F.when((_key() % 5).isin(1, 2), agents.INSUFFICIENT).otherwise(F.lit(agents.ANSWERED))
    cases = o.select(_key().alias("case_id"), category.alias("category"), expected.alias("expected_status"), F.when((_key() % 5).isin(1, 2), F.array().cast("array<string>")).otherwise(F.array(wanted)).alias("expected_evidence_ids"), fixture.alias("fixture"), acceptable.alias("acceptable_tool_sequences"), F.lit("routing").alias("evaluation_group"))
    records = li.select(F.concat_ws("-", F.concat(F.lit("S:"), F.col("l_orderkey").cast("string")), F.col("l_linenumber").cast("string")).alias("evidence_id"), F.lit("S").alias("source_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("block_id"), F.col("l_returnflag").alias("text")).dropDuplicates(["evidence_id"])
    hits = li.select(F.col("l_orderkey").alias("case_id"), (F.col("l_linenumber") + F.when(F.col("l_orderkey") % 2 == 0, 5).otherwise(0)).alias("rank"), F.concat_ws("-", F.concat(F.lit("S:"), F.col("l_orderkey").cast("string")), F.col("l_linenumber").cast("string")).alias("evidence_id"))
    return cases, records, hits


def routing_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, records, _ = _routing(spark, sf_dir)
    found = agents.routing_facts(cases, records)
    return found.select("case_id", "fact_id", "subject", F.array_join("evidence_ids", ",").alias("evidence_ids"), "support_status", "found")


def agent_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scripted policies do with every case, and how it is scored."""
    cases, records, hits = _routing(spark, sf_dir)
    facts = agents.routing_facts(cases, records).where("found")
    done = agents.outcomes(cases, agents.answer_policy(cases, hits, facts), records)
    return done.select("case_id", "actual_status", F.array_join("actual_tool_sequence", ",").alias("tools"), "evidence_id", "task_success", "citation_valid", "tool_selection_acceptable", F.col("unnecessary_tool_calls").cast("long").alias("unnecessary"))


def agent_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    sequence = F.when(F.col("event_id") % 5 == 0, F.array_repeat(F.lit("retrieve_evidence"), 5)).when(F.col("event_id") % 5 == 1, F.array(F.lit("delete_evidence"))).otherwise(F.array(F.lit("search_project_facts")))
    found = agents.check_limits(e.select(F.col("event_id").alias("case_id"), sequence.alias("tool_sequence")))
    return found.groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


def attempt_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.struct("ts", "event_id").alias("at"), "event_id")
    return agents.attempts_within(e, 3).select("event_id", F.col("attempt").cast("long").alias("attempt"), "allowed")


# ----------------------------------------------------------------------- manifests


def predicate_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply of one fact for each order, checked against the closed schema of its predicate; every eighth order's is as it should be,
    the others have one or two faults."""
    o = table(spark, sf_dir, "orders")
    n, m = _key(), _key() % 8
    quoted = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    fields = {
        "candidate_id": quoted(n), "subject_text": quoted(_text("Order ", n)), "subject_type": F.when(m == 1, F.lit('"risk"')).otherwise(F.lit('"metric"')), "predicate": F.when(m == 2, F.lit('"price"')).otherwise(F.lit('"metric"')),
        "raw_value": quoted(F.floor("o_totalprice")), "value_type": F.when(m == 3, F.lit('"date"')).otherwise(F.lit('"number"')), "normalized_value": quoted(F.floor("o_totalprice")),
        "qualifiers": F.when(m == 4, F.lit('{"unit": "GBP", "population": null, "period": null, "place": "x"}')).when(m == 5, F.lit('{"metric_name": null, "unit": "GBP", "population": null, "period": null}')).otherwise(F.lit('{"metric_name": "total", "unit": "GBP", "population": null, "period": "2024"}')),
        "evidence_ids": F.lit("[]"), "confidence": F.when(m == 6, F.lit('"high"')).otherwise(F.lit("0.9")),
    }
    parts = [F.when(m == 7, F.lit(None)).otherwise(F.concat(F.lit(f'"{name}": '), c)) if name == "raw_value" else F.concat(F.lit(f'"{name}": '), c) for name, c in fields.items()]
    body = F.concat(F.lit("{"), F.concat_ws(", ", *parts, F.when(m == 7, F.lit('"note": 1'))), F.when(n % 11 == 0, F.lit("")).otherwise(F.lit("}")))
    return manifests.reply_problems(o.select(n.alias("id"), body.alias("reply")))


def invocation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as invocations of a model, a run a user, with faults of all kinds here and there."""
    e, n, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    sha = lambda c: keys.sha256_upper(c)
    request = sha(F.concat_ws("-", u.cast("string"), (n % 40).cast("string")))
    m = n % 29
    errors = F.when(m == 1, "bad_request").when(m == 2, "timeout").when(m == 3, "rate_limit").when(m == 4, "connection").when(m == 5, "api").when(m == 6, "other")
    invocations = e.select(
        u.alias("run_id"), n.alias("invocation_id"), F.col("ts").alias("sequence"), request.alias("request_sha256"), F.when(m == 7, "S9").otherwise(F.lit("S1")).alias("source_id"), (1 + n % 3 % 2).alias("attempt"), F.when(m == 8, "q").otherwise(F.lit("p")).alias("provider"),
        F.when(m == 9, "n").otherwise(F.lit("m")).alias("model"), (F.pmod(n, F.lit(7)) / 4).cast("decimal(10,2)").alias("cost"), F.when(n % 4 == 0, "cache").when(n % 4 == 1, "mock").otherwise(F.lit("live")).alias("mode"), F.when(m == 10, "a/../b").when(m == 11, "/etc").otherwise(F.lit("a/b..c")).alias("cache_path"),
        errors.alias("error"), F.when(m == 12, "incomplete").when(m == 13, "failed").when(m == 14, "queued").otherwise(F.lit("completed")).alias("status"), (m == 15).alias("refused"), F.when(m != 16, n).alias("input_tokens"), n.alias("output_tokens"), F.when(m == 17, " ").when(m == 18, F.lit(None)).otherwise(F.lit("{}")).alias("output"),
    )
    body = F.concat(F.lit("run "), u.cast("string"))
    manifests_ = e.where(u % 17 != 0).select(u).distinct().select(u.alias("run_id"), body.alias("body"), F.when(u % 13 == 0, "0").otherwise(sha(body)).alias("body_sha256"), F.lit("p").alias("provider"), F.lit("m").alias("model"), F.array(F.lit("S1")).alias("sources"), F.lit(6).alias("most_requests"), F.lit(1 + 1).alias("most_attempts"), F.lit(9).alias("most_cost"))
    kept = e.where(n % 5 < 4).select(request.alias("request_sha256"), F.when(n % 5 == 1, F.concat(F.lit("r"), (n % 2).cast("string"))).otherwise(F.lit("r")).alias("response"), F.lit("2024").alias("recorded_at"), n.alias("_n"))
    cache = kept.select("request_sha256", "response", F.when(F.col("_n") % 5 == 2, "x").otherwise(sha(F.col("response"))).alias("response_sha256"), F.when(F.col("_n") % 5 != 3, F.col("recorded_at")).alias("recorded_at"))
    return invocations_.codes(invocations, manifests_, cache)


def metadata_getters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values of the clicks' properties, which are missing, null, cut off or of other types here and there."""
    meta = F.col("meta")
    rows = table(spark, sf_dir, "clicks").select("click_id", metadata.parsed(F.col("props")).alias("meta"))
    return rows.select(
        "click_id", metadata.number(meta, "$.k").alias("k"), metadata.simple(meta, "$.device.os").alias("os"), metadata.moment(meta, "$.device.os").isNull().alias("os_is_no_moment"), F.array_join(metadata.names(meta, "$.tags"), ",").alias("tags"),
        F.array_join(metadata.names(meta, "$.device.ver"), ",").alias("versions"), metadata.number(meta, "$.tags").alias("tags_as_number"), metadata.number(meta, "$.items[0].qty").alias("first_quantity"), metadata.simple(meta, "$.nothing").alias("nothing"),
    )


def _routes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of an order as blocks; two routes an order, of which some end beyond the lines."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    blocks = li.select(F.col("l_orderkey").cast("string").alias("source_id"), F.col("l_linenumber").cast("string").alias("block_id"), F.col("l_linenumber").alias("sequence"), F.lit("page").alias("location_type"), F.col("l_linenumber").cast("string").alias("location_value"), F.when(F.col("l_linenumber") == 4, " ").otherwise(F.concat_ws(" ", F.lit("line"), "l_linenumber", "l_returnflag")).alias("text"))
    o = table(spark, sf_dir, "orders")
    routes = o.select(_key().cast("string").alias("source_id"), F.explode(F.array(F.struct(_text("R", _key(), "-1").alias("request_id"), F.lit(1).alias("start"), F.lit(1).alias("end")), F.struct(_text("R", _key(), "-2").alias("request_id"), F.lit(2).alias("start"), (_key() % 3 + 2).cast("int").alias("end")))).alias("r")).select("source_id", "r.*")
    return blocks, routes


def route_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, routes = _routes(spark, sf_dir)
    return manifests.route_blocks(blocks, routes).select("request_id", "sequence", "evidence_id")


def route_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, routes = _routes(spark, sf_dir)
    return manifests.route_problems(routes, manifests.route_blocks(blocks, routes))


def _prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    prompts = {"system": "Read.\r\nAnswer.", "extraction": "Find facts.", "configuration": "m-1", "prompt_version": "0.4", "contract": "c-1"}
    return manifests.prepare(*_routes(spark, sf_dir), prompts, "0.75")


def request_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and sizes of the canonical prompt of each request."""
    _, sizes, _ = _prepared(spark, sf_dir)
    return sizes.select("request_id", "prompt_sha256", "prompt_bytes")


def request_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every payload carries its prompt's digest, and the planned tokens follow from its bytes."""
    requests, sizes, _ = _prepared(spark, sf_dir)
    rows = sizes.join(requests.select("request_id", "payload"), "request_id")
    carried = F.get_json_object("payload", "$.prompt_sha256") == F.col("prompt_sha256")
    return rows.agg(F.count("*").alias("requests"), F.bool_and(carried).alias("carried"), F.bool_and(F.col("planned_tokens") == F.ceil(F.col("payload_bytes") / 4)).alias("planned"), F.count_distinct("request_sha256").alias("identities"))


def identity_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored digests of which some are of another content."""
    requests, _, _ = _prepared(spark, sf_dir)
    own = requests.select("request_id", "prompt_sha256", "request_sha256")
    stored = own.withColumn("request_sha256", F.when(F.col("request_id").endswith("5-1"), F.lit("0")).otherwise(F.col("request_sha256"))).where("request_id NOT LIKE '%7-2'")
    return manifests.identity_drift(stored, own).groupBy("field").agg(F.count("*").alias("n"))


def repeat_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.format_string("R%010d", "doc_id").alias("request_id"), F.octet_length("text").cast("long").alias("payload_bytes"))
    return manifests.repeat_choice(sizes)


def invocation_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    invocations = o.select(F.when(_key() % 100 == 0, "R0").otherwise(_text("R", _key())).alias("request_id"), _text("C", F.col("o_custkey")).alias("source_id"), F.when(_key() % 9 == 0, "other").otherwise(F.lit("sha")).alias("document_sha256"), (_key() % 300 * 1000).alias("payload_bytes"), (_key() + 1).alias("invocation_order"))
    routes = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(_text("C", F.col("c_custkey")).alias("source_id"), F.lit("sha").alias("document_sha256"))
    return manifests.inventory_problems(invocations, routes, 200_000).groupBy("problem").agg(F.count("*").alias("n"))


def provenance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    rows = e.select(
        F.when(k % 8 == 0, "repeat").otherwise(F.lit("primary")).alias("role"), F.when(k % 10 == 0, "failure").when(k % 11 == 0, "timeout").otherwise(F.lit("success")).alias("status"), F.when(k % 4 == 0, "hit").otherwise(F.lit("miss")).alias("cache"), (k % 3).alias("attempts"),
        (k % 5 != 0).alias("valid"), (k % 6 == 0).alias("abstained"), (k % 2).alias("review_candidates"), F.when(k % 7 != 0, k % 1000).alias("input_tokens"), (k % 50).alias("output_tokens"), F.when(k % 13 != 0, (k % 100).cast("decimal(38,9)")).alias("cost"),
    )
    return manifests.run_report(rows).withColumn("total_estimated_cost", F.col("total_estimated_cost").cast("double"))


# ------------------------------------------------------------------------ functions


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends, collapsed and trimmed forms, error messages and addresses of texts with odd white space."""
    p = table(spark, sf_dir, "part")
    words = _text("\r\n  ", F.col("p_name"), " \t\r\n\n", F.col("p_type"), "  \r\n")
    path = _text("cannot open /data/raw/", F.col("p_partkey"), ".pdf\nnow")
    return p.select(
        "p_partkey", text.normalise_lines(words).alias("lines"), text.collapse(words).alias("collapsed"), text.strip(words).alias("stripped"), text.safe_message(path).alias("message"),
        F.array_join(text.message_ids(_text("<a@", F.col("p_partkey"), ">\n <b@x>")), ",").alias("ids"), F.array_join(text.message_ids(_text("a", F.col("p_partkey"), "  b")), ",").alias("bare_ids"),
    )


def collapsed_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each character of a collapsed text stands in the original."""
    p = table(spark, sf_dir, "part")
    found = text.collapsed_offsets(_text("  ", F.col("p_brand"), " \n\t ", F.col("p_type")))
    return p.select("p_partkey", found["text"].alias("collapsed"), F.array_join(found["offsets"], ",").alias("offsets"))


def date_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    words = F.when(_key() % 4 == 0, "2023-02-29").when(_key() % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(_key() % 4 == 2, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.lit("2024-13-01"))
    return o.select("o_orderkey", F.coalesce(numbers.iso_date(words), F.lit(False)).alias("valid"))


def stable_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, self-hashes, LF hashes and qualifier keys."""
    o = table(spark, sf_dir, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.select(
        "o_orderkey", keys.stable_id("X-", status, priority).alias("id"), keys.fields_digest(status.alias("a"), priority.alias("b")).alias("self_hash"), keys.lf_hash(_text(status, "\r\n", priority, "\r")).alias("lf"),
        keys.qualifier_key(F.create_map(F.lit("z"), status, F.lit("a"), priority)).alias("qualifiers"),
    )


def hash_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    own = keys.fields_digest(F.col("o_orderstatus"))
    rows = o.withColumn("stored", F.when(_key() % 6 == 0, F.lit("X")).otherwise(own))
    return validation.hash_violations(rows, "o_orderkey", "stored", own).select("o_orderkey")


def block_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of blocks, documents and facts."""
    o = table(spark, sf_dir, "orders")
    blocks = o.select(_key().cast("string").alias("block_id"), F.when(_key() % 5 == 0, "poem").otherwise(F.lit("page_text")).alias("block_type"), F.when(_key() % 7 == 0, " ").otherwise(F.lit("x")).alias("text"), F.array().cast("array<string>").alias("warnings"), F.lit("page").alias("location_type"), F.when(_key() % 9 == 0, "0").otherwise(F.lit("1")).alias("location_value"))
    documents = o.select(_key().cast("string").alias("document_id"), F.when(_key() % 2 == 0, "success").otherwise(F.lit("success_with_warnings")).alias("parse_status"), F.when(_key() % 3 == 0, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>")).alias("warnings"), F.when(_key() % 4 == 0, "DOC").otherwise(F.lit("PDF")).alias("source_format"), F.when(_key() % 6 == 0, "ab").otherwise(keys.sha256_upper(_key().cast("string"))).alias("checksum_sha256"))
    facts = o.select(_key().cast("string").alias("candidate_id"), F.when(_key() % 5 == 0, 1.5).when(_key() % 5 == 1, 0.5).otherwise(F.lit(0.9)).alias("confidence"), F.lit("not_required").alias("review_status"), F.when(_key() % 8 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("e"))).alias("evidence_ids"))
    every = validation.block_violations(blocks).select("violation").unionByName(validation.document_violations(documents).select("violation")).unionByName(validation.fact_violations(facts).select("violation"))
    return every.groupBy("violation").agg(F.count("*").alias("n"))


def dangling_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    facts = o.select(_key().alias("candidate_id"), F.lit("S").alias("source_id"), F.array(_text(_key(), "-1"), _text(_key(), "-9")).alias("evidence_ids"))
    evidence = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("evidence_id"), F.lit("S").alias("source_id")).distinct()
    return validation.dangling_evidence(facts, evidence)


def canonical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values as keys: equal decimals, currencies and dates give equal keys."""
    o = table(spark, sf_dir, "orders")
    kind = F.element_at(F.array(F.lit("money"), F.lit("percentage"), F.lit("date"), F.lit("string")), (_key() % 4 + 1).cast("int"))
    number = F.floor("o_totalprice").cast("decimal(38,9)") / 10
    return o.select("o_orderkey", keys.value_key(kind, F.col("o_orderpriority"), number.cast("decimal(38,9)"), F.lit("gbp")).alias("value_key"))


def structural_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested values in comparison form."""
    o = table(spark, sf_dir, "orders")
    words = _text('{"z": ["  ', F.col("o_orderpriority"), '.", 1, null], "a": {"d": true, "c": "', F.col("o_orderstatus"), '  X"}}')
    return o.select("o_orderkey", text.structural(words).alias("plain"))


def cache_record_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache records written and read back, some of them changed on the way."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(_text("R", _key()).alias("request_sha256"), F.lit("m-1").alias("configuration"), F.col("o_orderpriority").alias("response"), F.lit(1).alias("attempts"), F.lit("0.5").cast("decimal(38,9)").alias("cost"), F.lit("2026-01-01T00:00:00Z").alias("at"))
    records = manifests.cache_records(rows)
    n = F.get_json_object("record", "$.request_sha256").substr(2, 20).cast("long") % 5
    changed = F.when(n == 1, F.concat("record", F.lit(" "))).when(n == 3, F.replace("record", F.get_json_object("record", "$.response"), F.lit("other"))).otherwise(F.col("record"))
    records = records.withColumn("_new", changed).withColumns({"name": F.when(n == 2, F.lit("../x")).otherwise(F.col("name")), "record_sha256": F.when(n == 4, F.lit("0")).otherwise(keys.sha256_upper(F.col("_new")))})
    found = manifests.read_cache_records(records.withColumn("record", F.col("_new")).drop("_new"))
    return found.groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


def _run_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring_index(F.col("candidate_id"), "-", -1).cast("long")
    return _facts(spark, sf_dir, False).withColumns({"review_status": F.when(n % 6 == 0, "required").otherwise(F.lit("not_required")), "evidence_status": F.when(n % 9 == 0, "ambiguous").otherwise(F.lit("supported"))})


def rule_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    predicate = F.element_at(F.array(F.lit("commitment"), F.lit("budget"), F.lit("risk"), F.lit("poem")), (_key() % 4 + 1).cast("int"))
    rule = evaluation.rule_of(predicate, F.when(_key() % 8 == 0, 0.9).otherwise(F.lit(0.7)))
    return o.select(F.coalesce(rule, F.lit("none")).alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n"))


def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, gold = _run_facts(spark, sf_dir), _facts(spark, sf_dir, True)
    repeats = matching.reproducibility(candidates.select("source_id", F.lit("a").alias("d")).distinct(), candidates.where("source_id <> 'SRC2'").select("source_id", F.lit("a").alias("d")).distinct(), "source_id", "d")
    found = evaluation.complete(evaluation.report(candidates, gold, matching.strict_matches(candidates, gold)), repeats)
    return found.select(*[F.round(c, 6).alias(c) if c in ("precision", "recall", "f1") else c for c in found.columns])


def reproduction_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second pass without one order, against fixed numbers of which none can hold."""
    first, gold = _run_facts(spark, sf_dir), _facts(spark, sf_dir, True)
    second = first.where("candidate_id <> 'K-0000000001'")
    found = evaluation.reproduction(first, second, gold, {"candidates": -1}, ["source_id", "subject_text", "predicate", "raw_value"])
    return found.select("measure", "first", "second", "expected", "passed")


def predicate_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, gold = _run_facts(spark, sf_dir), _facts(spark, sf_dir, True)
    found = evaluation.rates(matching.predicate_counts(candidates, gold, matching.strict_matches(candidates, gold)), "predicate")
    return found.select("predicate", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def target_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = table(spark, sf_dir, "orders").agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("share"), F.lit(None).cast("double").alias("nothing"))
    return evaluation.quality_targets(report, {"some": ("share", 0.0), "all": ("share", 1.0), "missing": ("nothing", 0.5)}).withColumn("value", F.round("value", 6))


QUERIES = {
    f.__name__: f
    for f in (
        output_validation, output_hydration, hydration_codes, fact_ordinals, gold_problems, gold_case_problems, gold_report, gold_distribution, gold_counts, gold_inventory, gold_leaks, challenge_outcomes, review_packet,
        nearest_in_block, pair_scores, nearest_candidates, failure_categories, evidence_checks, candidate_trace, transformation_flags, trace_counters, attempt_inventory, case_references, manifest_reconciliation,
        metric_fractions, process_gates, freeze_gates, run_parity, nested_spans, routing_facts, agent_policy, agent_limits, attempt_limits, predicate_schema, invocation_codes, metadata_getters, route_blocks, route_problems, request_identities, request_measures,
        identity_drift, repeat_choice, invocation_inventory, provenance_report, text_forms, collapsed_offsets, date_checks, stable_identities, hash_check, block_check, dangling_evidence, canonical_values,
        structural_values, cache_record_check, rule_attribution, evaluation_report, reproduction_bundle, predicate_rates, target_check,
    )
}


def _case(expression: str, values: list[str | None], other: str) -> str:
    return f"CASE {expression} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v) + f" ELSE '{other}' END"


_SOFT = [f if i not in (8, 9, 10) else None for i, f in enumerate(FAULTS)]
_GOLD = """
    WITH g AS (SELECT o.o_orderkey AS n, o.o_custkey AS c, k.c_custkey IS NOT NULL AS listed, k.c_mktsegment AS family FROM orders o LEFT JOIN customer k ON k.c_custkey = o.o_custkey)"""
_LINKED = """
    WITH f AS (SELECT o_orderkey AS m, 'K' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS id FROM orders WHERE o_orderkey % 5 <> 0),
    c AS (SELECT o_orderkey AS n FROM orders WHERE o_orderkey % 2 = 0),
    l AS (SELECT n, m, id FROM c JOIN f ON m = n UNION ALL SELECT n, m, id FROM c JOIN f ON m = n - 1)"""
_NEAR = """
    WITH c AS (SELECT p_partkey AS n, p_brand AS b, p_size AS z, p_partkey % 211 AS r, p_partkey % 2 = 0 AS s, p_partkey % 3 <> 0 AS t, p_partkey % 5 <> 0 AS q FROM part),
    j AS (SELECT a.n AS a, c.n AS k, c.s, c.t, c.q, CAST(c.s AS INT) + CAST(c.t AS INT) + CAST(c.q AS INT) AS ok FROM c a JOIN c ON a.b = c.b AND a.z = c.z AND a.r = c.r),
    o AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY 3 - ok, k) AS rank, max(ok) OVER (PARTITION BY a) AS best, CASE WHEN ok = 3 THEN 'match' WHEN NOT s THEN 'subject_mismatch' ELSE 'qualifier_mismatch' END AS category FROM j)"""
_NEAREST = """
    WITH c AS (SELECT p_partkey AS n, coalesce(p_brand, '') AS b, p_size AS z, p_partkey % 2 = 0 AS s, p_partkey % 3 <> 0 AS t, p_partkey % 5 <> 0 AS q FROM part),
    j AS (SELECT a.n AS a, c.n AS k, c.s, c.t, c.q, a.z IS NOT DISTINCT FROM c.z AS v FROM c a JOIN c ON a.b = c.b),
    m AS (SELECT *, 4 - CAST(s AS INT) - CAST(t AS INT) - CAST(q AS INT) - CAST(v AS INT) AS mismatches FROM j),
    o AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY mismatches, k) AS rank FROM m)"""
_FLAGS = """
    WITH f AS (SELECT o_orderkey AS n, list_filter([CASE WHEN o_orderkey % 2 <> 0 THEN 'actor_resolved' END, CASE WHEN o_orderkey % 3 <> 0 THEN 'subject_type_changed' END,
        CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'raw_value_extended' ELSE 'raw_value_changed' END, CASE WHEN o_orderkey % 5 <> 0 THEN 'normalized_value_changed' END,
        CASE WHEN o_orderkey % 6 = 0 THEN 'structural_wrapper_removed' END, CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 5 <> 0 THEN 'possessive_preserved' END,
        CASE WHEN o_orderkey % 7 = 0 THEN 'semantic_modifier_preserved:now' END, CASE WHEN o_orderkey % 7 = 0 THEN 'semantic_modifier_preserved:also' END], lambda x: x IS NOT NULL) AS flags FROM orders)"""
_ROUTES = """
    WITH b AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS s FROM lineitem),
    r AS (SELECT o_orderkey AS k, 'R' || o_orderkey || '-1' AS id, 1 AS lo, 1 AS hi FROM orders UNION ALL SELECT o_orderkey, 'R' || o_orderkey || '-2', 2, o_orderkey % 3 + 2 FROM orders),
    w AS (SELECT id, r.k, s, lo, hi FROM r JOIN b ON b.k = r.k AND s BETWEEN lo AND hi)"""
_POLICY = """
    WITH l AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linenumber = 1),
    c AS (SELECT o_orderkey AS k, o_orderkey % 5 AS m, l.k IS NOT NULL AS there FROM orders o LEFT JOIN l ON l.k = o_orderkey),
    d AS (SELECT *, there AND (m >= 3 OR m = 0 AND k % 2 = 1) AS answered FROM c)"""


ORACLES = {
    "output_validation": f"SELECT o_orderkey AS request_id, {_case('o_orderkey % 16', FAULTS, 'accepted')} AS code, CASE WHEN o_orderkey % 16 = 0 THEN 1 ELSE 0 END AS facts, o_orderkey % 16 = 0 AS digest FROM orders",
    "output_hydration": """
        SELECT o_orderkey AS request_id, 'E' || o_orderkey || '-2' AS evidence_id, 'S' || (o_custkey % 7) AS source_id, 'B2' AS block_id, '2' AS location_value,
               regexp_replace(substr('Order ' || o_orderkey || ' ' || repeat(o_orderpriority, 30), 1, 240), '\\s+$', '') AS text_excerpt, 'llm' AS method
        FROM orders WHERE o_orderkey % 16 IN (0, 8, 9, 10)""",
    "hydration_codes": f"SELECT {_case('o_orderkey % 16', _SOFT, 'accepted')} AS code, count(*) AS n FROM orders GROUP BY 1",
    "fact_ordinals": "SELECT o_orderkey AS document, 1 AS ordinal, o_orderstatus AS fact FROM orders UNION ALL SELECT o_orderkey, 2, o_orderpriority FROM orders",
    "gold_problems": _GOLD + """,
        p AS (SELECT unnest([CASE WHEN NOT listed THEN 1 END, CASE WHEN listed AND CASE WHEN n % 7 = 0 THEN 'OTHER' ELSE 'AUTOMOBILE' END <> family THEN 3 END, CASE WHEN listed AND c % 10 = 0 THEN 4 END, CASE WHEN n % 4 >= 2 THEN 5 END,
            CASE WHEN n % 8 = 0 OR n % 4 = 1 AND n % 5 = 0 THEN 7 END, CASE WHEN n % 13 = 0 THEN 8 END, CASE WHEN n % 13 <> 0 AND n % 17 = 0 THEN 9 END, CASE WHEN n % 13 <> 0 AND n % 19 = 0 THEN 11 END, CASE WHEN n % 13 <> 0 AND n % 23 = 0 THEN 12 END]) AS ordinal FROM g)
        SELECT CAST(ordinal AS BIGINT) AS ordinal, """ + _case("ordinal", [None, *goldset.PROBLEMS], "") + " AS problem, count(*) AS n FROM p WHERE ordinal IS NOT NULL GROUP BY 1, 2",
    "gold_case_problems": _GOLD + """,
        s AS (SELECT * FROM g WHERE n % 6 = 0), e AS (SELECT n, c, unnest([n, n + 1]) AS b FROM s),
        p AS (SELECT 'source is absent from the split' AS problem FROM s WHERE NOT listed UNION ALL SELECT 'split does not match' FROM s WHERE listed AND c % 3 = 0 UNION ALL SELECT 'source is not a PDF' FROM s WHERE listed AND c % 10 = 0
              UNION ALL SELECT CASE WHEN o_orderkey IS NULL THEN 'evidence block does not exist' ELSE 'evidence block or page mismatch' END FROM e LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 13 <> 0) ON o_orderkey = b AND o_custkey = c
              WHERE o_orderkey IS NULL OR o_orderkey % 17 = 0 OR o_orderkey % 19 = 0)
        SELECT problem, count(*) AS n FROM p GROUP BY 1""",
    "gold_report": """
        SELECT count(*) AS fact_count, count(*) FILTER (WHERE o_custkey % 3 <> 0) AS development_fact_count, count(*) FILTER (WHERE o_custkey % 3 = 0) AS held_out_fact_count,
               count(*) FILTER (WHERE o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0) AS draft_ai_assisted_count, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS owner_verified_count, count(*) FILTER (WHERE o_orderkey % 2 <> 0 AND o_orderkey % 3 = 0) AS rejected_count,
               count(*) FILTER (WHERE o_orderkey % 6 = 0) AS challenge_case_count, 0 AS draft_ai_assisted_case_count, count(*) FILTER (WHERE o_orderkey % 6 = 0) AS owner_verified_case_count, 0 AS rejected_case_count,
               CASE WHEN count(*) FILTER (WHERE o_orderkey % 60 = 0) > 1 THEN 1 ELSE 0 END AS duplicate_ids FROM orders""",
    "gold_distribution": """
        WITH f AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'target_date' WHEN 1 THEN 'budget' ELSE 'recommendation' END AS predicate, count(*) AS found FROM orders GROUP BY 1),
        e AS (SELECT * FROM (VALUES ('target_date', 1), ('budget', 2), ('owner', 3)) t(predicate, expected))
        SELECT predicate, coalesce(expected, 0) AS expected, coalesce(found, 0) AS found FROM f FULL JOIN e USING (predicate) WHERE coalesce(expected, 0) <> coalesce(found, 0)""",
    "gold_counts": "SELECT '{\"budget\":' || count(*) FILTER (WHERE o_orderkey % 4 = 1) || ',\"recommendation\":' || count(*) FILTER (WHERE o_orderkey % 4 > 1) || ',\"target_date\":' || count(*) FILTER (WHERE o_orderkey % 4 = 0) || '}' AS counts FROM orders",
    "gold_inventory": """
        WITH i AS (SELECT CAST(o_custkey % 10 AS VARCHAR) AS source_id, CASE WHEN o_orderkey % 3 = 0 THEN 'held_out' ELSE 'development' END AS split, count(*) AS n FROM orders GROUP BY 1, 2)
        SELECT 'found' AS side, split, source_id, n FROM i WHERE source_id IN ('4', '7') UNION ALL SELECT 'manifest', split, source_id, n + 1 FROM i WHERE source_id = '4'""",
    "gold_leaks": """
        WITH d AS (SELECT r_name AS document, 'See G' || r_regionkey * 3 || ', and: Order ' || (r_regionkey * 3 + 1) || ' has a long value that nobody should know ahead!' AS text FROM region),
        g AS (SELECT 'G' || o_orderkey AS id, 'Order ' || o_orderkey || ' has a long value that nobody should know ahead' AS v FROM orders WHERE o_custkey % 3 = 0)
        SELECT id AS annotation_id, document, 'annotation_id' AS what FROM g JOIN d ON contains(text, id) UNION ALL SELECT id, document, 'raw_value' FROM g JOIN d ON contains(text, v)""",
    "challenge_outcomes": _LINKED + """,
        r AS (SELECT n, id FROM l WHERE CASE n % 3 WHEN 0 THEN m % 3 <> 0 AND m % 4 <> 0 WHEN 1 THEN true ELSE m % 18 = 0 END),
        s AS (SELECT c.n, count(id) AS k, coalesce(string_agg(id, ',' ORDER BY id), '') AS related FROM c LEFT JOIN r ON r.n = c.n GROUP BY 1)
        SELECT 'CASE-' || n AS case_id, CASE n % 3 WHEN 0 THEN 'preserve_missing' WHEN 1 THEN 'do_not_extract' ELSE 'route_to_review' END AS expected_behavior, CASE WHEN (k > 0) <> (n % 3 = 1) THEN 'passed' ELSE 'failed' END AS outcome, related FROM s""",
    "review_packet": _LINKED + " SELECT 'CASE-' || c.n AS case_id, coalesce(string_agg(id || '|Order ' || m, ';' ORDER BY id), '') AS candidates FROM c LEFT JOIN l ON l.n = c.n GROUP BY 1",
    "nearest_in_block": """
        SELECT 'A-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS annotation_id, CASE WHEN o_orderkey % 11 <> 0 THEN 'K-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') END AS closest_candidate_id,
               CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 5 = 0 THEN 'value' ELSE '' END AS mismatch_fields FROM orders WHERE o_orderkey % 7 <> 0""",
    "pair_scores": _NEAR + """
        SELECT 'A' || lpad(CAST(a AS VARCHAR), 8, '0') AS annotation_id, 'K' || lpad(CAST(k AS VARCHAR), 8, '0') AS candidate_id, CAST(ok + 2 AS BIGINT) AS score,
               array_to_string(list_filter(['no_strict_match', CASE WHEN NOT q THEN 'qualifier_mismatch' END, CASE WHEN NOT s THEN 'subject_text_mismatch' END, CASE WHEN NOT t THEN 'subject_type_mismatch' END], lambda x: x IS NOT NULL), ',') AS reasons
        FROM o WHERE ok = best""",
    "nearest_candidates": _NEAREST + """
        SELECT 'A' || lpad(CAST(a AS VARCHAR), 8, '0') AS annotation_id, rank, 'K' || lpad(CAST(k AS VARCHAR), 8, '0') AS candidate_id, CAST(mismatches AS BIGINT) AS mismatches,
               CASE WHEN mismatches = 0 THEN 'match' WHEN NOT s AND NOT v THEN 'different_fact' WHEN NOT s THEN 'subject_mismatch' WHEN NOT v THEN 'value_mismatch' ELSE 'qualifier_mismatch' END AS category
        FROM o WHERE rank <= 3""",
    "failure_categories": _NEAR + " SELECT category, count(*) AS n FROM o WHERE rank = 1 GROUP BY 1",
    "evidence_checks": "SELECT 'K' || o_orderkey AS candidate_id, 'A' || o_orderkey AS annotation_id, o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0 AS evidence_source_match, o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0 AS evidence_location_match, o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AS evidence_excerpt_exact_match FROM orders",
    "candidate_trace": """
        SELECT 'K-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS candidate_id, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN 'A-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') END AS strict_match_annotation_id
        FROM orders WHERE o_orderkey % 11 <> 0""",
    "transformation_flags": _FLAGS + " SELECT n AS o_orderkey, array_to_string(flags, ',') AS flags FROM f",
    "trace_counters": _FLAGS + """
        SELECT 'flags' AS counter, name, count(*) AS n FROM (SELECT unnest(flags) AS name FROM f) GROUP BY 1, 2
        UNION ALL SELECT 'operation', CASE WHEN o_orderkey % 6 = 0 THEN 'safe_recommendation_wrapper_collapsed' ELSE 'capitalisation_only' END, count(*) FROM orders GROUP BY 1, 2""",
    "attempt_inventory": "SELECT o_orderkey AS id, 'missing' AS problem FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey, 'repeated' FROM orders WHERE o_orderkey % 6 = 1 UNION ALL SELECT -o_orderkey, 'unexpected' FROM orders WHERE o_orderkey % 50 = 2",
    "case_references": "SELECT 'CASE-' || o_orderkey AS case_id, 'unknown_candidate' AS problem, 'K' || o_orderkey AS name FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'CASE-' || o_orderkey, 'warning_not_observed', o_orderpriority FROM orders WHERE o_orderpriority = '5-LOW'",
    "manifest_reconciliation": """
        WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
        SELECT o_custkey, '(row)' AS field, CAST(NULL AS VARCHAR) AS stored, 'true' AS computed FROM s WHERE o_custkey % 10 = 3 UNION ALL SELECT o_custkey, 'n', CAST(n + 1 AS VARCHAR), CAST(n AS VARCHAR) FROM s WHERE o_custkey % 10 = 4""",
    "metric_fractions": """
        SELECT 'finished' AS metric, count(*) FILTER (WHERE o_orderstatus = 'F') AS numerator, count(*) AS denominator, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS value FROM orders
        UNION ALL SELECT 'none_of_none', 0, 0, CAST(NULL AS DOUBLE)""",
    "process_gates": "SELECT 4 AS gates, false AS passed, concat_ws(',', CASE WHEN min(o_totalprice) >= 0 THEN 'negative_price' END, CASE WHEN count(DISTINCT o_orderstatus) <> 3 THEN 'three_kinds' END, 'no_rows') AS failing FROM orders",
    "freeze_gates": """
        WITH c AS (SELECT c_custkey AS run_id, c_custkey % 41 AS m, ['required_commit_ancestry_valid', 'repository_clean_before_finalization', 'exact_development_source_inventory', 'exact_development_challenge_inventory', 'protected_v0_4_hashes_valid',
                   'owner_preparation_hashes_valid', 'completed_owner_assessment_hash_valid', 'owner_validation_report_hash_valid', 'independent_review_record_valid', 'parsed_document_hashes_valid', 'candidate_output_hashes_match_preparation', 'candidate_counts_reconciled',
                   'strict_matches_reconciled', 'exact_metrics_reconciled', 'owner_and_machine_provenance_separate', 'no_post_v0_4_semantic_change', 'sparse_gold_limitation_preserved', 'output_transaction_complete', 'artifact_identities_agree'] AS checks FROM customer),
        f AS (SELECT run_id, CASE WHEN m < 19 THEN checks[m + 1] WHEN m = 30 THEN 'all_sources_complete_both_passes' WHEN m = 31 THEN 'candidate_schema_valid' WHEN m = 32 THEN 'zero_unhandled_extraction_exceptions' WHEN m IN (33, 34) THEN 'repeat_outputs_byte_identical'
              WHEN m IN (35, 36) THEN 'owner_assessments_complete' WHEN m = 37 THEN 'automated_challenge_diagnostics_reconciled' WHEN m = 38 THEN 'source_independent_rules,held_out_semantics_not_loaded,held_out_execution_not_authorized'
              WHEN m = 39 THEN array_to_string(checks, ',') ELSE '' END AS failed FROM c)
        SELECT run_id, failed = '' AS passed, failed FROM f""",
    "run_parity": "SELECT 2 * count(*) AS facts, count(*) FILTER (WHERE o_custkey % 5 = 3) AS only_first, count(*) FILTER (WHERE o_custkey % 5 = 3) AS only_second FROM orders WHERE o_orderkey % 11 <> 0",
    "nested_spans": """
        WITH s AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber * 10 AS BIGINT) AS start, CAST(floor(l_linenumber * 10 + l_quantity) AS BIGINT) AS "end" FROM lineitem),
        r AS (SELECT *, coalesce(max("end") OVER (PARTITION BY l_orderkey ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS reach FROM s)
        SELECT l_orderkey, start, "end" FROM r WHERE start >= reach""",
    "routing_facts": _POLICY + " SELECT k AS case_id, 'FACT-' || k AS fact_id, 'Order ' || k || '!' AS subject, 'S:' || k || '-1' AS evidence_ids, CASE WHEN there THEN 'supported' END AS support_status, there AS found FROM c WHERE m >= 3",
    "agent_policy": _POLICY + """
        SELECT k AS case_id, CASE WHEN answered THEN 'answered' ELSE 'insufficient_evidence' END AS actual_status,
               CASE WHEN m < 2 THEN 'retrieve_evidence' WHEN m = 2 OR NOT there THEN 'search_project_facts' ELSE 'search_project_facts,read_evidence_block' END AS tools, CASE WHEN answered THEN 'S:' || k || '-1' END AS evidence_id,
               answered = (m NOT IN (1, 2)) AS task_success, CASE WHEN answered THEN true END AS citation_valid, m < 3 OR there AS tool_selection_acceptable, CAST(0 AS BIGINT) AS unnecessary FROM d""",
    "agent_limits": "SELECT CASE event_id % 5 WHEN 0 THEN 'tool_limit' WHEN 1 THEN 'unknown_tool' ELSE 'none' END AS problem, count(*) AS n FROM events GROUP BY 1",
    "attempt_limits": "WITH a AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events) SELECT event_id, attempt, attempt <= 3 AS allowed FROM a",
    "predicate_schema": """
        WITH o AS (SELECT o_orderkey AS id, o_orderkey % 8 AS m, o_orderkey % 11 = 0 AS cut FROM orders),
        p AS (SELECT id, unnest(CASE WHEN cut THEN ['no_object'] WHEN m = 1 THEN ['enum:subject_type'] WHEN m = 2 THEN ['unknown_predicate'] WHEN m = 3 THEN ['enum:value_type']
            WHEN m = 4 THEN ['missing:qualifiers.metric_name', 'unknown:qualifiers.place'] WHEN m = 5 THEN ['type:qualifiers.metric_name'] WHEN m = 6 THEN ['type:confidence']
            WHEN m = 7 THEN ['missing:raw_value', 'unknown:note'] ELSE [] END) AS problem FROM o)
        SELECT id, problem FROM p""",
    "invocation_codes": """
        WITH e AS (SELECT event_id AS n, user_id AS u, ts, event_id % 29 AS m, upper(sha256(user_id || '-' || event_id % 40)) AS request, 1 + event_id % 3 % 2 AS attempt,
                   CASE event_id % 4 WHEN 0 THEN 'cache' WHEN 1 THEN 'mock' ELSE 'live' END AS mode, CAST(event_id % 7 / 4.0 AS DECIMAL(10, 2)) AS cost FROM events),
        r AS (SELECT *, CASE m WHEN 1 THEN 'bad_request' WHEN 2 THEN 'timeout' WHEN 3 THEN 'rate_limit' WHEN 4 THEN 'connection' WHEN 5 THEN 'api' WHEN 6 THEN 'other' END AS error,
                   row_number() OVER (PARTITION BY u, request ORDER BY ts, n) AS nth, row_number() OVER (PARTITION BY u, request, attempt ORDER BY ts, n) AS again FROM e),
        f AS (SELECT u, request, attempt + 1 AS attempt, coalesce(error, 'none') AS before FROM r WHERE again = 1),
        s AS (SELECT r.*, f.before, sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END) OVER w AS requests, sum(cost) OVER w AS spent FROM r LEFT JOIN f ON f.u = r.u AND f.request = r.request AND f.attempt = r.attempt
              WINDOW w AS (PARTITION BY r.u ORDER BY r.ts, r.n ROWS UNBOUNDED PRECEDING)),
        k AS (SELECT upper(sha256(user_id || '-' || event_id % 40)) AS request, CASE WHEN event_id % 5 = 1 THEN 'r' || event_id % 2 ELSE 'r' END AS response, event_id % 5 AS x FROM events WHERE event_id % 5 < 4),
        c AS (SELECT request, count(DISTINCT response) AS responses, bool_and(x <> 3) AS complete, bool_and(x <> 2) AS intact FROM k GROUP BY request)
        SELECT s.u AS run_id, s.n AS invocation_id, CASE
            WHEN u % 17 = 0 THEN 'invalid_manifest' WHEN u % 13 = 0 THEN 'manifest_hash_mismatch' WHEN m = 8 THEN 'provider_configuration_mismatch' WHEN m = 9 THEN 'model_configuration_mismatch' WHEN m = 7 THEN 'prohibited_source'
            WHEN again > 1 THEN 'duplicate_invocation' WHEN attempt > 1 AND coalesce(before, 'none') NOT IN ('timeout', 'rate_limit', 'connection') THEN 'retry_not_permitted'
            WHEN requests > 6 THEN 'request_budget_exceeded' WHEN spent > 9 THEN 'cost_budget_exceeded'
            WHEN mode = 'cache' THEN CASE WHEN m IN (10, 11) THEN 'cache_path_escape' WHEN responses IS NULL THEN 'cache_miss' WHEN responses > 1 THEN 'cache_conflict' WHEN NOT complete THEN 'cache_record_invalid' WHEN NOT intact THEN 'cache_hash_mismatch' END
            WHEN mode = 'mock' AND m = 18 THEN 'mock_response_not_found'
            ELSE CASE m WHEN 1 THEN 'invalid_provider_request' WHEN 2 THEN 'timeout' WHEN 3 THEN 'rate_limit' WHEN 4 THEN 'transport_error' WHEN 5 THEN 'provider_api_failure' WHEN 6 THEN 'execution_failed' WHEN 12 THEN 'incomplete_response'
                 WHEN 13 THEN 'failed_response' WHEN 14 THEN 'response_not_completed' WHEN 15 THEN 'provider_refusal' WHEN 16 THEN 'missing_provider_metadata' WHEN 17 THEN 'missing_output_text' WHEN 18 THEN 'missing_output_text' END END AS code
        FROM s LEFT JOIN c USING (request)""",
    "metadata_getters": """
        WITH c AS (SELECT click_id, CASE WHEN json_valid(props) THEN props END AS p FROM clicks)
        SELECT click_id, CAST(coalesce(TRY_CAST(json_extract_string(p, '$.k') AS BIGINT), 0) AS BIGINT) AS k, json_extract_string(p, '$.device.os') AS os, true AS os_is_no_moment,
               coalesce(array_to_string(CAST(CASE WHEN json_type(p, '$.tags') = 'ARRAY' THEN json_extract(p, '$.tags') ELSE '[]' END AS VARCHAR[]), ','), '') AS tags,
               coalesce(json_extract_string(p, '$.device.ver'), '') AS versions, 0 AS tags_as_number, CAST(coalesce(TRY_CAST(json_extract_string(p, '$.items[0].qty') AS BIGINT), 0) AS BIGINT) AS first_quantity,
               CAST(NULL AS VARCHAR) AS nothing FROM c""",
    "route_blocks": _ROUTES + " SELECT id AS request_id, s AS sequence, 'llm-evidence-v0.4-' || k || '-' || s AS evidence_id FROM w",
    "route_problems": _ROUTES + """,
        p AS (SELECT r.id, count(w.s) <> r.hi - r.lo + 1 AS incomplete, count(*) FILTER (WHERE w.s = 4) > 0 AS blank FROM r LEFT JOIN w ON w.id = r.id GROUP BY r.id, r.lo, r.hi)
        SELECT id AS request_id, 'incomplete_blocks' AS problem FROM p WHERE incomplete UNION ALL SELECT id, 'blank_block' FROM p WHERE blank""",
    "request_identities": _ROUTES + """,
        f AS (SELECT l_orderkey AS k, l_linenumber AS s, CASE WHEN l_linenumber = 4 THEN ' ' ELSE 'line ' || l_linenumber || ' ' || min(l_returnflag) END AS t FROM lineitem GROUP BY 1, 2),
        p AS (SELECT id, '{"extraction_prompt":"Find facts.","extraction_prompt_sha256":"' || upper(sha256('Find facts.')) || '","model_configuration_id":"m-1","ordered_evidence_blocks":[' ||
              string_agg('{"block_id":"' || w.s || '","evidence_id":"llm-evidence-v0.4-' || w.k || '-' || w.s || '","location":{"location_type":"page","location_value":"' || w.s || '"},"sequence":' || w.s || ',"source_id":"' || w.k || '","text":"' || t || '"}', ',' ORDER BY w.s) ||
              '],"output_contract_id":"c-1","prompt_version":"0.4","system_prompt":"Read.\\nAnswer.","system_prompt_sha256":"' || upper(sha256('Read.' || chr(10) || 'Answer.')) || '"}' AS prompt FROM w JOIN f ON f.k = w.k AND f.s = w.s GROUP BY 1)
        SELECT id AS request_id, upper(sha256(prompt)) AS prompt_sha256, strlen(prompt) AS prompt_bytes FROM p""",
    "request_measures": _ROUTES + " SELECT count(DISTINCT id) AS requests, true AS carried, true AS planned, count(DISTINCT id) AS identities FROM w",
    "identity_drift": _ROUTES + " SELECT CASE WHEN id LIKE '%5-1' THEN 'request_sha256' ELSE '(row)' END AS field, count(DISTINCT id) AS n FROM w WHERE id LIKE '%5-1' OR id LIKE '%7-2' GROUP BY 1",
    "repeat_choice": """
        WITH r AS (SELECT source AS source_id, 'R' || lpad(CAST(doc_id AS VARCHAR), 10, '0') AS request_id, strlen(text) AS payload_bytes, row_number() OVER (PARTITION BY source ORDER BY strlen(text) DESC, doc_id) AS place FROM documents)
        SELECT source_id, request_id, payload_bytes FROM r WHERE place = 1""",
    "invocation_inventory": """
        WITH i AS (SELECT o_orderkey AS k, c_custkey IS NOT NULL AS known FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 4 <> 0),
        p AS (SELECT unnest([CASE WHEN NOT known THEN 'no_route' END, CASE WHEN known AND k % 9 = 0 THEN 'other_document' END, CASE WHEN k % 300 > 200 THEN 'payload_too_large' END]) AS problem FROM i
              UNION ALL SELECT 'repeated_request' FROM i WHERE k % 100 = 0 HAVING count(*) > 1 UNION ALL SELECT 'order_not_1_to_n' FROM i HAVING count(DISTINCT k) < count(*) OR min(k) <> 0 OR max(k) <> count(*) - 1)
        SELECT problem, count(*) AS n FROM p WHERE problem IS NOT NULL GROUP BY 1""",
    "provenance_report": """
        SELECT count(*) AS invocation_total, count(*) FILTER (WHERE k % 8 <> 0) AS primary_invocation_count, count(*) FILTER (WHERE k % 8 = 0) AS repeat_invocation_count, count(*) FILTER (WHERE k % 4 = 0) AS cache_hit_count,
               count(*) FILTER (WHERE k % 4 <> 0) AS cache_miss_count, CAST(sum(k % 3) AS BIGINT) AS provider_call_count, CAST(sum(k % 3) AS BIGINT) AS attempt_count, count(*) FILTER (WHERE k % 10 <> 0 AND k % 11 <> 0) AS successful_terminal_response_count,
               count(*) FILTER (WHERE k % 10 = 0) AS provider_failure_count, count(*) FILTER (WHERE k % 10 <> 0 AND k % 11 = 0) AS timeout_outcome_count, count(*) FILTER (WHERE k % 5 <> 0) AS validation_success_count, count(*) FILTER (WHERE k % 5 = 0) AS validation_failure_count,
               count(*) FILTER (WHERE k % 6 = 0) AS abstention_count, count(*) FILTER (WHERE k % 2 > 0) AS review_required_output_count, CAST(coalesce(sum(k % 1000) FILTER (WHERE k % 7 <> 0), 0) AS BIGINT) AS total_reported_input_tokens,
               CAST(sum(k % 50) AS BIGINT) AS total_reported_output_tokens, CAST(coalesce(sum(k % 100) FILTER (WHERE k % 4 <> 0 AND k % 13 <> 0), 0) AS DOUBLE) AS total_estimated_cost FROM (SELECT event_id AS k FROM events)""",
    "text_forms": """
        SELECT p_partkey, '  ' || p_name || chr(10) || chr(10) || p_type AS lines, p_name || ' ' || p_type AS collapsed, p_name || ' ' || chr(9) || chr(13) || chr(10) || chr(10) || p_type AS stripped,
               'cannot open ' || p_partkey || '.pdf now' AS message, '<a@' || p_partkey || '>,<b@x>' AS ids, 'a' || p_partkey || ',b' AS bare_ids FROM part""",
    "collapsed_offsets": """
        WITH w AS (SELECT p_partkey, '  ' || p_brand || ' ' || chr(10) || chr(9) || ' ' || p_type AS t, p_brand || ' ' || p_type AS collapsed FROM part),
        i AS (SELECT *, list_filter(range(length(t)), lambda i: trim(t[i + 1], ' ' || chr(10) || chr(9)) <> '') AS p FROM w)
        SELECT p_partkey, collapsed, array_to_string(flatten(list_transform(range(len(p)), lambda j: CASE WHEN j > 0 AND p[j] < p[j + 1] - 1 THEN [p[j + 1], p[j + 1]] ELSE [p[j + 1]] END)), ',') AS offsets FROM i""",
    "date_checks": "SELECT o_orderkey, o_orderkey % 4 = 1 AS valid FROM orders",
    "stable_identities": """
        SELECT o_orderkey, 'X-' || upper(sha256('["' || o_orderstatus || '","' || o_orderpriority || '"]')) AS id, upper(sha256('{"a":"' || o_orderstatus || '","b":"' || o_orderpriority || '"}')) AS self_hash,
               upper(sha256(o_orderstatus || chr(10) || o_orderpriority || chr(10))) AS lf, '[{"key":"a","value":"' || o_orderpriority || '"},{"key":"z","value":"' || o_orderstatus || '"}]' AS qualifiers FROM orders""",
    "hash_check": "SELECT o_orderkey FROM orders WHERE o_orderkey % 6 = 0",
    "block_check": """
        WITH v AS (SELECT unnest([CASE WHEN k % 5 = 0 THEN 'unknown_block_type' END, CASE WHEN k % 7 = 0 THEN 'blank_without_warning' END, CASE WHEN k % 9 = 0 THEN 'bad_locator' END, CASE WHEN k % 2 = 1 AND k % 3 <> 0 THEN 'status_without_warnings' END,
            CASE WHEN k % 6 = 0 THEN 'warnings_without_status' END, CASE WHEN k % 4 = 0 THEN 'unknown_format' END, CASE WHEN k % 6 = 0 THEN 'bad_checksum' END, CASE WHEN k % 5 = 0 THEN 'bad_confidence' END, CASE WHEN k % 5 = 1 THEN 'review_required' END,
            CASE WHEN k % 8 = 0 THEN 'no_evidence' END]) AS violation FROM (SELECT o_orderkey AS k FROM orders))
        SELECT violation, count(*) AS n FROM v WHERE violation IS NOT NULL GROUP BY 1""",
    "dangling_evidence": "SELECT o_orderkey AS candidate_id, o_orderkey || '-' || n AS evidence_id FROM (SELECT o_orderkey, unnest([1, 9]) AS n FROM orders) LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON l_orderkey = o_orderkey AND l_linenumber = n WHERE l_orderkey IS NULL",
    "canonical_values": """
        WITH v AS (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS f FROM orders), p AS (SELECT *, (f // 10) || CASE WHEN f % 10 = 0 THEN '' ELSE '.' || (f % 10) END AS plain FROM v)
        SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'money|' || plain || '|GBP' WHEN 1 THEN 'number|' || plain WHEN 2 THEN 'date|' || o_orderpriority ELSE 'string|' || o_orderpriority END AS value_key FROM p""",
    "structural_values": """SELECT o_orderkey, '{"a":{"c":"' || lower(o_orderstatus) || ' x","d":true},"z":["' || lower(o_orderpriority) || '",1,null]}' AS plain FROM orders""",
    "cache_record_check": """
        WITH c AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'none' WHEN 2 THEN 'cache_path_escape' WHEN 4 THEN 'cache_hash_mismatch' ELSE 'cache_record_invalid' END AS problem FROM orders) SELECT problem, count(*) AS n FROM c GROUP BY 1""",
    "rule_attribution": "SELECT CASE WHEN o_orderkey % 8 = 0 THEN 'V02-RULE-COM-EXPLICIT-001' WHEN o_orderkey % 4 = 0 THEN 'V02-RULE-COM-WEAK-002' WHEN o_orderkey % 4 = 1 THEN 'V02-RULE-BUD-001' WHEN o_orderkey % 4 = 2 THEN 'V02-RULE-RISK-001' ELSE 'none' END AS rule_id, count(*) AS n FROM orders GROUP BY 1",
    "evaluation_report": """
        WITH k AS (SELECT o_orderkey AS n, o_custkey AS c, o_orderkey % 11 <> 0 AS own, o_orderkey % 7 <> 0 AS gold FROM orders),
        t AS (SELECT count(*) FILTER (WHERE own AND gold AND n % 5 <> 0) AS tp, count(*) FILTER (WHERE own) AS own, count(*) FILTER (WHERE gold) AS gold, count(*) FILTER (WHERE own AND gold) AS both_ FROM k)
        SELECT own AS candidates, (SELECT count(*) FROM k WHERE own AND n % 6 = 0) AS review_required, (SELECT count(*) FROM k WHERE own AND n % 9 = 0) AS ambiguous_evidence, both_ AS aligned, tp AS aligned_values, 0 AS duplicates,
               tp AS true_positive, own - tp AS false_positive, gold - tp AS false_negative, round(tp / own, 6) AS precision, round(tp / gold, 6) AS recall, round(2 * tp / (own + gold), 6) AS f1,
               (SELECT count(DISTINCT c % 5) FROM k WHERE own AND c % 5 <> 2) AS reproduced, (SELECT count(DISTINCT c % 5) FROM k WHERE own) AS sources, (SELECT count(*) = 0 FROM k WHERE own AND c % 5 = 2) AS complete FROM t""",
    "reproduction_bundle": """
        WITH k AS (SELECT o_orderkey AS n, o_orderkey <> 1 AS again FROM orders WHERE o_orderkey % 11 <> 0),
        m AS (SELECT unnest([struct_pack(measure := 'candidates', first := count(*), second := count(*) FILTER (WHERE again)), struct_pack(measure := 'review_required', first := count(*) FILTER (WHERE n % 6 = 0), second := count(*) FILTER (WHERE again AND n % 6 = 0)),
            struct_pack(measure := 'ambiguous_evidence', first := count(*) FILTER (WHERE n % 9 = 0), second := count(*) FILTER (WHERE again AND n % 9 = 0)),
            struct_pack(measure := 'strict_matches', first := count(*) FILTER (WHERE n % 7 <> 0 AND n % 5 <> 0), second := count(*) FILTER (WHERE again AND n % 7 <> 0 AND n % 5 <> 0)),
            struct_pack(measure := 'own_meanings', first := count(*) FILTER (WHERE NOT again), second := CAST(0 AS BIGINT))], recursive := true) FROM k)
        SELECT measure, first, second, CASE WHEN measure = 'candidates' THEN CAST(-1 AS BIGINT) END AS expected, first = second AND measure <> 'candidates' AND (measure <> 'own_meanings' OR first = 0) AS passed FROM m""",
    "predicate_rates": """
        WITH k AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'metric' ELSE 'finding' END AS predicate, o_orderkey % 11 <> 0 AS own, o_orderkey % 7 <> 0 AS gold, o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AS tp FROM orders),
        t AS (SELECT predicate, count(*) FILTER (WHERE tp) AS tp, count(*) FILTER (WHERE own) AS own, count(*) FILTER (WHERE gold) AS gold FROM k GROUP BY 1)
        SELECT predicate, round(tp / own, 6) AS precision, round(tp / gold, 6) AS recall, round(2 * tp / (own + gold), 6) AS f1 FROM t""",
    "target_check": """
        WITH s AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) AS v FROM orders)
        SELECT 'some' AS target, round(v, 6) AS value, 0.0::DOUBLE AS least, true AS reached FROM s UNION ALL SELECT 'all', round(v, 6), 1.0::DOUBLE, v >= 1 FROM s UNION ALL SELECT 'missing', NULL, 0.5::DOUBLE, false""",
}
