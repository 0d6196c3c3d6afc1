"""Rule engine, registry and matching queries over statements made from the star schema.

The statements follow from columns by a template, so that the oracle can state the
expected facts without any pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import numbers, text
from factloom.operators import comparison, matching, registry, rules, rules_v2, rules_v3, rules_v4, segmentation
from factloom.session import spread, table


def _blocks(rows: DataFrame, source: Column, number: Column, words: Column) -> DataFrame:
    return spread(rows).select(source.alias("source_id"), number.cast("string").alias("block_id"), F.lit(1).alias("sequence"), F.lit("page_text").alias("block_type"), words.alias("text"), F.lit("page").alias("location_type"), F.lit("1").alias("location_value"))


def _found(blocks: DataFrame, predicate: str) -> DataFrame:
    rows = rules.candidates(rules.outcomes(segmentation.statements(blocks), [predicate]), blocks)
    return rules.facts(rows)


def _shown(facts: DataFrame) -> DataFrame:
    return facts.select("block_id", "subject_text", "subject_type", "raw_value", F.round("confidence", 1).alias("confidence"))


def _concat(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def rule_commitment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return _shown(_found(_blocks(c, F.lit("C"), F.col("c_custkey"), _concat("Customer office ", F.col("c_custkey"), " will publish ", F.col("c_mktsegment"), " guidance.")), "commitment"))


def rule_requirement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return _shown(_found(_blocks(s, F.lit("S"), F.col("s_suppkey"), _concat("Supplier board ", F.col("s_suppkey"), " must not file late reports.")), "requirement"))


def rule_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return _shown(_found(_blocks(n, F.lit("N"), F.col("n_nationkey"), _concat("The council of ", F.col("n_name"), " approved the new process.")), "decision"))


def rule_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return _shown(_found(_blocks(p, F.lit("P"), F.col("p_partkey"), _concat("Project ", F.col("p_partkey"), " faces a risk of late ", F.col("p_size"), " unit delivery.")), "risk"))


def rule_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    found = _found(_blocks(o, F.lit("O"), F.col("o_orderkey"), _concat("Recommendation ", F.col("o_orderkey"), ": Review order of customer ", F.col("o_custkey"), ".")), "recommendation")
    return _shown(found).withColumn("subject_text", F.col("subject_text"))


def _budget_text() -> Column:
    return _concat("Delivery programme ", F.col("o_orderkey"), " has an approved budget of GBP ", F.floor("o_totalprice").cast("long"), ".")


def rule_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    found = _found(_blocks(o, F.lit("O"), F.col("o_orderkey"), _budget_text()), "budget")
    return found.select("block_id", "subject_text", "subject_type", F.col("value_number").cast("long").alias("amount"), F.col("value_currency").alias("currency"), F.element_at("qualifiers", "budget_status").alias("status"))


def rule_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    found = _found(_blocks(p, F.lit("P"), F.col("p_partkey"), _concat(F.col("p_size"), "% of surveyed users used part ", F.col("p_partkey"), " in March 2021.")), "metric")
    return found.select("block_id", "subject_text", F.col("value_number").cast("long").alias("value"), F.element_at("qualifiers", "metric_name").alias("metric_name"), F.element_at("qualifiers", "population").alias("population"), F.element_at("qualifiers", "period").alias("period"))


def rule_action_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "in progress").otherwise("delayed")
    found = _found(_blocks(o, F.lit("O"), F.col("o_orderkey"), _concat("Action ", F.col("o_orderkey"), " is ", state, ".")), "action_status")
    return found.select("block_id", "subject_text", "raw_value", F.element_at("qualifiers", "action_id").alias("action_id"))


def _engine_text() -> Column:
    return _concat("National Office\nwill publish ", F.col("c_name"), " guidance.\nThe council must review it. The council approved a plan.\nSatisfaction rate may be 40% or 60%.")


def rule_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over all templates of customers: counts by predicate."""
    c = table(spark, sf_dir, "customer")
    facts, _ = rules.extract(_blocks(c, F.lit("C"), F.col("c_custkey"), _engine_text()))
    return facts.groupBy("predicate", "confidence").agg(F.count("*").alias("n"), F.count_distinct("candidate_id").alias("ids"))


def rule_v2_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second engine over templates of customers; equal facts of a source count once."""
    c = table(spark, sf_dir, "customer")
    facts, _ = rules_v2.extract(_blocks(c, _concat("C", F.col("c_nationkey")), F.col("c_custkey"), _engine_text()))
    return facts.groupBy("source_id", "predicate", "confidence").agg(F.count("*").alias("n"))


def _reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two pages and a title for each customer: numbered recommendations, a ratio, a budget, and
    commitments of named, first-person and generic actors."""
    c = spread(table(spark, sf_dir, "customer"))
    k, source = F.col("c_custkey"), _concat("C", F.col("c_custkey"))
    first = _concat(
        "1. Publish the guidance for ", F.col("c_mktsegment"), " offices. 2. Birds sing. The board has met their commitments against ", k % 7, " of the 7 actions.\nThe council has committed GBP ", k + 1, " million to Harbour Fund ", k,
        ".\nIt will rain.\nThe harbour council ", k, " plans to open offices.",
    )
    second = _concat("Published by the Northern Harbour Authority.\nThe harbour council will now publish guidance ", k, ".\nWe will implement the reform plan of ", F.col("c_name"), " this year.\nThe Harbour Service Board will seek new members for the panel.\nWe will improve.")
    page = lambda n, words: c.select(source.alias("source_id"), F.lit(f"B{n}").alias("block_id"), F.lit(n).alias("sequence"), F.lit("page_text").alias("block_type"), words.alias("text"), F.lit("page").alias("location_type"), F.lit(str(n)).alias("location_value"))
    documents = c.select(source.alias("source_id"), _concat("Regional action plan ", k, " - Q1 2024: notes").alias("title"), F.array().cast("array<string>").alias("authors"), F.create_map().cast("map<string,string>").alias("metadata"))
    return page(1, first).unionByName(page(2, second)), documents


def rule_v3_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third engine over two pages of each customer."""
    blocks, documents = _reports(spark, sf_dir)
    facts, _ = rules_v3.extract(blocks, documents.select("source_id", "title"))
    return facts.select("source_id", "block_id", "rule_id", "predicate", "subject_text", "raw_value", F.col("value_number").cast("long").alias("amount"), F.element_at("qualifiers", "recommendation_id").alias("number"))


def rule_v4_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth engine over the same pages: resolved actors, plain values, recovered commitments."""
    facts, _, _ = rules_v4.extract(*_reports(spark, sf_dir))
    return facts.where("predicate = 'commitment'").select("source_id", "block_id", "rule_id", "subject_text", "subject_type", "raw_value", "value_text")


def rule_v4_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the fourth engine came to its commitments, counted."""
    _, _, trace = rules_v4.extract(*_reports(spark, sf_dir))
    return comparison.trace_counts(trace, ["status", "actor_method", "value_operation", "rejected"])


def sentence_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut statements of orders completed to whole sentences."""
    o = table(spark, sf_dir, "orders")
    rest = F.when(F.col("o_orderkey") % 4 == 0, " 2.5 million (see p. 4) on Dr. Lee. Next").when(F.col("o_orderkey") % 4 == 1, "\n- item").when(F.col("o_orderkey") % 4 == 2, "\nHEADING HERE\nmore.").otherwise(F.lit(" and\nmore! End"))
    raw = _concat("will spend ", F.col("o_orderkey"))
    excerpt = F.concat(F.lit("The office "), raw)
    return o.select("o_orderkey", rules_v4.whole_sentence(F.concat(F.lit("Intro. "), excerpt, rest), excerpt, raw).alias("whole"))


def rule_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstentions: two percentages in one statement."""
    p = table(spark, sf_dir, "part")
    blocks = _blocks(p, F.lit("P"), F.col("p_partkey"), _concat("Adoption rate was ", F.col("p_size"), "% while completion rate was 60% in 2021."))
    found = rules.candidates(rules.outcomes(segmentation.statements(blocks), ["metric"]), blocks)
    return rules.warnings(found).select(text.warning_code(F.col("warning")).alias("code"), F.split_part("warning", F.lit(":"), F.lit(2)).alias("block_id"))


def period_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    words = F.concat(F.lit("Ordered in "), F.date_format("o_orderdate", "MMMM yyyy"), F.lit(" by post"))
    return o.select("o_orderkey", numbers.period(words).alias("period"))


def money_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    code, amount = numbers.money(F.lit("£"), F.format_number(F.floor("o_totalprice"), 0), F.when(F.col("o_orderkey") % 2 == 0, "k").otherwise(F.lit(None)))
    return o.select("o_orderkey", code.alias("currency"), amount.cast("long").alias("amount"))


def metric_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.metric_slug(F.concat(F.lit("The share of "), F.col("p_type")), True).alias("slug"))


def _facts(spark: SparkSession, sf_dir: str, gold: bool) -> DataFrame:
    """Order facts; gold has other spellings, some other values and leaves out some orders."""
    o = spread(table(spark, sf_dir, "orders"))
    number = F.col("o_orderkey")
    subject = F.concat(F.lit("Order "), number.cast("string"))
    value = F.floor("o_totalprice").cast("decimal(38,9)")
    name = "annotation_id" if gold else "candidate_id"
    if gold:
        o = o.where(number % 7 != 0)
        subject = F.concat(F.lit("ORDER  "), number.cast("string"), F.lit("."))
        value = F.when(number % 5 == 0, value + 1).otherwise(value)
    else:
        o = o.where(number % 11 != 0)
    qualifiers = F.create_map(F.lit("unit"), F.lit("GBP")) if gold else F.create_map(F.lit("unit"), F.lit("GBP"), F.lit("period"), F.year("o_orderdate").cast("string"))
    return o.select(
        F.concat(F.lit("A-" if gold else "K-"), F.lpad(number.cast("string"), 10, "0")).alias(name), F.concat(F.lit("SRC"), (F.col("o_custkey") % 5).cast("string")).alias("source_id"), subject.alias("subject_text"),
        F.lit("metric").alias("subject_type"), F.when(number % 2 == 0, "metric").otherwise("finding").alias("predicate"), F.col("o_totalprice").cast("string").alias("raw_value"),
        F.lit("number").alias("value_type"), F.lit(None).cast("string").alias("value_text"), value.alias("value_number"), F.lit(None).cast("string").alias("value_currency"), qualifiers.alias("qualifiers"),
    )


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    candidates, gold = _facts(spark, sf_dir, False), _facts(spark, sf_dir, True)
    return candidates, gold, matching.strict_matches(candidates, gold)


def strict_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir)[2].select("source_id", "candidate_id", "annotation_id", "predicate", F.array_join("extra", ",").alias("extra"))


def value_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, gold, _ = _sides(spark, sf_dir)
    return matching.value_alignment(candidates, gold)


def predicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.predicate_counts(*_sides(spark, sf_dir), names=registry.predicates(spark))


def prf_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.metrics(matching.predicate_counts(*_sides(spark, sf_dir)))
    return found.select("true_positive", "false_positive", "false_negative", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def diagnostic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.source_predicate_counts(*_sides(spark, sf_dir))


def predicate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = _facts(spark, sf_dir, False).withColumn("qualifiers", F.map_filter("qualifiers", lambda k, v: k != "period"))
    return registry.contract_violations(candidates).groupBy("violation").agg(F.count("*").alias("n"))


def predicate_canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    spelt = F.when(F.col("o_orderkey") % 3 == 0, "Programme-Status").when(F.col("o_orderkey") % 3 == 1, " target launch date ").otherwise("Budget")
    return registry.canonical(o.select("o_orderkey", spelt.alias("predicate"))).groupBy("predicate").agg(F.count("*").alias("n"))


def duplicate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = _facts(spark, sf_dir, False)
    return matching.duplicate_count(candidates.unionByName(candidates))


QUERIES = {
    f.__name__: f
    for f in (
        rule_commitment, rule_requirement, rule_decision, rule_risk, rule_recommendation, rule_budget, rule_metric, rule_action_status, rule_all, rule_v2_all, rule_v3_all, rule_v4_all, rule_v4_trace, sentence_completion, rule_warnings, period_extract,
        money_normalise, metric_slug, strict_match, value_alignment, predicate_counts, prf_metrics, diagnostic_summary, predicate_violations, predicate_canon, duplicate_candidates,
    )
}

_GOLD = "SELECT *, 'A-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS annotation_id, floor(o_totalprice) + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS v FROM orders WHERE o_orderkey % 7 <> 0"
_CAND = "SELECT *, 'K-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS candidate_id, floor(o_totalprice) AS v FROM orders WHERE o_orderkey % 11 <> 0"
_KIND = "CASE WHEN o_orderkey % 2 = 0 THEN 'metric' ELSE 'finding' END"
_COUNTS = f"""
    WITH g AS ({_GOLD}), c AS ({_CAND}), m AS (SELECT o_orderkey FROM g JOIN c USING (o_orderkey, v)),
    k AS (SELECT {_KIND} AS predicate, 'tp' AS kind FROM m
          UNION ALL SELECT {_KIND}, 'fp' FROM c WHERE o_orderkey NOT IN (SELECT o_orderkey FROM m)
          UNION ALL SELECT {_KIND}, 'fn' FROM g WHERE o_orderkey NOT IN (SELECT o_orderkey FROM m))"""

ORACLES = {
    "rule_commitment": "SELECT CAST(c_custkey AS VARCHAR) AS block_id, 'Customer office ' || c_custkey AS subject_text, 'organisation' AS subject_type, 'will publish ' || c_mktsegment || ' guidance.' AS raw_value, 0.9::DOUBLE AS confidence FROM customer",
    "rule_requirement": "SELECT CAST(s_suppkey AS VARCHAR) AS block_id, 'Supplier board ' || s_suppkey AS subject_text, 'organisation' AS subject_type, 'must not file late reports.' AS raw_value, 0.9::DOUBLE AS confidence FROM supplier",
    "rule_decision": "SELECT CAST(n_nationkey AS VARCHAR) AS block_id, 'The council of ' || n_name AS subject_text, 'organisation' AS subject_type, 'approved the new process.' AS raw_value, 0.9::DOUBLE AS confidence FROM nation",
    "rule_risk": "SELECT CAST(p_partkey AS VARCHAR) AS block_id, 'Project ' || p_partkey AS subject_text, 'initiative' AS subject_type, 'faces a risk of late ' || p_size || ' unit delivery.' AS raw_value, 0.9::DOUBLE AS confidence FROM part",
    "rule_recommendation": "SELECT CAST(o_orderkey AS VARCHAR) AS block_id, 'Recommendation ' || o_orderkey AS subject_text, 'recommendation' AS subject_type, 'Review order of customer ' || o_custkey || '.' AS raw_value, 0.9::DOUBLE AS confidence FROM orders",
    "rule_budget": "SELECT CAST(o_orderkey AS VARCHAR) AS block_id, 'Delivery programme ' || o_orderkey AS subject_text, 'programme' AS subject_type, CAST(floor(o_totalprice) AS BIGINT) AS amount, 'GBP' AS currency, 'approved' AS status FROM orders",
    "rule_metric": "SELECT CAST(p_partkey AS VARCHAR) AS block_id, 'surveyed users' AS subject_text, CAST(p_size AS BIGINT) AS value, 'surveyed_users_percentage' AS metric_name, 'surveyed users' AS population, '2021-03' AS period FROM part",
    "rule_action_status": "SELECT CAST(o_orderkey AS VARCHAR) AS block_id, 'Action ' || o_orderkey AS subject_text, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in progress' ELSE 'delayed' END AS raw_value, CAST(o_orderkey AS VARCHAR) AS action_id FROM orders",
    "rule_all": "SELECT unnest(['commitment', 'requirement', 'decision']) AS predicate, unnest([0.7, 0.9, 0.9])::DOUBLE AS confidence, count(*) AS n, count(*) AS ids FROM customer GROUP BY 1, 2",
    "rule_v2_all": "SELECT 'C' || c_nationkey AS source_id, unnest(['commitment', 'requirement', 'decision', 'metric']) AS predicate, unnest([0.7, 0.9, 0.9, 0.5])::DOUBLE AS confidence, unnest([count(DISTINCT c_name), 1, 1, 2]) AS n FROM customer GROUP BY c_nationkey",
    "rule_v3_all": """
        WITH c AS (SELECT *, 'C' || c_custkey AS s, c_custkey AS k FROM customer)
        SELECT s AS source_id, 'B1' AS block_id, 'V03-POLICY-COMMITMENT-PRECISION-002' AS rule_id, 'commitment' AS predicate, 'The harbour council ' || k AS subject_text, 'plans to open offices.' AS raw_value, CAST(NULL AS BIGINT) AS amount, CAST(NULL AS VARCHAR) AS number FROM c
        UNION ALL SELECT s, 'B1', 'V03-RULE-ACTION-RATIO-001', 'action_status', 'Regional action plan ' || k, 'Commitments met against ' || (k % 7) || ' of the 7 actions.', NULL, NULL FROM c
        UNION ALL SELECT s, 'B1', 'V03-RULE-BUD-COMMITTED-001', 'budget', 'Harbour Fund ' || k, 'has committed GBP ' || (k + 1) || ' million to Harbour Fund ' || k, (k + 1) * 1000000, NULL FROM c
        UNION ALL SELECT s, 'B1', 'V03-RULE-REC-NUMBERED-001', 'recommendation', 'Regional action plan ' || k || ' recommendation 1', 'Publish the guidance for ' || c_mktsegment || ' offices.', NULL, '1' FROM c
        UNION ALL SELECT s, 'B2', 'V03-POLICY-COMMITMENT-PRECISION-002', 'commitment', 'The harbour council', 'will now publish guidance ' || k || '.', NULL, NULL FROM c""",
    "rule_v4_all": """
        WITH c AS (SELECT *, 'C' || c_custkey AS s, c_custkey AS k FROM customer)
        SELECT s AS source_id, 'B1' AS block_id, 'V04-POLICY-COMMITMENT-VALUE-003' AS rule_id, 'The harbour council ' || k AS subject_text, 'organisation' AS subject_type, 'plans to open offices.' AS raw_value, 'Plans to open offices.' AS value_text FROM c
        UNION ALL SELECT s, 'B2', 'V04-POLICY-COMMITMENT-VALUE-003', 'The harbour council', 'organisation', 'will now publish guidance ' || k || '.', 'Now publish guidance ' || k || '.' FROM c
        UNION ALL SELECT s, 'B2', 'V04-RULE-COMMITMENT-RECOVERY-004', 'Northern Harbour Authority', 'organisation', 'will implement the reform plan of ' || c_name || ' this year.', 'Implement the reform plan of ' || c_name || ' this year.' FROM c
        UNION ALL SELECT s, 'B2', 'V04-RULE-COMMITMENT-RECOVERY-004', 'The Harbour Service Board', 'initiative', 'will seek new members for the panel.', 'Seek new members for the panel.' FROM c""",
    "rule_v4_trace": """
        SELECT unnest(['status', 'status', 'actor_method', 'actor_method', 'actor_method', 'value_operation', 'value_operation', 'rejected']) AS counter,
               unnest(['retained', 'recovered', 'preserved_parent_subject', 'role_aware_front_matter', 'explicit_statement_actor', 'affirmative_will_removed', 'intent_or_planning_preserved', 'unsafe_or_ambiguous_parent_completion']) AS name,
               unnest([2 * n, 3 * n, 2 * n, 2 * n, n, 4 * n, n, n]) AS n FROM (SELECT count(*) AS n FROM customer)""",
    "sentence_completion": """
        SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'The office will spend ' || o_orderkey || ' 2.5 million (see p. 4) on Dr. Lee.' WHEN 3 THEN 'The office will spend ' || o_orderkey || ' and' || chr(10) || 'more!' END AS whole FROM orders""",
    "rule_warnings": "SELECT 'abstained_multiple_values' AS code, CAST(p_partkey AS VARCHAR) AS block_id FROM part",
    "period_extract": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS period FROM orders",
    "money_normalise": "SELECT o_orderkey, 'GBP' AS currency, CAST(floor(o_totalprice) * CASE WHEN o_orderkey % 2 = 0 THEN 1000 ELSE 1 END AS BIGINT) AS amount FROM orders",
    "metric_slug": "SELECT p_partkey, 'share_' || array_to_string(list_filter(regexp_extract_all(lower(p_type), '[a-z0-9]+'), lambda w: w NOT IN ('a', 'an', 'the', 'of', 'for')), '_') || CASE WHEN regexp_matches(lower(p_type), '(rate|percentage|share)$') THEN '' ELSE '_percentage' END AS slug FROM part",
    "strict_match": f"WITH g AS ({_GOLD}), c AS ({_CAND}) SELECT 'SRC' || (c.o_custkey % 5) AS source_id, candidate_id, annotation_id, CASE WHEN c.o_orderkey % 2 = 0 THEN 'metric' ELSE 'finding' END AS predicate, 'period' AS extra FROM c JOIN g USING (o_orderkey, v)",
    "value_alignment": f"WITH g AS ({_GOLD}), c AS ({_CAND}) SELECT 'SRC' || (c.o_custkey % 5) AS source_id, candidate_id, annotation_id, CASE WHEN c.o_orderkey % 2 = 0 THEN 'metric' ELSE 'finding' END AS predicate, c.v = g.v AS normalized_value_match FROM c JOIN g USING (o_orderkey)",
    "predicate_counts": _COUNTS + ", n AS (SELECT unnest([" + ", ".join(f"'{p[0]}'" for p in registry.PREDICATES) + "]) AS predicate) SELECT n.predicate, count(*) FILTER (WHERE kind = 'tp') AS true_positive, count(*) FILTER (WHERE kind = 'fp') AS false_positive, count(*) FILTER (WHERE kind = 'fn') AS false_negative FROM n LEFT JOIN k ON k.predicate = n.predicate GROUP BY 1",
    "prf_metrics": _COUNTS + ", t AS (SELECT count(*) FILTER (WHERE kind = 'tp') AS tp, count(*) FILTER (WHERE kind = 'fp') AS fp, count(*) FILTER (WHERE kind = 'fn') AS fn FROM k) SELECT tp AS true_positive, fp AS false_positive, fn AS false_negative, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM t",
    "diagnostic_summary": f"""
        WITH g AS ({_GOLD}), c AS ({_CAND}), m AS (SELECT o_orderkey FROM g JOIN c USING (o_orderkey, v)),
        k AS (SELECT o_custkey, o_orderkey, 1 AS c, 0 AS g, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM m) THEN 0 ELSE 1 END AS uc, 0 AS ug FROM c
              UNION ALL SELECT o_custkey, o_orderkey, 0, 1, 0, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM m) THEN 0 ELSE 1 END FROM g)
        SELECT 'SRC' || (o_custkey % 5) AS source_id, {_KIND} AS predicate, CAST(sum(c) AS BIGINT) AS candidates, CAST(sum(g) AS BIGINT) AS annotations, CAST(sum(uc) AS BIGINT) AS unmatched_candidates, CAST(sum(ug) AS BIGINT) AS unmatched_annotations FROM k GROUP BY 1, 2""",
    "predicate_violations": f"WITH c AS ({_CAND}), k AS (SELECT {_KIND} AS p FROM c) SELECT CASE p WHEN 'metric' THEN 'missing_qualifier:metric_name' ELSE 'unknown_qualifier:unit' END AS violation, count(*) AS n FROM k GROUP BY 1",
    "predicate_canon": "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'status' WHEN 1 THEN 'target_date' ELSE 'budget' END AS predicate, count(*) AS n FROM orders GROUP BY 1",
    "duplicate_candidates": f"SELECT count(*) AS duplicates FROM ({_CAND})",
}
