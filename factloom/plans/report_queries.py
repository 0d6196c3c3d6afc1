"""Manifest, validation, answer, agent and cost queries over tables made from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import numbers, text
from factloom.operators import answers, ingest, matching, model_calls, reports, validation
from factloom.session import table


def _manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    name = lambda x: F.concat(F.lit("S"), x.cast("string"))
    split = c.select(name(F.col("c_custkey")).alias("source_id"), F.col("c_mktsegment").alias("document_family"), F.when(F.col("c_custkey") % 3 == 0, "PPTX").otherwise("PDF").alias("source_format"), F.when(F.col("c_custkey") % 4 == 0, "held_out").otherwise("development").alias("split"))
    key = F.col("s_suppkey")
    digest = F.when(key % 6 == 0, "bad").otherwise(F.sha2(F.col("s_name"), 256))
    path = F.when(key % 10 == 0, F.concat(F.lit("../"), F.col("s_name"))).otherwise(F.concat(F.lit("raw/"), F.col("s_name")))
    register = s.select(name(key).alias("source_id"), F.lit("PDF").alias("source_format"), path.alias("local_filename"), digest.alias("sha256"), F.when(key % 5 == 0, "pending").otherwise("approved").alias("corpus_status"))
    return split, register


def manifest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    split, register = _manifests(spark, sf_dir)
    rows = ingest.active_sources(split, register, "development")
    return rows.select("source_id", "document_family", F.array_join("problems", ",").alias("problems"))


def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    split, register = _manifests(spark, sf_dir)
    rows = ingest.active_sources(split, register)
    return rows.select(F.explode("problems").alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "success_with_warnings").otherwise("failed")
    return reports.batch_report(o.select(status.alias("status"), (F.col("o_orderkey") % 2 == 0).alias("checksum_match")))


def sequence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("document_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("block_id"), F.col("l_linenumber").alias("sequence"))
    return validation.sequence_violations(li).groupBy("violation").agg(F.count("*").alias("n"))


def evidence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as evidence of the documents that may contain them: those that do not."""
    docs = table(spark, sf_dir, "documents").select(F.lit("D").alias("source_id"), F.col("doc_id").cast("string").alias("block_id"), F.lit("page").alias("location_type"), F.lit("1").alias("location_value"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("evidence_id"), F.lit("D").alias("source_id"), F.col("item_id").cast("string").alias("block_id"), F.lit("page").alias("location_type"), F.lit("1").alias("location_value"), F.col("text").alias("text_excerpt"))
    return validation.unresolved_evidence(items, docs)


def fact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    facts = p.select(F.col("p_partkey").alias("fact_id"), F.when(F.col("p_size") > 25, "risk").otherwise("metric").alias("fact_type"), F.col("p_brand").alias("subject"), F.col("p_type").alias("statement"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("value"))
    return answers.search_facts(facts, "risk", " BRAND#1").select("fact_id", "subject")


def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite the lines of an order, one of them possibly of another order."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    hits = li.select(F.col("l_orderkey").alias("qid"), F.concat(F.lit("L"), F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string")).alias("evidence_id"))
    cited = F.concat(F.lit("L"), (F.col("o_orderkey") + F.when(F.col("o_orderkey") % 9 == 0, 1).otherwise(0)).cast("string"), F.lit(":1"))
    rows = o.select(F.col("o_orderkey").alias("answer_id"), F.col("o_orderkey").alias("qid"), F.concat(F.lit("Shipped ["), cited, F.lit("].")).alias("answer"), F.array(cited).alias("cited"))
    found = answers.check_citations(rows, hits)
    return found.select("answer_id", F.array_join("in_text", ",").alias("in_text"), F.array_join("unknown", ",").alias("unknown"), "valid")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One agent case an order: tools by priority, status by order status."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    actual = F.when(key % 3 == 0, F.array(F.lit("retrieve"), F.lit("read"))).when(key % 3 == 1, F.array(F.lit("retrieve"))).otherwise(F.array(F.lit("search"), F.lit("retrieve"), F.lit("read")))
    acceptable = F.array(F.array(F.lit("retrieve")), F.array(F.lit("search"), F.lit("read")))
    status = F.when(F.col("o_orderstatus") == "F", "answered").otherwise("insufficient")
    expected = F.when(key % 4 == 0, "insufficient").otherwise("answered")
    rows = o.select(key.alias("case_id"), F.when(key % 2 == 0, "routing").otherwise("retrieval").alias("evaluation_group"), expected.alias("expected_status"), status.alias("actual_status"), actual.alias("actual_tool_sequence"), acceptable.alias("acceptable"), F.array(key).alias("expected_ids"), F.array(F.when(key % 5 == 0, key + 1).otherwise(key)).alias("cited_ids"))
    return rows.withColumns({
        "task_success": answers.task_success(F.col("expected_status"), F.col("actual_status"), F.col("expected_ids"), F.col("cited_ids")),
        "citation_valid": F.col("case_id") % 5 != 0,
        "tool_selection_acceptable": answers.tool_sequence_ok(F.col("acceptable"), F.col("actual_tool_sequence")),
        "unnecessary_tool_calls": answers.unnecessary_calls(F.col("acceptable"), F.col("actual_tool_sequence")),
    })


def agent_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).select("case_id", "task_success", "tool_selection_acceptable", F.col("unnecessary_tool_calls").cast("long").alias("unnecessary_tool_calls"))


def agent_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.agent_metrics(_outcomes(spark, sf_dir))
    return found.select("cases", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


def tool_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), (F.col("event_id") % 3).alias("results"))
    return reports.tool_counts(e, ["click", "view", "purchase", "never"]).select("tool", F.col("calls").cast("long").alias("calls"), F.col("results").cast("long").alias("results"))


def llm_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    key = F.col("event_id")
    rows = e.select(
        F.when(key % 10 == 0, "failed").otherwise("success").alias("status"), F.when(key % 4 == 0, "hit").otherwise("miss").alias("cache"), (key % 3 + 1).alias("attempts"),
        F.when(key % 7 != 0, key % 1000).alias("input_tokens"), (key % 50).alias("output_tokens"), numbers.token_cost(key % 1000, F.lit("0.75").cast("decimal(18,9)")).alias("cost"),
    )
    return reports.run_report(rows).withColumn("cost", F.col("cost").cast("double"))


def cost_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("payload"))
    found = reports.cost_budget(docs, "0.75", 4000, "4.5", "100000")
    return found.select("requests", "planned_tokens", "conservative_tokens", F.round(F.col("planned_cost").cast("double"), 6).alias("planned_cost"), F.round(F.col("conservative_cost").cast("double"), 6).alias("conservative_cost"), "within_cap")


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("request_sha256"), "doc_id")
    cache = docs.where(F.col("doc_id") % 3 == 0).groupBy("request_sha256").agg(F.lit("ok").alias("response"))
    return model_calls.cached(docs, cache).groupBy("cache").agg(F.count("*").alias("n"))


def cache_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("request_sha256"), "doc_id")
    return model_calls.new_for_cache(docs.where(F.col("doc_id") % 3 == 0), docs).select("doc_id")


def payload_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("block_id"), F.col("doc_id").alias("sequence"), "text")
    return model_calls.pack_blocks(docs)


def repro_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    first = docs.where(F.col("doc_id") % 10 != 3).select("doc_id", F.sha2("text", 256).alias("digest"))
    second = docs.where(F.col("doc_id") % 10 != 4).select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    return matching.reproducibility(first, second, "doc_id", "digest")


def email_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders written as e-mail dates and read back."""
    o = table(spark, sf_dir, "orders")
    words = F.concat(F.date_format("o_orderdate", "E, d MMM yyyy HH:mm:ss"), F.lit(" +0200"))
    return o.select("o_orderkey", F.date_format(numbers.email_date(words), "yyyy-MM-dd HH:mm:ss").alias("sent"))


def metadata_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"), F.min("o_totalprice").alias("low"))
    return reports.gates(report, {"any_rows": F.col("n") > 0, "unique_keys": F.col("n") == F.col("keys"), "negative_price": F.col("low") < 0})


def warning_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    words = F.concat(F.regexp_replace("o_orderpriority", "[^A-Za-z]", ""), F.lit("Error:x"))
    return o.select(text.error_code(text.warning_code(words)).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        manifest_join, manifest_violations, batch_report, sequence_check, evidence_check, fact_search, citation_check, agent_outcomes, agent_metrics, tool_usage, llm_run_report,
        cost_budget, cache_lookup, cache_anti_join, payload_packing, repro_check, email_dates, metadata_gates, warning_codes,
    )
}

_MANIFEST = """
    WITH sp AS (SELECT 'S' || c_custkey AS source_id, c_mktsegment AS document_family, CASE WHEN c_custkey % 3 = 0 THEN 'PPTX' ELSE 'PDF' END AS f, CASE WHEN c_custkey % 4 = 0 THEN 'held_out' ELSE 'development' END AS split FROM customer),
    rg AS (SELECT 'S' || s_suppkey AS source_id, s_suppkey % 5 = 0 AS pending, s_suppkey % 6 = 0 AS bad, s_suppkey % 10 = 0 AS unsafe FROM supplier),
    j AS (SELECT sp.*, rg.source_id IS NULL AS missing, pending, bad, unsafe FROM sp LEFT JOIN rg USING (source_id)),
    p AS (SELECT *, list_filter([CASE WHEN missing THEN 'not_registered' END, CASE WHEN pending THEN 'not_approved' END, CASE WHEN NOT missing AND f <> 'PDF' THEN 'format_mismatch' END, CASE WHEN bad THEN 'bad_checksum' END, CASE WHEN unsafe THEN 'unsafe_path' END], lambda x: x IS NOT NULL) AS problems FROM j)"""

_CASES = """
    WITH c AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS routing, CASE WHEN o_orderkey % 4 = 0 THEN 'insufficient' ELSE 'answered' END AS e, CASE WHEN o_orderstatus = 'F' THEN 'answered' ELSE 'insufficient' END AS a,
                      CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 3 END AS calls, CASE o_orderkey % 3 WHEN 1 THEN 0 ELSE 1 END AS extra, o_orderkey % 3 = 1 AS ok FROM orders),
    t AS (SELECT *, a = e AND (a <> 'answered' OR k % 5 <> 0) AS success FROM c)"""

ORACLES = {
    "manifest_join": _MANIFEST + " SELECT source_id, document_family, array_to_string(problems, ',') AS problems FROM p WHERE split = 'development'",
    "manifest_violations": _MANIFEST + " SELECT problem, count(*) AS n FROM (SELECT unnest(problems) AS problem FROM p) GROUP BY 1",
    "batch_report": "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS succeeded, count(*) FILTER (WHERE o_orderstatus = 'O') AS with_warnings, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS failed, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS checksum_matches, true AS reconciled FROM orders",
    "sequence_check": """
        WITH d AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS ids, min(l_linenumber) AS low, max(l_linenumber) AS high FROM lineitem GROUP BY 1),
        v AS (SELECT 'repeated_block_id' AS violation FROM d WHERE ids < n UNION ALL SELECT 'broken_sequence' FROM d WHERE ids < n OR low <> 1 OR high <> n)
        SELECT violation, count(*) AS n FROM v GROUP BY 1""",
    "evidence_check": """
        SELECT CAST(item_id AS VARCHAR) AS evidence_id, CASE WHEN d.doc_id IS NULL THEN 'missing_block' ELSE 'not_in_block' END AS violation
        FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id WHERE d.doc_id IS NULL OR NOT contains(d.text, b.text)""",
    "fact_search": "SELECT p_partkey AS fact_id, p_brand AS subject FROM part WHERE p_size > 25 AND contains(lower(concat_ws(' ', p_brand, p_type, CASE WHEN p_partkey % 2 = 0 THEN p_name END)), 'brand#1')",
    "citation_check": """
        WITH a AS (SELECT o_orderkey AS k, 'L' || (o_orderkey + CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END) || ':1' AS cite FROM orders),
        h AS (SELECT DISTINCT l_orderkey AS k, 'L' || l_orderkey || ':' || l_linenumber AS cite FROM lineitem)
        SELECT a.k AS answer_id, a.cite AS in_text, CASE WHEN h.k IS NULL THEN a.cite ELSE '' END AS unknown, h.k IS NOT NULL AS valid FROM a LEFT JOIN h ON a.k = h.k AND a.cite = h.cite""",
    "agent_outcomes": _CASES + " SELECT k AS case_id, success AS task_success, ok AS tool_selection_acceptable, CAST(extra AS BIGINT) AS unnecessary_tool_calls FROM t",
    "agent_metrics": _CASES + """ SELECT count(*) AS cases, round(count(*) FILTER (WHERE success) / count(*), 6) AS task_success,
        round(coalesce(count(*) FILTER (WHERE a = 'answered' AND k % 5 <> 0) / nullif(count(*) FILTER (WHERE a = 'answered'), 0), 0), 6) AS citation_validity,
        round(coalesce(count(*) FILTER (WHERE routing AND e = 'insufficient' AND a = 'insufficient') / nullif(count(*) FILTER (WHERE routing AND e = 'insufficient'), 0), 0), 6) AS abstention,
        round(count(*) FILTER (WHERE ok) / count(*), 6) AS tool_selection, round(sum(extra) / sum(calls), 6) AS unnecessary_calls, round(sum(calls) / count(*), 6) AS mean_calls FROM t""",
    "tool_usage": "SELECT t.tool, count(event_id) AS calls, CAST(coalesce(sum(event_id % 3), 0) AS BIGINT) AS results FROM (SELECT unnest(['click', 'view', 'purchase', 'never']) AS tool) t LEFT JOIN events ON event_type = t.tool GROUP BY 1",
    "llm_run_report": """
        SELECT count(*) AS invocations, count(*) FILTER (WHERE event_id % 10 <> 0) AS succeeded, count(*) FILTER (WHERE event_id % 10 = 0) AS failed, count(*) FILTER (WHERE event_id % 4 = 0) AS cache_hits,
               count(*) FILTER (WHERE event_id % 4 <> 0) AS cache_misses, CAST(sum(event_id % 3 + 1) AS BIGINT) AS attempts, CAST(sum(event_id % 1000) FILTER (WHERE event_id % 7 <> 0) AS BIGINT) AS input_tokens,
               CAST(sum(event_id % 50) AS BIGINT) AS output_tokens, CAST(sum(CAST((event_id % 1000) * 0.75 / 1000000 AS DECIMAL(38, 9))) FILTER (WHERE event_id % 4 <> 0) AS DOUBLE) AS cost FROM events""",
    "cost_budget": """
        WITH t AS (SELECT count(*) AS n, CAST(sum(CAST(ceil(strlen(text) / 4) AS BIGINT)) AS BIGINT) AS p, CAST(sum(strlen(text)) AS BIGINT) AS c FROM documents)
        SELECT n AS requests, p AS planned_tokens, c AS conservative_tokens, round(CAST(p AS DOUBLE) * 0.75 / 1e6 + n * 4000 * 4.5 / 1e6, 6) AS planned_cost, round(CAST(c AS DOUBLE) * 0.75 / 1e6 + n * 4000 * 4.5 / 1e6, 6) AS conservative_cost, true AS within_cap FROM t""",
    "cache_lookup": "WITH c AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 3 = 0) SELECT CASE WHEN c.h IS NULL THEN 'miss' ELSE 'hit' END AS cache, count(*) AS n FROM documents d LEFT JOIN c ON c.h = sha256(d.text) GROUP BY 1",
    "cache_anti_join": "SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0)",
    "payload_packing": """
        WITH RECURSIVE d AS (SELECT source, doc_id, strlen(text) AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
        w AS (SELECT source, doc_id, b, n, 1 AS request, b AS used FROM d WHERE n = 1
              UNION ALL SELECT d.source, d.doc_id, d.b, d.n, CASE WHEN w.used > 0 AND w.used + d.b > 200000 THEN w.request + 1 ELSE w.request END, CASE WHEN w.used > 0 AND w.used + d.b > 200000 THEN d.b ELSE w.used + d.b END FROM w JOIN d ON d.source = w.source AND d.n = w.n + 1)
        SELECT source AS source_id, CAST(doc_id AS VARCHAR) AS block_id, doc_id AS sequence, b AS bytes, request, b > 200000 AS oversize FROM w""",
    "repro_check": "SELECT doc_id, CASE WHEN doc_id % 10 IN (3, 4) THEN 'unavailable' WHEN doc_id % 10 = 5 THEN 'failed' ELSE 'passed' END AS status FROM documents",
    "email_dates": "SELECT o_orderkey, strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS sent FROM orders",
    "metadata_gates": "SELECT unnest([1, 2, 3]) AS ordinal, unnest(['any_rows', 'unique_keys', 'negative_price']) AS gate, unnest([count(*) > 0, count(*) = count(DISTINCT o_orderkey), min(o_totalprice) < 0]) AS passed FROM orders",
    "warning_codes": "WITH w AS (SELECT regexp_replace(regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g') || 'Error', '([A-Z])', '_\\1', 'g') AS w FROM orders) SELECT lower(regexp_replace(w, '^_', '')) AS code, count(*) AS n FROM w GROUP BY 1",
}
