import json
from decimal import Decimal

import pytest
from factloom.functions import keys, numbers, text
from factloom.operators import answers, matching, model_calls, registry, reports, retrieval, validation
from pyspark.sql import functions as F


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"])
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(("a", "b", "same"), [("ＡＢＣ", "abc", True), ("Straße", "STRASSE", True), ("‘x’ “y”", "'x' \"y\"", True), ("a — b", "a - b", True), ("a   b.", "A b", True), ("a", "b", False)])
def test_comparison_form(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select((text.comparable(F.col("a")) == text.comparable(F.col("b"))).alias("v")).first().v is same


def test_value_keys(spark):
    df = spark.createDataFrame([("number", None, Decimal("4.0"), None), ("number", None, Decimal("4"), None), ("number", None, Decimal("12.50"), None), ("money", None, Decimal("100"), "gbp"), ("date", "2028-03", None, None)], "t string, x string, n decimal(38,9), c string")
    got = [r.v for r in df.select(keys.value_key(F.col("t"), F.col("x"), F.col("n"), F.col("c")).alias("v")).collect()]
    assert got == ["number|4", "number|4", "number|12.5", "money|100|GBP", "date|2028-03"]


def test_small_functions(spark):
    assert one(spark, text.normalise_lines(F.col("a")), a="\n\n x \r\ny\t\r z\n\n") == " x\ny\n z"
    assert one(spark, text.citations(F.col("a")), a="see [S1:B2] and [S-3:x.y], not [z]") == ["S1:B2", "S-3:x.y"]
    assert one(spark, text.message_ids(F.col("a")), a="<a@b> junk <c@d>") == ["<a@b>", "<c@d>"]
    assert one(spark, text.error_code(F.col("a")), a="UnicodeDecodeError") == "unicode_decode_error"
    assert one(spark, text.safe_message(F.col("a")), a="cannot open\n /root/data/x.pdf now") == "cannot open x.pdf now"
    assert one(spark, numbers.common_subsequence(F.array(*map(F.lit, "abcbd")), F.array(*map(F.lit, "bdcab")))) == 3
    assert one(spark, numbers.common_subsequence(F.array(*map(F.lit, "ab")), F.array().cast("array<string>"))) == 0
    assert one(spark, keys.document_id(F.col("a"), F.lit("ab" * 32)), a=" s 1_x/ ") == "DOC-S-1_X"
    assert one(spark, keys.block_id(F.lit("D"), F.lit(7))) == "D-B0007"
    assert str(one(spark, numbers.email_date(F.col("a")), a="Tue, 3 Mar 2026 10:00:00 GMT")) == "2026-03-03 10:00:00"
    assert one(spark, numbers.email_date(F.col("a")), a="no date") is None
    assert one(spark, numbers.unit(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, numbers.unit(F.array(F.lit(0.0)))) is None
    assert [one(spark, model_calls.strict_json_problem(F.col("a")), a=a) for a in ('{"a": 1}', '{"a": 1} x', '{"a": 1, "a": 2}', "[1]", "NaN")] == [None, "invalid_json", "invalid_json", "not_an_object", "invalid_json"]


def test_pages(spark):
    for n, pages in ((0, []), (1, [1]), (2, [1, 2]), (5, [1, 3, 5]), (6, [1, 3, 6])):
        assert one(spark, reports.sample_pages(F.lit(n).cast("long"))) == pages
    for zero, total, risk in ((0, 0, "unknown"), (0, 9, "none"), (1, 10, "low"), (4, 10, "medium"), (5, 10, "high")):
        assert one(spark, reports.scan_risk(F.lit(zero), F.lit(total))) == risk


def facts(spark, rows, name):
    full = [(i, "S", s, "metric", p, "raw", "number", None, Decimal(v), None, q) for i, s, p, v, q in rows]
    return spark.createDataFrame(full, f"{name} string, source_id string, subject_text string, subject_type string, predicate string, raw_value string, value_type string, value_text string, value_number decimal(38,9), value_currency string, qualifiers map<string,string>")


def test_strict_matching_with_overlapping_qualifier_groups(spark):
    candidates = facts(spark, [("c1", "X", "metric", "1", {"a": "1", "b": "2"}), ("c2", "x.", "metric", "1.0", {"a": "1"}), ("c3", "X", "metric", "2", {}), ("c4", "Y", "metric", "1", {})], "candidate_id")
    gold = facts(spark, [("g1", "x", "metric", "1", {"a": "1"}), ("g2", "X", "metric", "1", {"a": "1", "b": "2"}), ("g3", "X", "metric", "3", {})], "annotation_id")
    found = {(r.candidate_id, r.annotation_id) for r in matching.strict_matches(candidates, gold).collect()}
    assert found == {("c1", "g2"), ("c2", "g1")}  # the group of more qualifiers comes first
    aligned = {(r.candidate_id, r.annotation_id): r.normalized_value_match for r in matching.value_alignment(candidates, gold).collect()}
    assert aligned == {("c1", "g1"): True, ("c2", "g3"): False}  # by ids; g2 asks for more than c2 has
    assert matching.duplicate_count(candidates.unionByName(candidates)).first().duplicates == 4


def test_kth_candidate_takes_kth_annotation(spark):
    candidates = facts(spark, [(f"c{i}", "X", "metric", "1", {}) for i in range(3)], "candidate_id")
    gold = facts(spark, [(f"g{i}", "X", "metric", "1", {}) for i in range(2)], "annotation_id")
    matches = matching.strict_matches(candidates, gold)
    assert {(r.candidate_id, r.annotation_id) for r in matches.collect()} == {("c0", "g0"), ("c1", "g1")}
    total = matching.metrics(matching.predicate_counts(candidates, gold, matches)).first()
    assert (total.true_positive, total.false_positive, total.false_negative) == (2, 1, 0) and total.recall == 1.0
    empty = matching.metrics(matching.predicate_counts(candidates.limit(0), gold.limit(0), matches.limit(0))).first()
    assert empty.precision is None and empty.f1 is None


def test_registry_contract(spark):
    rows = facts(spark, [("c1", "X", "metric", "1", {"metric_name": "m"}), ("c2", "X", "metric", "1", {"metric_name": " ", "x": "y"}), ("c3", "X", "risk", "1", {}), ("c4", "X", "nothing", "1", {})], "candidate_id")
    found = {(r.candidate_id, r.violation) for r in registry.contract_violations(rows).collect()}
    assert found == {("c2", "missing_qualifier:metric_name"), ("c2", "unknown_qualifier:x"), ("c3", "subject_type"), ("c3", "value_type"), ("c4", "unknown_predicate")}


def test_rank_fusion_breaks_ties_by_block(spark):
    rows = spark.createDataFrame([("S:B1", "S", "B1"), ("S:B2", "S", "B2")], "evidence_id string, source_id string, block_id string")
    lexical = spark.createDataFrame([(1, "S:B1", "S", "B1", 1), (1, "S:B2", "S", "B2", 2)], "qid int, evidence_id string, source_id string, block_id string, lexical_rank int")
    dense = spark.createDataFrame([(1, "S:B1", 2), (1, "S:B2", 1)], "qid int, evidence_id string, dense_rank int")
    found = retrieval.fuse(lexical, dense).orderBy("rank").collect()
    assert [r.evidence_id for r in found] == ["S:B1", "S:B2"] and abs(found[0].score - (1 / 61 + 1 / 62)) < 1e-12
    assert retrieval.evidence(rows, "S:B9").count() == 0


def test_hybrid_search_of_a_toy_corpus(spark):
    rows = spark.createDataFrame([("S:1", "S", "1", "zebra runs fast", [1.0, 0.0]), ("S:2", "S", "2", "common words here", [0.0, 1.0]), ("S:3", "S", "3", "common words there", [0.0, 0.0])], "evidence_id string, source_id string, block_id string, text string, vector array<double>")
    asked = spark.createDataFrame([(1, "zebra", [1.0, 0.1])], "qid int, text string, vector array<double>")
    found = retrieval.hybrid(rows, asked, 3).orderBy("rank").collect()
    assert [r.evidence_id for r in found] == ["S:1", "S:2", "S:3"]
    expected = spark.createDataFrame([(1, "S:1")], "qid int, evidence_id string")
    score = retrieval.evaluate(retrieval.first_ranks(retrieval.hybrid(rows, asked, 3), expected)).first()
    assert (score.hit_at_1, score.mrr) == (1.0, 1.0)


def test_first_ranks_are_of_the_complete_ranking(spark):
    rows = spark.createDataFrame([(f"S:{i:03}", "S", f"{i:03}", "zebra" if i < 150 else "zebra runs along with many other words" if i == 150 else "nothing") for i in range(160)], "evidence_id string, source_id string, block_id string, text string")
    asked = spark.createDataFrame([(1, "zebra"), (2, "zebra"), (3, "zebra"), (4, "unknown"), (5, "zebra")], "qid int, text string")
    expected = spark.createDataFrame([(1, "S:150"), (2, "S:155"), (2, "S:157"), (3, "S:007"), (3, "S:150"), (4, "S:020"), (5, "S:999")], "qid int, evidence_id string")
    scores = retrieval.lexical_scores(rows, asked)
    found = {r.qid: r.first_rank for r in retrieval.complete_first_ranks(scores, rows, expected).collect()}
    assert found == {1: 151, 2: 156, 3: 8, 4: 21, 5: None}
    ranked = retrieval.full_ranks(scores, rows, asked, "rank")
    assert found == {r.qid: r.first_rank for r in retrieval.first_ranks(ranked, expected).collect()}


def test_retrieval_eval_finds_a_passage_below_rank_100(spark, tmp_path):
    from factloom.plans import retrieval_queries

    words = "the quick brown fox jumps"
    docs = [(i, " ".join(reversed(words.split())), "en", "src0", 25) for i in range(120)] + [(120, words + " over a lazy dog" * 50, "en", "src0", 800)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, words)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, [1.0, 0.0]), (120, [1.0, 0.0])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = retrieval_queries.retrieval_eval(spark, str(tmp_path)).first()
    assert (found.questions, found.mrr) == (1, round(1 / 121, 6))
    found = retrieval_queries.hybrid_retrieval_eval(spark, str(tmp_path)).first()
    assert found.questions == 1 and found.mrr > 1 / 121


def test_citations_and_search(spark):
    facts_ = spark.createDataFrame([(1, "risk", "Solar", "late", None), (2, "risk", "Wind", "SOLAR part", "x"), (3, "metric", "solar", "y", "z")], "fact_id int, fact_type string, subject string, statement string, value string")
    assert {r.fact_id for r in answers.search_facts(facts_, "risk", " Solar ").collect()} == {1, 2}
    assert answers.search_facts(facts_).count() == 3
    catalog = spark.createDataFrame([("e1", "S", "B1", "t")], "evidence_id string, source_id string, block_id string, text string")
    cited = facts_.limit(1).withColumn("evidence_ids", F.array(F.lit("e1"), F.lit("e9")))
    row = answers.hydrate(cited, catalog).first()
    assert [e.evidence_id for e in row.evidence] == ["e1"] and row.unknown == ["e9"]


def test_requests_cache_and_responder(spark):
    blocks = spark.createDataFrame([("S", f"B{i}", i, "x" * 40) for i in range(5)], "source_id string, block_id string, sequence long, text string")
    packed = model_calls.pack_blocks(blocks, 100)
    assert sorted((r.sequence, r.request) for r in packed.collect()) == [(0, 1), (1, 1), (2, 2), (3, 2), (4, 3)]
    wanted = model_calls.requests(blocks, packed, "extract", "v1")
    assert wanted.count() == 3 and json.loads(wanted.orderBy("request").first().payload)["blocks"][0]["evidence_id"] == "S:B0"

    def responder(payload):
        if "B4" in payload:
            raise TimeoutError("late")
        return "{}"

    found = model_calls.respond(wanted, responder)
    assert sorted((r.error_class or "") for r in found.collect()) == ["", "", "TimeoutError"]
    cache = found.where("response IS NOT NULL").select("request_sha256", "response")
    assert sorted(r.cache for r in model_calls.cached(wanted, cache).collect()) == ["hit", "hit", "miss"]
    assert model_calls.cache_conflicts(cache, cache.withColumn("response", F.lit("[]"))).count() == 2
    assert model_calls.new_for_cache(cache, cache).count() == 0


def test_violations(spark):
    blocks = spark.createDataFrame([("D", "b1", 1, "page_text", "x", "page", "1", []), ("D", "b2", 3, "odd", " ", "page", "0", [])], "document_id string, block_id string, sequence int, block_type string, text string, location_type string, location_value string, warnings array<string>")
    assert {r.violation for r in validation.block_violations(blocks).collect()} == {"unknown_block_type", "blank_without_warning", "bad_locator"}
    assert [r.violation for r in validation.sequence_violations(blocks).collect()] == ["broken_sequence"]
    cited = spark.createDataFrame([("c", "S", ["e1", "e2"])], "candidate_id string, source_id string, evidence_ids array<string>")
    evidence = spark.createDataFrame([("e1", "S"), ("e2", "T")], "evidence_id string, source_id string")
    assert [r.evidence_id for r in validation.dangling_evidence(cited, evidence).collect()] == ["e2"]
    hashed = spark.createDataFrame([(1, "a", "bad")], "id int, text string, h string")
    assert validation.hash_violations(hashed, "id", "h", keys.fields_digest(F.col("id"), F.col("text"))).count() == 1
