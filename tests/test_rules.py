from decimal import Decimal

import pytest
from factloom.operators import rules, segmentation

CASES = [
    ("Recommendation 12: Publish quarterly progress reports.", ["recommendation"]),
    ("The oversight team recommends that services publish reports.", ["recommendation"]),
    ("The delivery programme will not publish personal records.", ["commitment"]),
    ("The civic service must publish progress updates.", ["requirement"]),
    ("The oversight board approved the new process.", ["decision"]),
    ("The oversight board proposed to approve the process.", []),
    ("The renewal project faces a risk of supplier delay.", ["risk"]),
    ("42% of surveyed residents used the civic service in March 2026.", ["metric"]),
    ("Adoption rate was 40% while completion rate was 60% in 2026.", []),
    ("The survey covered 1,204 participants in 2025.", ["metric"]),
    ("The renewal programme has an approved budget of GBP 2.5 million.", ["budget", "decision"]),
    ("The renewal programme has a budget of about GBP 2 million.", []),
    ("Action A-7 is completed.", ["action_status"]),
    ("Delivery plan: 3 of 5 actions were completed.", ["action_status"]),
]


def blocks(spark, texts, kind="page_text"):
    rows = [("S1", f"B{i:04d}", i, kind, t, "page", str(i)) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "source_id string, block_id string, sequence int, block_type string, text string, location_type string, location_value string")


@pytest.fixture(scope="module")
def found(spark):
    facts, warnings = rules.extract(blocks(spark, [t for t, _ in CASES]))
    return facts.collect(), {r.warning for r in warnings.collect()}


def test_each_sentence_gives_its_predicates(found):
    facts, _ = found
    for i, (text, expected) in enumerate(CASES, 1):
        assert sorted(f.predicate for f in facts if f.block_id == f"B{i:04d}") == expected, text


def test_values_subjects_and_qualifiers(found):
    by = {f.block_id: f for f in found[0] if f.predicate != "decision"}
    assert (by["B0001"].subject_text, by["B0001"].qualifiers) == ("Recommendation 12", {"recommendation_id": "12"})
    assert by["B0003"].raw_value == "will not publish personal records." and by["B0003"].subject_type == "programme"
    metric = by["B0008"]
    assert metric.value_number == Decimal(42) and metric.subject_text == "surveyed residents"
    assert metric.qualifiers == {"metric_name": "surveyed_residents_percentage", "unit": "percent", "population": "surveyed residents", "period": "2026-03"}
    assert by["B0010"].value_number == 1204 and by["B0010"].qualifiers["metric_name"] == "participants_count"
    budget = by["B0011"]
    assert (budget.value_number, budget.value_currency, budget.qualifiers) == (Decimal(2500000), "GBP", {"budget_status": "approved"})
    assert by["B0013"].qualifiers == {"action_id": "A-7"} and by["B0013"].raw_value == "completed"
    assert by["B0014"].raw_value == "3 of 5 actions were completed"


def test_every_fact_quotes_its_evidence(found):
    for f in found[0]:
        assert f.subject_text in f.text_excerpt and f.raw_value in f.text_excerpt


def test_abstentions_are_warned_of(found):
    codes = {w.split(":")[0] for w in found[1]}
    assert {"abstained_multiple_values", "abstained_ambiguous_relationship"} <= codes


def test_heading_context_and_table_risk(spark):
    facts, _ = rules.extract(blocks(spark, ["Civic Office\nwill publish guidance."]))
    (fact,) = facts.collect()
    assert (fact.subject_text, fact.confidence, fact.text_excerpt) == ("Civic Office", 0.7, "Civic Office\nwill publish guidance.")
    facts, _ = rules.extract(blocks(spark, ["Renewal Project | risk of supplier delay"], "table"))
    (fact,) = facts.collect()
    assert (fact.confidence, fact.evidence_status, fact.review_status) == (0.5, "ambiguous", "required")


def test_statement_offsets_point_into_the_block(spark):
    text = "  Title Here\r\nFirst one. Second one!  \"Third\" one\n\n indented é line. Next"
    rows = segmentation.statements(blocks(spark, [text])).collect()
    assert [r.text for r in rows] == ["First one.", "Second one!", '"Third" one', "indented é line.", "Next"]
    assert all(text[r.start : r.end] == r.text for r in rows)
    assert rows[0].context == "Title Here" and rows[3].context is None


def test_evidence_that_is_too_long_is_refused(spark):
    facts, warnings = rules.extract(blocks(spark, ["The board will " + "publish " * 40 + "it."]))
    assert facts.count() == 0 and warnings.first().warning.startswith("abstained_evidence_too_long")


def test_empty_and_null_blocks(spark):
    facts, warnings = rules.extract(blocks(spark, ["", None, "   \n "]))
    assert facts.count() == 0 and warnings.count() == 0


def test_budget_reads_its_currency_once(spark):
    """The parts of an amount, and what stands before and behind it, come from one match over the text."""
    texts = ["The renewal programme has an approved budget of up to £2.5m.", "Funding of 5 million EUR was allocated to the Harbour Project.", "The civic service received funding of USD 1,200."]
    rows = blocks(spark, texts)
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        found = rules.outcomes(segmentation.statements(rows), ["budget"])
        plan = found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "(.*?)(?:(up" not in plan and "^.*?(?:(up" not in plan
    got = [(r.raw_value, r.subject_text, r.value_number, r.value_currency, r.qualifiers) for r in found.orderBy("block_id").collect()]
    assert got == [
        ("up to £2.5m", "The renewal programme", Decimal(2_500_000), "GBP", {"budget_status": "ceiling"}),
        ("5 million EUR", "the Harbour Project", Decimal(5_000_000), "EUR", {}),
        ("USD 1,200", "The civic service", Decimal(1200), "USD", {}),
    ]


def test_statements_are_asked_for_the_words_of_a_rule_first(spark):
    """Every rule names words without which none of its patterns is tried; letters that patterns take for ASCII ones count as these."""
    from factloom.operators import rules_v2

    assert all(make().words for matchers in (rules.MATCHERS, rules_v2.MATCHERS) for make in matchers.values())
    odd = ["The civic service muſt publish progress updates.", "The oversight board wİll publish it.", "The renewal project faces a rısK of supplier delay."]
    for outcomes, statements in ((rules.outcomes, segmentation.statements), (rules_v2.outcomes, segmentation.statements_v2)):
        made = outcomes(statements(blocks(spark, odd))).select("block_id", "predicate").distinct().orderBy("block_id").collect()
        assert [tuple(r) for r in made] == [("B0001", "requirement"), ("B0002", "commitment"), ("B0003", "risk")]
