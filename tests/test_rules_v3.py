from decimal import Decimal

import pytest
from factloom.operators import rules_v3
from pyspark.sql import functions as F

TEXTS = [
    "The delivery team will publish guidance.",
    "The weather will improve soon.",
    "We have now met our commitments against 3 of the 5 actions in this plan.",
    "Items: 1. Publish the yearly\nreport for all. 2. The weather is fine today.",
    "The office has committed up to £2.5 million to Solar Renewal Programme.",
    "The launch of New Harbour Fund: the office has committed GBP 40,000.",
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [("S", f"B{i}", i, "page_text", t, "page", str(i)) for i, t in enumerate(TEXTS)]
    blocks = spark.createDataFrame(rows, "source_id string, block_id string, sequence int, block_type string, text string, location_type string, location_value string")
    titles = spark.createDataFrame([("S", "CP 123 - Digital Action Plan - March 2024: progress")], "source_id string, title string")
    facts, _ = rules_v3.extract(blocks, titles)
    return facts.collect()


def of(found, block):
    return [f for f in found if f.block_id == block]


def test_weak_commitments_need_an_actor_and_an_action(found):
    (fact,) = of(found, "B0")
    assert (fact.predicate, fact.rule_id) == ("commitment", rules_v3.RULES["commitment"])
    assert of(found, "B1") == []


def test_ratio_and_numbered_items_belong_to_the_policy(found):
    ratio = [f for f in of(found, "B2") if f.rule_id == rules_v3.RULES["ratio"]]
    assert [(f.subject_text, f.value_text) for f in ratio] == [("Digital Action Plan", "3 of 5 actions met")]
    (item,) = [f for f in of(found, "B3") if f.rule_id == rules_v3.RULES["numbered"]]
    assert (item.subject_text, item.raw_value, item.qualifiers) == ("Digital Action Plan recommendation 1", "Publish the yearly report for all.", {"recommendation_id": "1"})
    assert item.text_excerpt in TEXTS[3]


def test_committed_budgets(found):
    budgets = {f.block_id: f for f in found if f.rule_id == rules_v3.RULES["budget"]}
    assert (budgets["B4"].subject_text, budgets["B4"].value_number, budgets["B4"].value_currency) == ("Solar Renewal Programme", Decimal(2500000), "GBP")
    assert (budgets["B5"].subject_text, budgets["B5"].value_number) == ("New Harbour Fund", Decimal(40000))
    assert budgets["B5"].qualifiers == {"budget_status": "committed"}


def test_policy_subject(spark):
    for title, expected in (("Housing strategy: annex", "Housing strategy"), ("A report", None), (None, None), ("AB 12 – Long Policy Framework – Plan policy", "Long Policy Framework")):
        row = spark.createDataFrame([(title,)], "t string").select(rules_v3.policy_subject(F.col("t")).alias("v")).first()
        assert row.v == expected
