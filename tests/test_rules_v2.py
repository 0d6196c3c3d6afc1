import pytest
from factloom.operators import rules_v2, segmentation

CASES = [
    ("Civic Office\nwill publish guidance.", [("commitment", "Civic Office", 0.7)]),
    ("Civic Office\nDelivery Team\nwill publish guidance.", []),
    ("The delivery programme has committed to publish reports.", [("commitment", "The delivery programme", 0.9)]),
    ("The delivery programme will be late.", []),
    ("Goodwill matters here.", []),
    ("The board must publish it.", [("requirement", "The board", 0.9)]),
    ("The board is not required to publish it.", []),
    ("Satisfaction rate may be 40% or 60%.", [("metric", "Satisfaction rate", 0.5), ("metric", "Satisfaction rate", 0.5)]),
    ("Access rate and Completion rate may be 40% or 60%.", []),
    ("Completion rate was 45% in 2024.", [("metric", "Completion rate", 0.9)]),
    ("1. The council approved the plan.", [("decision", "The council", 0.9)]),
    ("The rollout project is on track.", [("action_status", "The rollout project", 0.9)]),
    ("The weather is on track.", []),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [("S", f"B{i:02d}", i, "page_text", t, "page", str(i)) for i, (t, _) in enumerate(CASES)]
    blocks = spark.createDataFrame(rows, "source_id string, block_id string, sequence int, block_type string, text string, location_type string, location_value string")
    facts, warnings = rules_v2.extract(blocks)
    return facts.collect(), [w.warning for w in warnings.collect()], blocks


def test_sentences_of_the_second_engine(found):
    for i, (text, expected) in enumerate(CASES):
        got = sorted((f.predicate, f.subject_text, f.confidence) for f in found[0] if f.block_id == f"B{i:02d}")
        assert got == sorted(expected), text


def test_readings_are_for_review_and_bounds_are_warned_of(found):
    two = [f for f in found[0] if f.block_id == "B07"]
    assert {int(f.value_number) for f in two} == {40, 60} and {f.review_status for f in two} == {"required"} and {f.evidence_status for f in two} == {"ambiguous"}
    codes = {(w.split(":")[0], w.split(":")[1]) for w in found[1]}
    assert {("abstained_ambiguous_metric_bounds_exceeded", "B08"), ("abstained_commitment_ambiguous_heading_context", "B01"), ("abstained_commitment_copular_or_passive", "B03"), ("abstained_action_status_ineligible_subject", "B12")} <= codes


def test_qualifiers_and_evidence(found):
    by = {f.block_id: f for f in found[0]}
    assert by["B09"].qualifiers == {"metric_name": "completion_rate", "unit": "percent", "period": "2024"}
    assert by["B00"].text_excerpt == "Civic Office\nwill publish guidance." and by["B02"].rule_id == rules_v2.EXPLICIT_RULE
    assert [r.text for r in segmentation.statements_v2(found[2]).where("block_id = 'B10'").collect()] == ["1. The council approved the plan."]
