import pytest
from factloom.operators import rules_v4
from pyspark.sql import functions as F

TEXTS = [
    "Published by the Northern Harbour Authority.",
    "The harbour council will now publish guidance.",
    "We will implement the reform plan this year.",
    'The reporter said: "we will launch the new fund."',
    "The Harbour Service Board will seek new members for the panel.",
    "The harbour council plans to open offices.",
    "We will improve.",
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [("S", f"B{i}", i, "page_text", t, "page", str(i)) for i, t in enumerate(TEXTS)]
    blocks = spark.createDataFrame(rows, "source_id string, block_id string, sequence int, block_type string, text string, location_type string, location_value string")
    documents = spark.createDataFrame([("S", "A report", ["Smith, John", "NHA"], {"producer": "Microsoft Word Group"})], "source_id string, title string, authors array<string>, metadata map<string,string>")
    facts, _, trace = rules_v4.extract(blocks, documents)
    return {f.block_id: f for f in facts.collect() if f.predicate == "commitment"}, {t.block_id: t for t in trace.collect()}


def test_values_lose_an_affirmative_will_and_keep_intent(found):
    facts, _ = found
    assert (facts["B1"].subject_text, facts["B1"].value_text, facts["B1"].rule_id) == ("The harbour council", "Now publish guidance.", rules_v4.RULES["value"])
    assert facts["B5"].value_text == "Plans to open offices."


def test_filtered_commitments_come_back_with_a_trusted_actor(found):
    facts, trace = found
    assert (facts["B2"].subject_text, facts["B2"].subject_type, facts["B2"].rule_id) == ("Northern Harbour Authority", "organisation", rules_v4.RULES["recovered"])
    assert facts["B4"].rule_id == rules_v4.RULES["recovered"] and facts["B4"].value_text == "Seek new members for the panel."
    assert trace["B6"].rejected == "unsafe_or_ambiguous_parent_completion" or trace["B6"].rejected == "ineligible_action"
    assert "B3" not in facts and "B6" not in facts


def test_sentence_ends(spark):
    text = "x will spend 2.5 million (see p. 4) on Dr. Lee and others. Next"
    cases = [
        (text[2:10], text[10:], " 2.5 million (see p. 4) on Dr. Lee and others."), ("will do", "\n1. Item", None), ("will do", "\nHEADING", None), ("will", " do it", None), ("will do it!", " x", ""), ("will do it.", "", ""),
        ("will do it.", "5 x.", "5 x."), ("will ask Dr.", " Lee.", " Lee."), ("will do (as", " said. Here) more. Then", " said. Here) more."), ("will do", "\nand more words.", "\nand more words."), ("will do", "\n\nTitle Line Here\nx.", None),
        ("will do", "\nTitle Line Here.\nx.", "\nTitle Line Here."), ("will do", " (a (b. c) d) e? f.", " (a (b. c) d) e?"), ("will do", " (open. x.", None), ("will do", " it" + " x" * 300 + ".", None), ("will do", ") it.", ") it."),
    ]
    cases[0] = (cases[0][0], cases[0][1], text[10:].removesuffix(" Next"))
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "known string, rest string")
    assert [r[0] for r in df.select(rules_v4.completed(F.col("known"), F.col("rest"))).collect()] == [c for _, _, c in cases]


def test_plain_values(spark):
    cases = [("will not go", "Will not go", "negation_preserved"), ("will take forward the recommendation to publish all the data", "Publish all the data", "safe_recommendation_wrapper_collapsed"), ("will take forward the recommendation to do it", "Will take forward the recommendation to do it", "unsafe_wrapper_preserved"), ("commits to x", "Commits to x", "intent_or_planning_preserved")]
    df = spark.createDataFrame([(a,) for a, _, _ in cases], "v string")
    value, how = rules_v4.plain_value(F.col("v"))
    assert [tuple(r) for r in df.select(value, how).collect()] == [(b, c) for _, b, c in cases]


def test_organisations(spark):
    cases = [("the Northern Harbour Authority.", "Northern Harbour Authority"), ("Smith, John Office", None), ("Microsoft Word Group", None), ("NHA BOARD", None), ("Board", None), ("Office of the", None)]
    df = spark.createDataFrame([(a,) for a, _ in cases], "v string")
    assert [r[0] for r in df.select(rules_v4.organisation(F.col("v"))).collect()] == [b for _, b in cases]


def test_a_block_is_searched_once_for_its_excerpt(spark):
    row = spark.createDataFrame([("We", "Intro. We will act.", "We will act.", 1, "A Board", "authors_or_senders", "other")], "subject_text string, _block string, text_excerpt string, actors int, actor string, method string, subject_type string")
    plan = rules_v4._resolved(row)._jdf.queryExecution().analyzed().toString()
    assert plan.count("replace(_block") == 1 and plan.count("instr(_block") == 1
