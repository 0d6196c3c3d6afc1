import json
import random

import pytest
from factloom.functions import text
from factloom.operators import agents, comparison, goldset, manifests, outputs, retrieval, validation
from factloom.sources import documents, publish, samples, tables
from pyspark.sql import functions as F


def test_strict_json(spark):
    cases = [('{"a": 1}', None), (' {"a": {"b": [1, 2]}} ', None), ('{"a": 1, "a": 2}', "invalid_json"), ('{"a": {"b": 1, "b": 1}}', "invalid_json"), ('{"a": NaN}', "invalid_json"), ('{"a": -Infinity}', "invalid_json")]
    cases += [('{"a": 1} x', "invalid_json"), ('{"a": 1}{}', "invalid_json"), ("[1]", "invalid_output_shape"), ("1", "invalid_output_shape"), ("", "invalid_json"), (None, "invalid_json"), ("[" * 100_000, "invalid_json")]
    df = spark.createDataFrame(cases, "raw string, code string")
    assert [r[0] for r in df.select(outputs.strict_json_code("raw")).collect()] == [c for _, c in cases]


def test_the_schema_is_strict_and_has_a_variant_for_each_predicate(spark):
    schema = manifests.output_schema(spark)
    assert manifests.schema_problems(schema) == []
    variants = schema["properties"]["candidate_facts"]["items"]["anyOf"]
    assert len(variants) == 20 and len({v["properties"]["predicate"]["const"] for v in variants}) == 20
    broken = json.loads(json.dumps(schema))
    broken["properties"]["warnings"]["default"] = []
    broken["properties"]["candidate_facts"]["items"]["anyOf"][0]["required"].pop()
    broken["properties"]["candidate_facts"]["items"]["anyOf"][1]["additionalProperties"] = True
    assert len(manifests.schema_problems(broken)) == 3 and manifests.schema_problems({"type": "array"}) == ["#: no object"]


def test_prompts_must_say_something():
    assert manifests.plain_asset("a\r\nb\rc") == "a\nb\nc"
    for bad in ("", " \n", "﻿x"):
        with pytest.raises(ValueError):
            manifests.plain_asset(bad)


class TimeoutError_(Exception):
    pass


def test_run_loop_asks_the_cache_first_and_retries(spark, tmp_path):
    from factloom.functions import keys

    def responder(payload):
        marker = tmp_path / payload
        seen = len(list(tmp_path.glob(f"{payload}*")))
        (tmp_path / f"{payload}-{seen}").write_text("x")
        if payload == "flaky" and seen == 0:
            raise TimeoutError(marker)
        if payload == "broken":
            raise KeyError("no")
        return f"reply to {payload}"

    requests = spark.createDataFrame([(i, p) for i, p in enumerate(["known", "new", "flaky", "broken"])], "request_id int, payload string").withColumn("request_sha256", keys.sha256_upper(F.col("payload")))
    cache = requests.where("payload = 'known'").select("request_sha256", F.lit("old reply").alias("response"))
    count = iter(range(100))

    def written(df):
        path = str(tmp_path / f"round{next(count)}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    done = written(manifests.run_with_cache(requests, cache, responder, lambda df: df.withColumn("valid", F.col("response").isNotNull()), "2026-01-01 00:00:00", 2, written))
    found = {r.payload: r for r in done.collect()}
    assert {k: (r.cache, r.attempts, r.response, r.error_class) for k, r in found.items()} == {
        "known": ("hit", 0, "old reply", None), "new": ("miss", 1, "reply to new", None), "flaky": ("miss", 2, "reply to flaky", None), "broken": ("miss", 1, None, "KeyError"),
    }
    assert str(found["new"].recorded_at) == "2026-01-01 00:00:00" and not found["broken"].valid
    records = manifests.provenance(done).collect()
    assert len({r.record_sha256 for r in records}) == 4


@pytest.fixture(scope="module")
def tools(spark):
    embed = agents.hashing_embedder(32)
    records = embed(spark.createDataFrame([(f"S{i % 2}:B{i}", f"S{i % 2}", f"B{i}", t) for i, t in enumerate(["the harbour plan", "a budget of the council", "risk of late delivery", "", "harbour risk"])], "evidence_id string, source_id string, block_id string, text string"))
    facts = spark.createDataFrame([("F1", "risk", "Harbour", "is late", None, ["S0:B2"])], "fact_id string, fact_type string, subject string, statement string, value string, evidence_ids array<string>")
    return lambda: agents.Tools(records, facts, embed)


def test_agent_tools_are_bounded(tools):
    own = tools()
    assert [r.evidence_id for r in own.retrieve_evidence("harbour plan").collect()][0] == "S0:B0"
    assert {r.evidence_id[:2] for r in own.retrieve_evidence("harbour risk", ["S0"], 2).collect()} == {"S0"}
    assert own.search_project_facts("LATE", "risk").count() == 1
    with pytest.raises(KeyError):
        own.read_evidence_block("none")
    with pytest.raises(agents.LimitReached):
        own.search_project_facts()
    with pytest.raises(ValueError):
        tools().retrieve_evidence("x", top_k=6)


def test_agent_runs_end_with_an_answer_or_an_error(tools):
    def policy(step, results):
        if step == 1:
            return "search_project_facts", {"query": "late"}
        if step == 2:
            return "read_evidence_block", {"evidence_id": results[0].first().evidence_ids[0]}
        return {"status": agents.ANSWERED, "evidence_id": results[1].first().evidence_id}

    assert agents.run(tools(), policy) == {"status": "answered", "evidence_id": "S0:B2", "tool_sequence": list(agents.TOOLS[1:])}
    with pytest.raises(agents.LimitReached):
        agents.run(tools(), lambda step, results: ("search_project_facts", {}))
    with pytest.raises(ValueError):
        agents.run(tools(), lambda step, results: ("drop_tables", {}))


def test_embeddings_of_terms(spark):
    embed = agents.hashing_embedder(16)
    rows = {r.id: r.vector for r in embed(spark.createDataFrame([(1, "one two"), (2, "two  ONE"), (3, ""), (4, "other words here")], "id int, text string")).collect()}
    assert rows[1] == rows[2] and rows[3] is None and rows[1] != rows[4] and abs(sum(x * x for x in rows[4]) - 1) < 1e-9


def test_collapsed_offsets(spark):
    rng = random.Random(4)
    cases = ["", " ", "a", " a  b", "a\n\tb c ", "é 日本  x"] + ["".join(rng.choice("ab \n\té") for _ in range(30)) for _ in range(30)]

    def plain(value):
        import re

        at, out = [], []
        for m in re.finditer(r"\S+", value):
            if out:
                out.append(" ")
                at.append(m.start())
            out += m.group()
            at += range(m.start(), m.end())
        return "".join(out), at

    found = spark.createDataFrame([(c,) for c in cases], "t string").select(text.collapsed_offsets(F.col("t")).alias("c")).collect()
    assert [(r.c.text, r.c.offsets) for r in found] == [plain(c) for c in cases]


def test_publishing_is_all_or_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    publish.publish({"a": spark.range(3), "b": spark.range(4)}, folder)
    publish.publish({"a": spark.range(5)}, folder)

    def refuse(tables):
        raise ValueError("wrong")

    with pytest.raises(ValueError):
        publish.publish({"a": spark.range(9), "c": spark.range(9)}, folder, refuse)
    assert [spark.read.parquet(f"{folder}/{n}").count() for n in "ab"] == [5, 4]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a", "b"]


def test_a_failed_move_is_taken_back(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "out")
    publish.publish({"a": spark.range(3), "b": spark.range(4)}, folder)
    real = publish._Files.move

    def move(self, source, target):
        if "_staged" in source and target.endswith("/b"):
            raise publish.Conflict("no")
        real(self, source, target)

    monkeypatch.setattr(publish._Files, "move", move)
    with pytest.raises(publish.Conflict):
        publish.publish({"a": spark.range(8), "b": spark.range(8)}, folder)
    assert [spark.read.parquet(f"{folder}/{n}").count() for n in "ab"] == [3, 4]


def test_write_once_and_checked(spark, tmp_path):
    path = str(tmp_path / "t")
    assert publish.write_once(spark.range(4), path) and not publish.write_once(spark.range(4), path)
    with pytest.raises(publish.Conflict):
        publish.write_once(spark.range(5), path)
    publish.write_checked(spark.range(3), str(tmp_path / "good"), lambda df: df.where("id > 5"))
    with pytest.raises(ValueError):
        publish.write_checked(spark.range(9), str(tmp_path / "bad"), lambda df: df.where("id > 5"))
    assert (tmp_path / "good").exists() and not (tmp_path / "bad").exists()


def test_exclusive_appends(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v string")
    assert publish.append_exclusive(rows(("a", "1"), ("b", "2")), path, "k", "v") == 2
    assert publish.append_exclusive(rows(("a", "1"), ("c", "3"), ("c", "3")), path, "k", "v") == 1
    assert publish.append_exclusive(rows(("a", "1")), path, "k", "v") == 0
    for bad in (rows(("a", "9"), ("d", "4")), rows(("e", "1"), ("e", "2"))):
        with pytest.raises(publish.Conflict):
            publish.append_exclusive(bad, path, "k", "v")
    assert spark.read.option("recursiveFileLookup", "true").parquet(path).count() == 3


def test_sample_corpus_is_fixed_and_parses(spark):
    found = samples.corpus(spark)
    assert samples.mail(3, True) == samples.mail(3, True) and samples.deck([["a", "b"]]) == samples.deck([["a", "b"]])
    parsed = documents.parse(found)
    assert parsed.where("error IS NULL").count() == 8
    blocks = documents.blocks(parsed)
    assert validation.sequence_violations(blocks).count() == 0
    kinds = {r.block_type: r["count"] for r in blocks.groupBy("block_type").count().collect()}
    assert kinds["email_body"] == 6 and kinds["quoted_history"] == 3 and kinds["slide_title"] == 4 and kinds["shape_text"] == 4


def test_broken_lines_are_named(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": }\n{"a": 2}\n[1]\n')
    found = tables.jsonl_problems(spark, str(tmp_path / "x.jsonl"))
    assert [(r.line, r.problem) for r in found.orderBy("line").collect()] == [(2, "blank_line"), (3, "invalid_json"), (5, "not_an_object")]


def test_one_file_for_each_document(spark, tmp_path):
    for name, source in (("a", "S1"), ("b", "S1"), ("c", "S2")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"source_id": source, "document_id": name}))
    found = tables.document_inventory(tables.read_documents(spark, str(tmp_path)), ["S1", "S2", "S3"])
    assert {r.source_id: r.files for r in found.collect()} == {"S1": 2, "S3": 0}


def test_zero_scores_are_ranked(spark):
    rows = spark.createDataFrame([(f"S:B{i}", "S", f"B{i}", t) for i, t in enumerate(["one two", "three", "four", "two"])], "evidence_id string, source_id string, block_id string, text string")
    asked = spark.createDataFrame([(1, "two"), (2, "nothing known")], "qid int, text string")
    found = retrieval.top(retrieval.lexical_scores(rows, asked), rows, 3, asked).collect()
    by = {q: [r.evidence_id for r in sorted(found, key=lambda r: r.rank) if r.qid == q] for q in (1, 2)}
    assert by == {1: ["S:B3", "S:B0", "S:B1"], 2: ["S:B0", "S:B1", "S:B2"]}


def test_gold_values_fit_their_types(spark):
    rows = [("money", None, 1, "GBP", None), ("money", None, 1, None, None), ("number", None, 2, None, None), ("boolean", "TRUE", None, None, None), ("boolean", "x", None, None, None), ("list", None, None, None, ["a"]), ("date", "2024-02-30", None, None, None), ("string", " ", None, None, None)]
    df = spark.createDataFrame(rows, "value_type string, value_text string, value_number int, value_currency string, value_list array<string>")
    assert [r[0] for r in df.select(goldset.value_fits()).collect()] == [True, False, True, True, False, True, False, False]


def test_spans_that_nothing_reaches_into(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 0, 9), ("a", 8, 12), ("a", 9, 10), ("a", 12, 14), ("b", 1, 2)], "k string, start int, end int")
    assert sorted(tuple(r) for r in comparison.non_overlapping(df, "k").collect()) == [("a", 0, 9), ("a", 12, 14), ("b", 1, 2)]


def test_cases_meet_facts_by_the_evidence_they_expect(spark):
    """Not by type alone, which gives as many pairs as cases and facts of a type multiplied."""
    case = "case_id string, category string, expected_evidence_ids array<string>, fixture struct<fact_type:string,query:string>"
    cases = spark.createDataFrame([("a", "structured_fact_search", ["S:1", "S:2"], ("t", " Two ")), ("b", "structured_fact_search", ["S:9"], ("t", "two")), ("c", "evidence_inspection", ["S:1"], ("u", "one"))], case)
    facts = spark.createDataFrame([("f1", "x", "t", "one", "", "", ["S:1"]), ("f2", "x", "t", "two", "", "", ["S:3", "S:2"]), ("f3", "x", "t", "two", "", "", ["S:1"])], "fact_id string, case_id string, fact_type string, subject string, statement string, value string, evidence_ids array<string>")
    hits = spark.createDataFrame([], "case_id string, rank int, evidence_id string")
    from factloom.operators import agents

    done = agents.answer_policy(cases, hits, facts)
    assert {r.case_id: r.evidence_id for r in done.collect()} == {"a": "S:2", "b": None, "c": None}
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join Inner, " in line and "fact_type" in line and "case_id" not in line]
