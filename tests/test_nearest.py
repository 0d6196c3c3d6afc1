import random
import sys
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, __file__.rpartition("/")[0])
import oracle
from factloom import storage
from factloom.operators import comparison, matching, nearest
from factloom.plans import contract_queries
from pyspark.sql import Window
from pyspark.sql import functions as F

FACT = "source_id string, predicate string, subject_text string, subject_type string, value_type string, value_text string, value_number decimal(38,9), value_currency string, qualifiers map<string,string>, raw_value string"


def facts(spark, n, name, seed, sources=2):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        kind = pick.choice(["number", "number", "text"])
        quals = {k: pick.choice("xy") for k in pick.sample(["unit", "period", "scope"], pick.randrange(3))}
        rows.append((f"{name}{i:04d}", f"S{pick.randrange(sources)}", pick.choice(["metric", "finding"]), pick.choice(["Alpha", "alpha.", "Beta", None]), pick.choice(["metric", "risk"]), kind, pick.choice(["p", "q"]) if kind == "text" else None, Decimal(pick.randrange(3)) if kind == "number" else None, None, quals, "r"))
    return spark.createDataFrame(rows, ("candidate_id" if name == "c" else "annotation_id") + " string, " + FACT)


def compared(candidates, gold):
    c, g = matching.keyed(candidates), matching.keyed(gold)
    every = g.select("annotation_id", "source_id", "predicate").join(c.select("candidate_id", "source_id", "predicate"), ["source_id", "predicate"]).select("annotation_id", "candidate_id")
    return matching.facts_with(every, c, g)


def test_nearest_equal_comparing_every_two(spark):
    candidates, gold = facts(spark, 150, "c", 1), facts(spark, 60, "g", 2, sources=3)
    rows = compared(candidates, gold).withColumn("reasons", F.when(F.col("candidate_id").isNotNull(), matching._differences()))
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("annotation_id").orderBy(F.size("reasons"), "candidate_id"))).where("n <= 3")
    got = matching.closest(candidates, gold)
    assert sorted((r.annotation_id, r.rank, r.candidate_id, r.reasons) for r in got.collect()) == sorted((r.annotation_id, r.n, r.candidate_id, r.reasons) for r in want.collect())


def test_all_that_agree_most_equal_comparing_every_two(spark):
    candidates, gold = facts(spark, 150, "c", 3), facts(spark, 60, "g", 4, sources=3)
    rows = comparison.pair_reasons(compared(candidates, gold).where("candidate_id IS NOT NULL"))
    want = rows.withColumn("b", F.max("score").over(Window.partitionBy("annotation_id"))).where("score = b")
    got = comparison.closest_by_score(candidates, gold)
    assert sorted((r.annotation_id, r.candidate_id, r.score) for r in got.collect()) == sorted((r.annotation_id, r.candidate_id, r.score) for r in want.collect())
    assert comparison.closest_by_score(candidates.limit(0), gold).count() == 0


def test_rows_joined_are_bounded_by_annotations(spark):
    gold = facts(spark, 20, "g", 6, sources=1)
    few, many = (matching.keyed(facts(spark, n, "c", 7, sources=1)) for n in (300, 3000))
    size = lambda c: nearest.few_nearest(c, matching.keyed(gold), ["source_id", "predicate"], 3).count()
    bound = 20 * 3 * 2 * 2 * 16  # of k, with or without qualifiers, with or without a subject, for each subset
    assert size(few) <= bound and size(many) <= bound and size(many) < 1.5 * size(few)


def test_small_and_large_groups_give_the_same(spark, monkeypatch):
    candidates, gold = facts(spark, 40, "c", 8), facts(spark, 30, "g", 9, sources=3)
    found = []
    for few in (0, 8, 1000):
        monkeypatch.setattr(nearest, "FEW", few)
        ranked = sorted((r.annotation_id, r.rank, r.candidate_id, r.reasons, r.category) for r in matching.closest(candidates, gold).collect())
        best = sorted((r.annotation_id, r.candidate_id, r.score, r.reasons) for r in comparison.closest_by_score(candidates, gold).collect())
        found.append((ranked, best))
    assert found[0] == found[1] == found[2]


def test_nothing_that_grows_is_broadcast(spark, monkeypatch):
    """Spark takes keys and arrays for as small as the files that they come from."""
    candidates, gold = storage.written(facts(spark, 40, "c", 8), "c"), storage.written(facts(spark, 30, "g", 9), "g")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(nearest, "FEW", 1000, raising=False)
    found = [matching.closest(candidates, gold), comparison.closest_by_score(candidates, gold)]
    assert not any("BroadcastHashJoin" in plan(x) for x in found)
    c, g = matching.keyed(candidates), matching.keyed(gold)
    few = plan(nearest.few_nearest(c, g, ["source_id", "predicate"], 3))
    assert "BroadcastHashJoin [source_id" not in few and "SortMergeJoin [source_id" in few


def test_small_groups_make_no_bucket(spark, monkeypatch):
    monkeypatch.setattr(nearest, "candidate_buckets", None)
    candidates, gold = facts(spark, 20, "c", 8, sources=5), facts(spark, 30, "g", 9, sources=6)
    assert matching.closest(candidates, gold).count() >= 30 and comparison.closest_by_score(candidates, gold).count() > 0


def test_alike_facts_are_judged_once(spark, monkeypatch):
    """Whatever the number of facts, buckets are made for three candidates and one annotation of each form."""
    monkeypatch.setattr(nearest, "FEW", 0)
    seen, made = [], nearest.few_nearest
    monkeypatch.setattr(nearest, "few_nearest", lambda c, g, on, most: seen.append((c.count(), g.count())) or made(c, g, on, most))
    candidates, gold = facts(spark, 4, "c", 8, sources=1), facts(spark, 4, "g", 8, sources=1)
    times = lambda rows, key: rows.crossJoin(spark.range(30)).withColumn(key, F.concat_ws("-", key, F.lpad(F.col("id").cast("string"), 2, "0"))).drop("id")
    found = matching.closest(times(candidates, "candidate_id"), times(gold, "annotation_id"))
    assert found.count() > 120 and seen[0][0] <= 4 * 3 and seen[0][1] <= 4
    rows = compared(times(candidates, "candidate_id"), times(gold, "annotation_id")).withColumn("reasons", F.when(F.col("candidate_id").isNotNull(), matching._differences()))
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("annotation_id").orderBy(F.size("reasons"), "candidate_id"))).where("n <= 3")
    assert sorted((r.annotation_id, r.rank, r.candidate_id, r.reasons) for r in found.collect()) == sorted((r.annotation_id, r.n, r.candidate_id, r.reasons) for r in want.collect())


@pytest.mark.parametrize("few", [0, 32, 1000])
def test_parts_are_compared_with_all_of_their_brand(spark, tmp_path, monkeypatch, few):
    """Whatever their sizes and the remainders of their keys; parts without a brand with each other."""
    monkeypatch.setattr(nearest, "FEW", few)
    pick = random.Random(11)
    parts = [(n, pick.choice(["A", "A", "A", "B", None]), pick.choice([1, 2, 3, None])) for n in range(0, 1000, 7)] + [(1001, "C", 1), (1002, "D", None), (1005, "D", 4)]
    pq.write_table(pa.table(dict(zip(["p_partkey", "p_brand", "p_size"], zip(*parts, strict=True), strict=True))), tmp_path / "part.parquet")

    def near(n, brand, size):
        found = []
        for k, b, z in parts:
            if b == brand:
                subject, kind, unit, value = k % 2 != 0, k % 3 == 0, k % 5 == 0, z != size
                category = "different_fact" if subject and value else "subject_mismatch" if subject else "value_mismatch" if value else "qualifier_mismatch" if kind or unit else "match"
                found.append((subject + kind + unit + value, k, category))
        return [(f"A{n:08d}", i, f"K{k:08d}", m, c) for i, (m, k, c) in enumerate(sorted(found)[:3], 1)]

    got = contract_queries.nearest_candidates(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(x for p in parts for x in near(*p))
    assert oracle.differences(spark, str(tmp_path), contract_queries.nearest_candidates, contract_queries.ORACLES["nearest_candidates"]) is None
