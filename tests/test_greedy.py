import random

import pytest
from factloom.operators import greedy, model_calls, ordinals
from pyspark.sql import functions as F

EDGES = "k string, t int, l string, r string"


def walked(rows):
    first = {}
    for k, t, l, r in rows:
        first[k, l, r] = min(t, first.get((k, l, r), t))
    used, kept = set(), set()
    for k, t, l, r in sorted((k, t, l, r) for (k, l, r), t in first.items()):
        if (k, 0, l) not in used and (k, 1, r) not in used:
            used |= {(k, 0, l), (k, 1, r)}
            kept.add((k, l, r))
    return kept


@pytest.mark.parametrize("fold", [512, 6])
def test_pairs_of_the_walk(spark, monkeypatch, fold):
    monkeypatch.setattr(greedy, "FOLD", fold)
    pick = random.Random(2)
    rows = [("sparse", pick.randrange(3), f"l{pick.randrange(30):02d}", f"r{pick.randrange(30):02d}") for _ in range(90)]
    rows += [("full", 0, f"l{i}", f"r{j}") for i in range(5) for j in range(7)] + [("one", 1, "a", "b")] * 2
    rows += [("two", (i + j) % 2, f"l{i}", f"r{j}") for i in range(4) for j in range(4)]
    rows += [("chain", 0, f"l{i:02d}", f"r{j:02d}") for i in range(12) for j in (i, i + 1)]
    found = greedy.one_to_one(spark.createDataFrame([*rows, (None, 0, "x", "y")], EDGES))
    got = [tuple(r) for r in found.select("k", "l", "r").collect()]
    assert len(got) == len(set(got)) and set(got) == walked(rows)


def test_one_key_of_a_hundred_thousand_pairs(spark):
    one = spark.range(400).select(F.format_string("l%04d", "id").alias("l")).crossJoin(spark.range(250).select(F.format_string("r%04d", "id").alias("r")))
    pairs = one.select(F.lit("k").alias("k"), F.lit(0).alias("t"), "l", "r")
    # pairs of a better tier first, which leave the rest of a rectangle
    pairs = pairs.unionByName(spark.createDataFrame([("k", -1, f"l{i:04d}", f"r{(i * 3) % 40:04d}") for i in range(0, 40, 2)], EDGES))
    found = greedy.one_to_one(pairs)
    assert {tuple(r) for r in found.select("k", "l", "r").collect()} == walked([tuple(r) for r in pairs.collect()])
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_no_pairs(spark):
    assert greedy.one_to_one(spark.createDataFrame([], EDGES)).count() == 0


def packed(blocks, most):
    out, source, request, used = {}, object(), 0, 0
    for s, seq, block, size in sorted(blocks, key=lambda b: (b[0] is not None, b[0] or "", b[1], b[2])):
        if s != source:
            source, request, used = s, 1, 0
        elif used and used + size > most:
            request, used = request + 1, 0
        used += size
        out[s, block] = (size, request, size > most)
    return out


def test_packing_equals_a_walk(spark):
    pick = random.Random(8)
    rows = [("hot", i, f"b{i:04d}", pick.choice([0, 0, 1, 7, 30, 99, 100, 101, 250])) for i in range(700)]
    rows += [(f"s{i % 5}", i, f"b{i}", pick.randrange(120)) for i in range(60)] + [("zero", i, f"b{i}", 0) for i in range(4)] + [("big", 0, "b", 500), (None, 1, "b1", 60), (None, 2, "b2", 60), ("gap", 1, "a", 0), ("gap", 2, "b", 200), ("gap", 3, "c", 0)]
    df = spark.createDataFrame([(s, q, b, "é" * (n // 2) + "x" * (n % 2) if n else None) for s, q, b, n in rows], "source_id string, sequence int, block_id string, text string")
    found = model_calls.pack_blocks(df, 100)
    assert {(r.source_id, r.block_id): (r.bytes, r.request, r.oversize) for r in found.collect()} == packed(rows, 100)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert model_calls.pack_blocks(df.limit(0)).count() == 0


def test_one_group_is_spread_over_tasks(spark):
    rows = spark.range(20_000).select(F.lit("g").alias("k"), F.col("id").alias("n"), (F.col("id") % 10).alias("v"))
    found = ordinals.running_sums(rows, ["k"], [F.col("n")], "at", {"upto": "v"})
    assert found.where("at <> n + 1").count() == 0
    assert found.agg(F.max("upto")).first()[0] == 90_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert ordinals._dealt(rows, ["k"], [F.col("n")]).select("_part").distinct().count() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
