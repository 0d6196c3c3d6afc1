import random
import re
import sys

from factloom.operators import containment, dense_index, goldset, lexical_index, lexical_parts, ordinals, retrieval
from pyspark.sql import Window
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rpartition("/")[0])


def corpus(spark, n, seed=5):
    pick = random.Random(seed)
    words = [f"w{int(pick.paretovariate(0.6)) % 400}" for _ in range(n * 40)]
    rows = []
    for i in range(n):
        size = pick.choice([0, 1, 3, 8, 20, 60])
        rows.append((f"S{i % 3}:{i:04d}", f"S{i % 3}", f"{i:04d}", " ".join(pick.choices(words, k=size)) or " - "))
    rows += [("S0:tie1", "S0", "tie1", "w1 w2 rare"), ("S0:tie2", "S0", "tie2", "w1 w2 rare"), ("S1:long", "S1", "long", "w1 " * 5000 + "w7"), ("S9:none", "S9", "none", "? !")]
    return spark.createDataFrame(rows, "evidence_id string, source_id string, block_id string, text string")


def asked(spark):
    pick = random.Random(9)
    texts = [" ".join(f"w{pick.randrange(60)}" for _ in range(pick.choice([1, 2, 6, 15]))) for _ in range(25)] + ["rare", "unknown words", "", "w1 rare unknown", "w1 " * 30]
    return spark.createDataFrame(list(enumerate(texts)), "qid long, text string")


def ranks(found):
    return sorted((r.qid, r.rank, r.evidence_id, r.score) for r in found.collect())


def test_pruned_search_gives_the_rows_of_complete_scoring(spark):
    rows, queries = corpus(spark, 400), asked(spark)
    for k in (1, 3, 10):
        whole = retrieval.top(retrieval.lexical_scores(rows, queries), rows, k, queries)
        assert ranks(retrieval.lexical_topk(rows, queries, k)) == ranks(whole)
    some = rows.limit(0)
    assert retrieval.lexical_topk(some, queries, 3).count() == 0


def test_blocks_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(lexical_index, "BLOCK", 64)
    rows = corpus(spark, 1500)
    queries = spark.createDataFrame([(1, "w1 w2 rare"), (2, "w1 rare")], "qid long, text string")
    index = lexical_index.build(rows)
    assert index.parts > 1 and index.records.count() == rows.count()
    words = lexical_index.ask(index, queries)
    held = lexical_index.blocks(index, words)
    least = lexical_index.least_of_best(index, words, held, 2)
    kept = lexical_index.kept_heads(lexical_index.limits(words, held, least), held).agg(F.sum("n")).first()[0]
    every = held.join(words.select("term", "qid"), "term").agg(F.sum("n")).first()[0]
    assert kept < every * 0.7
    assert held.agg(F.max("n")).first()[0] <= 4 * 64
    found = lexical_index.at_least(index, words, held, least)
    assert found.count() < rows.count() / 10


def test_first_ranks_of_the_complete_ranking_with_pruned_scores(spark):
    rows, queries = corpus(spark, 300), asked(spark)
    pick = random.Random(3)
    ids = [r.evidence_id for r in rows.select("evidence_id").collect()]
    expected = spark.createDataFrame([(q, pick.choice(ids)) for q in range(30) for _ in range(pick.randrange(1, 4))] + [(4, "S9:none"), (26, "S9:none"), (29, "not there"), (3, "not there")], "qid long, evidence_id string")
    whole = retrieval.full_ranks(retrieval.lexical_scores(rows, queries), rows, queries, "rank")
    want = {r.qid: r.first_rank for r in retrieval.first_ranks(whole, expected).collect()}
    assert {r.qid: r.first_rank for r in retrieval.lexical_first_ranks(rows, queries, expected).collect()} == want


def test_positions_equal_a_window(spark):
    rows = spark.range(3000).select((F.col("id") % 7).alias("qid"), F.concat(F.lit("e"), "id").alias("evidence_id"), F.pmod(F.xxhash64("id"), F.lit(20)).alias("score"), F.lit("s").alias("source_id"), F.col("id").cast("string").alias("block_id"))
    rows = rows.unionByName(rows.limit(1).withColumn("qid", F.lit(99)))
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(*retrieval._order())))
    got = ordinals.positions(rows, ["qid"], retrieval._order(), "n")
    assert got.exceptAll(want.select(got.columns).withColumn("n", F.col("n").cast("long"))).count() == 0 and got.count() == rows.count()
    assert ordinals.positions(rows.limit(0), ["qid"], retrieval._order(), "n").count() == 0


def test_complete_ranks_use_no_window_over_a_question(spark):
    rows, queries = corpus(spark, 20).withColumn("vector", F.array(F.lit(1.0), F.length("text").cast("double"))), asked(spark).withColumn("vector", F.array(F.lit(1.0), F.lit(2.0)))
    plan = retrieval.hybrid(rows, queries, None)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


PASSAGES = ["the quick brown fox", "fox", "quick", "uick brow", "a", " ", "naïve café au lait, please", "-[x]-", "longunbrokenword" * 4, "PG-V01-S001-001", "brown fox\njumps over", "", None, "zzz the zzz", "日本語の 文章 です"]


def test_containing_equals_comparing_all_with_all(spark):
    pick = random.Random(1)
    texts = [" ".join(pick.choice([p for p in PASSAGES if p] + ["the", "lazy", "dog"]) for _ in range(pick.randrange(1, 8))) for _ in range(60)] + ["", None, "xlongunbrokenword" * 9, "the quick brown foxes", "naïve café au lait, pleased"]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(0, texts[0])], "text_id long, text string")
    p = spark.createDataFrame([(i, x) for i, x in enumerate(PASSAGES)] + [(0, PASSAGES[0])], "passage_id long, passage string")
    found = [(r.passage_id, r.text_id) for r in containment.containing(t, p).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(i, j) for i, x in enumerate(PASSAGES) if x for j, y in enumerate(texts) if y is not None and x in y}
    assert containment.containing(t, p.limit(0)).count() == 0 and containment.containing(t.limit(0), p).count() == 0


def test_leaks_and_containment_plan_no_nested_loop(spark):
    gold = spark.createDataFrame([("PG-V01-S001-001", "held_out", "x" * 50), ("PG-V01-S001-002", "held_out", "short"), ("PG-V01-S001-003", "development", "y" * 60)], "annotation_id string, split string, raw_value string")
    docs = spark.createDataFrame([("d1", "see PG-V01-S001-001 and " + "x" * 51), ("d2", "short PG-V01-S001-003 " + "y" * 60), ("d3", "(PG-V01-S001-002)")], "document string, text string")
    found = goldset.leaks(gold, docs)
    assert {tuple(r) for r in found.select("annotation_id", "document", "what").collect()} == {("PG-V01-S001-001", "d1", "annotation_id"), ("PG-V01-S001-001", "d1", "raw_value"), ("PG-V01-S001-002", "d3", "annotation_id")}
    assert not re.search("NestedLoop|Cartesian", found._jdf.queryExecution().executedPlan().toString())


def vectors(spark, n, clusters=12):
    pick = random.Random(4)
    middles = [[pick.gauss(0, 1) for _ in range(16)] for _ in range(clusters)]
    rows = [(f"E:{i:05d}", "E", f"{i:05d}", [x + pick.gauss(0, 0.15) for x in middles[i % clusters]]) for i in range(n)]
    rows += [("E:zero", "E", "zero", [0.0] * 16), ("E:null", "E", "null", None), ("E:nan", "E", "nan", [float("nan")] * 16), ("E:same", "E", "same", rows[0][3]), ("E:again", "E", "again", [2 * x for x in rows[0][3]])]
    return spark.createDataFrame(rows, "evidence_id string, source_id string, block_id string, vector array<double>")


def test_pruned_dense_search_gives_the_rows_of_comparing_all(spark):
    rows = vectors(spark, 900)
    asked_ = rows.where("block_id < '00040' OR block_id IN ('zero', 'nan', 'again')").select(F.col("block_id").alias("qid"), "vector")
    for k in (1, 7):
        assert ranks(retrieval.dense_topk(rows, asked_, k)) == ranks(retrieval.top(retrieval.dense_scores(rows, asked_), rows, k))
    index = dense_index.build(rows)
    kept = dense_index.kept_rings(index, asked_, 7).agg(F.sum("n")).first()[0]
    assert kept < 0.4 * index.vectors.count() * 41  # the rest is pruned
    assert retrieval.dense_topk(rows.limit(0), asked_, 3).count() == 0 and retrieval.dense_topk(rows.limit(2), asked_, 5).count() == 41 * 2


def test_dense_search_makes_no_row_for_each_copy(spark, monkeypatch):
    monkeypatch.setattr(dense_index, "VECTORS", 100)
    monkeypatch.setattr(dense_index, "QUESTIONS", 30)
    copies = spark.range(400).select(F.format_string("E:c%03d", "id").alias("evidence_id"), F.lit("E").alias("source_id"), F.format_string("c%03d", "id").alias("block_id"), F.array(*[F.lit(x) for x in (0.3, -0.1, 0.7)]).alias("vector"))
    rows = copies.unionByName(spark.createDataFrame([("E:x", "E", "x", [0.3, -0.1, 0.6]), ("E:short", "E", "short", [1.0, 2.0])], copies.schema))
    asked_ = rows.where("block_id < 'c080' OR block_id = 'x'").select(F.col("block_id").alias("qid"), "vector")
    found = dense_index.candidates(dense_index.build(rows), asked_, 3)
    assert found.count() <= 81 * 3 * 8  # not 400 for each question
    assert ranks(retrieval.dense_topk(rows, asked_, 3)) == ranks(retrieval.top(retrieval.dense_scores(rows, asked_), rows, 3))


def test_runs_of_short_pages(spark):
    from factloom.operators import reports

    pages = [("d", p, n) for p, n in enumerate([0, 10, 90, None, 60, 60, 3, 3, 3])] + [("e", 5, 1), ("e", 70, 1), ("f", 1, 99), (None, 1, 0)]
    found = reports.page_runs(spark.createDataFrame(pages, "document string, page long, chars long"))
    assert sorted(tuple(r) for r in found.collect()) == [("d", 0, 1, 2), ("d", 3, 3, 1), ("d", 6, 8, 3), ("e", 5, 70, 2)]


def test_fused_ranks_of_rankings_that_are_not_made(spark, monkeypatch):
    """The rows of the complete fusion, with records and questions in several parts and chunks; no row for each pair."""
    from factloom.operators import fusion

    monkeypatch.setattr(fusion, "RECORDS", 100)
    monkeypatch.setattr(fusion, "QUESTIONS", 9)
    monkeypatch.setattr(retrieval, "FIRST_DEPTH", 4)
    vector = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda d: F.pmod(F.xxhash64(F.substring("block_id", -2, 2), d), F.lit(7)).cast("double") - 3)
    rows = corpus(spark, 300).withColumn("vector", F.when(F.col("block_id") != "0007", vector))
    queries = asked(spark).withColumn("vector", F.when(F.col("qid") != 3, F.array(*[(F.pmod(F.xxhash64("qid", F.lit(d)), F.lit(7)) - 3).cast("double") for d in range(4)])))
    whole = retrieval.hybrid(rows, queries, None)
    for k in (1, 5):
        assert ranks(retrieval.hybrid(rows, queries, k)) == ranks(whole.where(F.col("rank") <= k))
    expected = rows.where(F.pmod(F.xxhash64("evidence_id"), F.lit(40)) == 0).select("evidence_id").crossJoin(queries.select("qid"))
    want = {r.qid: r.first_rank for r in retrieval.first_ranks(whole, expected).collect()}
    assert {r.qid: r.first_rank for r in retrieval.hybrid_first_ranks(rows, queries, expected).collect()} == want
    held = fusion.build(rows, queries)
    assert (held.parts, held.chunks) == (4, 4)


def steps(monkeypatch):
    """The sizes of what lexical searches write between their steps."""
    sizes = {}

    def spied(module, plain):
        def written(rows, name):
            found = plain(rows, name)
            sizes[name] = max(found.count(), sizes.get(name, 0))
            return found

        monkeypatch.setattr(module, "written", written)

    for module in (lexical_index, lexical_parts, retrieval):
        spied(module, module.written)
    return sizes


def copies(spark):
    rows = spark.range(300).select(F.format_string("S:%03d", "id").alias("evidence_id"), F.lit("S").alias("source_id"), F.format_string("%03d", "id").alias("block_id"), F.lit("w1 w2 w3 and more").alias("text"))
    return rows.unionByName(spark.createDataFrame([("S:x", "S", "x", "w1 w2 and nothing else"), ("S:y", "S", "y", "? !")], rows.schema))


def test_lexical_search_makes_no_row_for_each_copy(spark, monkeypatch):
    rows, queries = copies(spark), asked(spark)
    want = ranks(retrieval.top(retrieval.lexical_scores(rows, queries), rows, 3, queries))
    sizes = steps(monkeypatch)
    assert ranks(retrieval.lexical_topk(rows, queries, 3)) == want
    assert max(sizes.values()) <= 302  # not 300 for each question


def test_lexical_first_ranks_make_no_row_for_each_copy(spark, monkeypatch):
    rows, queries = copies(spark), asked(spark)
    expected = queries.select("qid", F.lit("S:x").alias("evidence_id")).unionByName(queries.select("qid", F.lit("S:y").alias("evidence_id")))
    whole = retrieval.full_ranks(retrieval.lexical_scores(rows, queries), rows, queries, "rank")
    want = {r.qid: r.first_rank for r in retrieval.first_ranks(whole, expected).collect()}
    sizes = steps(monkeypatch)
    assert {r.qid: r.first_rank for r in retrieval.lexical_first_ranks(rows, queries, expected).collect()} == want
    assert max(sizes.values()) <= 302


def test_lexical_parts_and_chunks_change_nothing(spark, monkeypatch):
    for name, value in {"RECORDS": 40, "POSTINGS": 900, "QUESTIONS": 9, "ROWS": 7}.items():
        monkeypatch.setattr(lexical_parts, name, value)
    rows = corpus(spark, 300).unionByName(spark.createDataFrame([("n1", None, "n1", "w1 w2 rare"), ("null", "S0", "null", None)], "evidence_id string, source_id string, block_id string, text string"))
    queries = asked(spark)
    index = lexical_parts.build(rows, queries)
    sizes = index.records.groupBy("part").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 41 and sizes[1] >= 8 and index.chunks == 4
    whole = retrieval.full_ranks(retrieval.lexical_scores(rows, queries), rows, queries, "rank")
    best = whole.join(retrieval.lexical_scores(rows, queries), ["qid", "evidence_id"], "left").na.fill(0.0, ["score"]).where("rank <= 10")
    assert ranks(retrieval.lexical_topk(rows, queries, 10)) == ranks(best)
    expected = rows.where(F.pmod(F.xxhash64("evidence_id"), F.lit(30)) == 0).select("evidence_id").unionByName(spark.createDataFrame([("n1",)], "evidence_id string")).crossJoin(queries.select("qid"))
    want = {r.qid: r.first_rank for r in retrieval.first_ranks(whole, expected).collect()}
    assert {r.qid: r.first_rank for r in retrieval.lexical_first_ranks(rows, queries, expected).collect()} == want


def test_only_texts_that_may_contain_a_passage_are_exchanged(spark):
    t = spark.range(500).select(F.col("id").alias("text_id"), F.concat(F.lit("the lazy dog of "), "id").alias("text")).unionByName(spark.createDataFrame([(500, "see the quick brown fox")], "text_id long, text string"))
    found = containment.containing(t, spark.createDataFrame([(1, "the quick brown fox"), (2, "cat")], "passage_id long, passage string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin \[text_id#\d+L?\], \[text_id#\d+L?\], LeftSemi", plan)
    assert [tuple(r) for r in found.collect()] == [(1, 500)]
