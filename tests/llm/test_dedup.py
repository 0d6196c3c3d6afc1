import hashlib
import random
import re

import numpy as np
import pytest
from factloom.llm import components, embedding_dedup, hnsw, line_dedup, minhash, substring_dedup, superminhash
from factloom.llm.queries import op8_line_dedup
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Union:
    def __init__(self, nodes):
        self.p = {n: n for n in nodes}

    def find(self, x):
        while self.p[x] != x:
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choices(words, k=rng.randint(60, 160)) for _ in range(20)]
    rows = [" ".join(b) for b in base]
    for b in base[:10]:
        for _ in range(6):
            c = list(b)
            for _ in range(rng.randint(0, 5)):
                c[rng.randrange(len(c))] = rng.choice(words)
            rows.append(" ".join(c))
    passage = " ".join(rng.choices(words, k=60))
    rows += [" ".join(rng.choices(words, k=40)) + "\n" + passage + "\t" + " ".join(rng.choices(words, k=30)) for _ in range(8)]
    rows += [passage, passage, "one two", "One  TWO", "one", "", None, "the " * 120, "the " * 90, rows[0], rows[0].upper()]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def table(spark):
    rows = texts()
    extra = rows + [(None, rows[3][1]), (4, rows[4][1])]
    return spark.createDataFrame([(a, b, "k", 1, "f") for a, b in extra], "doc_id long, text string, key string, n_removed int, _key string"), rows


def sets_of(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def test_near_duplicates_match_brute_force(table):
    df, rows = table
    sets = sets_of(rows)
    union = Union(sets)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                union.join(a, b)
    found = minhash.near_duplicates(df).collect()
    assert len(found) == len(rows) + 2
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), union.find(r.doc_id), union.find(r.doc_id) == r.doc_id)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_blocks_of_a_large_bucket_lose_no_link(spark, monkeypatch, table):
    df, rows = table
    whole = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect()}
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 2)
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(df, slots=64, bands=64).collect()} == whole


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    both, left, right = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (300, 50, 50))
    elements = np.concatenate([both, left, both, right])
    owner = np.repeat([0, 1], 350)
    s = superminhash.signatures(elements, owner, 3, 256)
    assert abs((s[0] == s[1]).mean() - 0.75) < 0.1 and np.isinf(s[2]).all()
    one = superminhash.signatures(np.array([5], np.uint64), np.array([0]), 1, 16)[0]
    assert sorted(np.floor(one).astype(int)) == list(range(16))  # a permutation of the ranks


@pytest.mark.parametrize("group", [1000, 2])
def test_repeated_windows_match_brute_force(table, group):
    df, rows = table
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    expected = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        expected[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    cleaned = substring_dedup.remove_repeats(df, group=group)
    assert cleaned.columns == ["doc_id", "text", "key", "_key", "n_words", "n_removed"]
    found = substring_dedup.digests(cleaned).collect()
    assert len(found) == len(rows) + 2
    for r in found:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept_sha256) == expected[r.doc_id]
        else:
            assert r.n_removed == 0
    assert sum(v[1] for v in expected.values()) > 500
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_untouched_texts_keep_their_white_space(spark):
    df = spark.createDataFrame([(1, " a  b\n"), (2, None), (3, "")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in substring_dedup.remove_repeats(df).collect()} == {1: " a  b\n", 2: None, 3: ""}


def brute_lines(rows):
    def chunks(text):
        lines = text.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        own, out = [], []
        for i, line in enumerate(lines):
            own.append(line)
            r = (((h[i - 1] if i else 0) % 2**31) * 31 + h[i]) % 2**31
            if r % 3 == 0 or i == len(lines) - 1:
                out.append(own)
                own = []
        return out

    seen, result = set(), {}
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        kept, gone = [], 0
        for c in chunks(t):
            body = "\n".join(c)
            if len(c) >= 2 and body in seen:
                gone += len(c)
            else:
                kept.append(body)
            if len(c) >= 2:
                seen.add(body)
        result[i] = ("\n".join(kept), t.count("\n") + 1, gone)
    return result


def test_line_chunks_match_brute_force(spark):
    rng = random.Random(8)
    lines = [f"line {i} " + "x" * (i % 7) for i in range(60)]
    rows = []
    for i in range(60):
        own = [rng.choice(lines) for _ in range(rng.randint(1, 12))]
        at = rng.randrange(50)
        rows.append((i, "\n".join([*own, *lines[at : at + rng.randint(0, 10)]])))
    rows += [(60, ""), (61, "\n\n"), (62, rows[0][1]), (63, "é\n日本\n" * 40)]
    df = spark.createDataFrame([(a, b, "k", 3, "c") for a, b in [*rows, (64, None), (None, rows[1][1])]], "doc_id long, text string, _key string, n_lines int, _row string")
    found = line_dedup.remove_repeated_chunks(df)
    assert found.columns == ["doc_id", "_key", "_row", "text", "n_lines", "n_removed"]
    expected = brute_lines(rows)
    assert sum(v[2] for v in expected.values()) > 20
    for r in found.collect():
        if r.doc_id is None or r.doc_id == 64:
            assert r.n_removed == 0 and r.text == (rows[1][1] if r.doc_id is None else None)
        else:
            assert (r.text, r.n_lines, r.n_removed) == expected[r.doc_id]
    assert line_dedup.remove_repeated_chunks(df.limit(0)).count() == 0
    both = line_dedup.remove_repeated_chunks(df, out="clean")
    assert both.columns[-3:] == ["clean", "n_lines", "n_removed"] and "text" in both.columns


def test_line_dedup_runs_no_python(spark, tmp_path):
    spark.createDataFrame([(1, "a\nb")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = op8_line_dedup(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def vectors():
    rng = np.random.default_rng(2)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        rows += [centre + rng.normal(size=16) * 0.05 for _ in range(25 if c else 120)]
    rows += list(rng.normal(size=(200, 16)))
    rows += [rows[0], rows[0], rows[5] * 3]
    return [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(len(rows)), rows, strict=True)]


def test_embeddings_match_brute_force(spark):
    rows = vectors()
    odd = [(9000, None), (9001, [0.0] * 16), (9002, [1.0, None] + [0.0] * 14), (9003, [float("nan")] * 16), (9004, []), (9005, [1.0, 2.0]), (9006, [2.0, 4.0]), (None, rows[0][1]), (9007, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows + odd], "vec_id long, embedding array<float>, key int, vector string")
    x = np.array([v for _, v in sorted(rows)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    union = Union(range(len(rows)))
    for a, b in zip(*np.nonzero(near), strict=True):
        union.join(int(a), int(b))
    found = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, shards=3).collect()}
    assert len(found) == len(rows) + len(odd)
    for i in range(len(rows)):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (int(near[i].sum()), union.find(i), union.find(i) == i)
    for i in (9000, 9001, 9002, 9003, 9004, 9007):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert found[9005].n_links == 1 and found[9006].component_id == 9005
    assert found[None].component_id is None and found[None].n_links == 0
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_graph_recall_and_round_trip():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph.load(hnsw.Graph(x).dump())
    node, sim = graph.search(x[:200], 64)
    truth = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b.tolist())) / 10 for a, b in zip(truth, node, strict=True)]) > 0.9
    assert (node[:, 0] == np.arange(200)).all() and (np.diff(sim, axis=1) <= 1e-6).all()
    assert len(hnsw.Graph(x[:0]).vectors) == 0
    assert hnsw.Graph(x[:1]).search(x[:2], 4)[0][0, 0] == 0


def test_audit_widens_a_narrow_beam():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(1, 8)) + rng.normal(size=(300, 8)) * 0.02, rng.normal(size=(300, 8))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(x.astype(np.float32))
    q, node = embedding_dedup.links_of_block(graph, x, x, 0.95, 4, 64, 0.999)
    truth = set(zip(*(y.tolist() for y in np.nonzero(x @ x.T >= 0.95)), strict=True))
    found = set(zip(q.tolist(), node.tolist(), strict=True))
    assert found <= truth and len(found) >= 0.995 * len(truth)  # a beam of 4 would find 1 in 50


def test_no_query_hides_the_missed_links_of_another():
    rng = np.random.default_rng(7)
    hot = rng.normal(size=16) + rng.normal(size=(2100, 16)) * 0.01
    other = np.repeat(rng.normal(size=(300, 16)), 2, axis=0) + rng.normal(size=(600, 16)) * 0.01
    x = np.concatenate([hot, other])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(x.astype(np.float32))
    for layer in graph.layers:  # nothing leads to one vector of the hot group, nor to five of the pairs
        layer[np.isin(layer, [900, 2101, 2103, 2105, 2107, 2109])] = -1
    asked = np.arange(500, 2700)[::2]
    q, node = embedding_dedup.links_of_block(graph, x, x[asked], 0.95, embedding_dedup.BEAM, embedding_dedup.AUDITS, embedding_dedup.RECALL)
    truth = sorted(zip(*(y.tolist() for y in np.nonzero(x[asked] @ x.T >= 0.95)), strict=True))
    assert sorted(zip(q.tolist(), node.tolist(), strict=True)) == truth


def test_components_of_paths_and_hubs(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200, 260)] + [(500, i) for i in range(300, 400)] + [(7, 7), (None, 3), (1, 2), (2, 1)]
    rng.shuffle(edges)
    union = Union(range(600))
    for a, b in edges:
        if a is not None:
            union.join(a, b)
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: union.find(n) for e in edges if e[0] is not None and e[0] != e[1] for n in e}


def test_suffix_trees_have_exact_common_prefixes():
    rng = random.Random(12)
    texts = [[rng.randrange(3) for _ in range(rng.randint(1, 60))] for _ in range(12)]
    words = [w for t in texts for w in t]
    left = np.array([len(t) - i for t in texts for i in range(len(t))])
    suffix = [tuple(words[i : i + int(left[i])]) for i in range(len(words))]
    order, common = substring_dedup.suffix_tree(np.array(words, np.uint64), left, 20)
    for k in range(1, len(order)):
        a, b = suffix[order[k - 1]], suffix[order[k]]
        n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert a[:20] <= b[:20] and (common[k] == n if n < 20 else common[k] >= 20)


def test_a_hot_passage_goes_through_chains(spark):
    rng = random.Random(13)
    word = lambda: f"u{rng.randrange(10**9)}"
    passage = [word() for _ in range(90)]
    rows = [(i, " ".join([word() for _ in range(rng.randint(0, 30))] + passage[rng.randint(0, 3) :] + [word() for _ in range(20)])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(df, group=20).collect()}
    first, expected = {}, {}
    for i, t in rows:
        w, gone = t.split(), set()
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                gone |= set(range(k, k + 50))
        expected[i] = len(gone)
    assert found == expected and sum(n >= 87 for n in found.values()) > 290


LONG = " ".join(f"w{i * i % 10007}" for i in range(150_000))  # about 900 KB


def test_very_long_texts_go_through_every_dedup(spark):
    rows = [(1, LONG), (2, LONG + " end"), (3, LONG.replace(" ", "\n")), (4, LONG.replace(" ", "\n") + "\nlast"), (5, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert near == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    lines = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.remove_repeated_chunks(df).collect()}
    assert lines[1] == (1, 0) and lines[4][0] == 150_001 and lines[4][1] > 100_000 and lines[5] == (1, 0)
    gone = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()}
    assert gone[1][1] == 0 or gone[1][0] == 150_000
    assert gone[2] == (150_001, 150_000) and gone[3] == (150_000, 150_000) and gone[5] == (1, 0)


def test_texts_that_share_a_key_are_all_compared(spark):
    one, two = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [(5, one), (5, two), (5, two), (7, one + " x"), (8, two + " x"), (9, two + " y")]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {5} and len(found) == 6


def test_rows_that_repeat_a_key_keep_their_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [-1.0, 0.0])]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 6
    assert {r.vec_id: r.component_id for r in found}[2] == 1 and {r.vec_id: r.n_links for r in found}[4] == 0


def test_no_task_holds_more_stretches_of_a_partition_than_stated(spark):
    pick = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(70))
    texts = [" ".join(f"{passage} u{t}x{k} " + " ".join(f"w{pick.randrange(10**6)}" for _ in range(60)) for k in range(50)) for t in range(8)]
    texts += [texts[0]] * 3 + [" ".join(f"v{pick.randrange(10**6)}" for _ in range(200))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = df.select(F.col("doc_id").alias("key"), F.col("text").alias("_text"), F.xxhash64("text").alias("fp"))
    group = 20
    shared = substring_dedup._shared_partitions(base.select(F.col("fp").alias("_fp"), "_text"), 50, (20, 30, 40), group)
    once = base.dropDuplicates(["fp"]).join(shared, "fp").select(F.struct("key", "fp", "groups").alias("_keys"), "_text")
    rows = substring_dedup._stretch_rows(once, 50, (20, 30, 40))
    held = rows.where("text IS NOT NULL").groupBy("part").count().agg(F.max("count")).first()[0]
    assert (held or 0) <= group and rows.where("text IS NULL").count() > 0
    found = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(df, group=group).collect()}
    whole = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(df).collect()}
    assert found == whole and found[0] == 0 and found[1] >= 50 * 70 and found[8] == len(texts[0].split())
