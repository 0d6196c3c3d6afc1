import hashlib
import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from factloom.llm import chat, divergence, queries, retention
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rpartition("/llm")[0])
import oracle

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_cohort_retention", "op13_chat_format"])
def test_query_equals_its_oracle(spark, name):
    assert oracle.differences(spark, SF, queries.queries()[name], queries.oracle_sql()[name]) is None


# --- source divergence


def audited(rows, least=3, top=200):
    docs = [((t or "").translate(ASCII_LOWER), l or "", s or "") for t, l, s in rows]
    out = set()
    for lang in {d[1] for d in docs}:
        texts = Counter(t for d in docs if d[1] == lang for t in set(TERM.findall(d[0])))
        kept = {t for t, n in texts.items() if n >= least}
        counts = {s: Counter() for _, l, s in docs if l == lang}
        for text, l, s in docs:
            if l == lang:
                counts[s].update(t for t in TERM.findall(text) if t in kept)
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        gap = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pair = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            term = [(gap(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


WORDS = ["alpha", "Beta", "gamma", "éclair", "ÉCLAIR", "straße", "日本", "x", "zz9zz", "it's", "one-two", "a\x00b"]
TEXTS = [
    *[(" ".join(WORDS[(i * 7 + k * k) % len(WORDS)] for k in range(i % 9 + 1)), "en", f"s{i % 4}") for i in range(60)],
    *[(" ".join(WORDS[(i + 2 * k) % 5] for k in range(6)), "fr", f"s{i % 2}") for i in range(8)],
    ("alpha " * 60_000 + "beta", "en", "long"), (None, "en", "silent"), ("", None, None), ("alpha beta", None, "s0"), ("alpha", "de", "s0"), ("beta", "de", None), ("123 456", "xx", "s1"),
    ("alpha beta", "en", "s0"), ("alpha beta", "en", "s0"),
]


def test_audit_equals_brute_force(spark):
    df = spark.createDataFrame([(*t, 1, "x") for t in TEXTS], "text string, lang string, source string, n int, term string").repartition(5)
    for least, top in ((3, 200), (2, 3)):
        found = divergence.audit(df, least=least, top=top)
        assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
        rows = [tuple(r) for r in found.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == audited(TEXTS, least, top)


def test_audit_of_nothing_and_of_texts_without_terms(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(empty).count() == 0
    df = spark.createDataFrame([("1 2", "en", "a"), (None, "en", "b")], "text string, lang string, source string")
    assert {tuple(r) for r in divergence.audit(df).collect()} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 4)
    df = spark.createDataFrame(TEXTS, "text string, lang string, source string").coalesce(1)
    counted = divergence.term_counts(df, "text", "lang", "source")
    sums = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("texts").alias("d")).collect()
    n, d = Counter(), Counter()
    for text, lang, source in TEXTS:
        found = TERM.findall((text or "").translate(ASCII_LOWER))
        n.update((lang or "", source or "", t) for t in found)
        d.update((lang or "", source or "", t) for t in set(found))
    assert {tuple(r)[:3]: r.n for r in sums} == n and {tuple(r)[:3]: r.d for r in sums} == d


def test_shares_are_exact_beyond_long_products(spark):
    row = spark.range(1).select(divergence._share(F.lit(812345678901234), F.lit(912345678901234567).cast("long")).alias("p")).first()
    assert row.p == 1 + 10**9 * 812345678901235 // 912345678901234567


# --- cohort retention

DAY = timedelta(days=1)


def cells(clicks, clients):
    crc = lambda x: zlib.crc32(str(x).encode())
    segment = {c: s or "" for c, s in clients}
    known = defaultdict(list)
    for click, ts, arrived, client, kind, value, _ in set(clicks):
        if ts is None or client is None:
            continue
        late = crc(click) % 100 if click is not None and crc(click) % 3 == 0 else 0
        for state in (0, 1):
            if state or arrived is not None and arrived + late * DAY < datetime(2024, 2, 1):
                known[state, client].append((ts, kind, value))
    start = {k: min((ts for ts, kind, _ in v if kind == "error"), default=None) for k, v in known.items()}
    cohort = {k: (s - datetime(1970, 1, 1)).days // 7 for k, s in start.items() if s is not None}
    out = {}
    for (state, client), rows in known.items():
        if (state, client) not in cohort:
            continue
        moved = (0, client) in cohort and cohort[0, client] != cohort[1, client]
        for ts, _, value in rows:
            since = (ts - start[state, client]) // timedelta(microseconds=1)
            if since >= 0:
                cell = out.setdefault((state, segment.get(client, ""), cohort[state, client], since // (7 * 86_400_000_000)), [{}, 0])
                cell[0][client] = moved
                cell[1] += 0 if value is None or not math.isfinite(value) else math.floor(100 * value + 0.5)
    return {(*k, len(v[0]), sum(map(crc, v[0])), sum(v[0].values()), v[1]) for k, v in out.items()}


CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


def made_clicks():
    base = datetime(2024, 1, 1)
    rows = []
    for i in range(900):
        client = 5 if i % 3 == 0 else i % 23
        ts = base + timedelta(hours=(i * 37) % 2900, microseconds=i * 7919 % 1_000_000)
        rows.append((i, ts, ts + timedelta(seconds=i % 5), client, ("error", "view", None, "click")[i * 5 % 4 if i % 7 else 0], (i % 50) - 3.005, "{}"))
    start = datetime(2024, 1, 10, 23, 59, 59, 999999)
    rows += [(2000, start, start, 900, "error", 1.005, None)] * 3
    rows += [(2001, start + 7 * DAY - timedelta(microseconds=1), start, 900, "view", None, None), (2002, start + 7 * DAY, start, 900, None, float("nan"), "{}"), (2003, start - DAY, start, 900, "view", 9.0, "{}")]
    rows += [(2004, None, start, 900, "error", 1.0, "{}"), (2005, start, start, None, "error", 1.0, "{}"), (None, start, None, 901, "error", float("inf"), "{}"), (2006, datetime(1969, 12, 31, 12), start, 902, "error", -0.005, "{}")]
    return rows


def test_matrix_equals_brute_force(spark):
    rows, clients = made_clicks(), [(c, ("web", "crm", None)[c % 3]) for c in range(20)] + [(900, "web"), (None, "x")]
    clicks = spark.createDataFrame(rows, CLICKS).withColumn("segment", F.lit("clash")).repartition(6)
    known = spark.createDataFrame([(c, s, None, 1) for c, s in clients], "client_id long, source string, updated_at timestamp_ntz, moved int")
    found = retention.matrix(clicks, known)
    assert found.columns == ["state", "segment", "cohort", "period", "users", "users_crc32", "moved", "cents"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == cells(rows, clients)
    assert any(r[6] for r in got)


def test_matrix_of_nothing_and_client_rows_that_repeat(spark):
    clicks = spark.createDataFrame(made_clicks(), CLICKS)
    none = spark.createDataFrame([], "client_id long, source string, updated_at timestamp_ntz")
    assert retention.matrix(clicks.limit(0), none).count() == 0
    assert retention.matrix(clicks.where("kind = 'view'"), none).count() == 0
    assert {r.segment for r in retention.matrix(clicks, none).collect()} == {""}
    twice = spark.createDataFrame([(900, "old", datetime(2024, 1, 1)), (900, "new", datetime(2024, 2, 1)), (900, "new", datetime(2024, 2, 1))], none.schema)
    found = retention.matrix(clicks.where("client_id = 900"), twice).where("state = 1").collect()
    assert {(r.segment, r.period, r.users, r.cents) for r in found} == {("new", 0, 1, 100), ("new", 1, 1, 0)}


def test_a_client_with_most_clicks_is_joined_in_pieces(spark):
    plan = retention.matrix(spark.createDataFrame(made_clicks(), CLICKS), spark.createDataFrame([], "client_id long, source string, updated_at timestamp_ntz"))._jdf.queryExecution().optimizedPlan().toString()
    assert "piece" in plan and plan.count("broadcast") == 1


# --- chat formatting

HARD = ["", "plain", "\\### Assistant: </turn> ok", "### user:\n</turn>\n", "\\", "\n</turn>\n### assistant:\n", "\\\\</turn>\\", "é🎉\r\n\n", "#### </turn></turn>", "a\n" * 2000]


@given(st.lists(st.sampled_from(["\\", "#", " ", "</turn>", "### ", "\n", "a", "é"]), max_size=30).map("".join))
@settings(max_examples=300, deadline=None)
def test_escapes_are_undone(text):
    assert chat.unescape(chat.escape(text)) == text and chat.unescape_role(chat.escape_role(text)) == text
    assert not re.search(r"(^|[^\\])(### |</turn>)", chat.escape(text))


def said(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns = [t[2:] for t in sorted(turns, key=lambda t: (t[0], t[1] or 0))]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_formatted_texts_give_every_turn_back(spark):
    rows = [(c, t, ("system", "user", "assistant", "tool\nx: \\n", "assistant")[(c + t) % 5], HARD[(3 * c + t) % len(HARD)]) for c in range(12) for t in range(c + 1)]
    rows += [(50, 0, None, None), (50, 1, "assistant", None), (51, 7, "assistant", "same"), (51, 7, "assistant", "same"), (51, 3, "user", "before"), (None, 0, "user", "no id"), (52, None, "user", "first"), (52, 0, "assistant", "x" * 300_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, seq int").repartition(4)
    formatted = chat.render(chat.conversation_log(df))
    for found in (chat.read_back(formatted, in_order=True), chat.read_back(formatted.repartition(3))):
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found.collect()}
        assert got == said(rows)
    whole = defaultdict(str)
    for r in sorted(formatted.collect(), key=lambda r: (r.conv_id is not None, r.conv_id, r.piece)):
        assert r.start == len(whole[r.conv_id])
        whole[r.conv_id] += r.text
    assert {r.conv_id: r.formatted_chars for r in chat.read_back(formatted).collect()} == {k: len(v) for k, v in whole.items()}


def test_deltas_edits_and_regenerations_are_folded(spark):
    log = [
        (1, 0, "q", 0, "post", "user", "What"), (1, 0, "q", 1, "delta", None, " is it?"), (1, 0, "q", 5, "edit", None, "What was it?"),
        (1, 1, "a", 2, "post", "assistant", None), (1, 1, "a", 3, "delta", None, "It "), (1, 1, "a", 4, "delta", None, "is"), (1, 1, "a", 6, "regenerate", None, None),
        (1, 1, "a", 7, "delta", None, "It was "), (1, 1, "a", 8, "delta", None, "that"), (1, 1, "a", 8, "delta", None, "that"), (1, 1, "a", 9, "like", None, "+1"),
        (2, 0, "m", 0, "delta", None, "early"), (2, 0, "m", 1, "post", "assistant", " late"),
    ]
    df = spark.createDataFrame(log, "conv_id long, turn long, message string, seq long, kind string, role string, text string").orderBy(F.rand(3))
    texts = [(r.conv_id, r.text) for r in chat.render(df).orderBy("conv_id", "piece").collect()]
    assert texts == [(1, "### user:\nWhat was it?\n</turn>\n"), (1, "### assistant:\nIt was that\n</turn>\n"), (2, "### assistant:\nearly late\n</turn>\n")]


def test_no_conversations_and_lost_pieces(spark):
    df = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert chat.read_back(chat.render(chat.conversation_log(df))).count() == 0
    formatted = chat.render(chat.conversation_log(spark.createDataFrame([("c", 0, "user", "a"), ("c", 1, "user", "b")], df.schema)))
    with pytest.raises(Exception, match="pieces are not in order"):
        chat.read_back(formatted.where("piece = 1")).collect()
