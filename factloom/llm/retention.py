"""Cohort retention matrix (operator 12), as known at two times.

A conditional minimum gives each client its start in both states of knowledge at once. The starts are
joined back to the deduplicated clicks in a shuffle; clicks are summed by (state, client, period) first and
then rolled up to cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import storage

#: The first state of knowledge ends here.
CUTOFF = "2024-02-01 00:00:00"
#: The kind of click that starts a client.
START_KIND = "error"
#: A client with more than this part of all clicks is joined in pieces; so fewer than this many clients are.
SHARE = 1024


def arrival(arrived_at: Column, click_id: Column) -> Column:
    """When a click is known: those whose checksum 3 divides come checksum mod 100 days late."""
    h = F.crc32(click_id.cast("string").cast("binary"))
    late = F.when(h % 3 == 0, (h % 100).cast("int")).otherwise(F.lit(0))
    return arrived_at.cast("timestamp_ntz") + F.make_dt_interval(late)


def cents(value: Column) -> Column:
    """floor(100 * value + 0.5); 0 for null, NaN and infinite values."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, F.floor(100 * value + F.lit(0.5))).otherwise(F.lit(0)).cast("long")


def distinct_clicks(clicks: DataFrame, cutoff: str, start_kind: str) -> DataFrame:
    """Clicks with a time and a client, equal rows once: what later steps need of them. ``slot`` deals
    the clicks of one client out evenly."""
    rows = clicks.where("ts IS NOT NULL AND client_id IS NOT NULL").distinct()
    early = F.coalesce(arrival(F.col("arrived_at"), F.col("click_id")) < F.lit(cutoff).cast("timestamp_ntz"), F.lit(False))
    starts = F.coalesce(F.col("kind") == start_kind, F.lit(False))
    slot = F.pmod(F.xxhash64("click_id", "ts", "arrived_at"), F.lit(1 << 16)).cast("int")
    return rows.select("client_id", F.col("ts").cast("timestamp_ntz").alias("ts"), early.alias("early"), starts.alias("starts"), cents(F.col("value")).alias("cents"), slot.alias("slot"))


def _cohort(start: Column) -> Column:
    return F.floor(F.unix_date(start.cast("date")) / 7)


def starts(clicks: DataFrame, clients: DataFrame) -> DataFrame:
    """Clients with a start: the start in state 0 (null: none) and in state 1, clicks, segment and whether
    the cohorts of both differ."""
    first = lambda c: F.min(F.when(c, F.col("ts")))
    found = clicks.groupBy("client_id").agg(first(F.col("starts") & F.col("early")).alias("start0"), first(F.col("starts")).alias("start1"), F.count("*").alias("n"))
    segments = clients.where("client_id IS NOT NULL").groupBy("client_id").agg(F.max(F.struct("updated_at", "source"))["source"].alias("segment"))
    named = found.where("start1 IS NOT NULL").join(segments.hint("merge"), "client_id", "left")
    return named.withColumn("segment", F.coalesce("segment", F.lit(""))).withColumn("moved", F.coalesce(_cohort(F.col("start0")) != _cohort(F.col("start1")), F.lit(False)))


def matrix(clicks: DataFrame, clients: DataFrame, cutoff: str = CUTOFF, start_kind: str = START_KIND) -> DataFrame:
    """Cells (state, segment, cohort, period) with users, users_crc32, moved and cents.

    State 0 knows the clicks that had arrived before ``cutoff``, state 1 all. A client starts in a state with
    the earliest click of ``start_kind`` that it knows; its cohort is the number of 7-day
    spans from 1970 to the start's day, and a later click's period that of whole 7-day spans since the
    start. Equal rows of ``clicks`` count once, by all their columns; rows without ts or client_id do not count; clicks
    without arrived_at are known to state 1 only; a null click_id is never late, a null kind no start.
    Segments are the source of the client's row that was updated last (ties: the greatest source), ''
    if there is none. Null, NaN and infinite values are 0 cents. Without starts there are no rows.

    Clicks of a client with more than one in ``SHARE`` of all clicks meet its start in as many pieces as it
    has such parts, so that no task holds one client. Fewer than ``SHARE`` clients have that many,
    whatever the size of the table: their list is the one that is broadcast.
    """
    known = storage.written(distinct_clicks(clicks, cutoff, start_kind), "clicks")
    clients_at = storage.written(starts(known, clients), "starts")
    part = max(known.count() // SHARE, 1)
    pieces = F.ceil(F.col("n") / part).cast("int")
    hot = clients_at.where(F.col("n") > part).select("client_id", pieces.alias("pieces"))
    dealt = known.join(F.broadcast(hot), "client_id", "left").withColumn("piece", F.pmod("slot", F.coalesce("pieces", F.lit(1)))).drop("pieces", "slot", "starts")
    met = clients_at.withColumn("piece", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > part, pieces - 1).otherwise(0)))).drop("n")
    joined = dealt.join(met.hint("merge"), ["client_id", "piece"])
    states = F.array(F.struct(F.lit(0).alias("state"), F.when(F.col("early"), F.col("start0")).alias("start")), F.struct(F.lit(1).alias("state"), F.col("start1").alias("start")))
    seen = joined.select("client_id", "segment", "moved", "ts", "cents", F.inline(states)).where("ts >= start")
    period = F.expr("(ts - start) div interval '7' day")
    by_client = seen.groupBy("state", "client_id", period.alias("period"), "segment", "moved", _cohort(F.col("start")).alias("cohort")).agg(F.sum("cents").alias("cents"))
    return by_client.groupBy("state", "segment", "cohort", "period").agg(
        F.count("*").alias("users"),
        F.sum(F.crc32(F.col("client_id").cast("string").cast("binary"))).alias("users_crc32"),
        F.sum(F.col("moved").cast("long")).alias("moved"),
        F.sum("cents").alias("cents"),
    )


ORACLE = """
WITH crc AS (SELECT list_transform(range(0, 256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
             lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
ids AS (SELECT click_id AS id FROM clicks UNION SELECT client_id FROM clicks),
h AS (SELECT id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(id AS VARCHAR), ''), lambda q: CAST(ascii(q) AS BIGINT))),
             lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM ids, crc WHERE id IS NOT NULL),
d AS (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL),
k AS (SELECT d.*, arrived_at + to_days(CAST(CASE WHEN h.h % 3 = 0 THEN h.h % 100 ELSE 0 END AS INTEGER)) AS arrival
      FROM d LEFT JOIN h ON d.click_id = h.id),
s AS (SELECT 0 AS state, * FROM k WHERE arrival < TIMESTAMP '2024-02-01 00:00:00' UNION ALL SELECT 1, * FROM k),
st AS (SELECT state, client_id, min(ts) AS start, CAST(floor(date_diff('day', DATE '1970-01-01', CAST(min(ts) AS DATE)) / 7) AS BIGINT) AS cohort
       FROM s WHERE kind = 'error' GROUP BY state, client_id),
shifted AS (SELECT client_id FROM st GROUP BY client_id HAVING count(DISTINCT cohort) > 1),
c AS (SELECT s.state, s.client_id, st.cohort, epoch_us(s.ts - st.start) // 604800000000 AS period,
             sum(CASE WHEN s.value IS NULL THEN 0 ELSE floor(100 * s.value + 0.5) END) AS cents
      FROM s JOIN st ON s.state = st.state AND s.client_id = st.client_id AND s.ts >= st.start GROUP BY ALL)
SELECT state, coalesce(clients.source, '') AS segment, cohort, CAST(period AS BIGINT) AS period, count(*) AS users,
       CAST(sum(h.h) AS BIGINT) AS users_crc32, CAST(sum(CASE WHEN shifted.client_id IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS moved,
       CAST(sum(cents) AS BIGINT) AS cents
FROM c JOIN h ON c.client_id = h.id LEFT JOIN shifted ON shifted.client_id = c.client_id LEFT JOIN clients ON clients.client_id = c.client_id
GROUP BY ALL"""
