"""Requests to language models without a network: identities, packing, cache and replies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import keys
from factloom.operators import ordinals
from factloom.storage import written

MOST_BYTES = 200_000


def block_identity(blocks: DataFrame) -> DataFrame:
    """Blocks bound to their content by a digest of the text."""
    return blocks.withColumn("text_sha256", keys.sha256_upper(F.col("text")))


def pack_blocks(blocks: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """``request`` numbers blocks of a source greedily in sequence, so that each request has at
    most ``most`` bytes of text; ``oversize`` marks a block that alone has more. A block without text has 0 bytes.

    Nothing walks through a source: running sums are made over ranges of its blocks; where a request ends that
    would begin at a block is looked up in them, for all blocks in one sort; and the blocks
    where requests do begin are found from the first one by jumps of 1, 2, 4, ... requests.
    """
    rows = blocks.select(F.struct("source_id").alias("source_id"), "block_id", F.col("sequence").cast("long").alias("sequence"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    placed = written(ordinals.running_sums(rows, ["source_id"], [F.col("sequence"), F.col("block_id")], "at", {"upto": "bytes"}), "blocks")
    before = F.col("upto") - F.col("bytes")
    # among sums and bounds in order, what stands before the bound of block i are i bounds and the blocks that fit
    marks = placed.select("source_id", F.col("upto").alias("sum"), F.lit(0).alias("bound"), "at").unionByName(placed.select("source_id", (before + most).alias("sum"), F.lit(1).alias("bound"), "at"))
    merged = ordinals.positions(marks, ["source_id"], [F.col("sum"), F.col("bound"), F.col("at")], "place").where("bound = 1").select("source_id", "at", (F.col("place") - F.col("at") + 1).alias("beyond"))
    fits = placed.select("source_id", F.col("at").alias("beyond"), F.col("upto").alias("_upto"), F.col("bytes").alias("_bytes"))
    # blocks without bytes go with the large block behind them
    alone = (F.col("_upto") - F.col("_bytes") - before) == 0
    ends = placed.join(merged, ["source_id", "at"]).join(fits, ["source_id", "beyond"], "left").select("source_id", "at", (F.col("beyond") + F.when(F.coalesce(alone, F.lit(False)), 1).otherwise(0)).alias("next"))
    ends = written(ends, "ends")
    starts = written(ends.where("at = 1").select("source_id", "at", F.lit(1).alias("request")), "starts")
    jump, size = ends, 1
    while True:
        landed = starts.join(jump, ["source_id", "at"]).select("source_id", F.col("next").alias("at"), (F.col("request") + size).alias("request"))
        landed = written(landed.join(ends.select("source_id", "at"), ["source_id", "at"], "left_semi"), "starts")
        if landed.isEmpty():
            break
        starts = starts.unionByName(landed)
        twice = jump.join(jump.select("source_id", F.col("at").alias("next"), F.col("next").alias("_next")), ["source_id", "next"])
        jump, size = written(twice.select("source_id", "at", F.col("_next").alias("next")), "jumps"), 2 * size
    spans = starts.join(ends, ["source_id", "at"]).select("source_id", "request", F.explode(F.sequence("at", F.col("next") - 1)).alias("at"))
    found = placed.join(spans, ["source_id", "at"])
    return found.select("source_id.source_id", "block_id", "sequence", "bytes", "request", (F.col("bytes") > most).alias("oversize"))


def requests(blocks: DataFrame, packed: DataFrame, instructions: str, contract: str) -> DataFrame:
    """One row a request: its blocks in sequence as canonical JSON, and its identity hash."""
    rows = packed.join(blocks.select("source_id", "block_id", "text"), ["source_id", "block_id"])
    item = F.struct("sequence", keys.evidence_id(F.col("source_id"), F.col("block_id")).alias("evidence_id"), "text")
    grouped = rows.groupBy("source_id", "request").agg(F.array_sort(F.collect_list(item)).alias("blocks"))
    payload = F.to_json(F.struct(F.transform("blocks", lambda b: F.struct(b["evidence_id"].alias("evidence_id"), b["text"].alias("text"))).alias("blocks"), F.lit(contract).alias("contract"), F.lit(instructions).alias("instructions")))
    return grouped.select("source_id", "request", payload.alias("payload")).withColumn("request_sha256", keys.sha256_upper(F.col("payload")))


def cached(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with ``cache`` hit or miss and the cached response."""
    known = cache.select("request_sha256", F.col("response").alias("response"), F.lit("hit").alias("_hit"))
    return wanted.join(known, "request_sha256", "left").withColumn("cache", F.coalesce("_hit", F.lit("miss"))).drop("_hit")


def new_for_cache(cache: DataFrame, found: DataFrame) -> DataFrame:
    """Responses that the cache does not have yet."""
    return found.join(cache.select("request_sha256"), "request_sha256", "left_anti")


def cache_conflicts(cache: DataFrame, found: DataFrame) -> DataFrame:
    """Requests whose response differs from the cached one."""
    old = cache.select("request_sha256", F.sha2("response", 256).alias("_old"))
    return found.join(old, "request_sha256").where(F.sha2("response", 256) != F.col("_old")).select("request_sha256")


def respond(wanted: DataFrame, responder: Callable[[str], str]) -> DataFrame:
    """Requests with the response of an injected callable, or the error's class."""
    rows = wanted.select("request_sha256", "payload")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for digest, payload in zip(pdf["request_sha256"], pdf["payload"], strict=True):
                try:
                    out.append((digest, responder(payload), None))
                except Exception as error:
                    out.append((digest, None, type(error).__name__))
            yield pd.DataFrame(out, columns=["request_sha256", "response", "error_class"])

    return rows.mapInPandas(run, "request_sha256 string, response string, error_class string")


def strict_json_problem(column: Column) -> Column:
    """Why a text is not one strict JSON object: null if it is."""
    parsed = F.try_parse_json(column)
    return (
        F.when(column.isNull(), "empty_output")
        .when(parsed.isNull(), "invalid_json")
        .when(F.schema_of_variant(parsed).startswith("OBJECT"), F.when(F.trim(column).rlike(r"\}$"), F.lit(None)).otherwise("invalid_json"))
        .otherwise("not_an_object")
    )
