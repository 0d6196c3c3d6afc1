"""Byte-level BPE encoding and decoding of whole texts (operator 6)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import arrow, bpe


def encode(df: DataFrame, key: str, text: str, path: str, decoded: bool = False) -> DataFrame:
    """Token ids of every text by the rank file at ``path`` (a file that every executor has).

    Returns the key, ``ids`` (array<int>) and, if asked for, ``decoded``: the bytes
    that the ids stand for. A null or empty text has no ids. Special tokens are
    ordinary text. Repeated rows give repeated results; other columns of ``df`` are
    not read. A row's work is O(n log n) in its text, one task holds one Arrow
    batch, and nothing is shuffled.
    """

    def run(chunk, keys):
        encoder = bpe.byte_level_encoder(path)
        ids, offsets = encoder.encode_chunk(chunk)
        out = [keys, arrow.list_array(ids, offsets, pa.int32())]
        if decoded:
            plain = ids.tolist()
            out.append(pa.array([encoder.decode(plain[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary()))
        yield out

    return arrow.map_texts(df, key, text, "ids array<int>" + ", decoded binary" * decoded, run)


def decode(df: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """The bytes of every array of ids (null or empty: no bytes), as ``decoded``."""
    rows = df.select(F.col(key), F.col(ids).alias("_ids"))

    def run(batches):
        encoder = bpe.byte_level_encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encoder.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=[key, "decoded"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, decoded binary")


def digests(encoded: DataFrame, key: str) -> DataFrame:
    """Digest columns of encode(..., decoded=True)."""
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
