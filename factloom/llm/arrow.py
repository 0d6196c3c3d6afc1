"""Runs a function over the texts of a table, a chunk of whole texts at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import text_kernels as tk

#: Rows of an Arrow batch: whole texts of unknown length, so fewer than Spark's default.
BATCH_ROWS = 2000


def mapped(rows: DataFrame, run, schema) -> DataFrame:
    """mapInArrow whose worker, which Spark keeps for later tasks, gives its free memory back."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):
                pass  # not this C library

    return rows.mapInArrow(whole, schema)


def map_texts(df: DataFrame, key: str, text: str, columns: str, function: Callable[[tk.TextChunk, pa.Array], Iterator[list]], key_out: str | None = None) -> DataFrame:
    """``function(chunk, keys)`` yields lists of column values (without the key unless it
    gives it itself as the first list). Only the key and the text are read.

    Results: one frame with the key and the columns of the DDL string ``columns``.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    key_out = key_out or key
    rows = df.select(F.col(key).alias(key_out), F.col(text).cast("string").alias("_text"))
    schema = T.StructType([rows.schema[0], *T.StructType.fromDDL(columns).fields])
    arrow = _arrow_schema(schema)

    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            for chunk in tk.text_chunks(batch.column(1)):
                own = keys.slice(chunk.first, len(chunk))
                for values in function(chunk, own):
                    yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

    return mapped(rows, run, schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def list_array(values, offsets, kind: pa.DataType) -> pa.Array:
    """A list array from ragged values."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def map_columns(df: DataFrame, keys: str, text: str, columns: str, function) -> DataFrame:
    """Like map_texts, but the key column is only an input: ``function`` yields the
    values of exactly the given columns."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    rows = df.select(F.col(keys).alias("_keys"), F.col(text).cast("string").alias("_text"))
    schema = T.StructType.fromDDL(columns)
    arrow = _arrow_schema(schema)

    def run(batches):
        for batch in batches:
            own = batch.column(0)
            for chunk in tk.text_chunks(batch.column(1)):
                for values in function(chunk, own.slice(chunk.first, len(chunk))):
                    yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

    return mapped(rows, run, schema)
