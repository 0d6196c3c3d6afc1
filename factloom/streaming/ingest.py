"""Incremental ingestion: new document files become block rows once, by checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.functions import keys
from factloom.sources import documents, tables

_FILE = "path string, modificationTime timestamp, length long, content binary"


def stream(spark: SparkSession, path: str, watermark: str = "7 days") -> DataFrame:
    """Files that appear in a folder, each content once within the watermark."""
    found = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", "true").load(path)
    found = found.withColumn("checksum", keys.sha256_upper(F.col("content"))).withWatermark("modificationTime", watermark)
    return found.dropDuplicatesWithinWatermark(["checksum"])


def start(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Parses new files and appends their blocks; a repeated batch appends nothing twice."""

    def append(batch: DataFrame, number: int) -> None:
        rows = documents.blocks(documents.parse(batch.select("path", "content")))
        tables.append_new(rows, out, "block_id")

    return stream(spark, path).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
