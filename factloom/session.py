"""Session settings that results depend on."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "factloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings are passed on."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import this package, wherever the driver runs from;
    on a cluster the package is shipped with the job."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Deals rows out to as many tasks as there are cores where the table comes in fewer pieces, for work that
    costs far more than moving a small table. Tables in enough pieces, as large ones are, stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by keys in as many partitions as shuffles have, which adaptive execution leaves as they are: for
    steps whose work is large for the size of their rows."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
