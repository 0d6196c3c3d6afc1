"""Tables that appear whole or not at all: staged writes, renames, roll-back, write-once.

Everything goes through the file system that Spark uses for the path, so that it holds on a
cluster's store as on a disk; a rename within one folder is what makes a table visible.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import reports


class Conflict(RuntimeError):
    """Another content is there already."""


class _Files:
    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def move(self, source: str, target: str) -> None:
        self._fs.mkdirs(self._path(target).getParent())
        if self.exists(target) or not self._fs.rename(self._path(source), self._path(target)):
            raise Conflict(f"cannot move to {target}")

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


def publish(tables: dict[str, DataFrame], folder: str, check: Callable[[dict[str, DataFrame]], None] | None = None) -> None:
    """Replaces the Parquet tables of these names in a folder, all of them or none.

    All are written aside and read back by ``check``, which raises if something is wrong, before
    the first is moved; if a move fails, those made so far are taken back.
    """
    spark = next(iter(tables.values())).sparkSession
    files, mark = _Files(spark, folder), uuid.uuid4().hex
    aside, old = f"{folder}/_staged-{mark}", f"{folder}/_old-{mark}"
    done: list[tuple[str, bool]] = []
    try:
        for name, table in tables.items():
            table.write.parquet(f"{aside}/{name}")
        if check is not None:
            check({name: spark.read.schema(table.schema).parquet(f"{aside}/{name}") for name, table in tables.items()})
        for name in tables:
            before = files.exists(f"{folder}/{name}")
            if before:
                files.move(f"{folder}/{name}", f"{old}/{name}")
            done.append((name, before))
            files.move(f"{aside}/{name}", f"{folder}/{name}")
    except BaseException:
        for name, before in reversed(done):
            if files.exists(f"{aside}/{name}") is False:
                files.delete(f"{folder}/{name}")
            if before:
                files.move(f"{old}/{name}", f"{folder}/{name}")
        raise
    finally:
        files.delete(aside)
        files.delete(old)


def write_once(table: DataFrame, path: str) -> bool:
    """Writes a table where none is. True if it was written, False if equal rows were there; other
    rows there are a conflict and stay. Of two writers one wins, by the rename."""
    spark = table.sparkSession
    files = _Files(spark, path)
    if not files.exists(path):
        aside = f"{path}._staged-{uuid.uuid4().hex}"
        table.write.parquet(aside)
        try:
            files.move(aside, path)
            return True
        except Conflict:
            pass  # another writer was first: compare with what it wrote
        finally:
            files.delete(aside)
    plain = lambda df: df.select(*[F.to_json(c).alias(c) if kind.startswith(("map", "struct", "array")) else F.col(c) for c, kind in table.dtypes])
    if not reports.same_rows(plain(table), plain(spark.read.parquet(path))).first()["equal"]:
        raise Conflict(f"other rows are at {path}")
    return False


def write_checked(table: DataFrame, path: str, violations: Callable[[DataFrame], DataFrame]) -> None:
    """Writes a table, reads it back and looks for violations; with any, or with rows lost, it is
    taken away and an error raised."""
    spark = table.sparkSession
    table.write.mode("error").parquet(path)
    back = spark.read.schema(table.schema).parquet(path)
    found = violations(back).limit(5).collect()
    if found or back.count() != table.count():
        _Files(spark, path).delete(path)
        raise ValueError(f"not written: {[tuple(r) for r in found] or 'rows were lost'}")


def append_exclusive(found: DataFrame, path: str, key: str, content: str) -> int:
    """Appends rows whose key a table does not have; the same key with another content is a conflict
    and nothing is appended. Rows of one call go into a folder named by what they are, so that a call
    made twice writes once. Returns how many rows were new."""
    spark = found.sparkSession
    files = _Files(spark, path)
    if files.exists(path):
        known = spark.read.schema(found.schema).option("recursiveFileLookup", "true").parquet(path)
        other = found.join(known.select(key, F.col(content).alias("_known")), key).where(~F.col(content).eqNullSafe(F.col("_known")))
        if not other.isEmpty():
            raise Conflict(f"another {content} is known for {other.first()[key]}")
        found = found.join(known.select(key), key, "left_anti").select(*found.columns)
    twice = found.groupBy(key).agg(F.count_distinct(content).alias("_n")).where("_n > 1")
    if not twice.isEmpty():
        raise Conflict(f"two values of {content} for {twice.first()[key]}")
    found = found.dropDuplicates([key])
    n, mark = found.agg(F.count("*"), F.sum(F.xxhash64(key, content).cast("decimal(38,0)"))).first()
    if n:
        aside = f"{path}/_staged-{uuid.uuid4().hex}"
        found.write.parquet(aside)
        try:
            files.move(aside, f"{path}/rows-{int(mark) % 2**64:016x}-{n}")
        finally:
            files.delete(aside)
    return n
