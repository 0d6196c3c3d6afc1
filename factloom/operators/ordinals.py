"""Places and running sums inside groups of any size, without a window over a group.

Rows are dealt out by ranges of (group, order) and sorted in each task. That gives each row a place in its
partition; what stands before a partition comes from one number for each partition and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.storage import written


def _dealt(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows with the partition they fell in and their place there; written, for ranges are sampled anew each time."""
    sorted_ = rows.repartitionByRange(*[F.col(k) for k in keys], *order).sortWithinPartitions(*keys, *order)
    number = F.monotonically_increasing_id()  # the partition above 33 bits of the place in it
    return written(sorted_.select("*", F.shiftright(number, 33).alias("_part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ranges")


def _begins(dealt: DataFrame) -> DataFrame:
    """(_part, _before): how many rows stand in earlier partitions. One number a partition goes to the driver."""
    before, total = [], 0
    for row in dealt.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        before.append((row["_part"], total))
        total += row["n"]
    return dealt.sparkSession.createDataFrame(before, "_part long, _before long")


def _shifts(dealt: DataFrame, keys: list[str]) -> DataFrame:
    """(_part, keys, _shift): what to add to a row's place in its partition for that in its group, from 1."""
    first = dealt.groupBy("_part", *keys).agg(F.min("_at").alias("_first")).join(_begins(dealt), "_part")
    begins = first.groupBy(*keys).agg(F.min(F.col("_first") + F.col("_before")).alias("_begin"))
    return first.join(begins, keys).select("_part", *keys, (F.col("_before") - F.col("_begin") + 1).alias("_shift"))


def positions(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """The place of each row among those of its group, from 1. Rows with a null key are left out."""
    dealt = _dealt(rows, keys, order)
    return dealt.join(_shifts(dealt, keys), ["_part", *keys]).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))


def running_sums(rows: DataFrame, keys: list[str], order: list[Column], place: str, sums: dict[str, str]) -> DataFrame:
    """As ``positions``, and for each name of ``sums`` the sum of that column in all rows of the group up to and with
    this one. A window runs over the rows of one partition of one group only."""
    dealt = _dealt(rows, keys, order)
    inside = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.groupBy("_part", *keys).agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    earlier = own.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_{k}") for k in keys], *[F.col(f"_sum_{n}").alias(f"_s_{n}") for n in sums])
    joined = own.join(earlier, [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_p") < F.col("_part")], "left")  # partitions of a group
    before = joined.groupBy("_part", *keys).agg(*[F.coalesce(F.sum(f"_s_{n}"), F.lit(0)).alias(f"_earlier_{n}") for n in sums])
    found = dealt.withColumns({f"_inside_{n}": F.sum(c).over(inside) for n, c in sums.items()}).join(_shifts(dealt, keys), ["_part", *keys]).join(before, ["_part", *keys])
    kind = {n: found.schema[f"_inside_{n}"].dataType for n in sums}  # decimals keep their digits
    return found.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(place), *[(F.col(f"_inside_{n}") + F.col(f"_earlier_{n}").cast(kind[n])).cast(kind[n]).alias(n) for n in sums])
