"""Helpers on whole frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns behind a generator of one row. Spark pushes no filter below it, so that filters on
    these columns do not write their long expressions out again, once for every use further down."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return rows.drop(*columns).withColumn("_made", made).select("*", "_made.*").drop("_made")


def exploded(rows: DataFrame, items: Column, out: str) -> DataFrame:
    """A row for each item that is not null. The outer form, for from the plain one Spark infers a filter on
    the array's size, and pushes it below the columns that the array is made of, writing them out."""
    return rows.withColumn(out, F.explode_outer(items)).where(F.col(out).isNotNull())
