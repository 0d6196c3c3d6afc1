"""Connected components of a link graph, distributed and without hub tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import arrow, storage


class UnionFind:
    """Union by smallest label with path halving, over hashable labels."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = parent[x]
        return x

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) thinned in each batch of a task to a spanning forest by union-find."""

    def run(batches):
        for batch in batches:
            sets, kept = UnionFind(), []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if sets.union(a, b):
                    kept.append((min(a, b), max(a, b)))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*kept, strict=True), batch.schema.types, strict=True)], names=["a", "b"])

    kind = edges.schema["a"].dataType.simpleString()
    return arrow.mapped(edges.select("a", "b"), run, f"a {kind}, b {kind}")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of every node that has a link: the smallest node it can reach.

    Alternates the large-star and small-star operations until every node points at
    its root; each is an aggregation and a join by node, which can split a hub, and each round is
    written to the shared folder. Null ends and loops are dropped.
    """
    spark = edges.sparkSession
    links = forest(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b"))
    links = storage.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(most):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the joins have two plain exchanges and may split a hub
        least = storage.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = storage.written(large, "large")
        root = storage.written(large.groupBy("u").agg(F.min("v").alias("m")), "root")
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = small.unionByName(root.select("u", F.col("m").alias("v"))).distinct()
        new = storage.written(new, "links")
        storage.release(spark, links, least, large, root)
        links = new
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def local_labels(a: np.ndarray, b: np.ndarray) -> list[tuple]:
    """A spanning forest of the links a[i] - b[i]."""
    sets = UnionFind()
    return [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if sets.union(x, y)]
