"""Near-duplicate embeddings by sharded HNSW graphs (operator 2).

Vectors of equal components are one class, represented by its smallest key.
Representatives are dealt into shards by a hash; each shard builds a graph and
writes it to the shared folder with its vectors. Every representative then queries every
shard, in blocks: what is dealt out is which block asks which shard, and a task reads the
block's vectors from where its shard was written. A query whose beam is full of links is compared
with the shard exactly. A block audits the others: for some of them the links in the shard
are found exactly, and while the graph has too few of the links of any one, the rest of the
block goes on from its beams with twice as wide ones (at last, when a beam would hold the
shard, by exact comparison). Links are verified by the cosine in double precision and counted where
they are found; each block sends on a spanning forest of its links only, and the
forests are united into components.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import arrow, hnsw, storage
from factloom.llm.components import UnionFind, components
from factloom.llm.warc import _system, _write

COSINE = 0.95
SHARDS = 8
#: More shards are used where one would hold more vectors than this.
SHARD_ROWS = 100_000
BLOCK_ROWS = 1024
#: A task asks one shard for about so many blocks, so that it loads that shard once for them.
TASK_BLOCKS = 4
BEAM = 64
AUDITS = 128
#: Least share of its links that the graph finds for each audited query.
RECALL = 0.999


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that neither tiny nor huge components lose the norm
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@lru_cache(maxsize=64)
def _keys(folder: str, name: str) -> tuple[pa.Array, np.ndarray]:
    """Keys and copies of a shard."""
    system, base = _system(folder)
    with system.open_input_stream(f"{base}/{name}.keys", compression=None) as file, pa.ipc.open_stream(file) as reader:
        table = reader.read_all().combine_chunks()
    return table.column("key").combine_chunks(), table.column("copies").to_numpy()


def _vectors(folder: str, name: str, dim: int, lo: int, hi: int) -> np.ndarray:
    """Double-precision unit vectors of rows [lo, hi) of a shard, by one range read."""
    system, base = _system(folder)
    with system.open_input_file(f"{base}/{name}.vectors") as file:
        file.seek(lo * dim * 8)
        return np.frombuffer(file.read((hi - lo) * dim * 8), np.float64).reshape(hi - lo, dim)


@lru_cache(maxsize=2)
def _shard(folder: str, name: str, dim: int) -> tuple[hnsw.Graph, np.ndarray]:
    """Graph and vectors of a shard."""
    system, base = _system(folder)
    with system.open_input_stream(f"{base}/{name}.graph", compression=None) as file:
        graph = hnsw.Graph.load(file.read())
    return graph, _vectors(folder, name, dim, 0, len(graph.vectors))


def _whole_groups(batches, columns: int):
    """Tables with all rows of one value of the first ``columns`` columns (rows come sorted)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = list(zip(*(batch.column(c).to_pylist() for c in range(columns)), strict=True))
        at = 0
        for k in range(1, len(marks) + 1):
            if k == len(marks) or marks[k] != marks[at]:
                if held and marks[at] != last:
                    yield last, pa.Table.from_batches(held).combine_chunks()
                    held = []
                held.append(batch.slice(at, k - at))
                last, at = marks[at], k
    if held:
        yield last, pa.Table.from_batches(held).combine_chunks()


def build_shards(rows: DataFrame, folder: str) -> DataFrame:
    """Writes graph, vectors and keys of each (dim, shard) of rows (dim, shard, key, copies, vector)."""

    def run(batches):
        for (dim, shard), table in _whole_groups(batches, 2):
            unit = _unit(_matrix(table.column("vector").combine_chunks()))
            sink = pa.BufferOutputStream()
            own = table.select(["key", "copies"])
            with pa.ipc.new_stream(sink, own.schema) as writer:
                writer.write_table(own)
            _write(folder, f"{dim}-{shard}.keys", [sink.getvalue()])
            _write(folder, f"{dim}-{shard}.vectors", [np.ascontiguousarray(unit).tobytes()])
            _write(folder, f"{dim}-{shard}.graph", [hnsw.Graph(unit.astype(np.float32)).dump()])
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([shard], pa.int32()), pa.array([table.num_rows], pa.int64())], names=["dim", "shard", "n"])

    ordered = rows.select("dim", "shard", "key", "copies", "vector").repartition("dim", "shard").sortWithinPartitions("dim", "shard", "key")
    return storage.written(arrow.mapped(ordered, run, "dim int, shard int, n long"), "shards")


def links_of_block(graph: hnsw.Graph, unit: np.ndarray, queries: np.ndarray, cosine: float, beam: int, audits: int, recall: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (query, node) of unit queries in a shard, by beams wide enough for the audit."""
    n = len(unit)
    slack = cosine - 1e-4

    def verified(query: np.ndarray, node: np.ndarray) -> np.ndarray:
        good = np.zeros(len(query), bool)
        for lo in range(0, len(query), 1 << 16):
            good[lo : lo + (1 << 16)] = np.einsum("kd,kd->k", queries[query[lo : lo + (1 << 16)]], unit[node[lo : lo + (1 << 16)]]) >= cosine
        return good

    def exact(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [(np.zeros(0, np.int32), np.zeros(0, np.int32))]
        step = max(1, (1 << 24) // n)
        for lo in range(0, len(which), step):
            q, node = np.nonzero(queries[which[lo : lo + step]].astype(np.float32) @ graph.vectors.T >= slack)
            q = which[lo : lo + step][q]
            good = verified(q, node)
            found.append((q[good].astype(np.int32), node[good].astype(np.int32)))
        return joined(found)

    def joined(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([q for q, _ in found]), np.concatenate([node for _, node in found])

    random = np.random.default_rng(len(queries))
    found, todo, node = [], np.arange(len(queries)), None
    while len(todo) and beam < n:
        node, sim = graph.search(queries[todo], beam, node)
        near = sim >= slack
        full = near.all(1)  # a beam of links only may have left some out
        found.append(exact(todo[full]))
        q, at = np.nonzero(near & ~full[:, None])
        hit = node[q, at]
        good = verified(todo[q], hit)
        q, hit = q[good], hit[good]
        counts = np.bincount(q, minlength=len(todo))
        linked = np.flatnonzero(~full & (counts > 1))
        sample = np.unique(np.concatenate([random.permutation(np.flatnonzero(~full))[:audits], random.permutation(linked)[:audits]]))
        found.append(exact(todo[sample]))
        there = np.bincount(found[-1][0], minlength=len(queries))[todo[sample]]
        rest = ~full
        rest[sample] = False
        if (counts[sample] >= recall * there).all():
            found.append((todo[q[rest[q]]], hit[rest[q]]))
            return joined(found)
        todo, node, beam = todo[rest], node[rest], 2 * beam
    found.append(exact(todo))
    return joined(found)


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, shards: int = SHARDS, beam: int = BEAM, recall: float = RECALL) -> DataFrame:
    """One row for each row of ``df``: the key, ``n_links`` (other vectors linked directly),
    ``component_id`` (smallest key reachable by links, its own included), ``kept``.

    Vectors that are null, empty, zero or have null or non-finite components have no
    links, vectors of different lengths none with each other, and rows with a null key are not
    compared (their component is null, they are kept). Rows that repeat a key and a vector link with
    each other like other equal vectors. A task
    holds two shards at most, of SHARD_ROWS vectors each, and one block.
    """
    spark = df.sparkSession
    base = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("vector").isNotNull() & F.col("key").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    good = base.where(usable).withColumn("vector", F.transform("vector", lambda x: x + 0.0))
    classes = storage.written(good.groupBy("vector").agg(F.min("key").alias("rep"), F.count("*").alias("copies")), "classes")
    classes_count = classes.count()
    number, parts = max(shards, -(-classes_count // SHARD_ROWS)), max(1, classes_count // (BLOCK_ROWS * TASK_BLOCKS))
    reps = classes.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("rep"), F.lit(number)).cast("int").alias("shard"), F.col("rep").alias("key"), "copies", "vector")
    folder = storage.scratch(spark, "graphs")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    made = build_shards(reps, folder)
    asked = made.select("dim", F.col("shard").alias("source"), "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK_ROWS).cast("long"))).alias("lo"))
    asked = asked.join(made.select("dim", F.col("shard").alias("target")), "dim").withColumn("part", F.pmod(F.xxhash64("source", "lo"), F.lit(parts)))
    asked = asked.select("dim", "target", "part", "source", "lo", F.least(F.col("lo") + BLOCK_ROWS, "n").alias("hi"))
    # the rows are few and small, but each is much work: by number, so that they are not put together again
    asked = asked.repartition(min(number * parts, 50_000), "dim", "target", "part").sortWithinPartitions("dim", "target", "source", "lo")
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for dim, target, _, source, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                graph, unit = _shard(folder, f"{dim}-{target}", dim)
                all_keys, copies = _keys(folder, f"{dim}-{target}")
                own = _keys(folder, f"{dim}-{source}")[0].slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                keys = all_keys.to_numpy(zero_copy_only=False)
                q, node = links_of_block(graph, unit, _vectors(folder, f"{dim}-{source}", dim, lo, hi), cosine, beam, AUDITS, recall)
                other = own[q] != keys[node]
                q, node = q[other], node[other]
                counts = np.bincount(q, weights=copies[node], minlength=len(own)).astype(np.int64)
                at = np.flatnonzero(counts)
                sets = UnionFind()
                edges = [(a, b) for a, b in zip(own[q].tolist(), keys[node].tolist(), strict=True) if sets.union(a, b)]
                a = pa.concat_arrays([pc.cast(pa.array(own[at]), all_keys.type), pa.array([e[0] for e in edges], all_keys.type)])
                b = pa.concat_arrays([pa.nulls(len(at), all_keys.type), pa.array([e[1] for e in edges], all_keys.type)])
                yield pa.RecordBatch.from_arrays([a, b, pa.array(np.concatenate([counts[at], np.zeros(len(edges), np.int64)]))], names=["a", "b", "n"])

    found = storage.written(arrow.mapped(asked, run, f"a {kind}, b {kind}, n long"), "links")
    labels = components(found.where("b IS NOT NULL").select("a", "b"))
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("_n"))
    whole = classes.join(counts, F.col("rep") == F.col("a"), "left").join(labels, F.col("rep") == F.col("node"), "left")
    whole = whole.select("vector", (F.coalesce("_n", F.lit(0)) + F.col("copies") - 1).alias("_links"), F.coalesce("component", "rep").alias("_component"))
    rows = base.withColumn("vector", F.when(usable, F.transform("vector", lambda x: x + 0.0))).join(whole, "vector", "left")
    component = F.coalesce("_component", "key")
    return rows.select(F.col("key").alias(key), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))
