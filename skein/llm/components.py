"""Connected components of an edge table: bounded local contraction, then alternating large and small stars.

Contraction: the edges are dealt out in lots of at most CHUNK, and each lot is replaced by a spanning forest of itself (a
row per node at most). That is repeated while it at least halves the edges; when all edges fit into one lot, its forest is
the answer. What is left beyond that goes through star rounds, each of which deals edges out by node twice, takes minima
with partial aggregation and keeps the number of edges from growing; rounds grow with the logarithm of the nodes. Every
step is a written table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import removed, stored

#: Edges that are contracted at once.
CHUNK = 1 << 20
#: Rows of a batch handed back to Spark.
ROWS = 20_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, their components' smallest nodes) of a graph, without the smallest nodes themselves."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    up = np.arange(len(ids))
    while len(a):
        x, y = up[a], up[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up, higher := up[up]):
            up = higher
    below = np.flatnonzero(up != np.arange(len(ids)))
    return ids[below], ids[up[below]]


def _forest(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Forests of a partition's edges; a forest is contracted again with the edges after it, so a partition gives few more rows than it has nodes."""

    def close(held):
        return forest(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))

    held, size = [], 0
    for b in batches:
        held.append((b["u"].to_numpy(), b["v"].to_numpy()))
        size += len(b)
        if size >= chunk:
            held = [close(held)]
            size = len(held[0][0])
            if size > chunk // 2:
                yield from _rows(*held.pop())
                size = 0
    if held:
        yield from _rows(*close(held))


def _rows(u: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(u), ROWS):
        yield pa.record_batch([pa.array(u[k : k + ROWS]), pa.array(v[k : k + ROWS])], ["u", "v"])


def components(edges: DataFrame, chunk: int | None = None, made: list[str] | None = None) -> DataFrame:
    """(node, component) for every node of the edges (u, v); component is its smallest node. made gets the path of the table that it is read from; those on the way are removed."""
    chunk, spark, own = chunk or CHUNK, edges.sparkSession, []
    work = stored(edges.select("u", "v").filter("u != v").mapInArrow(lambda it: _forest(it, chunk), "u long, v long"), "edges", own)

    def done(df: DataFrame) -> DataFrame:
        for path in own[:-1]:
            removed(spark, path)
        if made is not None:
            made.append(own[-1])
        return _named(df)

    size = work.count()
    while size:
        lots = -(-size // chunk)
        work = stored(work.repartition(lots).mapInArrow(lambda it: _forest(it, 2 * chunk), "u long, v long"), "forest", own)
        if lots == 1:
            return done(work)
        before, size = size, work.count()
        if 2 * size > before:
            break
    before = None
    while size:
        # large star: the larger neighbours of a node go to its smallest
        both = work.select("u", "v").union(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        work = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "star", own)
        now = work.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    return done(work)


def _named(work: DataFrame) -> DataFrame:
    return work.select(F.col("u").alias("node"), F.col("v").alias("component")).union(work.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
