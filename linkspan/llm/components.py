"""Connected components by alternating large and small stars.

Each round is two aggregations and two joins. Least neighbours are written before
they are joined, so both sides of a join are plain exchanges and Spark can split
a hot node; the edge set is written to the shared folder between rounds, so
neither lineage nor the driver grows with it. Rounds grow with the logarithm of
the graph's size; before the first one, each task replaces the edges it reads by
a forest of depth one, so few are needed. A graph of ONE_TASK edges or fewer (a few
MB) is finished by one task in the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


#: Edges that one task may hold.
ONE_TASK = 1 << 18


def stars(batches):
    """The edges of a task as edges to the smallest node that they lead to."""
    u, v = [], []
    for batch in batches:
        u.append(batch.column("u").to_numpy())
        v.append(batch.column("v").to_numpy())
    if not u:
        return
    u, v = np.concatenate(u), np.concatenate(v)
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = spanned(len(nodes), at[: len(u)], at[len(u) :])
    child = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[root[child]])], names=["u", "v"])


def spanned(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the edges a, b."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    least = written(least, "least")
    found = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
    dropped(least)
    return found


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    linked = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    found = linked.unionByName(least.select("u", F.col("m").alias("v")))
    after = written(found.where("u <> v").distinct(), "edges")
    dropped(least)
    return after


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for every node of edges (u, v bigint); root is the component's
    smallest node. Loops and repeated edges are fine; no edges give no rows."""
    def shape(df):
        row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))).alias("s")).first()
        return tuple(row)

    def rooted(df):
        roots = df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
        return df.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

    schema = "u bigint, v bigint"
    now = written(edges.where("u <> v").select("u", "v").mapInArrow(stars, schema), "edges")
    if now.count() <= one_task:
        whole = written(now.coalesce(1).mapInArrow(stars, schema), "edges")
        dropped(now)
        return rooted(whole)
    before = shape(now)
    while before[0]:
        large = _large_star(now)
        after = _small_star(large)
        dropped(large)
        dropped(now)
        now, last, before = after, before, shape(after)
        if before == last:
            break
    return rooted(now)
