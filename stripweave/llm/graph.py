"""Connected components of an edge table, by local union-find and star contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def find(parent: dict, x):
    root = x
    while (p := parent.setdefault(root, root)) != root:
        root = p
    while parent[x] != root:
        parent[x], x = root, parent[x]
    return root


def unite(parent: dict, a, b) -> None:
    a, b = find(parent, a), find(parent, b)
    if a != b:
        parent[max(a, b)] = min(a, b)


def _forest(edges: DataFrame) -> DataFrame:
    """Each batch's edges (u, v) reduced to stars around the least node, by union-find; as many rows at most."""

    def reduce(batches):
        for batch in batches:
            parent: dict = {}
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                unite(parent, u, v)
            rows = [(x, r) for x in parent if (r := find(parent, x)) != x]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], batch.schema.field(i).type) for i in (0, 1)], ["u", "v"])

    return edges.mapInArrow(reduce, edges.schema)


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) to rows (u, v): every node that isn't the least of its component, with the least.

    Rounds of large-star and small-star until nothing changes; each is written, so a lost executor costs one round.
    No edges give no rows; nulls and loops are left out.
    """
    e = saved(_forest(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()))
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == mark or not now[0]:
            return e
        mark = now
        e = saved(_small_star(_large_star(e)))
