"""Sharding (8): minimum-cost-flow resharding that moves the fewest bytes.

From the old shards' sizes and the new shards' capacities a minimum-cost flow (moving a byte costs 1, leaving it
costs 0) gives the bytes each old shard sends to each new one. It is solved on the driver over the shards alone,
never over rows. Each old shard's rows are then laid end to end by prefix sums, in two levels (fixed blocks of
rows, then rows within a block), and a row goes where its middle byte lies in the flow's ranges. So a new shard
differs from its capacity by about half a row for each range that ends in it. Slots are numbered the same way.

Null texts have no bytes, only the fixed overhead of a row; null or new old shards start empty; repeated rows and
ties are rows of their own; an empty table gives no rows and no transfers.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

SHARDS, OVERHEAD = 24, 8
#: Rows numbered together: 2 to this power.
BLOCK_POWER = 12


def min_cost_flow(sizes: dict[int, int], capacities: dict[int, int], cost=lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard at the least total cost, by successive cheapest paths with potentials."""
    if sum(sizes.values()) > sum(capacities.values()):
        raise ValueError("the new shards are too small")
    old, new = [("old", i) for i in sorted(sizes)], [("new", j) for j in sorted(capacities)]
    flow = {(i, j): 0 for _, i in old for _, j in new}
    left, room = dict(sizes), dict(capacities)
    potential = {n: 0 for n in old + new}
    while any(left.values()):
        dist: dict = {}
        came: dict = {}
        heap = [(0, n) for n in old if left[n[1]]]
        best = {n: 0 for _, n in heap}
        while heap:
            d, n = heapq.heappop(heap)
            if n in dist:
                continue
            dist[n] = d
            if n[0] == "old":
                steps = [(("new", j), cost(n[1], j)) for _, j in new]
            else:
                steps = [(("old", i), -cost(i, n[1])) for _, i in old if flow[i, n[1]]]
            for m, c in steps:
                e = d + c + potential[n] - potential[m]
                if m not in dist and e < best.get(m, 1 << 62):
                    best[m], came[m] = e, n
                    heapq.heappush(heap, (e, m))
        far = max(dist.values())
        for n in potential:
            potential[n] += dist.get(n, far)
        end = min((n for n in new if room[n[1]] and n in dist), key=lambda n: (potential[n], n))
        path = [end]
        while path[-1] in came:
            path.append(came[path[-1]])
        path.reverse()
        amount = min([left[path[0][1]], room[end[1]], *(flow[b[1], a[1]] for a, b in zip(path, path[1:]) if a[0] == "new")])
        for a, b in zip(path, path[1:]):
            if a[0] == "old":
                flow[a[1], b[1]] += amount
            else:
                flow[b[1], a[1]] -= amount
        left[path[0][1]] -= amount
        room[end[1]] -= amount
    return {k: v for k, v in flow.items() if v}


def even(total: int, shards: int) -> dict[int, int]:
    """Capacities that differ by a byte at most and hold exactly ``total``."""
    return {j: (total * (j + 1)) // shards - (total * j) // shards for j in range(shards)}


def sized(docs: DataFrame, old: Column, *, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, old_shard and a row number that stays (the rows are written)."""
    body = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(body) + OVERHEAD).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"), F.coalesce(old.cast("int"), F.lit(0)).alias("old_shard"))
    return saved(rows.withColumn("row", F.monotonically_increasing_id()))


def _before(totals: DataFrame, by: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """For each row of a table of totals, the sums of the rows of its group that come before."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(*by, *order, *[F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"{s}_before") for s in sums])


def reshard(rows: DataFrame, capacities=None, *, shards: int = SHARDS, block_power: int = BLOCK_POWER) -> DataFrame:
    """``rows`` (as from ``sized``) with shard, slot (gapless from 0) and moved (whether the row leaves its old shard).

    ``capacities`` gives bytes by new shard; by default the whole is divided evenly.
    """
    blocked = rows.withColumn("block", F.shiftright("row", block_power))
    totals = blocked.groupBy("old_shard", "block").agg(F.sum("size").alias("size"))
    sizes = {r["old_shard"]: r["size"] for r in totals.groupBy("old_shard").agg(F.sum("size").alias("size")).collect()}
    flow = min_cost_flow(sizes, capacities or even(sum(sizes.values()), shards))
    ranges, at = [], dict.fromkeys(sizes, 0)
    for (i, j), amount in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):  # what stays comes first
        ranges.append((i, at[i], at[i] + amount, j))
        at[i] += amount
    where = F.lit(None).cast("int")
    for i, lo, hi, j in ranges:
        where = F.when((F.col("old_shard") == i) & (F.col("middle") >= 2 * lo) & (F.col("middle") < 2 * hi), j).otherwise(where)

    w = W.partitionBy("old_shard", "block").orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    before = _before(totals, ["old_shard"], ["block"], ["size"])
    laid = blocked.withColumn("end", F.sum("size").over(w)).join(before, ["old_shard", "block"])
    placed = laid.withColumn("middle", 2 * (F.col("size_before") + F.col("end")) - F.col("size")).withColumn("shard", where)
    in_block = W.partitionBy("old_shard", "block", "shard").orderBy("row")
    placed = saved(placed.select("doc_id", "size", "text_crc32", "old_shard", "block", "shard", (F.row_number().over(in_block) - 1).alias("place")))
    counts = placed.groupBy("shard", "old_shard", "block").agg(F.count("*").alias("n"))
    first = _before(counts, ["shard"], ["old_shard", "block"], ["n"])
    done = placed.join(first, ["shard", "old_shard", "block"])
    return done.select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("n_before") + F.col("place")).cast("bigint").alias("slot"), (F.col("shard") != F.col("old_shard")).alias("moved"))


def rewrite(docs: DataFrame, plan: DataFrame, path: str, *, max_rows: int = 1_000_000) -> list[int]:
    """Write the shards whose rows changed, as ``path/shard=N``; gives their numbers. Ids must be unique and not null.

    Columns of ``docs`` named shard or slot are replaced. Files hold ``max_rows`` rows at most and a shard's rows are written by many tasks.
    """
    ids = docs.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).first()
    if ids["n"] != ids["d"]:
        raise ValueError("doc_id must be unique and not null")
    moves = plan.where("moved").select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    affected = sorted(r["shard"] for r in moves.collect())
    rows = docs.drop("shard", "slot").join(plan.where(F.col("shard").isin(affected)).select("doc_id", "shard", "slot"), "doc_id")
    rows = rows.repartition("shard", F.floor(F.col("slot") / max_rows)).sortWithinPartitions("shard", "slot")
    rows.write.option("maxRecordsPerFile", max_rows).partitionBy("shard").mode("append").parquet(path)
    return affected


def shard_report(docs: DataFrame) -> DataFrame:
    """Every document in a shard of 0 to 23 with sizes near equal; before, each source was in the shard of its name's hash."""
    old = F.crc32(F.coalesce(F.col("source").cast("string"), F.lit("")).cast("binary")) % SHARDS
    return reshard(sized(docs, old)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")
