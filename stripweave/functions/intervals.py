"""Joins on intervals, nearest positions and per-group facts that hold under skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stripweave.functions.ordered import join_on

SALTS = 64


def on_group(df: DataFrame, facts: DataFrame, keys: Sequence[str], spread: Column, hot: bool, how: str = "inner") -> DataFrame:
    """Attach one row of facts per group. In hot groups the rows are spread over salts first. A null key is a key like any other."""
    keys = list(keys)
    if not hot:
        return join_on(df, facts, keys, how)
    salted = df.withColumn("_salt", F.coalesce(F.pmod(spread.cast("long"), F.lit(SALTS)), F.lit(0)).cast("int"))
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return join_on(salted, copies, [*keys, "_salt"], how).drop("_salt")


def points_in(points: DataFrame, spans: DataFrame, keys: Sequence[str], point: str, start: Column, end: Column,
              width: int, how: str = "inner") -> DataFrame:
    """Join points with the half-open spans holding them, on (keys, bucket of ``width``)."""
    p = points.withColumn("_bucket", F.floor(F.col(point) / width).cast("long"))
    s = spans.withColumns({"_s": start, "_e": end}).filter("_e > _s").withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col("_s") / width).cast("long"), F.floor(F.col("_e") / width).cast("long"))))
    joined = p.alias("p").join(
        s.alias("s"),
        [F.col(f"p.{k}") == F.col(f"s.{k}") for k in keys] + [F.col("p._bucket") == F.col("s._bucket"),
         F.col(f"p.{point}") >= F.col("s._s"), F.col(f"p.{point}") < F.col("s._e")], how)
    return joined.select("p.*", *[f"s.{c}" for c in spans.columns if c not in keys]).drop("_bucket")


def overlapping(a: DataFrame, b: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Pairs of half-open spans that overlap. ``a`` has (a0, a1), ``b`` has (b0, b1).

    Both sides are cut into buckets of ``width``; a pair is kept only in the bucket where the
    overlap starts, so nothing has to be made distinct afterwards.
    """
    def cut(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.filter(F.col(hi) > F.col(lo)).withColumn("_bucket", F.explode(F.sequence(
            F.floor(F.col(lo) / width).cast("long"), F.floor((F.col(hi) - 1) / width).cast("long"))))

    x, y = cut(a, "a0", "a1").alias("a"), cut(b, "b0", "b1").alias("b")
    cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [
        F.col("a._bucket") == F.col("b._bucket"),
        F.col("a0") < F.col("b1"), F.col("b0") < F.col("a1"),
        F.floor(F.greatest("a0", "b0") / width) == F.col("a._bucket"),
    ]
    return x.join(y, cond).select("a.*", *[f"b.{c}" for c in b.columns if c not in keys]).drop("_bucket")


def islands(df: DataFrame, keys: Sequence[str], lo: str, hi: str, hot: bool, name: str = "island", slack: int = 0) -> DataFrame:
    """Number groups of spans chained by overlap (a gap below ``slack`` still chains); spans with the same start are always together.

    In hot groups spans with the same start are first combined to their furthest end, so a group holds one row
    per start however many spans it has.
    """
    from stripweave.functions.ordered import max_before, scan, sum_to

    keys = list(keys)
    if not hot:
        w = Window.partitionBy(*keys).orderBy(lo)
        reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
        marked = df.withColumn("_break", F.when(reach.isNull() | ((F.col(lo) >= reach + slack) & ~F.lag(lo).over(w).eqNullSafe(F.col(lo))), 1).otherwise(0))
        return marked.withColumn(name, F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_break")
    tops = df.groupBy(*keys, lo).agg(F.max(hi).alias("_hi"))
    reach = scan(tops, keys, [lo], hot, _reach=max_before(F.col("_hi")))
    broken = reach.withColumn("_break", F.when(F.col("_reach").isNull() | (F.col(lo) >= F.col("_reach") + slack), 1).otherwise(0))
    numbered = scan(broken, keys, [lo], hot, **{name: sum_to(F.col("_break"))}).select(*keys, lo, name)
    return on_group(df, numbered, [*keys, lo], F.xxhash64(*df.columns), hot)
