"""Windows, row numbers and folds over ordered groups of any size.

A group is a chapter, strip, block, series or key. Where the largest group is proven small (one
count per group, map-side combined, one number to the driver) all rules are plain windows on the
group key, so a chain of them costs one shuffle. Where a group is too large for one task the same
rules run in two levels: windows inside (group, chunk of positions), totals per chunk, and a
window over the totals. Both give the same rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from stripweave.session import durable, number_setting

GROUP_ROWS = "spark.stripweave.groupRows"
CHUNK_ROWS = "spark.stripweave.chunkRows"
DEFAULT_GROUP_ROWS = 1_000_000
DEFAULT_CHUNK_ROWS = 65_536

_largest: dict[tuple, int] = {}


def _sizes(df: DataFrame) -> tuple | None:
    """Bytes of each stored table a plan reads, one number a table; None where it reads anything else."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if not leaf.getClass().getSimpleName().startswith("LogicalRelation"):
            return None
        found.append(leaf.relation().location().sizeInBytes())
    return tuple(found)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group; counted again unless the plan and the sizes of the tables it reads are the same.

    Only the form of a plan depends on this, never its rows, so a table rewritten with the same size costs no more than speed.
    """
    probe = df.groupBy(*keys).count().agg(F.max("count").alias("n"))
    files = _sizes(df)
    mark = None if files is None else (df.sparkSession.sparkContext.applicationId, probe.semanticHash(), files)
    if mark is not None and mark in _largest:
        return _largest[mark]
    n = probe.first()["n"] or 0
    if mark is not None:
        _largest[mark] = n
    return n


def is_hot(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether some group is too large to be handled by one task."""
    return largest_group(df, keys) > number_setting(df.sparkSession, GROUP_ROWS, DEFAULT_GROUP_ROWS)


def join_on(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null, so rows with a null key form a group like any other."""
    there = b.select(*[F.col(c).alias(f"__on_{c}") if c in keys else F.col(c) for c in b.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__on_{k}"))
    return a.join(there, same, how).drop(*[f"__on_{k}" for k in keys])


@dataclass(frozen=True)
class Scan:
    kind: str
    value: Column


def sum_to(value: Column) -> Scan:
    """Running sum, the row included."""
    return Scan("sum_to", value)


def sum_before(value: Column) -> Scan:
    """Running sum of the rows before."""
    return Scan("sum_before", value)


def max_to(value: Column) -> Scan:
    return Scan("max_to", value)


def max_before(value: Column) -> Scan:
    return Scan("max_before", value)


def min_after(value: Column) -> Scan:
    """Smallest value of the rows after."""
    return Scan("min_after", value)


def prev(value: Column) -> Scan:
    """Value of the row before."""
    return Scan("prev", value)


def next_(value: Column) -> Scan:
    """Value of the row after."""
    return Scan("next", value)


def last_to(value: Column) -> Scan:
    """Last non-null value up to the row."""
    return Scan("last_to", value)


def last_before(value: Column) -> Scan:
    return Scan("last_before", value)


def first_from(value: Column) -> Scan:
    """First non-null value from the row on."""
    return Scan("first_from", value)


def first_after(value: Column) -> Scan:
    return Scan("first_after", value)


_BACK = {"sum_before", "max_before", "last_before"}
_FORWARD = {"min_after", "next", "first_from", "first_after"}


def _inside(kind: str, v: Column, w) -> Column:
    to, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    since, after = w.rowsBetween(0, W.unboundedFollowing), w.rowsBetween(1, W.unboundedFollowing)
    match kind:
        case "sum_to":
            return F.sum(v).over(to)
        case "sum_before":
            return F.sum(v).over(before)
        case "max_to":
            return F.max(v).over(to)
        case "max_before":
            return F.max(v).over(before)
        case "min_after":
            return F.min(v).over(after)
        case "prev":
            return F.lag(v).over(w)
        case "next":
            return F.lead(v).over(w)
        case "last_to":
            return F.last(v, ignorenulls=True).over(to)
        case "last_before":
            return F.last(v, ignorenulls=True).over(before)
        case "first_from":
            return F.first(v, ignorenulls=True).over(since)
        case "first_after":
            return F.first(v, ignorenulls=True).over(after)
    raise ValueError(kind)


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: bool, **scans: Scan) -> DataFrame:
    """Add one column per scan. ``order[0]`` is an integer position, the rest break ties."""
    keys, order = list(keys), list(order)
    if not hot:
        w = W.partitionBy(*keys).orderBy(*order)
        out = df
        new = {}
        for name, s in scans.items():
            col = _inside(s.kind, s.value, w)
            new[name] = F.coalesce(col, F.lit(0)) if s.kind.startswith("sum") else col
        return out.withColumns(new)
    size = number_setting(df.sparkSession, CHUNK_ROWS, DEFAULT_CHUNK_ROWS)
    base = df.withColumns({f"__v_{n}": s.value for n, s in scans.items()})
    base = durable(base.withColumn("__chunk", F.floor(F.col(order[0]) / size).cast("long")))
    w = W.partitionBy(*keys, "__chunk").orderBy(*order)
    local = base.withColumns(
        {f"__l_{n}": _inside(s.kind, F.col(f"__v_{n}"), w) for n, s in scans.items()}
        | {"__head": F.lag(F.lit(True)).over(w).isNull(), "__tail": F.lead(F.lit(True)).over(w).isNull()}
    )
    at = F.struct(*order)
    totals, carry = {}, {}
    wk = W.partitionBy(*keys).orderBy("__chunk")
    back, fore = wk.rowsBetween(W.unboundedPreceding, -1), wk.rowsBetween(1, W.unboundedFollowing)
    for n, s in scans.items():
        v, t = F.col(f"__v_{n}"), F.col(f"__t_{n}")
        if s.kind.startswith("sum"):
            totals[n], carry[n] = F.sum(v), F.sum(t).over(back)
        elif s.kind.startswith("max"):
            totals[n], carry[n] = F.max(v), F.max(t).over(back)
        elif s.kind == "min_after":
            totals[n], carry[n] = F.min(v), F.min(t).over(fore)
        elif s.kind == "prev":
            totals[n], carry[n] = F.max_by(F.struct(v.alias("v")), at), F.lag(t["v"]).over(wk)
        elif s.kind == "next":
            totals[n], carry[n] = F.min_by(F.struct(v.alias("v")), at), F.lead(t["v"]).over(wk)
        elif s.kind.startswith("last"):
            totals[n] = F.max(F.when(v.isNotNull(), F.struct(*order, v.alias("_x"))))
            carry[n] = F.last(t["_x"], ignorenulls=True).over(back)
        else:
            totals[n] = F.min(F.when(v.isNotNull(), F.struct(*order, v.alias("_x"))))
            carry[n] = F.first(t["_x"], ignorenulls=True).over(fore)
    per_chunk = base.groupBy(*keys, "__chunk").agg(*[c.alias(f"__t_{n}") for n, c in totals.items()])
    carried = (
        per_chunk.withColumns({f"__c_{n}": c for n, c in carry.items()} | {"__n": F.count(F.lit(1)).over(W.partitionBy(*keys))})
        .filter("__n > 1").select(*keys, "__chunk", *[f"__c_{n}" for n in scans])
    )
    out = join_on(local, carried, [*keys, "__chunk"], "left")
    new = {}
    for n, s in scans.items():
        here, far = F.col(f"__l_{n}"), F.col(f"__c_{n}")
        if s.kind.startswith("sum"):
            new[n] = F.coalesce(far, F.lit(0)) + F.coalesce(here, F.lit(0))
        elif s.kind.startswith("max"):
            new[n] = F.greatest(far, here)
        elif s.kind == "min_after":
            new[n] = F.least(far, here)
        elif s.kind == "prev":
            new[n] = F.when(F.col("__head"), far).otherwise(here)
        elif s.kind == "next":
            new[n] = F.when(F.col("__tail"), far).otherwise(here)
        else:
            new[n] = F.coalesce(here, far)
    return out.withColumns(new).select(*df.columns, *scans)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str, hot: bool | None = None) -> DataFrame:
    """``row_number() - 1`` per group.

    Hot groups: rows are range partitioned by (keys, order), which cuts a group over many tasks,
    numbered inside each range and shifted by the counts of the ranges before.
    """
    keys = list(keys)
    if hot is None:
        hot = is_hot(df, keys)
    if not hot:
        return df.withColumn(name, (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    ranged = durable(df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()))
    inside = F.row_number().over(W.partitionBy(*keys, "__range").orderBy(*order)) - 1
    before = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    shift = ranged.groupBy(*keys, "__range").count().select(
        *keys, "__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__shift"))
    return (
        join_on(ranged.withColumn("__inside", inside), shift, [*keys, "__range"])
        .withColumn(name, (F.col("__inside") + F.col("__shift")).cast("long")).select(*df.columns, name)
    )


def number_wide(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, hot: bool | None = None) -> DataFrame:
    """``number_rows`` for rows that are costly to move: only the values of (keys, order) are put in order, and each row meets its
    number in one shuffle by those values, so no task sorts the rows of a whole group."""
    keys, order = list(keys), list(order)
    if hot is None:
        hot = is_hot(df, keys)
    counts = df.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("__c"))
    if hot:
        counts, order = number_rows(counts, keys, order, "__p", True), ["__p", *order]
    first = scan(counts, keys, order, hot, __first=sum_before(F.col("__c")))
    # a struct is never null, so null values are values like any other, and the window and the join share one shuffle
    at = F.struct(*keys, *[c for c in order if c != "__p"])
    own = df.withColumn("__at", at)
    own = own.withColumn("__i", F.row_number().over(W.partitionBy("__at").orderBy("__at")) - 1)
    return own.join(first.select(at.alias("__at"), "__first"), "__at").withColumn(name, (F.col("__first") + F.col("__i")).cast("long")).select(*df.columns, name)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that later lambdas read: the generator keeps the optimizer from copying
    the expression into every use."""
    names = list(columns)
    packed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.withColumn("_once", packed).select(*df.columns, *[F.col(f"_once.{n}").alias(n) for n in names])


def spread(df: DataFrame, low: Column, high: Column, step: Column | int, name: str, span: int = 1024) -> DataFrame:
    """A row for each of ``low, low + step, .. <= high`` in the long column ``name``; none where ``high`` is lower or null.

    Made in two levels, stretches and then at most ``span`` values of each, so no array grows with the range.
    """
    step = F.lit(step) if isinstance(step, int) else step
    far = df.withColumns({"_sp0": low.cast("long"), "_sp1": high.cast("long"), "_sps": step.cast("long")}).filter("_sp1 >= _sp0")
    wide = F.col("_sps") * span
    cut = far.withColumn("_spc", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_sp1") - F.col("_sp0")) / (wide * span)))))
    last = F.floor((F.col("_sp1") - F.col("_sp0")) / wide) - F.col("_spc") * span
    cut = cut.withColumn("_spd", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.least(last, F.lit(span - 1).cast("long")))))).withColumn("_spa", F.col("_sp0") + (F.col("_spc") * span + F.col("_spd")) * wide).filter("_spa <= _sp1")
    return cut.withColumn(name, F.explode(F.sequence("_spa", F.least(F.col("_sp1"), F.col("_spa") + wide - F.col("_sps")), F.col("_sps")))).drop("_sp0", "_sp1", "_sps", "_spc", "_spd", "_spa")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per group, the first by ``order``; combines before the shuffle, so hot keys are safe."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def runs(df: DataFrame, keys: Sequence[str], pos: str, hot: bool, where: Column, **aggs: Column) -> DataFrame:
    """Maximal runs of consecutive positions (dense, step 1) where the predicate holds."""
    flagged = df.withColumn("_on", where)
    marked = scan(flagged, keys, [pos], hot, _off=sum_to(F.when(F.col("_on"), 0).otherwise(1)))
    return (
        marked.filter("_on").groupBy(*keys, "_off")
        .agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"), *[c.alias(n) for n, c in aggs.items()])
        .drop("_off")
    )


# --- Sequential rules ------------------------------------------------------------------------
Step = Callable[[dict[str, np.ndarray], object], tuple[dict[str, list], object]]


def _empty_state(schema: T.StructType) -> T.StructType:
    return T.StructType([*[T.StructField(f.name, f.dataType, True) for f in schema.fields], T.StructField("_state", T.BinaryType(), True)])


Finish = Callable[[object], dict[str, list]]


def _differs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where neighbouring keys differ; null equals null."""
    none_a, none_b = pd.isna(a), pd.isna(b)
    return (none_a != none_b) | (~none_a & ~none_b & (a != b))


def _runner(keys: list[str], columns: list[str], step: Step | None, finish: Finish | None, fields: list[str], keep_state: bool):
    """Walk sorted batches, hand each whole group to ``step``, emit the rows in bulk."""

    def run(batches):
        names = list(dict.fromkeys([*keys, *columns]))
        held: list[dict[str, np.ndarray]] = []
        held_key = None

        def put(out, key, rows):
            n = len(next(iter(rows.values()))) if rows else 0
            if n:
                for f in fields:
                    out[f].extend([key[f]] * n if f in key and f not in rows else rows.get(f, []))
            return n

        def close(pieces, values, out):
            group = pieces[0] if len(pieces) == 1 else {c: np.concatenate([p[c] for p in pieces]) for c in pieces[0]}
            key = dict(zip(keys, values))
            state = None
            if "_state" in group:
                marks = np.array([x is not None for x in group["_state"]])
                if marks.any():
                    state = pickle.loads(group["_state"][marks][0])
                    group = {c: x[~marks] for c, x in group.items()}
            rows = {}
            if step is not None and len(group[keys[0]]):
                rows, state = step({c: group[c] for c in columns}, state)
            n = put(out, key, rows)
            if keep_state:
                out["_state"].extend([None] * n)
                for f in fields:
                    out[f].append(key.get(f))
                out["_state"].append(pickle.dumps(state))
            elif finish is not None:
                put(out, key, finish(state))

        def fresh():
            return {f: [] for f in ([*fields, "_state"] if keep_state else fields)}

        for batch in batches:
            if batch.empty:
                continue
            out = fresh()
            # one array per column of the batch; a group is a slice of them
            arrays = {c: batch[c].to_numpy() for c in (*names, *(["_state"] if "_state" in batch.columns else []))}
            changed = np.zeros(len(batch), dtype=bool)
            for k in keys:
                changed[1:] |= _differs(arrays[k][1:], arrays[k][:-1])
            bounds = [0, *np.flatnonzero(changed).tolist(), len(batch)]
            heads = [[None if lost else x for x, lost in zip(arrays[k][bounds[:-1]], pd.isna(arrays[k][bounds[:-1]]))] for k in keys]
            for a, b, *key in zip(bounds[:-1], bounds[1:], *heads):
                piece = {c: x[a:b] for c, x in arrays.items()}
                if held and key == held_key:
                    held.append(piece)
                    continue
                if held:
                    close(held, held_key, out)
                held, held_key = [piece], key
            yield pd.DataFrame(out, dtype=object)
        if held:
            out = fresh()
            close(held, held_key, out)
            yield pd.DataFrame(out, dtype=object)

    return run


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, schema: str, hot: bool,
         finish: Finish | None = None) -> DataFrame:
    """Rules where each row depends on what earlier rows decided.

    ``step(columns, state) -> (rows, state)`` gets one group as arrays in order; ``finish(state)``
    gives the rows known only at the end of the group. A group too large for one task is handed over
    chunk by chunk: every round takes the next chunk of each group still open, with the state of the
    chunk before, and is made durable. The key columns need not be among the returned rows.
    """
    keys, order = list(keys), list(order)
    columns = df.columns
    target = T.StructType.fromDDL(schema)
    fields = target.fieldNames()
    # a step costs far more than its bytes: spread over all partitions, not by size
    parts = number_setting(df.sparkSession, "spark.sql.shuffle.partitions", 200)
    if not hot:
        sorted_rows = df.repartition(parts, *keys).sortWithinPartitions(*keys, *order)
        return sorted_rows.mapInPandas(_runner(keys, columns, step, finish, fields, False), target)
    size = number_setting(df.sparkSession, CHUNK_ROWS, DEFAULT_CHUNK_ROWS)
    rows = durable(number_rows(df, keys, order, "__n", hot=True).withColumn("__chunk", F.floor(F.col("__n") / size)))
    last = rows.agg(F.max("__chunk")).first()[0]
    hidden = [k for k in keys if k not in fields]
    wide = _empty_state(T.StructType([*target.fields, *[df.schema[k] for k in hidden]]))
    out, state = None, None

    def add(new: DataFrame) -> None:
        nonlocal out
        out = new if out is None else out.unionByName(new)

    def ended(states: DataFrame) -> None:
        if finish is not None:
            add(states.mapInPandas(_runner(keys, [], None, finish, fields, False), target))

    for c in range(0 if last is None else last + 1):
        part = rows.filter(F.col("__chunk") == c).drop("__chunk").withColumn("_state", F.lit(None).cast("binary"))
        if state is not None:
            open_keys = part.select(*keys).distinct()
            ended(join_on(state, open_keys, keys, "left_anti"))
            part = part.unionByName(join_on(state, open_keys, keys, "left_semi"), allowMissingColumns=True)
        ordered = part.repartition(parts, *keys).sortWithinPartitions(*keys, F.col("_state").isNull(), "__n")
        done = durable(ordered.mapInPandas(_runner(keys, columns, step, finish, [*fields, *hidden], True), wide))
        add(done.filter("_state is null").select(*fields))
        state = done.filter("_state is not null").select(*keys, "_state")
    if state is not None:
        ended(state)
    return out if out is not None else df.sparkSession.createDataFrame([], target)


def median_by(df: DataFrame, keys: Sequence[str], value: str, name: str, hot: bool) -> DataFrame:
    """Exact median per group: by rank over split groups where one is too large for one task."""
    keys = list(keys)
    kept = df.filter(F.col(value).isNotNull()).select(*keys, value)
    if not hot:
        return kept.groupBy(*keys).agg(F.median(value).alias(name))
    # equal values are one row with their number, combined before the shuffle, so a group costs at most its distinct values
    ranged = durable(kept.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")).repartitionByRange(*keys, value).withColumn("__range", F.spark_partition_id()))
    inside = F.sum("_c").over(W.partitionBy(*keys, "__range").orderBy(value))
    earlier = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    parts = ranged.groupBy(*keys, "__range").agg(F.sum("_c").alias("_p")).select(
        *keys, "__range", F.coalesce(F.sum("_p").over(earlier), F.lit(0)).alias("_shift"), F.sum("_p").over(W.partitionBy(*keys)).alias("_n"))
    placed = join_on(ranged.withColumn("_to", inside), parts, [*keys, "__range"]).withColumn("_to", F.col("_to") + F.col("_shift"))
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)

    def at(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("_to")) & (rank >= F.col("_to") - F.col("_c")), F.col(value)))

    return placed.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias(name))


def nth_by(df: DataFrame, keys: Sequence[str], value: str, at: dict[str, Column], hot: bool) -> DataFrame:
    """Values at given 0-based ranks (columns over ``_n``, the group size): nearest-rank percentiles."""
    keys = list(keys)
    ranked = number_rows(df.select(*keys, value), keys, [value], "_r", hot=hot)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    wanted = sizes.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), c.cast("long").alias("_r")) for n, c in at.items()])).alias("_w")).select(
        *keys, F.col("_w.name").alias("_name"), F.col("_w._r").alias("_r"))
    found = join_on(ranked, wanted, [*keys, "_r"])
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col(value))).alias(n) for n in at])
