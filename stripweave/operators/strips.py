"""Row profiles of strips: variance, change, runs, gaps, panels, borders, background, blocks, windows.

Input rows are ``(strip, y, px)`` with one grey pixel array per row; ``y`` is dense from 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from stripweave.session import number_setting
from stripweave.functions.intervals import on_group, points_in
from stripweave.functions.ordered import (
    first_by, first_from, is_hot, join_on, last_to, next_, once, prev, runs, scan, sum_before, sum_to)

STRIP = ["strip"]
CALIBRATED_WIDTH = 575


def _hot(df: DataFrame, hot: bool | None, keys: Sequence[str] = ("strip",)) -> bool:
    return is_hot(df.select(*keys), list(keys)) if hot is None else hot


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def scaled(value: float, width: Column) -> Column:
    """A length calibrated at 575 px, at the real width; never below 1."""
    return F.greatest(F.lit(1), F.bround(F.lit(float(value)) * width / CALIBRATED_WIDTH).cast("int"))


# --- D1, D2 ----------------------------------------------------------------------------------
def row_variance(rows: DataFrame) -> DataFrame:
    """Population variance of each pixel row. A row without pixels is an error."""
    # pixels are whole numbers, so both sums are exact and one pass is enough
    zero = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("q"))
    both = F.aggregate("px", zero, lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x.cast("long") * x).alias("q")))
    n = F.size("px").cast("long")
    spread = (n * F.col("_m.q") - F.col("_m.s") * F.col("_m.s")) / (n * n)
    checked = F.when(n > 0, spread).otherwise(F.raise_error(F.lit("pixel row of width 0")).cast("double"))
    return once(rows, _m=both).select("strip", "y", checked.alias("variance"))


def row_change(rows: DataFrame, threshold: int = 24, hot: bool | None = None) -> DataFrame:
    """Share of columns that differ from the row above by more than ``threshold``."""
    near = scan(rows, STRIP, ["y"], _hot(rows, hot), _up=prev(F.col("px")))
    hits = F.size(F.filter(F.zip_with("px", "_up", lambda a, b: F.abs(a - b)), lambda x: x > threshold))
    return near.select("strip", "y", F.when(F.col("_up").isNull(), 0.0).otherwise(hits / F.size("px")).alias("change"))


# --- D3 - D6 ---------------------------------------------------------------------------------
def find_runs(rows: DataFrame, where: Column, min_len: int = 1, hot: bool | None = None) -> DataFrame:
    """Maximal runs ``[start, end)`` of rows satisfying the predicate, at least ``min_len`` long."""
    found = runs(rows, STRIP, "y", _hot(rows, hot), where)
    return found.filter(F.col("end") - F.col("start") >= min_len)


def extents(rows: DataFrame) -> DataFrame:
    """Height of each strip."""
    return rows.groupBy("strip").agg((F.max("y") + 1).alias("height"))


def complement_intervals(found: DataFrame, extent: DataFrame, hot: bool | None = None) -> DataFrame:
    """Gaps between runs over [0, height), head and tail included."""
    ends = extent.select("strip", F.col("height").alias("start"), F.col("height").alias("end"))
    both = found.select("strip", "start", "end").unionByName(ends)
    near = scan(both, STRIP, ["start", "end"], _hot(both, hot), _cursor=prev(F.col("end")))
    return near.select("strip", F.coalesce("_cursor", F.lit(0)).alias("start"), F.col("start").alias("end")).filter("end > start")


def merge_small(segments: DataFrame, max_height: int = 250, max_gap: int = 150, hot: bool | None = None) -> DataFrame:
    """Chain neighbours that are both below ``max_height`` and at most ``max_gap`` apart."""
    hot = _hot(segments, hot)
    low = segments.withColumn("_low", F.col("end") - F.col("start") < max_height)
    near = scan(low, STRIP, ["start"], hot, _end=prev(F.col("end")), _plow=prev(F.col("_low")))
    joins = F.coalesce(F.col("_low") & F.col("_plow") & (F.col("start") - F.col("_end") <= max_gap), F.lit(False))
    marked = scan(near.withColumn("_new", F.when(joins, 0).otherwise(1)), STRIP, ["start"], hot, _g=sum_to(F.col("_new")))
    return marked.groupBy("strip", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def pad_segments(segments: DataFrame, extent: DataFrame, padding: int = 15, min_height: int = 180, hot: bool | None = None) -> DataFrame:
    """Padded, clamped segments that are tall enough, numbered in order."""
    hot = _hot(segments, hot)
    tall = on_group(segments, extent, STRIP, F.col("start"), hot).select(
        "strip", F.greatest(F.lit(0), F.col("start") - padding).alias("y_start"),
        F.least("height", F.col("end") + padding).alias("y_end"))
    kept = tall.filter(F.col("y_end") - F.col("y_start") >= min_height)
    return scan(kept, STRIP, ["y_start", "y_end"], hot, segment=sum_before(F.lit(1)))


def slice_panels(segments: DataFrame, extent: DataFrame, padding: int = 15, min_height: int = 180, giant: int = 1500,
                 pieces: DataFrame | None = None, hot: bool | None = None) -> DataFrame:
    """Panels of each strip in reading order.

    ``pieces`` (from :func:`split_to_frame` on :func:`pad_segments`) replaces whole segments by
    their parts; the number of the segment is then kept as ``source_index``.
    """
    hot = _hot(segments, hot)
    if pieces is None:
        pieces = pad_segments(segments, extent, padding, min_height, hot).select(
            "strip", "segment", F.col("y_start").alias("y0"), F.col("y_end").alias("y1"), F.lit(None).cast("string").alias("part"))
    out = scan(pieces, STRIP, ["y0", "y1"], hot, idx=sum_before(F.lit(1)))
    h = F.col("y1") - F.col("y0")
    return out.select(
        "strip", "idx", F.col("y0").alias("y_start"), F.col("y1").alias("y_end"), h.alias("height"),
        F.when(h > giant, "scroll_vertical").otherwise("static").alias("type"), "part",
        F.when(F.col("part").isNotNull(), F.col("segment")).alias("source_index"))


def panels_of_strips(rows: DataFrame, variance_below: float, min_gap: int, merge_below: int, merge_gap: int, padding: int,
                     min_height: int, giant: int, hot: bool | None = None) -> DataFrame:
    """Whole chain from pixel rows to panels: variance, runs, complement, merge, slice."""
    hot = _hot(rows, hot)
    extent = extents(rows)
    gutters = find_runs(row_variance(rows), F.col("variance") < variance_below, min_gap, hot)
    merged = merge_small(complement_intervals(gutters, extent, hot), merge_below, merge_gap, hot)
    return slice_panels(merged, extent, padding, min_height, giant, hot=hot)


# --- D7, D8 ----------------------------------------------------------------------------------
def find_borders(change: DataFrame, segments: DataFrame, cover: float = 0.5, apart: int = 20, bucket: int = 1024,
                 hot: bool | None = None) -> DataFrame:
    """Border rows of each segment: hits of at least ``cover`` inside it, one per cluster.

    ``segments`` is ``(strip, y_start, y_end)``.
    """
    hot = _hot(change, hot)
    hits = points_in(change.filter(F.col("change") >= cover), segments.select("strip", "y_start", "y_end"), STRIP, "y",
                     F.col("y_start") + 1, F.col("y_end"), bucket)
    keys = ["strip", "y_start", "y_end"]
    near = scan(hits, keys, ["y"], hot, _before=prev(F.col("y")))
    new = F.when(F.col("y") - F.col("_before") <= apart, 0).otherwise(1)
    marked = scan(near.withColumn("_new", new), keys, ["y"], hot, _g=sum_to(F.col("_new")))
    best = F.struct((-F.col("change")).alias("c"), F.col("y").alias("y"))
    peak = marked.groupBy(*keys, "_g").agg(F.min(best).alias("_b")).withColumn("_c", -F.col("_b.c"))
    strength = F.when(F.col("_c") >= 0.7, 1.0).when(F.col("_c") >= 0.6, 0.75).otherwise(0.5)
    return peak.select(*keys, F.col("_b.y").alias("row"), strength.alias("strength"))


# Fixed values of the frame split.
GRID, MAX_PIECE, SHORTFALL, BONUS, SNAP = 24, 1.6, 0.05, 0.04, 25


def _coverage(height, width: int, frame_w: int, frame_h: int):
    scale = np.minimum(min(1.0, frame_w / width), frame_h / height)
    return width * scale * height * scale / (frame_w * frame_h)


def best_cuts(y0: int, y1: int, width: int, borders: list[tuple[int, float]], frame_w: int, frame_h: int, min_piece: int) -> list[int]:
    """Cut rows (both ends included) with the highest mean piece score; only the ends if whole.

    A mean is largest where, less that mean for each piece, the best sum is nought: so the best chain for a guessed mean gives a better
    guess, until it gives itself. Scores are whole hundred-millionths (coarser where a million rows would pass 64 bits), so ties are exact: fewer pieces, then the
    shorter last piece.
    Rows closer than ``min_piece`` don't depend on each other and are settled together; memory is a few numbers a node.
    """
    height = y1 - y0
    if frame_h <= 0 or height < 2 * min_piece or height <= frame_h:
        return [y0, y1]
    longest = max(min_piece, int(frame_h * MAX_PIECE))
    strong: dict[int, float] = {}
    for row, force in borders:
        if y0 < row < y1:
            strong[row] = max(strong.get(row, 0.0), force)
    at = np.array(sorted({y0, y1, *range(y0, y1, GRID), *strong}))
    pull = np.zeros(len(at))
    if strong:
        rows = np.array(sorted(strong))
        below = np.clip(np.searchsorted(rows, at, "right") - 1, 0, len(rows) - 1)
        above = np.minimum(below + 1, len(rows) - 1)
        near = np.where(np.abs(at - rows[below]) <= np.abs(rows[above] - at), below, above)
        far = np.abs(at - rows[near])
        pull = np.where(far <= SNAP, BONUS * np.array([strong[int(r)] for r in rows])[near] * (1 - far / SNAP), 0.0)
        pull[0] = 0.0
    most = height // max(min_piece, 1) + 2
    unit = float(min(10**8, 2**61 // most**3))
    size = np.maximum(1.0, np.arange(longest + 1))
    lack = np.maximum(0.0, 1.0 - size / frame_h)
    worth = np.rint((_coverage(size, width, frame_w, frame_h) - SHORTFALL * lack * lack) * unit).astype(np.int64)
    pull = np.rint(pull * unit).astype(np.int64)
    none = np.iinfo(np.int64).min // 2

    def chain(total: int, pieces: int) -> list[int]:
        # nodes of the best chain when each piece costs total / pieces, in units of 1 / (pieces * most)
        best, back = np.full(len(at), none), np.full(len(at), -1)
        best[0] = 0
        lo = int(np.searchsorted(at, y0 + min_piece))
        while lo < len(at):
            hi = int(np.searchsorted(at, at[lo] + min_piece))
            first, last = int(np.searchsorted(at, at[lo] - longest)), int(np.searchsorted(at, at[hi - 1] - min_piece, "right"))
            piece = at[lo:hi, None] - at[None, last - 1 : (first - 1 if first else None) : -1]
            own = best[first:last][::-1]
            fits = (piece >= min_piece) & (piece <= longest) & (own > none)[None, :]
            value = np.where(fits, own[None, :] + ((worth[np.clip(piece, 0, longest)] + pull[first:last][::-1][None, :]) * pieces - total) * most - 1, none)
            pick = value.argmax(axis=1)
            best[lo:hi] = value[np.arange(hi - lo), pick]
            back[lo:hi] = np.where(best[lo:hi] > none, last - 1 - pick, -1)
            lo = hi
        nodes = [len(at) - 1]
        while nodes[-1] > 0:
            nodes.append(int(back[nodes[-1]]))
        return nodes[::-1]

    nodes = chain(0, 1)
    while nodes[0] == 0:
        total, pieces = sum(int(worth[at[b] - at[a]] + pull[a]) for a, b in zip(nodes, nodes[1:])), len(nodes) - 1
        better = chain(total, pieces)
        if better == nodes:
            return [int(y) for y in at[nodes]]
        nodes = better
    return [y0, y1]


def split_to_frame(segments: DataFrame, borders: DataFrame | None, width: int, frame_w: int = 1920, frame_h: int = 1080,
                   min_piece: int = 180) -> DataFrame:
    """Pieces of each segment ``(strip, segment, y_start, y_end)``; a segment is one row of its own task input.

    Borders lie at least 20 rows apart, so a segment carries at most height/20 of them.
    """
    kind = dict(segments.dtypes)["strip"]
    tall = F.coalesce((F.col("y_end") - F.col("y_start") > frame_h) & (F.col("y_end") - F.col("y_start") >= 2 * min_piece), F.lit(True)) if frame_h > 0 else F.lit(False)
    schema = f"strip {kind}, segment long, y0 long, y1 long, part string"
    # what fits the frame stays whole and needs no borders
    whole = segments.filter(~tall).select("strip", F.col("segment").cast("long").alias("segment"), F.col("y_start").cast("long").alias("y0"), F.col("y_end").cast("long").alias("y1"), F.lit(None).cast("string").alias("part"))
    segments = segments.filter(tall)
    if borders is None:
        rows = segments.withColumn("_b", F.expr("cast(array() as array<struct<row: bigint, strength: double>>)"))
    else:
        lists = borders.filter(tall).groupBy("strip", "y_start", "y_end").agg(
            F.collect_list(F.struct(F.col("row").cast("long").alias("row"), "strength")).alias("_b"))
        rows = segments.join(lists, ["strip", "y_start", "y_end"], "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}  # the cuts depend only on the height and the borders relative to the top
        for pdf in batches:
            strips, segs, tops, ends, parts = [], [], [], [], []
            for s, g, a, b, near in zip(pdf.strip, pdf.segment, pdf.y_start, pdf.y_end, pdf["_b"]):
                found = [] if near is None else [(int(x["row"]), float(x["strength"])) for x in near]
                a = int(a)
                shape = (int(b) - a, tuple((r - a, f) for r, f in found))
                if shape not in known:
                    if len(known) > 4096:
                        known.clear()
                    known[shape] = best_cuts(0, shape[0], width, list(shape[1]), frame_w, frame_h, min_piece)
                cuts = [a + c for c in known[shape]]
                n = len(cuts) - 1
                names = [None] if n == 1 else ["top", *["middle"] * (n - 2), "bottom"]
                for k in range(n):
                    strips.append(s), segs.append(g), tops.append(cuts[k]), ends.append(cuts[k + 1]), parts.append(names[k])
            yield pd.DataFrame({"strip": strips, "segment": segs, "y0": tops, "y1": ends, "part": parts})

    # a row costs far more than its bytes: spread over all partitions, not by size
    n = number_setting(rows.sparkSession, "spark.sql.shuffle.partitions", 200)
    return rows.select("strip", "segment", "y_start", "y_end", "_b").repartition(n, "strip", "segment").mapInPandas(cut, schema).unionByName(whole)


# --- D9 - D12 --------------------------------------------------------------------------------
def background_palette(row_means: DataFrame, flat_std: float = 5.0, min_share: float = 0.02, min_count: int = 8,
                       apart: int = 24) -> DataFrame:
    """White, black and the dominant quantised means of flat rows, each clear of the earlier ones.

    Input ``(strip, r, g, b, std)``: channel means and the largest channel deviation per row. At most
    1/min_share colours per strip pass the share filter, so the list per strip is bounded.
    """
    def level(c: str) -> Column:
        return F.least(F.lit(255), F.greatest(F.lit(0), (F.bround(F.col(c) / 16) * 16).cast("int"))).alias(c)

    flat = row_means.filter(F.col("std") < flat_std).select("strip", level("r"), level("g"), level("b"))
    counts = flat.groupBy("strip", "r", "g", "b").count()
    common = counts.join(counts.groupBy("strip").agg(F.sum("count").alias("_all")), "strip").filter(
        F.col("count") >= F.greatest(F.lit(float(min_count)), F.col("_all") * min_share))
    strips = row_means.select("strip").distinct()
    ranked = common.groupBy("strip").agg(F.sort_array(F.collect_list(
        F.struct((-F.col("count")).alias("n"), "r", "g", "b"))).alias("_c"))

    def rgb(r: Column, g: Column, b: Column) -> Column:
        return F.struct(r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"))

    def add(kept: Column, c: Column) -> Column:
        clear = F.forall(kept, lambda k: F.greatest(F.abs(k["r"] - c["r"]), F.abs(k["g"] - c["g"]), F.abs(k["b"] - c["b"])) > apart)
        return F.when(clear, F.concat(kept, F.array(rgb(c["r"], c["g"], c["b"])))).otherwise(kept)

    start = F.array(rgb(F.lit(255), F.lit(255), F.lit(255)), rgb(F.lit(0), F.lit(0), F.lit(0)))
    picked = F.aggregate(F.coalesce("_c", F.expr("cast(array() as array<struct<n: bigint, r: int, g: int, b: int>>)")), start, add)
    return strips.join(ranked, "strip", "left").select("strip", F.posexplode(picked).alias("pos", "_k")).select(
        "strip", "pos", "_k.r", "_k.g", "_k.b")


def _p99(xs: Column) -> Column:
    """99th percentile of a sorted array, interpolated."""
    at = (F.size(xs) - 1) * F.lit(0.99)
    lo = F.floor(at).cast("int")
    low, high = F.element_at(xs, lo + 1), F.element_at(xs, F.least(lo + 2, F.size(xs)))
    return low + (high - low) * (at - lo)


def strip_background_score(rows: DataFrame, palette: DataFrame, scale: float = 48.0, ink: float = 64.0) -> DataFrame:
    """Background score and ink flag of each colour row ``(strip, y, r, g, b)``, against its own strip's colours.

    ``palette (strip, r, g, b)`` as from :func:`background_palette`, a bounded list per strip. A pixel is as far from a
    colour as its farthest channel; the nearest colour counts.
    """
    listed = palette.groupBy("strip").agg(F.collect_list(F.struct("r", "g", "b")).alias("_p"))
    each = rows.join(listed, "strip").select("strip", "y", "r", "g", "b", F.explode("_p").alias("_k"))
    def apart(c: str) -> Column:
        return F.transform(c, lambda x: F.abs(x - F.col(f"_k.{c}")).cast("double"))

    far = F.zip_with(F.zip_with(apart("r"), apart("g"), lambda a, b: F.greatest(a, b)), apart("b"), lambda a, b: F.greatest(a, b))
    sorted_ = once(each.select("strip", "y", far.alias("_f")), _d=F.array_sort("_f"))
    near = sorted_.groupBy("strip", "y").agg(F.least(F.min(_p99(F.col("_d"))), F.lit(255.0)).alias("_best"), F.least(F.min(F.element_at("_d", -1)), F.lit(255.0)).alias("_worst"))
    return near.select("strip", "y", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("_best") / scale)).alias("score"), (F.col("_worst") > ink).alias("ink"))


def row_background_score(rows: DataFrame, palette: Sequence[int] = (255, 0), scale: float = 48.0, ink: float = 64.0) -> DataFrame:
    """Background score and ink flag of each row, against the grey levels of ``palette``."""
    def far(level: int) -> Column:
        return F.array_sort(F.transform("px", lambda x: F.abs(x - level).cast("double")))

    sorted_ = once(rows, **{f"_d{i}": far(c) for i, c in enumerate(palette)})
    best = F.least(*[_p99(F.col(f"_d{i}")) for i in range(len(palette))], F.lit(255.0))
    worst = F.least(*[F.element_at(f"_d{i}", -1) for i in range(len(palette))], F.lit(255.0))
    return sorted_.select("strip", "y", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - best / scale)).alias("score"),
                          (worst > ink).alias("ink"))


def segment_blocks(scores: DataFrame, width: int, min_gap: float = 40, min_block: float = 120, min_text: float = 16,
                   row_min: float = 0.5, hot: bool | None = None) -> DataFrame:
    """Blocks of content between gutters, grown into the gutter while there is ink."""
    hot = _hot(scores, hot)
    w = F.lit(width)
    extent = extents(scores)
    found = on_group(runs(scores, STRIP, "y", hot, F.col("score") >= row_min, strength=F.sum("score")), extent, STRIP, F.col("start"), hot)
    gutters = found.filter((F.col("strength") >= scaled(min_gap, w)) | (F.col("start") == 0) | (F.col("end") == F.col("height")))
    tail = extent.select("strip", F.col("height").alias("start"), F.col("height").alias("end"), F.lit(0.0).alias("strength"), "height")
    walls = gutters.select("strip", "start", "end", "strength", "height").unionByName(tail)
    mid = F.floor((F.col("start") + F.col("end")) / 2)
    near = scan(walls.withColumn("mid", mid), STRIP, ["start", "end"], hot,
                _end=prev(F.col("end")), _above=prev(F.col("strength")), _lo=prev(F.col("mid")))
    raw = near.select(
        "strip", F.coalesce("_end", F.lit(0)).alias("y0"), F.col("start").alias("y1"), F.coalesce("_above", F.lit(0.0)).alias("gap_above"),
        F.col("strength").alias("gap_below"), F.coalesce("_lo", F.lit(0)).alias("lo"), F.col("mid").alias("hi")).filter("y1 > y0")
    # where the ink run around each row starts and ends
    ink = scan(scores, STRIP, ["y"], hot, _s=last_to(F.when(~F.col("ink"), F.col("y"))), _e=first_from(F.when(~F.col("ink"), F.col("y"))))
    ups = ink.filter("ink").select("strip", (F.col("y") + 1).alias("y0"), F.coalesce(F.col("_s") + 1, F.lit(0)).alias("_up"))
    downs = ink.filter("ink").select("strip", F.col("y").alias("y1"), F.coalesce(F.col("_e"), F.lit(2 ** 40)).alias("_down"))
    grown = raw.join(ups, ["strip", "y0"], "left").join(downs, ["strip", "y1"], "left").select(
        "strip", F.when(F.col("_up").isNull(), F.col("y0")).otherwise(F.greatest("lo", "_up")).alias("y0"),
        F.when(F.col("_down").isNull(), F.col("y1")).otherwise(F.least("hi", "_down")).alias("y1"),
        F.bround("gap_above", 1).alias("gap_above"), F.bround("gap_below", 1).alias("gap_below"))
    kept = grown.filter(F.col("y1") - F.col("y0") >= scaled(min_text, w))
    out = scan(kept, STRIP, ["y0"], hot, idx=sum_before(F.lit(1)))
    return out.withColumn("small", F.col("y1") - F.col("y0") < scaled(min_block, w))


def cut_energy(rows: DataFrame, hot: bool | None = None) -> DataFrame:
    """Mean vertical gradient of each row over the strip's largest plus 1e-6.

    Rows and columns outside the image mirror the inside ones, so the first and last rows are 0.
    """
    hot = _hot(rows, hot)
    near = scan(rows, STRIP, ["y"], hot, _up=prev(F.col("px")), _down=next_(F.col("px")))
    diff = F.zip_with("_down", "_up", lambda a, b: (a - b).cast("double"))
    near = once(near, _d=F.when(F.col("_up").isNotNull() & F.col("_down").isNotNull(), diff).otherwise(F.transform("px", lambda x: F.lit(0.0))))
    n = F.size("_d")

    def smooth(x: Column, i: Column) -> Column:
        left = F.element_at("_d", F.when(i == 0, F.least(F.lit(2), n)).otherwise(i).cast("int"))
        right = F.element_at("_d", F.when(i == n - 1, F.greatest(F.lit(1), n - 1)).otherwise(i + 2).cast("int"))
        return F.abs(left + 2 * x + right)

    lined = near.select("strip", "y", _mean(F.transform("_d", smooth)).alias("_e"))
    top = lined.groupBy("strip").agg(F.max("_e").alias("_top"))
    return on_group(lined, top, STRIP, F.col("y"), hot).select("strip", "y", (F.col("_e") / (F.col("_top") + 1e-6)).alias("energy"))


# --- D13 - D15 -------------------------------------------------------------------------------
#: Part of a profile that its moving mean spans.
SMOOTH = 0.06


def edge_energy(rows: DataFrame, hot: bool | None = None) -> DataFrame:
    """Absolute Laplacian ``e`` of every value of the grey rows ``(strip, y, px)``; y counts from 0 without gaps.

    The two-dimensional stencil takes the four diagonal neighbours twice and the value itself eight times; beyond an edge it reflects, the edge itself not repeated.
    """
    near = scan(rows, STRIP, ["y"], _hot(rows, hot), _up=prev(F.col("px")), _down=next_(F.col("px")))
    up, down = F.coalesce("_up", "_down", "px"), F.coalesce("_down", "_up", "px")
    sides = once(near, _t=F.zip_with(up, down, lambda a, b: a + b), _n=F.size("px"))
    left = lambda i: F.when(i == 0, F.least(F.lit(1), F.col("_n") - 1)).otherwise(i - 1)
    right = lambda i: F.when(i == F.col("_n") - 1, F.greatest(F.lit(0), F.col("_n") - 2)).otherwise(i + 1)
    e = F.transform("px", lambda v, i: F.abs(2 * (F.get(F.col("_t"), left(i)) + F.get(F.col("_t"), right(i))) - 8 * v).cast("double"))
    return sides.select("strip", "y", e.alias("e"))


def edge_profile(rows: DataFrame, axis: int = 0, hot: bool | None = None) -> DataFrame:
    """How much is drawn along an axis of the grey rows: ``(strip, x, v)``, v between 0 and 1; axis 0 goes over columns, 1 over rows.

    Edges summed over the other axis, smoothed by a moving mean of an odd length (nothing beyond the ends), divided by the greatest value.
    Sums combine before the shuffle; the mean is a difference of two running sums, so the window's length costs nothing.
    """
    hot = _hot(rows, hot)
    edges = edge_energy(rows, hot)
    if axis == 0:
        raw = edges.select("strip", F.posexplode("e").alias("x", "v")).groupBy("strip", F.col("x").cast("long").alias("x")).agg(F.sum("v").alias("v"))
    else:
        raw = edges.select("strip", F.col("y").cast("long").alias("x"), F.aggregate("e", F.lit(0.0), lambda a, v: a + v).alias("v"))
    length = raw.groupBy("strip").agg(F.count(F.lit(1)).alias("_n"))
    wide = F.greatest(F.lit(1), F.floor(F.col("_n") * SMOOTH).bitwiseOR(F.lit(1)))
    half = F.when(F.col("_n") > wide, F.floor(wide / 2)).otherwise(0)
    cum = on_group(scan(raw, STRIP, ["x"], hot, _c=sum_to(F.col("v"))), length.withColumns({"_w": F.when(F.col("_n") > wide, wide).otherwise(1), "_half": half}), STRIP, F.col("x"), hot)
    # a running sum is asked for by the places whose window ends at it, and by those whose window begins behind it
    asked = F.explode(F.array(F.struct(F.least(F.col("x") + F.col("_half"), F.col("_n") - 1).alias("at"), F.lit(1.0).alias("sign")), F.struct((F.col("x") - F.col("_half") - 1).alias("at"), F.lit(-1.0).alias("sign"))))
    ends = cum.select("strip", F.col("x").alias("place"), "_w", asked.alias("a")).filter("a.at >= 0").select("strip", F.col("a.at").alias("x"), "place", "_w", F.col("a.sign").alias("sign"))
    mean = join_on(ends, cum.select("strip", "x", "_c"), ["strip", "x"]).groupBy("strip", F.col("place").alias("x"), "_w").agg(F.sum(F.col("sign") * F.col("_c")).alias("_s"))
    mean = mean.select("strip", "x", (F.col("_s") / F.col("_w")).alias("v"))
    top = mean.groupBy("strip").agg(F.max("v").alias("_top"))
    return on_group(mean, top, STRIP, F.col("x"), hot).select("strip", "x", F.when(F.col("_top") > 0, F.col("v") / F.col("_top")).otherwise(F.col("v")).alias("v"))


def window_scores(profile: DataFrame, size: int | DataFrame, hot: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Sum of every full window of ``size`` values, a number or ``(strip, size)``: difference of two running sums; and the profiles' lengths."""
    hot = _hot(profile, hot)
    length = profile.groupBy("strip").agg((F.max("x") + 1).alias("length"))
    length = length.withColumn("size", F.lit(size)) if isinstance(size, int) else join_on(length, size.select("strip", "size"), ["strip"])
    length = length.withColumn("size", F.greatest(F.lit(1), F.least("size", "length")).cast("long"))
    cum = on_group(scan(profile, STRIP, ["x"], hot, _c=sum_before(F.col("v"))), length.select("strip", "size"), STRIP, F.col("x"), hot)
    ends = cum.select("strip", (F.col("x") - F.col("size") + 1).alias("x"), (F.col("_c") + F.col("v")).alias("_hi")).filter("x >= 0")
    scored = join_on(cum, ends, ["strip", "x"]).select("strip", F.col("x").alias("offset"), (F.col("_hi") - F.col("_c")).alias("score"))
    return scored, length


def profile_windows(profile: DataFrame, size: int | DataFrame, count: int, hot: bool | None = None) -> DataFrame:
    """``count`` window offsets per profile ``(strip, x, v)``: the best of each equal band, best band first.

    ``size`` is a number, or the windows' sizes ``(strip, size)``.
    """
    hot = _hot(profile, hot)
    scored, length = window_scores(profile, size, hot)
    spans = length.select("strip", (F.col("length") - F.col("size") + 1).alias("_n"))
    short = spans.filter("_n <= 1").select("strip", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("rank"), F.lit(0).cast("long").alias("offset"))
    wide = on_group(scored, spans.filter("_n > 1"), STRIP, F.col("offset"), hot)
    many = wide.filter(F.col("_n") >= count).withColumn("band", F.ceil((F.col("offset") + 1) * count / F.col("_n")) - 1)
    few = wide.filter(F.col("_n") < count).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<bigint>"))).filter(
        F.floor(F.col("band") * F.col("_n") / count) == F.col("offset"))
    best = many.unionByName(few).groupBy("strip", "band").agg(F.min(F.struct((-F.col("score")).alias("s"), "offset")).alias("_b"))
    picked = best.groupBy("strip").agg(F.sort_array(F.collect_list(F.struct(F.col("_b.s"), "band", F.col("_b.offset").alias("offset")))).alias("_p"))
    listed = picked.select("strip", F.posexplode("_p").alias("rank", "_o")).select("strip", "rank", F.col("_o.offset").cast("long").alias("offset"))
    return listed.unionByName(short)


def crop_plan(panels: DataFrame, count: int, frame_w: int = 1080, frame_h: int = 1920, max_upscale: float = 3.2, step: float = 0.16,
              xs: DataFrame | None = None, ys: DataFrame | None = None) -> DataFrame:
    """Display windows of each panel ``(ch, idx, width, height)``, ``count`` shots each.

    ``xs`` / ``ys`` are ``(ch, idx, shot, offset)`` from :func:`profile_windows`; without them the window is centred.
    """
    from stripweave.operators.layout import base_window, tightened

    ratio = frame_w / frame_h
    keep = [c for c in panels.columns if c not in ("width", "height")]
    bw, bh = base_window(F.col("width"), F.col("height"), ratio)
    p = panels.withColumns({"w": bw, "h": bh}).withColumn("shot", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    p = p.withColumns({"_cover": F.greatest(frame_w / F.col("w"), frame_h / F.col("h")),
                       "_contain": F.least(frame_w / F.col("width"), frame_h / F.col("height")),
                       "_rx": F.col("width") - F.col("w"), "_ry": F.col("height") - F.col("h")})
    whole = F.col("_cover") > max_upscale
    x, y = F.floor(F.col("_rx") / 2), F.floor(F.col("_ry") / 2)
    if xs is not None:
        p = p.join(xs.withColumnRenamed("offset", "_ox"), ["ch", "idx", "shot"], "left")
        x = F.when(F.col("_rx") > 0, F.coalesce("_ox", F.lit(0))).otherwise(0)
    if ys is not None:
        frozen = ys.filter("shot = 0").select("ch", "idx", F.col("offset").alias("_oy0"))
        p = p.join(ys.withColumnRenamed("offset", "_oy"), ["ch", "idx", "shot"], "left").join(frozen, ["ch", "idx"], "left")
        y = F.when(F.col("_ry") > 0, F.coalesce(F.when(F.col("_rx") > 0, F.col("_oy0")).otherwise(F.col("_oy")), F.lit(0))).otherwise(0)
    p = p.withColumns({
        "_x": F.when(whole, 0).otherwise(F.greatest(F.lit(0), F.least(x, F.col("_rx")))).cast("long"),
        "_y": F.when(whole, 0).otherwise(F.greatest(F.lit(0), F.least(y, F.col("_ry")))).cast("long"),
        "_w": F.when(whole, F.col("width")).otherwise(F.col("w")), "_h": F.when(whole, F.col("height")).otherwise(F.col("h")),
        "_amount": F.when(whole, F.least(step * F.col("shot"), F.greatest(F.lit(0.0), max_upscale / F.greatest("_contain", F.lit(1e-6)) - 1)))
        .when(F.col("shot") % 2 == 1, F.least(F.lit(step), F.greatest(F.lit(0.0), max_upscale / F.col("_cover") - 1))).otherwise(0.0)})
    tx, ty, tw, th = tightened(*[F.col(c) for c in ("_x", "_y", "_w", "_h", "_amount", "width", "height")])
    return p.select(*keep, "shot", tx.alias("x"), ty.alias("y"), tw.alias("w"), th.alias("h"),
                    F.when(whole, "contain").otherwise("cover").alias("fit"))


def chunk_layout(chunks: DataFrame, hot: bool | None = None) -> DataFrame:
    """Placement of page pieces ``(strip, pos, w, h)``: common width, resized height, running offset."""
    hot = _hot(chunks, hot)
    seen = chunks.groupBy("strip", "w").agg(F.count(F.lit(1)).alias("_n"), F.min("pos").alias("_p"))
    target = first_by(seen, STRIP, [-F.col("_n"), F.col("_p")]).select("strip", F.col("w").alias("target"))
    resized = F.when(F.col("w") == F.col("target"), F.col("h")).otherwise(
        F.greatest(F.lit(1), F.bround(F.col("h") * F.col("target") / F.col("w")))).cast("long")
    fitted = on_group(chunks, target, STRIP, F.col("pos"), hot).withColumn("height", resized)
    return scan(fitted, STRIP, ["pos"], hot, y_offset=sum_before(F.col("height"))).select("strip", "pos", "target", "height", "y_offset")
