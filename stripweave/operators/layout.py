"""Geometry of panels against a frame, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def contain_scale(w: Column, h: Column, frame_w: int, frame_h: int) -> Column:
    return F.least(frame_w / w, frame_h / h)


def cover_scale(w: Column, h: Column, frame_w: int, frame_h: int) -> Column:
    return F.greatest(frame_w / w, frame_h / h)


def native_scale(w: Column, h: Column, frame_w: int, frame_h: int) -> Column:
    return F.least(F.lit(1.0), contain_scale(w, h, frame_w, frame_h))


def coverage(w: Column, h: Column, frame_w: int, frame_h: int) -> Column:
    """Share of the frame a panel fills; never enlarged."""
    s = native_scale(w, h, frame_w, frame_h)
    return F.when((w <= 0) | (h <= 0), 0.0).otherwise((w * s) * (h * s) / float(frame_w * frame_h))


def _whole(x: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(x).cast("int"))


def base_window(w: Column, h: Column, ratio: float) -> tuple[Column, Column]:
    """Largest window of the ratio that fits."""
    wide = w / h > ratio
    return (F.least(w, F.when(wide, _whole(h * ratio)).otherwise(w)).cast("int"),
            F.least(h, F.when(wide, h).otherwise(_whole(w / ratio))).cast("int"))


def tightened(x: Column, y: Column, w: Column, h: Column, amount: Column, bound_w: Column, bound_h: Column) -> tuple[Column, ...]:
    """Window closed by ``amount`` around its centre, kept inside the bounds."""
    on = amount > 0
    factor = 1 / (1 + amount)
    tw, th = F.greatest(F.lit(8), F.bround(w * factor).cast("long")), F.greatest(F.lit(8), F.bround(h * factor).cast("long"))
    tx = F.bround(x + w / 2 - tw / 2).cast("long")
    ty = F.bround(y + h / 2 - th / 2).cast("long")
    return (F.when(on, F.greatest(F.lit(0), F.least(tx, bound_w - tw))).otherwise(x).cast("long"),
            F.when(on, F.greatest(F.lit(0), F.least(ty, bound_h - th))).otherwise(y).cast("long"),
            F.when(on, tw).otherwise(w).cast("long"), F.when(on, th).otherwise(h).cast("long"))


def fit_boxes(panels: DataFrame, frame_w: int, frame_h: int, amount: float = 0.16, max_upscale: float = 3.2, fill: float = 0.9,
              max_factor: float = 4.0, min_factor: float = 1.1) -> DataFrame:
    """All sizing columns of ``(ch, idx, width, height)``. ``up_w``/``up_h`` are null where no upscale is due."""
    w, h = F.col("width"), F.col("height")
    bw, bh = base_window(w, h, frame_w / frame_h)
    p = panels.withColumns({"win_w": bw, "win_h": bh})
    p = p.withColumns({"_x": F.floor((w - F.col("win_w")) / 2), "_y": F.floor((h - F.col("win_h")) / 2)})
    tx, ty, tw, th = tightened(F.col("_x"), F.col("_y"), F.col("win_w"), F.col("win_h"), F.lit(amount), w, h)
    factor = F.least(fill * frame_w / w, fill * frame_h / h, F.lit(max_factor))
    due = factor >= min_factor
    cover = cover_scale(F.col("win_w"), F.col("win_h"), frame_w, frame_h)
    return p.withColumns({
        "contain": contain_scale(w, h, frame_w, frame_h), "cover": cover,
        "native": native_scale(w, h, frame_w, frame_h), "coverage": coverage(w, h, frame_w, frame_h),
        "tight_x": tx, "tight_y": ty, "tight_w": tw, "tight_h": th,
        "room": F.greatest(F.lit(0.0), max_upscale / cover - 1),
        "up_w": F.when(due, _whole(w * factor)), "up_h": F.when(due, _whole(h * factor)),
        "placed": native_scale(w, h, frame_w, frame_h) / contain_scale(w, h, frame_w, frame_h),
        "left": F.col("_x") / w, "right": (F.col("_x") + F.col("win_w")) / w,
        "top": F.col("_y") / h, "bottom": (F.col("_y") + F.col("win_h")) / h,
    }).drop("_x", "_y")
