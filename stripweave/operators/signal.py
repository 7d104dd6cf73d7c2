"""Sampled signals ``(clip, i, v)``: shorter silences, mixing, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stripweave.functions.intervals import on_group
from stripweave.functions.ordered import is_hot, last_to, scan, spread, sum_before

CLIP = ["clip"]


def compress_silence(samples: DataFrame, rate: int, max_s: float, db: float = -45.0, hot: bool | None = None) -> DataFrame:
    """Every silent run keeps its first ``max_s`` seconds; what is left is numbered anew.

    Silence is judged on whole frames of 5 ms; the rest at the end counts as loud.
    """
    hot = is_hot(samples.select("clip"), CLIP) if hot is None else hot
    frame, keep = max(1, rate // 200), max(1, int(round(max_s * rate)))
    framed = samples.withColumn("_f", F.floor(F.col("i") / frame))
    peak = framed.groupBy("clip", "_f").agg(F.max(F.abs("v")).alias("_p"), F.count(F.lit(1)).alias("_c"))
    quiet = peak.select("clip", "_f", ((F.col("_p") < 10.0 ** (db / 20.0)) & (F.col("_c") == frame)).alias("_q"))
    p = framed.join(quiet, ["clip", "_f"])
    # position in the silent run: distance to the last loud sample
    p = scan(p, CLIP, ["i"], hot, _loud=last_to(F.when(~F.col("_q"), F.col("i"))))
    p = p.filter(~F.col("_q") | (F.col("i") - F.coalesce("_loud", F.lit(-1)) <= keep)).select("clip", "i", "v")
    return scan(p, CLIP, ["i"], hot, _n=sum_before(F.lit(1))).select("clip", F.col("_n").alias("i"), "v")


def _fade(k: Column, n: Column, into: Column, out: Column) -> Column:
    """Straight ramps of ``into`` samples at the start and ``out`` at the end, both ends included."""
    up = F.when(into == 1, 0.0).otherwise(k / F.greatest(into - 1, F.lit(1)))
    down = F.when(out == 1, 1.0).otherwise(1 - (k - (n - out)) / F.greatest(out - 1, F.lit(1)))
    return F.when(k < into, up).otherwise(1.0) * F.when(k >= n - out, down).otherwise(1.0)


def _at(seconds: Column, rate: int) -> Column:
    return F.bround(seconds * rate).cast("long")


USES = 1000


def mix_tracks(voice: DataFrame, music: DataFrame, sounds: DataFrame, assets: DataFrame, rate: int) -> DataFrame:
    """Voice ``(ch, i, v)`` with looped, faded music and sounds on top, within [-1, 1], never past the voice.

    ``music (ch, n, asset, start_s, duration_s, fade_in_s, fade_out_s, gain_db)``, ``sounds (ch, n, asset, start_s,
    gain_db)``, ``assets (asset, i, v)``. Music is limited before the sounds are added.
    """
    length = voice.groupBy("ch").agg((F.max("i") + 1).alias("_len"))
    # samples of an asset that many chapters use lie in several copies, so no task gets all its uses
    used = music.select("asset").unionByName(sounds.select("asset")).groupBy("asset").agg(F.ceil(F.count(F.lit(1)) / USES).cast("long").alias("_parts"))
    size = assets.groupBy("asset").agg((F.max("i") + 1).alias("_size")).join(used, "asset")
    copies = assets.join(used, "asset").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    part = F.pmod(F.xxhash64("ch"), F.col("_parts")).alias("_part")
    m = music.join(length, "ch").join(size, "asset").withColumns({"_s": _at(F.col("start_s"), rate), "_n": _at(F.col("duration_s"), rate)})
    m = m.filter((F.col("_s") < F.col("_len")) & (F.col("_n") > 0)).withColumn("_n", F.least("_n", F.col("_len") - F.col("_s")))
    k = F.col("_k")
    m = spread(m, F.lit(0), F.col("_n") - 1, 1, "_k").withColumn("i", k % F.col("_size"))
    fade = _fade(k, F.col("_n"), F.least("_n", _at(F.col("fade_in_s"), rate)), F.least("_n", _at(F.col("fade_out_s"), rate)))
    m = m.withColumn("_part", part).join(copies, ["asset", "i", "_part"]).select("ch", (F.col("_s") + k).alias("i"), (F.col("v") * fade * F.pow(F.lit(10.0), F.col("gain_db") / 20)).alias("_a"))
    s = sounds.join(length, "ch").join(used, "asset").withColumn("_part", part).withColumn("_s", _at(F.col("start_s"), rate)).filter(F.col("_s") < F.col("_len"))
    s = s.join(copies, ["asset", "_part"]).select("ch", (F.col("_s") + F.col("i")).alias("i"), (F.col("v") * F.pow(F.lit(10.0), F.col("gain_db") / 20)).alias("_b"))
    parts = voice.select("ch", "i", "v", F.lit(0.0).alias("_a"), F.lit(0.0).alias("_b")).unionByName(
        m.select("ch", "i", F.lit(None).cast("double").alias("v"), "_a", F.lit(0.0).alias("_b"))).unionByName(
        s.select("ch", "i", F.lit(None).cast("double").alias("v"), F.lit(0.0).alias("_a"), "_b"))
    mixed = parts.groupBy("ch", "i").agg(F.sum("v").alias("v"), F.sum("_a").alias("_a"), F.sum("_b").alias("_b")).filter("v is not null")

    def limit(x: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x))

    return mixed.select("ch", "i", limit(limit(F.col("v") + F.col("_a")) + F.col("_b")).alias("v"))


def resample_linear(samples: DataFrame, rate: int, to: int) -> DataFrame:
    """Straight-line interpolation at i * rate / to; the last sample holds."""
    step = rate / to
    size = samples.groupBy("clip").agg((F.max("i") + 1).alias("_n"))
    grid = spread(size, F.lit(0), F.ceil(F.col("_n") / F.lit(step)) - 1, 1, "j").withColumn("_x", F.col("j") * step)
    grid = grid.withColumn("_lo", F.floor("_x"))
    a = samples.select("clip", F.col("i").alias("_lo"), F.col("v").alias("_a"))
    b = samples.select("clip", (F.col("i") - 1).alias("_lo"), F.col("v").alias("_b"))
    near = grid.join(a, ["clip", "_lo"]).join(b, ["clip", "_lo"], "left")
    v = F.col("_a") + (F.coalesce("_b", "_a") - F.col("_a")) * (F.col("_x") - F.col("_lo"))
    return near.select("clip", F.col("j").alias("i"), v.alias("v"))
