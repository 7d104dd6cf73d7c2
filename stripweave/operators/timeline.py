"""Assembly of timed tracks from scenes, voice segments and panels. Seconds are doubles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stripweave.functions import text as tx
from stripweave.functions.intervals import on_group, points_in
from stripweave.functions.ordered import (
    first_after, is_hot, last_to, max_to, next_, number_rows, once, prev, scan, spread, sum_before, sum_to)
from stripweave.session import durable

CH = ["ch"]
SCENE = ["ch", "scene"]


def _hot(df: DataFrame, hot: bool | None, keys: Sequence[str] = ("ch",)) -> bool:
    return is_hot(df.select(*keys), list(keys)) if hot is None else hot


def with_totals(df: DataFrame, keys: Sequence[str], hot: bool, spread: Column, **aggs: Column) -> DataFrame:
    """Per-group aggregates on every row: a window, or totals joined back over salts where groups are hot."""
    if not hot:
        w = W.partitionBy(*keys)
        return df.withColumns({n: a.over(w) for n, a in aggs.items()})
    facts = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return on_group(df, facts, keys, spread, True)


# --- H1 - H3 ---------------------------------------------------------------------------------
def missing_panels(scene_panels: DataFrame, panels: DataFrame) -> DataFrame:
    """Scene panels ``(ch, scene, panel)`` that the panel table lacks; building a timeline with any is an error."""
    return scene_panels.select("ch", "scene", "panel").join(panels.select("ch", F.col("idx").alias("panel")), ["ch", "panel"], "left_anti")


def mountable(scenes: DataFrame, audio: DataFrame, scene_panels: DataFrame) -> DataFrame:
    """Scenes ``(ch, scene)`` that have a voice segment and at least one panel."""
    return scenes.join(audio, SCENE).join(scene_panels.select(*SCENE).distinct(), SCENE, "left_semi")


def widen_ranges(scene_panels: DataFrame, panels: DataFrame, hot: bool | None = None) -> DataFrame:
    """Each scene takes the panels from its first key panel up to the next scene's first one.

    ``scene_panels (ch, scene, panel)``, ``panels (ch, idx)`` without filler panels. Scenes that get none
    keep their own.
    """
    hot = _hot(panels, hot)
    first = scene_panels.groupBy(*SCENE).agg(F.min("panel").alias("low"))
    spans = scan(first, CH, ["scene"], hot, high=next_(F.col("low")))
    top = panels.groupBy("ch").agg((F.max("idx") + 1).alias("_top"))
    spans = on_group(spans, top, CH, F.col("scene"), hot, "left").select("ch", "scene", "low", F.coalesce("high", "_top").alias("high"))
    got = points_in(panels.select("ch", F.col("idx").alias("panel")), spans, CH, "panel", F.col("low"), F.col("high"), 256).select("ch", "scene", "panel")
    bare = first.join(got.select(*SCENE).distinct(), SCENE, "left_anti")
    own = scene_panels.join(bare.select(*SCENE), SCENE, "left_semi").select("ch", "scene", "panel")
    return got.unionByName(own)


def limit_by_budget(scene_panels: DataFrame, min_clip: float = 2.5, hot: bool | None = None) -> DataFrame:
    """The tallest panels of each scene that fit its length at ``min_clip`` seconds each. Needs ``height, duration_s``."""
    if min_clip <= 0:
        return scene_panels
    hot = _hot(scene_panels, hot, SCENE)
    from stripweave.functions.ordered import number_rows

    ranked = number_rows(scene_panels, SCENE, [F.desc("height"), F.desc("panel")], "_r", hot=hot)
    return ranked.filter(F.col("_r") < F.greatest(F.lit(1), F.floor(F.col("duration_s") / min_clip))).drop("_r")


# --- H4, H5 ----------------------------------------------------------------------------------
def share_time(scene_panels: DataFrame, frame_h: int = 1080, min_weight: int = 400, heavy: float = 2.0, tall: float = 1.25,
               floor_s: float = 1.6, ceiling_s: float = 6.0, passes: int = 12, hot: bool | None = None) -> DataFrame:
    """Seconds of each panel of a scene: by weight, between a floor and a ceiling, summing to the scene exactly."""
    hot = _hot(scene_panels, hot, SCENE)
    d = F.col("duration_s")
    weight = F.greatest(F.col("height"), F.lit(min_weight)).cast("double") * F.when(F.col("heavy"), heavy).otherwise(1.0) * F.when(
        F.col("height") > frame_h, tall).otherwise(1.0)
    p = with_totals(scene_panels.withColumn("_w", weight), SCENE, hot, F.col("panel"), _n=F.count(F.lit(1)), _all=F.sum("_w"))
    p = p.withColumns({"_lo": F.least(F.lit(floor_s), d / F.col("_n")), "_hi": F.greatest(F.lit(ceiling_s), d / F.col("_n")),
                       "_x": d * F.col("_w") / F.col("_all"), "_done": F.lit(False)})
    for i in range(passes):
        p = p.withColumn("_x", F.when(F.col("_done"), F.col("_x")).otherwise(F.least("_hi", F.greatest("_lo", "_x"))))
        p = p.withColumn("_free", ((F.col("_x") > F.col("_lo")) & (F.col("_x") < F.col("_hi"))).cast("int"))
        p = with_totals(p, SCENE, hot, F.col("panel"), _sum=F.sum("_x"), _nf=F.sum("_free"))
        gap = d - F.col("_sum")
        p = p.withColumn("_done", F.col("_done") | (F.abs(gap) < 1e-9) | (F.col("_nf") == 0))
        p = p.withColumn("_x", F.when(~F.col("_done") & (F.col("_free") == 1), F.col("_x") + gap / F.col("_nf")).otherwise(F.col("_x"))).drop("_sum", "_nf", "_free")
        if hot:
            p = durable(p)
    run = scan(p, SCENE, ["panel"], hot, _spent=sum_before(F.col("_x")), _next=next_(F.col("panel")))
    share = F.when(F.col("_next").isNull(), d - F.col("_spent")).otherwise(F.col("_x"))
    return run.withColumn("share_s", share).drop("_w", "_n", "_all", "_lo", "_hi", "_x", "_done", "_spent", "_next")


def short_shots(scene_panels: DataFrame, max_clip: float = 1.2, min_shot: float = 0.45, max_sub: int = 6,
                motions: Sequence[str] = ("punch_in", "fast_pan"), hot: bool | None = None) -> DataFrame:
    """Equal short shots of each scene, spread over its panels; the last absorbs the rounding."""
    hot = _hot(scene_panels, hot, SCENE)
    p = with_totals(scene_panels, SCENE, hot, F.col("panel"), _n=F.count(F.lit(1)))
    p = scan(p, SCENE, ["panel"], hot, _i=sum_before(F.lit(1)))
    d, n = F.col("duration_s"), F.col("_n")
    wanted = F.greatest(F.lit(1), F.ceil(d / max_clip - 1e-9))
    total = F.greatest(F.lit(1), F.least(wanted, F.greatest(F.lit(1), F.floor(d / min_shot)), F.greatest(F.lit(1), n * max_sub)))
    p = p.withColumn("_t", total)
    base, extra = F.floor(F.col("_t") / n), F.col("_t") % n
    count = F.least(F.lit(max_sub), base + F.when(F.col("_i") < extra, 1).otherwise(0))
    before = F.col("_i") * base + F.least(F.col("_i"), extra)
    p = p.withColumns({"_c": count.cast("int"), "_b": before}).filter("_c > 0").withColumn("subshot", F.explode(F.expr("sequence(0, _c - 1)")))
    placed = F.col("_b") + F.col("subshot")
    each = d / F.col("_t")
    length = F.when(placed == F.col("_t") - 1, d - each * (F.col("_t") - 1)).otherwise(each)
    cycle = F.element_at(F.array(*[F.lit(m) for m in motions]), (placed % len(motions) + 1).cast("int"))
    return p.select("ch", "scene", "panel", "subshot", placed.alias("shot"), F.greatest(length, F.lit(1e-3)).alias("share_s"),
                    F.when(F.col("heavy") & (F.col("subshot") == 0), "punch_in").otherwise(cycle).alias("motion"))


# --- H6 --------------------------------------------------------------------------------------
def scene_starts(scenes: DataFrame, hot: bool | None = None) -> DataFrame:
    """``(ch, scene, duration_s)`` with the running start of each scene."""
    return scan(scenes, CH, ["scene"], _hot(scenes, hot), scene_start=sum_before(F.col("duration_s")))


def place_clips(shots: DataFrame, max_s: float | None = None, hot: bool | None = None) -> DataFrame:
    """Clips ``(ch, scene, panel, share_s, duration_s, heavy)`` with their start; scenes starting past ``max_s`` go."""
    hot = _hot(shots, hot)
    if not hot:
        # scenes start where those before end: a running sum over their first rows, so nothing is joined or moved again
        p = scan(shots.filter("ch is not null and scene is not null"), SCENE, ["panel"], False, _in=sum_before(F.col("share_s")), _back=prev(F.lit(True)))
        before = W.partitionBy("ch").orderBy("scene").rangeBetween(W.unboundedPreceding, -1)
        p = p.withColumn("scene_start", F.coalesce(F.sum(F.when(F.col("_back").isNull(), F.col("duration_s"))).over(before), F.lit(0.0))).drop("_back")
        return _moving(p if max_s is None else p.filter(F.col("scene_start") < max_s))
    starts = scene_starts(shots.groupBy(*SCENE).agg(F.first("duration_s").alias("duration_s")), hot)
    if max_s is not None:
        starts = starts.filter(F.col("scene_start") < max_s)
    return _moving(scan(shots, SCENE, ["panel"], hot, _in=sum_before(F.col("share_s"))).join(starts.select(*SCENE, "scene_start"), SCENE))


def _moving(p: DataFrame) -> DataFrame:
    return p.withColumns({"start_s": F.col("scene_start") + F.col("_in"), "motion": F.when(F.col("heavy"), "punch_in").otherwise("ken_burns")}).drop("_in", "scene_start")


# --- H7, H8 ----------------------------------------------------------------------------------
# How a caption enters, by emotion, and how it keeps moving.
CUE_INTRO = {"action": "弹入", "tension": "故障", "fear": "故障", "epic": "放大", "mystery": "模糊", "sad": "渐显", "romance": "渐显",
             "calm": "渐显", "happy": "弹入", "humor": "弹入", "neutral": "逐字"}
CUE_LOOP = {"action": "心跳", "tension": "颤抖", "fear": "颤抖"}


def cues(scenes: DataFrame, max_words: int = 4, min_cue: float = 0.25) -> DataFrame:
    """Captions of each scene ``(ch, scene, narration, emotion, start_s, speech_s)``: chunks over the speech by length.

    A caption lasts at least ``min_cue``, never past the speech; once no time is left the rest is dropped. Chunks are rows; as no
    caption takes negative time, the cursor is the running sum of what the captions before ask for, capped at the end of
    the speech. A scene's chunks are those of one text. ``(ch, scene)`` is a key.
    """
    p = once(scenes, _c=tx.balanced_chunks(F.col("narration"), max_words)).filter((F.size("_c") > 0) & (F.col("speech_s") > 0))
    p = p.select("ch", "scene", "emotion", F.col("start_s").cast("double").alias("_a"), F.col("speech_s").alias("_l"), (F.size("_c") - 1).alias("_last"),
                 F.length(F.array_join("_c", "")).alias("_all"), F.posexplode("_c").alias("cue", "text"))
    p = p.withColumn("_d", F.greatest(F.col("_l") * F.length("text") / F.col("_all"), F.lit(min_cue)))
    p = scan(p, ["ch", "scene"], ["cue"], False, _s=sum_before(F.col("_d")))
    end = F.col("_a") + F.col("_l")
    p = p.withColumns({"start_s": F.least(F.col("_a") + F.col("_s"), end), "end_s": F.when(F.col("cue") == F.col("_last"), end).otherwise(F.least(F.col("_a") + (F.col("_s") + F.col("_d")), end))})
    out = p.filter("end_s > start_s").select("ch", "scene", "cue", "emotion", "start_s", "end_s", "text")
    budget = (F.col("end_s") - F.col("start_s")) * 0.35
    return out.withColumns({
        "intro_s": F.when(budget >= 0.12, F.bround(F.least(F.lit(0.4), budget), 3)),
        "intro": F.when(budget >= 0.12, F.coalesce(tx.mapped(F.col("emotion"), CUE_INTRO), F.lit("逐字"))),
        "loop": F.when(budget >= 0.12, F.coalesce(tx.mapped(F.col("emotion"), CUE_LOOP), F.lit("")))})


def word_times(cue: DataFrame) -> DataFrame:
    """Words of each caption ``(ch, scene, cue, text, start_s, end_s)`` over its time, by length; the last ends exactly.

    Words are rows, placed by the running sum of their lengths. ``(ch, scene, cue)`` is a key.
    """
    p = once(cue, _w=tx.words(F.col("text"))).filter((F.size("_w") > 0) & (F.col("end_s") > F.col("start_s")))
    p = p.select("ch", "scene", "cue", F.col("start_s").alias("_a"), F.col("end_s").alias("_b"), (F.size("_w") - 1).alias("_last"),
                 F.length(F.array_join("_w", "")).alias("_all"), F.posexplode("_w").alias("word", "text"))
    p = scan(p, ["ch", "scene", "cue"], ["word"], False, _s=sum_before(F.length("text")))
    span = F.col("_b") - F.col("_a")
    lo = F.col("_a") + span * F.col("_s") / F.col("_all")
    hi = F.when(F.col("word") == F.col("_last"), F.col("_b")).otherwise(F.least("_b", F.col("_a") + span * (F.col("_s") + F.length("text")) / F.col("_all")))
    p = p.withColumns({"start_s": lo, "_hi": hi})
    end = F.when(F.col("_hi") <= F.col("start_s"), F.least(F.col("_b"), F.col("start_s") + 1e-3)).otherwise(F.col("_hi"))
    return p.select("ch", "scene", "cue", "word", "text", "start_s", end.alias("end_s"))


def word_at(times: DataFrame, t: DataFrame, hot: bool | None = None) -> DataFrame:
    """Word of each caption at moment ``t (ch, scene, cue, t)``: -1 before the first, the last past the end; moments of captions without words go.

    Starts and moments in one order, each moment with the largest word begun by then.
    """
    keys = ["ch", "scene", "cue"]
    moments = t.select(*keys, "t").distinct().join(times.select(*keys).distinct(), keys, "left_semi")
    both = moments.select(*keys, "t", F.lit(1).alias("_asks"), F.lit(None).cast("int").alias("word")).unionByName(
        times.select(*keys, F.col("start_s").alias("t"), F.lit(0).alias("_asks"), "word"))
    hot = is_hot(both, keys) if hot is None else hot
    placed = scan(number_rows(both, keys, ["t", "_asks", "word"], "_p", hot=hot), keys, ["_p"], hot, _w=max_to(F.col("word")))
    return placed.filter("_asks = 1").select(*keys, "t", F.coalesce("_w", F.lit(-1)).alias("word"))


# --- H9 - H13 --------------------------------------------------------------------------------
TRANSITIONS = {"action": ["快速挥动", "甩鞭转场", "高速滑动"], "tension": ["故障", "色差故障", "闪黑"]}  # fixed values
MOODS = {"neutral": "calm", "calm": "calm", "happy": "calm", "romance": "calm", "humor": "calm", "tension": "tense", "mystery": "tense",
         "fear": "tense", "sad": "tense", "action": "action", "epic": "action"}  # fixed values
EFFECTS = {"action": "speed_lines", "epic": "glow", "mystery": "rain"}  # fixed values
EFFECT_NAMES = {"speed_lines": "冲刺", "glow": "光晕", "rain": "下雨", "sparks": "星火"}  # fixed values
SOUND_CYCLE = ["impact", "swoosh", "roar", "swoosh"]  # fixed values


def scene_transitions(clips: DataFrame, hot: bool | None = None) -> DataFrame:
    """Transition carried by the clip before a scene change ``(ch, clip, scene, emotion, duration_s)``."""
    hot = _hot(clips, hot)
    near = scan(clips, CH, ["clip"], hot, _n=next_(F.struct("scene", "emotion", "duration_s")))
    loud = [F.lit(k) for k in TRANSITIONS]
    trigger = F.when(F.col("_n.emotion").isin(*TRANSITIONS), F.col("_n.emotion")).when(F.col("emotion").isin(*TRANSITIONS), F.col("emotion"))
    length = F.least(F.lit(0.30), 0.15 * F.least("duration_s", "_n.duration_s"))
    posted = F.coalesce((F.col("scene") != F.col("_n.scene")) & trigger.isNotNull() & (length >= 0.20), F.lit(False))
    p = near.withColumns({"_t": trigger, "_l": length, "_p": posted.cast("int")})
    p = scan(p, CH, ["clip"], hot, _k=sum_before(F.col("_p"))).filter("_p = 1")
    kind = F.lit(None).cast("string")
    for emotion, names in TRANSITIONS.items():
        kind = F.when(F.col("_t") == emotion, F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("_k") % len(names) + 1).cast("int"))).otherwise(kind)
    return p.select("ch", "clip", kind.alias("kind"), F.bround("_l", 3).alias("duration_s"))


def transition_drift(transitions: DataFrame) -> DataFrame:
    return transitions.groupBy("ch").agg(F.sum("duration_s").alias("drift_s"), F.count(F.lit(1)).alias("n"))


def effect_spans(spans: DataFrame, assets: Mapping[str, str] | None = None, min_s: float = 2.0) -> DataFrame:
    """Effect over each long enough scene ``(ch, scene, start_s, end_s, emotion)``; an asset beats the built-in."""
    p = spans.withColumn("kind", tx.mapped(F.col("emotion"), EFFECTS)).filter(F.col("kind").isNotNull() & (F.col("end_s") - F.col("start_s") >= min_s))
    own = tx.mapped(F.col("kind"), assets) if assets else F.lit(None).cast("string")
    p = p.withColumns({"file": F.coalesce(own, F.lit("")), "_e": tx.mapped(F.col("kind"), EFFECT_NAMES)})
    p = p.withColumn("effect", F.when(F.col("file") != "", "").otherwise(F.coalesce("_e", F.lit(""))))
    return p.filter("file <> '' or effect <> ''").select("ch", "scene", "kind", "effect", "file", "start_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"))


def sound_events(clips: DataFrame, files: Mapping[str, str], hot: bool | None = None) -> DataFrame:
    """Sound per clip ``(ch, scene, panel, start_s, motion, emotion)``: a cycle in action scenes, impact on punch-ins."""
    hot = _hot(clips, hot)
    p = scan(clips, SCENE, ["panel"], hot, _k=sum_before(F.lit(1)))
    cycle = F.element_at(F.array(*[F.lit(x) for x in SOUND_CYCLE]), (F.col("_k") % 4 + 1).cast("int"))
    kind = F.when(F.col("emotion") == "action", cycle).when(F.col("motion") == "punch_in", "impact")
    p = p.withColumn("kind", kind).filter("kind is not null")
    return p.select("ch", "scene", "panel", "start_s", "kind", F.coalesce(tx.mapped(F.col("kind"), files), F.lit(next(iter(files.values())))).alias("file"))


def mood_spans(spans: DataFrame, files: Mapping[str, str], crossfade: float = 1.5, max_end: Column | None = None, hot: bool | None = None) -> DataFrame:
    """Music per mood over merged scenes ``(ch, scene, start_s, end_s, emotion)``, overlapping by the crossfade."""
    hot = _hot(spans, hot)
    p = spans.withColumn("mood", F.coalesce(tx.mapped(F.col("emotion"), MOODS), F.lit("calm")))
    p = scan(p, CH, ["scene"], hot, _m=prev(F.col("mood")))
    p = scan(p.withColumn("_new", F.when(F.col("_m") == F.col("mood"), 0).otherwise(1)), CH, ["scene"], hot, span=sum_to(F.col("_new")))
    limit = [F.max("_max").alias("_max")] if max_end is not None else []
    p = p.withColumn("_max", max_end) if max_end is not None else p
    s = p.groupBy("ch", "span").agg(F.first("mood").alias("mood"), F.min("start_s").alias("_s"), F.max("end_s").alias("_e"), *limit)
    s = scan(s, CH, ["span"], hot, _after=next_(F.col("span")))
    first, last, half = F.col("span") == 1, F.col("_after").isNull(), crossfade / 2
    start = F.when(first, F.col("_s")).otherwise(F.greatest(F.lit(0.0), F.col("_s") - half))
    end = F.when(last, F.col("_e")).otherwise(F.col("_e") + half)
    if max_end is not None:
        end = F.least(end, F.col("_max"))
    file = F.coalesce(tx.mapped(F.col("mood"), files), F.lit(files.get("default") or next(iter(files.values()))))
    out = s.select("ch", "span", "mood", file.alias("file"), start.alias("start_s"), (end - start).alias("duration_s"),
                   F.when(first, 0.5).otherwise(crossfade).alias("fade_in_s"), F.when(last, 1.0).otherwise(crossfade).alias("fade_out_s"))
    return out.filter("duration_s > 0")


def truncate(track: DataFrame, t: float) -> DataFrame:
    """Rows starting before ``t``, the one that crosses it shortened."""
    return track.filter(F.col("start_s") < t).withColumn("duration_s", F.least(F.col("duration_s"), t - F.col("start_s")))


# --- H14 -------------------------------------------------------------------------------------
def mixed_formats(timelines: DataFrame) -> DataFrame:
    """Series of ``(series, width, height, fps)`` whose chapters differ in format; joining them is an error."""
    return timelines.groupBy("series").agg(F.count_distinct("width", "height", "fps").alias("formats")).filter("formats > 1")


def chapter_offsets(timelines: DataFrame, gap: float = 0.6, hot: bool | None = None) -> DataFrame:
    """Shift of each chapter ``(series, ch, total_s, scenes)``: earlier lengths plus gaps, earlier scene counts."""
    hot = _hot(timelines, hot, ("series",))
    return scan(timelines, ["series"], ["ch"], hot, offset_s=sum_before(F.col("total_s") + gap), scene_base=sum_before(F.col("scenes"))).select(
        "series", "ch", "offset_s", "scene_base")


def concat_chapters(offsets: DataFrame, track: DataFrame, clip: str | None = None, hot: bool | None = None) -> DataFrame:
    """A track ``(ch, scene, start_s, ...)`` on the time line of its series.

    With ``clip`` (the clip number) the last clip of each chapter loses its ``transition``.
    """
    hot = _hot(track, hot)
    spread = F.col(clip) if clip else F.col("scene")
    p = on_group(track, offsets, CH, spread, hot)
    p = p.withColumns({"start_s": F.col("start_s") + F.col("offset_s"), "scene": F.col("scene") + F.col("scene_base")})
    if clip:
        p = scan(p, CH, [clip], hot, _n=next_(F.col(clip)))
        p = p.withColumn("transition", F.when(F.col("_n").isNotNull(), F.col("transition"))).drop("_n")
    return p.drop("offset_s", "scene_base")


# --- H15, H16 --------------------------------------------------------------------------------
def us(seconds: Column) -> Column:
    return F.greatest(F.lit(0), F.bround(seconds * 1_000_000)).cast("long")


def contiguous_ranges(clips: DataFrame, shift: bool = False, hot: bool | None = None) -> DataFrame:
    """Integer microseconds of clips ``(ch, clip, start_s, duration_s)``: each ends where the next starts.

    With ``shift`` a clip moves later by the ``transition_s`` of those before it.
    """
    hot = _hot(clips, hot)
    p = clips.withColumn("start_us", us(F.col("start_s")))
    p = scan(p, CH, ["clip"], hot, _n=next_(F.col("start_us")))
    end = F.greatest(F.coalesce("_n", us(F.col("start_s") + F.col("duration_s"))), F.col("start_us") + 1)
    p = p.withColumn("length_us", end - F.col("start_us"))
    if shift:
        p = scan(p.withColumn("_t", us(F.coalesce("transition_s", F.lit(0.0)))), CH, ["clip"], hot, _by=sum_before(F.col("_t")))
        p = p.withColumn("start_us", F.col("start_us") + F.col("_by"))
    return p.select("ch", "clip", "start_us", "length_us")


def cue_ranges(cue: DataFrame, hot: bool | None = None) -> DataFrame:
    """Integer microseconds of captions ``(ch, n, start_s, end_s)``, bounded by the next start, 0 if inverted."""
    hot = _hot(cue, hot)
    p = scan(cue.withColumn("start_us", us(F.col("start_s"))), CH, ["n"], hot, _n=next_(F.col("start_us")))
    return p.select("ch", "n", "start_us", F.greatest(F.lit(0), F.least(us(F.col("end_s")), F.col("_n")) - F.col("start_us")).alias("length_us"))


def loop_ranges(spans: DataFrame, material_us: int) -> DataFrame:
    """Repeats of the material end to end over each span ``(start_s, duration_s)``, the last cut short."""
    p = spans.withColumns({"_a": us(F.col("start_s")), "_b": us(F.col("start_s") + F.col("duration_s"))}).filter(F.col("_b") > F.col("_a"))
    p = spread(p, F.col("_a"), F.col("_b") - 1, material_us, "start_us")
    return p.withColumn("length_us", F.least(F.lit(material_us), F.col("_b") - F.col("start_us"))).drop("_a", "_b")


# --- H17 -------------------------------------------------------------------------------------
def ease_in_out(p: Column) -> Column:
    x = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    return x * x * (3.0 - 2.0 * x)


def ease_out(p: Column) -> Column:
    x = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    return 1.0 - F.pow(1.0 - x, 3)


def zoom_factor(motion: Column, progress: Column, elapsed: Column, ken: float = 0.05, punch: float = 0.05, punch_s: float = 0.2, most: float = 1.05) -> Column:
    return F.least(F.lit(most), F.when(motion == "punch_in", 1.0 + punch * ease_out(elapsed / punch_s)).otherwise(1.0 + ken * ease_in_out(progress)))


def pan_offset(progress: Column, travel: Column, ratio: float = 0.85, power: float = 1.6) -> Column:
    """Offset of a fast pan, eased at both ends."""
    return F.when(travel <= 0, 0).otherwise(F.bround(travel * ratio * F.pow(ease_in_out(progress), power))).cast("long")


def live_window(motion: Column, progress: Column, elapsed: Column, x: Column, y: Column, w: Column, h: Column, panel_w: Column, panel_h: Column,
                zoom: float, ratio: float = 0.85, punch_s: float = 0.2, power: float = 1.6) -> tuple[Column, ...]:
    """Window shown at a moment: closed by a punch-in, or moved by a pan along the roomier side."""
    factor = 1.0 + zoom * ease_out(elapsed / punch_s)
    punch, pan = (motion == "punch_in") & F.lit(zoom > 0), motion == "fast_pan"
    nw, nh = F.greatest(F.lit(8), F.bround(w / factor).cast("long")), F.greatest(F.lit(8), F.bround(h / factor).cast("long"))
    rx, ry = panel_w - w, panel_h - h
    px = F.least(rx, x + pan_offset(progress, rx - x, ratio, power))
    py = F.least(ry, y + pan_offset(progress, ry - y, ratio, power))
    ww, wh = F.when(punch, nw).otherwise(w), F.when(punch, nh).otherwise(h)
    wx = F.when(punch, x + F.floor((w - nw) / 2)).when(pan & (rx >= ry), px).otherwise(x)
    wy = F.when(punch, y + F.floor((h - nh) / 2)).when(pan & (rx < ry), py).otherwise(y)
    return F.greatest(F.lit(0), F.least(wx, panel_w - ww)), F.greatest(F.lit(0), F.least(wy, panel_h - wh)), ww, wh


def _first_frame(at: Column, fps: float) -> Column:
    """The least frame i >= 0 with i / fps not before ``at``; the product alone may be off by rounding."""
    near = F.floor(at * fps).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.when((near - 1) / F.lit(fps) >= at, near - 1).when(near / F.lit(fps) >= at, near).otherwise(near + 1))


STRETCH = 128
CLIP, CUE, EFFECT, TOTAL = range(4)  # rows of one table


def _frame_spans(spans: DataFrame, kind: int, fps: float) -> DataFrame:
    """Spans ``(ch, n, start_s, end_s)`` as frames from ``_f0`` to before ``_f1``; those without a frame or a chapter meet no clip."""
    p = spans.select("ch", F.lit(kind).alias("_kind"), F.col("n").alias("_n"), _first_frame(F.col("start_s"), fps).alias("_f0"), _first_frame(F.col("end_s"), fps).alias("_f1"))
    return p.filter("ch is not null and _f1 > _f0")


def sample_timeline(clips: DataFrame, cue: DataFrame, effects: DataFrame, totals: DataFrame, fps: float, outro_s: float | None = None,
                    hot: bool | None = None, punch_zoom: float = 0.16, pan_ratio: float = 0.85) -> DataFrame:
    """State of the picture at every frame i/fps.

    ``clips (ch, clip, start_s, duration_s, motion, transition_s)``: the last one started stays until the
    next starts. ``cue`` / ``effects`` are ``(ch, n, start_s, end_s)``; ``totals (ch, total_s)``. Clips that also have their crop
    ``x, y, w, h`` and the panel's ``panel_w, panel_h`` give the window shown at the moment (``win_x, win_y, win_w, win_h``).

    Clips, cues, effects and totals are rows of one table by chapter, so small chapters are moved once. All are cut at every ``STRETCH``-th
    frame, and each piece of a clip makes its own frames from the cues and effects of its stretch; frames are never shuffled.
    """
    hot = _hot(clips, hot)
    cropped = {"x", "y", "w", "h", "panel_w", "panel_h"} <= set(clips.columns)
    needed = ["clip", "start_s", "duration_s", "motion", "transition_s", *(["x", "y", "w", "h", "panel_w", "panel_h"] if cropped else [])]
    spans = _frame_spans(cue, CUE, fps).unionByName(_frame_spans(effects, EFFECT, fps))
    if hot:
        near = scan(clips.select("ch", *needed), CH, ["start_s", "clip"], True, _next=next_(F.col("start_s")), _before=prev(F.col("start_s")))
        near = on_group(near, totals.select("ch", "total_s"), CH, F.col("clip"), True).withColumn("_kind", F.lit(CLIP))
        rows = near.unionByName(spans, allowMissingColumns=True)
    else:
        rows = clips.select("ch", *needed, F.lit(CLIP).alias("_kind")).unionByName(spans, allowMissingColumns=True).unionByName(
            totals.select("ch", "total_s", F.lit(TOTAL).alias("_kind")), allowMissingColumns=True)
        w = W.partitionBy("ch", "_kind").orderBy("start_s", "clip")
        total = F.collect_list(F.when(F.col("_kind") == TOTAL, F.struct("total_s"))).over(W.partitionBy("ch"))
        rows = rows.withColumns({"_next": F.lead("start_s").over(w), "_before": F.lag("start_s").over(w)}).withColumn("_t", total).filter(F.col("_kind") != TOTAL)
        # a chapter without a total has no frames; its spans meet no clip
        rows = rows.withColumn("total_s", F.explode(F.when(F.col("_kind") == CLIP, F.transform("_t", lambda x: x["total_s"])).otherwise(F.array(F.lit(None).cast("double"))))).drop("_t")
    n = F.bround(F.col("total_s") * fps).cast("long")
    own = F.col("_kind") == CLIP
    rows = rows.withColumns({
        "_f0": F.when(~own, F.col("_f0")).when(F.col("_before").isNull(), F.lit(0).cast("long")).otherwise(_first_frame(F.col("start_s"), fps)),
        "_f1": F.when(~own, F.col("_f1")).when(F.col("_next").isNull(), n).otherwise(F.least(n, _first_frame(F.col("_next"), fps)))})
    cut = spread(rows.filter("_f1 > _f0"), F.floor(F.col("_f0") / STRETCH), F.floor((F.col("_f1") - 1) / STRETCH), 1, "_stretch")
    all_met = F.collect_set(F.when(~own, F.struct(F.col("_kind").alias("kind"), F.col("_n").alias("n"), F.col("_f0").alias("b0"), F.col("_f1").alias("b1")))).over(W.partitionBy("ch", "_stretch"))
    p = cut.withColumn("_m", all_met).filter(own).withColumns({
        "_a": F.greatest("_f0", F.col("_stretch") * STRETCH), "_b": F.least("_f1", (F.col("_stretch") + 1) * STRETCH)})
    known = F.col("ch").isNotNull() & F.col("clip").isNotNull()
    p = once(p, **{f"_near{kind}": F.filter("_m", lambda m: known & (m["kind"] == kind) & (m["b0"] < F.col("_b")) & (F.col("_a") < m["b1"])) for kind in (CUE, EFFECT)}).drop("_m")

    def shown(kind: int) -> Column:
        return F.explode_outer(F.transform(F.filter(f"_near{kind}", lambda m: (m["b0"] <= F.col("frame")) & (F.col("frame") < m["b1"])), lambda m: m["n"]))

    p = p.withColumn("frame", F.explode(F.sequence("_a", F.col("_b") - 1))).withColumn("t", F.col("frame") / fps).withColumn("cue", shown(CUE)).withColumn("effect", shown(EFFECT))
    p = p.withColumn("elapsed_s", F.greatest(F.lit(0.0), F.col("t") - F.col("start_s")))
    p = p.withColumn("progress", F.when(F.col("duration_s") > 0, F.least(F.lit(1.0), F.col("elapsed_s") / F.col("duration_s"))).otherwise(0.0))
    begin = F.col("start_s") + F.col("duration_s") - F.col("transition_s")
    later = F.col("_next").isNotNull() | (F.col("t") < F.col("start_s"))
    phase = F.when(later & (F.col("transition_s") > 0) & (F.col("t") >= begin), (F.col("t") - begin) / F.col("transition_s"))
    outro = F.col("t") >= F.col("total_s") - outro_s if outro_s is not None else F.lit(False)
    keep = ["ch", "frame", "t", "clip", "elapsed_s", "progress", phase.alias("phase"), zoom_factor(F.col("motion"), F.col("progress"), F.col("elapsed_s")).alias("zoom")]
    if cropped:
        window = live_window(F.col("motion"), F.col("progress"), F.col("elapsed_s"), *[F.col(c) for c in ("x", "y", "w", "h", "panel_w", "panel_h")], punch_zoom, pan_ratio)
        keep += [c.cast("long").alias(f"win_{a}") for c, a in zip(window, "xywh")]
    return p.select(*keep, outro.alias("outro"), "cue", "effect")


# --- H18 -------------------------------------------------------------------------------------
def mixed_rates(segments: DataFrame) -> DataFrame:
    """Chapters whose segments differ in sample rate; joining them is an error."""
    return segments.groupBy("ch").agg(F.count_distinct("rate").alias("rates")).filter("rates > 1")


def voice_manifest(segments: DataFrame, padding_s: float = 0.18, include_filler: bool = False, hot: bool | None = None) -> DataFrame:
    """Voice segments ``(ch, scene, speech_samples, rate, is_filler)`` with padding, seconds and offset."""
    hot = _hot(segments, hot)
    kept = segments if include_filler else segments.filter(~F.col("is_filler"))
    pad = F.bround(padding_s * F.col("rate"))
    p = kept.withColumns({"samples": (F.col("speech_samples") + pad).cast("long")})
    p = scan(p, CH, ["scene"], hot, offset=sum_before(F.col("samples")))
    return p.select("ch", "scene", (F.col("speech_samples") / F.col("rate")).alias("speech_s"), (F.col("samples") / F.col("rate")).alias("duration_s"),
                    (F.col("offset") / F.col("rate")).alias("start_s"))


def voice_totals(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("ch").agg(F.count(F.lit(1)).alias("segments"), F.sum("duration_s").alias("total_s"))
