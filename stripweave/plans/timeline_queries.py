"""Registered queries on timelines and sampled signals, with their SQL texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stripweave.operators import signal as sg, timeline as tl
from stripweave.plans import views as v
from stripweave.plans.strip_queries import even

QUERIES, SQL = {}, {}


def r9(*names):
    """Nine decimals: lengths are multiples of half a microsecond, so six would meet ties."""
    return {n: F.round(n, 9) for n in names}


def query(name: str, text: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if text is not None:
            SQL[name] = text
        return fn
    return add


hot, talks = v.hot_chapters, v.hot_talks


@query("h1_mountable", v.sql("scenes audio scene_panels", "SELECT s.ch, s.idx AS scene, emotion, round(speech_s, 9) AS speech_s, round(duration_s, 9) AS duration_s FROM scenes s JOIN audio a ON a.ch = s.ch AND a.scene = s.idx SEMI JOIN scene_panels p ON p.ch = s.ch AND p.scene = s.idx".replace("round(duration_s", "round(a.duration_s")))
def h1(spark, d):
    s = v.scenes(spark, d).select("ch", F.col("idx").alias("scene"), "emotion")
    return tl.mountable(s, v.audio(spark, d), v.scene_panels(spark, d)).withColumns(r9("speech_s", "duration_s"))


@query("h1_missing_panels", v.sql("scene_panels", "SELECT s.ch, s.scene, s.panel + s.panel % 3 AS panel FROM scene_panels s ANTI JOIN panels p ON p.ch = s.ch AND p.idx = s.panel + s.panel % 3"))
def h1b(spark, d):
    s = v.scene_panels(spark, d).select("ch", "scene", (F.col("panel") + F.col("panel") % 3).alias("panel"))
    return tl.missing_panels(s, v.panels(spark, d))


KEYS = "k AS (SELECT ch, scene, panel FROM scene_panels WHERE panel % 3 = 1)"


@query("h2_widen_ranges", v.sql("scene_panels", f"""WITH {KEYS}, a AS (SELECT ch, idx FROM panels WHERE idx % 5 <> 3), f AS (SELECT ch, scene, min(panel) AS low FROM k GROUP BY ch, scene),
  s AS (SELECT *, coalesce(lead(low) OVER (PARTITION BY ch ORDER BY scene), (SELECT max(idx) + 1 FROM a WHERE a.ch = f.ch)) AS high FROM f),
  g AS (SELECT s.ch, scene, idx AS panel FROM s JOIN a ON a.ch = s.ch AND idx >= low AND idx < high)
  SELECT * FROM g UNION ALL SELECT k.* FROM k ANTI JOIN g ON g.ch = k.ch AND g.scene = k.scene"""))
def h2(spark, d):
    keys = v.scene_panels(spark, d).filter("panel % 3 = 1").select("ch", "scene", "panel")
    return tl.widen_ranges(keys, v.panels(spark, d).filter("idx % 5 <> 3").select("ch", "idx"), hot(spark, d))


@query("h3_limit_by_budget", v.sql("scene_panels", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY ch, scene ORDER BY height DESC, panel DESC) AS rn FROM scene_panels)
  SELECT ch, scene, panel, height FROM r WHERE rn <= greatest(1, floor(duration_s / 2.5))"""))
def h3(spark, d):
    return tl.limit_by_budget(v.scene_panels(spark, d), hot=hot(spark, d)).select("ch", "scene", "panel", "height")


def _share_sql() -> str:
    out = ["""s0 AS (SELECT *, duration_s * w / sum(w) OVER (PARTITION BY ch, scene) AS x, least(1.6, duration_s / n) AS lo, greatest(6.0, duration_s / n) AS hi, false AS done FROM (
      SELECT *, CAST(greatest(height, 400) AS DOUBLE) * CASE WHEN heavy THEN 2.0 ELSE 1.0 END * CASE WHEN height > 1080 THEN 1.25 ELSE 1.0 END AS w, count(*) OVER (PARTITION BY ch, scene) AS n FROM scene_panels))"""]
    for i in range(12):
        out.append(f"""c{i} AS (SELECT * REPLACE (CASE WHEN done THEN x ELSE least(hi, greatest(lo, x)) END AS x) FROM s{i}),
      t{i} AS (SELECT *, duration_s - sum(x) OVER (PARTITION BY ch, scene) AS gap, count(*) FILTER (x > lo AND x < hi) OVER (PARTITION BY ch, scene) AS nf FROM c{i}),
      s{i + 1} AS (SELECT * EXCLUDE (gap, nf) REPLACE (CASE WHEN NOT (done OR abs(gap) < 1e-9 OR nf = 0) AND x > lo AND x < hi THEN x + gap / nf ELSE x END AS x, done OR abs(gap) < 1e-9 OR nf = 0 AS done) FROM t{i})""")
    out.append("""sh AS (SELECT ch, scene, panel, duration_s, heavy, CASE WHEN lead(panel) OVER w IS NULL THEN duration_s - coalesce(sum(x) OVER (PARTITION BY ch, scene ORDER BY panel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE x END AS share_s
      FROM s12 WINDOW w AS (PARTITION BY ch, scene ORDER BY panel))""")
    return ", ".join(out)


SHARE = _share_sql()


@query("h4_share_time", v.sql("scene_panels", f"WITH {SHARE} SELECT ch, scene, panel, round(share_s, 9) AS share_s FROM sh"))
def h4(spark, d):
    return tl.share_time(v.scene_panels(spark, d), hot=hot(spark, d)).select("ch", "scene", "panel", F.round("share_s", 9).alias("share_s"))


SHORT = """pn AS (SELECT *, count(*) OVER (PARTITION BY ch, scene) AS n, row_number() OVER (PARTITION BY ch, scene ORDER BY panel) - 1 AS i FROM scene_panels),
  tt AS (SELECT *, CAST(greatest(1, least(greatest(1, ceil(duration_s / 1.2 - 1e-9)), greatest(1, floor(duration_s / 0.45)), n * 6)) AS BIGINT) AS t FROM pn),
  cc AS (SELECT *, least(6, t // n + CASE WHEN i < t % n THEN 1 ELSE 0 END) AS c, i * (t // n) + least(i, t % n) AS b FROM tt),
  ss AS (SELECT *, unnest(range(c)) AS sub FROM cc),
  sh AS (SELECT ch, scene, panel, sub AS subshot, b + sub AS shot, CASE WHEN b + sub = t - 1 THEN duration_s - duration_s / t * (t - 1) ELSE duration_s / t END AS share_s,
    CASE WHEN heavy AND sub = 0 THEN 'punch_in' WHEN (b + sub) % 2 = 0 THEN 'punch_in' ELSE 'fast_pan' END AS motion FROM ss)"""


@query("h5_short_shots", v.sql("scene_panels", f"WITH {SHORT} SELECT ch, scene, panel, subshot, shot, round(share_s, 9) AS share_s, motion FROM sh"))
def h5(spark, d):
    return tl.short_shots(v.scene_panels(spark, d), hot=hot(spark, d)).withColumns(r9("share_s"))


PLACED = """sc AS (SELECT ch, scene, coalesce(sum(d) OVER (PARTITION BY ch ORDER BY scene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0 FROM (SELECT ch, scene, any_value(duration_s) AS d FROM scene_panels GROUP BY ch, scene)),
  pl AS (SELECT s.ch, s.scene, s.panel, s.heavy, s.height, s.duration_s / count(*) OVER (PARTITION BY s.ch, s.scene) AS dur, s0, row_number() OVER (PARTITION BY s.ch, s.scene ORDER BY panel) - 1 AS k FROM scene_panels s JOIN sc ON sc.ch = s.ch AND sc.scene = s.scene),
  cl AS (SELECT ch, scene, panel AS clip, heavy, height, dur AS duration_s, s0 + k * dur AS start_s, CASE WHEN heavy THEN 'punch_in' ELSE 'ken_burns' END AS motion,
    CASE (scene + ch) % 6 WHEN 0 THEN 'action' WHEN 1 THEN 'tension' WHEN 2 THEN 'calm' WHEN 3 THEN 'epic' WHEN 4 THEN 'mystery' ELSE 'sad' END AS emotion, s0 FROM pl)"""


@query("h6_place_clips", v.sql("scene_panels", f"WITH {PLACED} SELECT ch, scene, clip AS panel, round(start_s, 9) AS start_s, motion FROM cl WHERE s0 < 12"))
def h6(spark, d):
    return _clips(spark, d, 12.0).select("ch", "scene", F.col("clip").alias("panel"), F.round("start_s", 9).alias("start_s"), "motion")


def _clips(spark, d, max_s=None):
    """Clips of equal length per scene, with an emotion per scene."""
    from pyspark.sql import Window as W

    p = v.scene_panels(spark, d)
    n = F.count(F.lit(1)).over(W.partitionBy("ch", "scene"))
    out = tl.place_clips(p.withColumn("share_s", F.col("duration_s") / n), max_s, hot(spark, d))
    names = F.array(*[F.lit(x) for x in ("action", "tension", "calm", "epic", "mystery", "sad")])
    return out.select("ch", "scene", F.col("panel").alias("clip"), "heavy", "height", F.col("share_s").alias("duration_s"), "start_s", "motion",
                      F.element_at(names, ((F.col("scene") + F.col("ch")) % 6 + 1).cast("int")).alias("emotion"))


PREP = "pz AS (SELECT ch, idx, emotion, trim(regexp_replace(narration, '\\s+', ' ', 'g')) AS c0 FROM scenes), pr AS (SELECT ch, idx, emotion, CASE WHEN regexp_matches(c0, '[.!?]$') THEN c0 ELSE c0 || '.' END AS c FROM pz WHERE regexp_matches(c0, '[\\p{L}\\p{N}]'))"
CHUNKS = PREP + """, sn AS (SELECT ch, idx, emotion, generate_subscripts(l, 1) AS sp, unnest(l) AS s FROM (SELECT *, string_split(regexp_replace(c, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS l FROM pr)),
  wd AS (SELECT *, string_split(s, ' ') AS w FROM sn WHERE s <> ''), gr AS (SELECT *, len(w) AS n, CAST(ceil(len(w) / 4.0) AS BIGINT) AS g FROM wd),
  ck AS (SELECT ch, idx, emotion, sp, k, array_to_string(w[k * (n // g) + least(k, n % g) + 1 : (k + 1) * (n // g) + least(k + 1, n % g)], ' ') AS piece FROM (SELECT *, unnest(range(g)) AS k FROM gr)),
  oc AS (SELECT ch, idx, emotion, piece, row_number() OVER (PARTITION BY ch, idx ORDER BY sp, k) - 1 AS cue, count(*) OVER (PARTITION BY ch, idx) AS m, sum(length(piece)) OVER (PARTITION BY ch, idx) AS total FROM ck)"""
# adding floors and capping at the end is the capped running sum of the floors
CUES = CHUNKS + """, j AS (SELECT oc.*, speech_s, 10 + sum(greatest(speech_s * length(piece) / total, 0.25)) OVER (PARTITION BY oc.ch, idx ORDER BY cue) AS run FROM oc JOIN audio a ON a.ch = oc.ch AND a.scene = oc.idx WHERE speech_s > 0),
  q AS (SELECT *, CASE WHEN cue = m - 1 THEN 10 + speech_s ELSE least(run, 10 + speech_s) END AS b FROM j),
  r AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY ch, idx ORDER BY cue), 10) AS a FROM q)"""


def _cues(spark, d):
    s = v.scenes(spark, d).select("ch", F.col("idx").alias("scene"), "narration", "emotion").join(v.audio(spark, d), ["ch", "scene"])
    return tl.cues(s.withColumn("start_s", F.lit(10.0)))


@query("h7_cues", v.sql("scenes audio", f"WITH {CUES} SELECT ch, idx AS scene, cue, piece AS text, round(a, 9) AS start_s, round(b, 9) AS end_s FROM r WHERE b > a"))
def h7(spark, d):
    return _cues(spark, d).select("ch", "scene", "cue", "text", *[F.round(c, 9).alias(c) for c in ("start_s", "end_s")])


@query("h7_cue_animation", v.sql("scenes audio", f"""WITH {CUES} SELECT ch, idx AS scene, cue, round(CASE WHEN 0.35 * (b - a) >= 0.12 THEN round(least(0.4, 0.35 * (b - a)), 3) ELSE 0 END, 2) AS intro_s,
  CASE WHEN 0.35 * (b - a) < 0.12 THEN '' WHEN emotion IN ('action', 'happy', 'humor') THEN '弹入' WHEN emotion IN ('tension', 'fear') THEN '故障' WHEN emotion = 'epic' THEN '放大' WHEN emotion = 'mystery' THEN '模糊'
   WHEN emotion IN ('sad', 'romance', 'calm') THEN '渐显' ELSE '逐字' END AS intro, CASE WHEN 0.35 * (b - a) < 0.12 THEN '' WHEN emotion = 'action' THEN '心跳' WHEN emotion IN ('tension', 'fear') THEN '颤抖' ELSE '' END AS "loop" FROM r WHERE b > a"""))
def h7b(spark, d):
    c = _cues(spark, d).fillna({"intro": "", "loop": "", "intro_s": 0.0})
    return c.select("ch", "scene", "cue", F.round("intro_s", 2).alias("intro_s"), "intro", "loop")


@query("h8_word_times", v.sql("scenes", f"""WITH {CHUNKS}, w AS (SELECT ch, idx, cue, generate_subscripts(l, 1) - 1 AS word, unnest(l) AS t, l FROM (SELECT *, string_split(piece, ' ') AS l FROM oc)),
  c AS (SELECT *, list_sum(list_transform(l, lambda x: length(x))) AS total, coalesce(list_sum(list_transform(l[1:word], lambda x: length(x))), 0) AS done FROM w)
  SELECT ch, idx AS scene, cue, word, t AS text, round(cue + 1.5 * done / total, 9) AS start_s, round(CASE WHEN word = len(l) - 1 THEN cue + 1.5 ELSE least(cue + 1.5, cue + 1.5 * (done + length(t)) / total) END, 9) AS end_s FROM c"""))
def h8(spark, d):
    from stripweave.functions.text import balanced_chunks

    s = v.scenes(spark, d).select("ch", F.col("idx").alias("scene"), F.posexplode(balanced_chunks(F.col("narration"), 4)).alias("cue", "text"))
    cue = s.withColumns({"start_s": F.col("cue").cast("double"), "end_s": F.col("cue") + 1.5})
    return tl.word_times(cue).withColumns(r9("start_s", "end_s"))


@query("h9_scene_transitions", v.sql("scene_panels", f"""WITH {PLACED}, n AS (SELECT *, lead(scene) OVER w AS ns, lead(emotion) OVER w AS ne, lead(duration_s) OVER w AS nd FROM cl WINDOW w AS (PARTITION BY ch ORDER BY clip)),
  t AS (SELECT *, CASE WHEN ne IN ('action', 'tension') THEN ne WHEN emotion IN ('action', 'tension') THEN emotion END AS tr, least(0.3, 0.15 * least(duration_s, nd)) AS l FROM n),
  p AS (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY clip) - 1 AS k FROM t WHERE ns <> scene AND tr IS NOT NULL AND l >= 0.2)
  SELECT ch, clip, CASE tr WHEN 'action' THEN CASE k % 3 WHEN 0 THEN '快速挥动' WHEN 1 THEN '甩鞭转场' ELSE '高速滑动' END ELSE CASE k % 3 WHEN 0 THEN '故障' WHEN 1 THEN '色差故障' ELSE '闪黑' END END AS kind, (EVEN) / 1000 AS duration_s FROM p""".replace("EVEN", even("l * 1000"))))
def h9(spark, d):
    return tl.scene_transitions(_clips(spark, d), hot(spark, d))


SPANS = """sp0 AS (SELECT s.ch, s.idx AS scene, emotion, a.duration_s AS dd FROM scenes s JOIN audio a ON a.ch = s.ch AND a.scene = s.idx),
  spans AS (SELECT ch, scene, emotion, coalesce(sum(dd) OVER (PARTITION BY ch ORDER BY scene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, coalesce(sum(dd) OVER (PARTITION BY ch ORDER BY scene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + dd AS b FROM sp0)"""


def _spans(spark, d):
    s = v.scenes(spark, d).select("ch", F.col("idx").alias("scene"), "emotion").join(v.audio(spark, d).select("ch", "scene", "duration_s"), ["ch", "scene"])
    return tl.scene_starts(s, talks(spark, d)).select("ch", "scene", "emotion", F.col("scene_start").alias("start_s"), (F.col("scene_start") + F.col("duration_s")).alias("end_s"))


@query("h10_effect_spans", v.sql("scenes audio", f"""WITH {SPANS} SELECT ch, scene, CASE emotion WHEN 'action' THEN 'speed_lines' WHEN 'epic' THEN 'glow' ELSE 'rain' END AS kind, CASE emotion WHEN 'action' THEN '冲刺' WHEN 'epic' THEN '' ELSE '下雨' END AS effect,
  CASE emotion WHEN 'epic' THEN 'glow.mov' ELSE '' END AS file, round(a, 9) AS start_s, round(b - a, 9) AS duration_s FROM spans WHERE emotion IN ('action', 'epic', 'mystery') AND b - a >= 2"""))
def h10(spark, d):
    return tl.effect_spans(_spans(spark, d), {"glow": "glow.mov"}).withColumns(r9("start_s", "duration_s"))


@query("h11_sound_events", v.sql("scene_panels", f"""WITH {PLACED}, k AS (SELECT *, row_number() OVER (PARTITION BY ch, scene ORDER BY clip) - 1 AS k FROM cl),
  e AS (SELECT *, CASE WHEN emotion = 'action' THEN CASE k % 4 WHEN 0 THEN 'impact' WHEN 2 THEN 'roar' ELSE 'swoosh' END WHEN motion = 'punch_in' THEN 'impact' END AS kind FROM k)
  SELECT ch, scene, clip AS panel, round(start_s, 9) AS start_s, kind, CASE kind WHEN 'swoosh' THEN 's.wav' ELSE 'i.wav' END AS file FROM e WHERE kind IS NOT NULL"""))
def h11(spark, d):
    c = _clips(spark, d).withColumnRenamed("clip", "panel")
    return tl.sound_events(c, {"impact": "i.wav", "swoosh": "s.wav"}, hot(spark, d)).withColumns(r9("start_s"))


MOOD = SPANS + """, mo AS (SELECT *, CASE WHEN emotion IN ('tension', 'mystery', 'fear', 'sad') THEN 'tense' WHEN emotion IN ('action', 'epic') THEN 'action' ELSE 'calm' END AS mood FROM spans),
  mi AS (SELECT *, sum(ch_) OVER (PARTITION BY ch ORDER BY scene) AS span FROM (SELECT *, CASE WHEN lag(mood) OVER (PARTITION BY ch ORDER BY scene) = mood THEN 0 ELSE 1 END AS ch_ FROM mo)),
  mg AS (SELECT ch, span, any_value(mood) AS mood, min(a) AS s, max(b) AS e FROM mi GROUP BY ch, span),
  mp AS (SELECT *, span = 1 AS f, span = max(span) OVER (PARTITION BY ch) AS l FROM mg),
  ms AS (SELECT ch, CAST(span AS BIGINT) AS span, mood, CASE mood WHEN 'tense' THEN 't.wav' ELSE 'd.wav' END AS file, CASE WHEN f THEN s ELSE greatest(0, s - 0.75) END AS start_s, CASE WHEN l THEN e ELSE e + 0.75 END - CASE WHEN f THEN s ELSE greatest(0, s - 0.75) END AS duration_s,
    CASE WHEN f THEN 0.5 ELSE 1.5 END AS fade_in_s, CASE WHEN l THEN 1.0 ELSE 1.5 END AS fade_out_s FROM mp)"""


def _moods(spark, d):
    return tl.mood_spans(_spans(spark, d), {"default": "d.wav", "tense": "t.wav"}, hot=talks(spark, d))


@query("h12_mood_spans", v.sql("scenes audio", f"WITH {MOOD} SELECT ch, span, mood, file, round(start_s, 9) AS start_s, round(duration_s, 9) AS duration_s, CAST(fade_in_s AS DOUBLE) AS fade_in_s, CAST(fade_out_s AS DOUBLE) AS fade_out_s FROM ms"))
def h12(spark, d):
    return _moods(spark, d).withColumns(r9("start_s", "duration_s"))


@query("h13_truncate", v.sql("scene_panels", f"WITH {PLACED} SELECT ch, clip, round(start_s, 9) AS start_s, round(least(duration_s, 9.5 - start_s), 9) AS duration_s FROM cl WHERE start_s < 9.5"))
def h13(spark, d):
    return tl.truncate(_clips(spark, d).select("ch", "clip", "start_s", "duration_s"), 9.5).withColumns(r9("start_s", "duration_s"))


@query("h14_concat_chapters", v.sql("scene_panels", f"""WITH {PLACED}, tm AS (SELECT cl.ch, any_value(o_custkey) AS series, sum(duration_s) AS total, max(scene) + 1 AS n FROM cl JOIN orders ON o_orderkey = cl.ch GROUP BY cl.ch),
  df AS (SELECT ch, series, coalesce(sum(total + 0.6) OVER w, 0) AS off, coalesce(sum(n) OVER w, 0) AS base FROM tm WINDOW w AS (PARTITION BY series ORDER BY ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT series, cl.ch, clip, CAST(scene + base AS BIGINT) AS scene, round(start_s + off, 9) AS start_s, CASE WHEN clip = max(clip) OVER (PARTITION BY cl.ch) THEN '' ELSE 'cut' END AS transition FROM cl JOIN df ON df.ch = cl.ch"""))
def h14(spark, d):
    clips = _clips(spark, d)
    orders = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("ch"), F.col("o_custkey").alias("series"))
    totals = clips.groupBy("ch").agg(F.sum("duration_s").alias("total_s"), (F.max("scene") + 1).alias("scenes")).join(orders, "ch")
    off = tl.chapter_offsets(totals, hot=v.hot(spark, d, "orders", "o_custkey"))
    out = tl.concat_chapters(off, clips.select("ch", "clip", "scene", "start_s", F.lit("cut").alias("transition")), "clip", hot(spark, d))
    return out.select("series", "ch", "clip", "scene", F.round("start_s", 9).alias("start_s"), F.coalesce("transition", F.lit("")).alias("transition"))


# cut to 10 µs off any tie first, so both engines round the same numbers
USC = """uc AS (SELECT ch, clip, scene, floor(start_s * 1e5 + 0.3137) / 1e5 AS start_s, floor(duration_s * 1e5 + 0.3137) / 1e5 AS duration_s FROM cl), us AS (SELECT *, CAST(round(start_s * 1e6) AS BIGINT) AS u, CAST(round((start_s + duration_s) * 1e6) AS BIGINT) AS ue, CASE WHEN scene % 2 = 1 THEN 250000 ELSE 0 END AS tr FROM uc),
  rg AS (SELECT ch, clip, u, greatest(coalesce(lead(u) OVER (PARTITION BY ch ORDER BY clip), ue), u + 1) - u AS len, CAST(coalesce(sum(tr) OVER (PARTITION BY ch ORDER BY clip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM us)"""


def _micro(spark, d):
    down = {c: F.floor(F.col(c) * 1e5 + 0.3137) / 1e5 for c in ("start_s", "duration_s")}
    return _clips(spark, d).withColumns(down).withColumn("transition_s", F.when(F.col("scene") % 2 == 1, 0.25))


@query("h15_contiguous_ranges", v.sql("scene_panels", f"WITH {PLACED}, {USC} SELECT ch, clip, u + shift AS start_us, len AS length_us FROM rg"))
def h15(spark, d):
    return tl.contiguous_ranges(_micro(spark, d), True, hot(spark, d))


@query("h15_cue_ranges", v.sql("scene_panels", f"WITH {PLACED}, {USC} SELECT ch, clip AS n, u AS start_us, greatest(0, least(ue + 400000, coalesce(lead(u) OVER (PARTITION BY ch ORDER BY clip), ue + 400000)) - u) AS length_us FROM us"))
def h15b(spark, d):
    c = _micro(spark, d).select("ch", F.col("clip").alias("n"), "start_s", (F.col("start_s") + F.col("duration_s") + 0.4).alias("end_s"))
    return tl.cue_ranges(c, hot(spark, d))


@query("h16_loop_ranges", v.sql("scenes audio", f"""WITH {MOOD}, u AS (SELECT ch, span, CAST(round(round(start_s, 4) * 1e6) AS BIGINT) AS a, CAST(round((round(start_s, 4) + round(duration_s, 4)) * 1e6) AS BIGINT) AS b FROM ms)
  SELECT ch, span, s AS start_us, least(7000000, b - s) AS length_us FROM (SELECT *, unnest(range(a, b, 7000000)) AS s FROM u)"""))
def h16(spark, d):
    m = _moods(spark, d).select("ch", "span", *[F.round(c, 4).alias(c) for c in ("start_s", "duration_s")])
    return tl.loop_ranges(m, 7_000_000).drop("start_s", "duration_s")


def _shown() -> str:
    """The window of a clip's crop (x, y, w, h of a panel 800 wide) at progress pg and el seconds after its start."""
    eased = "pow(pg * pg * (3 - 2 * pg), 1.6)"
    f = "(1 + 0.16 * (1 - pow(1 - least(el / 0.2, 1), 3)))"
    x, y, w, h, ph = "((clip % 5) * 20)", "((clip % 7) * 10)", "(300 + clip % 3 * 100)", "400", "(500 + clip % 4 * 200)"
    nw, nh = f"greatest(8, {even(f'{w} / {f}')})", f"greatest(8, {even(f'{h} / {f}')})"
    side = f"800 - {w} >= {ph} - {h}"
    px = f"least(800 - {w}, {x} + CASE WHEN 800 - {w} - {x} <= 0 THEN 0 ELSE {even(f'(800 - {w} - {x}) * 0.85 * {eased}')} END)"
    py = f"least({ph} - {h}, {y} + CASE WHEN {ph} - {h} - {y} <= 0 THEN 0 ELSE {even(f'({ph} - {h} - {y}) * 0.85 * {eased}')} END)"
    punch, pan = "motion = 'punch_in'", "motion = 'fast_pan'"
    ww, wh = f"CASE WHEN {punch} THEN {nw} ELSE {w} END", f"CASE WHEN {punch} THEN {nh} ELSE {h} END"
    wx = f"CASE WHEN {punch} THEN {x} + floor(({w} - {nw}) / 2) WHEN {pan} AND {side} THEN {px} ELSE {x} END"
    wy = f"CASE WHEN {punch} THEN {y} + floor(({h} - {nh}) / 2) WHEN {pan} AND NOT ({side}) THEN {py} ELSE {y} END"
    at = [f"greatest(0, least({wx}, 800 - {ww}))", f"greatest(0, least({wy}, {ph} - {wh}))", ww, wh]
    return ", ".join(f"CAST({e} AS BIGINT) AS win_{n}" for e, n in zip(at, "xywh"))


PAN = _shown()


@query("h17_sample_timeline", v.sql("scene_panels", f"""WITH {PLACED}, mc AS (SELECT ch, clip, motion, CAST(round(start_s * 1000) AS DOUBLE) / 1000 AS s, CAST(round(duration_s * 1000) AS DOUBLE) / 1000 AS dd, scene % 2 = 1 AS tr FROM cl),
  tt AS (SELECT ch, max(s + dd) AS total FROM mc GROUP BY ch), fr AS (SELECT ch, total, unnest(range(CAST({even('total * 2')} AS BIGINT))) AS frame FROM tt),
  fa AS (SELECT fr.*, frame / 2.0 AS t, max(mc.clip) AS clip FROM fr JOIN mc ON mc.ch = fr.ch AND mc.s <= frame / 2.0 GROUP BY ALL),
  x AS (SELECT fa.*, s, dd, motion, tr, greatest(0, t - s) AS el, least(1, greatest(0, t - s) / dd) AS pg, (SELECT max(clip) FROM mc m2 WHERE m2.ch = fa.ch) AS lastc FROM fa JOIN mc ON mc.ch = fa.ch AND mc.clip = fa.clip)
  SELECT ch, frame, clip, round(el, 9) AS elapsed_s, round(pg, 9) AS progress, round(CASE WHEN tr AND clip < lastc AND t >= s + dd - 0.6 THEN (t - (s + dd - 0.6)) / 0.6 ELSE 0 END, 5) AS phase,
    round(least(1.05, CASE WHEN motion = 'punch_in' THEN 1 + 0.05 * (1 - pow(1 - least(el / 0.2, 1), 3)) ELSE 1 + 0.05 * pg * pg * (3 - 2 * pg) END), 9) AS zoom,
    coalesce((SELECT clip FROM mc c WHERE c.ch = x.ch AND c.s + 0.1 * c.dd <= x.t AND x.t < c.s + 0.8 * c.dd), -1) AS cue, coalesce((SELECT clip FROM mc c WHERE c.ch = x.ch AND c.clip % 2 = 0 AND c.s <= x.t AND x.t < c.s + 0.5 * c.dd), -1) AS effect,
    t >= total - 1.5 AS outro, WIN FROM x""".replace("WIN", PAN)))
def h17(spark, d):
    ms = {c: F.round(F.col(c) * 1000).cast("long").cast("double") / 1000 for c in ("start_s", "duration_s")}
    c = _clips(spark, d).withColumns(ms).select("ch", "clip", "start_s", "duration_s", "motion", F.when(F.col("scene") % 2 == 1, 0.6).alias("transition_s"),
        *[F.expr(e).cast("long").alias(n) for n, e in (("x", "clip % 5 * 20"), ("y", "clip % 7 * 10"), ("w", "300 + clip % 3 * 100"), ("h", "400"), ("panel_w", "800"), ("panel_h", "500 + clip % 4 * 200"))])
    totals = c.groupBy("ch").agg(F.max(F.col("start_s") + F.col("duration_s")).alias("total_s"))
    cue = c.select("ch", F.col("clip").alias("n"), (F.col("start_s") + 0.1 * F.col("duration_s")).alias("a"), (F.col("start_s") + 0.8 * F.col("duration_s")).alias("end_s")).withColumnRenamed("a", "start_s")
    fx = c.filter("clip % 2 = 0").select("ch", F.col("clip").alias("n"), "start_s", (F.col("start_s") + 0.5 * F.col("duration_s")).alias("end_s"))
    out = tl.sample_timeline(c, cue, fx, totals, 2.0, 1.5, hot(spark, d)).drop("t")
    out = out.withColumns({"cue": F.coalesce("cue", F.lit(-1)), "effect": F.coalesce("effect", F.lit(-1)), "phase": F.round(F.coalesce("phase", F.lit(0.0)), 5)})
    return out.withColumns(r9("elapsed_s", "progress", "zoom"))


@query("h18_voice_manifest", v.sql("scenes", f"""WITH s AS (SELECT ch, idx AS scene, length(narration) * 160 AS n FROM scenes WHERE NOT is_filler), p AS (SELECT *, n + CAST({even('0.18 * 2400')} AS BIGINT) AS m FROM s)
  SELECT ch, scene, round(n / 2400.0, 9) AS speech_s, round(m / 2400.0, 9) AS duration_s, round(coalesce(sum(m) OVER (PARTITION BY ch ORDER BY scene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 2400.0, 9) AS start_s FROM p"""))
def h18(spark, d):
    s = v.scenes(spark, d).select("ch", F.col("idx").alias("scene"), (F.length("narration") * 160).alias("speech_samples"), F.lit(2400).alias("rate"), "is_filler")
    return tl.voice_manifest(s, hot=talks(spark, d)).withColumns(r9("speech_s", "duration_s", "start_s"))


# --- signals ---------------------------------------------------------------------------------
def _quiet(spark, d):
    return v.samples(spark, d).withColumn("v", F.when(F.floor(F.col("i") / 12) % 2 == 1, F.col("v") / 1000).otherwise(F.col("v")))


@query("i1_compress_silence", v.sql("samples", """WITH q AS (SELECT clip, i, CASE WHEN (i // 12) % 2 = 1 THEN v / 1000 ELSE v END AS v FROM samples), n AS (SELECT clip, count(*) AS n FROM q GROUP BY clip),
  f AS (SELECT q.*, CASE WHEN i < n // 3 * 3 THEN max(abs(v)) OVER (PARTITION BY q.clip, i // 3) < pow(10, -45 / 20.0) ELSE false END AS quiet FROM q JOIN n ON n.clip = q.clip),
  g AS (SELECT *, i - row_number() OVER (PARTITION BY clip, quiet ORDER BY i) AS g FROM f), p AS (SELECT *, row_number() OVER (PARTITION BY clip, quiet, g ORDER BY i) - 1 AS k FROM g)
  SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY i) - 1 AS i, round(v, 9) AS v FROM p WHERE NOT quiet OR k < 5"""))
def i1(spark, d):
    return sg.compress_silence(_quiet(spark, d), 600, 5 / 600, -45.0, hot=v.hot(spark, d, "embeddings", "vec_id")).withColumn("v", F.round("v", 9))


@query("i2_mix_tracks", v.sql("samples", """WITH vo AS (SELECT clip AS ch, i, v FROM samples), m AS (SELECT i, v FROM samples WHERE clip = (SELECT min(clip) FROM samples)), x AS (SELECT i, v FROM samples WHERE clip = (SELECT max(clip) FROM samples)),
  a AS (SELECT ch, 7 + k AS i, k, (SELECT v FROM m WHERE m.i = k % (SELECT count(*) FROM m)) * CASE WHEN k < 8 THEN k / 7.0 ELSE 1 END * CASE WHEN k >= 24 THEN 1 - (k - 24) / 15.0 ELSE 1 END * pow(10, -6 / 20.0) AS v FROM (SELECT DISTINCT ch FROM vo), (SELECT unnest(range(40)) AS k)),
  b AS (SELECT ch, 50 + i AS i, v * pow(10, -12 / 20.0) AS v FROM (SELECT DISTINCT ch FROM vo), x),
  s AS (SELECT vo.ch, vo.i, least(1.0, greatest(-1.0, vo.v + coalesce(a.v, 0))) AS v FROM vo LEFT JOIN a ON a.ch = vo.ch AND a.i = vo.i)
  SELECT s.ch, s.i, round(least(1.0, greatest(-1.0, s.v + coalesce(b.v, 0))), 9) AS v FROM s LEFT JOIN b ON b.ch = s.ch AND b.i = s.i"""))
def i2(spark, d):
    s = v.samples(spark, d)
    voice = s.withColumnRenamed("clip", "ch")
    ends = s.agg(F.min("clip").alias("lo"), F.max("clip").alias("hi"))
    music = s.join(F.broadcast(ends), F.col("clip") == F.col("lo")).select(F.lit("m").alias("asset"), "i", "v")
    sound = s.join(F.broadcast(ends), F.col("clip") == F.col("hi")).select(F.lit("x").alias("asset"), "i", "v")
    chapters = voice.select("ch").distinct()
    bgm = chapters.select("ch", F.lit(0).alias("n"), F.lit("m").alias("asset"), F.lit(0.7).alias("start_s"), F.lit(4.0).alias("duration_s"), F.lit(0.8).alias("fade_in_s"), F.lit(1.6).alias("fade_out_s"), F.lit(-6.0).alias("gain_db"))
    sfx = chapters.select("ch", F.lit(0).alias("n"), F.lit("x").alias("asset"), F.lit(5.0).alias("start_s"), F.lit(-12.0).alias("gain_db"))
    return sg.mix_tracks(voice, bgm, sfx, music.unionByName(sound), 10).withColumn("v", F.round("v", 9))


@query("i3_resample_linear", v.sql("samples", """WITH n AS (SELECT clip, count(*) AS n FROM samples GROUP BY clip), g AS (SELECT clip, n, unnest(range(CAST(ceil(n / 1.5) AS BIGINT))) AS j FROM n),
  p AS (SELECT *, j * 1.5 AS x, CAST(floor(j * 1.5) AS BIGINT) AS lo FROM g)
  SELECT p.clip, j AS i, round(a.v + (coalesce(b.v, a.v) - a.v) * (x - lo), 9) AS v FROM p JOIN samples a ON a.clip = p.clip AND a.i = lo LEFT JOIN samples b ON b.clip = p.clip AND b.i = lo + 1"""))
def i3(spark, d):
    return sg.resample_linear(v.samples(spark, d), 24000, 16000).withColumn("v", F.round("v", 9))
