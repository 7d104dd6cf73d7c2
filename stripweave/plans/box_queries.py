"""Registered queries on boxes and intervals, with their SQL texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stripweave.operators import boxes as bx, strips
from stripweave.plans import views as v
from stripweave.plans.strip_queries import even, r6

QUERIES, SQL = {}, {}


def query(name: str, text: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if text is not None:
            SQL[name] = text
        return fn
    return add


def hot_blocks(spark, d):
    return v.hot_chapters(spark, d)


def sourced(spark, d):
    return v.boxes(spark, d).withColumn("source", F.concat(F.lit("s"), (F.col("idx") % 3).cast("string")))


PAIR = """pr AS (SELECT a.block, a.idx AS a_idx, b.idx AS b_idx, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS w, (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS h,
    (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ab, least(a.x0, b.x0) AS x0, least(a.y0, b.y0) AS y0, greatest(a.x1, b.x1) AS x1, greatest(a.y1, b.y1) AS y1,
    a.kind AS a_kind, b.kind AS b_kind FROM boxes a JOIN boxes b ON a.block = b.block)"""


@query("e1_box_pairs", v.sql("boxes", f"""WITH {PAIR} SELECT block, a_idx, b_idx, w * h AS inter, round(CAST(w * h AS DOUBLE) / (aa + ab - w * h), 6) AS iou, round(CAST(w * h AS DOUBLE) / least(aa, ab), 6) AS contain,
  h AS overlap1d, round(CAST(h AS DOUBLE) / (y1 - y0), 6) AS iou1d, x0, y0, x1, y1 FROM pr WHERE w > 0 AND h > 0 AND a_idx < b_idx"""))
def e1(spark, d):
    b = v.boxes(spark, d)
    out = bx.box_pairs(b, b).filter("a_idx < b_idx").drop("a_kind", "b_kind", "a_area", "b_area")
    return out.withColumns(r6("iou", "contain", "iou1d"))


# a group's boxes one after the other, with the list of those kept so far
@query("e2_nms", v.sql("boxes", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY block, kind ORDER BY score DESC, idx) AS n, (x1 - x0 + 1) * (y1 - y0 + 1) AS a FROM boxes),
  r AS (SELECT block, kind, n, [{'idx': idx, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'score': score, 'a': a}] AS kept FROM o WHERE n = 1
    UNION ALL SELECT o.block, o.kind, o.n, CASE WHEN len(list_filter(kept, lambda k: CAST(greatest(0, least(k.x1, o.x1) - greatest(k.x0, o.x0) + 1) * greatest(0, least(k.y1, o.y1) - greatest(k.y0, o.y0) + 1) AS DOUBLE)
        / (k.a + o.a - greatest(0, least(k.x1, o.x1) - greatest(k.x0, o.x0) + 1) * greatest(0, least(k.y1, o.y1) - greatest(k.y0, o.y0) + 1)) > 0.1)) > 0 THEN kept
      ELSE list_append(kept, {'idx': o.idx, 'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1, 'score': o.score, 'a': o.a}) END
    FROM r JOIN o ON o.block = r.block AND o.kind = r.kind AND o.n = r.n + 1),
  l AS (SELECT block, kind, unnest(arg_max(kept, n)) AS k FROM r GROUP BY block, kind)
  SELECT block, kind, k.idx AS idx, k.x0 AS x0, k.y0 AS y0, k.x1 AS x1, k.y1 AS y1, k.score AS score FROM l""", recursive=True))
def e2(spark, d):
    return bx.nms(v.boxes(spark, d), 0.1, hot_blocks(spark, d))


def _common(k: str, o: str) -> str:
    return f"(greatest(0, least({k}.x1, {o}.x1) - greatest({k}.x0, {o}.x0)) * greatest(0, least({k}.y1, {o}.y1) - greatest({k}.y0, {o}.y0)))"


def _size(k: str) -> str:
    return f"(({k}.x1 - {k}.x0) * ({k}.y1 - {k}.y0))"


def _iou(k: str, o: str) -> str:
    return f"(CAST({_common(k, o)} AS DOUBLE) / ({_size(k)} + {_size(o)} - {_common(k, o)}))"


def _inside(k: str, o: str) -> str:
    return f"(CAST({_common(k, o)} AS DOUBLE) / least({_size(k)}, {_size(o)}))"


def _round(k: str, o: str) -> str:
    """The box around two, with the better score and both sources."""
    return (f"{{'x0': least({k}.x0, {o}.x0), 'y0': least({k}.y0, {o}.y0), 'x1': greatest({k}.x1, {o}.x1), 'y1': greatest({k}.y1, {o}.y1), 'score': greatest({k}.score, {o}.score), "
            f"'source': array_to_string(list_sort(list_distinct(list_concat(string_split({k}.source, '+'), string_split({o}.source, '+')))), '+')}}")


ONE = "{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'score': score, 'source': 's' || (idx % 3)}"
NO_BOX = "CAST([] AS STRUCT(x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT, score DOUBLE, source VARCHAR)[])"
AS_BOX = "STRUCT(x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT, score DOUBLE, source VARCHAR)"


@query("e3_merge_tile_hits", v.sql("boxes", f"""WITH o AS (SELECT block, kind, idx % 2 = 1 AS cut, CAST({ONE} AS {AS_BOX}) AS b, row_number() OVER (PARTITION BY block, kind ORDER BY idx % 2, score DESC, y0, x0, idx) AS n FROM boxes),
  r AS (SELECT block, kind, CAST(0 AS BIGINT) AS n, {NO_BOX} AS kept FROM (SELECT DISTINCT block, kind FROM o)
    UNION ALL SELECT block, kind, n, CASE WHEN len(list_filter(kept, lambda k: {_iou('k', 'b')} >= 0.5)) > 0 OR (cut AND len(list_filter(kept, lambda k: {_inside('k', 'b')} >= 0.7 AND {_size('k')} >= {_size('b')})) > 0) THEN kept
      WHEN cut AND side > 0 THEN list_concat(kept[: side - 1], [{_round('kept[side]', 'b')}], kept[side + 1 :]) ELSE list_append(kept, b) END
    FROM (SELECT o.block, o.kind, o.n, o.cut, o.b, r.kept, coalesce(list_position(list_transform(r.kept, lambda k: {_common('k', 'o.b')} > 0 AND least(k.x1, o.b.x1) - greatest(k.x0, o.b.x0) >= 0.6 * greatest(1, least(k.x1 - k.x0, o.b.x1 - o.b.x0))), true), 0) AS side
      FROM r JOIN o ON o.block = r.block AND o.kind = r.kind AND o.n = r.n + 1)),
  l AS (SELECT block, kind, unnest(arg_max(kept, n)) AS k FROM r GROUP BY block, kind)
  SELECT block, kind, k.x0 AS x0, k.y0 AS y0, k.x1 AS x1, k.y1 AS y1, k.score AS score, k.source AS source FROM l""", recursive=True))
def e3(spark, d):
    hits = sourced(spark, d).withColumn("truncated", F.col("idx") % 2 == 1)
    return bx.merge_tile_hits(hits, 0.5, hot_blocks(spark, d))


# each step either joins the box in hand with the first it meets, or puts it down and takes the next
@query("e4_fuse_boxes", v.sql("boxes", f"""WITH o AS (SELECT block, kind, CAST({ONE} AS {AS_BOX}) AS b, row_number() OVER (PARTITION BY block, kind ORDER BY score DESC, y0, x0, y1, x1) AS n FROM boxes),
  r AS (SELECT block, kind, n, CAST(1 AS BIGINT) AS step, b, {NO_BOX} AS kept FROM o WHERE n = 1
    UNION ALL SELECT q.block, q.kind, CASE WHEN hit > 0 THEN q.n ELSE q.n + 1 END, step + 1, CASE WHEN hit > 0 THEN {_round('kept[hit]', 'q.b')} ELSE o.b END, CASE WHEN hit > 0 THEN list_concat(kept[: hit - 1], kept[hit + 1 :]) ELSE list_append(kept, q.b) END
    FROM (SELECT *, coalesce(list_position(list_transform(kept, lambda k: {_iou('k', 'b')} >= 0.3 OR {_inside('k', 'b')} >= 0.6), true), 0) AS hit FROM r WHERE b IS NOT NULL) q LEFT JOIN o ON o.block = q.block AND o.kind = q.kind AND o.n = q.n + 1),
  l AS (SELECT block, kind, unnest(arg_max(kept, step)) AS k FROM r GROUP BY block, kind)
  SELECT block, kind, k.x0 AS x0, k.y0 AS y0, k.x1 AS x1, k.y1 AS y1, k.score AS score, k.source AS source FROM l""", recursive=True))
def e4(spark, d):
    return bx.fuse_boxes(sourced(spark, d), 0.3, 0.6, hot_blocks(spark, d))


@query("e5_suppress_contained", v.sql("boxes", f"""WITH {PAIR}, gone AS (SELECT DISTINCT block, a_idx AS idx FROM pr WHERE w > 0 AND h > 0 AND a_kind = 'free_text' AND b_kind = 'bubble'
    AND CAST(w * h AS DOUBLE) / least(aa, ab) >= 0.6 AND ab >= aa)
  SELECT block, idx, x0, y0, x1, y1, kind, score FROM boxes WHERE kind = 'bubble' OR (kind = 'free_text' AND (block, idx) NOT IN (SELECT block, idx FROM gone))"""))
def e5(spark, d):
    b = v.boxes(spark, d)
    return bx.suppress_contained(b.filter("kind = 'free_text'"), b.filter("kind = 'bubble'"))


@query("e6_tile_grid", v.sql("panels", """SELECT ch, idx, unnest(CASE WHEN height <= 800 THEN [CAST(0 AS BIGINT)] ELSE list_distinct(list_concat(range(0, height - 800, 400), [CAST(height - 800 AS BIGINT)])) END) AS top FROM panels"""))
def e6(spark, d):
    return bx.tile_grid(v.panels(spark, d).select("ch", "idx", "height", "width")).select("ch", "idx", "top")


def _zones(b):
    """Zones from boxes: fractions of a 900 px block, some out of bounds, inverted or of the wrong length."""
    top, bottom = F.col("y0") / 640.0 - 0.02, F.col("y1") / 640.0
    y = F.when(F.col("idx") % 7 == 6, F.array(top)).when(F.col("idx") % 5 == 4, F.array(bottom, top)).otherwise(F.array(top, bottom))
    return b.select("block", F.when(F.col("kind").isin("head", "person"), "keep").otherwise("drop").alias("list"), F.col("idx").alias("pos"),
                    y.alias("y"), (F.col("idx") % 6).alias("priority"))


@query("e7_zone_spec", v.sql("boxes", """WITH z AS (SELECT block, CASE WHEN kind IN ('head', 'person') THEN 'keep' ELSE 'drop' END AS li, idx % 7 = 6 AS short,
    CASE WHEN idx % 5 = 4 THEN y1 / 640.0 ELSE y0 / 640.0 - 0.02 END AS t, CASE WHEN idx % 5 = 4 THEN y0 / 640.0 - 0.02 ELSE y1 / 640.0 END AS b FROM boxes),
  c AS (SELECT *, least(greatest(t, 0.0), 1.0) AS lo, least(greatest(b, 0.0), 1.0) AS hi FROM z),
  e AS (SELECT *, NOT (short OR t < -0.05 OR b > 1.05 OR lo >= hi) AS ok FROM c),
  p AS (SELECT block, count(*) FILTER (ok AND li = 'keep') AS keeps, count(*) FILTER (ok AND li = 'drop') AS drops, count(*) FILTER (NOT ok) AS errors FROM e GROUP BY block)
  SELECT block, role, keeps, drops, errors + CASE WHEN role IN ('key', 'insert') AND keeps = 0 THEN 1 ELSE 0 END AS errors
  FROM (SELECT *, CASE block % 3 WHEN 0 THEN 'key' WHEN 1 THEN 'insert' ELSE 'transition' END AS role FROM p)"""))
def e7(spark, d):
    b = v.boxes(spark, d)
    role = F.element_at(F.array(F.lit("key"), F.lit("insert"), F.lit("transition")), (F.col("block") % 3 + 1).cast("int"))
    return bx.zone_spec(b.select("block").distinct().withColumn("role", role), _zones(b)).drop("top", "bottom")


@query("e7_fallback_spec", v.sql("boxes", """WITH f AS (SELECT block, CAST(min(y0) FILTER (kind IN ('head', 'person')) AS DOUBLE) / 1024 AS t, CAST(max(y1) FILTER (kind IN ('head', 'person')) AS DOUBLE) / 1024 AS b FROM boxes GROUP BY block)
  SELECT block, CAST(TOP AS BIGINT) AS top, CAST(BOT AS BIGINT) AS bottom, CASE WHEN t IS NULL THEN 'block' ELSE 'subjects' END AS origin FROM f""".replace("TOP", even("coalesce(t, 0) * 1000")).replace("BOT", even("coalesce(greatest(b, t + 0.01), 1) * 1000"))))
def e7b(spark, d):
    b = v.boxes(spark, d)
    out = bx.fallback_spec(b.select("block").distinct().withColumn("height", F.lit(1024)), b)
    return out.select("block", *[F.round(F.col(c) * 1000).cast("long").alias(c) for c in ("top", "bottom")], "origin")


@query("e8_snap_intervals", v.sql("boxes", """WITH s AS (SELECT block, y0, y1, false AS own FROM boxes UNION ALL SELECT DISTINCT block, 300, 340, true FROM boxes),
  r AS (SELECT *, max(y1) OVER (PARTITION BY block ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
  g AS (SELECT *, sum(CASE WHEN reach IS NULL OR y0 >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY block ORDER BY y0, y1 ROWS UNBOUNDED PRECEDING) AS isl FROM r)
  SELECT block, min(y0) AS k0, max(y1) AS k1 FROM g GROUP BY block, isl HAVING bool_or(own)"""))
def e8(spark, d):
    b = v.boxes(spark, d)
    keep = b.select("block").distinct().select("block", F.lit(300).alias("k0"), F.lit(340).alias("k1"))
    return bx.snap_intervals(keep, b, hot=hot_blocks(spark, d))


def _pixel_zones(b):
    kind = F.element_at(F.array(F.lit("narration"), F.lit("detached_bubble"), F.lit("sfx")), (F.col("idx") % 3 + 1).cast("int"))
    return b.select("block", F.col("idx").alias("zone"), F.when(F.col("kind") == "person", "keep").otherwise("drop").alias("list"),
                    (F.col("y0") + 10).alias("y0"), (F.col("y0") + 70).alias("y1"), kind.alias("kind"), (F.col("idx") % 3 + 1).cast("int").alias("priority")).filter(
        (F.col("list") == "keep") | (F.col("idx") % 2 == 0))


def _snapped(name: str, asked: str) -> str:
    """Keep rows of ``asked`` (block, k0, k1) grown to every head and attached bubble they touch: the island of each among all spans."""
    return f"""{name}_s AS (SELECT block, k0 AS y0, k1 AS y1, true AS own FROM {asked} UNION ALL SELECT block, y0, y1, false FROM tb WHERE role IN ('head', 'attached') AND y1 > y0),
  {name}_t AS (SELECT block, y0, max(y1) AS y1, bool_or(own) AS own FROM {name}_s GROUP BY block, y0),
  {name}_r AS (SELECT *, max(y1) OVER (PARTITION BY block ORDER BY y0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {name}_t),
  {name}_g AS (SELECT *, sum(CASE WHEN reach IS NULL OR y0 >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY block ORDER BY y0 ROWS UNBOUNDED PRECEDING) AS isl FROM {name}_r),
  {name} AS (SELECT block, min(y0) AS k0, max(y1) AS k1 FROM {name}_g GROUP BY block, isl HAVING bool_or(own))"""


# typed boxes ``tb`` and keep rows by policy ``rg`` from blocks ``bl``, boxes ``bb`` and zones ``zz``
CONSTRAINTS = f"""ins AS (SELECT bb.block, bb.idx, bool_or(zz.kind = 'narration') AS narr FROM bb JOIN zz ON zz.block = bb.block AND zz.list = 'drop' AND zz.kind IN ('narration', 'detached_bubble')
    WHERE least(bb.y1, zz.y1) - greatest(bb.y0, zz.y0) > 0 AND least(bb.y1, zz.y1) - greatest(bb.y0, zz.y0) >= 0.5 * greatest(1, bb.y1 - bb.y0) GROUP BY bb.block, bb.idx),
  roles AS (SELECT bb.*, height, width, CASE WHEN kind IN ('head', 'person') THEN kind WHEN kind = 'bubble' THEN CASE WHEN narr IS NULL THEN 'attached' ELSE 'excluded' END WHEN kind = 'narration' OR narr THEN 'narration' ELSE 'sfx' END AS role
    FROM bb LEFT JOIN ins ON ins.block = bb.block AND ins.idx = bb.idx JOIN bl ON bl.block = bb.block),
  padded AS (SELECT block, CASE WHEN role = 'head' THEN greatest(0, y0 - round_even(0.08 * (y1 - y0), 0)) ELSE y0 END AS y0, CASE WHEN role = 'head' THEN least(height, y1 + round_even(0.08 * (y1 - y0), 0)) ELSE y1 END AS y1, role FROM roles),
  loud AS (SELECT zz.block, list({{'zone': zz.zone, 'y0': zz.y0, 'y1': zz.y1, 'c0': greatest(0, zz.y0), 'c1': least(height, zz.y1)}} ORDER BY zz.zone) AS l FROM zz JOIN bl ON bl.block = zz.block
    WHERE list = 'drop' AND kind = 'sfx' AND NOT EXISTS (SELECT 1 FROM padded p WHERE p.block = zz.block AND p.role = 'sfx' AND p.y1 > p.y0 AND zz.y1 > zz.y0 AND least(p.y1, zz.y1) > greatest(p.y0, zz.y0)) GROUP BY zz.block),
  apart AS (SELECT block, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: least(k.c1, x.y1) > greatest(k.c0, x.y0))) > 0 THEN acc ELSE list_append(acc, x) END, l[1:0])) AS k FROM loud),
  tb AS (SELECT block, CAST(y0 AS BIGINT) AS y0, CAST(y1 AS BIGINT) AS y1, role FROM padded UNION ALL SELECT block, k.c0, k.c1, 'sfx' FROM apart),
  asked AS (SELECT block, CAST(min(y0) AS BIGINT) AS k0, CAST(max(y1) AS BIGINT) AS k1 FROM zz WHERE list = 'keep' GROUP BY block),
  {_snapped('base', 'asked')},
  tx AS (SELECT base.block, base.k0, base.k1, tb.y0 AS b0, tb.y1 AS b1, (tb.y0 + tb.y1) / 2.0 >= (k0 + k1) / 2.0 AS low FROM base JOIN tb ON tb.block = base.block AND tb.role IN ('excluded', 'narration') AND tb.y1 > tb.y0 AND k1 > k0 AND least(k1, tb.y1) > greatest(k0, tb.y0)),
  cf AS (SELECT block, any_value(k0) AS k0, any_value(k1) AS k1, count(*) AS conflicts, min(b0) AS t0, max(b1) AS t1, min(b0) FILTER (low) AS c1, max(b1) FILTER (NOT low) AS c0 FROM tx GROUP BY block),
  texts AS (SELECT block, least(k0, t0) AS k0, greatest(k1, t1) AS k1 FROM cf),
  {_snapped('wide', 'texts')},
  trim AS (SELECT cf.block, k0, k1, greatest(k0, coalesce(c0, k0)) AS n0, least(k1, coalesce(c1, k1)) AS n1, conflicts, height FROM cf JOIN bl ON bl.block = cf.block),
  rg AS (SELECT block, policy, greatest(0, k0) AS k0, least(height, k1) AS k1, conflicts FROM (
    SELECT base.block, unnest(['default', 'sfx_whole']) AS policy, base.k0, base.k1, coalesce(conflicts, 0) AS conflicts, height FROM base JOIN bl ON bl.block = base.block LEFT JOIN cf ON cf.block = base.block
    UNION ALL SELECT cf.block, 'keep_text', wide.k0, wide.k1, conflicts, height FROM cf JOIN wide ON wide.block = cf.block JOIN bl ON bl.block = cf.block
    UNION ALL SELECT block, 'cut_subject', n0, n1, conflicts, height FROM trim WHERE n1 - n0 >= 0.2 * height AND NOT EXISTS (SELECT 1 FROM tb WHERE tb.block = trim.block AND role = 'head' AND tb.y1 > tb.y0 AND k1 > k0 AND least(k1, tb.y1) > greatest(k0, tb.y0) AND (tb.y0 < n0 OR tb.y1 > n1))))"""


@query("e9_classify_constraints", v.sql("boxes", f"""WITH bl AS (SELECT DISTINCT block, 920 AS height, 800 AS width FROM boxes), bb AS (SELECT block, idx, y0, y1, kind FROM boxes),
  zz AS (SELECT block, idx AS zone, CASE WHEN kind = 'person' THEN 'keep' ELSE 'drop' END AS list, y0 + 10 AS y0, y0 + 70 AS y1, ['narration', 'detached_bubble', 'sfx'][idx % 3 + 1] AS kind FROM boxes WHERE kind = 'person' OR idx % 2 = 0),
  {CONSTRAINTS} SELECT block, policy, CAST(k0 AS BIGINT) AS k0, CAST(k1 AS BIGINT) AS k1, CAST(conflicts AS BIGINT) AS conflicts FROM rg"""))
def e9(spark, d):
    b = bx.durable(v.boxes(spark, d))
    blocks = b.select("block").distinct().select("block", F.lit(920).alias("height"), F.lit(800).alias("width"))
    zones = _pixel_zones(b)
    typed = bx.durable(bx.classify_constraints(blocks, b, zones))
    return bx.keep_ranges(blocks, typed, zones, hot_blocks(spark, d))


@query("e10_boundary_counts", v.sql("boxes", """WITH b AS (SELECT block, greatest(0, y0 + 1) AS lo, least(701, y1) AS hi FROM boxes WHERE greatest(0, y0 + 1) < least(701, y1)),
  e AS (SELECT block, lo AS y, 1 AS d FROM b UNION ALL SELECT block, hi, -1 FROM b UNION ALL SELECT DISTINCT block, 0, 0 FROM boxes UNION ALL SELECT DISTINCT block, 701, 0 FROM boxes),
  s AS (SELECT block, y, sum(d) AS d FROM e GROUP BY block, y),
  w AS (SELECT block, y AS y0, lead(y) OVER (PARTITION BY block ORDER BY y) AS y1, sum(d) OVER (PARTITION BY block ORDER BY y) AS n FROM s)
  SELECT block, y0, y1, CAST(n AS BIGINT) AS n FROM w WHERE y1 IS NOT NULL"""))
def e10(spark, d):
    b = v.boxes(spark, d)
    return bx.boundary_counts(b, b.select("block").distinct().withColumn("height", F.lit(700)), hot_blocks(spark, d))


ENERGY = """near AS (SELECT strip, y, px, lag(px) OVER w AS up, lead(px) OVER w AS down FROM strip_rows WINDOW w AS (PARTITION BY strip ORDER BY y)),
  diff AS (SELECT strip, y, CASE WHEN up IS NULL OR down IS NULL THEN list_transform(px, lambda x: 0) ELSE list_transform(list_zip(down, up), lambda t: t[1] - t[2]) END AS d FROM near),
  pad AS (SELECT strip, y, list_concat([d[2]], d, [d[len(d) - 1]]) AS d FROM diff),
  e0 AS (SELECT strip, y, list_avg(list_transform(range(2, len(d)), lambda i: abs(d[i - 1] + 2 * d[i] + d[i + 1]))) AS e FROM pad),
  en AS (SELECT strip AS block, y, e / (max(e) OVER (PARTITION BY strip) + 1e-6) AS e FROM e0)"""


# Blocks, boxes and zones on the strips, for the search: a box every 7 rows, zones every 25.
class Strips:
    def __init__(self, spark, d, width=40):
        rows = v.strip_rows(spark, d)
        self.hot = v.hot_strips(spark, d)
        r = rows.select(F.col("strip").cast("long").alias("block"), "y", *[F.element_at("px", i + 1).alias(f"p{i}") for i in range(3)])
        self.blocks = r.groupBy("block").agg((F.max("y") + 1).cast("int").alias("height")).select("block", "height", F.lit(width).alias("width"))
        kind = F.element_at(F.array(*[F.lit(k) for k in v.KINDS]), F.col("p1") % 6 + 1)
        y, x = F.col("y").cast("int"), F.col("p0") % 30
        self.boxes = r.filter("y % 7 = 0").select("block", F.col("y").alias("idx"), x.alias("x0"), y.alias("y0"), (x + 8).alias("x1"), (y + 4).alias("y1"), kind.alias("kind"), F.lit(0.5).alias("score"))
        zk = F.element_at(F.array(F.lit("narration"), F.lit("detached_bubble"), F.lit("sfx")), F.col("p2") % 3 + 1)
        self.zones = r.filter("y % 25 = 5 or y % 25 = 20").select(
            "block", F.col("y").alias("zone"), F.when(F.col("y") % 25 == 5, "keep").otherwise("drop").alias("list"), y.alias("y0"),
            F.when(F.col("y") % 25 == 5, y + 12).otherwise(y + 3).alias("y1"), zk.alias("kind"), (F.col("p2") % 3 + 1).alias("priority"))
        self.energy = strips.cut_energy(rows, self.hot).withColumnRenamed("strip", "block").withColumn("block", F.col("block").cast("long"))
        # each is read many times by the search
        self.blocks, self.boxes, self.zones, self.energy = map(bx.durable, (self.blocks, self.boxes, self.zones, self.energy))

    def typed(self):
        return bx.classify_constraints(self.blocks, self.boxes, self.zones)


# the strips as blocks ``bl``, boxes ``bb`` and zones ``zz``
STRIPS = """bl AS (SELECT strip AS block, max(y) + 1 AS height, {width} AS width FROM strip_rows GROUP BY strip),
  bb AS (SELECT strip AS block, y AS idx, y AS y0, y + 4 AS y1, {kind} AS kind FROM strip_rows WHERE y % 7 = 0),
  zz AS (SELECT strip AS block, y AS zone, CASE WHEN y % 25 = 5 THEN 'keep' ELSE 'drop' END AS list, y AS y0, CASE WHEN y % 25 = 5 THEN y + 12 ELSE y + 3 END AS y1, ['narration', 'detached_bubble', 'sfx'][px[3] % 3 + 1] AS kind, {priority} AS priority FROM strip_rows WHERE y % 25 IN (5, 20))"""
KIND = "[" + ", ".join(f"'{k}'" for k in v.KINDS) + "][px[2] % 6 + 1]"

# every window of an allowed height, with its score (``strict`` where it cuts nothing and covers the keep rows), for each (block, policy) of ``fc``
SCORES = f"""row_weight AS (SELECT block, policy, y, max(w) AS w FROM (SELECT fc.block, policy, unnest(range(greatest(0, zz.y0), least(height, zz.y1))) AS y, CASE WHEN zz.kind <> 'sfx' THEN 3.0 ELSE 1.0 END AS w FROM zz JOIN fc ON fc.block = zz.block
    WHERE list = 'drop' AND NOT (policy = 'keep_text' AND EXISTS (SELECT 1 FROM tx WHERE tx.block = zz.block AND least(tx.b1, zz.y1) - greatest(tx.b0, zz.y0) > 0 AND least(tx.b1, zz.y1) - greatest(tx.b0, zz.y0) >= 0.5 * greatest(1, tx.b1 - tx.b0)))) GROUP BY block, policy, y),
  hs AS (SELECT *, least(CAST(ceil(width / 1.35) AS BIGINT), height) AS lo, least(CAST(floor(width / 0.55) AS BIGINT), height) AS hi FROM fc),
  win AS (SELECT *, y0 + h AS y1, (h = hi OR (h - lo) % 4 = 0) AND (y0 % 4 = 0 OR y0 + h = height) AS coarse FROM (SELECT *, unnest(range(0, height - h + 1)) AS y0 FROM (SELECT *, unnest(range(lo, hi + 1)) AS h FROM hs))),
  cut AS (SELECT w.block, w.policy, w.y0, w.y1, coalesce(sum(n) FILTER (role IN ('attached', 'excluded', 'narration') OR (role = 'sfx' AND w.policy = 'sfx_whole')), 0) AS bc, coalesce(sum(n) FILTER (role = 'sfx' AND w.policy <> 'sfx_whole'), 0) AS sc, coalesce(sum(n) FILTER (role = 'head'), 0) AS hc,
      coalesce(sum((least(greatest(w.y0 - t0, 0), t1 - t0) + least(greatest(t1 - w.y1, 0), t1 - t0)) / greatest(1.0, t1 - t0)) FILTER (role = 'person' AND (k0 IS NULL OR least(k1, t1) > greatest(k0, t0))), 0) AS pc
    FROM (SELECT w.*, tb.role, tb.y0 AS t0, tb.y1 AS t1, CAST(tb.y0 < w.y0 AND w.y0 < tb.y1 AS INT) + CAST(tb.y0 < w.y1 AND w.y1 < tb.y1 AS INT) AS n FROM win w LEFT JOIN tb ON tb.block = w.block) w GROUP BY w.block, w.policy, w.y0, w.y1),
  lost AS (SELECT w.block, w.policy, w.y0, w.y1, coalesce(sum(r.w), 0) AS dropped FROM win w LEFT JOIN row_weight r ON r.block = w.block AND r.policy = w.policy AND r.y >= w.y0 AND r.y < w.y1 GROUP BY w.block, w.policy, w.y0, w.y1),
  part AS (SELECT win.*, bc, sc, hc, pc, dropped, coalesce(k1 - k0, 0) > 0 AS has, coalesce(CASE WHEN win.y0 > 0 THEN u.e END, 0) + coalesce(CASE WHEN win.y1 < height THEN l.e END, 0) AS e FROM win JOIN cut USING (block, policy, y0, y1) JOIN lost USING (block, policy, y0, y1)
    LEFT JOIN en u ON u.block = win.block AND u.y = win.y0 LEFT JOIN en l ON l.block = win.block AND l.y = win.y1),
  cov AS (SELECT *, CASE WHEN has THEN greatest(0, least(y1, k1) - greatest(y0, k0)) / CAST(k1 - k0 AS DOUBLE) ELSE 1.0 END AS cover, CAST(width AS DOUBLE) AS wd FROM part),
  sco AS (SELECT *, bc = 0 AND hc = 0 AND cover >= 0.98 - 1e-9 AS strict, cover - dropped / height - 0.35 * CASE WHEN has THEN (h - (k1 - k0)) / CAST(height AS DOUBLE) ELSE h / CAST(height AS DOUBLE) END - 0.15 * e
    - 1.5 * greatest(0.0, greatest(wd / 1.05 - h, h - wd / 0.62)) / wd - 0.3 * abs(wd / h - 2 / 3) - 0.5 * sc - 0.3 * pc - bc - 3 * hc AS score, greatest(1, round_even(40 * wd / 575, 0)) AS gap FROM cov)"""


def _picked(usable: str) -> str:
    """The three best windows that differ: seeds among the coarse ones, windows near the seeds, then one after the other. ``usable`` says what counts where ``anys`` tells whether the block has a strict window."""
    near = "abs(p.y0 - q.y0) <= p.gap AND abs(p.y1 - q.y1) <= p.gap"
    picks = ", ".join(f"""p{n} AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.block, p.policy ORDER BY round(p.score, 9) DESC, p.y0, p.y1) AS rn FROM pool p
      WHERE NOT EXISTS (SELECT 1 FROM ({' UNION ALL '.join(['SELECT block, policy, y0, y1 FROM pool WHERE false', *(f'SELECT block, policy, y0, y1 FROM p{m}' for m in range(n))])}) q WHERE q.block = p.block AND q.policy = p.policy AND {near})) WHERE rn = 1)""" for n in range(3))
    return f"""any_strict AS (SELECT block, policy, bool_or(strict) AS anys FROM sco WHERE coarse GROUP BY block, policy), ok AS (SELECT sco.*, NOT anys AS loose FROM sco JOIN any_strict USING (block, policy) WHERE {usable}),
  seed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block, policy ORDER BY round(score, 9) DESC, y0, y1) AS rn FROM ok WHERE coarse) WHERE rn <= 30),
  pool AS (SELECT * FROM ok p WHERE coarse OR EXISTS (SELECT 1 FROM seed q WHERE q.block = p.block AND q.policy = p.policy AND abs(q.y0 - p.y0) < 4 AND abs(q.y1 - p.y1) < 4)),
  {picks}, picked AS (SELECT *, 0 AS rank FROM p0 UNION ALL SELECT *, 1 FROM p1 UNION ALL SELECT *, 2 FROM p2)"""


@query("e11_search_windows", v.sql("strip_rows", f"""WITH {ENERGY}, {STRIPS.format(width=40, kind=KIND, priority='px[3] % 3 + 1')}, {CONSTRAINTS}, fc AS (SELECT bl.*, 'default' AS policy, k0, k1 FROM bl LEFT JOIN rg ON rg.block = bl.block AND rg.policy = 'default'),
  {SCORES}, {_picked('true')} SELECT CAST(block AS BIGINT) AS block, rank, y0, y1, round(score, 6) AS score, round(cover, 6) AS cover FROM picked"""))
def e11(spark, d):
    s = Strips(spark, d)
    typed = bx.durable(s.typed())
    ranges = bx.durable(bx.keep_ranges(s.blocks, typed, s.zones, s.hot))
    facts = bx.search_facts(s.blocks.select("block", F.lit("default").alias("policy")), s.blocks, ranges)
    terms = bx.durable(bx.row_terms(facts, typed, s.zones, s.energy, hot=s.hot))
    out = bx.search_windows(facts, terms, relaxed=True)
    return out.select("block", "rank", "y0", "y1", F.round("score", 6).alias("score"), F.round("cover", 6).alias("cover"))


# the scored windows as one expression per term, straight from boxes and rows
@query("e11_score_windows", v.sql("strip_rows", f"""WITH {ENERGY},
  bl AS (SELECT strip AS block, max(y) + 1 AS height FROM strip_rows GROUP BY strip),
  b AS (SELECT strip AS block, y AS y0, y + 4 AS y1, px[2] % 6 AS k FROM strip_rows WHERE y % 7 = 0),
  h AS (SELECT block, unnest(list_distinct(list_concat(range(least(30, height), least(72, height) + 1, 4), [CAST(least(72, height) AS BIGINT)]))) AS h, height FROM bl),
  w AS (SELECT block, height, y0, y0 + h AS y1 FROM (SELECT block, height, h, unnest(list_distinct(list_concat(range(0, height - h + 1, 4), [height - h]))) AS y0 FROM h)),
  c AS (SELECT w.block, w.y0, w.y1, any_value(height) AS height,
     count(*) FILTER (k = 1 AND false) AS none_, coalesce(sum(CASE WHEN k IN (2, 5) THEN CAST(b.y0 < w.y0 AND w.y0 < b.y1 AS INT) + CAST(b.y0 < w.y1 AND w.y1 < b.y1 AS INT) END), 0) AS bc,
     coalesce(sum(CASE WHEN k IN (3, 4) THEN CAST(b.y0 < w.y0 AND w.y0 < b.y1 AS INT) + CAST(b.y0 < w.y1 AND w.y1 < b.y1 AS INT) END), 0) AS sc,
     coalesce(sum(CASE WHEN k = 0 THEN CAST(b.y0 < w.y0 AND w.y0 < b.y1 AS INT) + CAST(b.y0 < w.y1 AND w.y1 < b.y1 AS INT) END), 0) AS hc,
     coalesce(sum(CASE WHEN k = 1 THEN (least(greatest(w.y0 - b.y0, 0), 4) + least(greatest(b.y1 - w.y1, 0), 4)) / 4.0 END), 0) AS pc
     FROM w LEFT JOIN b ON b.block = w.block GROUP BY w.block, w.y0, w.y1),
  s AS (SELECT c.*, coalesce(CASE WHEN c.y0 > 0 THEN u.e END, 0) + coalesce(CASE WHEN c.y1 < c.height THEN l.e END, 0) AS energy FROM c
     LEFT JOIN en u ON u.block = c.block AND u.y = c.y0 LEFT JOIN en l ON l.block = c.block AND l.y = c.y1)
  SELECT CAST(block AS BIGINT) AS block, y0, y1, CAST(bc AS BIGINT) AS bubble_cuts, CAST(hc AS BIGINT) AS head_cuts, CAST(sc AS BIGINT) AS sfx_cuts,
    round(1 - 0.35 * (y1 - y0) / height - 0.15 * energy - 1.5 * greatest(0.0, greatest(40 / 1.05 - (y1 - y0), (y1 - y0) - 40 / 0.62)) / 40 - 0.3 * abs(40.0 / (y1 - y0) - 2 / 3) - 0.5 * sc - 0.3 * pc - bc - 3 * hc, 6) AS score FROM s"""))
def e11b(spark, d):
    """Scores without zones, so the SQL stays one term per line."""
    s = Strips(spark, d)
    none = s.zones.filter("false")
    typed = bx.durable(bx.classify_constraints(s.blocks, s.boxes, none))
    # without padding the heads stay raw in this form
    typed = typed.withColumns({"y0": F.col("raw0"), "y1": F.col("raw1")})
    ranges = bx.durable(bx.keep_ranges(s.blocks, typed, none, s.hot))
    facts = bx.search_facts(s.blocks.select("block", F.lit("default").alias("policy")), s.blocks, ranges)
    terms = bx.durable(bx.row_terms(facts, typed, none, s.energy, hot=s.hot))
    out = bx.score_windows(bx.coarse_windows(facts, terms).select("block", "policy", "y0", "y1"), facts, terms)
    return out.select("block", "y0", "y1", *[F.col(c).cast("long").alias(c) for c in ("bubble_cuts", "head_cuts", "sfx_cuts")], F.round("score", 6).alias("score"))


# cheapest chains of crops ``chain`` (block, y0, y1) over the blocks ``big`` (block, height, width, k0, k1): the reached ends of a block in one list, row after row
CHAINS = f"""deep AS (SELECT *, CAST(ceil(width / 1.35) AS BIGINT) AS lo, CAST(floor(width / 0.55) AS BIGINT) AS hi FROM big WHERE k1 - k0 >= 2 * ceil(width / 1.35)),
  firm AS (SELECT block, y0, y1 FROM tb WHERE role <> 'sfx' UNION ALL SELECT block, y0, y1 FROM zz WHERE list = 'keep' AND priority <= 1),
  cand AS (SELECT *, false AS fin FROM (SELECT *, unnest(range(k0 + lo, k1 - lo + 1, 4)) AS y FROM deep) d WHERE NOT EXISTS (SELECT 1 FROM firm WHERE firm.block = d.block AND firm.y0 < d.y AND d.y < firm.y1) UNION ALL SELECT *, true FROM (SELECT *, unnest([k0, k1]) AS y FROM deep)),
  toll AS (SELECT c.*, CASE WHEN fin THEN 0.0 ELSE 0.15 * coalesce(en.e, 0) + 0.5 * (SELECT count(*) FROM tb WHERE tb.block = c.block AND role = 'sfx' AND tb.y0 < c.y AND c.y < tb.y1) END AS price, row_number() OVER (PARTITION BY c.block ORDER BY c.y) AS n
    FROM cand c LEFT JOIN en ON en.block = c.block AND en.y = least(c.y, c.height - 1)),
  trek AS (SELECT block, n, [{{'y': y, 't': CAST(0 AS DOUBLE), 'b': CAST(-1 AS BIGINT)}}] AS l FROM toll WHERE n = 1
    UNION ALL SELECT block, n, CASE WHEN best IS NULL THEN l ELSE list_append(l, {{'y': y, 't': best.t + price, 'b': best.y}}) END FROM (
      SELECT toll.*, trek.l, list_min(list_transform(list_filter(trek.l, lambda q: toll.y - q.y BETWEEN lo AND hi), lambda q: {{'t': q.t + greatest(0.0, greatest(width / 1.05 - (toll.y - q.y), (toll.y - q.y) - width / 0.62)) * 1.5 / width + 0.3 * abs(CAST(width AS DOUBLE) / (toll.y - q.y) - 2 / 3) + 0.1, 'y': q.y}})) AS best
      FROM trek JOIN toll ON toll.block = trek.block AND toll.n = trek.n + 1)),
  legs AS (SELECT block, unnest(arg_max(l, n)) AS q FROM trek GROUP BY block),
  chain AS (SELECT legs.block, q.b AS y0, q.y AS y1 FROM legs JOIN deep ON deep.block = legs.block AND q.y = k1 WHERE q.b >= 0
    UNION ALL SELECT legs.block, q.b, q.y FROM chain JOIN legs ON legs.block = chain.block AND q.y = chain.y0 WHERE q.b >= 0)"""
QUIET = f"CASE WHEN y % 21 = 0 THEN {KIND} ELSE 'person' END"


@query("e12_split_tall", v.sql("strip_rows", f"""WITH {ENERGY}, {STRIPS.format(width=12, kind=QUIET, priority='2')}, {CONSTRAINTS}, big AS (SELECT bl.*, k0, k1 FROM bl JOIN rg ON rg.block = bl.block AND policy = 'default'), {CHAINS}
  SELECT CAST(block AS BIGINT) AS block, y0, y1 FROM chain""", recursive=True))
def e12(spark, d):
    s = Strips(spark, d, width=12)
    quiet = s.boxes.withColumn("kind", F.when(F.col("idx") % 21 == 0, F.col("kind")).otherwise("person"))
    zones = s.zones.withColumn("priority", F.lit(2))
    typed = bx.durable(bx.classify_constraints(s.blocks, quiet, zones))
    ranges = bx.durable(bx.keep_ranges(s.blocks, typed, zones, s.hot))
    return bx.split_tall(s.blocks, ranges, typed, zones, s.energy, hot=s.hot)


def _union(a: str, b: str) -> str:
    """Shared part of two row spans, of what both cover."""
    return f"(greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)) / CAST(greatest({a}.y1, {b}.y1) - least({a}.y0, {b}.y0) AS DOUBLE))"


@query("e13_plan_blocks", v.sql("strip_rows", f"""WITH {ENERGY}, every AS (SELECT strip AS block, max(y) + 1 AS height, 40 AS width, ['key', 'insert', 'text_only', 'transition'][strip % 4 + 1] AS part FROM strip_rows GROUP BY strip),
  {STRIPS.format(width=40, kind=KIND, priority='px[3] % 3 + 1').replace("bl AS (SELECT strip AS block, max(y) + 1 AS height, 40 AS width FROM strip_rows GROUP BY strip)", "bl AS (SELECT block, height, width FROM every WHERE part <> 'text_only' AND (part <> 'transition' OR block IN (SELECT strip FROM strip_rows WHERE y % 25 = 5)))")},
  {CONSTRAINTS}, big AS (SELECT bl.*, k0, k1 FROM bl JOIN rg ON rg.block = bl.block AND policy = 'default' WHERE k1 - k0 > floor(width / 0.55) AND height > floor(width / 0.55)), {CHAINS},
  lone AS (SELECT * FROM bl WHERE block NOT IN (SELECT block FROM big)), strife AS (SELECT block FROM rg WHERE policy = 'default' AND conflicts > 0),
  fc AS (SELECT lone.*, want.policy, rg.k0, rg.k1 FROM (SELECT block, 'default' AS policy FROM lone UNION ALL SELECT block, policy FROM rg WHERE policy IN ('keep_text', 'cut_subject') AND block IN (SELECT block FROM strife) UNION ALL SELECT block, policy FROM rg WHERE policy = 'sfx_whole') want
    JOIN lone USING (block) LEFT JOIN rg ON rg.block = want.block AND rg.policy = want.policy),
  {SCORES}, {_picked("strict OR (policy = 'default' AND NOT anys)")},
  sliced AS (SELECT block FROM picked WHERE policy = 'default' AND rank = 0 AND sc > 0),
  offers AS (SELECT block, y0, y1, CASE WHEN rank = 0 THEN 0 ELSE rank + 10 END AS o, loose FROM picked WHERE policy = 'default' UNION ALL SELECT block, 0, height, 0, true FROM lone WHERE block NOT IN (SELECT block FROM picked WHERE policy = 'default')
    UNION ALL SELECT block, y0, y1, CASE policy WHEN 'keep_text' THEN 1 WHEN 'cut_subject' THEN 2 ELSE 3 END, false FROM picked WHERE rank = 0 AND (policy IN ('keep_text', 'cut_subject') OR (policy = 'sfx_whole' AND block IN (SELECT block FROM sliced)))),
  kept AS (SELECT block, bool_or(loose AND o = 0) AS relaxed, list_reduce(list({{'y0': CAST(y0 AS BIGINT), 'y1': CAST(y1 AS BIGINT)}} ORDER BY o, y0, y1), lambda acc, x: CASE WHEN len(acc) < 3 AND len(list_filter(acc, lambda k: {_union('k', 'x')} >= 0.9)) = 0 THEN list_append(acc, x) ELSE acc END, CAST([] AS STRUCT(y0 BIGINT, y1 BIGINT)[])) AS c FROM offers GROUP BY block),
  flagged AS (SELECT block, block IN (SELECT block FROM strife UNION SELECT block FROM sliced) AS conflict FROM every),
  judged AS (SELECT kept.*, conflict, len(c) >= 2 AND (conflict OR {_union('c[1]', 'c[2]')} < 0.8) AS judge FROM kept JOIN flagged USING (block)),
  shots AS (SELECT block, c[CASE WHEN judge AND block % 2 = 0 AND len(c) >= 2 THEN 2 ELSE 1 END] AS w, 'single' AS mode, conflict, relaxed, judge FROM judged)
  SELECT CAST(block AS BIGINT) AS block, CAST(y0 AS BIGINT) AS y0, CAST(y1 AS BIGINT) AS y1, mode, conflict, relaxed, coalesce(judge, false) AS judge FROM (
    SELECT block, w.y0 AS y0, w.y1 AS y1, mode, conflict, relaxed, judge FROM shots
    UNION ALL SELECT block, 0, height, 'none', conflict, false, false FROM every JOIN flagged USING (block) WHERE block NOT IN (SELECT block FROM bl)
    UNION ALL SELECT block, y0, y1, 'multi', conflict, false, false FROM chain JOIN flagged USING (block)
    UNION ALL SELECT block, k0, k1, 'pan', conflict, false, false FROM big JOIN flagged USING (block) WHERE block NOT IN (SELECT block FROM chain))""", recursive=True))
def e13(spark, d):
    s = Strips(spark, d)
    role = F.element_at(F.array(F.lit("key"), F.lit("insert"), F.lit("text_only"), F.lit("transition")), (F.col("block") % 4 + 1).cast("int"))
    verdicts = s.blocks.select("block", F.lit(2).alias("best"), (F.col("block") % 2 == 0).alias("confident"))
    return bx.plan_blocks(s.blocks.withColumn("role", role), s.boxes, s.zones, s.energy, verdicts, hot=s.hot)


@query("e14_window_report", v.sql("boxes", f"""WITH b AS (SELECT block, y0, y1, kind, idx % 2 = 0 AS told FROM boxes), w AS (SELECT DISTINCT block, i AS win, 100 * i + 50 AS y0, 100 * i + 350 AS y1 FROM boxes, (SELECT unnest([0, 1, 2]) AS i)),
  m AS (SELECT w.block, win, kind, told, (b.y0 < w.y0 AND w.y0 < b.y1) OR (b.y0 < w.y1 AND w.y1 < b.y1) AS cut, least(b.y1, w.y1) - greatest(b.y0, w.y0) >= 0.5 * greatest(1, b.y1 - b.y0) AS mostly FROM w LEFT JOIN b USING (block)),
  p AS (SELECT block, win, count(*) FILTER (cut AND kind = 'head') AS head_cuts, count(*) FILTER (cut AND kind IN ('bubble', 'narration')) AS bubble_cuts,
    count(*) FILTER (mostly AND (kind = 'narration' OR (kind = 'bubble' AND told))) AS narration_included, count(*) FILTER (cut AND kind IN ('sfx', 'free_text')) AS sfx_cuts FROM m GROUP BY block, win),
  f AS (SELECT p.*, w.y0, w.y1, greatest(120, w.y0) AS a, least(420, w.y1) AS b FROM p JOIN w USING (block, win))
  SELECT block, win, head_cuts, bubble_cuts, narration_included, sfx_cuts, CASE WHEN b > a THEN round(abs((a + b) / 2.0 - (y0 + y1) / 2.0) / (y1 - y0), 4) ELSE 0.0 END AS offcenter, round(800.0 / (y1 - y0), 4) AS ratio FROM f"""))
def e14(spark, d):
    b = v.boxes(spark, d)
    ids = b.select("block").distinct()
    win = ids.withColumn("win", F.explode(F.array(*[F.lit(i) for i in range(3)]))).select("block", "win", (100 * F.col("win") + 50).alias("y0"), (100 * F.col("win") + 350).alias("y1"))
    role = F.when(F.col("kind") == "bubble", "attached").when(F.col("kind") == "free_text", "sfx").otherwise(F.col("kind"))
    typed = b.select("block", "y0", "y1", role.alias("role"), (F.col("idx") % 2 == 0).alias("told"))
    facts = ids.select("block", F.lit(800).alias("width"), F.lit(120).alias("k0"), F.lit(420).alias("k1"))
    return bx.window_report(win, typed, facts)


MATCH = """r AS (SELECT ch AS "case", idx AS ref, y_start + 300 AS y0, y_start + height + 300 AS y1 FROM panels), bl AS (SELECT ch AS "case", idx AS block, y_start AS y0, y_start + height AS y1 FROM panels),
  sh AS (SELECT "case", block, s AS shot, y0 + s * ((y1 - y0) // 2) AS y0, y0 + (s + 1) * ((y1 - y0) // 2) AS y1 FROM bl, (SELECT unnest([0, 1]) AS s)),
  o AS (SELECT r.*, block, least(r.y1, bl.y1) - greatest(r.y0, bl.y0) AS ov FROM r JOIN bl USING ("case")),
  hm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "case", ref ORDER BY ov DESC, block) AS rn FROM o WHERE ov > 0) WHERE rn = 1),
  sc AS (SELECT hm."case", ref, hm.block, shot, greatest(0, least(hm.y1, sh.y1) - greatest(hm.y0, sh.y0)) / CAST(greatest(hm.y1, sh.y1) - least(hm.y0, sh.y0) AS DOUBLE) AS iou FROM hm JOIN sh ON sh."case" = hm."case" AND sh.block = hm.block),
  bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "case", ref ORDER BY iou DESC, shot) AS rn FROM sc) WHERE rn = 1),
  ev AS (SELECT r."case", r.ref, coalesce(block, -1) AS block, coalesce(shot, -1) AS shot, round(coalesce(iou, 0), 4) AS iou FROM r LEFT JOIN bs ON bs."case" = r."case" AND bs.ref = r.ref)"""


def _cases(spark, d):
    p = bx.durable(v.panels(spark, d).select("ch", "idx", "y_start", "height"))
    refs = p.select(F.col("ch").alias("case"), F.col("idx").alias("ref"), (F.col("y_start") + 300).alias("y0"), (F.col("y_start") + F.col("height") + 300).alias("y1"))
    blocks = p.select(F.col("ch").alias("case"), F.col("idx").alias("block"), F.col("y_start").alias("y0"), (F.col("y_start") + F.col("height")).alias("y1"))
    half = F.floor((F.col("y1") - F.col("y0")) / 2)
    shots = blocks.withColumn("shot", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "case", "block", "shot", (F.col("y0") + F.col("shot") * half).alias("_a"), (F.col("y0") + (F.col("shot") + 1) * half).alias("_b")).withColumnsRenamed({"_a": "y0", "_b": "y1"})
    return refs, shots, blocks


def _matched(refs, shots, blocks):
    out = bx.match_references(refs, shots, blocks)
    return out.withColumns({"block": F.coalesce("block", F.lit(-1)), "shot": F.coalesce("shot", F.lit(-1))})


@query("e15_match_references", v.sql("panels", f'WITH {MATCH} SELECT "case", ref, block, shot, iou FROM ev'))
def e15(spark, d):
    return _matched(*_cases(spark, d))


@query("e16_evaluation_summary", v.sql("panels", f"""WITH {MATCH}, x AS (SELECT "case", iou, ref % 3 AS hc, ref % 2 AS bc, ref % 5 AS nc, ref % 4 AS sc, iou / 2 AS off FROM ev), y AS (SELECT "case", shot + block % 2 AS hc, block % 3 AS bc, shot AS nc, 1 AS sc, (block % 10) / 20.0 AS off FROM sh),
  k AS (SELECT grouping("case") = 1 AS g, coalesce(CAST("case" AS VARCHAR), '') AS name, count(*) AS calls, CAST(sum(height) AS DOUBLE) * 0.125 AS cost FROM (SELECT ch AS "case", height FROM panels) GROUP BY GROUPING SETS (("case"), ())),
  z AS (SELECT grouping("case") = 1 AS g, coalesce(CAST("case" AS VARCHAR), '') AS name, count(*) AS shots, CAST(sum(hc) AS BIGINT) AS hc, CAST(sum(bc) AS BIGINT) AS bc, CAST(sum(nc) AS BIGINT) AS nc, CAST(sum(sc) AS BIGINT) AS sc, count(*) FILTER (off > 0.25) AS oc FROM y GROUP BY GROUPING SETS (("case"), ()))
  SELECT r.g AS total, r.name, n, round(m, 9) AS iou_mean, round(lo, 9) AS iou_min, round(md, 9) AS iou_median, round(sh, 9) AS share_iou, r.hc AS head_cuts, r.bc AS bubble_cuts, r.nc AS narration_included, r.sc AS sfx_cuts, r.oc AS offcenter,
    shots, z.hc AS shot_head_cuts, z.bc AS shot_bubble_cuts, z.nc AS shot_narration_included, z.sc AS shot_sfx_cuts, z.oc AS shot_offcenter, calls, cost FROM (
   SELECT grouping("case") = 1 AS g, coalesce(CAST("case" AS VARCHAR), '') AS name, count(*) AS n, avg(iou) AS m, min(iou) AS lo, median(iou) AS md, CAST(count(*) FILTER (iou >= 0.7) AS DOUBLE) / count(*) AS sh,
     CAST(sum(hc) AS BIGINT) AS hc, CAST(sum(bc) AS BIGINT) AS bc, CAST(sum(nc) AS BIGINT) AS nc, CAST(sum(sc) AS BIGINT) AS sc, count(*) FILTER (off > 0.25) AS oc FROM x GROUP BY GROUPING SETS (("case"), ())) r JOIN z ON z.g = r.g AND z.name = r.name JOIN k ON k.g = r.g AND k.name = r.name"""))
def e16(spark, d):
    def part(column: str, n: int, name: str):
        return (F.col(column) % n).alias(name)

    refs, shots, blocks = _cases(spark, d)
    e = _matched(refs, shots, blocks).select("case", "iou", part("ref", 3, "head_cuts"), part("ref", 2, "bubble_cuts"), part("ref", 5, "narration_included"), part("ref", 4, "sfx_cuts"), (F.col("iou") / 2).alias("offcenter"))
    s = shots.select("case", (F.col("shot") + F.col("block") % 2).alias("head_cuts"), part("block", 3, "bubble_cuts"), F.col("shot").alias("narration_included"), F.lit(1).alias("sfx_cuts"), ((F.col("block") % 10) / 20).alias("offcenter"))
    runs = refs.select("case", F.lit(1).alias("calls"), ((F.col("y1") - F.col("y0")) * 0.125).alias("cost"))
    return bx.evaluation_summary(e, v.hot_chapters(spark, d), s, runs).withColumns({c: F.round(c, 9) for c in ("iou_mean", "iou_min", "iou_median", "share_iou")})


@query("e17_extract_figures")
def e17(spark, d):
    b = v.boxes(spark, d)
    blocks = b.select("block").distinct().select("block", F.lit(920).alias("height"), F.lit(800).alias("width"))
    return bx.extract_figures(b, blocks, 0.05, whole_bubbles=True, hot=hot_blocks(spark, d))


@query("e17_group_figures")
def e17b(spark, d):
    b = bx.durable(v.boxes(spark, d))
    blocks = b.select("block").distinct().select("block", F.lit(920).alias("height"), F.lit(800).alias("width"))
    hot = hot_blocks(spark, d)
    figures = bx.extract_figures(b, blocks, require_head=False, hot=hot)
    return bx.group_figures(figures, b.filter("kind = 'head'"), hot=hot)


@query("e18_overlap_assign", v.sql("panels", """WITH i AS (SELECT ch, idx AS item, y_start + 170 AS y0, y_start + height + 170 AS y1 FROM panels), s AS (SELECT ch, idx AS span, y_start AS y0, y_start + height AS y1 FROM panels),
  o AS (SELECT i.ch, item, span, least(i.y1, s.y1) - greatest(i.y0, s.y0) AS ov, i.y1 - i.y0 AS h FROM i JOIN s ON s.ch = i.ch),
  k AS (SELECT *, ov >= 0.3 * h AS ok, bool_or(ov >= 0.3 * h) OVER (PARTITION BY ch, item) AS any_ok, row_number() OVER (PARTITION BY ch, item ORDER BY ov DESC, span DESC) AS rn FROM o WHERE ov > 0)
  SELECT ch, item, span FROM k WHERE ok OR (NOT any_ok AND rn = 1)"""))
def e18(spark, d):
    p = v.panels(spark, d)
    items = p.select("ch", F.col("idx").alias("item"), (F.col("y_start") + 170).alias("y0"), (F.col("y_start") + F.col("height") + 170).alias("y1"))
    spans = p.select("ch", F.col("idx").alias("span"), F.col("y_start").alias("y0"), (F.col("y_start") + F.col("height")).alias("y1"))
    return bx.overlap_assign(items, spans)


@query("e19_remap_ids", v.sql("scene_panels", """WITH ids AS (SELECT ch, scene, panel % 3 AS pos, panel AS id, heavy FROM scene_panels),
  br AS (SELECT ch, panel AS id, panel * 2 + k AS item, panel * 2 + k AS ord FROM scene_panels, (SELECT unnest([0, 1]) AS k) WHERE (panel // 3) % 2 = 0 AND (k = 0 OR panel % 2 = 1)),
  m AS (SELECT ids.ch, scene, item, min(pos * 1000000 + ord) AS att, bool_or(heavy) AS heavy FROM ids JOIN br ON br.ch = ids.ch AND br.id = ids.id GROUP BY ids.ch, scene, item),
  lost AS (SELECT ch, scene, id FROM ids WHERE (ch, scene) NOT IN (SELECT ch, scene FROM m)),
  n AS (SELECT lost.ch, scene, item, row_number() OVER (PARTITION BY lost.ch, scene ORDER BY abs(lost.id - br.id), item) AS rn FROM lost JOIN br ON br.ch = lost.ch)
  SELECT ch, scene, item, CAST(att // 1000000 AS BIGINT) AS pos, CAST(att % 1000000 AS BIGINT) AS "order", heavy FROM m UNION ALL SELECT ch, scene, item, 0, 0, false FROM n WHERE rn = 1"""))
def e19(spark, d):
    p = bx.durable(v.scene_panels(spark, d).select("ch", "scene", "panel", "heavy"))
    ids = p.select("ch", "scene", (F.col("panel") % 3).alias("pos"), F.col("panel").alias("id"), "heavy")
    br = p.filter("panel div 3 % 2 = 0").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).filter("k = 0 or panel % 2 = 1").select(
        "ch", F.col("panel").alias("id"), (F.col("panel") * 2 + F.col("k")).alias("item"), (F.col("panel") * 2 + F.col("k")).alias("order"))
    return bx.remap_ids(ids, br, br, v.hot_chapters(spark, d))
