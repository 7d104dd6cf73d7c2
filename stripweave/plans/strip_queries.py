"""Registered queries on strips and panels, with their SQL texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stripweave.operators import layout, strips
from stripweave.plans import views as v
from stripweave.session import durable

QUERIES, SQL = {}, {}


def query(name: str, text: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if text is not None:
            SQL[name] = text
        return fn
    return add


def r6(*names):
    return {n: F.round(n, 6) for n in names}


@query("d1_row_variance", v.sql("strip_rows", "SELECT strip, y, round(list_aggregate(px, 'var_pop'), 6) AS variance FROM strip_rows"))
def d1(spark, d):
    return strips.row_variance(v.strip_rows(spark, d)).withColumns(r6("variance"))


CHANGE = """ch AS (SELECT strip, y, CASE WHEN up IS NULL THEN 0.0 ELSE CAST(len(list_filter(list_zip(px, up), lambda t: abs(t[1] - t[2]) > 24)) AS DOUBLE) / len(px) END AS change
  FROM (SELECT *, lag(px) OVER (PARTITION BY strip ORDER BY y) AS up FROM strip_rows))"""


@query("d2_row_change", v.sql("strip_rows", f"WITH {CHANGE} SELECT strip, y, round(change, 6) AS change FROM ch"))
def d2(spark, d):
    return strips.row_change(v.strip_rows(spark, d), hot=v.hot_strips(spark, d)).withColumns(r6("change"))


RUNS = """var AS (SELECT strip, y, list_aggregate(px, 'var_pop') AS variance FROM strip_rows),
  mark AS (SELECT *, y - row_number() OVER (PARTITION BY strip ORDER BY y) AS g FROM var WHERE variance < 249.6),
  runs AS (SELECT strip, min(y) AS "start", max(y) + 1 AS "end" FROM mark GROUP BY strip, g),
  ext AS (SELECT strip, max(y) + 1 AS height FROM strip_rows GROUP BY strip)"""


def _variance(spark, d):
    return strips.row_variance(v.strip_rows(spark, d))


@query("d3_find_runs", v.sql("strip_rows", f'WITH {RUNS} SELECT strip, "start", "end" FROM runs WHERE "end" - "start" >= 2'))
def d3(spark, d):
    return strips.find_runs(_variance(spark, d), F.col("variance") < 249.6, 2, v.hot_strips(spark, d))


GAPS = """seg AS (SELECT strip, coalesce(lag("end") OVER (PARTITION BY strip ORDER BY "start"), 0) AS "start", "start" AS "end"
    FROM (SELECT strip, "start", "end" FROM runs UNION ALL SELECT strip, height, height FROM ext)),
  gaps AS (SELECT * FROM seg WHERE "end" > "start")"""


@query("d4_complement_intervals", v.sql("strip_rows", f'WITH {RUNS}, {GAPS} SELECT strip, "start", "end" FROM gaps'))
def d4(spark, d):
    rows = v.strip_rows(spark, d)
    hot = v.hot_strips(spark, d)
    return strips.complement_intervals(strips.find_runs(strips.row_variance(rows), F.col("variance") < 249.6, 1, hot), strips.extents(rows), hot)


def _chunks(spark, d):
    """Panels with gaps between them, as segments of a strip."""
    p = v.panels(spark, d)
    return p.select(F.col("ch").alias("strip"), (F.col("y_start") + 30 * F.col("idx")).alias("start"),
                    (F.col("y_start") + 30 * F.col("idx") + F.col("height")).alias("end"))


SEGMENTS = 'sg AS (SELECT ch AS strip, y_start + 30 * idx AS "start", y_start + 30 * idx + height AS "end" FROM panels)'
MERGE = """near AS (SELECT *, "end" - "start" < {low} AS low, lag("end") OVER w AS pend, lag("end" - "start") OVER w < {low} AS plow FROM {src} WINDOW w AS (PARTITION BY strip ORDER BY "start")),
  grp AS (SELECT *, sum(CASE WHEN low AND plow AND "start" - pend <= {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY strip ORDER BY "start") AS g FROM near),
  merged AS (SELECT strip, min("start") AS "start", max("end") AS "end" FROM grp GROUP BY strip, g)"""


@query("d5_merge_small", v.sql("panels", f"WITH {SEGMENTS}, {MERGE.format(low=900, gap=150, src='sg')} SELECT strip, \"start\", \"end\" FROM merged"))
def d5(spark, d):
    return strips.merge_small(_chunks(spark, d), 900, 150, v.hot_chapters(spark, d))


SLICE = """padded AS (SELECT strip, greatest(0, "start" - {pad}) AS y_start, least(height, "end" + {pad}) AS y_end FROM {src} JOIN ext USING (strip)),
  out AS (SELECT strip, row_number() OVER (PARTITION BY strip ORDER BY y_start) - 1 AS idx, y_start, y_end, y_end - y_start AS height,
    CASE WHEN y_end - y_start > {giant} THEN 'scroll_vertical' ELSE 'static' END AS "type" FROM padded WHERE y_end - y_start >= {low})"""
OUT = "SELECT CAST(strip AS BIGINT) AS strip, idx, y_start, y_end, height, \"type\" FROM out"


@query("d6_slice_panels", v.sql("panels", f"""WITH {SEGMENTS}, ext AS (SELECT strip, max("end") + 10 AS height FROM sg GROUP BY strip),
  {SLICE.format(pad=15, src='sg', giant=1500, low=400)} {OUT}"""))
def d6(spark, d):
    seg = _chunks(spark, d)
    extent = seg.groupBy("strip").agg((F.max("end") + 10).alias("height"))
    return strips.slice_panels(seg, extent, 15, 400, 1500, hot=v.hot_chapters(spark, d)).drop("part", "source_index")


@query("d0_strip_to_panels", v.sql("strip_rows", f"WITH {RUNS}, {GAPS}, {MERGE.format(low=4, gap=2, src='gaps')}, {SLICE.format(pad=1, src='merged', giant=8, low=3)} {OUT}"))
def strip_to_panels(spark, d):
    """Pixel rows in, panel table out: the whole slicing chain."""
    rows = v.strip_rows(spark, d)
    out = strips.panels_of_strips(rows, 249.6, 1, 4, 2, 1, 3, 8, v.hot_strips(spark, d))
    return out.drop("part", "source_index").withColumn("strip", F.col("strip").cast("long"))


@query("d7_find_borders", v.sql("strip_rows", f"""WITH {CHANGE}, sg AS (SELECT strip, y AS y_start, y + 40 AS y_end FROM strip_rows WHERE y % 40 = 0),
  hits AS (SELECT sg.*, y, change FROM ch JOIN sg USING (strip) WHERE y > y_start AND y < y_end AND change >= 0.3),
  near AS (SELECT *, y - lag(y) OVER (PARTITION BY strip, y_start ORDER BY y) AS gap FROM hits),
  grp AS (SELECT *, sum(CASE WHEN gap <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY strip, y_start ORDER BY y) AS g FROM near),
  best AS (SELECT *, row_number() OVER (PARTITION BY strip, y_start, g ORDER BY change DESC, y) AS rn FROM grp)
  SELECT strip, y_start, y_end, y AS "row", CAST(CASE WHEN change >= 0.7 THEN 1.0 WHEN change >= 0.6 THEN 0.75 ELSE 0.5 END AS DOUBLE) AS strength FROM best WHERE rn = 1"""))
def d7(spark, d):
    rows = v.strip_rows(spark, d)
    hot = v.hot_strips(spark, d)
    seg = rows.filter("y % 40 = 0").select("strip", F.col("y").alias("y_start"), (F.col("y") + 40).alias("y_end"))
    return strips.find_borders(strips.row_change(rows, hot=hot), seg, 0.3, 2, 64, hot)


@query("d8_split_to_frame")
def d8(spark, d):
    p = v.panels(spark, d)
    seg = durable(p.select(F.col("ch").alias("strip"), F.col("idx").alias("segment"), "y_start", (F.col("y_start") + F.col("height")).alias("y_end")))
    near = seg.withColumn("row", F.explode(F.array(F.col("y_start") + 333, F.col("y_start") + 700, F.col("y_start") + 1111)))
    borders = near.filter("row < y_end").select("strip", "y_start", "y_end", "row", F.lit(0.75).alias("strength"))
    return strips.split_to_frame(seg, borders, 800)


def _means(spark, d):
    rows = v.strip_rows(spark, d)
    def channel(c):
        return F.filter("px", lambda x, i: i % 3 == c)

    tri = [channel(c) for c in range(3)]
    mean = [strips._mean(F.transform(t, lambda x: x.cast("double"))) for t in tri]
    return rows.select("strip", *[m.alias(c) for m, c in zip(mean, "rgb")], F.lit(1.0).alias("std"))


LEVEL = "least(255, greatest(0, CAST(round_even(list_avg(list_filter(px, lambda x, i: i % 3 = {}) ) / 16, 0) * 16 AS INT))) AS {}"


@query("d9_background_palette", v.sql("strip_rows", f"""WITH m AS (SELECT strip, {LEVEL.format(1, 'r')}, {LEVEL.format(2, 'g')}, {LEVEL.format(0, 'b')} FROM strip_rows),
  c AS (SELECT *, sum(n) OVER (PARTITION BY strip) AS every FROM (SELECT strip, r, g, b, count(*) AS n FROM m GROUP BY ALL)),
  l AS (SELECT strip, list({{'r': r, 'g': g, 'b': b}} ORDER BY n DESC, r, g, b) FILTER (n >= greatest(2, every * 0.02)) AS l FROM c GROUP BY strip),
  k AS (SELECT strip, list_reduce(coalesce(l, []), lambda acc, x: CASE WHEN len(list_filter(acc, lambda q: greatest(abs(q.r - x.r), abs(q.g - x.g), abs(q.b - x.b)) <= 24)) > 0 THEN acc ELSE list_append(acc, x) END,
    [CAST({{'r': 255, 'g': 255, 'b': 255}} AS STRUCT(r INT, g INT, b INT)), CAST({{'r': 0, 'g': 0, 'b': 0}} AS STRUCT(r INT, g INT, b INT))]) AS k FROM l)
  SELECT strip, CAST(pos - 1 AS INT) AS pos, q.r AS r, q.g AS g, q.b AS b FROM (SELECT strip, unnest(k) AS q, generate_subscripts(k, 1) AS pos FROM k)"""))
def d9(spark, d):
    return strips.background_palette(_means(spark, d), min_count=2, min_share=0.02)


def _bg() -> str:
    dev = "list_transform(px, lambda x: CAST(abs(x - {}) AS DOUBLE))"
    one, two = dev.format(255), dev.format(0)
    mid = dev.format(128)
    return f"""bg AS (SELECT strip, y, greatest(0.0, least(1.0, 1 - least(list_aggregate({one}, 'quantile_cont', 0.99), list_aggregate({two}, 'quantile_cont', 0.99), list_aggregate({mid}, 'quantile_cont', 0.99), 255) / 48.0)) AS score,
      least(list_max({one}), list_max({two}), list_max({mid}), 255) > 40 AS ink FROM strip_rows)"""


@query("d10_row_background", v.sql("strip_rows", f"WITH {_bg()} SELECT strip, y, round(score, 6) AS score, ink FROM bg"))
def d10(spark, d):
    return strips.row_background_score(v.strip_rows(spark, d), (255, 0, 128), ink=40).withColumns(r6("score"))


COLOURS = """co AS (SELECT strip, y, px AS r, list_transform(px, lambda x: 255 - x) AS g, list_transform(px, lambda x: x // 2) AS b FROM strip_rows),
  pa AS (SELECT DISTINCT strip, unnest([{'r': 255, 'g': 255, 'b': 255}, {'r': 0, 'g': 0, 'b': 0}, {'r': 100 + strip % 90, 'g': 120, 'b': 64}]) AS k FROM strip_rows),
  de AS (SELECT strip, y, list_transform(range(1, len(r) + 1), lambda i: CAST(greatest(abs(r[i] - k.r), abs(g[i] - k.g), abs(b[i] - k.b)) AS DOUBLE)) AS d FROM co JOIN pa USING (strip))"""


@query("d10_strip_background", v.sql("strip_rows", f"""WITH {COLOURS}, ne AS (SELECT strip, y, least(min(list_aggregate(d, 'quantile_cont', 0.99)), 255) AS best, least(min(list_max(d)), 255) AS worst FROM de GROUP BY strip, y)
  SELECT strip, y, round(greatest(0.0, least(1.0, 1 - best / 48.0)), 6) AS score, worst > 64 AS ink FROM ne"""))
def d10b(spark, d):
    """Every strip against white, black and a colour of its own."""
    rows = v.strip_rows(spark, d)
    colour = rows.select("strip", "y", F.col("px").alias("r"), F.transform("px", lambda x: 255 - x).alias("g"), F.transform("px", lambda x: F.floor(x / 2).cast("int")).alias("b"))
    own = F.array(*[F.struct(r.cast("int").alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b")) for r, g, b in ((F.lit(255), 255, 255), (F.lit(0), 0, 0), (100 + F.col("strip") % 90, 120, 64))])
    palette = rows.select("strip").distinct().select("strip", F.explode(own).alias("k")).select("strip", "k.*")
    return strips.strip_background_score(colour, palette).withColumns(r6("score"))


def _scores(spark, d):
    """Row scores with long background stretches, from the mean of each pixel row."""
    rows = v.strip_rows(spark, d).withColumn("_s", F.aggregate("px", F.lit(0), lambda a, x: a + x))
    return rows.select("strip", "y", ((F.col("_s") % 9) / 8.0).alias("score"), (F.col("_s") % 3 == 0).alias("ink"))


def even(x: str) -> str:
    """Half-even rounding in SQL: a tie goes to the even neighbour."""
    return f"CASE WHEN ({x}) - floor({x}) = 0.5 THEN 2 * round(({x}) / 2) ELSE round({x}) END"


@query("d11_segment_blocks", v.sql("strip_rows", """WITH sc AS (SELECT strip, y, (CAST(list_sum(px) AS BIGINT) % 9) / 8.0 AS score, CAST(list_sum(px) AS BIGINT) % 3 = 0 AS ink FROM strip_rows),
  ext AS (SELECT strip, max(y) + 1 AS height FROM sc GROUP BY strip),
  mark AS (SELECT *, y - row_number() OVER (PARTITION BY strip ORDER BY y) AS g FROM sc WHERE score >= 0.5),
  gut AS (SELECT strip, min(y) AS s, max(y) + 1 AS e, sum(score) AS st, min(height) AS height FROM mark JOIN ext USING (strip) GROUP BY strip, g),
  wall AS (SELECT strip, s, e, st, (s + e) // 2 AS mid FROM gut WHERE st >= 2 OR s = 0 OR e = height UNION ALL SELECT strip, height, height, 0, height FROM ext),
  raw AS (SELECT strip, coalesce(lag(e) OVER w, 0) AS y0, s AS y1, coalesce(lag(st) OVER w, 0) AS ga, st AS gb, coalesce(lag(mid) OVER w, 0) AS lo, mid AS hi FROM wall WINDOW w AS (PARTITION BY strip ORDER BY s, e)),
  run AS (SELECT strip, y, coalesce(max(CASE WHEN NOT ink THEN y END) OVER (PARTITION BY strip ORDER BY y), -1) + 1 AS rs,
     coalesce(min(CASE WHEN NOT ink THEN y END) OVER (PARTITION BY strip ORDER BY y ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1000000) AS re, ink FROM sc),
  grown AS (SELECT r.strip, CASE WHEN u.ink THEN greatest(lo, u.rs) ELSE y0 END AS y0, CASE WHEN n.ink THEN least(hi, n.re) ELSE y1 END AS y1, ga, gb
     FROM raw r LEFT JOIN run u ON u.strip = r.strip AND u.y = y0 - 1 LEFT JOIN run n ON n.strip = r.strip AND n.y = y1 WHERE y1 > y0)
  SELECT strip, row_number() OVER (PARTITION BY strip ORDER BY y0) - 1 AS idx, y0, y1, GA AS gap_above, GB AS gap_below, y1 - y0 < 3 AS small FROM grown WHERE y1 - y0 >= 2""".replace("GA AS", f"({even('ga * 10')}) / 10 AS").replace("GB AS", f"({even('gb * 10')}) / 10 AS")))
def d11(spark, d):
    return strips.segment_blocks(_scores(spark, d), 575, min_gap=2, min_block=3, min_text=2, hot=v.hot_strips(spark, d)).select(
        "strip", "idx", "y0", "y1", "gap_above", "gap_below", "small")


@query("d12_cut_energy", v.sql("strip_rows", """WITH near AS (SELECT strip, y, px, lag(px) OVER w AS up, lead(px) OVER w AS down FROM strip_rows WINDOW w AS (PARTITION BY strip ORDER BY y)),
  diff AS (SELECT strip, y, CASE WHEN up IS NULL OR down IS NULL THEN list_transform(px, lambda x: 0) ELSE list_transform(list_zip(down, up), lambda t: t[1] - t[2]) END AS d FROM near),
  pad AS (SELECT strip, y, list_concat([d[2]], d, [d[len(d) - 1]]) AS d FROM diff),
  e AS (SELECT strip, y, list_avg(list_transform(range(2, len(d)), lambda i: abs(d[i - 1] + 2 * d[i] + d[i + 1]))) AS e FROM pad)
  SELECT strip, y, round(e / (max(e) OVER (PARTITION BY strip) + 1e-6), 6) AS energy FROM e"""))
def d12(spark, d):
    return strips.cut_energy(v.strip_rows(spark, d), v.hot_strips(spark, d)).withColumns(r6("energy"))


def _profile(spark, d):
    rows = v.strip_rows(spark, d)
    return rows.select("strip", F.col("y").alias("x"), F.aggregate("px", F.lit(0), lambda a, x: a + x).cast("long").alias("v"))


@query("d13_profile_windows", v.sql("strip_rows", """WITH p AS (SELECT strip, y AS x, CAST(list_sum(px) AS BIGINT) AS v FROM strip_rows),
  sc AS (SELECT strip, x AS o, sum(v) OVER (PARTITION BY strip ORDER BY x ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS s, count(*) OVER (PARTITION BY strip) - 6 AS n FROM p),
  band AS (SELECT *, CAST(ceil((o + 1) * 4.0 / n) AS BIGINT) - 1 AS b FROM sc WHERE o < n),
  best AS (SELECT *, row_number() OVER (PARTITION BY strip, b ORDER BY s DESC, o) AS rn FROM band)
  SELECT strip, CAST(row_number() OVER (PARTITION BY strip ORDER BY s DESC, b) - 1 AS INT) AS rank, o AS "offset" FROM best WHERE rn = 1"""))
def d13(spark, d):
    return strips.profile_windows(_profile(spark, d), 7, 4, v.hot_strips(spark, d))


# edges of the grey rows, summed along both axes ('c' over columns, 'r' over rows), smoothed and scaled; even strips keep 20 columns
EDGES = """near AS (SELECT strip, y, px, coalesce(lag(px) OVER w, lead(px) OVER w, px) AS up, coalesce(lead(px) OVER w, lag(px) OVER w, px) AS down FROM (SELECT strip, y, CASE WHEN strip % 2 = 0 THEN px[1:20] ELSE px END AS px FROM strip_rows) WINDOW w AS (PARTITION BY strip ORDER BY y)),
  side AS (SELECT strip, y, px, len(px) AS k, list_transform(list_zip(up, down), lambda t: t[1] + t[2]) AS t FROM near),
  edge AS (SELECT strip, y, list_transform(range(1, k + 1), lambda i: CAST(abs(2 * (t[CASE WHEN i = 1 THEN least(2, k) ELSE i - 1 END] + t[CASE WHEN i = k THEN greatest(1, k - 1) ELSE i + 1 END]) - 8 * px[i]) AS DOUBLE)) AS e FROM side),
  along AS (SELECT strip, 'r' AS axis, y AS x, list_sum(e) AS v FROM edge UNION ALL SELECT strip, 'c', x - 1, sum(v) FROM (SELECT strip, unnest(range(1, len(e) + 1)) AS x, unnest(e) AS v FROM edge) GROUP BY strip, x),
  sized AS (SELECT *, greatest(1, CAST(floor(count(*) OVER q * 0.06) AS BIGINT) | 1) AS w, count(*) OVER q AS n FROM along WINDOW q AS (PARTITION BY strip, axis)),
  mean AS (SELECT a.strip, a.axis, a.x, CASE WHEN any_value(a.n) > any_value(a.w) THEN sum(b.v) FILTER (abs(b.x - a.x) <= a.w // 2) / any_value(a.w) ELSE any_value(a.v) END AS v FROM sized a JOIN along b ON b.strip = a.strip AND b.axis = a.axis GROUP BY a.strip, a.axis, a.x),
  prof AS (SELECT strip, axis, x, CASE WHEN max(v) OVER q > 0 THEN v / max(v) OVER q ELSE v END AS v FROM mean WINDOW q AS (PARTITION BY strip, axis))"""


def _grey(spark, d):
    return v.strip_rows(spark, d).withColumn("px", F.when(F.col("strip") % 2 == 0, F.slice("px", 1, 20)).otherwise(F.col("px")))


@query("d13_edge_profile_columns", v.sql("strip_rows", f"WITH {EDGES} SELECT strip, x, round(v, 6) AS v FROM prof WHERE axis = 'c'"))
def d13b(spark, d):
    return strips.edge_profile(_grey(spark, d), 0, v.hot_strips(spark, d)).withColumns(r6("v"))


@query("d13_edge_profile_rows", v.sql("strip_rows", f"WITH {EDGES} SELECT strip, x, round(v, 6) AS v FROM prof WHERE axis = 'r'"))
def d13c(spark, d):
    return strips.edge_profile(_grey(spark, d), 1, v.hot_strips(spark, d)).withColumns(r6("v"))


WINDOW = f"""win AS (SELECT *, CASE WHEN 800.0 / height > 0.5625 THEN greatest(1, CAST({even('height * 0.5625')} AS INT)) ELSE 800 END AS ww,
    CASE WHEN 800.0 / height > 0.5625 THEN height ELSE greatest(1, CAST({even('800 / 0.5625')} AS INT)) END AS wh FROM panels)"""


@query("d14_crop_plan", v.sql("panels", f"""WITH {WINDOW},
  s AS (SELECT *, greatest(1080.0 / ww, 1920.0 / wh) AS cover, least(1080.0 / 800, 1920.0 / height) AS contain, shot FROM win, (SELECT unnest([0, 1, 2]) AS shot)),
  a AS (SELECT *, cover > 3.2 AS whole FROM s),
  b AS (SELECT ch, idx, shot, height, whole, CASE WHEN whole THEN 0 ELSE (800 - ww) // 2 END AS x, CASE WHEN whole THEN 0 ELSE (height - wh) // 2 END AS y,
    CASE WHEN whole THEN 800 ELSE ww END AS w, CASE WHEN whole THEN height ELSE wh END AS h,
    CASE WHEN whole THEN least(0.16 * shot, greatest(0.0, 3.2 / greatest(contain, 1e-6) - 1)) WHEN shot % 2 = 1 THEN least(0.16, greatest(0.0, 3.2 / cover - 1)) ELSE 0.0 END AS am FROM a),
  c AS (SELECT *, greatest(8, CAST({even('w * (1 / (1 + am))')} AS BIGINT)) AS tw, greatest(8, CAST({even('h * (1 / (1 + am))')} AS BIGINT)) AS th FROM b)
  SELECT ch, idx, shot, CAST(CASE WHEN am > 0 THEN greatest(0, least({even('x + w / 2.0 - tw / 2.0')}, 800 - tw)) ELSE x END AS BIGINT) AS x,
    CAST(CASE WHEN am > 0 THEN greatest(0, least({even('y + h / 2.0 - th / 2.0')}, height - th)) ELSE y END AS BIGINT) AS y,
    CAST(CASE WHEN am > 0 THEN tw ELSE w END AS BIGINT) AS w, CAST(CASE WHEN am > 0 THEN th ELSE h END AS BIGINT) AS h, CASE WHEN whole THEN 'contain' ELSE 'cover' END AS fit FROM c"""))
def d14(spark, d):
    return strips.crop_plan(v.panels(spark, d).select("ch", "idx", "width", "height"), 3)


# windows of the strips' own size on both profiles, best band first, and the crops they give
AIMED = f"""{EDGES}, pan AS (SELECT strip, max(y) + 1 AS height, any_value(len(e)) AS width FROM edge GROUP BY strip),
  win AS (SELECT *, CASE WHEN width / CAST(height AS DOUBLE) > 0.5625 THEN greatest(1, CAST({even('height * 0.5625')} AS BIGINT)) ELSE width END AS ww, CASE WHEN width / CAST(height AS DOUBLE) > 0.5625 THEN height ELSE greatest(1, CAST({even('width / 0.5625')} AS BIGINT)) END AS wh FROM pan),
  spot AS (SELECT prof.*, CASE axis WHEN 'c' THEN ww ELSE wh END AS size, CASE axis WHEN 'c' THEN width - ww ELSE height - wh END + 1 AS m FROM prof JOIN win USING (strip)),
  sco AS (SELECT a.strip, a.axis, a.x, any_value(a.m) AS m, round(sum(b.v), 9) AS s FROM spot a JOIN prof b ON b.strip = a.strip AND b.axis = a.axis AND b.x >= a.x AND b.x < a.x + a.size WHERE a.x < a.m GROUP BY a.strip, a.axis, a.x),
  band AS (SELECT *, b FROM (SELECT *, unnest(range(3)) AS b FROM sco) WHERE m > 1 AND CASE WHEN m >= 3 THEN CAST(ceil((x + 1) * 3.0 / m) AS BIGINT) - 1 = b ELSE b * m // 3 = x END),
  lead_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strip, axis, b ORDER BY s DESC, x) AS rn FROM band) WHERE rn = 1),
  shots AS (SELECT strip, axis, CAST(row_number() OVER (PARTITION BY strip, axis ORDER BY s DESC, b) - 1 AS BIGINT) AS shot, x AS o FROM lead_)"""


@query("d14_crop_plan_aimed", v.sql("strip_rows", f"""WITH {AIMED}, s AS (SELECT win.*, shot, greatest(1080.0 / ww, 1920.0 / wh) AS cover, least(1080.0 / width, 1920.0 / height) AS contain FROM win, (SELECT unnest(range(3)) AS shot)),
  a AS (SELECT s.*, cover > 40 AS whole, CASE WHEN width > ww THEN coalesce(c.o, 0) ELSE 0 END AS ox, CASE WHEN height > wh THEN CASE WHEN width > ww THEN coalesce(r0.o, 0) ELSE coalesce(r.o, 0) END ELSE 0 END AS oy FROM s
    LEFT JOIN shots c ON c.strip = s.strip AND c.axis = 'c' AND c.shot = s.shot LEFT JOIN shots r ON r.strip = s.strip AND r.axis = 'r' AND r.shot = s.shot LEFT JOIN shots r0 ON r0.strip = s.strip AND r0.axis = 'r' AND r0.shot = 0),
  b AS (SELECT strip, shot, width, height, whole, CASE WHEN whole THEN 0 ELSE ox END AS x, CASE WHEN whole THEN 0 ELSE oy END AS y, CASE WHEN whole THEN width ELSE ww END AS w, CASE WHEN whole THEN height ELSE wh END AS h,
    CASE WHEN whole THEN least(0.16 * shot, greatest(0.0, 40 / greatest(contain, 1e-6) - 1)) WHEN shot % 2 = 1 THEN least(0.16, greatest(0.0, 40 / cover - 1)) ELSE 0.0 END AS am FROM a),
  c AS (SELECT *, greatest(8, CAST({even('w * (1 / (1 + am))')} AS BIGINT)) AS tw, greatest(8, CAST({even('h * (1 / (1 + am))')} AS BIGINT)) AS th FROM b)
  SELECT strip AS ch, 0 AS idx, CAST(shot AS INT) AS shot, CAST(CASE WHEN am > 0 THEN greatest(0, least({even('x + w / 2.0 - tw / 2.0')}, width - tw)) ELSE x END AS BIGINT) AS x, CAST(CASE WHEN am > 0 THEN greatest(0, least({even('y + h / 2.0 - th / 2.0')}, height - th)) ELSE y END AS BIGINT) AS y,
    CAST(CASE WHEN am > 0 THEN tw ELSE w END AS BIGINT) AS w, CAST(CASE WHEN am > 0 THEN th ELSE h END AS BIGINT) AS h, CASE WHEN whole THEN 'contain' ELSE 'cover' END AS fit FROM c"""))
def d14b(spark, d):
    """Crops of the strips, aimed by their edge profiles along both axes."""
    hot, rows = v.hot_strips(spark, d), _grey(spark, d)
    panels = rows.groupBy("strip").agg(F.max(F.size("px")).alias("width"), (F.max("y") + 1).cast("int").alias("height"))
    w, h = layout.base_window(F.col("width"), F.col("height"), 1080 / 1920)
    sizes = panels.select("strip", w.alias("w"), h.alias("h"))
    aimed = [strips.profile_windows(strips.edge_profile(rows, axis, hot).withColumn("v", F.round("v", 12)), sizes.select("strip", F.col(size).alias("size")), 3, hot).select(
        F.col("strip").alias("ch"), F.lit(0).alias("idx"), F.col("rank").alias("shot"), "offset") for axis, size in ((0, "w"), (1, "h"))]
    return strips.crop_plan(panels.select(F.col("strip").alias("ch"), F.lit(0).alias("idx"), "width", "height"), 3, max_upscale=40.0, xs=aimed[0], ys=aimed[1])


@query("d15_chunk_layout", v.sql("panels", f"""WITH c AS (SELECT ch AS strip, idx AS pos, 700 + 50 * (height % 3) AS w, height AS h FROM panels),
  n AS (SELECT strip, w, count(*) AS n, min(pos) AS p FROM c GROUP BY strip, w),
  t AS (SELECT strip, w AS target FROM (SELECT *, row_number() OVER (PARTITION BY strip ORDER BY n DESC, p) AS rn FROM n) WHERE rn = 1),
  f AS (SELECT strip, pos, target, CAST(CASE WHEN w = target THEN h ELSE greatest(1, {even('h * target / w')}) END AS BIGINT) AS height FROM c JOIN t USING (strip))
  SELECT strip, pos, target, height, CAST(coalesce(sum(height) OVER (PARTITION BY strip ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS y_offset FROM f"""))
def d15(spark, d):
    c = v.panels(spark, d).select(F.col("ch").alias("strip"), F.col("idx").alias("pos"), (700 + 50 * (F.col("height") % 3)).alias("w"), F.col("height").alias("h"))
    return strips.chunk_layout(c, v.hot_chapters(spark, d))


@query("c14_fit_boxes", v.sql("panels", f"""WITH {WINDOW},
  g AS (SELECT *, least(1080.0 / 800, 1920.0 / height) AS contain, greatest(1080.0 / ww, 1920.0 / wh) AS cover, least(1.0, 1080.0 / 800, 1920.0 / height) AS native,
    least(0.9 * 1080 / 800, 0.9 * 1920 / height, 4.0) AS f, (800 - ww) // 2 AS x, (height - wh) // 2 AS y,
    greatest(8, CAST({even('ww * (1 / 1.16)')} AS BIGINT)) AS tw, greatest(8, CAST({even('wh * (1 / 1.16)')} AS BIGINT)) AS th FROM win)
  SELECT ch, idx, ww AS win_w, wh AS win_h, round(contain, 6) AS contain, round(cover, 6) AS cover, round(native, 6) AS native,
    round((800 * native) * (height * native) / (1080.0 * 1920), 6) AS coverage,
    CAST(greatest(0, least({even('x + ww / 2.0 - tw / 2.0')}, 800 - tw)) AS BIGINT) AS tight_x, CAST(greatest(0, least({even('y + wh / 2.0 - th / 2.0')}, height - th)) AS BIGINT) AS tight_y,
    tw AS tight_w, th AS tight_h, round(greatest(0.0, 3.2 / cover - 1), 6) AS room,
    CASE WHEN f >= 1.1 THEN CAST({even('800 * f')} AS INT) ELSE -1 END AS up_w, CASE WHEN f >= 1.1 THEN CAST({even('height * f')} AS INT) ELSE -1 END AS up_h,
    round(native / contain, 6) AS placed, round(x / 800.0, 6) AS "left", round((x + ww) / 800.0, 6) AS "right", round(CAST(y AS DOUBLE) / height, 6) AS top, round(CAST(y + wh AS DOUBLE) / height, 6) AS bottom FROM g"""))
def c14(spark, d):
    out = layout.fit_boxes(v.panels(spark, d).select("ch", "idx", "width", "height"), 1080, 1920).drop("width", "height")
    out = out.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("up_w", "up_h")})
    return out.withColumns(r6("contain", "cover", "native", "coverage", "room", "placed", "left", "right", "top", "bottom"))
