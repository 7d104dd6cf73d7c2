"""The supplied tables in the shapes the operators take, for Spark and as SQL text.

The SQL texts are the bindings the checks start from; the Spark forms below return the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stripweave.functions.ordered import is_hot, number_rows, number_wide, scan, sum_before

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_shipdate", "l_returnflag", "l_linestatus"]
EMOTIONS = ["neutral", "calm", "tension", "action", "sad", "happy", "humor", "romance", "fear", "mystery", "epic"]
KINDS = ["head", "person", "bubble", "free_text", "sfx", "narration"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def hot(spark: SparkSession, d: str, name: str, key: str) -> bool:
    return is_hot(table(spark, d, name).select(key), [key])


def hot_strips(spark: SparkSession, d: str) -> bool:
    return hot(spark, d, "embeddings", "label")


def hot_chapters(spark: SparkSession, d: str) -> bool:
    return hot(spark, d, "lineitem", "l_orderkey")


def hot_talks(spark: SparkSession, d: str) -> bool:
    return hot(spark, d, "conversations", "conv_id")


def strip_rows(spark: SparkSession, d: str) -> DataFrame:
    e = number_rows(table(spark, d, "embeddings"), ["label"], ["vec_id"], "y")
    px = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int"))
    return e.select(F.col("label").alias("strip"), "y", px.alias("px"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return number_rows(table(spark, d, "lineitem"), ["l_orderkey"], LINE_ORDER, "idx")


def panels(spark: SparkSession, d: str) -> DataFrame:
    p = _lines(spark, d).select(
        F.col("l_orderkey").alias("ch"), "idx", F.lit(800).alias("width"),
        (100 + 40 * F.col("l_quantity")).cast("int").alias("height"),
        (F.col("l_quantity") >= 45).alias("heavy"), F.col("l_extendedprice").alias("price"))
    return scan(p, ["ch"], ["idx"], hot_chapters(spark, d), y_start=sum_before(F.col("height")))


def scenes(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(e) for e in EMOTIONS])
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("ch"), F.col("turn").alias("idx"), F.col("text").alias("narration"),
        F.element_at(names, ((F.col("conv_id") * 7 + F.col("turn") * 3) % 11 + 1).cast("int")).alias("emotion"),
        (F.col("role") == "system").alias("is_filler"))


def audio(spark: SparkSession, d: str) -> DataFrame:
    spoken = F.length("text").cast("double") / 15
    return table(spark, d, "conversations").filter("role <> 'system'").select(
        F.col("conv_id").alias("ch"), F.col("turn").alias("scene"), spoken.alias("speech_s"), (spoken + 0.18).alias("duration_s"))


def scene_panels(spark: SparkSession, d: str) -> DataFrame:
    """The scene length is a sum over at most three panels, so its groups are bounded."""
    p = _lines(spark, d).select(
        F.col("l_orderkey").alias("ch"), F.floor(F.col("idx") / 3).cast("int").alias("scene"), F.col("idx").alias("panel"),
        (100 + 40 * F.col("l_quantity")).cast("int").alias("height"), (F.col("l_quantity") >= 45).alias("heavy"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("_cents"))
    from pyspark.sql import Window as W

    total = F.sum("_cents").over(W.partitionBy("ch", "scene")).cast("double") / 2000000
    return p.withColumn("duration_s", total).drop("_cents")


def api_calls(spark: SparkSession, d: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    e = table(spark, d, "events").withColumn("k", k)
    bad = F.col("event_type") == "error"
    code = F.when(~bad, 200)
    for r, c in enumerate([429, 429, 403, 404, 503]):
        code = code.when(F.col("k") % 6 == r, c)
    message = F.when(F.col("k") % 6 == 0, "quota PerDay").when(
        F.col("k") % 6 == 1, F.concat(F.lit("retry in "), F.col("k").cast("string"), F.lit("s"))).otherwise("other")
    return e.select(F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("model"),
                    (F.col("user_id") % 5).alias("key_id"), F.col("value").alias("latency_s"), (~bad).alias("ok"),
                    code.otherwise(400).alias("code"), message.alias("message"))


def ledger(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "purchase", "done").when(
        F.col("event_type") == "error", "failed").otherwise("processing")
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("url"), F.col("ts").cast("timestamp").alias("ts"),
                                            status.alias("status"), F.col("value").alias("step_s"))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    x0, y0 = (F.col("l_partkey") % 500).cast("int"), ((F.col("l_suppkey") * 13) % 700).cast("int")
    return _lines(spark, d).select(
        F.col("l_orderkey").alias("block"), "idx", x0.alias("x0"), y0.alias("y0"),
        (x0 + 20 + F.col("l_quantity").cast("int") * 4).alias("x1"), (y0 + 20 + (F.col("l_partkey") % 200).cast("int")).alias("y1"),
        F.element_at(kinds, (F.col("l_linenumber") % 6 + 1).cast("int")).alias("kind"), F.col("l_discount").alias("score"))


def cards(spark: SparkSession, d: str) -> DataFrame:
    """Names are cut from the texts before these are numbered, so a query that asks for no ``who`` moves no texts."""
    words = F.split("text", " ", 3)
    t = table(spark, d, "documents").select("source", "doc_id", words[0].alias("name"), F.coalesce(F.get(words, 1), F.lit("")).alias("alias"), F.col("text").alias("who"))
    n = number_wide(t, ["source"], ["doc_id"], "_n", hot(spark, d, "documents", "source"))
    return n.select(F.col("source").alias("series"), (F.col("_n") + 1).alias("ep"), "name", "alias", "who")


def samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("clip"), F.posexplode("embedding").alias("i", "v")).select(
        "clip", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"))


_KIND_ROWS = ", ".join(f"({i}, '{k}')" for i, k in enumerate(KINDS))
_EMOTION_ROWS = ", ".join(f"({i}, '{e}')" for i, e in enumerate(EMOTIONS))
_ORDER = ", ".join(LINE_ORDER)

SQL = {
    "strip_rows": "SELECT label AS strip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y, "
                  "list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS INT)) AS px FROM embeddings",
    "panels": f"""SELECT *, CAST(coalesce(sum(height) OVER (PARTITION BY ch ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS y_start
        FROM (SELECT l_orderkey AS ch, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS idx,
          800 AS width, CAST(100 + 40 * l_quantity AS INT) AS height, l_quantity >= 45 AS heavy, l_extendedprice AS price FROM lineitem) p""",
    "scenes": f"""SELECT conv_id AS ch, turn AS idx, text AS narration, e.emotion, role = 'system' AS is_filler
        FROM conversations JOIN (VALUES {_EMOTION_ROWS}) AS e(i, emotion) ON e.i = (conv_id * 7 + turn * 3) % 11""",
    "audio": "SELECT conv_id AS ch, turn AS scene, CAST(length(text) AS DOUBLE) / 15 AS speech_s, "
             "CAST(length(text) AS DOUBLE) / 15 + 0.18 AS duration_s FROM conversations WHERE role <> 'system'",
    "scene_panels": "SELECT ch, CAST(floor(idx / 3.0) AS INT) AS scene, idx AS panel, height, heavy, "
                    "CAST(sum(CAST(round(price * 100) AS BIGINT)) OVER (PARTITION BY ch, CAST(floor(idx / 3.0) AS INT)) AS DOUBLE) / 2000000 AS duration_s FROM panels",
    "api_calls": """SELECT event_id AS call_id, ts, event_type AS model, user_id % 5 AS key_id, value AS latency_s, event_type <> 'error' AS ok,
        CASE WHEN event_type <> 'error' THEN 200 ELSE CASE k % 6 WHEN 0 THEN 429 WHEN 1 THEN 429 WHEN 2 THEN 403 WHEN 3 THEN 404 WHEN 4 THEN 503 ELSE 400 END END AS code,
        CASE k % 6 WHEN 0 THEN 'quota PerDay' WHEN 1 THEN concat('retry in ', CAST(k AS VARCHAR), 's') ELSE 'other' END AS message
        FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) q""",
    "ledger": """SELECT event_id, user_id AS url, ts, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'processing' END AS status,
        value AS step_s FROM events""",
    "boxes": f"""SELECT l_orderkey AS block, b.idx, x0, y0, x0 + 20 + CAST(l_quantity AS INT) * 4 AS x1, y0 + 20 + CAST(l_partkey % 200 AS INT) AS y1, k.kind, b.l_discount AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS idx,
          CAST(l_partkey % 500 AS INT) AS x0, CAST((l_suppkey * 13) % 700 AS INT) AS y0 FROM lineitem) b
        JOIN (VALUES {_KIND_ROWS}) AS k(i, kind) ON k.i = b.l_linenumber % 6""",
    "cards": "SELECT source AS series, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ep, split_part(text, ' ', 1) AS name, "
             "split_part(text, ' ', 2) AS alias, text AS who FROM documents",
    "samples": "SELECT vec_id AS clip, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings",
}
_NEEDS = {"scene_panels": ["panels"]}


def sql(views: str, body: str, recursive: bool = False) -> str:
    """SQL text with the named views in front: ``sql('panels scenes', 'SELECT ...')``."""
    names: list[str] = []
    for v in views.split():
        for n in [*_NEEDS.get(v, []), v]:
            if n not in names:
                names.append(n)
    parts = [f"{n} AS ({SQL[n]})" for n in names]
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    if body.startswith("WITH "):
        return f"{head}{', '.join(parts)}, {body[5:]}" if parts else body
    return f"{head}{', '.join(parts)} {body}" if parts else body
