"""Registered queries on ledgers and call logs, batch and stream, with their SQL texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stripweave.operators import ledger as lg
from stripweave.plans import views as v
from stripweave.plans.strip_queries import even
from stripweave.streaming import ledgers as st

QUERIES, SQL = {}, {}


def query(name: str, text: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if text is not None:
            SQL[name] = text
        return fn
    return add


LATEST = "lt AS (SELECT url, coalesce(arg_max(status, (ts, event_id)), 'pending') AS status, arg_max(step_s, (ts, event_id)) AS step_s, count(*) FILTER (status = 'processing') AS attempts FROM ledger GROUP BY url)"
LATEST_SQL = v.sql("ledger", f"WITH {LATEST} SELECT url, status, round(step_s, 6) AS step_s, attempts FROM lt")


@query("j1_ledger_latest", LATEST_SQL)
def j1(spark, d):
    return lg.ledger_latest(v.ledger(spark, d)).withColumn("step_s", F.round("step_s", 6))


def stream_of(spark, d, name):
    schema = v.table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}*.parquet")


def _status(e):
    status = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("processing")
    return e.select("event_id", F.col("user_id").alias("url"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), F.col("value").alias("step_s"))


@query("j1_ledger_stream", LATEST_SQL)
def j1s(spark, d):
    out = st.upsert_ledger(st.ledger_stream(_status(stream_of(spark, d, "events"))), st.working_folder(spark))
    return out.withColumn("step_s", F.round("step_s", 6))


@query("j2_ledger_counts", v.sql("ledger", f"WITH {LATEST}, s AS (SELECT unnest(['pending', 'processing', 'done', 'failed']) AS status) SELECT s.status, count(lt.url) AS n FROM s LEFT JOIN lt ON lt.status = s.status AND lt.url % 3 = 0 GROUP BY s.status"))
def j2(spark, d):
    latest = lg.ledger_latest(v.ledger(spark, d))
    return lg.ledger_counts(latest, latest.filter("url % 3 = 0"))


@query("j3_due_chapters", v.sql("ledger", f"WITH {LATEST}, u AS (SELECT c_custkey % 2000 AS url, min(c_custkey) AS pos FROM customer GROUP BY 1), p AS (SELECT u.url, pos, coalesce(status, 'pending') AS status FROM u LEFT JOIN lt ON lt.url = u.url) SELECT * FROM p WHERE status NOT IN ('done', 'failed')"))
def j3(spark, d):
    urls = v.table(spark, d, "customer").select((F.col("c_custkey") % 2000).alias("url"), F.col("c_custkey").alias("pos"))
    return lg.due_chapters(urls, lg.ledger_latest(v.ledger(spark, d)), retry_failed=False)


def _medians() -> str:
    step = "".join(f"UNION ALL SELECT 'step', step || '.{n}', {x} FROM ps " for n, x in (("median", f"({even('md * 10')}) / 10"), ("total", f"({even('tot * 10')}) / 10"), ("n", "n")))
    al = "".join(f"UNION ALL SELECT 'all', '{n}', {x} FROM aa " for n, x in (
        ("measured", "m"), ("reused", "c - m"), ("chapter_min", f"({even('lo * 10')}) / 10"), ("chapter_max", f"({even('hi * 10')}) / 10"), ("chapter_median", f"({even('cm * 10')}) / 10"),
        ("video_median", f"({even('vm * 10')}) / 10"), ("compute_per_video_second", f"({even('rm * 100')}) / 100")))
    return f"SELECT 'all' AS scope, 'chapters' AS name, CAST(c AS DOUBLE) AS value FROM aa {al}{step}"


@query("j4_timing_summary", v.sql("ledger", f"""WITH s AS (SELECT url AS run, status AS step, sum(CAST(round(step_s * 1000) AS BIGINT)) / 1000.0 AS seconds, FROM ledger GROUP BY url, status),
  r AS (SELECT url AS run, CAST(count(*) * 7 AS DOUBLE) AS video_s, url % 4 AS reused FROM ledger GROUP BY url),
  p AS (SELECT run, sum(seconds) AS total, count(*) FILTER (seconds > 0.05) AS k FROM s GROUP BY run), g AS (SELECT r.*, total, k > 0 AND reused < 3 AS ok FROM r JOIN p USING (run)),
  ps AS (SELECT step, median(seconds) AS md, sum(seconds) AS tot, count(*) AS n FROM s JOIN g USING (run) WHERE ok AND seconds > 0.05 GROUP BY step),
  aa AS (SELECT count(*) AS c, count(*) FILTER (ok) AS m, min(total) FILTER (ok) AS lo, max(total) FILTER (ok) AS hi, median(total) FILTER (ok) AS cm, median(video_s) FILTER (ok) AS vm, median(total / video_s) FILTER (ok) AS rm FROM g)
  {_medians()}"""))
def j4(spark, d):
    led = v.ledger(spark, d)
    steps = led.groupBy(F.col("url").alias("run"), F.col("status").alias("step")).agg((F.sum(F.round(F.col("step_s") * 1000).cast("long")) / 1000.0).alias("seconds"))
    runs = led.groupBy(F.col("url").alias("run")).agg((F.count(F.lit(1)) * 7).cast("double").alias("video_s")).withColumn("reused", F.col("run") % 4)
    return lg.timing_summary(steps, runs)


ADMIT = v.sql("api_calls", """WITH k AS (SELECT key_id, call_id, epoch_us(ts) AS a, row_number() OVER (PARTITION BY key_id ORDER BY ts, call_id) - 1 AS k FROM api_calls),
  m AS (SELECT *, max(a - k // 3 * 600000000) OVER (PARTITION BY key_id, k % 3 ORDER BY k) + k // 3 * 600000000 AS s FROM k)
  SELECT key_id, call_id, a AS arrival_us, s AS start_us, s - a AS wait_us FROM m""")


@query("j5_rate_admission", ADMIT)
def j5(spark, d):
    return lg.rate_admission(v.api_calls(spark, d), 3, 600)


@query("j5_rate_admission_stream", ADMIT)
def j5s(spark, d):
    e = stream_of(spark, d, "events").select((F.col("user_id") % 5).alias("key_id"), F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"))
    return st.admit_requests(e, 3, 600, st.working_folder(spark))


@query("j5_over_limit", v.sql("api_calls", """SELECT key_id, call_id, count(*) OVER (PARTITION BY key_id ORDER BY epoch_us(ts) RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW) AS n FROM api_calls"""))
def j5b(spark, d):
    return lg.over_limit(v.api_calls(spark, d), 600)


@query("j6_call_stats", v.sql("api_calls", f"""WITH b AS (SELECT model, latency_s, ok FROM api_calls UNION ALL SELECT '', latency_s, ok FROM api_calls),
  r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY latency_s) - 1 AS r, count(*) OVER (PARTITION BY model) AS n FROM b)
  SELECT model, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed, count(*) AS n, round(avg(latency_s), 6) AS mean, max(latency_s) AS "max", round(sum(latency_s), 4) AS total,
   max(CASE WHEN r = {even('0.5 * (n - 1)')} THEN latency_s END) AS p50, max(CASE WHEN r = {even('0.95 * (n - 1)')} THEN latency_s END) AS p95 FROM r GROUP BY model"""))
def j6(spark, d):
    return lg.call_stats(v.api_calls(spark, d)).withColumns({"mean": F.round("mean", 6), "total": F.round("total", 4)})


@query("j7_classify_errors", v.sql("api_calls", """WITH c AS (SELECT call_id, CASE WHEN code = 429 AND contains(message, 'PerDay') THEN 'daily_quota' WHEN code = 429 THEN 'rate_limit' WHEN code IN (401, 403) THEN 'invalid_key' WHEN code = 404 THEN 'model_gone'
    WHEN code BETWEEN 500 AND 599 OR code = 408 THEN 'transient' ELSE 'fatal' END AS kind, coalesce(TRY_CAST(regexp_extract(message, 'retry in ([0-9.]+)s', 1) AS DOUBLE) + 1, 0) AS h, 2 ** (1 + call_id % 4) AS b FROM api_calls WHERE NOT ok)
  SELECT call_id, kind, CASE WHEN h > 1 THEN h ELSE 0 END AS hint_s, CAST(least(65, greatest(b, CASE WHEN h > 1 THEN h ELSE 0 END)) AS DOUBLE) AS delay_s, '...' || right('key-' || call_id || '-secret', 4) AS masked FROM c"""))
def j7(spark, d):
    c = v.api_calls(spark, d).filter("not ok")
    out = lg.classify_errors(c, F.col("call_id") % 4 + 1)
    return out.select("call_id", "kind", "hint_s", "delay_s", lg.mask_secret(F.concat(F.lit("key-"), F.col("call_id").cast("string"), F.lit("-secret"))).alias("masked"))


PAIRS = """rd AS (SELECT user_id AS url, user_id % 20 AS title_no, user_id // 20 AS episode_no, epoch_us(min(ts)) AS ready FROM events GROUP BY user_id), fn AS (SELECT user_id AS url, epoch_us(min(ts)) AS f FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id)"""


@query("j8_release_in_order", f"""WITH {PAIRS}, p AS (SELECT *, lag(url) OVER (PARTITION BY title_no ORDER BY episode_no, url) AS prev FROM rd)
  SELECT p.url, coalesce(prev, -1) AS previous, ready AS ready_us, CASE WHEN prev IS NULL THEN ready ELSE least(greatest(ready, coalesce(f, ready + 86400000000)), ready + 86400000000) END AS release_us, coalesce(f <= ready + 86400000000, false) AS has_memory
  FROM p LEFT JOIN fn ON fn.url = prev""")
def j8(spark, d):
    ready, finished = _pairs(spark, d)
    return lg.release_in_order(ready, finished, 86400).withColumn("previous", F.coalesce("previous", F.lit(-1)))


def _pairs(spark, d):
    e = v.table(spark, d, "events").select(F.col("user_id").alias("url"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    ready = e.groupBy("url").agg(F.min("at").alias("ready_us")).select("url", (F.col("url") % 20).alias("title_no"), F.floor(F.col("url") / 20).alias("episode_no"), "ready_us")
    finished = e.filter("event_type in ('purchase', 'error')").groupBy("url").agg(F.min("at").alias("finished_us"))
    return ready, finished


@query("j8_release_stream", """WITH r AS (SELECT user_id AS url, CASE WHEN user_id % 20 > 0 THEN user_id - 1 END AS previous, epoch_us(ts) AS ready_us FROM events WHERE event_type = 'signup'),
  f AS (SELECT user_id AS done, epoch_us(min(ts)) AS f FROM events WHERE event_type = 'purchase' GROUP BY user_id)
  SELECT url, coalesce(previous, -1) AS previous, ready_us, CASE WHEN previous IS NULL THEN ready_us ELSE least(greatest(ready_us, coalesce(f, ready_us + 600000000)), ready_us + 600000000) END AS release_us,
    coalesce(f <= ready_us + 600000000, false) AS has_memory FROM r LEFT JOIN f ON done = previous""")
def j8s(spark, d):
    """Sign-ups wait for a purchase of the user before them, ten minutes at most."""
    e = stream_of(spark, d, "events").select(F.col("user_id").alias("url"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    ready = e.filter("event_type = 'signup'").select("url", F.when(F.col("url") % 20 > 0, F.col("url") - 1).alias("previous"), F.col("ts").alias("ready_ts"))
    finished = e.filter("event_type = 'purchase'").select("url", F.col("ts").alias("finished_ts"))
    out = st.append_once(st.release_stream(ready, finished, 600, "10 minutes"), st.working_folder(spark))
    return out.withColumn("previous", F.coalesce("previous", F.lit(-1)))
