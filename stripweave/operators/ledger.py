"""Run ledgers and call logs in batch form; the streaming forms are in ``stripweave.streaming``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stripweave.functions.ordered import is_hot, max_to, median_by, nth_by, number_rows, prev, scan

STATUSES = ["pending", "processing", "done", "failed"]
STAGES = ["analyze", "tts", "montage"]


def _hot(df: DataFrame, hot: bool | None, keys: Sequence[str]) -> bool:
    return is_hot(df.select(*keys), list(keys)) if hot is None else hot


def bad_status(events: DataFrame) -> DataFrame:
    """Events with an unknown status; a ledger must have none."""
    return events.filter(F.col("status").isNotNull() & ~F.col("status").isin(STATUSES))


def known_status(status: Column) -> Column:
    """The status; an unknown one is an error, as a ledger must not lose what came with it."""
    return F.when(status.isNull() | status.isin(STATUSES), status).otherwise(F.raise_error(F.concat(F.lit("unknown status: "), status)))


def latest_columns(fields: Sequence[str], order: Sequence[str]) -> list[Column]:
    """Aggregates for one ledger row: the latest value set of each field, and the number of attempts.

    A URL that never had a status is pending.
    """
    at = F.struct(*order)
    latest = {c: F.max_by(c, F.when(F.col(c).isNotNull(), at)) for c in fields}
    if "status" in latest:
        latest["status"] = F.coalesce(latest["status"], F.lit("pending"))
    return [v.alias(c) for c, v in latest.items()] + [F.count_if(F.col("status") == "processing").alias("attempts")]


def ledger_latest(events: DataFrame, fields: Sequence[str] = ("status", "step_s"), order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """One row per URL. Combines before the shuffle. Events with an unknown status are refused."""
    return events.withColumn("status", known_status(F.col("status"))).groupBy("url").agg(*latest_columns(fields, order))


def ledger_counts(latest: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """URLs per status, zeros included, of all or only of ``urls``."""
    some = latest if urls is None else latest.join(urls.select("url"), "url", "left_semi")
    all_ = latest.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    n = some.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return all_.join(n, "status", "left").fillna(0, ["n"])


def due_chapters(urls: DataFrame, latest: DataFrame, retry_failed: bool = True, force: bool = False) -> DataFrame:
    """Distinct URLs ``(url, pos)`` still to do, at their first position; an unknown URL is pending."""
    first = urls.groupBy("url").agg(F.min("pos").alias("pos"))
    p = first.join(latest.select("url", "status"), "url", "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    skip = (F.col("status") == "done") | ((F.col("status") == "failed") & F.lit(not retry_failed))
    return p if force else p.filter(~skip)


def recompute(stage: Column, redo: str | None, force: bool = False) -> Column:
    """Whether a stage is due: forced, or at or after the first stage to redo."""
    rank = STAGES.index(redo) + 1 if redo in STAGES else 0
    own = F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage)
    return F.lit(force) | ((own > 0) & F.lit(rank > 0) & (own >= rank))


def timing_summary(steps: DataFrame, runs: DataFrame, hot: bool | None = None) -> DataFrame:
    """Medians per step and over runs, as rows ``(scope, name, value)``.

    ``steps (run, step, seconds)``, ``runs (run, video_s, reused)``. Steps up to 0.05 s do not count as
    computed; runs without a computed step or with three reused stages only count as reused.
    """
    per = steps.groupBy("run").agg(F.sum("seconds").alias("total_s"), F.count_if(F.col("seconds") > 0.05).alias("_n"))
    r = runs.join(per, "run", "left").fillna(0, ["_n"])
    r = r.withColumn("measured", (F.col("_n") > 0) & (F.col("reused") < 3))
    good = r.filter("measured")
    done = steps.filter("seconds > 0.05").join(good.select("run"), "run", "left_semi")
    large = _hot(done, hot, ["step"])
    per_step = done.groupBy("step").agg(F.sum("seconds").alias("total"), F.count(F.lit(1)).cast("double").alias("n")).join(
        median_by(done, ["step"], "seconds", "median", large), "step")
    a = per_step.select(F.lit("step").alias("scope"), F.explode(F.array(*[
        F.struct(F.concat(F.col("step"), F.lit(f".{n}")).alias("name"), c.alias("value")) for n, c in (
            ("median", F.bround("median", 1)), ("total", F.bround("total", 1)), ("n", F.col("n")))])).alias("x")).select("scope", "x.*")
    one = good.withColumns({"_k": F.lit(1), "ratio": F.when(F.col("video_s") > 0, F.col("total_s") / F.col("video_s")), "video": F.when(F.col("video_s") > 0, F.col("video_s"))})
    big = _hot(one, hot, ["_k"])
    counts = r.agg(F.count(F.lit(1)).cast("double").alias("chapters"), F.count_if("measured").cast("double").alias("measured"),
                   F.count_if(~F.col("measured")).cast("double").alias("reused"),
                   F.bround(F.min(F.when(F.col("measured"), F.col("total_s"))), 1).alias("chapter_min"),
                   F.bround(F.max(F.when(F.col("measured"), F.col("total_s"))), 1).alias("chapter_max"))
    out = counts.select(F.lit("all").alias("scope"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.coalesce(F.col(n), F.lit(0.0)).alias("value")) for n in ("chapters", "measured", "reused", "chapter_min", "chapter_max")])).alias("x")).select("scope", "x.*")
    for value, name, digits in (("total_s", "chapter_median", 1), ("video", "video_median", 1), ("ratio", "compute_per_video_second", 2)):
        m = median_by(one, ["_k"], value, "value", big)
        out = out.unionByName(m.select(F.lit("all").alias("scope"), F.lit(name).alias("name"), F.bround("value", digits).alias("value")))
    return a.unionByName(out)


def rate_admission(requests: DataFrame, n: int, window_s: float, keys: Sequence[str] = ("key_id",), hot: bool | None = None) -> DataFrame:
    """When each request ``(keys, call_id, ts)`` is admitted: fewer than ``n`` admissions in the last ``window_s``.

    First come, first served: start k = max(arrival k, start k-n + window). Along every n-th request that is
    a running maximum of arrival minus its steps, so it is a window, not a loop. Times are whole
    microseconds.
    """
    p = requests.select(*keys, "call_id", F.unix_micros("ts").alias("arrival_us"), F.lit(True).alias("fresh"), F.unix_micros("ts").alias("place"))
    return admissions(p, n, window_s, keys, hot).select(*keys, "call_id", "arrival_us", "start_us", (F.col("start_us") - F.col("arrival_us")).alias("wait_us"))


def admissions(p: DataFrame, n: int, window_s: float, keys: Sequence[str], hot: bool | None = None) -> DataFrame:
    """``p (keys, call_id, arrival_us, fresh, place)`` with ``start_us`` and the number ``k`` of each admission of its key.

    Rows that are not ``fresh`` are admissions already given (arrival = start), at most the last ``n`` of a key; they come first, by ``place``.
    """
    keys = list(keys)
    hot = _hot(p, hot, keys)
    w = int(round(window_s * 1_000_000))
    p = number_rows(p, keys, ["fresh", "place", "call_id"], "k", hot=hot)
    p = p.withColumns({"_lane": F.col("k") % n, "_j": F.floor(F.col("k") / n)})
    p = scan(p, [*keys, "_lane"], ["_j"], hot, _m=max_to(F.col("arrival_us") - F.col("_j") * w))
    return p.withColumn("start_us", F.col("_m") + F.col("_j") * w).drop("_lane", "_j", "_m", "place")


def over_limit(requests: DataFrame, window_s: float, keys: Sequence[str] = ("key_id",), hot: bool | None = None) -> DataFrame:
    """How many requests of the key fall in the window ending at each request, itself included.

    Rank of the request minus rank of the first one inside the window: both come from one ordered
    pass over arrivals and window starts, so no window frame has to hold a whole key.
    """
    keys = list(keys)
    hot = _hot(requests, hot, keys)
    w = int(round(window_s * 1_000_000))
    p = requests.select(*keys, "call_id", F.unix_micros("ts").alias("at"))
    points = p.select(*keys, "call_id", F.col("at").alias("t"), F.lit(0).alias("kind"), F.lit(1).alias("one")).unionByName(
        p.select(*keys, "call_id", (F.col("at") - w).alias("t"), F.lit(1).alias("kind"), F.lit(0).alias("one"))).unionByName(
        p.select(*keys, "call_id", F.col("at").alias("t"), F.lit(2).alias("kind"), F.lit(0).alias("one")))
    points = points.withColumn("_c", F.col("one"))
    ranked = number_rows(points, keys, ["t", "kind", "call_id"], "_p", hot=hot)
    from stripweave.functions.ordered import sum_to

    run = scan(ranked, keys, ["_p"], hot, _n=sum_to(F.col("_c")))
    # arrivals up to the window start (kind 1 comes after those at the same moment) are outside
    per = run.filter("kind > 0").groupBy(*keys, "call_id").agg(
        (F.max(F.when(F.col("kind") == 2, F.col("_n"))) - F.max(F.when(F.col("kind") == 1, F.col("_n")))).alias("n"))
    return per


def call_stats(calls: DataFrame, hot: bool | None = None) -> DataFrame:
    """Outcome and latency of calls ``(model, latency_s, ok)`` per model and over all (model '').

    p50 and p95 are nearest ranks: index round-half-even(q (n - 1)).
    """
    both = calls.select(F.explode(F.array("model", F.lit(""))).alias("model"), "latency_s", "ok")
    agg = both.groupBy("model").agg(
        F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.count(F.lit(1)).alias("n"), F.avg("latency_s").alias("mean"),
        F.max("latency_s").alias("max"), F.sum("latency_s").alias("total"))
    at = {n: F.bround(q * (F.col("_n") - 1)) for n, q in (("p50", 0.5), ("p95", 0.95))}
    return agg.join(nth_by(both, ["model"], "latency_s", at, _hot(both, hot, ["model"])), "model")


# Waits between attempts, and the longest wait, in seconds.
BACKOFF, LONGEST_WAIT = [2.0, 4.0, 8.0, 16.0], 65.0
# How a service words the wait it asks for.
HINTS = [r"(?i)retry in ([\d.]+)\s*s", r"(?i)retryDelay['\"]?\s*[:=]\s*['\"]?([\d.]+)s"]


def classify_errors(calls: DataFrame, attempt: Column | None = None) -> DataFrame:
    """Class, suggested wait and wait before the next attempt of failed calls ``(code, message)``."""
    text, code = F.lower(F.coalesce("message", F.lit(""))), F.col("code")

    def holds(*parts: str) -> Column:
        out = F.lit(False)
        for x in parts:
            out = out | text.contains(x)
        return out

    kind = (F.when((code == 429) & F.coalesce("message", F.lit("")).contains("PerDay"), "daily_quota").when(code == 429, "rate_limit")
            .when(code.isin(401, 403) | ((code == 400) & holds("api key", "api_key_invalid")), "invalid_key")
            .when((code == 400) & holds("max_output_tokens", "maxoutputtokens", "output token"), "output_limit")
            .when(code == 404, "model_gone").when(code.between(500, 599) | (code == 408) | code.isNull(), "transient").otherwise("fatal"))
    found = F.concat(*[F.regexp_extract_all("message", F.lit(h), F.lit(1)) for h in HINTS])
    best = F.array_max(F.transform(found, lambda x: F.when(x.rlike(r"^\d*\.?\d+$|^\d+\.$"), x.cast("double"))))
    hint = F.when(best > 0, best + 1).otherwise(0.0)
    k = F.least(F.greatest(attempt if attempt is not None else F.lit(1), F.lit(1)), F.lit(len(BACKOFF)))
    back = F.element_at(F.array(*[F.lit(b) for b in BACKOFF]), k.cast("int"))
    return calls.withColumns({"kind": kind, "hint_s": F.coalesce(hint, F.lit(0.0))}).withColumn(
        "delay_s", F.least(F.lit(LONGEST_WAIT), F.greatest(back, F.col("hint_s"))))


def http_delay(attempt: Column, retry_after: Column, backoff: float = 1.0, most: float = 60.0) -> Column:
    """Doubling wait, or the server's own number where larger, up to a limit."""
    asked = F.when(F.trim(retry_after).rlike(r"^\d+(\.\d+)?$"), F.trim(retry_after).cast("double"))
    return F.least(F.lit(most), F.greatest(backoff * F.pow(F.lit(2.0), attempt - 1), F.coalesce(asked, F.lit(0.0))))


def mask_secret(c: Column) -> Column:
    return F.concat(F.lit("..."), F.when(F.length(c) >= 8, F.right(c, F.lit(4))).otherwise("****"))


def release_in_order(ready: DataFrame, finished: DataFrame, timeout_s: float = 600.0, hot: bool | None = None) -> DataFrame:
    """When each chapter ``(url, title_no, episode_no, ready_us)`` may start its analysis.

    After its predecessor in the series has finished (``finished (url, finished_us)``, any outcome) or the
    timeout is over; without a predecessor at once. ``has_memory`` tells whether it got what that one left.
    """
    hot = _hot(ready, hot, ["title_no"])
    placed = F.col("title_no").isNotNull() & F.col("episode_no").isNotNull()
    near = scan(ready.filter(placed), ["title_no"], ["episode_no", "url"], hot, previous=prev(F.col("url")))
    # without both ids a chapter has no place in a series: it waits for nobody and nobody for it
    near = near.unionByName(ready.filter(~placed).withColumn("previous", F.lit(None).cast(ready.schema["url"].dataType)))
    first = finished.groupBy(F.col("url").alias("previous")).agg(F.min("finished_us").alias("_f"))
    p = near.join(first, "previous", "left")
    limit = F.col("ready_us") + int(timeout_s * 1_000_000)
    at = F.when(F.col("previous").isNull(), F.col("ready_us")).otherwise(F.least(F.greatest("ready_us", F.coalesce("_f", limit)), limit))
    return p.select("url", "previous", "ready_us", at.alias("release_us"), F.coalesce(F.col("_f") <= limit, F.lit(False)).alias("has_memory"))
