"""Streaming forms of the ledger rules: latest rows, rate admission, ordered release."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stripweave.operators.ledger import admissions, known_status, latest_columns
from stripweave.session import shared_folder


def working_folder(spark) -> str:
    """New folder for a stream's output and checkpoint, in the folder all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/stripweave-{uuid.uuid4().hex}"


def ledger_stream(events: DataFrame, fields: Sequence[str] = ("status", "step_s"), order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """One row per URL, updated with each event; write it in update mode."""
    return events.withColumn("status", known_status(F.col("status"))).groupBy("url").agg(*latest_columns(fields, order))


def upsert_ledger(stream: DataFrame, folder: str):
    """Run the available input of an update-mode ledger; every batch's changed rows are one partition.

    A batch that is run again overwrites its own partition, so a lost executor or driver changes nothing.
    """
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    q = (stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    rows = stream.sparkSession.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    cols = [c for c in rows.columns if c not in ("batch", "url")]
    return rows.groupBy("url").agg(F.max_by(F.struct(*cols), F.col("batch")).alias("_r")).select("url", "_r.*")


def admit_requests(requests: DataFrame, n: int, window_s: float, folder: str) -> DataFrame:
    """Run the available input of a stream ``(key_id, call_id, ts)``; every request's admission, first come, first served.

    Each micro-batch goes through the batch rule behind the last ``n`` admissions of every key, so a key of any size is cut into chunks as
    there, and no task holds a key's requests. Those ``n`` rows a key are kept beside the batch's own in one partition, which a
    batch that is run again overwrites. Requests of a batch go by time; one that comes after a later one of an earlier batch is
    admitted behind it. None is dropped.
    """
    spark = requests.sparkSession
    kept = F.col("key_id"), F.col("call_id"), F.col("arrival_us"), F.col("start_us"), F.col("k"), F.col("fresh")
    last = W.partitionBy("key_id").orderBy(F.desc("k"))

    def put(batch: DataFrame, number: int) -> None:
        before = batch.sparkSession.read.schema(held).parquet(f"{folder}/rows/batch={number - 1}")
        carried = before.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= n)
        rows = batch.select("key_id", "call_id", F.unix_micros("ts").alias("arrival_us"), F.lit(True).alias("fresh"), F.unix_micros("ts").alias("place")).unionByName(
            carried.select("key_id", "call_id", F.col("start_us").alias("arrival_us"), F.lit(False).alias("fresh"), F.col("k").alias("place")))
        admissions(rows, n, window_s, ["key_id"]).select(*kept).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    types = {f.name: f.dataType.simpleString() for f in requests.schema}
    held = f"key_id {types['key_id']}, call_id {types['call_id']}, arrival_us long, start_us long, k long, fresh boolean"
    spark.createDataFrame([], held).write.mode("overwrite").parquet(f"{folder}/rows/batch=-1")
    q = requests.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(held).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows").filter("fresh")
    return rows.select("key_id", "call_id", "arrival_us", "start_us", (F.col("start_us") - F.col("arrival_us")).alias("wait_us"))


RELEASED = "url string, previous string, ready_us long, release_us long, has_memory boolean"


def release_stream(ready: DataFrame, finished: DataFrame, timeout_s: int, late: str) -> DataFrame:
    """Ordered release over two streams: ``ready (url, previous, ready_ts)`` and ``finished (url, finished_ts)``.

    One row per sign-up. ``previous`` comes from a static series table; the state of a chapter is the earliest end of it
    seen so far, however old, and the sign-ups that still wait for it. A sign-up without predecessor comes out at
    once, one whose predecessor has ended with the next batch, any other when the watermark (``late`` behind the newest
    event) has passed its limit; what is still open when a run ends stays in the state.
    """
    wait = timeout_s * 1_000_000
    free = ready.filter("previous is null").select(
        "url", "previous", F.unix_micros("ready_ts").alias("ready_us"), F.unix_micros("ready_ts").alias("release_us"), F.lit(False).alias("has_memory"))
    # ids are text inside, since numbers with nulls would pass through floats
    waiting = ready.filter("previous is not null").select(F.col("previous").cast("string").alias("key"), F.col("url").cast("string").alias("url"), F.unix_micros("ready_ts").alias("ready_us"), F.lit(None).cast("long").alias("end_us"), F.col("ready_ts").alias("at"))
    ends = finished.select(F.col("url").cast("string").alias("key"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("long").alias("ready_us"), F.unix_micros("finished_ts").alias("end_us"), F.col("finished_ts").alias("at"))

    def release(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        end, urls, readies = state.get if state.exists else (None, [], [])
        still = list(zip(urls, readies))
        for pdf in batches:
            seen = pdf["end_us"].dropna()
            if len(seen):
                end = int(seen.min()) if end is None else min(end, int(seen.min()))
            new = pdf[pdf["ready_us"].notna()]
            still += [(u, int(t)) for u, t in zip(new["url"], new["ready_us"])]
        passed = state.getCurrentWatermarkMs() * 1000
        out, later = [], []
        for url, at in still:
            if end is not None:
                out.append((url, key[0], at, min(max(at, end), at + wait), end <= at + wait))
            elif at + wait < passed:
                out.append((url, key[0], at, at + wait, False))
            else:
                later.append((url, at))
        state.update((end, [u for u, _ in later], [t for _, t in later]))
        if later:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (min(t for _, t in later) + wait) // 1000 + 1))
        yield pd.DataFrame(out, columns=["url", "previous", "ready_us", "release_us", "has_memory"])

    both = waiting.unionByName(ends).withWatermark("at", late)
    held = both.groupBy("key").applyInPandasWithState(release, RELEASED, "end_us long, urls array<string>, readies array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    own = {c: ready.schema[c].dataType for c in ("url", "previous")}
    return free.unionByName(held.withColumns({c: F.col(c).cast(t) for c, t in own.items()}))


def append_once(stream: DataFrame, folder: str) -> DataFrame:
    """Run the available input of an append-mode stream into files and read them."""
    q = (stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows")
         .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
