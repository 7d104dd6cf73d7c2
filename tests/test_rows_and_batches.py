"""Captions, words and admissions as rows, against plain loops; streams over several batches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stripweave.functions import text as tx
from stripweave.operators import ledger as lg, partition as pt, texts, timeline as tl
from stripweave.streaming import ledgers as st


def test_captions_are_those_of_a_cursor(spark):
    random.seed(4)
    say = lambda n: " ".join("w" * random.randint(1, 9) + random.choice(["", "", "", ".", "!"]) for _ in range(n))
    rows = [(1, i, say(random.randint(0, 60)), "epic", float(random.randint(0, 50)), random.choice([0.0, 0.3, 2.0, 9.5])) for i in range(60)] + [(1, 90, None, "epic", 0.0, 3.0), (None, 0, "a b c. d e f", None, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "ch long, scene long, narration string, emotion string, start_s double, speech_s double")
    pieces = {(r.ch, r.scene): r.c for r in df.select("ch", "scene", tx.balanced_chunks(F.col("narration"), 4).alias("c")).collect()}
    want = []
    for ch, scene, _, _, at, length in rows:
        c, end = pieces[ch, scene] or [], at + length
        for i, piece in enumerate(c):
            stop = end if i == len(c) - 1 else min(at + max(length * len(piece) / sum(map(len, c)), 0.25), end)
            if length > 0 and stop > at:
                want.append((str(ch), scene, i, piece, round(at, 9), round(stop, 9)))
                at = stop
    got = tl.cues(df)
    assert sorted((str(r.ch), r.scene, r.cue, r.text, round(r.start_s, 9), round(r.end_s, 9)) for r in got.collect()) == sorted(want) and len(want) > 200

    cue = spark.createDataFrame([(1, 1, i, say(random.randint(0, 8)), float(i), i + random.choice([0.0, 0.0005, 1.5])) for i in range(80)], "ch long, scene long, cue long, text string, start_s double, end_s double")
    times = tl.word_times(cue)
    words, want = {}, []
    for r in cue.collect():
        w, done = r.text.split(), 0
        for i, x in enumerate(w if r.end_s > r.start_s else []):
            span, total = r.end_s - r.start_s, sum(map(len, w))
            lo = r.start_s + span * done / total
            done += len(x)
            hi = r.end_s if i == len(w) - 1 else min(r.end_s, r.start_s + span * done / total)
            want.append((r.cue, i, x, round(lo, 9), round(min(r.end_s, lo + 1e-3) if hi <= lo else hi, 9)))
            words.setdefault(r.cue, []).append(lo)
    assert sorted((r.cue, r.word, r.text, round(r.start_s, 9), round(r.end_s, 9)) for r in times.collect()) == sorted(want)
    asked = [(1, 1, c, c + random.random() * 3 - 1) for c in range(80) for _ in range(3)] + [(1, 1, 999, 4.0)]
    ask = spark.createDataFrame(asked + asked[:5], "ch long, scene long, cue long, t double")
    for hot in (False, True):
        got = {(r.cue, r.t): r.word for r in tl.word_at(times, ask, hot).collect()}
        assert got == {(c, t): max((i for i, lo in enumerate(words[c]) if lo <= t), default=-1) for _, _, c, t in asked if c in words}


@pytest.mark.parametrize("chunk", [None, "4"])
def test_admissions_over_batches(spark, tmp_path, chunk):
    """Three files read as three micro-batches give what one batch gives; a key that stays away keeps its last admissions."""
    random.seed(3)
    at, rows = 0, []
    for call in range(150):
        at += random.choice([0, 1, 5, 40])
        rows.append((None if call % 11 == 0 else 7 if 50 <= call < 100 else call % 2, call, at))
    schema = "key_id long, call_id long, t long"
    stamp = (F.lit(1_700_000_000) + F.col("t")).cast("timestamp").alias("ts")
    for n in range(3):
        spark.createDataFrame(rows[50 * n:50 * n + 50], schema).select("key_id", "call_id", stamp).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema("key_id long, call_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    if chunk:
        spark.conf.set("spark.stripweave.groupRows", chunk), spark.conf.set("spark.stripweave.chunkRows", chunk)
    try:
        got = [tuple(r) for r in st.admit_requests(stream, 3, 60, str(tmp_path / "out")).collect()]
    finally:
        if chunk:
            spark.conf.unset("spark.stripweave.groupRows"), spark.conf.unset("spark.stripweave.chunkRows")
    starts, want = {}, []
    for key, call, t in rows:
        own, a = starts.setdefault(key, []), (1_700_000_000 + t) * 1_000_000
        own.append(max(a, own[-3] + 60_000_000) if len(own) >= 3 else a)
        want.append((key, call, a, own[-1], own[-1] - a))
    assert sorted(got, key=str) == sorted(want, key=str)
    batch = lg.rate_admission(spark.createDataFrame(rows, schema).select("key_id", "call_id", stamp), 3, 60)
    assert sorted((tuple(r) for r in batch.collect()), key=str) == sorted(want, key=str)


def test_large_dictionary_by_distinct_words(spark):
    words = spark.createDataFrame([("Cat", "dog"), (" cat ", "late"), ("ré", "/re/"), ("gone", None)], "word string, value string")
    texts_ = [(1, "the cat, CAT the concat cat! gone"), (2, ""), (3, None), (4, "ré Ré"), (None, "a cat"), (5, "the the the")]
    df = spark.createDataFrame([(k, t, 0) for k, t in texts_], "id long, text string, _k int")
    got = {r["id"]: r["text"] for r in texts.apply_large_dictionary(df.drop("_k"), "id", "text", words).collect()}
    first = got[5]
    assert first == "the the the" and got[2] == "" and got[3] is None and got[None] in ("a dog", "a late")
    assert got[4] == "[ré](/re/) [ré](/re/)" and got[1].count("cat") == 1 and got[1].endswith("gone")


def test_chapter_without_a_valid_element(spark):
    lists = spark.createDataFrame([(1, 0, 0, 5, "x"), (2, 0, 0, 1, "...")], "ch long, element long, pos long, id long, text string")
    ids = spark.createDataFrame([(1, 4), (1, 5), (2, 1), (2, 2), (3, 1)], "ch long, id long")
    for hot in (False, True):
        assert {(r.ch, r.id): r.element for r in pt.assign_partition(lists, ids, hot).collect()} == {(1, 4): 0, (1, 5): 0, (2, 1): None, (2, 2): None, (3, 1): None}
