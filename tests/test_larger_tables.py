"""Rows that only larger tables hold, and plans that must not grow faster than their input."""

import pytest

import __spark_entry__ as entry
from stripweave.functions.html import page_facts
from stripweave.functions.ordered import median_by
from stripweave.operators import partition as pt, web


def test_reference_without_semicolon_is_text():
    assert page_facts("<title>a&amp;&lt;b &amp</title>").found("title") == "a&<b &amp"
    assert page_facts('<a href="/v?a=1&copy=2&amp;b=3">x</a>').links == ["/v?a=1&copy=2&b=3"]
    assert page_facts("<title>&ampx; &eacute; &#39; &#x41;</title>").found("title") == "&ampx; é ' A"


def test_page_title_with_open_reference(spark):
    pages = spark.createDataFrame([(1, "http://h/a", "<title>One &amp;&amp - Two&am</title>")], "page_id long, url string, html string")
    assert [tuple(r) for r in web.page_titles(web.parse_pages(pages)).select("series", "episode").collect()] == [("One &&amp", "Two&am")]


def test_words_of_patterns_end_at_any_letter_but_a_to_z(spark):
    rows = [(1, i, t) for i, t in enumerate(["One.", "Go pourè on. Stay.", "Three."])]
    df = spark.createDataFrame(rows, "ch long, idx int, text string")

    def texts(**kw):
        return [r["text"] for r in pt.script_conventions(df, r"\b(?:pour)\b", [], own="", **kw).orderBy("idx").collect()]

    assert texts() == ["One.", "Go pourè on. Stay.", "Three."]
    assert texts(ascii_words=True) == ["One.", "Stay.", "Three."]


def plan_counts(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return {k: text.count(k) for k in ("Window [", "SortMergeJoin", "BroadcastHashJoin", "MapInPandas", "MapInArrow")}


def test_reference_matching_reads_panels_once(spark, data):
    assert plan_counts(entry.queries()["e15_match_references"](spark, data))["Window ["] == 0  # before: 14
    assert plan_counts(entry.queries()["e16_evaluation_summary"](spark, data))["Window ["] <= 3  # the totals of a median's ranges


def test_frames_are_not_shuffled(spark, data):
    df = entry.queries()["h17_sample_timeline"](spark, data)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert not any("frame" in line for line in text.splitlines() if "Join" in line)


def test_median_of_many_equal_values(spark):
    df = spark.createDataFrame([(1, float(x)) for x in [3] * 7 + [1] * 5 + [9] * 2] + [(2, 4.0), (2, 5.0), (None, 2.0)], "k int, v double")
    assert {(r.k, r.m) for r in median_by(df, ["k"], "v", "m", True).collect()} == {(1, 3.0), (2, 4.5), (None, 2.0)}


def test_pages_are_parsed_in_slices_and_images_by_one_worker(spark, data):
    assert plan_counts(entry.queries()["b2_page_image_urls"](spark, data))["MapInPandas"] == 0
    assert plan_counts(entry.queries()["b2_page_image_urls"](spark, data))["MapInArrow"] == 1


def test_an_asset_of_many_chapters_lies_in_several_copies(spark, monkeypatch):
    from stripweave.operators import signal as sg

    voice = spark.range(40).selectExpr("id as ch", "0L as i", "0.0D as v").unionByName(spark.range(40).selectExpr("id as ch", "1L as i", "0.0D as v"))
    sounds = spark.range(40).selectExpr("id as ch", "0 as n", "'x' as asset", "0.0D as start_s", "0.0D as gain_db")
    music = spark.range(40).selectExpr("id as ch", "0 as n", "'m' as asset", "0.0D as start_s", "1.0D as duration_s", "0.0D as fade_in_s", "0.0D as fade_out_s", "0.0D as gain_db")
    assets = spark.createDataFrame([("x", 0, 0.25), ("x", 1, 0.5), ("m", 0, 0.125)], "asset string, i long, v double")
    whole = sg.mix_tracks(voice, music, sounds, assets, 2).collect()
    monkeypatch.setattr(sg, "USES", 3)
    parted = sg.mix_tracks(voice, music, sounds, assets, 2)
    assert "_part" in parted._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, parted.collect())) == sorted(map(tuple, whole))
    assert {(r.i, r.v) for r in whole} == {(0, 0.375), (1, 0.625)}


def test_claims_read_panels_once(spark, data):
    assert plan_counts(entry.queries()["f5_claim_keyframes"](spark, data))["Window ["] == 0  # before: 23
    assert plan_counts(entry.queries()["f4_candidates_topk"](spark, data))["Window ["] <= 4  # before: 8
    assert plan_counts(entry.queries()["e19_remap_ids"](spark, data))["Window ["] <= 2  # before: 7


def test_boxes_side_by_side_are_alone(spark):
    """Common rows but no common columns: such boxes cannot meet, so none of them goes through Python; before, all did."""
    from stripweave.operators import boxes as bx

    rows = [(1, i, 100 * i, 5 * i, 100 * i + 50, 200, "head", 0.5, "s0") for i in range(4)] + [(1, 4, 120, 6, 160, 190, "head", 0.25, "s1")]
    df = spark.createDataFrame(rows, "block long, idx long, x0 int, y0 int, x1 int, y1 int, kind string, score double, source string")
    alone, crowd, by, _ = bx.regions(df, ["block", "kind"], False, sides=True)
    assert sorted(r.idx for r in alone.collect()) == [0, 2, 3] and sorted(r.idx for r in crowd.collect()) == [1, 4]
    assert sorted((r.x0, r.x1, r.score, r.source) for r in bx.fuse_boxes(df, hot=False).collect()) == [
        (0, 50, 0.5, "s0"), (100, 160, 0.5, "s0+s1"), (200, 250, 0.5, "s0"), (300, 350, 0.5, "s0")]


def test_sampled_frames_move_lines_once(spark, data):
    """Every branch starts from the one exchange of lines by chapter; before, clips, spans and their pieces were exchanged by other keys too."""
    plan = entry.queries()["h17_sample_timeline"](spark, data)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange " in line]
    assert moved and all("hashpartitioning(l_orderkey" in line for line in moved)


@pytest.mark.parametrize("hot", [False, True])
def test_sampled_frames_by_hand(spark, hot):
    """Null chapters, repeated clips, spans longer than a stretch and chapters without a total, against plain loops."""
    from stripweave.operators import timeline as tl

    clips = [(1, 0, 0.0, 90.0, "punch_in", 0.5), (1, 1, 90.0, 0.25, "ken_burns", None), (1, 2, 90.25, 70.0, "fast_pan", 0.5), (2, 0, 1.5, 2.0, "ken_burns", None), (2, 0, 1.5, 2.0, "ken_burns", None),
             (None, 0, 0.0, 2.0, "punch_in", None), (3, 0, 0.0, 9.0, "punch_in", None), (4, None, 0.0, 1.0, "punch_in", None)]
    cue = [(1, 0, 3.0, 150.0), (1, 1, 149.0, 151.0), (1, 2, 5.0, 5.0), (2, 0, 0.0, 9.0), (None, 0, 0.0, 9.0), (3, 0, 0.0, 9.0), (4, 0, 0.0, 9.0)]
    effects = [(1, 7, 0.0, 1000.0), (2, 7, 2.0, 2.5)]
    totals = [(1, 160.25), (2, 4.0), (None, 2.0), (4, 1.0)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = tl.sample_timeline(frame(clips, "ch int, clip int, start_s double, duration_s double, motion string, transition_s double"), frame(cue, "ch int, n int, start_s double, end_s double"),
                             frame(effects, "ch int, n int, start_s double, end_s double"), frame(totals, "ch int, total_s double"), 2.0, hot=hot)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = []
    for ch, total in totals:
        own = sorted((c for c in clips if c[0] == ch), key=lambda c: (c[2], key((c[1],))))
        for i, c in enumerate(own):
            for f in range(round(total * 2)):
                if (i == 0 or f / 2 >= c[2]) and (i + 1 == len(own) or f / 2 < own[i + 1][2]):
                    at = lambda spans: [s[1] for s in spans if None not in (ch, c[1]) and s[0] == ch and s[2] <= f / 2 < s[3]] or [None]
                    want += [(ch, f, c[1], a, b) for a in at(cue) for b in at(effects)]
    got = [(r.ch, r.frame, r.clip, r.cue, r.effect) for r in out.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert len({f for ch, f, *_ in got if ch == 1}) == 320


def test_panels_keep_their_file(spark, tmp_path):
    """A family's own column named file is not the path it was read from."""
    from stripweave.sources import artifacts as ar

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "panels.json").write_text('[{"index": 0, "file": "p0.webp"}, {"y_start": 7}]')
    rows, bad = ar.read_artifacts(spark, str(tmp_path / "a" / "panels.json"), "panels")
    assert [(r.folder, r["index"], r.file) for r in rows.collect()] == [("a", 0, "p0.webp")]
    assert [r.file.rsplit("/", 2)[1:] for r in bad.collect()] == [["a", "panels.json"]]
