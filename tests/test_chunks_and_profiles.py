"""Rules that are cut into chunks, regions or stretches give what one plain pass gives; edge profiles are the plain stencil."""

import bisect
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stripweave.functions import ordered as o
from stripweave.operators import boxes as bx, memory as mm, partition as pt, strips, timeline as tl
from stripweave.plans import views as v


@pytest.fixture(params=[False, True])
def hot(spark, request):
    if request.param:
        request.getfixturevalue("chunked")
    return request.param


def test_spread_in_two_levels(spark):
    df = spark.createDataFrame([(1, 0, 10, 1), (2, 5, 4, 1), (3, -3, 40, 7), (4, None, 3, 1), (5, 0, 200, 1)], "k int, a long, b long, s long")
    got = defaultdict(list)
    for r in o.spread(df, F.col("a"), F.col("b"), F.col("s"), "n", span=4).collect():
        got[r.k].append(r.n)
    assert {k: sorted(v) for k, v in got.items()} == {1: list(range(11)), 3: list(range(-3, 41, 7)), 5: list(range(201))}


def test_null_chapters_share_time(spark, hot):
    rows = [(ch, 0, i, 400 + 50 * i, i == 1, 6.0) for ch in (None, 1) for i in range(3)]
    df = spark.createDataFrame(rows, "ch long, scene int, panel long, height int, heavy boolean, duration_s double")
    got = {(r.ch, r.panel): round(r.share_s, 9) for r in tl.share_time(df).collect()}
    assert len(got) == 6 and all(got[None, i] == got[1, i] for i in range(3)) and abs(sum(got[1, i] for i in range(3)) - 6) < 1e-9
    shots = Counter(r.ch for r in tl.short_shots(df).collect())
    assert shots[None] == shots[1] > 0


def test_capacity_groups(spark, hot):
    r = random.Random(2)
    rows = [(ch, i, r.choice([0, 1, 2, 5, 9, 12])) for ch in (None, 1, 2) for i in range(r.randint(1, 40))]
    want = {}
    for ch in (None, 1, 2):
        load, group = 0, -1
        for _, i, x in sorted(x for x in rows if x[0] == ch) if ch is not None else [x for x in rows if x[0] is None]:
            if group < 0 or load + x > 10:
                load, group = 0, group + 1
            load += x
            want[ch, i] = group
    got = {(x.ch, x.idx): x.grp for x in pt.capacity_groups(spark.createDataFrame(rows, "ch long, idx long, load long"), 10).collect()}
    assert got == want


@pytest.mark.parametrize("fan", [2, 64])
def test_best_so_far(spark, hot, fan, monkeypatch):
    monkeypatch.setattr(mm, "FAN", fan)
    r = random.Random(fan)
    events, asked, want = [], [], {}
    for series in ("a", "b", None):
        count, best = Counter(), []
        for ep in range(60):
            asked.append((series, ep))
            for rank, (n, i) in enumerate(best[:3]):
                want[series, ep, rank] = (i, -n)
            for i in r.sample(range(12), 2 if ep % 7 else 0):
                count[i] += 1
                events.append((series, ep, i, count[i]))
            best = sorted((-n, i) for i, n in count.items())
    line = spark.createDataFrame(events, "series string, ep long, ord long, n long")
    got = mm._prefix_top(line, spark.createDataFrame(asked, "series string, ep long"), 3, hot).collect()
    assert {(x.series, x.ep, x["rank"]): (x.ord, x.hits) for x in got} == want


def test_longest_runs_point_back(spark, hot):
    r = random.Random(8)
    rows, kept = [], {}
    for ch in range(12):
        ids = r.sample(range(60), r.randint(3, 25))
        rows += [(ch, n, x) for n, x in enumerate(ids)]
        ends = []
        for x in ids:
            k = bisect.bisect_left(ends, x)
            ends[k : k + 1] = [x]
        kept[ch] = len(ends)
    panels = spark.createDataFrame([(ch, i, 10 + i % 7) for ch in range(12) for i in range(60)], "ch long, id long, height long")
    out = defaultdict(list)
    for x in pt.enforce_order(spark.createDataFrame(rows, "ch long, par long, id long"), panels).collect():
        out[x.ch].append((x.par, x.id))
    for ch, own in out.items():
        assert sum((ch, p, i) in set(rows) for p, i in own) >= kept[ch] and len(own) == len({p for p, _ in own})


def test_edge_profile_is_the_plain_stencil(spark, hot):
    rng = np.random.default_rng(3)
    images = {1: rng.integers(0, 255, (40, 25)), 2: rng.integers(0, 255, (1, 9)), 3: rng.integers(0, 255, (6, 1)), 4: np.zeros((5, 5), int)}
    rows = [(k, y, [int(x) for x in row]) for k, g in images.items() for y, row in enumerate(g)]
    df = spark.createDataFrame(rows, "strip int, y long, px array<int>")
    for axis in (0, 1):
        got = {(r.strip, r.x): r.v for r in strips.edge_profile(df, axis).collect()}
        want = {}
        for k, g in images.items():
            p = np.pad(g.astype(float), [(1, 1) if n > 1 else (0, 0) for n in g.shape], mode="reflect")
            p = np.pad(p, [(0, 0) if n > 1 else (1, 1) for n in g.shape], mode="edge")
            e = np.abs(2 * (p[:-2, :-2] + p[:-2, 2:] + p[2:, :-2] + p[2:, 2:]) - 8 * p[1:-1, 1:-1])
            v = e.sum(axis=axis)
            w = max(1, int(len(v) * 0.06) | 1)
            v = np.convolve(v, np.ones(w) / w, mode="same") if 1 < w < len(v) else v
            want |= {(k, x): y / v.max() if v.max() > 0 else y for x, y in enumerate(v)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_fusion_takes_one_box_after_the_other(spark, hot):
    r = random.Random(6)
    rows, want = [], []

    def joins(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        common = max(0, w) * max(0, h)
        areas = [(x[2] - x[0]) * (x[3] - x[1]) for x in (a, b)]
        return common / (sum(areas) - common) >= 0.3 or common / min(areas) >= 0.6

    for block in range(8):
        own = []
        for i in range(14):
            x, y = r.randint(0, 60), r.randint(0, 90)
            own.append((block, i, x, y, x + r.randint(5, 40), y + r.randint(5, 30), "bubble", r.random(), f"s{i % 3}"))
        rows += own
        shelf = []
        for b in sorted(own, key=lambda b: (-b[7], b[3], b[2])):
            box = b[2:6]
            while (k := next((n for n, s in enumerate(shelf) if joins(s, box)), None)) is not None:
                s = shelf.pop(k)
                box = (min(s[0], box[0]), min(s[1], box[1]), max(s[2], box[2]), max(s[3], box[3]))
            shelf.append(box)
        want += [(block, *s) for s in shelf]
    df = spark.createDataFrame(rows, "block long, idx long, x0 int, y0 int, x1 int, y1 int, kind string, score double, source string")
    assert sorted((b.block, b.x0, b.y0, b.x1, b.y1) for b in bx.fuse_boxes(df).collect()) == sorted(want)


def test_block_plans_of_every_mode(spark):
    blocks = [(0, 50, 40, "text_only"), (1, 200, 40, "key"), (2, 200, 40, "key"), (3, 60, 40, "key"), (4, 60, 40, "transition")]
    boxes = [(1, 0, 0, 10, 30, 60, "head", 0.5), (1, 1, 0, 100, 30, 130, "head", 0.5), (2, 0, 0, 5, 30, 190, "bubble", 0.5), (3, 0, 0, 20, 30, 30, "head", 0.5)]
    zones = [(1, 0, "keep", 5, 140, "", 2), (2, 0, "keep", 5, 190, "", 2), (3, 0, "keep", 18, 32, "", 2)]
    height = {b[0]: b[1] for b in blocks}
    out = bx.plan_blocks(
        spark.createDataFrame(blocks, "block long, height int, width int, role string"),
        spark.createDataFrame(boxes, "block long, idx long, x0 int, y0 int, x1 int, y1 int, kind string, score double"),
        spark.createDataFrame(zones, "block long, zone long, list string, y0 int, y1 int, kind string, priority int"),
        spark.createDataFrame([(b, y, 0.0) for b, h in height.items() for y in range(h)], "block long, y long, energy double")).collect()
    modes = {r.block: r["mode"] for r in out}
    assert modes == {0: "none", 1: "multi", 2: "pan", 3: "single", 4: "none"}
    chain = sorted((r.y0, r.y1) for r in out if r.block == 1)
    assert chain[0][0] <= 10 and chain[-1][1] >= 130 and all(a[1] == b[0] for a, b in zip(chain, chain[1:]))
    one = next(r for r in out if r.block == 3)
    assert one.y0 <= 20 and one.y1 >= 30 and not one.relaxed


def test_wide_rows_meet_their_number(spark, hot):
    """Null and repeated values are numbered like others; equal rows share the numbers of their stretch in any order."""
    r = random.Random(9)
    rows = [(k, r.choice([None, 1, 2, 3, 5, 8, 9]), f"text {i}") for i, k in enumerate(r.choices(["a", "b", None], k=60))]
    df = spark.createDataFrame(rows, "k string, at long, text string")
    got = o.number_wide(df, ["k"], ["at"], "n", hot).collect()
    assert sorted(x.text for x in got) == sorted(t for _, _, t in rows)
    for k in ("a", "b", None):
        own = sorted((x.n, -1 if x["at"] is None else x["at"]) for x in got if x.k == k)
        assert [n for n, _ in own] == list(range(len(own))) and [a for _, a in own] == sorted(a for _, a in own)


def test_cards_without_description_move_no_texts(spark, tmp_path):
    """Names and numbers come without the texts; with them each text is moved once, by its own values and not by its series."""
    spark.createDataFrame([(i, f"Name{i % 3} Alias rest {i}", f"s{i % 2}") for i in range(12)], "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))

    def windows(node):
        """Keys and columns of every window of a plan."""
        if node.getClass().getSimpleName() == "Window":
            yield node.partitionSpec().toString(), node.output().toString()
        for i in range(node.children().size()):
            yield from windows(node.children().apply(i))

    of = lambda df: list(windows(df._jdf.queryExecution().optimizedPlan()))
    cards = v.cards(spark, str(tmp_path))
    thin = cards.select("series", "ep", "name", "alias")
    assert of(thin) and not any("text" in out or "who" in out for _, out in of(thin))
    assert any("who" in out for _, out in of(cards)) and not any("source" in key and "who" in out for key, out in of(cards))
    assert sorted((x.series, x.ep, x.name, x.alias, x.who) for x in cards.collect()) == sorted((f"s{i % 2}", i // 2 + 1, f"Name{i % 3}", "Alias", f"Name{i % 3} Alias rest {i}") for i in range(12))


def test_walks_of_small_series_are_bounded(spark, monkeypatch):
    """A series that is small enough for plain windows still is walked chunk by chunk, since each question gives k rows."""
    spark.conf.set("spark.stripweave.chunkRows", "16")
    sizes = []
    plain = mm.fold

    def watched(df, keys, *rest):
        sizes.extend(x["n"] for x in df.groupBy(*keys).agg(F.count("*").alias("n")).collect())
        return plain(df, keys, *rest)

    monkeypatch.setattr(mm, "fold", watched)
    try:
        rows = [("s", ep, 0, f"n{ep % 5}", [], "w") for ep in range(1, 101)]
        cards = spark.createDataFrame(rows, "series string, ep long, pos long, name string, aliases array<string>, who string")
        got = {(x.ep, x["rank"]): (x.name, x.hits) for x in mm.series_cards(cards, 3, False).collect()}
    finally:
        spark.conf.unset("spark.stripweave.chunkRows")
    assert max(sizes) <= 16 + 3
    for ep in range(1, 101):
        count = Counter(f"n{e % 5}" for e in range(1, ep))
        best = sorted(count.items(), key=lambda x: (-x[1], (int(x[0][1:]) - 1) % 5))[:3]
        assert [got.get((ep, i)) for i in range(3)] == [*best, None, None, None][:3]


def test_tails_are_cut_before_they_are_moved(spark):
    sheets = spark.createDataFrame([("s", 1, "word " * 200), ("s", 2, None)], "series string, ep long, tail string")
    cards = spark.createDataFrame([("s", 1, 0, "Kang", [], "w")], "series string, ep long, pos long, name string, aliases array<string>, who string")
    asked = spark.createDataFrame([("s", 1), ("s", 2), ("s", 3)], "series string, ep long")
    out = mm.series_context(cards, sheets, asked, hot=False)
    assert {x.ep: x.tail for x in out.collect()} == {1: "", 2: " ".join(["word"] * 64) + "...", 3: ""}
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Window [", 1)
    assert len(above) == 2 and "[^ ]*$" not in above[0] and "[^ ]*$" in above[1]
