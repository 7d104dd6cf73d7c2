"""Segments that fit the frame stay whole without Python."""

from stripweave.operators import strips


def test_only_tall_segments_are_cut(spark):
    heights = [100, 1080, 1081, 2000, 3500, 200, 1079]
    seg = spark.createDataFrame([(1, i, 5000 * i, 5000 * i + h) for i, h in enumerate(heights)], "strip long, segment int, y_start long, y_end long")
    near = spark.createDataFrame([(1, 5000 * i, 5000 * i + h, 5000 * i + r, 0.75) for i, h in enumerate(heights) for r in (333, 700, 1111) if r < h], "strip long, y_start long, y_end long, row long, strength double")
    for borders in (near, None):
        out = strips.split_to_frame(seg, borders, 800)
        want = []
        for i, h in enumerate(heights):
            cuts = strips.best_cuts(0, h, 800, [(r, 0.75) for r in (333, 700, 1111) if r < h] if borders is not None else [], 1920, 1080, 180)
            names = [None] if len(cuts) == 2 else ["top", *["middle"] * (len(cuts) - 3), "bottom"]
            want += [(1, i, 5000 * i + a, 5000 * i + b, n) for a, b, n in zip(cuts, cuts[1:], names)]
        assert sorted(tuple(r) for r in out.collect()) == sorted(want)
        fits = out._jdf.queryExecution().optimizedPlan().children().apply(1).toString()
        assert "MapInPandas" not in fits and "1080" in fits
    assert strips.split_to_frame(seg, None, 800, frame_h=0).count() == len(heights)
