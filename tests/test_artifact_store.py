"""Stores of many small chapters, and lists of one file a chapter."""

import glob

import pytest
from pyspark.sql import functions as F

from stripweave.sources import artifacts as ar


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_files_do_not_grow_with_chapters(spark, tmp_path, fmt):
    """Chapters that are written again lose their old members, all others stay, null and unlike ones too."""
    path = str(tmp_path / "store")
    rows = spark.range(600).select((F.col("id") / 2).cast("long").alias("ch"), (F.col("id") % 2).cast("int").alias("index"), F.lit("a").alias("emotion"))
    rows = rows.unionByName(spark.createDataFrame([(None, 0, "none")], "ch long, index int, emotion string"))
    ar.write_artifacts(rows, path, ["ch"], fmt)
    ar.write_artifacts(rows.where("ch % 3 = 0 and index = 1").withColumn("emotion", F.lit("b")), path, ["ch"], fmt)
    ar.write_artifacts(rows.where("ch is null").withColumn("emotion", F.lit("c")), path, ["ch"], fmt)
    ar.write_artifacts(rows.limit(0), path, ["ch"], fmt)
    found = spark.read.schema("ch long, index int, emotion string").format(fmt).load(path)
    want = [(c, i, "b" if c % 3 == 0 else "a") for c in range(300) for i in (0, 1) if i or c % 3] + [(None, 0, "c")]
    assert sorted(((r.ch, r["index"], r.emotion) for r in found.collect()), key=str) == sorted(want, key=str)
    assert len(glob.glob(f"{path}/*/part-*")) <= ar.PARTS


def test_store_keeps_what_other_writes_hold(spark, tmp_path):
    """Fields of chapters that are not in a later write stay, though that write lacks them; so does their text."""
    path = str(tmp_path / "store")
    old = spark.range(200).select("id", F.lit("2020-01-01T00:00:00.000Z").alias("at"), F.lit("1.10").alias("x"))
    ar.write_artifacts(old.withColumnRenamed("id", "ch"), path, ["ch"], "json")
    ar.write_artifacts(spark.range(50).select(F.col("id").alias("ch")), path, ["ch"], "json")
    assert sorted(r.value for r in spark.read.text(path).collect()) == sorted(
        f'{{"ch":{i}}}' if i < 50 else f'{{"ch":{i},"at":"2020-01-01T00:00:00.000Z","x":"1.10"}}' for i in range(200))
    path = str(tmp_path / "parquet")
    ar.write_artifacts(old.limit(0).withColumnRenamed("id", "ch"), path, ["ch"])
    ar.write_artifacts(old.withColumnRenamed("id", "ch"), path, ["ch"])
    ar.write_artifacts(spark.range(50).select(F.col("id").cast("long").alias("ch")), path, ["ch"])
    got = spark.read.option("mergeSchema", True).parquet(path)
    assert got.count() == 200 and got.where("at is null").count() == 50 == got.where("ch < 50 and x is null").count()


def test_chapter_of_a_stored_row(spark, tmp_path):
    """Rows know their chapter by its key; a line that cannot be read comes out with the folder it lies in."""
    path = str(tmp_path / "store")
    ar.write_artifacts(spark.createDataFrame([(7, 0, "x"), (None, 1, "y"), (8, None, "z")], "ch long, index int, emotion string"), path, ["ch"], "json")
    (tmp_path / "store" / "store_part=0").mkdir(exist_ok=True)
    (tmp_path / "store" / "store_part=0" / "part-bad.json").write_text('{"ch": 9, "ind\n')
    rows, bad = ar.read_artifacts(spark, path, "scenes", lines=True, schema="index int, emotion string", keys="ch long")
    assert sorted(((r.folder, r["index"], r.emotion) for r in rows.collect()), key=str) == [("ch=7", 0, "x"), (None, 1, "y")]
    assert sorted(r.folder for r in bad.collect()) == ["ch=8", "store_part=0"]


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    """Each file is read once, for rows and bad ones alike, and no folder costs a task of its own."""
    for i in range(100):
        (tmp_path / f"ch={i}").mkdir()
        (tmp_path / f"ch={i}" / "scenes.json").write_text(f'{{"scenes": [{{"index": {i}}}]}}' if i % 10 else '{"scenes": [')
    tracker, name = spark.sparkContext.statusTracker(), "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    was = spark.conf.get(name)
    spark.sparkContext.setJobGroup("listed", "listed")
    rows, bad = ar.read_artifacts(spark, str(tmp_path), "scenes")
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("listed")]
    tasks = [tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
    spark.sparkContext.setJobGroup("", "")
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism and spark.conf.get(name) == was
    for path in tmp_path.glob("*/scenes.json"):
        path.write_text("")
    assert sorted(r["index"] for r in rows.collect()) == [i for i in range(100) if i % 10] and bad.count() == 10


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_one_file_a_row(spark, tmp_path, scheme):
    df = spark.range(40).select(F.concat(F.lit("ch="), "id").alias("folder"), F.concat(F.lit("é"), "id").alias("value"))
    ar.write_files(df, f"{scheme}{tmp_path}/out", "a.json")
    assert {p.parent.name: p.read_text() for p in tmp_path.glob("out/*/*") if not p.name.startswith(".")} == {f"ch={i}": f"é{i}\n" for i in range(40)}
