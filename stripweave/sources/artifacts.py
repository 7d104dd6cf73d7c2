"""Folders of small stage artifacts as tables, URL lists, pixel rows, and what is out of date."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Sequence
from contextlib import contextmanager
from functools import reduce
from operator import or_

import pyarrow as pa
from pyarrow import fs as files
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from stripweave.functions.ordered import number_rows
from stripweave.session import durable

# Declared schemas, one per artifact family.
SCHEMAS = {
    "panels": "index int, y_start long, y_end long, height int, width int, type string, part string, source_index int, file string",
    "scenes": "index int, panel_ids array<int>, narration string, emotion string, is_filler boolean, action_heavy_ids array<int>",
    "characters": "series string, series_title string, episode_no int, episode_title string, "
                  "characters array<struct<name: string, also_called: array<string>, who: string>>, tail string",
    "voiceover": "language string, sample_rate int, total_duration_s double, "
                 "items array<struct<scene_index: int, file: string, duration_s: double, speech_s: double>>",
    "timeline": "width int, height int, fps int, total_duration_s double, "
                "clips array<struct<scene_index: int, panel_index: int, start_s: double, duration_s: double, motion: string>>",
    "figures_map": "index int, x0 int, y0 int, x1 int, y1 int, reading_panels array<int>",
    "shots": "y0 long, y1 long, role string, pan boolean, source_block int",
    "reference": "label string, y0 long, y1 long",
}


# Families whose file is one object that holds the rows in a list of this name.
LISTED = {"scenes": "scenes", "reference": "crops"}


@contextmanager
def _listing(spark: SparkSession):
    """Folders are listed by a few tasks a core; Spark's own setting, a task for each, costs far more than the listing."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    was = spark.conf.get(name)
    spark.conf.set(name, str(min(int(was), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def read_artifacts(spark: SparkSession, path: str | Sequence[str], kind: str, lines: bool = False,
                   schema: str | None = None, keys: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of one artifact family and, apart, the files or rows that could not be read.

    Schemas are declared, never inferred; a bad file never fails the job. The chapter is the name of the
    folder (``ch=...`` partitions too). Files are read in the shape of their family: a list of rows, one object, or an
    object with a list (``LISTED``), whose members come out as rows. ``lines`` reads one row per line instead; there ``keys`` declares
    the columns that name the chapter in a store of :func:`write_artifacts`, which then make its folder (``ch=...``).
    """
    rows = T.StructType.fromDDL(schema or SCHEMAS[kind])
    named = T.StructType.fromDDL(keys).fields if keys else []
    listed = None if lines else LISTED.get(kind)
    want = (T.StructType([T.StructField(listed, T.ArrayType(rows))]) if listed else T.StructType(rows.fields + named)).add("_bad", T.StringType())
    with _listing(spark):
        df = (spark.read.schema(want).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
              .option("multiLine", not lines).json(path))
    df = df.select(*want.names, F.col("_metadata.file_path").alias("_path"))  # a family may have a file of its own
    df = df.withColumn("folder", F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1))
    if not lines:
        df = durable(df)  # opening a small file costs far more than its bytes: each once, for rows and bad ones
    if named:
        key = F.concat_ws("/", *[F.concat(F.lit(f"{k.name}="), F.col(k.name).cast("string")) for k in named])
        df = df.withColumn("folder", F.when(F.col("_bad").isNull(), F.when(~reduce(or_, [F.col(k.name).isNull() for k in named]), key)).otherwise(F.col("folder")))
    # a row without its first field is as useless as an unparsable one
    first = rows.fields[0].name
    broken = F.col("_bad").isNotNull() | F.col(want.fields[0].name).isNull()
    bad = df.filter(broken).select("folder", "_bad", F.col("_path").alias("file"))
    if listed is None:
        return df.filter(~broken).drop("_bad", "_path"), bad
    each = df.filter(~broken).select("folder", F.col("_path").alias("file"), F.explode(listed).alias("_row"))
    lost = F.col(f"_row.{first}").isNull()
    return each.filter(~lost).select("_row.*", "folder"), bad.unionByName(each.filter(lost).select("folder", F.to_json("_row").alias("_bad"), "file"))


def duplicate_index(rows: DataFrame, keys: Sequence[str] = ("folder", "index")) -> DataFrame:
    """Members given twice in one artifact; any is an error of the file."""
    return rows.groupBy(*keys).count().filter("count > 1")


#: Folders of a store; never to be changed for a store that exists.
PARTS = 64


def write_artifacts(df: DataFrame, path: str, keys: Sequence[str], fmt: str = "parquet") -> None:
    """Replace the artifacts of exactly the chapters in ``df``; members they no longer have disappear.

    Chapters lie in ``PARTS`` folders by a hash of their ``keys``, which stay columns: files grow with bytes, not with chapters.
    Only the folders of chapters in ``df`` are written again, each in one commit, their other chapters as they were: JSON line for
    line, other formats with all their columns. A folder too large for one task is split over several by adaptive
    execution, which gives it several files.
    """
    lines = fmt == "json"
    names = [f"_key{i}" for i in range(len(keys))]
    new = _keyed(df.select(F.to_json(F.struct(*df.columns)).alias("value")) if lines else df, keys, lines)
    new = new.withColumn("store_part", F.pmod(F.xxhash64(*names), F.lit(PARTS)).cast("int"))
    old = _stored_rows(df.sparkSession, path, lines, fmt)
    if old is not None:
        new = durable(new)
        known = new.select(*[F.col(n).alias(f"_new{n}") for n in names]).distinct()
        touched = [r.store_part for r in new.select("store_part").distinct().collect()]  # at most ``PARTS`` numbers
        kept = _keyed(old, keys, lines).where(F.col("store_part").isin(touched)).join(known, [F.col(n).eqNullSafe(F.col(f"_new{n}")) for n in names], "left_anti")
        new = kept.unionByName(new, allowMissingColumns=True)
    (new.drop(*names).hint("rebalance", "store_part").write.partitionBy("store_part").mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").format("text" if lines else fmt).save(path))


def write_files(df: DataFrame, path: str, name: str) -> None:
    """Rows ``(folder, value)`` as one small file each, ``path/folder/name``; a file appears whole or not at all.

    Tasks write through Arrow's file systems, since Spark's writer starts two processes for each file of a local folder. A path that
    Arrow does not know goes through Spark's writer, where the folder must be ``column=value``.
    """
    root = re.sub(r"^file:/(?!/)", "file:///", path)
    try:
        files.FileSystem.from_uri(root)
    except (pa.ArrowInvalid, ImportError, OSError):
        column = df.select(F.split_part("folder", F.lit("="), F.lit(1))).first()
        if column is not None:
            df.select("value", F.split_part("folder", F.lit("="), F.lit(2)).alias(column[0])).write.partitionBy(column[0]).text(path)
        return

    def write(rows: Iterable[Row]) -> None:
        fs, base = files.FileSystem.from_uri(root)
        for r in rows:
            folder = f"{base}/{r.folder}"
            fs.create_dir(folder)
            new = f"{folder}/.{name}-{uuid.uuid4().hex}"
            with fs.open_output_stream(new) as out:
                out.write(r.value.encode() + b"\n")
            fs.move(new, f"{folder}/{name}")

    df.select("folder", "value").foreachPartition(write)


def _keyed(rows: DataFrame, keys: Sequence[str], lines: bool) -> DataFrame:
    """The rows of a store with their keys as text, which JSON lines hold inside."""
    key = F.from_json("value", T.StructType([T.StructField(k, T.StringType()) for k in keys])) if lines else None
    return rows.withColumns({f"_key{i}": key[k] if lines else F.col(k).cast("string") for i, k in enumerate(keys)})


def _stored_rows(spark: SparkSession, path: str, lines: bool, fmt: str) -> DataFrame | None:
    """What a store holds, JSON as lines; none where there is no store yet."""
    try:
        return spark.read.schema("value string, store_part int").text(path) if lines else spark.read.format(fmt).option("mergeSchema", True).load(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_url_list(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """URLs of text files: trimmed, without blanks, comments and repeats; the first position counts.

    A position is (file, block, line in the block), so lines keep their order however files are split.
    """
    raw = spark.read.text(path).select(
        F.regexp_replace("value", r"(?U)^[\s\x{FEFF}]+|\s+$", "").alias("url"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    kept = raw.filter((F.col("url") != "") & ~F.col("url").startswith("#"))
    first = kept.groupBy("url").agg(F.min(F.struct("file", "_b", "_i")).alias("_p"))
    flat = first.select("url", "_p.file", "_p._b", "_p._i")
    return number_rows(flat, ["file"], ["_b", "_i"], "pos").select("url", "file", "pos")


def chapter_catalog(timelines: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chapters ``(folder)`` that have a timeline, with their episode, by (episode, folder); none at all is an error."""
    have = chapters.select("folder", "episode_no").groupBy("folder").agg(F.max("episode_no").alias("episode_no"))
    out = timelines.select("folder").distinct().join(have, "folder", "left").withColumn("episode_no", F.coalesce("episode_no", F.lit(0)))
    if out.isEmpty():
        raise ValueError("no chapter has a timeline")
    return out.orderBy("episode_no", "folder")


# Weights of red, green and blue in 1/16384.
GREY = (4899, 9617, 1868)


def grey(r: Column, g: Column, b: Column) -> Column:
    """Grey level of 8-bit colours."""
    return F.shiftright(r * GREY[0] + g * GREY[1] + b * GREY[2] + 8192, 14)


def to_bytes(xs: Column) -> Column:
    """Pixel values as whole numbers 0..255: an array within [0, 1] is scaled, any other is clipped."""
    plain = F.transform(xs, lambda x: F.when(x.isNull() | F.isnan(x.cast("double")), 0.0).otherwise(x.cast("double")))
    unit = (F.array_min(plain) >= 0) & (F.array_max(plain) <= 1)
    return F.transform(F.zip_with(plain, F.array_repeat(unit, F.size(xs)), lambda x, u: F.when(u, x * 255).otherwise(x)),
                       lambda x: F.bround(F.least(F.lit(255.0), F.greatest(F.lit(0.0), x))).cast("int"))


def read_strip_rows(spark: SparkSession, path: str) -> DataFrame:
    """Pixel rows ``(strip, y, px)`` from Parquet; colour rows ``(strip, y, r, g, b)`` become grey."""
    df = spark.read.parquet(path)
    if "px" in df.columns:
        return df.select("strip", "y", "px")
    return grey_rows(df)


def grey_rows(df: DataFrame) -> DataFrame:
    rg = F.zip_with("r", "g", lambda r, g: F.struct(r.alias("r"), g.alias("g")))
    return df.select("strip", "y", F.zip_with(rg, F.col("b"), lambda x, b: grey(x["r"], x["g"], b)).alias("px"))


# --- A6 --------------------------------------------------------------------------------------
def row_digest(*cols: Column | str) -> Column:
    return F.sha2(F.concat_ws("\u0000", *cols), 256)


def group_digest(df: DataFrame, keys: Sequence[str], *cols: Column | str) -> DataFrame:
    """Fingerprint of all rows of a group, in any order: four sums over the parts of the rows' SHA-256.

    The sums combine before the shuffle, so a group of any size costs one small row per task. Put the
    position among ``cols`` where order matters.
    """
    h = df.select(*keys, row_digest(*cols).alias("_h"))
    lanes = [F.sum(F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return h.groupBy(*keys).agg(F.sha2(F.concat_ws("\u0000", F.count(F.lit(1)).cast("string"), *[x.cast("string") for x in lanes]), 256).alias("digest"))


def stale_inputs(current: DataFrame, done: DataFrame, keys: Sequence[str], version: str, options: str = "") -> DataFrame:
    """Inputs ``(keys, digest)`` whose output is missing or was made from other input, options or version.

    ``done`` is ``(keys, mark)`` with the mark of :func:`made_from`.
    """
    marked = made_from(current, version, options)
    return marked.join(done.select(*keys, "mark"), [*keys, "mark"], "left_anti")


def made_from(current: DataFrame, version: str, options: str = "") -> DataFrame:
    return current.withColumn("mark", row_digest(F.lit(version), F.lit(options), "digest"))
