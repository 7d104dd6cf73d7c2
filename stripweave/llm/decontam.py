"""Benchmark decontamination (3): a broadcast set of the test items' word windows, scanned over whole documents.

A window is ``size`` consecutive words of an item; an item of fewer words, but not none, is one window.
Documents of any length are scanned whole. Null and empty texts have no words and no hits; items with a
null id or without words are left out; repeated items count once per id; repeated documents are judged each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import common
from .common import U64, binary, bounds, lists, text_words, word_array

SIZE = 13
#: The most item words whose windows are broadcast (about 200 MB in a worker); more go by a join on the windows.
MAX_ITEM_WORDS = 1_000_000
RESULT = "struct<n_words: bigint, n_hit: bigint, spans: array<struct<first: int, last: int>>, items: array<bigint>>"
_CHUNK = 500_000


class Grams:
    """The windows of all items as rows of word numbers, found by hash and confirmed word by word."""

    def __init__(self, items: list[tuple[int, bytes | None]], size: int):
        self.vocab: dict[bytes, int] = {}
        of: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            words = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in text_words(text)]
            n = min(size, len(words))
            for i in range(len(words) - n + 1 if n else 0):
                of.setdefault(tuple(words[i : i + n]), set()).add(item)
        self.by_length = []
        for n in sorted({len(g) for g in of}):
            grams = [g for g in of if len(g) == n]
            rows, salt = np.array(grams, np.int64), 1
            while len(np.unique(keys := self._keys(rows, salt))) < len(rows):
                salt += 1
            order = np.argsort(keys)
            self.by_length.append((n, salt, keys[order], rows[order], [sorted(of[grams[i]]) for i in order]))

    @staticmethod
    def _keys(rows: np.ndarray, salt: int) -> np.ndarray:
        h = np.full(len(rows), salt, U64)
        for column in rows.T:
            h = common.mix(h * U64(0x9E3779B97F4A7C15) + column.astype(U64))
        return h

    def scan(self, texts: list[bytes | None]) -> pa.StructArray:
        counts, spans, found = [], [], []
        for part in _parts(texts):
            c, s, f = self._scan(part)
            counts += c
            spans += s
            found += f
        n_hit = [sum(b - a for a, b in s) for s in spans]
        pairs = np.array([p for s in spans for p in s], np.int32).reshape(-1, 2)
        span = pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["first", "last"])
        return pa.StructArray.from_arrays(
            [
                pa.array(counts, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.ListArray.from_arrays(pa.array(bounds([len(s) for s in spans]), pa.int32()), span),
                lists(np.array([i for f in found for i in sorted(f)], np.int64), [len(f) for f in found], pa.int64()),
            ],
            ["n_words", "n_hit", "spans", "items"],
        )

    def _scan(self, texts):
        get = self.vocab.get
        words = [text_words(t) for t in texts]
        counts = [len(w) for w in words]
        start = bounds([n + 1 for n in counts])  # one 0 after each text, so no window crosses
        ids = np.zeros(start[-1], np.int64)
        for a, w in zip(start, words):
            ids[a : a + len(w)] = [get(x, 0) for x in w]
        known = ids > 0
        stop = np.flatnonzero(~known)
        here = np.flatnonzero(known)
        run = stop[np.searchsorted(stop, here)] - here if len(stop) else here
        edge = np.zeros(len(ids) + 1, np.int64)
        found: list[set[int]] = [set() for _ in texts]
        for n, salt, keys, rows, items in self.by_length:
            at = here[run >= n]
            if not len(at):
                continue
            seen = ids[at[:, None] + np.arange(n)]
            h = self._keys(seen, salt)
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            same = keys[k] == h
            at, k, seen = at[same], k[same], seen[same]
            same = (rows[k] == seen).all(axis=1)
            at, k = at[same], k[same]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + n, -1)
            for d, g in zip(np.searchsorted(start, at, "right") - 1, k):
                found[d].update(items[g])
        hit = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
        turn = np.flatnonzero(hit[1:] != hit[:-1]).reshape(-1, 2)
        doc = np.searchsorted(start, turn[:, 0], "right") - 1
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        for d, (a, b) in zip(doc, turn):
            spans[d].append((a - start[d], b - start[d]))
        return counts, spans, found


def _parts(texts, chars: int = 4 * _CHUNK):
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t or b"")
        if n > chars:
            yield part
            part, n = [], 0
    if part:
        yield part


def overlaps(docs: DataFrame, benchmark: DataFrame, *, size: int = SIZE, text: str = "text", into: str = "overlap",
             max_item_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """``docs`` with a struct ``into``: n_words, n_hit, spans of hit words [first, last), items (sorted ids).

    The set is broadcast while the items' words number at most ``max_item_words``, which is counted first;
    beyond that the windows meet in a shuffle, with the same result.
    """
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.size(word_array(F.col("text"))))).first()[0] or 0
    if total > max_item_words:
        return _by_join(docs, items, size, text, into)
    grams = docs.sparkSession.sparkContext.broadcast(Grams([(i, t.encode()) for i, t in items.collect()], size))

    @arrow_udf(RESULT)
    def scan(column: pa.Array) -> pa.Array:
        return grams.value.scan(binary(column))

    return docs.withColumn(into, scan(F.col(text).cast("string")))


def _windows(words: Column, n: Column) -> Column:
    """Each start of a window of ``n`` words with the window's words."""
    return F.when((n > 0) & (F.size(words) >= n), F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.struct(i.alias("first"), F.array_join(F.slice(words, i + 1, n), " ").alias("gram"))))


def _by_join(docs: DataFrame, items: DataFrame, size: int, text: str, into: str) -> DataFrame:
    """The same through a shuffle by window, for test sets too large to broadcast."""
    w = items.select("item_id", word_array(F.col("text")).alias("w")).withColumn("n", F.least(F.size("w"), F.lit(size)))
    grams = w.select("item_id", "n", F.explode(_windows(F.col("w"), F.col("n"))).alias("g")).select("item_id", "n", "g.gram").distinct()
    lengths = [r[0] for r in grams.select("n").distinct().collect()]
    base = common.saved(docs.withColumn("__row", F.expr("uuid()")))
    words = base.select("__row", word_array(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("w"))
    seen = None
    for n in lengths or [size]:
        part = words.select("__row", F.lit(n).alias("n"), F.explode(_windows(F.col("w"), F.lit(n))).alias("g")).select("__row", "n", "g.first", "g.gram")
        seen = part if seen is None else seen.unionByName(part)
    hits = seen.join(grams, ["n", "gram"]).groupBy("__row").agg(
        F.array_sort(F.collect_set(F.struct("first", (F.col("first") + F.col("n")).alias("last")))).alias("raw"),
        F.array_sort(F.collect_set("item_id")).alias("items"))
    empty = F.expr("cast(array() as array<struct<first: int, last: int>>)")
    joined = F.aggregate("raw", empty, lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["last"] >= x["first"]), F.concat(
        F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["last"], x["last"]).alias("last"))))
    ).otherwise(F.concat(acc, F.array(x))))
    hits = hits.select("__row", "items", joined.alias("spans"))
    spans = F.coalesce("spans", empty)
    n_hit = F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, x: a + x["last"] - x["first"])
    out = F.struct(F.size("w").cast("bigint").alias("n_words"), n_hit.alias("n_hit"), spans.alias("spans"), F.coalesce("items", F.expr("cast(array() as array<bigint>)")).alias("items"))
    judged = words.join(hits, "__row", "left").select("__row", out.alias(into))
    return base.join(judged, "__row").drop("__row")


def contaminated(overlap: Column) -> Column:
    """At least one word in twenty lies inside an occurring window."""
    return (overlap["n_hit"] > 0) & (20 * overlap["n_hit"] >= overlap["n_words"])


def cut_spans(text: Column, overlap: Column) -> Column:
    """The text's words outside the hit spans, joined by spaces; a text without hits stays as it is."""
    words = word_array(text)
    kept = F.filter(words, lambda w, i: ~F.exists(overlap["spans"], lambda s: (i >= s["first"]) & (i < s["last"])))
    return F.when(F.size(overlap["spans"]) > 0, F.array_join(kept, " ")).otherwise(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", size: int = SIZE) -> DataFrame:
    """Drop contaminated documents, or cut only the hit spans (``remove="spans"``); columns stay as they are."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    judged = overlaps(docs, benchmark, size=size, into="__overlap")
    if remove == "documents":
        return judged.where(~contaminated(F.col("__overlap"))).select(*[F.col(f"`{c}`") for c in docs.columns])
    return judged.select(*[cut_spans(F.col("text"), F.col("__overlap")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def decontam_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest per document: counts, the number and SHA-256 of the occurring items, and the verdict."""
    o = F.col("overlap")
    ids = F.array_join(F.array_sort(F.transform(o["items"], lambda i: i.cast("string"))), ",")
    return overlaps(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", o["n_words"].alias("n_words"), o["n_hit"].alias("n_hit"), F.size(o["items"]).cast("bigint").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), contaminated(o).alias("contaminated"))


REPORT_SQL = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
ig AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS gram
  FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS i FROM (SELECT *, least(13, len(w)) AS n FROM iw) WHERE n > 0)),
dw AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
dg AS (
  SELECT r, n, i, array_to_string(w[i + 1 : i + n], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM dw, (SELECT DISTINCT n FROM ig) l WHERE len(w) >= n)),
hit AS (SELECT dg.r, dg.i, dg.n, ig.item_id FROM dg JOIN ig USING (n, gram)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
