"""License scans (2): an exact set-similarity join between text blocks and license templates.

A block is a line of a document, taken as its set of words; a template is the word set of a notice. Every pair
whose containment |block & template| / |template| reaches the threshold is found. Words are ordered by how many
blocks of the corpus hold them, rarest first (one counting pass over all documents, only template words kept).
Then a pair can only qualify if the template's prefix and the block's prefix share a word (prefix filter), the
block holds enough template words (length filter), and the words after the first shared one could still reach
the overlap (positional filter). What passes is verified on the whole sets, so nothing is missed or invented.

Notices also run over line ends, and a line may be a whole document. So for each template the report takes as blocks
the lines of at most its ``SPREAD``-fold number of words, and every window of that many words of the text, whatever the
lines (each start; a block of consecutive lines of that size lies inside one). The whole text goes through the same
filters first: a window holds no more than the text. Overlapping windows that match are one notice, given
beside the lines where it finds more than they do.

Words of a block outside all templates cannot add to an overlap and are dropped first. Null and empty texts
have no blocks; documents of any length are scanned whole; repeated documents are judged each.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import _WORD_BYTES, binary, bounds

#: Phrases looked for word by word, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices, by label. Each is the opening or the usual one-line form of a public license notice.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
]
PERCENT = 85
#: A notice may be spread over so many times its own number of words.
SPREAD = 2
RESULT = ("struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base: array<string>, "
          "blocks: array<struct<block: int, label: string, containment: double>>, "
          "notices: array<struct<first: int, last: int, label: string, containment: double>>>")


class Templates:
    """Templates under one global order of words, with an index of their prefixes."""

    def __init__(self, templates, frequency: dict[bytes, int], percent: int):
        self.sets = [frozenset(t.encode().translate(_WORD_BYTES).split()) for _, t in templates]
        self.labels = [label for label, _ in templates]
        self.window = [SPREAD * len(t.encode().translate(_WORD_BYTES).split()) for _, t in templates]
        self.words = frozenset().union(*self.sets)
        self.rank = {w: i for i, w in enumerate(sorted(self.words, key=lambda w: (frequency.get(w, 0), w)))}
        self.need = [-(-percent * len(s) // 100) for s in self.sets]
        self.least = min(self.need)
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for t, s in enumerate(self.sets):
            for at, w in enumerate(sorted(s, key=self.rank.__getitem__)[: len(s) - self.need[t] + 1]):
                self.prefix.setdefault(w, []).append((t, at))

    def matches(self, found: frozenset[bytes]) -> list[tuple[int, float]]:
        """Templates that the block's template words ``found`` contain to the threshold, with the containment."""
        held = len(found)
        if held < self.least:
            return []
        seen, out = set(), []
        for at, w in enumerate(sorted(found, key=self.rank.__getitem__)[: held - self.least + 1]):
            for t, pos in self.prefix.get(w, ()):
                if t in seen or held < self.need[t]:
                    continue
                seen.add(t)
                size = len(self.sets[t])
                if 1 + min(size - pos - 1, held - at - 1) < self.need[t]:
                    continue
                shared = len(found & self.sets[t])
                if shared >= self.need[t]:
                    out.append((t, shared / size))
        return sorted(out)

    def runs(self, t: int, words: list[bytes]) -> list[tuple[int, int, float]]:
        """Overlapping windows of ``words`` that match template ``t``, joined: first and last word and the best containment.

        Windows start at the template's words, as no other start holds more.
        """
        at = [i for i, w in enumerate(words) if w in self.sets[t]]
        out: list[tuple[int, int, float]] = []
        held: Counter = Counter()
        end = 0
        for start, i in enumerate(at):
            while end < len(at) and at[end] < i + self.window[t]:
                held[words[at[end]]] += 1
                end += 1
            if len(held) >= self.need[t]:
                c = len(held) / len(self.sets[t])
                if out and i <= out[-1][1]:
                    out[-1] = (out[-1][0], at[end - 1], max(c, out[-1][2]))
                else:
                    out.append((i, at[end - 1], c))
            held[words[i]] -= 1
            if not held[words[i]]:
                del held[words[i]]
        return out


def block_frequency(docs: DataFrame, templates=TEMPLATES, text: str = "text") -> dict[bytes, int]:
    """How many blocks of the whole corpus hold each template word; the answer has a row per template word at most."""
    words = frozenset(w for _, t in templates for w in t.encode().translate(_WORD_BYTES).split())

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for t in binary(batch.column(0)):
                for line in (t or b"").translate(_KEEP_LINES).split(b"\n"):
                    total.update(words.intersection(line.split()))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"].encode(): r["n"] for r in rows}


_KEEP_LINES = bytes(0x0A if b == 0x0A else c for b, c in enumerate(_WORD_BYTES))


def _places(words: list[bytes], phrases) -> list[tuple[int, str]]:
    out = []
    for phrase, label in phrases:
        at = -1
        try:
            while True:
                at = words.index(phrase[0], at + 1)
                if words[at : at + len(phrase)] == phrase:
                    out.append((at, label))
        except ValueError:
            pass
    return out


def scan_blocks(docs: DataFrame, *, templates=TEMPLATES, phrases=PHRASES, percent: int = PERCENT, text: str = "text", into: str = "license") -> DataFrame:
    """``docs`` with a struct ``into``: words, places of the base phrases, every line that a template matches (``blocks``), and
    the notices: matching lines within a template's window, and runs of matching windows that find more (``notices``)."""
    index = Templates(templates, block_frequency(docs, templates, text), percent)
    spoken = [(p.encode().split(), label) for p, label in phrases.items()]
    asked = index.words.union(w for p, _ in spoken for w in p)

    @arrow_udf(RESULT)
    def scan(column: pa.Array) -> pa.Array:
        n_words, n_base, first, last, base, base_n, hits, hit_n, notices, notice_n = [], [], [], [], [], [], [], [], [], []
        for t in binary(column):
            lines = [line.split() for line in (t or b"").translate(_KEEP_LINES).split(b"\n")]
            words = [w for line in lines for w in line]
            n_words.append(len(words))
            here, own, start, close = set(), 0, 0, []
            for number, line in enumerate(lines):
                found = asked.intersection(line)
                if found:
                    here |= found
                    for k, c in index.matches(found & index.words):
                        hits.append((number, index.labels[k], c))
                        own += 1
                        if len(line) <= index.window[k]:
                            close.append((start, start + len(line) - 1, k, c))
                start += len(line)
            hit_n.append(own)
            more = [(a, b, k, c) for k, _ in index.matches(here & index.words) for a, b, c in index.runs(k, words)
                    if c > max((x[3] for x in close if x[2] == k and x[0] <= b and a <= x[1]), default=0)]
            notices += [(a, b, index.labels[k], c) for a, b, k, c in close + more]
            notice_n.append(len(close) + len(more))
            places = _places(words, [p for p in spoken if here.issuperset(p[0])])
            n_base.append(len(places))
            first.append(min((a for a, _ in places), default=None))
            last.append(max((a for a, _ in places), default=None))
            labels = sorted({x for _, x in places})
            base += labels
            base_n.append(len(labels))
        block = pa.StructArray.from_arrays(
            [pa.array([h[0] for h in hits], pa.int32()), pa.array([h[1] for h in hits], pa.string()), pa.array(np.array([h[2] for h in hits], np.float64))],
            ["block", "label", "containment"])
        notice = pa.StructArray.from_arrays(
            [pa.array([h[0] for h in notices], pa.int32()), pa.array([h[1] for h in notices], pa.int32()), pa.array([h[2] for h in notices], pa.string()),
             pa.array(np.array([h[3] for h in notices], np.float64))], ["first", "last", "label", "containment"])
        return pa.StructArray.from_arrays(
            [pa.array(n_words, pa.int64()), pa.array(n_base, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()),
             pa.ListArray.from_arrays(pa.array(bounds(base_n), pa.int32()), pa.array(base, pa.string())),
             pa.ListArray.from_arrays(pa.array(bounds(hit_n), pa.int32()), block), pa.ListArray.from_arrays(pa.array(bounds(notice_n), pa.int32()), notice)],
            ["n_words", "n_base", "first_word", "last_word", "base", "blocks", "notices"])

    return docs.withColumn(into, scan(F.col(text).cast("string")))


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def license_report(docs: DataFrame) -> DataFrame:
    """Digest per document; ``score`` is 1 where a base phrase stands, else the best containment found, else 0."""
    x = F.col("license")
    found = F.transform(x["notices"], lambda b: b["label"])
    best = F.coalesce(F.array_max(F.transform(x["notices"], lambda b: b["containment"])), F.lit(0.0))
    return scan_blocks(docs.select("doc_id", "text")).select(
        "doc_id", x["n_words"].alias("n_words"), x["n_base"].alias("n_base"), x["first_word"].alias("first_word"), x["last_word"].alias("last_word"),
        _joined(x["base"]).alias("base_labels"), _joined(F.concat(x["base"], found)).alias("labels"),
        F.when(x["n_base"] > 0, 1.0).otherwise(best).alias("score"), F.size(x["notices"]).cast("bigint").alias("n_blocks"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows)


#: Lines and windows as ``scan_blocks`` takes them, by plain sets: every window of a template's span that starts at one of its words.
REPORT_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
p AS (SELECT string_split(phrase, ' ') AS p, label FROM (VALUES {_values(PHRASES.items())}) x(phrase, label)),
pl AS (SELECT r, i, label FROM (SELECT r, w, unnest(range(0, len(w))) AS i FROM w), p WHERE w[i + 1] = p[1] AND w[i + 1 : i + len(p)] = p),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_distinct(list(label)) AS labels FROM pl GROUP BY r),
tp AS (
  SELECT row_number() OVER () AS k, label, list_distinct(string_split(words, ' ')) AS s, {SPREAD} * len(string_split(words, ' ')) AS span
  FROM (VALUES {_values(TEMPLATES)}) x(label, words)),
ln AS (SELECT r, line, regexp_extract_all(l, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM (
  SELECT r, generate_subscripts(ls, 1) AS line, unnest(ls) AS l FROM (SELECT r, string_split(t, chr(10)) AS ls FROM w))),
laid AS (SELECT r, l, coalesce(sum(len(l)) OVER (PARTITION BY r ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM ln),
near AS (
  SELECT r, k, label, a, a + len(l) - 1 AS b, len(list_intersect(list_distinct(l), s)) / len(s) AS c
  FROM laid, tp WHERE len(l) <= span AND 100 * len(list_intersect(list_distinct(l), s)) >= {PERCENT} * len(s)),
tw AS (SELECT k, label, span, len(s) AS n, unnest(s) AS word FROM tp),
hit AS (
  SELECT r, i, k, label, span, n, tw.word FROM (SELECT r, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS word FROM w) x JOIN tw ON x.word = tw.word
  QUALIFY 100 * count(DISTINCT tw.word) OVER (PARTITION BY r, k) >= {PERCENT} * n),
win AS (
  SELECT a.r, a.k, a.label, a.i AS a, max(b.i) AS b, count(DISTINCT b.word) / a.n AS c
  FROM hit a JOIN hit b ON a.r = b.r AND a.k = b.k AND b.i BETWEEN a.i AND a.i + a.span - 1
  GROUP BY a.r, a.k, a.label, a.i, a.n HAVING 100 * count(DISTINCT b.word) >= {PERCENT} * a.n),
mark AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY r, k ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM win),
part AS (SELECT *, sum(new) OVER (PARTITION BY r, k ORDER BY a) AS run FROM mark),
run AS (SELECT r, k, any_value(label) AS label, min(a) AS a, max(b) AS b, max(c) AS c FROM part GROUP BY r, k, run),
notice AS (
  SELECT r, label, c FROM near UNION ALL
  SELECT r, label, c FROM run WHERE c > coalesce((SELECT max(near.c) FROM near WHERE near.r = run.r AND near.k = run.k AND near.a <= run.b AND run.a <= near.b), 0)),
own AS (SELECT r, list_distinct(list(label)) AS labels, max(c) AS best, count(*) AS n_blocks FROM notice GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score, CAST(coalesce(n_blocks, 0) AS BIGINT) AS n_blocks
FROM w LEFT JOIN base USING (r) LEFT JOIN own USING (r)
"""
