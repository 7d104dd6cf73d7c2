"""Text rules as columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, functions as F

# Characters without width, and typographic characters with their plain forms.
ZERO_WIDTH = "​‌‍﻿"
PLAIN = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"',
         "–": "-", "—": " - ", "…": "...", " ": " "}
BOUNDARY = r"(?U)(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])"
ANY_BOUNDARY = r"(?U)(?<=[.!?])\s+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind a costly value once for an expression that reads it several times."""
    return F.transform(F.array(value), use)[0]


def spaced(c: Column) -> Column:
    """Whitespace collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def _or_empty(c: Column) -> Column:
    return let(c, lambda x: F.when(x.rlike(r"[\p{L}\p{N}]"), x).otherwise(""))


def clean_text(c: Column) -> Column:
    return _or_empty(spaced(F.translate(c, ZERO_WIDTH, "")))


def prepare_text(c: Column) -> Column:
    """Text ready to be read aloud: plain typography, spaces collapsed, an end mark."""
    c = F.translate(c, ZERO_WIDTH, "")
    for k, v in PLAIN.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return let(_or_empty(spaced(c)), lambda x: F.when((x == "") | x.rlike(r"[.!?]$"), x).otherwise(F.concat(x, F.lit("."))))


def sentences(c: Column) -> Column:
    """Sentences: end mark, whitespace, then a capital, digit, quote or bracket."""
    return F.filter(F.transform(F.split(F.trim(c), BOUNDARY), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def words(c: Column) -> Column:
    return let(spaced(c), lambda t: F.when(t == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(t, " ")))


def balanced_chunks(c: Column, max_words: int = 4) -> Column:
    """Chunks of at most ``max_words`` words, sizes within a sentence differing by at most one."""
    m = max(1, max_words)

    def cut(w: Column) -> Column:
        n = F.size(w)
        groups = F.ceil(n / m).cast("int")
        base, extra = F.floor(n / groups).cast("int"), (n % groups).cast("int")
        return F.transform(F.sequence(F.lit(0), groups - 1), lambda g: F.array_join(
            F.slice(w, (g * base + F.least(g, extra) + 1).cast("int"), base + F.when(g < extra, 1).otherwise(0)), " "))

    # split to words in a step of its own, so the cut reads a bound array; an empty text has no pieces
    pieces = F.filter(F.split(prepare_text(c), ANY_BOUNDARY), lambda s: s != "")
    return F.flatten(F.transform(F.transform(pieces, lambda s: F.split(s, " ")), cut))


def trim_text(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at a space and marked with three dots."""
    def cut(t: Column) -> Column:
        head = F.substring(t, 1, limit)
        kept = F.regexp_replace(head, " [^ ]*$", "")
        return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.when(kept == "", head).otherwise(kept), F.lit("...")))

    return let(spaced(c), cut)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def mapped(c: Column, table: Mapping[str, str]) -> Column:
    """Value of a small fixed table, null where the key is missing."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def ascii_edges(pattern: str) -> str:
    r"""The pattern with each ``\b`` between a character of ``[0-9A-Za-z_]`` and any other."""
    word = "[0-9A-Za-z_]"
    edge = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    return re.sub(r"\\(.)", lambda m: edge if m[1] == "b" else m[0], pattern)


def any_match(c: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(f"(?iuU){p}")
    return out
