"""Text rules over document and scene tables."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stripweave.functions import text as tx
from stripweave.functions.ordered import first_by, join_on, once

# Phrases that describe the picture instead of telling the story.
FORBIDDEN = [
    r"\bin (?:this|the|that|our) (?:panel|panels|scene|image|images|frame|picture|illustration|shot|drawing|page)\b",
    r"\bwe (?:can |then |now |also |first )?(?:see|watch|witness|observe|are shown|get to see|find)\b",
    r"\bthe (?:panel|image|frame|picture|illustration|artwork|drawing|scene|page|strip) (?:shows|depicts|reveals|displays|features|captures|presents|opens|closes)\b",
    r"\b(?:is|are) (?:shown|depicted|displayed|pictured|illustrated|visible)\b",
    r"\bthe camera\b",
    r"\bclose-?up\b",
    r"\bzoom(?:s|ed|ing)? (?:in|out)\b",
    r"(?:^|[.!?]\s+)here[,:]?\s",
    r"\b(?:the narrator|the protagonist|our (?:hero|protagonist)|the main character)\b",
    r"\bthe (?:scene|panel|image|page|shot) (?:unfolds|cuts|shifts|switches|changes)\b",
    r"\bthis (?:chapter|episode) (?:opens|begins|starts|ends|closes|follows|covers)\b",
    r"\bthe (?:final|last|opening|first) (?:panel|frame|shot)\b",
    r"\bsur cette (?:case|image|planche|vignette)\b",
    r"\bon (?:voit|apercoit|aperçoit|decouvre|découvre)\b",
    r"(?:^|[.!?]\s+)ici[,:]?\s",
    r"\bl'image (?:montre|revele|révèle)\b",
]
# Openings that say nothing.
GENERIC_INTRO = [
    r"^\s*(?:in|during|for) (?:this|today's|the) (?:chapter|episode|video|recap|prologue)\b",
    r"^\s*(?:welcome|hello|hey|hi|greetings)\b",
    r"^\s*today,? (?:we|let's|let us|i|you)\b",
    r"^\s*let'?s (?:dive|jump|get|start|begin|take|go)\b",
    r"^\s*(?:this|the|our) (?:recap|video|chapter|episode|story|prologue) (?:covers|starts|begins|opens|follows|tells|takes)\b",
    r"^\s*(?:get ready|buckle up|without further ado|before we (?:start|begin))\b",
    r"^\s*(?:dans|pour) (?:ce|cet) (?:chapitre|episode|épisode|recap|récap)\b",
    r"^\s*(?:bienvenue|bonjour|salut)\b",
]
# What a call to action looks like.
CALL = (r"\b(?:subscribe|subscribing|subscribed|hit the (?:like|bell)|like (?:this|the) video|"
        r"abonne[sz]?-?(?:toi|vous)?|abonnez|abonner|like et abonne)\b")
# Emotions and the free labels that mean them.
EMOTIONS = ["neutral", "calm", "tension", "action", "sad", "happy", "humor", "romance", "fear", "mystery", "epic"]
ALIASES = {
    "joy": "happy", "joyful": "happy", "cheerful": "happy", "sadness": "sad", "melancholy": "sad", "grief": "sad",
    "anger": "tension", "angry": "tension", "suspense": "mystery", "mysterious": "mystery", "comedy": "humor", "funny": "humor",
    "humour": "humor", "horror": "fear", "scary": "fear", "dread": "fear", "peaceful": "calm", "serene": "calm", "quiet": "calm",
    "fight": "action", "battle": "action", "combat": "action", "love": "romance", "romantic": "romance", "dramatic": "epic",
    "heroic": "epic", "triumph": "epic",
}


def split_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(tx.sentences(F.col(text))).alias("pos", "sentence"))


def scan_patterns(df: DataFrame, key: str, text: str, patterns: Sequence[str] = FORBIDDEN) -> DataFrame:
    """Every match of every pattern, ignoring case. The patterns are a fixed list, so they are literals, not a join."""
    hits = F.array(*[F.struct(F.lit(i).alias("pattern"), F.regexp_extract_all(text, F.lit(f"(?iuU)({p})"), F.lit(1)).alias("found")) for i, p in enumerate(patterns)])
    p = df.select(key, F.explode(hits).alias("_h")).select(key, "_h.pattern", F.explode("_h.found").alias("_f"))
    return p.select(key, "pattern", F.trim("_f").alias("hit"))


def generic_opening(text: Column, patterns: Sequence[str] = GENERIC_INTRO) -> Column:
    """First sentence if it is a generic opening, else null."""
    first = F.get(tx.sentences(text), 0)
    return F.when(tx.any_match(first, patterns), first)


def scrub_text(text: Column) -> Column:
    """Text without the most frequent describing phrases, sentences capitalised again."""
    head = r"(^|[.!?]\s+)"
    # The describing phrases that go.
    for p, r in [
        (head + r"in (?:this|the|that) (?:panel|panels|scene|image|frame|picture|illustration|shot|page),?\s+", "$1"),
        (head + r"(?:here|ici),?\s+", "$1"),
        (head + r"we (?:can |then |now )?(?:see|watch|observe) (?:that |how )?", "$1"),
        (r"\bwe (?:can |then |now )?(?:see|watch) (?:that |how )?", ""),
    ]:
        text = F.regexp_replace(text, f"(?iuU){p}", r)
    # cut before every sentence start, raise its first letter, join again
    marked = F.regexp_replace(text, r"(?U)([.!?]\s+)([a-z])", "$1\u0001$2")
    pieces = F.transform(F.split(marked, "\u0001"), lambda s: F.when(s.rlike("^[a-z]"), F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))).otherwise(s))
    return tx.spaced(F.array_join(pieces, ""))


def _quoted(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def apply_dictionary(text: Column, words: Mapping[str, str]) -> Column:
    """Whole-word replacement ignoring case, longest keys first; ``/.../`` values keep the key beside them."""
    known = {k.strip(): w.strip() for k, w in words.items() if not k.startswith("_")}
    for key in sorted(known, key=len, reverse=True):
        value = known[key]
        put = f"[{key}]({value})" if re.match(r"^/.+/$", value) else value
        text = F.regexp_replace(text, f"(?iuU)(?<!\\w){_quoted(key)}(?!\\w)", put.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def apply_large_dictionary(df: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """Single-word dictionary ``(word, value)`` of any size: the distinct words of each text meet it in a join.

    Only words that it holds come back to their texts, so a word that every text uses costs a row per text, however often it stands
    there, and a word outside the dictionary costs nothing after the join. A text is one row and holds its own replacements.
    Rows with a null key and keys that repeat are put together as one text's words.
    """
    cut = F.regexp_extract_all(text, F.lit(r"(?U)(\w+|\W+)"), F.lit(1))
    known = first_by(words.select(F.lower(F.trim("word")).alias("_k"), F.trim("word").alias("word"), "value"), ["_k"], [F.col("word")])
    put = F.when(F.col("value").rlike("^/.+/$"), F.concat(F.lit("["), F.col("word"), F.lit("]("), F.col("value"), F.lit(")"))).otherwise(F.col("value"))
    asked = df.select(key, F.explode(F.array_distinct(F.transform(cut, F.lower))).alias("_k"))
    hits = asked.join(known.select("_k", put.alias("_v")).filter("_v is not null"), "_k").groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("_k", "_v"))).alias("_put"))
    out = F.array_join(F.transform(cut, lambda t: F.coalesce(F.element_at("_put", F.lower(t)), t)), "")
    return join_on(df, hits, [key], "left").withColumn(text, F.when(F.col("_put").isNotNull(), out).otherwise(F.col(text))).drop("_put")


def coerce_emotion(label: Column) -> Column:
    k = F.lower(F.trim(F.coalesce(label.cast("string"), F.lit(""))))
    return F.when(k.isin(*EMOTIONS), k).otherwise(F.coalesce(tx.mapped(k, ALIASES), F.lit("neutral")))


def coerce_bool(label: Column) -> Column:
    """Text by its word, a number by whether it is zero; anything missing is false."""
    word = F.lower(F.trim(F.coalesce(label.cast("string"), F.lit("")))).isin("true", "1", "yes", "y", "oui", "vrai")
    return F.when(F.typeof(label) == "string", word).otherwise(F.coalesce(label.try_cast("double") != 0, F.lit(False)))


def coerce_texts(value: Column) -> Column:
    """A list from one text: the text trimmed, or nothing if it is blank or missing."""
    t = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return F.filter(F.array(t), lambda x: x != "")


def coerce_list(values: Column) -> Column:
    """A list of trimmed texts without blanks and nulls; empty where the list is missing."""
    kept = F.filter(F.transform(values, lambda x: F.trim(x.cast("string"))), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(kept, F.expr("cast(array() as array<string>)"))


def coerce_weight(value: Column) -> Column:
    """Whole number between 1 and 3; 2 where it is none."""
    number = F.when(F.trim(value).rlike("^[+-]?[0-9]{1,18}$"), F.trim(value).cast("long"))
    return F.when(number.isNull(), 2).otherwise(F.greatest(F.lit(1), F.least(F.lit(3), number))).cast("int")


def series_key(title_no: Column, title: Column) -> Column:
    s = tx.slug(F.coalesce(title, F.lit("")))
    return F.when(title_no.isNotNull(), F.concat(F.lit("t"), title_no.cast("string"))).when(s != "", F.concat(F.lit("s-"), s)).otherwise("")


def project_name(series: Column, episode: Column, fallback: str) -> Column:
    """Name usable as a folder, at most 80 characters."""
    raw = F.concat_ws(" - ", F.when(series != "", series), F.when(episode != "", episode))
    clean = F.regexp_replace(F.regexp_replace(raw, r'[<>:"/\\|?*\x00-\x1f]+', " "), r"(?U)\s+", " ")
    clean = F.substring(F.regexp_replace(clean, r"^[ .]+|[ .]+$", ""), 1, 80)
    return F.when(clean == "", fallback).otherwise(clean)


def ascii_safe(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "?")


def normalize_hook(c: Column) -> Column:
    """At most three upper-case words and 18 characters; null if nothing is left."""
    edge = "\\s\"'«»\\-–—"
    t = F.upper(F.regexp_replace(F.regexp_replace(c, f"(?U)^[{edge}]+", ""), f"(?U)[{edge}.,;:!?]+$", ""))
    w = tx.words(F.regexp_replace(t, "[^A-Z0-9' ]+", " "))

    def first(n: int) -> Column:
        return F.array_join(F.slice(w, 1, n), " ")

    hook = F.when(F.length(first(3)) <= 18, first(3)).when(F.length(first(2)) <= 18, first(2)).otherwise(F.substring(first(1), 1, 18))
    return F.when(F.trim(hook) != "", F.trim(hook))


def opposite_side(subject: Column, arrow: Column) -> tuple[Column, Column]:
    """Subject and arrow side, the arrow never on the subject's side."""
    s = F.when(F.lower(F.trim(subject)).isin("left", "center", "right"), F.lower(F.trim(subject))).otherwise("center")
    a = F.lower(F.trim(arrow))
    return s, F.when(a.isin("left", "right") & (a != s), a).otherwise(F.when(s == "right", "left").otherwise("right"))


# --- C11 -------------------------------------------------------------------------------------
def assemble_text(lines: DataFrame, keys: Sequence[str], pos: str, line: str, part: int) -> DataFrame:
    """Lines put together in order, ``part`` lines to a row, so no row grows with its chapter.

    Parts number from 0 and follow each other; how many lines make one is the caller's choice.
    """
    cut = lines.withColumn("part", F.floor(F.col(pos) / part))
    packed = cut.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("_p"), F.col(line).alias("_l")))).alias("_a"))
    return packed.select(*keys, "part", F.array_join(F.transform("_a", lambda x: x["_l"]), "\n").alias("text"))


def beat_line(idx: Column, ids: Column, summary: Column, filler: Column, characters: Column, dialogue: Column) -> Column:
    """One line per beat; who is there and what is said only where known."""
    return F.concat(
        F.lit("Beat "), idx.cast("string"), F.lit(" (panels "), F.array_join(F.transform(ids, lambda x: x.cast("string")), ", "), F.lit(")"),
        F.when(filler, " [FILLER - do not narrate]").otherwise(""), F.lit(": "), summary,
        F.when(F.size(characters) > 0, F.concat(F.lit(" | Characters: "), F.array_join(characters, ", "))).otherwise(""),
        F.when(F.size(dialogue) > 0, F.concat(F.lit(" | Dialogue: "), F.array_join(F.transform(dialogue, lambda q: F.concat(F.lit('"'), q, F.lit('"'))), " / "))).otherwise(""))


def card_line(name: Column, aliases: Column, who: Column) -> Column:
    return F.concat(F.lit("  - "), name, F.when(F.size(aliases) > 0, F.concat(F.lit(" (also called "), F.array_join(aliases, ", "), F.lit(")"))).otherwise(""), F.lit(": "), who)


def head_tail(scenes: DataFrame, keys: Sequence[str], pos: str, n: int = 3) -> DataFrame:
    """First and last ``n`` rows of each chapter; the end is empty where the chapter has no more than ``n``.

    Each side keeps its ``n`` rows before the shuffle.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys)
    head = scenes.withColumn("_r", F.row_number().over(w.orderBy(pos))).filter(F.col("_r") <= n).withColumn("side", F.lit("head"))
    tail = scenes.withColumn("_r", F.row_number().over(w.orderBy(F.desc(pos)))).filter(F.col("_r") <= n).withColumn("side", F.lit("tail"))
    size = scenes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > n)
    return head.unionByName(tail.join(size.select(*keys), list(keys), "left_semi")).drop("_r")


# --- C12 -------------------------------------------------------------------------------------
LONGEST_INT, RUNAWAY = 18, -1  # fixed values


def _whole(digits: str) -> int:
    return RUNAWAY if len(digits.lstrip("-")) > LONGEST_INT else int(digits)


def _load(s: str):
    return json.loads(s, parse_int=_whole)


def _strings(s: str) -> list[bool]:
    """For every character, whether it lies inside a JSON string; one more entry tells how the text ends."""
    inside, escaped, out = False, False, []
    for ch in s:
        out.append(inside)
        if not inside:
            inside = ch == '"'
        elif escaped:
            escaped = False
        elif ch == "\\":
            escaped = True
        elif ch == '"':
            inside = False
    out.append(inside)
    return out


# Faults that can be mended in place, with what replaces them.
MENDS = [
    (re.compile(r"([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)(\s*:)"), r'\1"\2"\3'),
    (re.compile(r",(\s*[}\]])"), r"\1"),
    (re.compile(r',\s*-?\d+(?:\.\d+)?(?=\s*,\s*"[^"]*"\s*:)'), ""),
]


def mend_json(s: str) -> tuple[str | None, str]:
    """Mended JSON text and ``ok`` / ``truncated`` / ``invalid``."""
    fence = re.match(r"^\s*```(?:json)?\s*(.*?)\s*```\s*$", s, re.DOTALL)
    s = fence.group(1) if fence else s
    mended = s
    for pattern, put in MENDS:
        # searched over the whole text, applied only where the match starts outside a string
        held = _strings(mended)
        mended = pattern.sub(lambda m: m.group(0) if held[m.start()] else m.expand(put), mended)
    cuts = [s[s.find(a):s.rfind(b) + 1] for a, b in ("{}", "[]") if 0 <= s.find(a) < s.rfind(b)]
    for t in [s, *cuts, *([mended] if mended != s else [])]:
        try:
            return json.dumps(_load(t), ensure_ascii=False), "ok"
        except ValueError:
            continue
    t = s.strip()
    if t[:1] in ("{", "["):
        held = _strings(t)
        depth = sum((c in "{[") - (c in "}]") for c, h in zip(t, held) if not h)
        if held[-1] or depth > 0:
            return None, "truncated"
    return None, "invalid"


def parse_model_json(df: DataFrame, column: str, schema: str, list_key: str, defaults: Mapping[str, str] | None = None) -> DataFrame:
    """Tolerant JSON column: ``parsed`` by ``schema`` and ``status``.

    Clean objects are read natively; only the others, a separate branch, go through one Arrow function that mends them. A bare
    list is put under ``list_key``; ``defaults`` (JSON text) stand in for missing parts.
    """
    @F.pandas_udf("json string, status string")
    def mend(s: pd.Series) -> pd.DataFrame:
        pairs = [(None, "invalid") if x is None else mend_json(x) for x in s]
        return pd.DataFrame(pairs, columns=["json", "status"])

    probe = F.try_parse_json(column) if hasattr(F, "try_parse_json") else None
    runaway = F.col(column).rlike(r"[0-9]{19,}")
    clean = F.coalesce(probe.isNotNull(), F.lit(False)) & ~runaway if probe is not None else F.lit(False)
    p = df.withColumn("_clean", clean)
    native = p.filter("_clean").select(*df.columns, F.col(column).alias("_text"), F.lit("ok").alias("status"))
    # the mending function stands in a plan of its own, so clean rows never leave the JVM
    mended = once(p.filter("not _clean"), _m=mend(F.col(column))).select(*df.columns, F.col("_m.json").alias("_text"), F.col("_m.status").alias("status"))
    p, text = native.unionByName(mended), F.col("_text")
    text = F.when(F.ltrim(text).startswith("["), F.concat(F.lit(f'{{"{list_key}":'), text, F.lit("}"))).otherwise(text)
    p = p.withColumn("_t", text).withColumn("parsed", F.from_json("_t", schema))
    for name, value in (defaults or {}).items():
        kind = T.StructType.fromDDL(schema)[name].dataType.simpleString()
        p = p.withColumn("parsed", F.when(F.col("parsed").isNotNull(), F.col("parsed").withField(name, F.coalesce(F.col(f"parsed.{name}"), F.from_json(F.lit(value), kind)))))
    # an answer without its list is refused
    lacking = (F.col("status") == "ok") & F.col(f"parsed.{list_key}").isNull()
    return p.withColumn("status", F.when(lacking, "invalid").otherwise(F.col("status"))).drop("_text", "_t")


# --- C13 -------------------------------------------------------------------------------------
def text_stats(samples: DataFrame) -> DataFrame:
    """Rates of voice samples ``(voice, text, duration_s, compute_s)`` with the groups their code names."""
    n = F.size(tx.words(F.col("text")))
    accent = F.coalesce(tx.mapped(F.substring("voice", 1, 1), {"a": "american", "b": "british"}), F.substring("voice", 1, 1))
    return samples.withColumns({
        "n_words": n, "words_per_minute": F.when(F.col("duration_s") > 0, n * 60 / F.col("duration_s")).otherwise(0.0),
        "realtime": F.when(F.col("compute_s") > 0, F.col("duration_s") / F.col("compute_s")).otherwise(0.0),
        "gender": F.when(F.substring("voice", 2, 1) == "f", "feminine").otherwise("masculine"), "accent": accent})


def fastest_slowest(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Voice with the highest and the lowest rate per group, by name on ties."""
    return stats.groupBy(*keys).agg(
        F.min(F.struct((-F.col("words_per_minute")).alias("r"), "voice"))["voice"].alias("fastest"),
        F.min(F.struct(F.col("words_per_minute").alias("r"), "voice"))["voice"].alias("slowest"))
