"""Chat formatting (7): budgeted windows of turns with retained system turn, repeated history and a loss mask.

Prefix sums of the turns' tokens (words, and ``OVERHEAD`` for a turn's marks) choose the windows: short turns whose
sums end in one cell of a grid share a window, a turn longer than a cell has its own. Two cells, the system turn
and the history fit the budget, so every window does, unless a single turn is longer by itself (``oversize``). A
window after the first repeats the system turn and the turns just before it, up to ``HISTORY`` tokens; what
is repeated is marked so and masked. The loss mask is the list of [start, length) code points of the own
assistant texts, so each counts exactly once over all windows.

Control strings inside texts get a backslash after their first character, which is taken out when reading back.
Prefix sums run in two levels, so a conversation of any length is spread. Only DataFrame and SQL functions.

Null texts and roles are empty; null turns come first; equal (turn, role, text) rows are turns of their own; rows with a
null conv_id are one conversation; an empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

BUDGET, HISTORY, OVERHEAD = 1024, 128, 4
#: Strings that a model reads as control, escaped in texts besides this template's own marks.
_TAIL = r"(\||/?s>|/?INST\]|</?SYS>>)"
#: Turns of a conversation whose prefix sums one task builds.
SPAN = 512
OPEN, SHUT = "|>\n", "<|end|>\n"
KEY = ["conv_id"]


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, r"$1$2$3")


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\n\r]+")) + OVERHEAD


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def _left(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on null-safe keys, which come from ``a``."""
    renamed = b.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in b.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return a.join(renamed, cond, how).drop(*[f"__{k}" for k in keys])


def turns_of(conversations: DataFrame, *, budget: int = BUDGET, history: int = HISTORY, span: int = SPAN) -> DataFrame:
    """Turns in order with their tokens, place, first and last token, system turn and window (``w``: break, long, cell)."""
    t = conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("n", tokens(F.col("text")).cast("bigint")).withColumn("part", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / span))
    t = saved(t)  # so that equal rows keep their order below
    system = t.where("role = 'system'").groupBy("conv_id").agg(F.min(F.struct("turn", "text", "n")).alias("sys"))
    t = _left(t, system, KEY)
    room = F.greatest(F.lit(budget) - history - F.coalesce(F.col("sys")["n"], F.lit(0)), F.lit(budget // 4))
    t = t.withColumn("cell", F.floor(room / 2)).withColumn("long", F.col("n") > F.col("cell"))
    counted = [F.sum("n").alias("n_sum"), F.sum(F.col("long").cast("int")).alias("long_sum"), F.count("*").alias("rows")]
    order = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = t.groupBy("conv_id", "part").agg(*counted).select(
        "conv_id", "part", *[F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"{c}_before") for c in ("n_sum", "long_sum", "rows")])
    inner = W.partitionBy("conv_id", "part").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumns({"n_run": F.sum("n").over(inner), "long_run": F.sum(F.col("long").cast("int")).over(inner), "row_run": F.row_number().over(W.partitionBy("conv_id", "part").orderBy("turn", "role", "text"))})
    t = _left(t, sums, ["conv_id", "part"], "inner")
    last = F.col("n_sum_before") + F.col("n_run")
    place = F.col("rows_before") + F.col("row_run")
    w = F.struct((F.col("long_sum_before") + F.col("long_run")).alias("brk"), F.col("long"), F.when(F.col("long"), F.lit(0)).otherwise(F.floor((last - 1) / F.col("cell"))).alias("cell"))
    return t.select("conv_id", "role", "text", "n", "long", "sys", w.alias("w"), place.alias("place"), (last - F.col("n")).alias("first"), last.alias("last"), (F.col("turn").eqNullSafe(F.col("sys")["turn"]) & (F.col("role") == "system")).alias("is_sys"))


def windows(conversations: DataFrame, *, budget: int = BUDGET, history: int = HISTORY, span: int = SPAN) -> DataFrame:
    """conv_id, first_turn (place of the window's first own turn), formatted, mask, n_tokens, oversize."""
    t = saved(turns_of(conversations, budget=budget, history=history, span=span))
    heads = t.groupBy("conv_id", "w").agg(F.min("first").alias("begin"), F.min("place").alias("first_turn"))
    own = _left(t, heads.select("conv_id", "w", "first_turn"), ["conv_id", "w"], "inner").select("conv_id", "first_turn", F.lit(2).alias("kind"), "place", "role", "text", "n")
    later = heads.where("begin > 0").select("conv_id", "first_turn", "begin", F.floor(F.col("begin") / max(history, 1)).alias("bucket"))
    # a window beginning within ``history`` tokens after a turn's first token lies in one of two buckets
    near = t.where("not is_sys and n <= %d" % history).withColumn("bucket", F.explode(F.array(F.floor(F.col("first") / max(history, 1)), F.floor(F.col("first") / max(history, 1)) + 1)))
    past = _left(near, later, ["conv_id", "bucket"], "inner").where(f"first < begin and begin - first <= {history}").select("conv_id", "first_turn", F.lit(1).alias("kind"), "place", "role", "text", "n")
    first_sys = t.where("is_sys").groupBy("conv_id").agg(F.min(F.struct("place", "text", "n")).alias("s"))
    keep = _left(heads, first_sys, KEY, "inner").where("first_turn > s.place").select("conv_id", "first_turn", F.lit(0).alias("kind"), F.col("s.place").alias("place"), F.lit("system").alias("role"), F.col("s.text").alias("text"), F.col("s.n").alias("n"))
    items = own.unionByName(past).unionByName(keep)
    head = F.concat(F.lit("<|"), F.element_at(F.array(F.lit("keep"), F.lit("past"), F.lit("turn")), F.col("kind") + 1), F.lit(":"), F.url_encode("role"), F.lit(OPEN))
    items = items.withColumn("body", escape(F.col("text"))).withColumn("head", head).withColumn("piece", F.concat("head", "body", F.lit(SHUT)))
    w = W.partitionBy("conv_id", "first_turn").orderBy("kind", "place")
    starts = F.sum(F.char_length("piece")).over(w.rowsBetween(W.unboundedPreceding, 0)) - F.char_length("piece") + F.char_length("head")
    items = items.withColumn("loss", F.when((F.col("kind") == 2) & (F.col("role") == "assistant"), F.struct(starts.cast("bigint").alias("start"), F.char_length("body").cast("bigint").alias("length"))))
    made = items.groupBy("conv_id", "first_turn").agg(
        F.array_sort(F.collect_list(F.struct("kind", "place", "piece"))).alias("p"), F.array_sort(F.collect_list("loss")).alias("mask"), F.sum("n").alias("n_tokens"))
    return made.select("conv_id", "first_turn", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), "mask", "n_tokens", (F.col("n_tokens") > budget).alias("oversize"))


def parse(formatted: Column) -> Column:
    """The items of a window, read back: kind (turn, past or keep), role and text as they were."""
    found = F.split(formatted, r"<\|end\|>\n")
    head = r"(?s)^<\|(\w+):([^|]*)\|>\n(.*)$"
    return F.transform(F.slice(found, 1, F.size(found) - 1), lambda x: F.struct(
        F.regexp_extract(x, head, 1).alias("kind"), F.url_decode(F.regexp_extract(x, head, 2)).alias("role"), unescape(F.regexp_extract(x, head, 3)).alias("text")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, from windows and masks alone."""
    own = F.filter(parse(F.col("formatted")), lambda x: x["kind"] == "turn")
    said = F.array_join(F.transform(own, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
    per = formatted.select("conv_id", "first_turn", F.size(own).alias("n"), said.alias("said"), loss.alias("loss"), F.char_length("formatted").alias("chars"), "oversize")
    per = per.groupBy("conv_id").agg(
        F.sum("n").cast("bigint").alias("n_turns"), F.array_sort(F.collect_list(F.struct("first_turn", "said", "loss"))).alias("parts"), F.sum("chars").cast("bigint").alias("formatted_chars"),
        F.count("*").alias("n_windows"), F.sum(F.col("oversize").cast("int")).cast("bigint").alias("n_oversize"))
    whole = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return per.select("conv_id", "n_turns", F.sha2(F.array_join(F.transform("parts", lambda p: p["said"]), "").cast("binary"), 256).alias("turns_sha256"),
                      F.char_length(whole).cast("bigint").alias("loss_chars"), F.sha2(whole.cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_windows", "n_oversize")


def chat_report(conversations: DataFrame) -> DataFrame:
    """All conversations and one that talks in control strings."""
    tricky = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(windows(conversations.select("conv_id", "turn", "role", "text").unionByName(tricky)))


REPORT_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) x(i)),
t AS (SELECT *, row_number() OVER o AS place, len(regexp_extract_all(text, '[^ \t\n\r]+')) + {OVERHEAD} AS n FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT conv_id, min(place) AS sys_place, arg_min(n, place) AS sys_n, arg_min(text, place) AS sys_text FROM t WHERE role = 'system' GROUP BY conv_id),
g AS (SELECT t.*, sys_place, sys_n, sys_text, greatest({BUDGET} - {HISTORY} - coalesce(sys_n, 0), {BUDGET // 4}) // 2 AS cell FROM t LEFT JOIN s USING (conv_id)),
p AS (SELECT *, CAST(sum(n) OVER o AS BIGINT) AS last, CAST(sum(CASE WHEN n > cell THEN 1 ELSE 0 END) OVER o AS BIGINT) AS brk FROM g WINDOW o AS (PARTITION BY conv_id ORDER BY place)),
w AS (SELECT *, last - n AS first, CASE WHEN n > cell THEN -1 ELSE (last - 1) // cell END AS k FROM p),
h AS (SELECT conv_id, brk, k, min(first) AS b, min(place) AS first_turn FROM w GROUP BY ALL),
i AS (
  SELECT w.conv_id, first_turn, n, role, text, 2 AS kind FROM w JOIN h ON w.conv_id = h.conv_id AND w.brk = h.brk AND w.k = h.k
  UNION ALL SELECT w.conv_id, first_turn, n, role, text, 1 FROM w JOIN h ON w.conv_id = h.conv_id AND first < b AND b - first <= {HISTORY} WHERE n <= {HISTORY} AND place IS DISTINCT FROM sys_place
  UNION ALL SELECT h.conv_id, first_turn, sys_n, 'system', sys_text, 0 FROM h JOIN s ON h.conv_id = s.conv_id AND first_turn > sys_place),
f AS (SELECT conv_id, first_turn, sum(n) AS n_tokens,
  sum(18 + length(role) + length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g'))) AS chars FROM i GROUP BY ALL),
x AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) AS n_windows, CAST(count(*) FILTER (n_tokens > {BUDGET}) AS BIGINT) AS n_oversize FROM f GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256, any_value(formatted_chars) AS formatted_chars, any_value(n_windows) AS n_windows, any_value(n_oversize) AS n_oversize
FROM t JOIN x USING (conv_id) GROUP BY conv_id
"""
