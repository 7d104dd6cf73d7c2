"""What earlier episodes of a series hand on: merged entities, their rank, context and sheets."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from stripweave.functions import text as tx
from stripweave.functions.ordered import first_by, fold, is_hot, join_on, last_before, number_rows, prev, scan
from stripweave.session import durable, number_setting

ALIASES, WHO, TAIL, TOP = 6, 160, 320, 20  # fixed values


def _hot(df: DataFrame, hot: bool | None) -> bool:
    return is_hot(df.select("series"), ["series"]) if hot is None else hot


def _named(cards: DataFrame) -> DataFrame:
    """Cards with a name; aliases trimmed, blanks dropped; the description cut to its limit."""
    return cards.withColumns({
        "name": F.trim("name"), "aliases": F.filter(F.transform("aliases", lambda a: F.trim(a)), lambda a: a != ""),
        "who": tx.trim_text(F.col("who"), WHO)}).filter("name <> ''")


def _roots(rows: DataFrame, mentions: DataFrame) -> DataFrame:
    """``(series, row, root)``: the row that began each row's entity.

    A row points to the first row that mentions its name, as name or alias, which is itself or an earlier one. Doubling
    the pointers until none moves leads every row to the beginning of its entity.
    """
    first = mentions.groupBy("series", "token").agg(F.min("row").alias("root"))
    to = join_on(rows.select("series", "row", F.lower("name").alias("token")), first, ["series", "token"]).select("series", "row", "root")
    while True:
        # only rows that don't begin their entity point on; one write and one look a round, each doubling twice
        to = durable(to)
        away = to.filter("root <> row").select("series", F.col("row").alias("root"), F.col("root").alias("_next"))
        for _ in range(2):
            to = join_on(to, away, ["series", "root"], "left").select("series", "row", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
            away = to.filter("root <> row").select("series", F.col("row").alias("root"), F.col("root").alias("_next"))
        to = durable(to)
        if not to.filter("moved").limit(1).count():
            return to.drop("moved")
        to = to.drop("moved")


def _entities(cards: DataFrame, hot: bool, *told: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows in order, the entities ``(series, ord, root, name, ep)`` with the columns ``told`` and their aliases ``(series, root, alias, ep, place)``."""
    rows = durable(number_rows(_named(cards).select("series", "ep", "pos", "name", "aliases", *told), ["series"], ["ep", "pos", "name"], "row", hot))
    called = rows.select("series", "row", "ep", F.posexplode("aliases").alias("nth", "alias"))
    mentions = rows.select("series", "row", F.lower("name").alias("token")).unionByName(called.select("series", "row", F.lower("alias").alias("token")))
    roots = _roots(rows, mentions)
    begun = join_on(rows, roots, ["series", "row"]).filter("row = root").select("series", "root", "name", "ep", *told)
    begun = durable(number_rows(begun, ["series"], ["root"], "ord", hot))
    own = join_on(called, roots, ["series", "row"]).withColumn("token", F.lower("alias"))
    fresh = own.groupBy("series", "root", "token").agg(F.min(F.struct("row", "nth", "alias", "ep")).alias("m"))
    fresh = join_on(fresh, begun.select("series", "root", F.lower("name").alias("_n")), ["series", "root"]).filter("token <> _n")
    w = W.partitionBy("series", "root").orderBy("m.row", "m.nth")
    kept = fresh.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= ALIASES)
    return rows, begun, kept.select("series", "root", F.col("m.alias").alias("alias"), F.col("m.ep").alias("ep"), "place")


def merge_entities(cards: DataFrame, hot: bool | None = None) -> DataFrame:
    """Entities of each series from ``(series, ep, pos, name, aliases, who)`` in episode order.

    The first row of an entity gives its name and description; a name already known as an alias joins that entity;
    aliases add up, first come, to six. All steps go by name within a series, so one large series is spread.
    """
    _, begun, aliases = _entities(cards, _hot(cards, hot), "who")
    listed = aliases.groupBy("series", "root").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "alias"))), lambda a: a["alias"]).alias("aliases"))
    out = join_on(begun, listed, ["series", "root"], "left")
    return out.select("series", "ord", "name", F.coalesce("aliases", F.expr("cast(array() as array<string>)")).alias("aliases"), "who")


def rank_entities(cards: DataFrame, sheets: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` entities ``(series, ord, name, aliases)`` named in most sheets ``(series, ep, name)``, then first seen."""
    seen = sheets.select("series", "ep", F.lower(F.trim("name")).alias("_n")).filter("_n <> ''").distinct().groupBy("series", "_n").agg(F.count(F.lit(1)).alias("_c"))
    names = cards.select("series", "ord", F.explode(F.concat(F.array("name"), "aliases")).alias("_a")).select("series", "ord", F.lower("_a").alias("_n")).distinct()
    hits = join_on(names, seen, ["series", "_n"]).groupBy("series", "ord").agg(F.max("_c").alias("hits"))
    ranked = join_on(cards, hits, ["series", "ord"], "left").fillna(0, ["hits"])
    w = W.partitionBy("series").orderBy(F.desc("hits"), "ord")
    # the plain rank is filtered first, so each task keeps its own best before the shuffle
    return ranked.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).withColumn("rank", F.col("_r") - 1).drop("_r")


def series_tail(sheets: DataFrame, hot: bool | None = None) -> DataFrame:
    """For every episode ``(series, ep, tail)``, the end of the latest earlier one."""
    near = scan(sheets.select("series", "ep", "tail"), ["series"], ["ep"], _hot(sheets, hot), _t=prev(F.col("tail")))
    return near.select("series", "ep", tx.trim_text(F.coalesce("_t", F.lit("")), TAIL).alias("tail"))


#: Rows of a series that one task walks (each may give k rows), and chunks whose best are brought together in one step.
WALK, WALK_ROWS, FAN = "spark.stripweave.chunkRows", 16_384, 64


def _best(rows: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The ``k`` highest (n, then lowest ord) of each group, each entity with its highest n."""
    w = W.partitionBy(*keys).orderBy(F.desc("n"), "ord")
    return rows.groupBy(*keys, "ord").agg(F.max("n").alias("n")).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def _carried(rows: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Rows (series, chunk, ord, n) to the ``k`` best of all chunks before each of ``chunks (series, chunk)``.

    The best of ``FAN`` chunks are brought together at a time and carried over likewise, so no step sees more than ``FAN * k`` rows of a
    chunk. An entity among the best of all was among the best of the chunk in which its count rose last, since counts only grow.
    """
    pack = F.floor(F.col("chunk") / FAN)
    own = durable(_best(rows, ["series", "chunk"], k).withColumn("pack", pack))
    chunks = chunks.withColumn("pack", pack)
    later = chunks.select(F.col("series").alias("_s"), F.col("pack").alias("_p"), F.col("chunk").alias("_c"))
    met = own.join(later, F.col("series").eqNullSafe(F.col("_s")) & (F.col("pack") == F.col("_p")) & (F.col("chunk") < F.col("_c"))).select("series", F.col("_c").alias("chunk"), "ord", "n")
    if chunks.filter("pack > 0").limit(1).count():
        far = _carried(own.select("series", F.col("pack").alias("chunk"), "ord", "n"), chunks.select("series", F.col("pack").alias("chunk")).distinct(), k)
        met = met.unionByName(join_on(chunks, far.withColumnRenamed("chunk", "pack"), ["series", "pack"]).select("series", "chunk", "ord", "n"))
    return _best(met, ["series", "chunk"], k)


def _prefix_top(events: DataFrame, asked: DataFrame, k: int, hot: bool) -> DataFrame:
    """For every asked (series, ep) the ``k`` entities of highest count before it: ``events (series, ep, ord, n)``, where counts of an entity only grow.

    A series is cut into chunks of its line of events and questions, however small it is, since a walk holds k rows for each question. Within
    a chunk only the best carried into it and the entities whose count rises there can be among the best, so chunks are walked side by
    side, each with a bounded number of rows.
    """
    line = events.withColumn("kind", F.lit(1)).unionByName(asked.select("series", "ep", F.lit(-1).cast("long").alias("ord"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("kind")))
    size = number_setting(events.sparkSession, WALK, WALK_ROWS)
    line = durable(number_rows(line, ["series"], ["ep", "kind", "ord"], "at", hot).withColumn("chunk", F.floor(F.col("at") / size)).drop("at"))
    if line.filter("chunk > 0").limit(1).count():
        held = _carried(line.filter("kind = 1").select("series", "chunk", "ord", "n"), line.select("series", "chunk").distinct(), k)
        line = line.unionByName(held.select("series", F.lit(None).cast("long").alias("ep"), "ord", "n", F.lit(1).alias("kind"), "chunk"))

    def walk(c, _):
        order, hits = [], {}
        out = {"ep": [], "rank": [], "ord": [], "hits": []}
        for ep, kind, i, n in zip(c["ep"].tolist(), c["kind"].tolist(), c["ord"].tolist(), c["n"].tolist()):
            if kind == 0:
                best = order[:k]
                out["ep"] += [int(ep)] * len(best)
                out["rank"] += range(len(best))
                out["ord"] += [o for _, o in best]
                out["hits"] += [-m for m, _ in best]
            elif n > hits.get(i, -1):
                if i in hits:
                    del order[bisect.bisect_left(order, (-hits[i], i))]
                hits[i] = n
                bisect.insort(order, (-n, i))
        return out, None

    return fold(line, ["series", "chunk"], ["ep", "kind"], walk, "series string, ep long, rank long, ord long, hits long", False)


def series_cards(cards: DataFrame, k: int = TOP, hot: bool | None = None, episodes: DataFrame | None = None) -> DataFrame:
    """The top entities known from strictly earlier episodes, for every episode of the cards or of ``episodes (series, ep)``.

    How many sheets name each entity so far is worked out as events per entity; only those numbers are walked in order, chunk by chunk of a large series.
    """
    hot = _hot(cards, hot)
    rows, begun, aliases = _entities(cards, hot)
    named = rows.select("series", F.lower("name").alias("token"), "ep").distinct()
    counted = named.withColumn("n", F.row_number().over(W.partitionBy("series", "token").orderBy("ep"))).withColumnRenamed("ep", "at")
    known = begun.select("series", "ord", F.lower("name").alias("token"), F.col("ep").alias("since")).unionByName(
        join_on(aliases, begun.select("series", "root", "ord"), ["series", "root"]).select("series", "ord", F.lower("alias").alias("token"), F.col("ep").alias("since")))
    # an entity has a token's count from the episode on in which both are known
    events = join_on(known, counted, ["series", "token"], "left").groupBy("series", "ord", F.greatest("since", F.coalesce("at", "since")).alias("ep")).agg(F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("n"))
    asked = (rows if episodes is None else episodes).select("series", F.col("ep").cast("long").alias("ep")).distinct()
    top = _prefix_top(events.select("series", F.col("ep").cast("long").alias("ep"), F.col("ord").cast("long").alias("ord"), "n"), asked, k, hot)
    listed = aliases.groupBy("series", "root").agg(F.array_sort(F.collect_list(F.struct("place", "alias", "ep"))).alias("_a"))
    facts = join_on(begun.select("series", "root", "ord", "name"), listed, ["series", "root"], "left").select("series", "ord", "name", "_a")
    whole = join_on(top, facts, ["series", "ord"])
    so_far = F.transform(F.filter(F.coalesce("_a", F.expr("cast(array() as array<struct<place: int, alias: string, ep: bigint>>)")), lambda a: a["ep"] < F.col("ep")), lambda a: a["alias"])
    return whole.select("series", "ep", "rank", "name", so_far.alias("aliases"), "hits")


def series_context(cards: DataFrame, sheets: DataFrame, episodes: DataFrame, k: int = TOP, hot: bool | None = None) -> DataFrame:
    """One row for every asked episode ``(series, ep)``: known entities in rank order and the tail of the latest earlier sheet.

    ``sheets (series, ep, tail)``. Both are empty where the series or the number is unknown, or nothing came before.
    """
    hot = _hot(cards, hot)
    asked = episodes.select("series", F.col("ep").cast("long").alias("ep")).distinct()
    told = series_cards(cards, k, hot, asked.filter("series is not null and ep is not null")).groupBy("series", "ep").agg(
        F.array_sort(F.collect_list(F.struct("rank", "name", "aliases", "hits"))).alias("_c"))
    # tails are cut before they are moved
    cut = tx.trim_text(F.coalesce("tail", F.lit("")), TAIL)
    line = sheets.select("series", F.col("ep").cast("long").alias("ep"), F.lit(1).alias("kind"), cut.alias("tail")).unionByName(
        asked.select("series", "ep", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("tail")))
    near = scan(line, ["series"], ["ep", "kind"], hot, _t=last_before(F.col("tail"))).filter("kind = 0 and series is not null and ep is not null")
    out = join_on(join_on(asked, told, ["series", "ep"], "left"), near.select("series", "ep", "_t"), ["series", "ep"], "left")
    none = F.expr("cast(array() as array<struct<rank: bigint, name: string, aliases: array<string>, hits: bigint>>)")
    return out.select("series", "ep", F.coalesce("_c", none).alias("cards"), F.coalesce("_t", F.lit("")).alias("tail"))


def chapter_sheets(chapters: DataFrame, scenes: DataFrame, cards: DataFrame) -> DataFrame:
    """Sheet of each chapter ``(ch, series, ep)``: its cards in order, and the end of its last story scene.

    Chapters without series or episode give none. ``cards (ch, pos, name, aliases, who)`` is one model answer per chapter; a card has
    its name, at most six aliases without blanks, and a description cut to its limit. A chapter's cards are one model answer, a short list.
    """
    told = scenes.filter(~F.col("is_filler") & (F.trim("narration") != "")).groupBy("ch").agg(F.max_by("narration", "idx").alias("_n"))
    good = _named(cards).withColumn("aliases", F.slice(F.coalesce("aliases", F.expr("cast(array() as array<string>)")), 1, ALIASES))
    card = F.struct("pos", "name", "aliases", F.coalesce("who", F.lit("")).alias("who"))
    listed = good.groupBy("ch").agg(F.transform(F.array_sort(F.collect_list(card)), lambda c: F.struct(c["name"].alias("name"), c["aliases"].alias("aliases"), c["who"].alias("who"))).alias("cards"))
    out = chapters.filter("series <> '' and ep is not null").join(told, "ch", "left").join(listed, "ch", "left")
    none = F.expr("cast(array() as array<struct<name: string, aliases: array<string>, who: string>>)")
    return out.select("ch", "series", "ep", F.coalesce("cards", none).alias("cards"), tx.trim_text(F.coalesce("_n", F.lit("")), TAIL).alias("tail"))


def sheet_cards(sheets: DataFrame) -> DataFrame:
    """The cards of ``chapter_sheets`` as rows ``(series, ep, pos, name, aliases, who)``: what later episodes merge and rank."""
    return sheets.select("series", "ep", F.posexplode("cards").alias("pos", "_c")).select("series", "ep", "pos", "_c.name", "_c.aliases", "_c.who")


def predecessors(urls: DataFrame, hot: bool | None = None) -> DataFrame:
    """Previous episode of the same series for ``(url, title_no, episode_no)``; rows lacking an id have none."""
    known = urls.filter("title_no is not null and episode_no is not null")
    hot = is_hot(known.select("title_no"), ["title_no"]) if hot is None else hot
    return scan(known, ["title_no"], ["episode_no", "url"], hot, previous=prev(F.col("url")))
