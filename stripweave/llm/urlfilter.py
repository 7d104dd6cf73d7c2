"""URL filters (5): host rules, and exact membership of listed keys by a Bloom filter cascade.

Level 1 holds the listed keys; level 2 the other keys of the corpus that level 1 wrongly passes; level 3 the listed keys
that level 2 wrongly passes; and so on until a level makes no mistake. Over all keys of the corpus (its universe, which
the levels are built from) the first level that refuses a key tells exactly whether it is listed, so the pages
are judged by bit tests alone. A level is an array of 64-bit words, read once as a scalar subquery; its size
follows the listed keys and is checked against ``MAX_BITS``, beyond which the pages meet the list in a join instead.

Only DataFrame and SQL functions. Null urls, and those without ``://``, have empty host and path; null keys are never
listed; an empty list blocks nothing; repeated rows are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import BITS_PER_KEY, MAX_BITS, Level, build_level
from .common import saved

#: Rules as (verdict, host/path).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: A host is listed if one of its dotted or dashed parts is one of these.
LISTED_PARTS = ["casino", "pills", "bets", "adult"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    found = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


class Cascade:
    """Exact membership in ``listed`` for every key of ``universe`` (both with a column ``key``)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS):
        flags = listed.select("key", F.lit(True).alias("listed")).unionByName(universe.select("key", F.lit(False).alias("listed")))
        self.keys = saved(flags.where("key is not null").groupBy("key").agg(F.max("listed").alias("listed")))
        self.levels: list[Level] = []
        self.max_bits, self.joins = max_bits, False
        own, other = self.keys.where("listed"), self.keys.where("not listed")
        while count := own.count():
            if count * BITS_PER_KEY > max_bits:
                self.joins = True
                break
            level = build_level(own, count, len(self.levels) + 1)
            self.levels.append(level)
            own, other = saved(other.where(level.passes(F.col("key")))), own

    def member(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(level.passes(key), out).otherwise(F.lit(level.number % 2 == 0))
        return F.coalesce(out, F.lit(False)) & key.isNotNull()

    def mark(self, rows: DataFrame, key: str, into: str) -> DataFrame:
        """``rows`` with a boolean ``into``: by the levels, or by a join where a level would pass its bound."""
        if not self.joins:
            return rows.withColumn(into, self.member(F.col(key)))
        listed = self.keys.where("listed").select(F.col("key").alias("__listed"))
        return rows.join(listed, F.col(key) == F.col("__listed"), "left").withColumn(into, F.col("__listed").isNotNull()).drop("__listed")


def hosts(pages: DataFrame) -> DataFrame:
    return pages.select(host_of(F.col("url")).alias("key")).distinct()


def listed_hosts(universe: DataFrame, parts=LISTED_PARTS) -> DataFrame:
    return universe.where(F.col("key").rlike(_part_pattern(parts)))


def _part_pattern(parts) -> str:
    return "(^|[.-])(" + "|".join(parts) + ")([.-]|$)"


def judge(pages: DataFrame, cascade: Cascade, *, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page: the rule's verdict, else block if the host is listed."""
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = cascade.mark(rows, "host", "listed").withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("best")["verdict"], F.when(F.col("listed"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("best")["rule"].alias("rule"), verdict.alias("verdict"), "listed")


def url_report(pages: DataFrame) -> DataFrame:
    universe = hosts(pages)
    return judge(pages, Cascade(listed_hosts(universe), universe))


REPORT_SQL = f"""
WITH h AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
  regexp_matches(host, '{_part_pattern(LISTED_PARTS)}') AS listed FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM r
"""
