"""Titles, images and links of stored pages, episode lists and URL parts."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stripweave.functions.html import page_facts
from stripweave.functions.ordered import first_by, is_hot, scan, sum_to
from stripweave.functions import text as tx

SITE = "WEBTOON"  # fixed value: the site name that ends page titles
PLACEHOLDER = "bg_transparency"  # fixed value: the transparent stand-in image


PAGES = 64
TEXTS = {"subj": "info_subj", "any_subj": "subj", "episode": "episode", "title": "title", "h1": "h1", "label": "label"}


def parse_pages(pages: DataFrame) -> DataFrame:
    """Facts of each page ``(page_id, url, html)``, parsed once per row; everything after is columns.

    A task holds the facts of ``PAGES`` pages at a time, whatever the size of its batches.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), *[(n, pa.string()) for n in TEXTS], ("og", pa.string()),
                        ("images", pa.list_(pa.struct([("tier", pa.int32()), ("image", pa.string())]))), ("links", pa.list_(pa.string()))])

    # resolved here because joining relative references is a rule of its own
    def image(url: str, data_url: str, src: str) -> str | None:
        raw = data_url.strip() or ("" if PLACEHOLDER in src else src.strip())
        return urljoin(url, raw) if raw else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                some = batch.slice(at, PAGES)
                urls, facts = some.column("url").to_pylist(), [page_facts(h) for h in some.column("html").to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    "page_id": some.column("page_id"), "url": urls,
                    **{n: [f.found(k) for f in facts] for n, k in TEXTS.items()},
                    "og": [f.og for f in facts],
                    "images": [[{"tier": t, "image": image(u, a, s)} for t, a, s in f.images] for u, f in zip(urls, facts)],
                    "links": [[urljoin(u, x) for x in f.links] for u, f in zip(urls, facts)]}, schema=schema)

    texts = ", ".join(f"{n} string" for n in TEXTS)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        parse, f"page_id long, url string, {texts}, og string, images array<struct<tier: int, image: string>>, links array<string>")


def split_title(title: Column) -> tuple[Column, Column]:
    """Page title to (series, episode): site name off, cut at the first dash; the episode may be empty."""
    parts = F.transform(F.split(title, r" \| "), lambda x: F.trim(x))
    ends = (F.size(parts) > 1) & (F.upper(F.element_at(parts, -1)) == SITE)
    kept = F.array_join(F.filter(F.when(ends, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts), lambda x: x != ""), " | ")
    cut = F.split(kept, " - ", 2)
    return F.trim(cut[0]), F.when(F.size(cut) > 1, F.trim(F.get(cut, 1))).otherwise("")


def page_titles(parsed: DataFrame) -> DataFrame:
    """Series and episode of each page, by a chain of fallbacks."""
    def some(*cs: Column) -> Column:
        return F.coalesce(*[F.when(tx.spaced(c) != "", tx.spaced(c)) for c in cs], F.lit(""))

    series, episode = split_title(some(F.col("og"), F.col("title")))
    return parsed.select("page_id", some(F.col("subj"), F.col("any_subj"), series).alias("series"), some(F.col("episode"), episode).alias("episode"))


def page_image_urls(parsed: DataFrame) -> DataFrame:
    """Images of the first selector tier with a hit, in document order, as absolute URLs."""
    best = F.array_min(F.transform("images", lambda i: i["tier"]))
    p = parsed.withColumn("_t", best).select("page_id", F.posexplode(F.filter("images", lambda i: i["tier"] == F.col("_t"))).alias("pos", "_i"))
    return p.select("page_id", "pos", F.col("_i.image").alias("image")).filter("image is not null")


def page_links(parsed: DataFrame, key: Column | None = None) -> DataFrame:
    """First viewer link per episode of each page; ``key`` of the link column ``href`` may replace the episode number."""
    p = parsed.select("page_id", F.posexplode("links").alias("pos", "href"))
    if key is None:
        number = F.expr("try_cast(regexp_extract(href, '[?&]episode_no=([^&#]+)', 1) as bigint)")
        path = F.regexp_extract("href", r"^[^?#]*", 0)
        p = p.withColumn("episode_no", number).filter(F.col("episode_no").isNotNull() & path.contains("viewer"))
    else:
        p = p.withColumn("episode_no", key)
    return first_by(p, ["page_id", "episode_no"], [F.col("pos")]).select("page_id", "episode_no", F.col("href").alias("url"))


def discover_episodes(links: DataFrame, max_pages: int | None = None, hot: bool | None = None) -> DataFrame:
    """Episodes of each series over its list pages ``(series, page, episode_no, url)``.

    Pages from 1 in order up to the first that adds nothing (or is missing); the first URL of an episode
    wins. Where the caller sets a page limit, ``truncated`` tells where it cut a list that was still growing.
    """
    hot = is_hot(links.select("series"), ["series"]) if hot is None else hot
    first = first_by(links.select("series", "episode_no", "page", "url"), ["series", "episode_no"], [F.col("page"), F.col("url")])
    fresh = first.select("series", "page").distinct()
    steps = scan(fresh, ["series"], ["page"], hot, _n=sum_to(F.lit(1)))
    # while every page adds something, the page number equals the count so far
    unbroken = steps.groupBy("series").agg(F.max(F.when(F.col("_n") == F.col("page"), F.col("page"))).alias("_last"))
    kept = first.join(unbroken, "series").filter(F.col("page") <= F.col("_last"))
    if max_pages is None:
        return kept.select("series", "episode_no", "url", F.lit(False).alias("truncated"))
    return kept.filter(F.col("page") <= max_pages).select("series", "episode_no", "url", (F.col("_last") > max_pages).alias("truncated"))


def url_parts(df: DataFrame, url: str = "url", language: str = "en") -> DataFrame:
    """Ids, normalised address, viewer and list address and folder name of each URL."""
    u = F.col(url)
    base = F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    rest = F.substr(u, F.length(base) + 1)
    path = F.regexp_extract(rest, r"^[^?#]*", 0)
    tail = F.substr(rest, F.length(path) + 1)
    parts = F.split(path, "/")
    coded = F.coalesce(F.get(parts, 1).rlike("^[a-z]{2}(-[a-z]+)?$"), F.lit(False))
    named = F.concat(base, F.lit("/"), F.lit(language), F.when(F.size(parts) > 2, F.concat(F.lit("/"), F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), "/"))).otherwise(""), tail)
    segs = F.filter(parts, lambda x: x != "")
    last = F.element_at(F.concat(F.array(F.lit("")), segs), -1)

    def upto(n: int) -> Column:
        return F.slice(segs, 1, F.greatest(F.size(segs) - n, F.lit(0)))

    number = {n: F.expr(f"try_cast(regexp_extract({url}, '[?&]{n}=([^&#]+)', 1) as bigint)") for n in ("title_no", "episode_no")}
    lists = F.concat(base, F.lit("/"), F.array_join(F.concat(F.when(last == "viewer", upto(2)).when(last == "list", upto(1)).otherwise(segs), F.array(F.lit("list"))), "/"),
                     F.when(number["title_no"].isNotNull(), F.concat(F.lit("?title_no="), number["title_no"].cast("string"))).otherwise(""))
    stem = F.when(F.size(segs) >= 3, F.get(segs, 2)).otherwise(last)
    slug = tx.slug(stem)
    mark = F.when(number["episode_no"].isNotNull(), F.concat(F.lit("_ep"), number["episode_no"].cast("string"))).when(
        number["title_no"].isNotNull(), F.concat(F.lit("_t"), number["title_no"].cast("string"))).otherwise("")
    return df.withColumns({
        "title_no": number["title_no"], "episode_no": number["episode_no"], "normalized": F.when(coded, named).otherwise(u),
        "list_url": lists, "slug": F.concat(F.when(slug == "", "chapter").otherwise(slug), mark)})


def episode_url(url: Column, number: Column) -> Column:
    """Viewer address of another episode: its number put into the query, the rest kept."""
    base = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(F.substr(url, F.length(base) + 1), r"^[^?#]*", 0)
    mark = F.regexp_extract(url, "#.*$", 0)
    segs = F.filter(F.split(path, "/"), lambda x: x != "")
    last = F.element_at(F.concat(F.array(F.lit("")), segs), -1)
    way = F.when(last == "list", F.concat(F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(0))), F.array(F.lit("episode"), F.lit("viewer")))).when(
        last == "viewer", segs).otherwise(F.concat(segs, F.array(F.lit("viewer"))))
    pairs = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x.rlike("^[^=]+=.+"))
    name = F.transform(pairs, lambda x: F.substring_index(x, "=", 1))
    # a repeated key keeps its first value and place
    unique = F.filter(pairs, lambda x, i: F.array_position(name, F.get(name, i)) == i + 1)
    own = F.concat(F.lit("episode_no="), number.cast("string"))
    put = F.transform(unique, lambda x: F.when(x.startswith("episode_no="), own).otherwise(x))
    put = F.when(F.array_contains(name, "episode_no"), put).otherwise(F.concat(put, F.array(own)))
    return F.concat(base, F.lit("/"), F.array_join(way, "/"), F.lit("?"), F.array_join(put, "&"), mark)


def expand_range(requests: DataFrame, episodes: DataFrame) -> DataFrame:
    """Chapters lo..hi of each request ``(series, url, lo, hi)``: discovered address, else derived.

    One missing bound is the end of what was discovered (``episodes (series, episode_no, url)``); an inverted
    range is an error. With both missing a list address means the episodes as listed, without any between them,
    and a viewer address means itself. ``missing`` marks episodes the list does not have.
    """
    last = F.element_at(F.concat(F.array(F.lit("")), F.filter(F.split(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), "/"), lambda x: x != "")), -1)
    known = episodes.select("series").distinct().withColumn("_any", F.lit(True))
    asked = requests.withColumn("_open", F.col("lo").isNull() & F.col("hi").isNull()).withColumn("_list", last == "list").join(known, "series", "left")
    number = F.expr("try_cast(regexp_extract(url, '[?&]episode_no=([^&#]+)', 1) as bigint)")
    alone = asked.filter("_open and not _list").select("series", number.alias("episode_no"), "url", F.lit(False).alias("missing"))
    whole = asked.filter("_open and _list and _any").select("series").distinct().join(episodes, "series").select("series", "episode_no", "url", F.lit(False).alias("missing"))
    requests = asked.filter("not _open or (_list and _any is null)").drop("_open", "_list", "_any")
    ends = episodes.groupBy("series").agg(F.min("episode_no").alias("_lo"), F.max("episode_no").alias("_hi"))
    own = F.expr("try_cast(regexp_extract(url, '[?&]episode_no=([^&#]+)', 1) as bigint)")
    p = requests.join(ends, "series", "left").withColumn("_own", own)
    p = p.withColumns({"_a": F.coalesce("lo", "_lo", "_own", F.lit(1))}).withColumn("_b", F.coalesce("hi", "_hi", "_own", "_a"))
    bad = F.raise_error(F.concat(F.lit("range ends before it starts: "), F.col("series").cast("string"))).cast("array<bigint>")
    p = p.withColumn("episode_no", F.explode(F.when(F.col("lo") > F.col("hi"), bad).when(F.col("_a") <= F.col("_b"), F.sequence(F.col("_a").cast("long"), F.col("_b").cast("long")))))
    found = episodes.select("series", "episode_no", F.col("url").alias("_known"))
    out = p.join(found, ["series", "episode_no"], "left")
    ranged = out.select("series", "episode_no", F.coalesce("_known", episode_url(F.col("url"), F.col("episode_no"))).alias("url"), F.col("_known").isNull().alias("missing"))
    return ranged.unionByName(alone).unionByName(whole)


def chapter_meta(parsed: DataFrame, final_url: DataFrame | None = None) -> DataFrame:
    """One row per chapter page: ids by fallback, titles, number of images. ``final_url (page_id, final_url)``."""
    p = parsed if final_url is None else parsed.join(final_url, "page_id", "left")
    if final_url is None:
        p = p.withColumn("final_url", F.col("url"))
    one = url_parts(p.select("page_id", "url"), "url").select("page_id", F.col("title_no").alias("_t1"), F.col("episode_no").alias("_e1"))
    two = url_parts(p.select("page_id", "final_url"), "final_url").select("page_id", F.col("title_no").alias("_t2"), F.col("episode_no").alias("_e2"))
    label = F.expr("try_cast(regexp_extract(label, '^#*\\\\s*([0-9]+)$', 1) as bigint)")
    ids = p.select("page_id", "url", label.alias("_l")).join(one, "page_id").join(two, "page_id").select(
        "page_id", "url", F.coalesce("_t1", "_t2").alias("title_no"), F.coalesce("_e1", "_e2", "_l").alias("episode_no"))
    # a page's images are bounded by its text
    pics = page_image_urls(parsed).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "image"))).alias("_p"))
    out = ids.join(page_titles(parsed), "page_id").join(pics, "page_id", "left")
    episode = F.when((F.col("episode") == "") & F.col("episode_no").isNotNull(), F.concat(F.lit("Episode "), F.col("episode_no").cast("string"))).otherwise(F.col("episode"))
    return out.select("page_id", "url", "title_no", "episode_no", "series", episode.alias("episode"), F.transform(F.coalesce("_p", F.expr("cast(array() as array<struct<pos: int, image: string>>)")), lambda x: x["image"]).alias("images"))
