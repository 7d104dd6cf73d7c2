"""Registered queries on artifacts, pages and texts, with their SQL texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stripweave.functions import text as tx
from stripweave.operators import texts as op, web
from stripweave.plans import views as v
from stripweave.sources import artifacts as ar
from stripweave.streaming.ledgers import working_folder

QUERIES, SQL = {}, {}


def query(name: str, text: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if text is not None:
            SQL[name] = text
        return fn
    return add


def docs(spark, d):
    return v.table(spark, d, "documents")


# --- A: artifacts ----------------------------------------------------------------------------
SCENE = "index int, narration string, emotion string, is_filler boolean"


def _stored(spark, d, fmt):
    path = working_folder(spark) + "/scenes"
    s = v.scenes(spark, d).select("ch", F.col("idx").cast("int").alias("index"), "narration", "emotion", "is_filler")
    ar.write_artifacts(s, path, ["ch"], fmt)
    return s, path


@query("a1_read_artifacts", v.sql("scenes", "SELECT 'ch=' || ch AS folder, idx AS \"index\", narration, emotion, is_filler FROM scenes"))
def a1(spark, d):
    _, path = _stored(spark, d, "json")
    rows, _ = ar.read_artifacts(spark, path, "scenes", lines=True, schema=SCENE, keys="ch long")
    return rows.select("folder", "index", "narration", "emotion", "is_filler")


@query("a1_read_listed", v.sql("scenes", "SELECT 'ch=' || ch AS folder, idx AS \"index\", narration, emotion, is_filler FROM scenes WHERE ch % 6 <> 5 UNION ALL SELECT DISTINCT 'ch=' || ch, -1, NULL, NULL, NULL FROM scenes WHERE ch % 6 = 5"))
def a1b(spark, d):
    """One object per chapter with its scenes in a list; every sixth chapter's file is cut short, and comes out apart."""
    path = working_folder(spark) + "/listed"
    s = v.scenes(spark, d)
    whole = s.groupBy("ch").agg(F.to_json(F.struct(F.lit("m").alias("model"), F.collect_list(F.struct(F.col("idx").cast("int").alias("index"), "narration", "emotion", "is_filler")).alias("scenes"))).alias("value"))
    cut = whole.withColumn("value", F.when(F.col("ch") % 6 == 5, F.expr("left(value, length(value) - 2)")).otherwise(F.col("value")))
    ar.write_files(cut.select(F.concat(F.lit("ch="), F.coalesce(F.col("ch").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))).alias("folder"), "value"), path, "scenes.json")
    rows, bad = ar.read_artifacts(spark, path, "scenes")
    lost = bad.select("folder", F.lit(-1).alias("index"), *[F.lit(None).cast(t).alias(n) for n, t in (("narration", "string"), ("emotion", "string"), ("is_filler", "boolean"))])
    return rows.select("folder", "index", "narration", "emotion", "is_filler").unionByName(lost)


@query("a2_write_artifacts", v.sql("scenes", "SELECT ch, idx AS \"index\", emotion FROM scenes WHERE ch % 5 <> 0 OR idx < 2"))
def a2(spark, d):
    s, path = _stored(spark, d, "parquet")
    ar.write_artifacts(s.filter("ch % 5 = 0 and index < 2"), path, ["ch"])
    return spark.read.parquet(path).select(F.col("ch").cast("long").alias("ch"), "index", "emotion")


@query("a3_read_url_list", "SELECT DISTINCT url FROM pages WHERE url NOT LIKE '#%'")
def a3(spark, d):
    path = working_folder(spark) + "/urls"
    u = v.table(spark, d, "pages").orderBy("page_id").select(F.explode(F.array(F.concat(F.lit("  "), "url"), F.concat(F.lit("# "), "url"), F.lit(""), F.col("url"))).alias("value"))
    u.write.text(path)
    return ar.read_url_list(spark, path).select("url")


@query("a4_chapter_catalog", v.sql("scenes", "WITH t AS (SELECT DISTINCT ch FROM scenes WHERE ch % 4 <> 0) SELECT 'c' || ch AS folder, coalesce(CASE WHEN doc_id % 3 <> 0 THEN doc_id % 9 END, 0) AS episode_no FROM t LEFT JOIN documents ON doc_id = ch"))
def a4(spark, d):
    t = v.scenes(spark, d).filter("ch % 4 <> 0").select(F.concat(F.lit("c"), F.col("ch").cast("string")).alias("folder"))
    c = docs(spark, d).select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("folder"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 9).alias("episode_no"))
    return ar.chapter_catalog(t, c)


@query("a5_strip_rows", v.sql("strip_rows", "SELECT strip, y, CAST(list_sum(list_transform(range(1, 23), lambda i: i * ((px[i] * 4899 + px[i + 21] * 9617 + px[i + 42] * 1868 + 8192) >> 14))) AS BIGINT) AS mark FROM strip_rows"))
def a5(spark, d):
    r = v.strip_rows(spark, d)
    g = ar.grey_rows(r.select("strip", "y", *[F.slice("px", 1 + 21 * i, 22).alias(c) for i, c in enumerate("rgb")]))
    marks = F.aggregate(F.transform("px", lambda x, i: x * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return g.select("strip", "y", marks.alias("mark"))


@query("a6_stale_inputs", "SELECT doc_id FROM documents WHERE doc_id % 10 = 3 OR doc_id % 7 = 6")
def a6(spark, d):
    t = docs(spark, d).select("doc_id", ar.row_digest("text", "lang").alias("digest"))
    old = docs(spark, d).filter("doc_id % 7 <> 6").withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    done = ar.made_from(old.select("doc_id", ar.row_digest("text", "lang").alias("digest")), "2", "margin=0")
    return ar.stale_inputs(t, done, ["doc_id"], "2", "margin=0").select("doc_id")


@query("a6_group_digest", "WITH s AS (SELECT source FROM documents GROUP BY source HAVING bool_or(doc_id % 97 = 5)) SELECT source FROM s")
def a6b(spark, d):
    t = docs(spark, d)
    old = t.withColumn("text", F.when(F.col("doc_id") % 97 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    done = ar.made_from(ar.group_digest(old, ["source"], F.col("doc_id").cast("string"), "text"), "1")
    return ar.stale_inputs(ar.group_digest(t, ["source"], F.col("doc_id").cast("string"), "text"), done, ["source"], "1").select("source")


# --- B: pages --------------------------------------------------------------------------------
UNESCAPE = "replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
HOST = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"


def _parsed(spark, d, html=None):
    p = v.table(spark, d, "pages")
    return web.parse_pages(p if html is None else p.withColumn("html", html))


def _imaged():
    """Two tiers of images, a placeholder and a relative address, put in front of every page."""
    n = F.col("page_id").cast("string")
    return F.concat(F.lit('<a href="/en/viewer?episode_no='), n, F.lit('">x</a><a href="/en/viewer?episode_no='), n, F.lit('&amp;again">y</a><a href="/en/viewer?episode_no=z">z</a><img class="big _images" src="/out.png">'),
                    F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<div id="_imageList"><p><img class="_images" src="/bg_transparency.png" data-url="/a/'), n, F.lit('.png"><img class="_images" src="/bg_transparency.png"><img class="_images" src="http://h/b.png"></p></div>'))).otherwise(""), F.col("html"))


TITLES = f"""WITH t AS (SELECT page_id, trim(regexp_replace({UNESCAPE.format(x="regexp_extract(html, '<title>([^<]*)</title>', 1)")}, '\\s+', ' ', 'g')) AS t FROM pages)
  SELECT page_id, CASE WHEN contains(t, ' - ') THEN trim(split_part(t, ' - ', 1)) ELSE t END AS series, CASE WHEN contains(t, ' - ') THEN trim(substr(t, strpos(t, ' - ') + 3)) ELSE '' END AS episode FROM t"""


@query("b1_page_titles", TITLES)
def b1(spark, d):
    return web.page_titles(_parsed(spark, d))


IMAGES = f"""SELECT page_id, 0 AS pos, {HOST} || CASE WHEN page_id % 2 = 0 THEN '/a/' || page_id || '.png' ELSE '/out.png' END AS image FROM pages UNION ALL SELECT page_id, 2, 'http://h/b.png' FROM pages WHERE page_id % 2 = 0"""


@query("b2_page_image_urls", IMAGES)
def b2(spark, d):
    return web.page_image_urls(_parsed(spark, d, _imaged()))


@query("b3_page_links", f"SELECT page_id, page_id AS episode_no, {HOST} || '/en/viewer?episode_no=' || page_id AS url FROM pages")
def b3(spark, d):
    return web.page_links(_parsed(spark, d, _imaged()))


@query("b3_all_links", f"WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS h FROM pages) SELECT DISTINCT page_id, CASE WHEN starts_with(h, '/') THEN {HOST} || h ELSE h END AS url FROM l")
def b3b(spark, d):
    return web.page_links(_parsed(spark, d), F.col("href")).select("page_id", "url")


@query("b4_discover_episodes", """WITH l AS (SELECT source AS series, 1 + doc_id % 7 + CASE WHEN doc_id % 7 > 4 THEN 1 ELSE 0 END AS page, doc_id % 23 AS episode_no, 'u' || doc_id AS url FROM documents),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series, episode_no ORDER BY page, url) AS rn FROM l) WHERE rn = 1),
  s AS (SELECT series, page, row_number() OVER (PARTITION BY series ORDER BY page) AS n FROM (SELECT DISTINCT series, page FROM f)), e AS (SELECT series, max(page) AS m FROM s WHERE n = page GROUP BY series)
  SELECT f.series, episode_no, url, false AS truncated FROM f JOIN e ON e.series = f.series AND page <= m""")
def b4(spark, d):
    n = F.col("doc_id") % 7
    return web.discover_episodes(docs(spark, d).select(F.col("source").alias("series"), (1 + n + F.when(n > 4, 1).otherwise(0)).alias("page"), (F.col("doc_id") % 23).alias("episode_no"),
                                                       F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url")))


@query("b5_url_parts", f"""WITH u AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '[?#].*', '') || '?title_no=' || page_id || '&episode_no=' || CASE WHEN page_id % 2 = 0 THEN 'x' ELSE CAST(page_id % 50 AS VARCHAR) END ELSE url END AS url FROM pages),
  p AS (SELECT *, {HOST} AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?#].*$', 0) AS tail FROM u),
  s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS g, TRY_CAST(regexp_extract(url, '[?&]title_no=([^&#]+)', 1) AS BIGINT) AS t, TRY_CAST(regexp_extract(url, '[?&]episode_no=([^&#]+)', 1) AS BIGINT) AS e FROM p)
  SELECT page_id, coalesce(t, -1) AS title_no, coalesce(e, -1) AS episode_no, CASE WHEN regexp_full_match(g[1], '[a-z]{{2}}(-[a-z]+)?') THEN host || '/en' || CASE WHEN len(string_split(path, '/')) > 2 THEN '/' || array_to_string(string_split(path, '/')[3:], '/') ELSE '' END || tail ELSE url END AS normalized,
    host || '/' || array_to_string(list_append(g, 'list'), '/') || coalesce('?title_no=' || t, '') AS list_url,
    regexp_replace(regexp_replace(lower(CASE WHEN len(g) >= 3 THEN g[3] ELSE g[-1] END), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || coalesce('_ep' || e, '_t' || t, '') AS slug FROM s""")
def b5(spark, d):
    u = F.when(F.col("page_id") % 3 == 0, F.concat(F.regexp_replace("url", "[?#].*", ""), F.lit("?title_no="), F.col("page_id").cast("string"), F.lit("&episode_no="),
                                                   F.when(F.col("page_id") % 2 == 0, "x").otherwise((F.col("page_id") % 50).cast("string")))).otherwise(F.col("url"))
    out = web.url_parts(v.table(spark, d, "pages").select("page_id", u.alias("url")))
    return out.drop("url").fillna(-1, ["title_no", "episode_no"])


@query("b6_expand_range", """WITH e AS (SELECT o_custkey AS series, o_orderkey % 12 AS episode_no, min('u' || o_orderkey) AS url FROM orders GROUP BY 1, 2), b AS (SELECT series, min(episode_no) AS lo, max(episode_no) AS hi FROM e GROUP BY series),
  r AS (SELECT series, unnest(range(1, hi + 1)) AS episode_no FROM b WHERE series % 2 = 0 UNION ALL SELECT series, episode_no FROM e WHERE series % 2 = 1)
  SELECT r.series, r.episode_no, coalesce(e.url, 'http://x.com/en/s/episode/viewer?title_no=' || r.series || '&episode_no=' || r.episode_no) AS url, e.url IS NULL AS missing FROM r LEFT JOIN e ON e.series = r.series AND e.episode_no = r.episode_no""")
def b6(spark, d):
    o = v.table(spark, d, "orders")
    e = o.groupBy(F.col("o_custkey").alias("series"), (F.col("o_orderkey") % 12).alias("episode_no")).agg(F.min(F.concat(F.lit("u"), F.col("o_orderkey").cast("string"))).alias("url"))
    r = e.filter("episode_no >= 1 or series % 2 = 1").select("series").distinct().select("series", F.concat(F.lit("http://x.com/en/s/list?title_no="), F.col("series").cast("string")).alias("url"),
                                                   F.when(F.col("series") % 2 == 0, 1).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"))
    return web.expand_range(r, e)


@query("b7_chapter_meta", f"""WITH ti AS ({TITLES}), im AS (SELECT page_id, string_agg(image, ' ' ORDER BY pos) AS images FROM ({IMAGES}) GROUP BY page_id),
  n AS (SELECT page_id, url, CASE WHEN page_id % 3 > 0 THEN page_id % 40 END AS title_no, CASE WHEN page_id % 3 = 2 THEN page_id END AS episode_no FROM pages)
  SELECT page_id, url, title_no, episode_no, series, CASE WHEN episode = '' AND episode_no IS NOT NULL THEN 'Episode ' || episode_no ELSE episode END AS episode, coalesce(images, '') AS images FROM n JOIN ti USING (page_id) LEFT JOIN im USING (page_id)""")
def b7(spark, d):
    """A third of the addresses lead on to one with both numbers, a third to one with the title alone, the rest nowhere."""
    i = F.col("page_id")
    led = v.table(spark, d, "pages").select("page_id", F.when(i % 3 == 2, F.concat(F.lit("https://x.org/viewer?title_no="), (i % 40).cast("string"), F.lit("&episode_no="), i.cast("string")))
                                            .when(i % 3 == 1, F.concat(F.lit("https://x.org/list?title_no="), (i % 40).cast("string"))).otherwise("https://x.org/").alias("final_url"))
    return web.chapter_meta(_parsed(spark, d, _imaged()), led).withColumn("images", F.array_join("images", " "))


# --- C: texts --------------------------------------------------------------------------------
SP = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query("c1_prepare_text", f"""WITH m AS (SELECT doc_id, replace(replace(text, 'er ', 'e‘r '), ', ', '—') AS t FROM documents),
  c AS (SELECT doc_id, {SP.format(x="replace(replace(t, '‘', ''''), '—', ' - ')")} AS p, {SP.format(x='t')} AS c FROM m)
  SELECT doc_id, CASE WHEN regexp_matches(p, '[.!?]$') THEN p ELSE p || '.' END AS prepared, c AS cleaned FROM c""")
def c1(spark, d):
    t = F.replace(F.replace(F.col("text"), F.lit("er "), F.lit("e​‘r ")), F.lit(", "), F.lit("—"))
    return docs(spark, d).select("doc_id", t.alias("t")).select("doc_id", tx.prepare_text(F.col("t")).alias("prepared"), F.replace(tx.clean_text(F.col("t")), F.lit("x​"), F.lit("")).alias("cleaned"))


@query("c2_split_sentences", r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+([A-Z0-9"''(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS s FROM documents)
  SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM s""")
def c2(spark, d):
    return op.split_sentences(docs(spark, d), "doc_id", "text")


@query("c3_balanced_chunks", r"""WITH a AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents), b AS (SELECT doc_id, CASE WHEN regexp_matches(c, '[.!?]$') THEN c ELSE c || '.' END AS c FROM a),
  s AS (SELECT doc_id, generate_subscripts(l, 1) AS sp, unnest(l) AS s FROM (SELECT doc_id, string_split(regexp_replace(c, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS l FROM b)),
  w AS (SELECT *, string_split(s, ' ') AS w FROM s WHERE s <> ''), g AS (SELECT *, len(w) AS n, CAST(ceil(len(w) / 5.0) AS BIGINT) AS g FROM w), k AS (SELECT *, unnest(range(g)) AS k FROM g)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sp, k) - 1 AS pos, array_to_string(w[k * (n // g) + least(k, n % g) + 1 : (k + 1) * (n // g) + least(k + 1, n % g)], ' ') AS chunk FROM k""")
def c3(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(tx.balanced_chunks(F.col("text"), 5)).alias("pos", "chunk"))


PATTERNS = [r"(?:^|[.!?]\s+)(?:the|les|der|el)\s", r"\s(?:the|und|que) [a-z]+\s", r"[0-9]{3,}"]
_ROWS = " UNION ALL ".join(f"SELECT doc_id, {i} AS pattern, unnest(regexp_extract_all(text, '(?i){p}')) AS hit FROM documents" for i, p in enumerate(PATTERNS))


@query("c4_scan_patterns", f"WITH h AS ({_ROWS}) SELECT doc_id, pattern, trim(hit) AS hit FROM h")
def c4(spark, d):
    return op.scan_patterns(docs(spark, d), "doc_id", "text", PATTERNS)


def _found() -> str:
    each = " UNION ALL ".join(f"SELECT doc_id, {i} AS pattern, unnest(regexp_extract_all(t, '(?i)(?:{p.replace(chr(39), chr(39) * 2)})')) AS hit FROM x" for i, p in enumerate(op.FORBIDDEN))
    return f"WITH x AS (SELECT doc_id, 'In this panel, we can see the camera. The image shows ' || text AS t FROM documents) SELECT doc_id, pattern, trim(hit) AS hit FROM ({each})"


@query("c4_forbidden", _found())
def c4b(spark, d):
    t = F.concat(F.lit("In this panel, we can see the camera. The image shows "), "text")
    return op.scan_patterns(docs(spark, d).select("doc_id", t.alias("text")), "doc_id", "text")


@query("c4_generic_opening", r"SELECT doc_id, split_part(regexp_replace(trim(text), '([.!?])\s+([A-Z0-9\"''(\[])', '\1' || chr(1) || '\2', 'g'), chr(1), 1) AS opening FROM documents WHERE regexp_matches(split_part(regexp_replace(trim(text), '([.!?])\s+([A-Z0-9\"''(\[])', '\1' || chr(1) || '\2', 'g'), chr(1), 1), '(?i)^\s*(the|les|der|el)\s')".replace('\\"', '"'))
def c4c(spark, d):
    first = op.generic_opening(F.col("text"), [r"^\s*(?:the|les|der|el)\s"])
    return docs(spark, d).select("doc_id", first.alias("opening")).filter("opening is not null")


SCRUBBED = r"""WITH a AS (SELECT doc_id, 'In this panel, we can see that ' || text || ' Here, we now watch how it ends. we see more.' AS t FROM documents),
  b AS (SELECT doc_id, regexp_replace(t, '(^|[.!?]\s+)in (?:this|the|that) (?:panel|panels|scene|image|frame|picture|illustration|shot|page),?\s+', '\1', 'gi') AS t FROM a),
  c AS (SELECT doc_id, regexp_replace(t, '(^|[.!?]\s+)(?:here|ici),?\s+', '\1', 'gi') AS t FROM b),
  e AS (SELECT doc_id, regexp_replace(t, '(^|[.!?]\s+)we (?:can |then |now )?(?:see|watch|observe) (?:that |how )?', '\1', 'gi') AS t FROM c),
  f AS (SELECT doc_id, regexp_replace(t, '\bwe (?:can |then |now )?(?:see|watch) (?:that |how )?', '', 'gi') AS t FROM e),
  g AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?]\s+)([a-z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM f)
  SELECT doc_id, trim(regexp_replace(array_to_string(list_transform(s, lambda x: CASE WHEN regexp_matches(x, '^[a-z]') THEN upper(x[1]) || x[2:] ELSE x END), ''), '\s+', ' ', 'g')) AS text FROM g""".replace("\\\\", "\\")


@query("c5_scrub_text", SCRUBBED)
def c5(spark, d):
    t = F.concat(F.lit("In this panel, we can see that "), "text", F.lit(" Here, we now watch how it ends. we see more."))
    return docs(spark, d).select("doc_id", op.scrub_text(t).alias("text"))


WORDS = {"the": "THEE", "und": "and-y", "que": "/kə/", "les": "lay", "with": "w$ith", "der": "dare", "_note": "no"}


def _put(x: str) -> str:
    for k in sorted((k for k in WORDS if not k.startswith("_")), key=len, reverse=True):
        val = f"[{k}]({WORDS[k]})" if WORDS[k].startswith("/") else WORDS[k]
        for _ in range(2):
            x = f"regexp_replace({x}, '(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){k}([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)', '\\1' || chr(2) || '\\2', 'g')"
        x = f"replace({x}, chr(2), '{val}')"
    return x


@query("c6_apply_dictionary", f"SELECT doc_id, {_put('text')} AS text FROM documents")
def c6(spark, d):
    return docs(spark, d).select("doc_id", op.apply_dictionary(F.col("text"), WORDS).alias("text"))


@query("c6_large_dictionary", f"SELECT doc_id, {_put('text')} AS text FROM documents")
def c6b(spark, d):
    words = spark.createDataFrame([(k, x) for k, x in WORDS.items() if not k.startswith("_")], "word string, value string")
    return op.apply_large_dictionary(docs(spark, d).select("doc_id", "text"), "doc_id", "text", words)


@query("c7_trim_text", f"WITH t AS (SELECT doc_id, {SP.format(x='text')} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 160 THEN t ELSE regexp_replace(substr(t, 1, 160), ' [^ ]*$', '') || '...' END AS text FROM t")
def c7(spark, d):
    return docs(spark, d).select("doc_id", tx.trim_text(F.col("text"), 160).alias("text"))


LABELS = "CASE event_type WHEN 'click' THEN 'Joyful ' WHEN 'error' THEN 'HORROR' WHEN 'purchase' THEN 'epic' WHEN 'signup' THEN 'odd' ELSE 'battle' END"


@query("c8_coerce_labels", f"SELECT event_id, CASE event_type WHEN 'click' THEN 'happy' WHEN 'error' THEN 'fear' WHEN 'purchase' THEN 'epic' WHEN 'signup' THEN 'neutral' ELSE 'action' END AS emotion, event_type IN ('click', 'view') AS flag, CASE WHEN event_id % 5 = 4 THEN 2 ELSE greatest(1, least(3, event_id % 7)) END AS weight FROM events")
def c8(spark, d):
    e = v.table(spark, d, "events")
    flag = F.when(F.col("event_type") == "click", " Yes").when(F.col("event_type") == "view", "1").otherwise("no")
    weight = F.when(F.col("event_id") % 5 == 4, "heavy").otherwise((F.col("event_id") % 7).cast("string"))
    return e.select("event_id", op.coerce_emotion(F.expr(LABELS)).alias("emotion"), op.coerce_bool(flag).alias("flag"), op.coerce_weight(weight).alias("weight"))


@query("c9_slug_keys", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 't' || p_partkey ELSE 's-' || regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END AS key,
  substr(trim(regexp_replace(regexp_replace(p_name || ' - a/b: ' || p_partkey, '[<>:"/\\\\|?*]+', ' ', 'g'), '\\s+', ' ', 'g')), 1, 80) AS project FROM part""")
def c9(spark, d):
    p = v.table(spark, d, "part")
    return p.select("p_partkey", op.series_key(F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey")), F.col("p_name")).alias("key"),
                    op.project_name(F.col("p_name"), F.concat(F.lit("a/b: "), F.col("p_partkey").cast("string")), "none").alias("project"))


@query("c9_ascii_safe", "SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS text FROM documents")
def c9b(spark, d):
    return docs(spark, d).select("doc_id", op.ascii_safe(F.col("text")).alias("text"))


@query("c10_normalize_hook", r"""WITH a AS (SELECT doc_id, regexp_replace(upper(regexp_replace(regexp_replace(replace(text, 'ß', 'ss'), '^[\s"''«»\-–—]+', ''), '[\s"''«»\-–—.,;:!?]+$', '')), '[^A-Z0-9'' ]+', ' ', 'g') AS t FROM documents),
  w AS (SELECT doc_id, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM a)
  SELECT doc_id, CASE WHEN length(array_to_string(w[:3], ' ')) <= 18 THEN array_to_string(w[:3], ' ') WHEN length(array_to_string(w[:2], ' ')) <= 18 THEN array_to_string(w[:2], ' ') ELSE substr(w[1], 1, 18) END AS hook FROM w WHERE len(w) > 0""")
def c10(spark, d):
    return docs(spark, d).select("doc_id", op.normalize_hook(F.col("text")).alias("hook")).filter("hook is not null")


@query("c11_assemble_text", v.sql("scenes", "SELECT ch, idx // 4 AS part, string_agg('Beat ' || idx || ' (panels ' || idx || ', ' || (idx + 1) || ')' || CASE WHEN is_filler THEN ' [FILLER - do not narrate]' ELSE '' END || ': ' || narration || CASE WHEN idx % 2 = 0 THEN ' | Characters: ' || emotion || ', x' ELSE '' END || CASE WHEN idx % 3 = 0 THEN ' | Dialogue: \"hi\" / \"' || emotion || '\"' ELSE '' END, chr(10) ORDER BY idx) AS text FROM scenes GROUP BY ch, idx // 4"))
def c11(spark, d):
    s = v.scenes(spark, d)
    none = F.expr("cast(array() as array<string>)")
    line = op.beat_line(F.col("idx"), F.array("idx", F.col("idx") + 1), F.col("narration"), F.col("is_filler"), F.when(F.col("idx") % 2 == 0, F.array("emotion", F.lit("x"))).otherwise(none),
                        F.when(F.col("idx") % 3 == 0, F.array(F.lit("hi"), F.col("emotion"))).otherwise(none))
    return op.assemble_text(s.select("ch", "idx", line.alias("line")), ["ch"], "idx", "line", 4)


@query("c11_head_tail", v.sql("scenes", "WITH r AS (SELECT ch, idx, row_number() OVER (PARTITION BY ch ORDER BY idx) AS a, row_number() OVER (PARTITION BY ch ORDER BY idx DESC) AS b, count(*) OVER (PARTITION BY ch) AS n FROM scenes) SELECT ch, idx, 'head' AS side FROM r WHERE a <= 3 UNION ALL SELECT ch, idx, 'tail' FROM r WHERE b <= 3 AND n > 3"))
def c11b(spark, d):
    return op.head_tail(v.scenes(spark, d).select("ch", "idx"), ["ch"], "idx")


@query("c12_parse_model_json", """SELECT event_id, CASE WHEN event_id % 7 = 5 THEN 'truncated' WHEN event_id % 7 = 6 THEN 'invalid' ELSE 'ok' END AS status, CASE WHEN event_id % 7 < 5 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) ELSE -1 END AS k FROM events""")
def c12(spark, d):
    p = F.col("props")
    raw = (F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('{"items":['), p, F.lit("]}"))).when(F.col("event_id") % 7 == 1, F.concat(F.lit('```json\n{"items":['), p, F.lit("]}\n```")))
           .when(F.col("event_id") % 7 == 2, F.concat(F.lit("{items: ["), p, F.lit(",]}"))).when(F.col("event_id") % 7 == 3, F.concat(F.lit("["), p, F.lit("]")))
           .when(F.col("event_id") % 7 == 4, F.concat(F.lit('Sure: {"items":['), p, F.lit("]} done"))).when(F.col("event_id") % 7 == 5, F.concat(F.lit('{"items":['), p)).otherwise("no json here"))
    e = v.table(spark, d, "events").select("event_id", raw.alias("answer"))
    out = op.parse_model_json(e, "answer", "items array<struct<k: bigint>>, plan struct<peak_id: int>", "items", {"plan": '{"peak_id": -1}'})
    return out.select("event_id", "status", F.when(F.col("status") == "ok", F.col("parsed.items")[0]["k"]).otherwise(-1).alias("k"))


@query("c13_text_stats", v.sql("scenes audio", f"""WITH s AS (SELECT a.ch, a.scene, CASE s.idx % 4 WHEN 0 THEN 'af_x' WHEN 1 THEN 'am_y' WHEN 2 THEN 'bf_z' ELSE 'zm_q' END AS voice, narration, duration_s FROM scenes s JOIN audio a ON a.ch = s.ch AND a.scene = s.idx)
  SELECT ch, scene, len(string_split({SP.format(x='narration')}, ' ')) AS n_words, round(len(string_split({SP.format(x='narration')}, ' ')) * 60 / duration_s, 6) AS words_per_minute, round(duration_s / (1 + ch % 3), 6) AS realtime,
   CASE WHEN voice[2] = 'f' THEN 'feminine' ELSE 'masculine' END AS gender, CASE voice[1] WHEN 'a' THEN 'american' WHEN 'b' THEN 'british' ELSE voice[1] END AS accent FROM s"""))
def c13(spark, d):
    return _stats(spark, d).select("ch", "scene", "n_words", F.round("words_per_minute", 6).alias("words_per_minute"), F.round("realtime", 6).alias("realtime"), "gender", "accent")


def _stats(spark, d):
    names = F.array(*[F.lit(x) for x in ("af_x", "am_y", "bf_z", "zm_q")])
    s = v.scenes(spark, d).select("ch", F.col("idx").alias("scene"), F.col("narration").alias("text"), F.element_at(names, (F.col("idx") % 4 + 1).cast("int")).alias("voice"))
    return op.text_stats(s.join(v.audio(spark, d), ["ch", "scene"]).withColumn("compute_s", (1 + F.col("ch") % 3).cast("double")))


@query("c13_fastest_slowest", v.sql("scenes audio", f"""WITH s AS (SELECT a.ch, 'v' || a.scene AS voice, len(string_split({SP.format(x='narration')}, ' ')) * 60 / duration_s AS r FROM scenes s JOIN audio a ON a.ch = s.ch AND a.scene = s.idx)
  SELECT ch, arg_min(voice, (-r, voice)) AS fastest, arg_min(voice, (r, voice)) AS slowest FROM s GROUP BY ch"""))
def c13b(spark, d):
    return op.fastest_slowest(_stats(spark, d).withColumn("voice", F.concat(F.lit("v"), F.col("scene").cast("string"))), ["ch"])
