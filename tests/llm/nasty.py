"""Small tables with every awkward case: nulls, empty and long texts, repeats, clashing columns."""

LONG = " ".join(f"word{i % 977} lorem ipsum" for i in range(20_000))
CLASH = ["words", "ids", "overlap", "license", "toxicity", "language", "node", "shard", "term", "score", "u", "v", "w", "key", "old_shard", "r"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASH)


def documents(spark, texts):
    """Rows (id, text); ids count from 0 where a plain list of texts is given."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, None, "s", None, *["x"] * len(CLASH)) for i, t in rows], SCHEMA)


def awkward(spark, extra=()):
    base = [(0, None), (1, ""), (2, " \n\t "), (3, "a"), (4, LONG), (5, "same text of six short words"), (6, "same text of six short words"),
            (6, "same text of six short words"), (None, "no id at all but a text"), (None, None), (-9, "…  ¿? 123 \u0000 é")]
    return documents(spark, base + list(extra))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
