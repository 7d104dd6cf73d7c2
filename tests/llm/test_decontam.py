import re

import pytest
from pyspark.sql import functions as F

from stripweave.llm import decontam as D
from tests.llm.nasty import LONG, awkward, documents, empty


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, size):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n and i is not None else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, own = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    hit |= set(range(k, k + n))
                    own |= grams[g]
        out.append((d, len(w), len(hit), sorted(own), sorted(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "Alpha beta gamma delta"), (2, "gamma delta epsilon"), (3, "zeta"), (4, ""), (5, None), (None, "lorem ipsum"), (2, "gamma delta epsilon"), (6, "Éa ß 12")]
EXTRA = [(20, "x alpha, BETA gamma; delta epsilon y"), (21, "beta gamma delta epsilon zeta"), (22, "zeta zeta alpha"), (23, "éa Éa ß 12 q")]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_both_forms_are_brute_force(spark, limit):
    docs, items = awkward(spark, EXTRA), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rows = D.overlaps(docs, items, size=3, max_item_words=limit, into="__o").select("doc_id", "__o.*").collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), sorted(p for s in r["spans"] for p in range(s["first"], s["last"]))) for r in rows), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], ITEMS, 3)


def test_removal(spark):
    items = spark.createDataFrame(ITEMS[:2], "item_id bigint, text string")
    docs = documents(spark, [(1, "clean text stays AS is"), (2, "see alpha beta gamma delta here"), (3, "alpha beta gamma delta " + LONG), (4, None)])
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 3, 4]
    cut = {r["doc_id"]: r["text"] for r in D.decontaminate(docs, items, remove="spans").collect()}
    assert cut[2] == "see here" and cut[1] == "clean text stays AS is" and cut[4] is None
    with pytest.raises(ValueError):
        D.decontaminate(docs, items, remove="words")


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert D.overlaps(empty(spark), items).count() == 0
    assert D.overlaps(awkward(spark), items, into="__o").where("__o.n_hit > 0").count() == 0
    assert D.overlaps(awkward(spark), items, into="__o", max_item_words=-1).where("__o.n_hit > 0 or size(__o.items) > 0").count() == 0
    assert D.decontam_report(awkward(spark), items).where(F.col("contaminated")).count() == 0
