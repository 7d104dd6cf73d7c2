import random

import pytest

from stripweave.llm import toxicity as T
from stripweave.llm.common import read
from tests.llm.nasty import awkward, documents, empty


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_levenshtein():
    random.seed(1)
    terms = ["scum", "moron", "idiot", "stupid", "worthless", "disgusting", "mor", "worthles"]
    auto = T.LexiconAutomaton(terms, limit=500)
    for _ in range(4000):
        w = list(random.choice(terms))
        for _ in range(random.randint(0, 4)):
            k = random.randint(0, len(w))
            w[k : k + random.randint(0, 1)] = random.choice(["", "x", "o", "s"])
        w = "".join(w)
        want = min(((d, n) for n, t in enumerate(terms) if (d := distance(w, t)) <= T.edits_for(t)), default=None)
        assert auto.match(w) == want, w


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def small(spark):
    random.seed(2)
    clean = ["the boat went over the quiet water again " + " ".join(random.choice("abcdefgh") * 3 for _ in range(9)) for _ in range(240)]
    texts = [t + (" you are a worthless blockhead and a numskull" if i % 6 == 0 else "") for i, t in enumerate(clean)]
    return documents(spark, texts), _labels(spark, [(i, 0, int(i % 6 == 0)) for i in range(240)])


def test_misspelling_and_quotation(spark, small):
    model = T.fit(*small)
    assert {"blockhead", "numskull"} <= set(model.terms)
    texts = ["you blockhead, you utter numskull", "you bl0ckhead, you utter numskul", 'the report quotes the words "blockhead" and "numskull" as heard', "the boat went over the water", None, ""]
    s = {r["doc_id"]: r["toxicity"] for r in T.score_texts(documents(spark, texts).drop("toxicity"), model).collect()}
    assert s[0]["score"] > 0.5 and s[1]["score"] > 0.5 and s[1]["hits"] >= 2
    assert s[2]["score"] < 0.5 and s[2]["quoted"] >= 2
    assert s[3]["score"] < 0.5 and s[4]["score"] == s[5]["score"] == s[3]["score"]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = T.toxicity_report(read(spark, d, "documents"), read(spark, d, "labels")).where("held_out").join(read(spark, d, "labels"), "doc_id").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    caught = [r["predicted"] for r in rows if r["toxic"]]
    assert len(rows) > 700 and right / len(rows) > 0.97 and sum(caught) / len(caught) > 0.85
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_awkward_rows(spark, small):
    docs = awkward(spark)
    report = T.toxicity_report(docs, _labels(spark, [(0, 0, 1), (1, 0, 0), (6, 1, None), (None, 1, 1)]))
    assert report.count() == docs.count()
    assert T.toxicity_report(empty(spark), _labels(spark, [])).count() == 0
    none = T.toxicity_report(docs, _labels(spark, [])).collect()
    assert all(r["score"] < 1e-9 and r["predicted"] == 0 for r in none)
    kept = T.drop_toxic(small[0], small[1])
    assert kept.columns == small[0].columns and kept.count() == 200
