import numpy as np
import pytest

from stripweave.llm import langid as L
from stripweave.llm.common import read
from tests.llm.nasty import LONG, awkward, documents, empty


def test_viterbi_is_brute_force(monkeypatch):
    monkeypatch.setattr(L, "SEGMENT", 5)
    rng = np.random.default_rng(1)
    vocab = ["w" + c for c in "abcdefghij"]
    for _ in range(150):
        m = L.Languages(["a", "b", "c"], {"latin": [True] * 3}, {}, np.zeros((0, 3)), 2.0)
        score = -rng.random((10, 3)).astype(np.float32) * 4
        m.cache, m.table = {w: i for i, w in enumerate(vocab)}, [np.column_stack([score, np.ones(10, np.float32)])]
        texts = [" ".join(rng.choice(vocab, size=rng.integers(0, 23))) for _ in range(6)] + [None]
        for t, (_, label, _) in zip(texts, m.label(texts)):
            s = np.array([score[vocab.index(x)] for x in (t or "").split()], float).reshape(-1, 3)
            if len(s):
                best = s[0]
                for x in s[1:]:
                    best = np.maximum(best, best.max() - 2.0) + x
                own = sum(s[i, k] for i, k in enumerate(label)) - 2.0 * (np.diff(label) != 0).sum()
                assert abs(own - best.max()) < 1e-5
            else:
                assert len(label) == 0


def test_held_out_accuracy(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    rows = L.language_report(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.fixture(scope="module")
def model(spark):
    texts = [("the house and the river with the old bridge", "en"), ("das haus und der fluss mit der alten brücke", "de"), ("дом и река со старым мостом", "ru")]
    rows = [(i, texts[i % 3][0], texts[i % 3][1]) for i in range(90)]
    return L.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))


def test_spans_of_mixed_text(spark, model):
    text = "the house and the river with the old bridge the river and the house река со старым мостом"
    r = L.label_spans(documents(spark, [text, "река", "12 ?!", None]).drop("language"), model).orderBy("doc_id").collect()
    assert [(s["first"], s["last"], s["lang"]) for s in r[0]["language"]["spans"]] == [(0, 14, "en"), (14, 18, "ru")]
    assert r[0]["language"]["lang"] == "en" and r[1]["language"]["lang"] == "ru"
    assert [x["language"]["lang"] for x in r[2:]] == ["und", "und"] and not r[2]["language"]["spans"]


def test_script_ranges():
    assert [L.script_of(w) for w in ("été", "река", "λόγος", "漢字", "ひらがな", "한글", "שלום")] == ["latin", "cyrillic", "greek", "han", "kana", "hangul", "hebrew"]


def test_awkward_rows(spark, model):
    docs = awkward(spark, [(40, "the river " * 50_000)])
    got = {r["doc_id"]: r["__l"] for r in L.label_spans(docs, model, into="__l").collect()}
    assert got[0]["lang"] == got[1]["lang"] == got[2]["lang"] == "und" and got[40]["lang"] == "en" and len(got[40]["spans"]) == 1
    assert got[4]["lang"] in model.langs and LONG
    none = L.language_report(docs).collect()  # no language is known
    assert {r["lang_pred"] for r in none} == {"und"} and len(none) == docs.count()
    assert L.language_report(empty(spark)).count() == 0
    assert L.keep_known(empty(spark)).columns == empty(spark).columns
