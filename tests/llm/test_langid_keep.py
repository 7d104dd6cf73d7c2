from stripweave.llm import langid as L
from tests.llm.nasty import documents

TEXTS = [("the house and the river with the old bridge", "en"), ("das haus und der fluss mit der alten brücke", "de"), ("дом и река со старым мостом", "ru")]


def test_three_languages_in_one_document_stay(spark):
    mixed = " ".join([(TEXTS[0][0] + " ") * 4, (TEXTS[1][0] + " ") * 3, (TEXTS[2][0] + " ") * 3])
    rows = [(i, *TEXTS[i % 3]) for i in range(90)] + [(900, mixed, None), (901, "12 ?!", None), (902, None, None), (903, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    own = L.label_spans(docs.where("doc_id = 900"), L.fit(docs)).first()["language"]
    assert own["score"] < 0.5 and len({s["lang"] for s in own["spans"]}) == 3
    assert sorted(r["doc_id"] for r in L.keep_known(docs).collect()) == [*range(90), 900]


def test_nothing_to_learn_from_keeps_all_texts_with_letters(spark):
    docs = documents(spark, [TEXTS[0][0], "река", "12 ?!", None, "", "_", "a"])
    kept = L.keep_known(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 6]


def test_numbers_that_look_like_letters(spark):
    rows = [(i, *TEXTS[i % 2]) for i in range(60)]
    docs = spark.createDataFrame([*rows, (900, "½ ²", None), (901, "① x½y", None)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.language_report(docs).where("doc_id >= 900").collect()}
    assert got[900] == ("und", 0.0) and got[901][0] in ("en", "de")
    assert L.words_of("x½y ² á①b") == ["x", "y", "á", "b"]


def test_unknown_languages_score_nothing_and_go(spark):
    rows = [(i, *TEXTS[i % 2]) for i in range(60)]
    docs = spark.createDataFrame([*rows, (900, TEXTS[2][0], None), (901, TEXTS[2][0] + " the old house", None), (902, "qq", None)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["score"] for r in L.language_report(docs).collect()}
    assert got[900] == 0 and 0 < got[901] < 0.6 and got[0] > 0.9
    assert sorted(r["doc_id"] for r in L.keep_known(docs).collect()) == [*range(60), 901]
