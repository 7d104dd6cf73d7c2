import random
import re

from stripweave.llm import licenses as L
from tests.llm.nasty import awkward, documents, empty

TEMPLATES = [("one", "a b c d e"), ("two", "c d e f g h i j"), ("three", "k"), ("four", "a b k l m n")]


def test_join_finds_every_pair(spark):
    random.seed(5)
    lines = ["".join(random.choice("abcdefghijklmnop") + " " for _ in range(random.randint(0, 14))) for _ in range(400)]
    docs = documents(spark, ["\n".join(lines[i : i + 8]) for i in range(0, 400, 8)])
    for percent in (50, 75, 100):
        found = {(r["doc_id"], b["block"], b["label"], round(b["containment"], 9)) for r in L.scan_blocks(docs, templates=TEMPLATES, percent=percent, into="__l").select("doc_id", "__l.blocks").collect() for b in r["blocks"]}
        want = set()
        for r in docs.collect():
            for n, line in enumerate(r["text"].split("\n")):
                for label, t in TEMPLATES:
                    t = set(t.split())
                    if 100 * len(t & set(line.split())) >= percent * len(t):
                        want.add((r["doc_id"], n, label, round(len(t & set(line.split())) / len(t), 9)))
        assert found == want


def test_report_on_awkward_rows(spark):
    docs = awkward(spark, [(30, "x CC-BY cc by\nAll rights\nreserved. General public license"), (31, "Released under the MIT License"), (32, "Released under the Apache License")])
    rows = {r["doc_id"]: r for r in L.license_report(docs).collect() if r["doc_id"] is not None}
    assert (rows[30]["n_base"], rows[30]["first_word"], rows[30]["last_word"], rows[30]["base_labels"], rows[30]["score"]) == (4, 1, 8, "cc-by,gpl,reserved", 1.0)
    assert rows[31]["labels"] == "mit" and rows[31]["n_base"] == 0 and rows[31]["first_word"] is None
    assert rows[32]["labels"] == "" and rows[32]["score"] == 0
    assert rows[0]["n_words"] == 0 and rows[4]["n_words"] == 60_000
    assert L.license_report(empty(spark)).count() == 0


def test_frequency_order_covers_all_blocks(spark):
    docs = documents(spark, ["the mit\nthe the mit", "the", None])
    n = L.block_frequency(docs)
    assert n[b"the"] == 3 and n[b"mit"] == 2 and not re.search("x", "".join(w.decode() for w in n if n[w] == 0))
