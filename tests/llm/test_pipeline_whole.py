import corpus_pipeline as P
from pyspark.sql import functions as F

from stripweave.llm import neardup
from tests.llm.nasty import documents
from tests.llm.test_neardup import shingles


def test_pair_between_the_thresholds_is_dropped(spark, data):
    words = [f"w{i}" for i in range(204)]
    other = words[:60] + [f"z{i}" for i in range(11)] + words[71:120] + ["y"] + words[121:]
    a, b = " ".join(words), " ".join(other)
    similar = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert 0.81 < similar < 0.83
    docs = documents(spark, [(7, a), (3, b), (9, "something else entirely, of a few words")])
    assert sorted(r["doc_id"] for r in P.dedup_stage(spark, docs, data).collect()) == [3, 9]
    assert neardup.near_duplicates(docs).where(F.col("kept")).count() == 3  # op9 keeps its 0.85
