import corpus_pipeline as P
from pyspark.sql import functions as F

from stripweave.llm import decontam, neardup
from stripweave.llm.common import read, saved
from tests.llm.nasty import awkward, empty
from tests.llm.test_decontam import brute as contaminated_brute
from tests.llm.test_neardup import brute as groups_brute


def test_stages_against_brute_force(spark, data):
    docs = read(spark, data, "documents")
    rows = {0: docs}
    for k, (_, stage) in enumerate(P.STAGES, 1):
        rows[k] = saved(stage(spark, rows[k - 1], data))
    assert all(rows[k].columns == docs.columns for k in range(1, 5))
    toxic = {r["doc_id"] for r in rows[0].join(read(spark, data, "labels").where("toxic = 1"), "doc_id").collect()}
    gone = {r["doc_id"] for r in rows[0].join(rows[1], "doc_id", "left_anti").collect()}
    labelled = {r["doc_id"] for r in read(spark, data, "labels").collect()}
    assert not (gone & labelled) - toxic  # no document that is known to be clean goes
    assert {r["doc_id"] for r in rows[1].collect()} - {r["doc_id"] for r in rows[2].collect()} <= {r["doc_id"] for r in rows[1].where("text is null or not rlike(text, '[a-zA-Z]{40}')").collect()}
    kept = [i for i, _, _, own in groups_brute([(r["doc_id"], r["text"]) for r in rows[2].collect()], 80) if own]
    assert sorted(kept) == sorted(r["doc_id"] for r in rows[3].collect())
    items = [(r["item_id"], r["text"]) for r in read(spark, data, "benchmark").collect()]
    clean = [d for d, n, hit, _, _ in contaminated_brute([(r["doc_id"], r["text"]) for r in rows[3].collect()], items, decontam.SIZE) if not (hit and 20 * hit >= n)]
    assert sorted(clean) == sorted(r["doc_id"] for r in rows[4].collect())
    assert rows[5].where(F.col("round_trip")).count() == len(clean) == P.run(spark, data).count()
    assert neardup.near_duplicates(rows[4], percent=80, bands=48, rows=4).where("not kept").count() == 0


def test_awkward_and_empty_tables(spark, data):
    for docs in (awkward(spark), empty(spark)):
        out = docs
        for k, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, out, data)
            assert k == 4 or out.columns == docs.columns
        assert out.count() <= docs.count()
