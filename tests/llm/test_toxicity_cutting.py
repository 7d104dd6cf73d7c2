import pytest

from stripweave.llm import toxicity as T
from tests.llm.nasty import documents
from tests.llm.test_toxicity import small  # noqa: F401

SPELLINGS = ["blockhead\u2014numskull", "numskull\u2026really", "you\u00a0numskull", "you_numskull", "the_numskull_again", "so\u2013blockhead\u2013so", "\u00bfnumskull?", "a\u202fblockhead"]


def test_every_spelling_is_a_hit(spark, small):  # noqa: F811
    model = T.fit(*small)
    texts = SPELLINGS + ["\u00ab\u00a0numskull\u00a0\u00bb", "you numskull", "numskull really"]
    got = {texts[r["doc_id"]]: r["toxicity"] for r in T.score_texts(documents(spark, texts).drop("toxicity"), model).collect()}
    assert [t for t in texts if not got[t]["hits"]] == []
    assert got["blockhead\u2014numskull"]["hits"] == 2 and got["\u00ab\u00a0numskull\u00a0\u00bb"]["quoted"] == 1
    assert got["you\u00a0numskull"] == got["you_numskull"] == got["you numskull"]
    assert got["numskull\u2026really"] == got["numskull really"]


@pytest.mark.parametrize("sep", ["\u2014", "\u00a0", "\u2026", "_"])
def test_lexicon_is_learned_through_any_separator(spark, small, sep):  # noqa: F811
    docs, labels = small
    joined = docs.withColumn("text", T.F.regexp_replace("text", "worthless blockhead and", f"worthless{sep}blockhead{sep}and"))
    assert {"blockhead", "numskull"} <= set(T.fit(joined, labels).terms)
