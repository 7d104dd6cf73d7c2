"""Search by presence masks against plain scoring of every document."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from stripweave.llm.common import text_words
from stripweave.llm.masks import Best, masked, search, search_shard
from tests.llm.nasty import LONG, awkward, documents, empty

ITEMS = "item_id bigint, text string, doc_id string, term string, score string"


def brute(docs, items, k):
    words = [(i, Counter(text_words((t or "").encode()))) for i, t in docs]
    n = sum(bool(w) for _, w in words)
    total = sum(sum(w.values()) for _, w in words)
    df = Counter(t for _, w in words for t in w)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(text_words((t or "").encode()))
    out = []
    for item, terms in asked.items():
        scores = []
        for doc, w in words:
            m = 100 - 50 + (50 * sum(w.values()) * n) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * w[t]) // (1000 * w[t] + 20 * m)) for t in terms if w[t])
            if s > 0:
                scores.append((-s, doc is None, doc))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(map(str, out))


def items_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], ITEMS)


@pytest.mark.parametrize("shard", [3, 8192])
def test_against_brute_force(spark, shard):
    rng = random.Random(1)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 90}" for _ in range(3000)]
    texts = [(rng.choice([i, i, 7, None]), " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 10, 60])))) for i in range(120)]
    texts += [(500, None), (501, ""), (502, LONG), (503, "w1 W1 é"), (503, "w1 W1 é")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 30, 200])))) for i in range(12)] + [(3, "é lorem"), (None, "w1 ipsum"), (90, None), (91, "nowhere")]
    got = search(documents(spark, texts), items_of(spark, items), k=5, item_block=4, group=2, shard_docs=shard).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(texts, items, 5)


def test_awkward_and_empty(spark):
    docs, items = awkward(spark), [(1, "same text"), (2, "lorem 123"), (3, "ID"), (4, "")]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(str(tuple(r)) for r in search(docs, items_of(spark, items)).collect()) == brute(rows, items, 50)
    assert search(empty(spark), items_of(spark, items)).count() == 0
    assert search(docs, items_of(spark, [])).count() == 0


def test_masks_are_exact_sets():
    rng = np.random.default_rng(2)
    postings = [np.flatnonzero(rng.random(300) < 0.02 * (1 + t % 5)) for t in range(150)]
    group, masks = masked(postings, 300)
    holds = [frozenset(t for t, p in enumerate(postings) if d in set(p.tolist())) for d in range(300)]
    assert len(set(zip(group.tolist(), holds))) == len(set(holds)) == len(masks[0])
    for d in range(300):
        assert {t for t in range(150) if int(masks[t >> 6][group[d]]) >> (t & 63) & 1} == holds[d]


def test_stops_before_all_documents():
    size = 5000
    rare, common = np.arange(0, size, 500), np.arange(size)
    best = Best(5)
    seen = search_shard([(rare, np.full(len(rare), 9000)), (common, np.full(size, 10) + common % 3)], np.arange(size), size, best)
    assert seen < 100 and best.score.tolist() == [9012, 9012, 9012, 9011, 9011][: len(best.score)] or best.score.tolist() == sorted((9010 + d % 3 for d in rare), reverse=True)[:5]
    assert search_shard([(common, np.full(size, 10))], np.arange(size), size, best) == 0
