import random

import numpy as np

from stripweave.llm import neardup as N
from stripweave.llm.graph import components
from tests.llm.nasty import awkward, documents, empty


def test_super_minhash_is_the_plain_algorithm():
    def plain(s, m):
        h = [int(N._MANY)] * m
        for e in s:
            p = list(range(m))
            for j in range(m):
                x = int(N.mix(np.array([(int(e) + (j + 1) * int(N._GOLD)) % 2**64], N.U64))[0])
                k = j + ((x & 0xFFFFFFFF) * (m - j) >> 32)
                p[j], p[k] = p[k], p[j]
                h[p[j]] = min(h[p[j]], (j << 32) | (x >> 32))
        return h

    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(N.U64)) for n in (0, 1, 2, 5, 30, 200)]
    got = N.super_minhash(sets, 24)
    for s, g in zip(sets, got):
        assert g.tolist() == plain(s, 24)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000).astype(N.U64)
    s = N.super_minhash([np.sort(a[:800]), np.sort(a[100:900])], 192)
    assert abs((s[0] == s[1]).mean() - 700 / 900) < 0.12


def shingles(t):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=str)


def test_groups_are_brute_force(spark):
    random.seed(8)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [random.choice(vocab) for _ in range(random.choice([3, 7, 60, 150]))]
        for _ in range(random.choice([1, 3, 14])):
            w = list(base)
            for _ in range(random.choice([0, 0, 1, 2, 3])):
                w[random.randrange(len(w))] = random.choice(vocab)
            texts.append(" ".join(w))
    random.shuffle(texts)
    docs = documents(spark, texts)
    for block in (2048, 3):  # the second cuts every cluster in blocks that meet two at a time
        got = sorted((tuple(r) for r in N.near_duplicates(docs, block=block).collect()), key=str)
        assert got == brute(list(enumerate(texts)))


def test_awkward_rows(spark):
    extra = [(60, "Same TEXT of\tsix short\nwords"), (61, "a"), (62, "A")]
    docs = awkward(spark, extra)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] != 6]
    got = [tuple(r) for r in N.near_duplicates(docs).collect()]
    assert sorted((g for g in got if g[0] != 6), key=str) == brute(rows) and [g for g in got if g[0] == 6] == [(6, 2, 5, False)] * 2
    kept = N.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i in [-9, 0, 1, 2, 3, 4, 5, None, None])
    assert N.near_duplicates(empty(spark)).count() == 0


def test_rows_of_one_id_are_judged_each(spark):
    base = " ".join(f"w{i}" for i in range(200))
    near, other = base + " tail", " ".join(f"z{i}" for i in range(50))
    rows = [(1, base), (1, other), (1, near), (2, near), (2, "quite unlike all of the others here"), (3, other), (4, ""), (4, None), (4, ""), (5, base), (6, "one more text of its own"), (6, "one more text of its own")]
    kept = [(r["doc_id"], r["text"]) for r in N.drop_near_duplicates(documents(spark, rows)).collect()]
    assert len([t for i, t in kept if t in (base, near)]) == 1 and (1, other) in kept and (3, other) not in kept
    assert sorted(i for i, _ in kept) == [1, 1, 2, 4, 4, 6]
    assert {t for i, t in kept if i == 4} == {"", None} and (2, "quite unlike all of the others here") in kept


def test_components(spark):
    random.seed(9)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    least = {}
    for a, b in edges:
        least.setdefault(a, a), least.setdefault(b, b)
    for _ in range(400):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = components(spark.createDataFrame(edges, "u long, v long").repartition(7))
    assert sorted((r["u"], r["v"]) for r in got.collect()) == sorted((x, m) for x, m in least.items() if x != m)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_texts_of_unlinked_rows_are_not_shuffled(spark):
    def written():
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    rng = random.Random(3)
    rows = [(i, " ".join(f"{rng.getrandbits(64):x}" for _ in range(2000))) for i in range(150)]
    rows += [(1000, rows[3][1]), (1001, rows[4][1] + " tail"), (None, rows[5][1]), (7, "other words under one id, six")]
    docs = documents(spark, rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        kept = [(r["doc_id"], r["text"]) for r in N.drop_near_duplicates(docs).collect()]
        assert written() - before < sum(len(t) for _, t in rows) / 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(kept, key=str) == sorted((r for r in rows if r[0] not in (1000, 1001)), key=str)
