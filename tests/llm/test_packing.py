"""Sum-of-squares packing against plain recomputation, and its windows against the tokenizer itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from stripweave.llm.common import read
from stripweave.llm.packing import Packer, WordIds, pack, packing_report, sequences, tokenizer_file
from tests.llm.nasty import LONG, awkward, documents, empty


def brute_level(levels, s, window):
    """Try every open level and a new window, square all counts anew; the fullest of equals."""
    best = None
    for h in {0, *(x for x, n in levels.items() if n and x + s <= window)}:
        after = dict(levels)
        if h:
            after[h] -= 1
        if h + s < window:
            after[h + s] = after.get(h + s, 0) + 1
        now = (sum(n * n for n in after.values()), -h)
        best = min(best, now) if best else now
    return -best[1]


@pytest.mark.parametrize("window", [8, 32])
def test_levels_minimise_the_sum_of_squares(window):
    rng = random.Random(window)
    for _ in range(30):
        packer, levels = Packer(window, limit=10_000), {}
        for i in range(60):
            s = rng.randint(1, window - 1)
            want = brute_level(levels, s, window)
            assert packer.level(s) == want
            packer.add(i, np.zeros(s, "<u4").tobytes())
            if want:
                levels[want] -= 1
            if want + s < window:
                levels[want + s] = levels.get(want + s, 0) + 1
            assert {h: n for h, n in levels.items() if n} == {h: int(n) for h, n in enumerate(packer.count) if n}


@pytest.mark.parametrize("limit", [1, 5, 10_000])
def test_every_id_once_and_no_padding(limit):
    rng = random.Random(limit)
    packer, docs = Packer(16, limit), {}
    for i in range(200):
        docs[i] = np.arange(rng.choice([1, 3, 9, 9, 16, 40])).astype("<u4").tobytes()
        packer.add(i, docs[i])
        assert packer.open <= limit
    packer.end()
    whole, fill = defaultdict(bytes), defaultdict(int)
    for row, start, ids, tokens, made, offset in sorted(packer.out, key=lambda p: p[:2]):
        assert start == len(whole[row]) // 4 and tokens == len(docs[row]) // 4
        whole[row] += ids
    for row, start, ids, tokens, made, offset in sorted(packer.out, key=lambda p: p[4:]):
        assert offset == fill[made]
        fill[made] += len(ids) // 4
    assert whole == docs
    assert sum(n < 16 for n in fill.values()) <= 4 and all(n & (n - 1) == 0 for n in fill.values())


def held(df, texts):
    """Check pieces against the tokenizer; the windows' lengths."""
    t = Tokenizer.from_file(tokenizer_file())
    want = defaultdict(list)
    for i, text in texts:
        want[i].append(np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    rows = [r.asDict() for r in df.collect()]
    found, fill = defaultdict(list), defaultdict(int)
    for r in sorted(rows, key=lambda r: r["start"]):
        found[r["doc_id"]].append(r)
    for i, whole in want.items():
        assert sum(r["length"] for r in found[i]) == sum(len(w) // 4 for w in whole)
        for r in found[i]:
            assert any(zlib.crc32(w[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] and r["doc_tokens"] == len(w) // 4 for w in whole)
    assert set(found) == set(want)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert all(n <= 4096 and n & (n - 1) == 0 for n in fill.values())
    return fill


def test_awkward_and_empty(spark):
    odd = [(50, "a b c"), (51, "<|endoftext|> x<|startoftext|>y"), (52, "É e ́x"), (53, "ΣΑΣ ΣΑΣ. İ ß"), (54, "x" * 9000), (55, "it's 'll 'REab"), (56, "\x1c\x1d\x85a\x0bb"), (57, "a ́b")]
    docs = awkward(spark, odd)
    held(packing_report(docs), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert packing_report(empty(spark)).count() == 0


def test_whole_table(spark, data):
    docs = read(spark, data, "documents")
    fill = held(packing_report(docs), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(n < 4096 for n in fill.values()) <= 12 * docs.rdd.getNumPartitions()


def test_sequences_hold_the_ids(spark):
    docs = documents(spark, ["one two three", "", LONG, None, "one two three"])
    pieces = pack(docs)
    rows = {r["sequence_id"]: r for r in sequences(pieces, pad=7).collect()}
    for p in pieces.collect():
        own = rows[p["sequence_id"]]
        assert own["ids"][p["offset"] : p["offset"] + p["length"]] == np.frombuffer(p["ids"], "<u4").tolist()
        assert len(set(own["segments"][p["offset"] : p["offset"] + p["length"]])) == 1
    assert all(len(r["ids"]) == len(r["segments"]) and len(r["ids"]) & (len(r["ids"]) - 1) == 0 for r in rows.values())


def test_words_are_kept_within_bounds(monkeypatch):
    monkeypatch.setattr("stripweave.llm.packing._KEPT", 50)
    t = Tokenizer.from_file(tokenizer_file())
    w = WordIds(open(tokenizer_file(), encoding="utf-8").read())
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["Ab", "|", "<|endoftext|>", " ", " ", "\t", "\n", "\x0b", "é", "́", "\u2003", "7", "'s", "…", "z" * 60, "ß", "𝒳", "\x00", "Σ", str(rng.randrange(1000))]) for _ in range(rng.choice([1, 5, 60])))
        assert np.frombuffer(w.texts([text.encode()])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text
        assert all(len(k) <= 40 for k in w.young) and len(w.young) <= 200 and len(w.old) <= 250


def test_plain_words_need_no_normalizer():
    """Words of letters and punctuation give the tokenizer's own ids; under other rules every word goes the long way."""
    import json
    import random

    from tokenizers import Tokenizer

    file = open(tokenizer_file(), encoding="utf-8").read()
    tokenizer, rng = Tokenizer.from_str(file), random.Random(5)
    some = [chr(c) for c in range(1, 0x180)] + list("abcdeXYZ.,'|<>!") * 12 + ["'s", "'T", "\u0130", "\u03a3", "e\u0301", "<|endoftext|>"]
    words = ["".join(rng.choices(some, k=rng.randint(1, 9))) for _ in range(20_000)] + ["Stra\u00dfe.", "\u00c9T\u00c9,", "end|>", "don't", "x'", "A|", "<|endoftext|>", "a<|endoftext|>."]
    texts = [" ".join(words[i : i + 40]) for i in range(0, len(words), 40)]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    w = WordIds(file)
    short: list[str] = []
    w._ids, long = lambda t, own=w._ids: short.extend(t) or own(t), w._learn_plain
    assert w.texts([t.encode() for t in texts]) == want
    assert long([b"Word.,", b"\xc3\x89t", b"don't", b"1a"], {}) == [b"don't", b"1a"] and not any(" Straße. " in t for t in short)
    rules = json.loads(file)
    rules["normalizer"]["normalizers"].pop()
    other = json.dumps(rules)
    assert WordIds(other).texts([b"Word And"]) == [np.array(Tokenizer.from_str(other).encode("Word And", add_special_tokens=False).ids, "<u4").tobytes()]
