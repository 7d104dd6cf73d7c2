import sentencepiece

from hypothesis import given, settings
from hypothesis import strategies as st

from stripweave.llm import pieces as P
from stripweave.llm.common import read
from tests.llm.nasty import awkward, empty

TABLE = P.PieceTable()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
SCORE = {TABLE.pieces[i]: TABLE.score[i] for *_, ids in TABLE.by_length.values() for i in ids}


def best(word):
    top = [0.0] + [-1e300] * len(word)
    for j in range(1, len(word) + 1):
        for k in range(max(0, j - TABLE.longest), j):
            s = SCORE.get(word[k:j], TABLE.no_piece if j - k == 1 else None)
            if s is not None:
                top[j] = max(top[j], top[k] + s)
    return top[-1]


TEXT = st.text(st.sampled_from("abcdeilnorst ét\n\t.,!😀漢'\u0000"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_round_trip_and_library_ids(text):
    for rule in ("score", "merge"):
        ids = P.Encoder(TABLE, rule).encode([text, None])[0].tolist()
        assert TABLE.decode(ids) == text
    assert ids == LIBRARY.encode(text)  # the merges of a BPE model are that model's own encoding


def test_viterbi_is_brute_force(monkeypatch):
    docs = open(P.__file__).read()
    words = sorted(set(P.Encoder._units(docs)))[:1500] + ["a" * 70, "é漢😀x" * 9]
    for ends in (4096, 7):
        monkeypatch.setattr(P, "_ENDS", ends)
        for w in words:
            flat, n = TABLE.viterbi([w])
            assert abs(sum(TABLE.score[i] if i >= 0 else TABLE.no_piece for i in flat) - best(w)) < 1e-6 and n[0] == len(flat)


def test_units_join_to_the_text():
    for t in ("a  b", " a\n b \n", "\n\n", "x y\nz w", "a\n\n b", "▁a ▁"):
        assert "".join(P.Encoder._units(t)) == "▁" + t.replace(" ", "▁")


def test_report(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    rows = P.encode_report(docs)
    assert rows.count() == docs.count() and rows.where("not round_trip or n_ids <> size(ids)").count() == 0


def test_awkward_rows(spark):
    docs = awkward(spark, [(50, "x" * 30_000)])
    got = P.decode(P.encode(docs, into="__i"), ids="__i", into="__t").collect()
    assert all(r["__t"] == r["text"] for r in got) and [r["__i"] for r in got if r["text"] == ""] == [[]] and [r["__i"] for r in got if r["text"] is None] == [None, None]
    assert P.encode_report(empty(spark)).count() == 0
