"""SentencePiece encoding and decoding (10): Viterbi over pieces, batched in numpy.

A text is cut before each run of spaces and around line ends (no piece goes on past those), so words are independent.
The distinct words of a batch are grouped by length and advance together: hashes of all their substrings of
each length are looked up among the sorted keys of the pieces of that length and confirmed letter by letter; for
each end the best sum over the possible last pieces is a vectorised maximum, whose place is the backpointer.
Ties go to the longer last piece. A character that is no piece becomes its UTF-8 bytes' pieces (the unknown id
where the model has none). Words of any length run in blocks of ends, so memory follows the block.

``rule="score"`` maximises the sum of piece scores (what a unigram model means by encoding). ``rule="merge"``
applies the merges of a BPE model one after the other with the same tables, and so gives that model's own ids.
Decoding inverts both: decode(encode(x)) = x for every text without U+2581, which stands for a space.

Null texts give null ids, empty ones no ids. The model file is a parameter and read on the driver alone; its
pieces (a vocabulary, of bounded size) are broadcast.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import U64, bounds, mix, slot

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_UNIT = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
_GOLD = U64(0x9E3779B97F4A7C15)
_ENDS = 4096
_CELLS = 1_000_000
#: Words whose ids a worker keeps between batches.
_KEPT = 150_000


def _codes(words: list[str]) -> np.ndarray:
    """Words of equal length as a matrix of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(U64)


class PieceTable:
    """Sorted hashed keys, ids and scores of the pieces, by length in characters."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model)
        n = p.vocab_size()
        self.pieces = [p.id_to_piece(i) for i in range(n)]
        self.unknown = p.unk_id()
        self.byte = np.full(256, self.unknown, np.int32)
        self.raw = []
        own: dict[int, list[tuple[str, int]]] = {}
        for i, piece in enumerate(self.pieces):
            if p.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif p.is_control(i) or p.is_unknown(i):
                self.raw.append(b"" if p.is_control(i) else " ⁇ ".encode())
            else:
                self.raw.append(piece.replace(SPACE, " ").encode())
                own.setdefault(len(piece), []).append((piece, i))
        self.score = np.array([p.get_score(i) for i in range(n)])
        self.no_piece = self.score.min() - 10.0
        if any("\n" in w for f in own.values() for w, _ in f if len(w) > 1):
            raise ValueError("a piece goes on past a line end")
        self.longest, self.salt, self.by_length = max(own, default=1), 1, {}
        while any(len(np.unique(self._keys(_codes([w for w, _ in f]))[-1])) < len(f) for f in own.values()):
            self.salt += 1
        for length, found in own.items():
            codes = _codes([w for w, _ in found])
            key = self._keys(codes)[-1][:, 0]
            order = np.argsort(key)
            seen = np.zeros(1 << 18, bool)
            seen[(key >> U64(46)).astype(np.int64)] = True
            self.by_length[length] = (key[order], seen, codes[order], np.array([i for _, i in found], np.int32)[order])

    def _keys(self, codes: np.ndarray) -> list[np.ndarray]:
        """Hashes of all substrings by length (words x starts); each length goes on from the one before."""
        h, out = np.full(codes.shape, U64(self.salt)), []
        for k in range(min(self.longest, codes.shape[1])):
            h = mix(h[:, : codes.shape[1] - k] * _GOLD + codes[:, k:])
            out.append(h)
        return out

    def ids(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length, the piece id of every substring (words x starts); -1 where it is no piece."""
        out = []
        for length, h in enumerate(self._keys(codes), 1):
            found = np.full(h.shape, -1, np.int32)
            if length in self.by_length:
                key, seen, rows, ids = self.by_length[length]
                w, at = np.nonzero(seen[(h >> U64(46)).astype(np.int64)])  # most substrings end here
                k = np.minimum(np.searchsorted(key, h[w, at]), len(key) - 1)
                same = key[k] == h[w, at]
                w, at, k = w[same], at[same], k[same]
                same = (codes[w[:, None], at[:, None] + np.arange(length)] == rows[k]).all(axis=1)
                found[w[same], at[same]] = ids[k[same]]
            out.append(found)
        return out

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best segmentation of words of one length: flat ids (-1 - code point for no piece) and counts."""
        codes = _codes(words)
        n, length = codes.shape
        most = min(self.longest, length)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, length + 1), np.uint8), np.zeros((n, length + 1), np.int64)
        for e0 in range(1, length + 1, _ENDS):
            e1, s0 = min(e0 + _ENDS, length + 1), max(0, e0 - most)
            part = codes[:, s0 : e1 - 1]
            tables = self.ids(part)
            scores = [np.where(t >= 0, self.score[t], -np.inf) for t in tables]
            lone = tables[0] < 0
            scores[0][lone] = self.no_piece
            tables[0] = np.where(lone, -1 - part.astype(np.int64), tables[0])
            for e in range(e0, e1):
                ks = range(min(most, e), 0, -1)
                cand = np.stack([best[:, e - k] + scores[k - 1][:, e - k - s0] for k in ks])
                pick = cand.argmax(axis=0)
                best[:, e] = cand[pick, np.arange(n)]
                back[:, e] = ks[0] - pick
                ids = np.stack([tables[k - 1][:, e - k - s0] for k in ks])
                piece[:, e] = ids[pick, np.arange(n)]
        at, used = np.full(n, length), np.zeros((n, length + 1), bool)
        live = np.arange(n)
        while len(live):
            used[live, at[live]] = True
            at[live] -= back[live, at[live]]
            live = live[at[live] > 0]
        return piece[used], used.sum(axis=1)

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same shape of answer by a BPE model's merges: again and again the best-scored adjacent pair, leftmost first."""
        codes = _codes(words)
        n, length = codes.shape
        flat, counts = [], []
        tables = dict(enumerate(self.ids(codes), 1))
        single = tables[1]
        for w in range(n):
            edge = list(range(length + 1))

            def pair(i, edge=edge, w=w):
                k = edge[i + 2] - edge[i]
                t = tables[k][w, edge[i]] if k in tables else -1
                return self.score[t] if t >= 0 else -np.inf

            value = [pair(i) for i in range(length - 1)]
            while value and (top := max(value)) > -np.inf:
                i = value.index(top)
                del edge[i + 1], value[i]
                for j in (i - 1, i):
                    if 0 <= j < len(edge) - 2:
                        value[j] = pair(j)
            own = [int(single[w, a]) if b - a == 1 else int(tables[b - a][w, a]) for a, b in zip(edge, edge[1:])]
            flat += [-1 - int(codes[w, a]) if t < 0 else t for t, a in zip(own, edge)]
            counts.append(len(own))
        return np.array(flat, np.int64), np.array(counts, np.int64)

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.raw[i] for i in ids])
        return (text[1:] if text.startswith(b" ") else text).decode("utf-8", "replace")


class Encoder:
    """Encodes batches of texts; keeps the ids of the words seen, up to a bound."""

    def __init__(self, table: PieceTable, rule: str = "score"):
        if rule not in ("score", "merge"):
            raise ValueError(f"rule is 'score' or 'merge', not {rule!r}")
        self.table, self.rule = table, rule
        self._reset()

    def _reset(self):
        self.place: dict[str, int] = {}
        self.flat, self.counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]

    def _learn(self, new: list[str]):
        by: dict[int, list[str]] = {}
        for w in new:
            by.setdefault(len(w), []).append(w)
        for length, words in sorted(by.items()):
            step = max(1, _CELLS // (min(length, _ENDS) * min(length, self.table.longest)))
            for lo in range(0, len(words), step):
                some = words[lo : lo + step]
                flat, counts = (self.table.viterbi if self.rule == "score" else self.table.merged)(some)
                if (flat < 0).any():
                    flat, counts = self._bytes(flat, counts)
                base = len(self.place)
                self.place.update(zip(some, range(base, base + len(some))))
                self.flat.append(flat.astype(np.int32))
                self.counts.append(counts)

    def _bytes(self, flat, counts):
        """Characters that are no piece as the pieces of their UTF-8 bytes."""
        at = np.flatnonzero(flat < 0)
        each = [[int(self.table.byte[b]) for b in chr(-1 - int(t)).encode("utf-8", "surrogatepass")] for t in flat[at]]
        n = np.ones(len(flat), np.int64)
        n[at] = [len(x) for x in each]
        out, total = np.repeat(flat, n), bounds(n)
        for i, x in zip(at, each):
            out[total[i] : total[i + 1]] = x
        edge = bounds(counts)
        return out, total[edge[1:]] - total[edge[:-1]]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; a null text counts as empty here."""
        units = [self._units(t) for t in texts]
        if len(self.place) > _KEPT:
            self._reset()
        new = [w for w in dict.fromkeys(w for u in units for w in u) if w not in self.place]
        if new:
            self._learn(new)
            self.flat, self.counts = [np.concatenate(self.flat)], [np.concatenate(self.counts)]
        flat, counts, place = self.flat[0], self.counts[0], self.place
        start = bounds(counts)
        out = []
        for u in units:
            at = np.fromiter((place[w] for w in u), np.int64, len(u))
            n = counts[at]
            shift = np.repeat(start[at] - bounds(n)[:-1], n)
            out.append(flat[shift + np.arange(len(shift))])
        return out

    @staticmethod
    def _units(text: str | None) -> list[str]:
        """The text cut where no piece can go on: before each run of spaces, around each line end."""
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " " or SPACE in text or " \n" in text:
            return _UNIT.findall(SPACE + text.replace(" ", SPACE))
        out: list[str] = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            if out:
                out.append("\n")
            if first or not out:
                out.append(first if out else SPACE + first)
            out += [SPACE + w for w in rest]
        return out


def _encoder(shared, rule: str) -> Encoder:
    by_rule = slot(shared.value, dict)
    if rule not in by_rule:
        by_rule[rule] = Encoder(shared.value, rule)
    return by_rule[rule]


def _parts(texts, chars: int = 1_000_000):
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t or "")
        if n > chars:
            yield part
            part, n = [], 0
    if part:
        yield part


def broadcast_pieces(spark: SparkSession, model: str = MODEL):
    return spark.sparkContext.broadcast(PieceTable(model))


def encode(docs: DataFrame, *, model: str = MODEL, text: str = "text", into: str = "ids", rule: str = "score", shared=None) -> DataFrame:
    """``docs`` with an array ``into`` of piece ids."""
    shared = shared or broadcast_pieces(docs.sparkSession, model)
    Encoder(shared.value, rule)

    @arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        encoder, ids = _encoder(shared, rule), []
        for part in _parts(column.to_pylist()):
            ids += encoder.encode(part)
        return _id_lists(ids, column)

    return docs.withColumn(into, run(F.col(text).cast("string")))


def _id_lists(ids: list[np.ndarray], column: pa.Array) -> pa.ListArray:
    counts = [len(i) for i in ids]
    return pa.ListArray.from_arrays(pa.array(bounds(counts), pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()), mask=column.is_null())


def decode(rows: DataFrame, *, model: str = MODEL, ids: str = "ids", into: str = "text", shared=None) -> DataFrame:
    """``rows`` with the text ``into`` that the array ``ids`` stands for; null for null."""
    shared = shared or broadcast_pieces(rows.sparkSession, model)

    @arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        table, edge, values = shared.value, column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        return pa.array([table.decode(values[a:b].tolist()) if ok else None for a, b, ok in zip(edge, edge[1:], column.is_valid().to_pylist())], pa.string())

    return rows.withColumn(into, run(F.col(ids)))


def encode_report(docs: DataFrame, *, model: str = MODEL) -> DataFrame:
    """Per document: doc_id, ids, n_ids, and whether decoding gives back the text (null for a null text)."""
    shared = broadcast_pieces(docs.sparkSession, model)

    @arrow_udf("struct<ids: array<int>, same: boolean>")
    def run(column: pa.Array) -> pa.Array:  # one call, so that each text is encoded once
        encoder, ids, same = _encoder(shared, "score"), [], []
        for part in _parts(column.to_pylist()):
            own = encoder.encode(part)
            same += [None if t is None else encoder.table.decode(i.tolist()) == t for t, i in zip(part, own)]
            ids += own
        return pa.StructArray.from_arrays([_id_lists(ids, column), pa.array(same, pa.bool_())], ["ids", "same"])

    done = docs.select("doc_id", run(F.col("text").cast("string")).alias("done"))
    return done.select("doc_id", F.col("done")["ids"].alias("ids"), F.size(F.col("done")["ids"]).cast("bigint").alias("n_ids"), F.col("done")["same"].alias("round_trip"))
