"""Sum-of-squares packing (13): documents as token ids into windows of a fixed length, online and almost without padding.

* **Tokens**: a document is its tokenizer's ids and then ``END``. White space ends every pre-token of this tokenizer and is
  dropped, so texts are cut at ASCII blanks and each distinct word goes through the tokenizer once; a worker keeps the ids of
  short words in bounded tables. A null text is an empty one.
* **Levels**: of a document the whole windows are cut off first. The rest, of ``s`` tokens, goes into an open window whose fill
  level ``h`` makes the sum over all levels of (open windows at the level) squared least; a new window is level 0, and a window
  that becomes full counts no more. Only the number of open windows a level is needed for this: one array of ``WINDOW`` counts.
  Ties go to the fullest window, the one opened last of those.
* **Closing**: when a task ends, or more than ``OPEN`` windows are open, the open windows' pieces are poured together, fullest
  windows first, cut where a window becomes full. What is left at the end is cut into windows of a power of two, which need no padding.

A task packs the rows it reads, so nothing is shuffled, collected or broadcast but the tokenizer's file (a vocabulary), memory is
bounded by ``OPEN`` windows and one document's ids, and a lost task gives the same windows again. Window numbers are unique over all tasks and
not consecutive. Rows with equal or null ids are separate documents; an empty table gives no pieces; other columns are left out.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, slot

WINDOW, END, OPEN = 4096, 2, 1024
_KEPT, _SHORT, _MARK = 500_000, 40, "|"
_PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Letters of ASCII and Latin-1, then ASCII punctuation: at most two pre-tokens, composed as they stand and lower-cased letter by letter.
_PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)").fullmatch
#: The normalizer and pre-tokenizer for which that holds, and the suffix of the last token of a pre-token.
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_SUFFIX = "</w>"


class WordIds:
    """Ids of UTF-8 texts as little-endian 32-bit numbers, each word between ASCII blanks encoded once while it is kept.

    Words are kept in two generations of at most ``_KEPT``: a full younger one becomes the older, whose words that come again move on.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.plain, self.ends = self._for_plain(tokenizer)
        self.mark = np.array(self._ids([_MARK])[0], "<u4").tobytes()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _for_plain(self, tokenizer: str):
        """A tokenizer of plain words that are lower-cased and split already, and which ids end a pre-token; none where the file has other rules."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        rules = json.loads(tokenizer)
        model, vocabulary = rules["model"], self.tokenizer.get_vocab()
        if (rules.get("normalizer"), rules.get("pre_tokenizer")) != (_NORMAL, {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}) or rules.get("post_processor"):
            return None, None
        # no plain word has a letter after a mark, so none holds such a token
        if not all(re.search(r"[!-/:-@\[-`{-~][A-Za-z]", token["content"]) for token in rules.get("added_tokens") or []):
            return None, None
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != _SUFFIX or not all(c in vocabulary and c + _SUFFIX in vocabulary for c in ByteLevel.alphabet()):
            return None, None
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[n for token, n in vocabulary.items() if token.endswith(_SUFFIX)]] = True
        rules |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, _BYTES]}}
        return Tokenizer.from_str(json.dumps(rules)), ends

    def _learn_plain(self, words: list[bytes], into: dict[bytes, bytes]) -> list[bytes]:
        """Encode plain words without marks and without normalization; the other words come back."""
        met = list(map(_PLAIN, words))
        rest = [w for w, m in zip(words, met) if m is None]
        met = [m for m in met if m is not None]
        for lo in range(0, len(met), 1000):
            some = met[lo : lo + 1000]
            parts = [part for m in some for part in m.groups() if part]
            flat = np.array(self.plain.encode_batch_fast([b" ".join(parts).decode().lower()], add_special_tokens=False)[0].ids, "<u4")
            end = np.flatnonzero(self.ends[flat]) + 1
            if len(end) != len(parts):
                rest += [m[0] for m in some]
                continue
            cut = [0, *end[np.cumsum([1 if m.end(1) == m.end() else 2 for m in some]) - 1].tolist()]
            raw = flat.tobytes()
            into.update((m[0], raw[4 * a : 4 * b]) for m, a, b in zip(some, cut[:-1], cut[1:], strict=True))
        return rest

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes], into: dict[bytes, bytes]) -> None:
        """Encode many words in one text, a mark between any two; those that hold the mark one by one. Plain words need none."""
        if self.plain is not None:
            words = self._learn_plain(words, into)
        plain = [w for w in words if b"|" not in w]
        for lo in range(0, len(plain), 500):
            some = plain[lo : lo + 500]
            flat = np.array(self._ids([f" {_MARK} ".join(w.decode() for w in some)])[0], "<u4")
            cut = [-1, *np.flatnonzero(flat == np.frombuffer(self.mark, "<u4")[0]).tolist(), len(flat)]
            raw = flat.tobytes()
            into.update((w, raw[4 * (a + 1) : 4 * b]) for w, a, b in zip(some, cut[:-1], cut[1:], strict=True))
        odd = [w for w in words if b"|" in w]
        into.update((w, np.array(ids, "<u4").tobytes()) for w, ids in zip(odd, self._ids([w.decode() for w in odd])))

    def texts(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text; words are looked up and learned together."""
        cut = [t.split() if t else [] for t in texts]  # bytes: splits at ASCII blanks alone
        young, old = self.young, self.old
        new = set().union(*cut).difference(young)
        again = new.intersection(old)
        young.update((w, old[w]) for w in again)
        new -= again
        self._learn([w for w in new if len(w) <= _SHORT], young)
        rare: dict[bytes, bytes] = {}
        self._learn([w for w in new if len(w) > _SHORT], rare)
        out = [b"".join(map(young.__getitem__, words)) if rare.keys().isdisjoint(words) else b"".join([rare[w] if w in rare else young[w] for w in words]) for words in cut]
        if len(young) > _KEPT:
            self.young, self.old = {}, young
        return out


class Packer:
    """Windows being filled; ``out`` gets the pieces (row, start, ids, tokens, window, offset) of those that are done."""

    def __init__(self, window: int = WINDOW, limit: int = OPEN):
        self.window, self.limit, self.made, self.open, self.out = window, limit, 0, 0, []
        self.count = np.zeros(window + 1, np.int64)
        self.at: list[list[list]] = [[] for _ in range(window)]  # the open windows of each level, each a list of pieces

    def level(self, s: int) -> int:
        """The level to put ``s`` tokens on: the least growth of the sum of squares, the fullest level among equals."""
        n, full = self.count, self.window - s
        growth = 2 * (n[s : self.window] - n[:full]) + 2  # levels 0 .. full - 1: one window leaves h, one comes to h + s
        growth[n[:full] == 0] = np.iinfo(np.int64).max
        if full:
            growth[0] = 2 * n[s] + 1
        best = full - 1 - int(np.argmin(growth[::-1])) if full else 0
        if full and n[full] and 1 - 2 * n[full] <= growth[best]:
            return full
        return best

    def add(self, row, ids: bytes) -> None:
        tokens = len(ids) // 4
        whole = tokens - tokens % self.window
        for start in range(0, whole, self.window):
            self._done([(row, start, ids[4 * start : 4 * (start + self.window)], tokens)])
        if whole < tokens:
            self._place((row, whole, ids[4 * whole :], tokens))

    def _place(self, piece) -> None:
        s = len(piece[2]) // 4
        h = self.level(s)
        if h:
            held = self.at[h].pop()
            self.count[h] -= 1
            self.open -= 1
        else:
            held = []
        held.append(piece)
        if h + s == self.window:
            self._done(held)
            return
        self.at[h + s].append(held)
        self.count[h + s] += 1
        self.open += 1
        if self.open > self.limit:
            rest = self._pour()
            if rest:
                fill = sum(len(p[2]) for p in rest) // 4
                self.at[fill].append(rest)
                self.count[fill] += 1
                self.open += 1

    def _pour(self) -> list:
        """Close all open windows into full ones; what fills no window comes back."""
        held, fill = [], 0
        for h in range(self.window - 1, 0, -1):
            for pieces in self.at[h]:
                for row, start, ids, tokens in pieces:
                    while ids:
                        own = ids[: 4 * (self.window - fill)]
                        held.append((row, start, own, tokens))
                        start, ids, fill = start + len(own) // 4, ids[len(own) :], fill + len(own) // 4
                        if fill == self.window:
                            self._done(held)
                            held, fill = [], 0
            self.at[h] = []
        self.count[:] = 0
        self.open = 0
        return held

    def _done(self, pieces) -> None:
        offset = 0
        for row, start, ids, tokens in pieces:
            self.out.append((row, start, ids, tokens, self.made, offset))
            offset += len(ids) // 4
        self.made += 1

    def end(self) -> None:
        """Close everything: the last window is cut at powers of two."""
        held, size = self._pour(), self.window
        left = sum(len(p[2]) for p in held) // 4
        while held:
            while size > left:
                size //= 2
            own, fill, rest = [], 0, []
            for row, start, ids, tokens in held:
                cut = ids[: 4 * (size - fill)]
                if cut:
                    own.append((row, start, cut, tokens))
                    fill += len(cut) // 4
                if len(cut) < len(ids):
                    rest.append((row, start + len(cut) // 4, ids[len(cut) :], tokens))
            self._done(own)
            held, left = rest, left - size


def _some(ids: list, texts: list[bytes | None]):
    """Consecutive documents of a few megabytes together; a longer one alone."""
    lo = size = 0
    for hi, text in enumerate(texts):
        size += len(text or b"")
        if size > 4_000_000:
            yield ids[lo : hi + 1], texts[lo : hi + 1]
            lo, size = hi + 1, 0
    yield ids[lo:], texts[lo:]


def pack(docs: DataFrame, *, tokenizer: str | None = None, window: int = WINDOW, limit: int = OPEN, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start (tokens of its document before it), length, ids (little-endian 32-bit numbers), doc_tokens, sequence_id, offset.

    ``window`` is a power of two. ``tokenizer`` is the path of a tokenizer's file whose pre-tokens end at white space.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("the window must be a power of two")
    spark = docs.sparkSession
    with open(tokenizer or tokenizer_file(), encoding="utf-8") as f:
        file = spark.sparkContext.broadcast(f.read())
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        words = slot(file, lambda: WordIds(file.value))
        packer, first = Packer(window, limit), TaskContext.get().partitionId() << 40

        def rows():
            row, start, ids, tokens, made, offset = zip(*packer.out)
            packer.out = []
            for lo in range(0, len(row), 2048):
                k = slice(lo, lo + 2048)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[k], pa.int64()), pa.array(start[k], pa.int64()), pa.array([len(x) // 4 for x in ids[k]], pa.int64()), pa.array(ids[k], pa.binary()),
                     pa.array(tokens[k], pa.int64()), pa.array([first + n for n in made[k]], pa.int64()), pa.array(offset[k], pa.int64())],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for ids, texts in _some(batch.column(0).to_pylist(), binary(batch.column(1))):
                for doc_id, own in zip(ids, words.texts(texts)):
                    packer.add(doc_id, own + last)
                if len(packer.out) >= 2048:
                    yield from rows()
        packer.end()
        if packer.out:
            yield from rows()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECES)


def sequences(pieces: DataFrame, *, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """Pieces to training windows: sequence_id, tokens, ids array<bigint> and segments array<int> (piece numbers from 1 in the window), both padded.

    A window is padded with ``pad`` (segment 0) to ``window`` unless its length is a power of two. At most ``window`` pieces meet in a group.
    """

    def build(batches):
        for batch in batches:
            own = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            ids, segments, tokens = [], [], []
            for found in own["pieces"]:
                flat = [np.frombuffer(p["ids"], "<u4") for p in found]
                n = sum(map(len, flat))
                width = n if n & (n - 1) == 0 else window
                ids.append(np.concatenate([*flat, np.full(width - n, pad, np.uint32)]).astype(np.int64))
                segments.append(np.concatenate([np.repeat(np.arange(1, len(flat) + 1), [len(x) for x in flat]), np.zeros(width - n, np.int64)]).astype(np.int32))
                tokens.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own["sequence_id"], pa.int64()), pa.array(tokens, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(segments, pa.list_(pa.int32()))],
                ["sequence_id", "tokens", "ids", "segments"])

    grouped = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    return grouped.mapInArrow(build, "sequence_id bigint, tokens bigint, ids array<bigint>, segments array<int>")


def packing_report(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
