"""Language ID (6): scripts narrow the candidates, per-word scores and Viterbi label spans of mixed text.

Each word (a run of letters) belongs to a script by the range of its letters; only languages that training saw
in that script compete for it. A word's score for a language is the sum of the log probabilities of its letter
2- and 3-grams (word ends marked), learned from a bounded sample of training documents. Viterbi over a document's
words, with a penalty for each switch, labels every word; runs of one label are the document's spans. The
document's language is the one whose spans hold most letters.

Whole texts are labelled, long ones too: segments of all a batch's documents advance together, so memory follows
the batch's words. A text that is null or has no letter is ``und`` with score 0 and has no spans; so is every text
where training has no rows. Words of scripts unseen in training follow their neighbours. Ties go to the
language first in alphabetical order. lang, source and doc_id are never inputs.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import bounds, held, saved, slot

#: About so many training documents of each language are counted.
PER_LANG = 1_500
#: An n-gram counts from so many occurrences in the sample on; rarer ones tell little.
LEAST_SEEN = 3
SWITCH = 12.0
#: Words of a segment that the Viterbi pass takes at a time; no effect on results.
SEGMENT = 256
#: First code points of script ranges; letters below the first range, and Latin ones, are Latin.
SCRIPTS = [(0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"),
           (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
           (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other")]
_STARTS = [s for s, _ in SCRIPTS]
_WORD = re.compile(r"[^\W\d_]+")
RESULT = "struct<lang: string, score: double, spans: array<struct<first: int, last: int, lang: string>>>"


def words_of(text: str) -> list[str]:
    """Runs of letters; other characters that count as part of a word, such as fractions and raised digits, end a run."""
    out = []
    for w in _WORD.findall(text):
        if w.isalpha():
            out.append(w)
        else:
            out += "".join(c if c.isalpha() else " " for c in w).split()
    return out


def script_of(word: str) -> str:
    c = ord(word[-1])
    return "latin" if c < _STARTS[0] else SCRIPTS[bisect_right(_STARTS, c) - 1][1]


def grams_of(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)] + [w[i : i + 2] for i in range(len(w) - 1)]


@dataclass
class Languages:
    """Learned languages, the scripts each was seen in, and log probabilities by n-gram (those seen ``LEAST_SEEN`` times, however many)."""

    langs: list[str]
    scripts: dict[str, list[bool]]
    row: dict[str, int]
    logp: np.ndarray
    switch: float = SWITCH
    cache: dict = field(default_factory=dict, repr=False)
    table: list = field(default_factory=list, repr=False)

    def score(self, words: list[str]) -> np.ndarray:
        """Log score of each language for each word, relative to the word's best; -60 where the script rules it out."""
        return self.rows(words)[:, : len(self.langs)]

    def rows(self, words: list[str]) -> np.ndarray:
        """The scores, and a last column that is 1 where there is evidence: a known n-gram in a known script."""
        cache, n = self.cache, len(self.langs)
        if len(cache) > 150_000:
            cache.clear()
        new = [w for w in dict.fromkeys(words) if w not in cache]
        if new:
            if not cache:
                self.table[:] = [np.zeros((0, n + 1), np.float32)]
            get, rows, counts = self.row.get, [], []
            for w in new:
                own = [r for g in grams_of(w) if (r := get(g)) is not None]
                rows += own
                counts.append(len(own))
            total = np.zeros((len(rows) + 1, n))
            np.cumsum(self.logp[rows], axis=0, out=total[1:])
            edge = bounds(counts)
            s = (total[edge[1:]] - total[edge[:-1]]) / 2
            everyone = [True] * n
            kind = [script_of(w) for w in new]
            s[~np.array([self.scripts.get(k, everyone) for k in kind])] = -np.inf
            s = np.maximum(s - s.max(axis=1, keepdims=True), -60).astype(np.float32)
            strange = np.array([k not in self.scripts for k in kind])
            s[strange] = 0
            told = ((np.array(counts) > 0) & ~strange).astype(np.float32)
            base = len(self.table[0])
            self.table[0] = np.concatenate([self.table[0], np.column_stack([s, told])])
            cache.update(zip(new, range(base, base + len(new))))
        return self.table[0][[cache[w] for w in words]]

    def label(self, texts: list[str | None]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        """The words of each text, their labels by exact Viterbi, and whether there is evidence for them.

        Texts are cut into segments that advance together, whatever their text's length: a first pass finds what
        each segment adds between every two states, those sums are chained along each text, and a second pass
        from the values so known notes where the best path to each state switches. The path is then read back
        from switch to switch.
        """
        words = [words_of(t.lower()) if t else [] for t in texts]
        flat = [w for ws in words for w in ws]
        if not flat:
            return [(w, np.zeros(0, np.int16), np.zeros(0)) for w in words]
        counts, n = np.array([len(w) for w in words]), len(self.langs)
        begin = bounds(counts)
        score = self.rows(flat)
        score, told = score[:, :-1], score[:, -1]
        pieces = -(-counts // SEGMENT)
        of = bounds(pieces)
        text = np.repeat(np.arange(len(texts)), pieces)
        rank = np.arange(of[-1]) - of[text]
        first = begin[text] + rank * SEGMENT
        length = np.minimum(begin[text + 1] - first, SEGMENT)
        enter = np.zeros((of[-1], n))  # value of the best path to each state before the segment

        middle = np.flatnonzero(rank < pieces[text] - 1)  # those whose end another segment needs
        if len(middle):
            cost = np.where(np.eye(n, dtype=bool), 0.0, -self.switch)
            m = score[first[middle]][:, None, :] + cost
            m[rank[middle] == 0] = score[first[middle][rank[middle] == 0]][:, None, :]
            for step in range(1, SEGMENT):
                m = np.maximum(m, m.max(axis=2, keepdims=True) - self.switch) + score[first[middle] + step][:, None, :]
            for r in range(int(rank[middle].max()) + 1):
                k = np.flatnonzero(rank[middle] == r)
                enter[middle[k] + 1] = m[k, 0] if r == 0 else (enter[middle[k]][:, :, None] + m[k]).max(axis=1)

        order = np.argsort(-length, kind="stable")
        at, size, head = first[order], length[order], rank[order] == 0
        stay, source = np.zeros(score.shape, bool), np.zeros(len(flat), np.int16)
        best, last = enter[order], np.zeros((of[-1], n))
        for step in range(int(size[0])):
            running = int(np.searchsorted(-size, -step, "left"))
            last[running : len(best)] = best[running:]
            best = best[:running]
            top = best.argmax(axis=1)
            jump = best[np.arange(running), top][:, None] - self.switch
            keep = best >= jump
            if step == 0:
                keep |= head[:running, None]
            stay[at[:running] + step], source[at[:running] + step] = keep, top
            best = np.where(keep, best, jump) + score[at[:running] + step]
        last[: len(best)] = best
        final = np.empty_like(last)
        final[order] = last

        back = np.maximum.accumulate(np.where(stay, -1, np.arange(len(flat))[:, None]), axis=0)
        label = np.zeros(len(flat), np.int16)
        for d in np.flatnonzero(counts):
            lo, hi, state = begin[d], begin[d + 1], int(final[of[d + 1] - 1].argmax())
            while (p := back[hi - 1, state]) > lo:
                label[p:hi] = state
                hi, state = p, int(source[p])
            label[lo:hi] = state
        return [(w, label[begin[d] : begin[d + 1]], told[begin[d] : begin[d + 1]]) for d, w in enumerate(words)]


def fit(docs: DataFrame, *, per_lang: int = PER_LANG, least_seen: int = LEAST_SEEN, switch: float = SWITCH) -> Languages:
    """Count n-grams of about ``per_lang`` training documents of each language (those folds whose remainder isn't 1)."""
    own = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held(F.col("doc_id"), 3, 1))
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Languages([], {}, {}, np.zeros((0, 0)), switch)
    share = F.create_map(*[F.lit(v) for l in langs for v in (l, min(1.0, per_lang / counts[l]))])
    part = saved(own.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).select("lang", "text"))

    def count(batches):
        tally: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = Counter(words_of(text.lower()))
                own = tally.setdefault(lang, Counter())
                for w, n in words.items():
                    own["\x00" + script_of(w)] += n
                    for g in grams_of(w):
                        own[g] += n
        for lang, own in tally.items():
            rows = list(own.items())
            for lo in range(0, len(rows), 20_000):
                some = rows[lo : lo + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([g for g, _ in some]), pa.array([n for _, n in some], pa.int64())], ["lang", "gram", "n"])

    tally = (
        part.mapInArrow(count, "lang string, gram string, n bigint").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
        .groupBy("gram").agg(F.sum("n").alias("total"), F.map_from_arrays(F.collect_list("lang"), F.collect_list("n")).alias("by"))
    )
    marks = tally.where(F.col("gram").startswith("\x00")).collect()
    rows = tally.where(~F.col("gram").startswith("\x00")).where(F.col("total") >= least_seen).orderBy(F.desc("total"), "gram").collect()
    n = np.array([[r["by"].get(l, 0) for l in langs] for r in rows], np.float64).reshape(-1, len(langs))
    logp = np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * max(1, len(rows))))
    seen = {r["gram"][1:]: r["by"] for r in marks}
    whole = {l: sum(by.get(l, 0) for by in seen.values()) for l in langs}
    scripts = {s: [by.get(l, 0) > 0.001 * whole[l] for l in langs] for s, by in seen.items()}
    return Languages(langs, {s: may for s, may in scripts.items() if any(may)}, {r["gram"]: i for i, r in enumerate(rows)}, logp, switch)


def _judge(model: Languages, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, int]]]]:
    out = []
    for words, label, told in model.label(texts) if model.langs else []:
        if not words:
            out.append(("und", 0.0, []))
            continue
        size = np.array([len(w) for w in words])
        letters = np.bincount(label, weights=size * told, minlength=len(model.langs))
        turn = np.flatnonzero(np.diff(label)) + 1
        edges = [0, *turn.tolist(), len(words)]
        best = int((letters if letters.any() else np.bincount(label, weights=size, minlength=len(model.langs))).argmax())
        out.append((model.langs[best], float(letters[best] / size.sum()), [(a, b, int(label[a])) for a, b in zip(edges, edges[1:])]))
    return out or [("und", 0.0, []) for _ in texts]


def label_spans(docs: DataFrame, model: Languages, *, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct ``into``: lang, score (the share of the letters that speak for it) and spans of words [first, last).

    Words of a script or of n-grams that were never learned speak for no language, so a text of those alone has score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf(RESULT)
    def scan(column: pa.Array) -> pa.Array:
        model = slot(shared.value, lambda: replace(shared.value, cache={}, table=[]))
        rows = []
        for part in _parts(column.to_pylist()):
            rows += _judge(model, part)
        spans = [s for r in rows for s in r[2]]
        names = shared.value.langs
        span = pa.StructArray.from_arrays(
            [pa.array([s[0] for s in spans], pa.int32()), pa.array([s[1] for s in spans], pa.int32()), pa.array([names[s[2]] for s in spans], pa.string())], ["first", "last", "lang"])
        return pa.StructArray.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()),
             pa.ListArray.from_arrays(pa.array(bounds([len(r[2]) for r in rows]), pa.int32()), span)], ["lang", "score", "spans"])

    return docs.withColumn(into, scan(F.col(text).cast("string")))


def _parts(texts, chars: int = 2_000_000):
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t or "")
        if n > chars:
            yield part
            part, n = [], 0
    if part:
        yield part


def language_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, n_spans."""
    x = F.col("language")
    return label_spans(docs.select("doc_id", "text"), fit(docs)).select(
        "doc_id", held(F.col("doc_id"), 3, 1).alias("held_out"), x["lang"].alias("lang_pred"), x["score"].alias("score"), F.size(x["spans"]).cast("bigint").alias("n_spans"))


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents with a word that speaks for a learned language, in however many languages; where none was learned, those with a letter."""
    model = fit(docs)
    if not model.langs:

        @arrow_udf("boolean")
        def lettered(column: pa.Array) -> pa.Array:
            return pa.array([t is not None and any(map(str.isalpha, t)) for t in column.to_pylist()], pa.bool_())

        return docs.where(lettered(F.col("text").cast("string")))
    judged = label_spans(docs, model, into="__language")
    return judged.where(F.col("__language")["score"] > 0).select(*[F.col(f"`{c}`") for c in docs.columns])
