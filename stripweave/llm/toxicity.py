"""Toxicity (1): terms of a learned lexicon, also misspelled ones, weighed by their surroundings.

* **Lexicon**: words that stand in toxic training documents far more often than in others (log odds with
  their error), counted by Spark over a bounded sample of labelled rows (``SAMPLE`` documents at most, the
  same ones in every run). All that pass the bars of significance are kept; the sample bounds them.
* **Misspellings**: the Levenshtein automata of all terms, run against the lexicon's trie, are one automaton whose
  states are sets of (trie node, edits so far). Its transitions are worked out when first needed and kept, so
  almost every word of a text dies within a few letters. Short terms must match exactly, longer ones within
  one edit, long ones within two.
* **Context**: a hit inside quotation marks or after a word of reporting counts as quotation and weighs little;
  one near a second-person word or another hit weighs more.
* **Score**: a logistic model over the document's hit sums, fitted on the same sample.

Null and empty texts have no hits and get the model's score for that; long texts are read whole. Without
training rows of both kinds every score is the share of toxic rows seen (0 where there are none). A document
with several label rows counts as toxic if one says so. doc_id, lang, source and labels never enter a score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import held, saved, slot

#: Bound on the labelled documents that the lexicon and the model are fitted on.
SAMPLE = 20_000
WINDOW = 8
#: Words that report speech, and words that address someone.
REPORTING = frozenset("said says say called calls quoted quote quotes wrote writes word words term slur insult report reported alleged sagte nannte dit appelé dijo llamó".split())
ADDRESS = frozenset("you your you're youre u ur yourself du dich dein ihr sie tu te toi vous votre usted eres ustedes".split())
QUOTES = "\"“”«»„"
#: The one cutting of texts: quotation marks, and runs of letters, digits and the signs that spell words.
_TOKEN = re.compile(r"[\"“”«»„]|(?:[^\W_]|[*@$!'])+")
_EDGE = "*@$!'_‘’“”«»„…—–¿¡"
RESULT = "struct<score: double, hits: int, quoted: int>"


def edits_for(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """All terms' Levenshtein automata intersected with the terms' trie, made deterministic as words need it."""

    def __init__(self, terms: list[str], limit: int = 200_000):
        self.child: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.depth_edits: list[int] = [0]  # the most edits that a term below allows
        for number, t in enumerate(terms):
            node, k = 0, edits_for(t)
            self.depth_edits[0] = max(self.depth_edits[0], k)
            for ch in t:
                nxt = self.child[node].get(ch)
                if nxt is None:
                    nxt = self.child[node][ch] = len(self.child)
                    self.child.append({})
                    self.term.append(-1)
                    self.depth_edits.append(0)
                node = nxt
                self.depth_edits[node] = max(self.depth_edits[node], k)
            self.term[node] = number
        self.terms, self.limit = terms, limit
        self._reset()

    def _reset(self):
        self.moves: dict[tuple[int, str], int] = {}
        self.number: dict[frozenset, int] = {frozenset(): 0}
        self.states: list[tuple[tuple[int, int], ...]] = [()]
        self.ends: list[tuple[int, int] | None] = [None]
        self.start = self._state({0: 0})

    def _state(self, best: dict[int, int]) -> int:
        todo = list(best.items())
        while todo:  # a letter of the term left out
            node, e = todo.pop()
            if e < best[node]:
                continue
            for c in self.child[node].values():
                if e + 1 <= self.depth_edits[c] and e + 1 < best.get(c, 99):
                    best[c] = e + 1
                    todo.append((c, e + 1))
        key = frozenset(best.items())
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(tuple(best.items()))
            ends = [(e, self.term[n]) for n, e in best.items() if self.term[n] >= 0 and e <= edits_for(self.terms[self.term[n]])]
            self.ends.append(min(ends, default=None))
        return self.number[key]

    def _move(self, state: int, ch: str) -> int:
        best: dict[int, int] = {}
        for node, e in self.states[state]:
            for c, to in self.child[node].items():
                cost = e + (c != ch)
                if cost <= self.depth_edits[to] and cost < best.get(to, 99):
                    best[to] = cost
            if e + 1 <= self.depth_edits[node] and e + 1 < best.get(node, 99):  # a letter too many
                best[node] = e + 1
        self.moves[state, ch] = out = self._state(best)
        return out

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term within its own bound, else None."""
        if len(self.moves) > self.limit:
            self._reset()
        state, moves = self.start, self.moves
        for ch in word:
            nxt = moves.get((state, ch))
            state = self._move(state, ch) if nxt is None else nxt
            if not state:
                return None
        return self.ends[state]


class _Matches(dict):
    """Word -> match, worked out once per distinct word; emptied when it holds ``limit``."""

    def __init__(self, automaton: LexiconAutomaton, limit: int = 200_000):
        super().__init__()
        self.automaton, self.limit = automaton, limit

    def __missing__(self, word: str):
        if len(self) >= self.limit:
            self.clear()
        self[word] = m = self.automaton.match(word.strip(_EDGE))
        return m


def features(text: str | None, matches: _Matches, weight: list[list[float]]) -> tuple[list[float], int, int]:
    """Hit sums of one whole text: direct, quoted, strongest, hits per word; and the hits, all and quoted."""
    if not text:
        return [0.0] * 4, 0, 0
    tokens = _TOKEN.findall(text.lower())
    if not any([matches[w] for w in tokens]):
        return [0.0] * 4, 0, 0
    marks = np.array([t in QUOTES for t in tokens])
    quotes = np.flatnonzero(marks)
    hits = [(i, m) for i, t in enumerate(tokens) if not marks[i] and (m := matches[t]) and weight[min(m[0], 1)][m[1]]]
    at = np.array([i for i, _ in hits])
    sums, strongest, quoted = [0.0, 0.0], 0.0, 0
    for i, (e, term) in hits:
        w = weight[min(e, 1)][term] * 0.8 ** max(0, e - 1)
        around = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
        k = np.searchsorted(quotes, i)
        inside = 0 < k < len(quotes) and k % 2 == 1 and quotes[k] - quotes[k - 1] <= 2 * WINDOW
        if inside or REPORTING.intersection(tokens[max(0, i - WINDOW) : i]):
            sums[1] += w
            quoted += 1
            continue
        if ADDRESS.intersection(around) or np.searchsorted(at, i + WINDOW, "right") - np.searchsorted(at, i - WINDOW) > 1:
            w *= 1.3
        sums[0] += w
        strongest = max(strongest, w)
    return [*(np.log1p(sums)), strongest, min(1.0, 20 * len(hits) / max(1, len(tokens)))], len(hits), quoted


@dataclass
class Toxicity:
    """A fitted lexicon and model: terms, their weights as they are and misspelled, five coefficients."""

    terms: list[str]
    weight: list[list[float]]
    coef: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.coef[0] + x @ np.array(self.coef[1:]), -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled training documents with text: the smallest hashes of their ids."""
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held(F.col("doc_id"), 5, 0))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return saved(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(own), "doc_id").select("text", "toxic"))


def _lexicon(sample: DataFrame, n: tuple[int, int]) -> list[tuple[str, float]]:
    def count(batches):
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in set(_TOKEN.findall((text or "").lower())):
                    seen.setdefault(w, [0, 0])[toxic] += 1
        words: dict[str, list[int]] = {}
        for w, c in seen.items():
            if t := w.strip(_EDGE):
                own = words.setdefault(t, [0, 0])
                own[0] += c[0]
                own[1] += c[1]
        for lo in range(0, len(words), 20_000):
            some = list(words.items())[lo : lo + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some]), pa.array([c[0] for _, c in some], pa.int64()), pa.array([c[1] for _, c in some], pa.int64())], ["word", "clean", "toxic"])

    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (n[1] + 1.0 - a)) - F.log(b / (n[0] + 1.0 - b))
    rows = (
        sample.mapInArrow(count, "word string, clean bigint, toxic bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where("toxic >= 4").where((a < n[1] + 0.9) & (b < n[0] + 0.9))
        .withColumn("odds", odds).withColumn("z", F.col("odds") / F.sqrt(1 / a + 1 / b)).where("z > 2.6 and odds > 3.2")
        .orderBy(F.desc("z"), "word").collect()
    )
    return [(r["word"], r["odds"]) for r in rows]


def _trusted(sample: DataFrame, terms: list[str], exact: list[float], n: tuple[int, int]) -> list[float]:
    """Each term's weight when misspelled: lower than its own, and 0 where the training texts show near words to be harmless."""

    def count(batches):
        matches, seen = _Matches(LexiconAutomaton(terms)), np.zeros((2, len(terms)), np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {m[1] for w in _TOKEN.findall((text or "").lower()) if (m := matches[w]) and m[0]}
                seen[toxic, list(own)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(terms))), pa.array(seen[0]), pa.array(seen[1])], ["term", "clean", "toxic"])

    out = [0.8 * w for w in exact]
    if terms:
        for r in sample.mapInArrow(count, "term bigint, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).collect():
            if r["c"]:
                odds = np.log((r["t"] + 0.5) / (n[1] + 0.5)) - np.log((r["c"] + 0.5) / (n[0] + 0.5))
                out[r["term"]] = float(min(0.8 * exact[r["term"]], odds / 4)) if odds > 3.2 else 0.0
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Toxicity:
    """Learn lexicon and weights from the training folds' labelled documents; the driver holds ``sample`` feature rows."""
    rows = _sample(docs, labels, sample)
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n = (counts.get(0, 0), counts.get(1, 0))
    if not all(n):
        return Toxicity([], [[], []], [30.0 if n[1] else -30.0] + [0.0] * 4)
    found = _lexicon(rows, n)
    exact = [min(o, 8.0) / 4 for _, o in found]
    model = Toxicity([t for t, _ in found], [exact, _trusted(rows, [t for t, _ in found], exact, n)], [0.0] * 5)
    x = rows.select(_scan(docs.sparkSession.sparkContext.broadcast(model))("text").alias("x"), "toxic").collect()
    model.coef = [float(c) for c in _logistic(np.array([r["x"] for r in x]), np.array([r["toxic"] for r in x]))]
    return model


def _scan(shared):
    @arrow_udf("array<double>")
    def scan(column: pa.Array) -> pa.Array:
        matches, weight = slot(shared.value, lambda: _ready(shared.value))
        return pa.array([[float(v) for v in features(t, matches, weight)[0]] for t in column.to_pylist()], pa.list_(pa.float64()))

    return scan


def _ready(model: Toxicity):
    return _Matches(LexiconAutomaton(model.terms)), model.weight


def score_texts(docs: DataFrame, model: Toxicity, *, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with a struct ``into``: score 0 to 1, lexicon hits and how many of them read as quotation."""

    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf(RESULT)
    def scan(column: pa.Array) -> pa.Array:
        matches, weight = slot(shared.value, lambda: _ready(shared.value))
        rows = [features(t, matches, weight) for t in column.to_pylist()]
        score = shared.value.score(np.array([r[0] for r in rows], np.float64).reshape(-1, 4))
        return pa.StructArray.from_arrays(
            [pa.array(score, pa.float64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], ["score", "hits", "quoted"])

    return docs.withColumn(into, scan(F.col(text).cast("string")))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, hits, quoted."""
    x = F.col("toxicity")
    return score_texts(docs.select("doc_id", "text"), fit(docs, labels)).select(
        "doc_id", held(F.col("doc_id"), 5, 0).alias("held_out"), x["score"].alias("score"), (x["score"] >= 0.5).cast("int").alias("predicted"),
        x["hits"].alias("hits"), x["quoted"].alias("quoted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, at: float = 0.5) -> DataFrame:
    """The documents that score below ``at``, with their columns as they were."""
    judged = score_texts(docs, fit(docs, labels), into="__toxicity")
    return judged.where(F.col("__toxicity")["score"] < at).select(*[F.col(f"`{c}`") for c in docs.columns])
