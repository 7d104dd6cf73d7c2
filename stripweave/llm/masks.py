"""Ranked lexical search (12): documents grouped by the set of an item's terms they hold, groups taken by their best possible score.

* **Index**: a task turns its documents into shards of at most ``SHARD_DOCS`` documents or ``SHARD_WORDS`` words: per term the documents
  (by their place in the shard, in order of doc_id) and counts. It is written once; statistics are sums over it.
* **Groups**: in a shard every term of an item sets its bit in its documents' masks; equal masks are one group. No document of a group
  scores more than the sum of its terms' best scores in the shard, so groups are evaluated by falling bound until ``k``
  documents are held and the next bound is below the worst of them. What is left can't enter: the answer is exact.
* **Work**: blocks of items meet groups of shards by a shuffle of the postings that some item asks for. A task takes its shards in turn and keeps
  each item's best ones, so later shards start with a threshold. The tasks' answers are merged by a window per item over ``k`` rows a task.

A word is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased, of whole texts. Scores are whole numbers (see ``search``), so ties are exact: they
go to the smaller doc_id, null ids last. Null and empty texts have no terms and aren't counted. Rows with one doc_id are separate
documents; rows with one item_id (or none) are one item of all their terms. Very long texts make shards of their own. Empty tables give no
rows. Other columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import U64, binary, bounds, lists, read, saved, text_words

K = 50
SHARD_DOCS, SHARD_WORDS = 8192, 1_500_000
ITEM_BLOCK, SHARD_GROUP = 1024, 4
#: Asked terms of up to so many bytes are sent to the tasks that index, which then leave other terms out.
SENT_BYTES = 32_000_000
_INDEX = "shard bigint, term string, docs array<int>, tfs array<int>, ids array<bigint>, lens array<int>, named int"


def build_index(docs: DataFrame, asked: set[bytes] | None = None, *, shard_docs: int = SHARD_DOCS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Rows (shard, term, docs, tfs), and one row of a null term per shard: ids and word counts of its documents, those without id last. Written."""
    sent = docs.sparkSession.sparkContext.broadcast(asked) if asked is not None else None

    def shard(number, ids, held, vocabulary):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        named = sum(i is not None for i in ids)
        lens = np.array([held[i][1] for i in order], np.int32)
        none = lists(np.zeros(0, np.int32), [0], pa.int32())
        names = ["shard", "term", "docs", "tfs", "ids", "lens", "named"]
        yield pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([None], pa.string()), none, none, lists(np.array([ids[i] or 0 for i in order], np.int64), [len(ids)], pa.int64()), lists(lens, [len(ids)], pa.int32()), pa.array([named], pa.int32())], names)
        word = np.concatenate([held[i][0] for i in order])
        place = np.repeat(np.arange(len(order)), [len(held[i][0]) for i in order])
        keys, tf = np.unique(word * len(order) + place, return_counts=True)
        word, place = keys // len(order), (keys % len(order)).astype(np.int32)
        words = list(vocabulary)
        edge = bounds(np.bincount(word, minlength=len(words)))
        for lo in range(0, len(words), 20_000):
            hi = min(len(words), lo + 20_000)
            a, per, n = slice(edge[lo], edge[hi]), np.diff(edge[lo : hi + 1]), hi - lo
            empty = [lists(np.zeros(0, np.int64), [0] * n, kind) for kind in (pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * n), pa.array([w.decode("utf-8", "replace") for w in words[lo:hi]]), lists(place[a], per, pa.int32()), lists(tf[a].astype(np.int32), per, pa.int32()), *empty, pa.array([None] * n, pa.int32())], names)

    def run(batches):
        number, ids, held, vocabulary, words = TaskContext.get().partitionId() << 24, [], [], {}, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), binary(batch.column(1))):
                own = text_words(text)
                known = own if sent is None else [w for w in own if w in sent.value]
                ids.append(doc_id)
                held.append((np.array([vocabulary.setdefault(w, len(vocabulary)) for w in known], np.int64), len(own)))
                words += len(own)
                if len(ids) >= shard_docs or words >= shard_words:
                    yield from shard(number, ids, held, vocabulary)
                    number, ids, held, vocabulary, words = number + 1, [], [], {}, 0
        if ids:
            yield from shard(number, ids, held, vocabulary)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return saved(rows.mapInArrow(run, _INDEX))


def masked(postings: list[np.ndarray], size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Documents 0 .. size - 1 by the set of lists that hold them: the group of each document (0: in none), and each group's mask as rows of 64 bits."""
    words = -(-len(postings) // 64)
    bits = np.zeros((words, size), np.uint64)
    for t, docs in enumerate(postings):
        bits[t >> 6, docs] |= U64(1) << U64(t & 63)
    group = np.zeros(size, np.int64)
    first = np.zeros(1, np.int64)
    for w in range(words):  # each 64 bits split the groups further
        own, part = np.unique(bits[w], return_inverse=True)
        _, first, group = np.unique(group * len(own) + part, return_index=True, return_inverse=True)
    masks = [bits[w][first] for w in range(words)]
    return group, masks


class Best:
    """The k best (score, id) so far; null ids behind all others."""

    def __init__(self, k: int):
        self.k = k
        self.score = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)
        self.id = np.zeros(0, np.int64)

    def worst(self) -> int:
        """No lower score can enter; at least 1."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score, null, ids):
        score, null, ids = np.concatenate([self.score, score]), np.concatenate([self.null, null]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.null, self.id = score[order], null[order], ids[order]


def search_shard(terms: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, named: int, best: Best) -> int:
    """Bring a shard's documents into ``best``; the number of documents that had to be scored.

    ``terms``: for each of the item's terms the sorted places of its documents and their scores, of which the document's score is the sum.
    """
    top = [int(s.max()) for _, s in terms]
    if sum(top) < best.worst():
        return 0
    group, masks = masked([d for d, _ in terms], len(ids))
    bound = np.zeros(len(masks[0]), np.int64)
    for t, most in enumerate(top):
        bound += most * ((masks[t >> 6] >> U64(t & 63)) & U64(1)).astype(np.int64)
    order = np.argsort(-bound, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by = np.argsort(rank[group], kind="stable")  # documents by falling bound of their group
    falling = bound[group[by]]
    at, width = 0, best.k
    while at < len(by) and falling[at] >= best.worst():
        end = min(len(by), at + width)
        end = int(np.searchsorted(-falling, -falling[end - 1], "right"))  # whole groups
        end = min(end, int(np.searchsorted(-falling, -best.worst(), "right")))
        docs = np.sort(by[at:end])
        score = np.zeros(len(docs), np.int64)
        for own, scores in terms:
            place = np.minimum(np.searchsorted(own, docs), len(own) - 1)
            score += np.where(own[place] == docs, scores[place], 0)
        keep = score >= best.worst()
        if keep.any():
            best.add(score[keep], docs[keep] >= named, ids[docs[keep]])
        at, width = end, 2 * width
    return at


def search(docs: DataFrame, items: DataFrame, *, k: int = K, item_block: int = ITEM_BLOCK, group: int = SHARD_GROUP, shard_docs: int = SHARD_DOCS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The ``k`` best documents of each item with a score above 0: item_id, rank (from 1), doc_id, score.

    Over all documents: N with at least one term, L terms with repeats, df the documents holding a term. A document of n terms, tf of them this one,
    scores the sum over the item's terms of floor(1000 ln((2 N + 2) / (2 df + 1))) * (10^9 tf div (1000 tf + 20 (50 + 50 n N div L))).
    """

    def words(batches):
        for batch in batches:
            rows = [(i, w.decode("utf-8", "replace")) for i, text in zip(batch.column(0).to_pylist(), binary(batch.column(1))) for w in set(text_words(text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.string())], ["item_id", "term"])

    asked = items.select("item_id", F.col("text").cast("string").alias("text"))
    asked = saved(asked.mapInArrow(words, asked.select("item_id", F.col("text").alias("term")).schema).distinct())
    distinct = asked.select("term").distinct()
    size = distinct.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    few = {r["term"].encode() for r in distinct.collect()} if size <= SENT_BYTES else None
    index = build_index(docs, few, shard_docs=shard_docs, shard_words=shard_words)
    shards = index.where("term is null")
    n, total, count = shards.agg(
        F.sum(F.size(F.filter("lens", lambda x: x > 0))), F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)), F.count(F.lit(1))).first()
    n, total = n or 0, total or 0
    blocks = max(1, -(-asked.select("item_id").distinct().count() // item_block))
    groups = max(1, -(-count // group))
    df = index.where("term is not null").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block")
    terms = asked.join(df, "term").groupBy("term", block).agg(F.first("df").alias("df"), F.collect_list(F.struct("item_id")).alias("items"))
    own_group = F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int").alias("group")
    met = index.where("term is not null").drop("ids", "lens", "named").join(terms, "term").select("block", own_group, "shard", F.lit(1).alias("kind"), "df", "items", "docs", "tfs", F.lit(None).cast("array<bigint>").alias("ids"), F.lit(None).cast("int").alias("named"))
    heads = shards.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), own_group, "shard", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("df"), F.lit(None).cast(terms.schema["items"].dataType).alias("items"), F.lit(None).cast("array<int>").alias("docs"), F.col("lens").alias("tfs"), "ids", "named")
    rows = met.unionByName(heads).repartition("block", "group").sortWithinPartitions("block", "group", "shard", "kind")
    item_type = asked.schema["item_id"].dataType

    def answer(batches):
        task = shard = None
        best: dict = {}
        by: dict = {}
        ids = m = None
        named = 0

        def scored():
            for item, own in by.items():
                search_shard(own, ids, named, best.setdefault(item, Best(k)))
            by.clear()

        def found():
            items_, docs_, scores = [], [], []
            for item, b in best.items():
                items_ += [item] * len(b.score)
                docs_ += [None if null else i for i, null in zip(b.id.tolist(), b.null.tolist())]
                scores += b.score.tolist()
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array(items_, kind), pa.array(docs_, pa.int64()), pa.array(scores, pa.int64())], ["item_id", "doc_id", "score"])

        kind = None
        for batch in batches:
            column = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            kind = column["items"].type.value_type.field(0).type
            of = {f: (column[f].offsets.to_pylist(), column[f].values.to_numpy(zero_copy_only=False)) for f in ("docs", "tfs", "ids")}
            part = lambda f, i: of[f][1][of[f][0][i] : of[f][0][i + 1]]
            rows = [column[f].to_pylist() for f in ("block", "group", "shard", "kind", "df", "named")]
            asking = column["items"].to_pylist()
            for i, (b, g, s, what, df_, named_) in enumerate(zip(*rows)):
                if (b, g) != task or s != shard:
                    scored()
                    if (b, g) != task and best:
                        yield found()
                if what == 0:
                    task, shard, named = (b, g), s, named_
                    ids = part("ids", i).astype(np.int64)
                    m = 50 + 50 * part("tfs", i).astype(np.int64) * n // max(1, total)
                    continue
                docs_, tf = part("docs", i).astype(np.int64), part("tfs", i).astype(np.int64)
                weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df_ + 1)))
                if weight > 0:
                    one = (docs_, weight * (1_000_000_000 * tf // (1000 * tf + 20 * m[docs_])))
                    for item in asking[i]:
                        by.setdefault(item["item_id"], []).append(one)
        scored()
        if best:
            yield found()

    schema = StructType([StructField("item_id", item_type), StructField("doc_id", LongType()), StructField("score", LongType())])
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = rows.mapInArrow(answer, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search_report(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
REPORT_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT count(*) FILTER (len(ws) > 0) AS n, sum(len(ws))::BIGINT AS l FROM d),
p AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w),
f AS (SELECT w, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY w, n),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS w FROM benchmark),
g AS (SELECT item_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(ws) * n) // l))))::BIGINT AS score
      FROM q JOIN f USING (w) JOIN p USING (w) JOIN d USING (r), s GROUP BY item_id, r)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
FROM g JOIN d USING (r) WHERE score > 0 QUALIFY rank <= {K}
"""
