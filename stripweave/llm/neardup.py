"""MinHash near-dedup (9): SuperMinHash signatures, banding, verification on whole sets, union-find groups.

1. Each document's set of shingles is hashed (64 bits a shingle) and signed. SuperMinHash draws, for each shingle,
   a permutation of the slots and gives the slot at rank j the value j + r with r in [0, 1): the ranks of one shingle
   are correlated, which lowers the variance, and once every slot has a value below j the document is done.
   All documents of a batch take one rank at a time.
2. Documents with equal sets are one node; nodes that share a band of the signature are candidates. Candidates
   are joined to clusters through one edge per node and band (to the band's least node), never as pairs.
3. The whole sets of a cluster's nodes meet, in blocks of ``BLOCK`` nodes where it is large, and every pair of the
   cluster is compared exactly by blocked products over the shingles that several nodes hold; a union-find
   forest of the links leaves the task. So no link that a band caught is lost, whatever the group's size.
4. Components of the links; the class is the smallest doc_id.

With 32 bands of 6 a pair at similarity 0.85 is missed with probability 3e-7. Null, empty and blank texts have no
shingles and are linked with nothing; texts of fewer words than a shingle are one shingle; ties and repeated rows share
a node. A row with a null id gets a null class, links nothing and counts as kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .bloom import BITS_PER_KEY, MAX_BITS, build_level
from .common import U64, HashedWords, binary, bounds, lists, mix, saved, slot
from .graph import components, find, unite

WORDS, BANDS, ROWS, PERCENT = 5, 32, 6, 85
#: Nodes of a cluster that one task compares with as many others.
BLOCK = 2048
_PART_BYTES = 4_000_000
_MANY, _GOLD = U64(0xFFFFFFFFFFFFFFFF), U64(0x9E3779B97F4A7C15)
_TEXT = "doc_id bigint, text string"


def shingle_sets(texts: list[bytes | None], words: HashedWords, size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased)."""
    tokens = [t.lower().split() if t else [] for t in texts]
    counts = [len(t) for t in tokens]
    start = bounds(counts)
    get = words.__getitem__
    h = np.fromiter((get(w) for t in tokens for w in t), U64, start[-1])
    full = np.full(max(0, len(h) - size + 1), U64(size))
    for j in range(size):
        full = mix(full * _GOLD + h[j : len(h) - size + 1 + j]) if len(full) else full
    out = []
    for a, n in zip(start, counts):
        if n >= size:
            out.append(np.unique(full[a : a + n - size + 1]))
        elif n:
            x = np.full(1, U64(n))
            for w in h[a : a + n]:
                x = mix(x * _GOLD + w)
            out.append(x)
        else:
            out.append(h[:0])
    return out


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """Signatures (documents x ``slots``); a value is rank << 32 | fraction. Empty sets keep the largest value."""
    counts = np.array([len(s) for s in sets])
    sig = np.full((len(sets), slots), _MANY)
    e = np.concatenate(sets) if len(sets) else np.zeros(0, U64)
    doc = np.repeat(np.arange(len(sets)), counts)
    ks = np.zeros((len(e), 0), np.uint16)
    flat = sig.reshape(-1)
    steps = np.arange(1, slots + 1, dtype=U64) * _GOLD
    for j in range(slots):
        x = mix(e + steps[j])
        k = j + ((x & U64(0xFFFFFFFF)) * U64(slots - j) >> U64(32)).astype(np.int64)
        at = k.copy()
        for t in range(j - 1, -1, -1):  # what earlier swaps left at place k
            at[at == ks[:, t]] = t
        np.minimum.at(flat, doc * slots + at, (U64(j) << U64(32)) | (x >> U64(32)))
        left = (sig == _MANY).any(axis=1)[doc]
        if not left.any():
            break
        e, doc = e[left], doc[left]
        ks = np.column_stack([ks[left], k[left].astype(np.uint16)])
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per document and band, different between bands."""
    x = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), x.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * _GOLD + x[:, :, r])
    return key.view(np.int64)


def _parts(batches, column: int):
    """Rows of the batches in parts of bounded text."""
    for batch in batches:
        texts = binary(batch.column(column))
        lo, n = 0, 0
        for i, t in enumerate(texts):
            n += len(t or b"")
            if n > _PART_BYTES or i + 1 == len(texts):
                yield batch.slice(lo, i + 1 - lo), texts[lo : i + 1]
                lo, n = i + 1, 0


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, node (128-bit digest of the whole set; null if empty), keys (one per band)."""

    def sign(batches):
        words = slot(HashedWords, HashedWords)  # what an earlier stage kept in this worker is let go
        for batch, texts in _parts(batches, 1):
            sets = shingle_sets(texts, words, size)
            keys = band_keys(super_minhash(sets, bands * rows), bands, rows)
            some = np.array([len(s) > 0 for s in sets], bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 lists(keys[some].reshape(-1), some * bands, pa.int64())], ["doc_id", "n_shingles", "node", "keys"])

    return docs.mapInArrow(sign, "doc_id bigint, n_shingles bigint, node binary, keys array<bigint>")


def _perhaps(table: DataFrame, name: str):
    """A test of ids that holds for all those in the (written) table and few others, so texts of other rows need no shuffle.

    The filter is bounded; beyond it more rows pass, and the join behind the test still decides.
    """
    n = table.count()
    if not n:
        return lambda key: F.lit(False)
    return build_level(table.select(F.col(name).alias("key")), min(n, MAX_BITS // BITS_PER_KEY), 0).passes


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The whole sets of the ``wanted`` nodes (doc_id, node, cluster, n_blocks), from their first document's text."""

    def sets(batches):
        words = slot(HashedWords, HashedWords)  # what an earlier stage kept in this worker is let go
        for batch, texts in _parts(batches, 1):
            found = shingle_sets(texts, words, size)
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in found]
            right = [i for i, (d, w) in enumerate(zip(digest, batch.column(2).to_pylist())) if d == w]
            own = [found[i] for i in right]
            took = batch.take(pa.array(right, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [took.column(2), took.column(3), took.column(4), lists(np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64), [len(s) for s in own], pa.int64())],
                ["node", "cluster", "n_blocks", "shingles"])

    some = docs.where(_perhaps(wanted, "doc_id")(F.col("doc_id")))
    joined = some.join(wanted, "doc_id").select("doc_id", "text", "node", "cluster", "n_blocks")
    return joined.mapInArrow(sets, "node binary, cluster binary, n_blocks int, shingles array<bigint>")


def links_within(nodes: list[bytes], sets: list[np.ndarray], block: list[int], cross: bool, percent: int) -> list[tuple[bytes, bytes]]:
    """A union-find forest of all links 100 * |a & b| >= percent * |a or b|; with ``cross`` only those between blocks."""
    parent: dict = {}
    if len(nodes) == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        if 100 * n >= percent * (len(sets[0]) + len(sets[1]) - n):
            unite(parent, *nodes)
        return [(x, find(parent, x)) for x in nodes if find(parent, x) != x]
    counts = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), counts)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    number = np.cumsum(new) - 1
    number, owner = number[keep := (np.bincount(number) > 1)[number]], owner[keep]
    _, number = np.unique(number, return_inverse=True)
    width, side = int(number.max()) + 1 if len(number) else 0, np.array(block)
    step = 4096
    rows = max(1, min(len(sets), 2_000_000 // len(sets)))
    for lo in range(0, len(sets), rows):
        hi = min(len(sets), lo + rows)
        both = np.zeros((hi - lo, len(sets)), np.float32)
        for c in range(0, width, step):  # the shingles are numbered in order, so a slice holds one range of them
            a, b = np.searchsorted(number, [c, c + step])
            x = np.zeros((len(sets), step), np.float32)
            x[owner[a:b], number[a:b] - c] = 1
            both += x[lo:hi] @ x.T
        n = both.astype(np.int64)
        near = 100 * n >= percent * (counts[lo:hi, None] + counts[None, :] - n)
        near &= np.arange(lo, hi)[:, None] < np.arange(len(sets))[None, :]
        if cross:
            near &= side[lo:hi, None] != side[None, :]
        for i, j in zip(*np.nonzero(near)):
            unite(parent, nodes[lo + i], nodes[j])
    return [(x, r) for x in list(parent) if (r := find(parent, x)) != x]


def _verified(sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) among the nodes of each cluster; a large cluster's blocks meet two at a time."""
    blocked = sets.withColumn("own", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    tasks = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        "cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "shingles")

    def verify(batches):
        key, held = None, []

        def done():
            if len(held) > 1:
                out = links_within([r[0] for r in held], [r[2] for r in held], [r[1] for r in held], key[1] != key[2], percent)
                return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.binary()) for i in (0, 1)], ["u", "v"])
            return None

        for batch in batches:
            rows = batch.column(5)
            edge, values = rows.offsets.to_numpy(), rows.values.to_numpy()
            for n, now in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)))):
                if now != key:
                    if (out := done()) is not None:
                        yield out
                    key, held = now, []
                held.append((batch.column(4)[n].as_py(), batch.column(3)[n].as_py(), values[edge[n] : edge[n + 1]].view(U64).copy()))
        if (out := done()) is not None:
            yield out

    return tasks.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(verify, "u binary, v binary")


def _classes(docs: DataFrame, size: int, bands: int, rows: int, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, node), and per node its class: component_id and the node that stands for it."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = saved(signatures(texts, size, bands, rows))
    nodes = signed.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
    nodes = saved(nodes)
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    least = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    candidates = keyed.join(least, "key").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    clusters = components(candidates)
    clusters = clusters.unionByName(clusters.select(F.col("v").alias("u"), "v").distinct()).select(F.col("u").alias("node"), F.col("v").alias("cluster"))
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("n_blocks"))
    wanted = clusters.join(sizes, "cluster").join(nodes.select("node", "doc_id"), "node").select("doc_id", "node", "cluster", "n_blocks")
    links = components(_verified(_sets_of(texts, saved(wanted), size).dropDuplicates(["node"]), percent))
    joined = nodes.select("node", "doc_id").join(links.select(F.col("u").alias("node"), F.col("v").alias("top")), "node", "left").withColumn("top", F.coalesce("top", "node"))
    smallest = joined.groupBy("top").agg(F.min(F.struct("doc_id", "node")).alias("least"))
    classes = joined.join(smallest, "top").select("node", F.col("least.doc_id").alias("component_id"), F.col("least.node").alias("stands"))
    return signed.select("doc_id", "n_shingles", "node"), classes


def near_duplicates(docs: DataFrame, *, size: int = WORDS, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    signed, classes = _classes(docs, size, bands, rows, percent, block)
    out = signed.join(classes, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == own)).alias("kept"))


def _node_of(size: int):
    """The node of each text, as ``signatures`` gives it."""

    @arrow_udf("binary")
    def node(column: pa.Array) -> pa.Array:
        words, out = HashedWords(), []
        for t in binary(column):
            own = shingle_sets([t], words, size)[0]
            out.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
        return pa.array(out, pa.binary())

    return node


def drop_near_duplicates(docs: DataFrame, *, size: int = WORDS, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One document of each class, the one with the smallest id, columns as they were; rows with a null id stay.

    Rows are judged, not ids: where several rows share an id each row stays or goes by its own text, so unlike texts under one id all
    stay. Of a class whose smallest id is on several rows one row stays. Rows without shingles are linked with nothing; of those
    with the same id and text one stays.
    """
    signed, classes = _classes(docs, size, bands, rows, percent, block)
    signed = signed.where("doc_id is not null").withColumnRenamed("doc_id", "__id")
    stays = F.expr("component_id is null or (__id = component_id and node = stands)")
    judged = saved(signed.join(classes, "node", "left").select("__id", F.col("node").alias("__node"), stays.alias("stays")))
    often = saved(judged.groupBy("__id").agg(F.count("*").alias("n")).where("n > 1").select("__id"))
    out = saved(judged.where("not stays").select("__id").unionByName(often).distinct())
    key, own = docs["doc_id"].cast("bigint"), [F.col(f"`{c}`") for c in docs.columns]
    perhaps = _perhaps(out, "__id")(key)
    once = docs.where(~perhaps).unionByName(docs.where(perhaps).join(out, key == out["__id"], "left_anti"))
    if often.isEmpty():  # else the texts would be read again to find no row
        return once
    stays = judged.where("stays").select("__id", "__node").distinct()
    again = docs.where(_perhaps(often, "__id")(key)).join(often, key == often["__id"], "left_semi").withColumns({"__id": key, "__node": _node_of(size)(F.col("text").cast("string"))})
    again = again.join(stays, (again["__id"] == stays["__id"]) & again["__node"].eqNullSafe(stays["__node"]), "left_semi")
    again = again.withColumn("__same", F.when(F.col("__node").isNull(), F.xxhash64("text"))).dropDuplicates(["__id", "__node", "__same"])
    return once.unionByName(again.select(*own))


REPORT_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM d),
n AS (SELECT s.list AS s, min(doc_id) AS id, len(s.list) AS n FROM (SELECT list_sort(s) AS list, doc_id FROM s) s WHERE len(s.list) > 0 GROUP BY s.list),
x AS MATERIALIZED (SELECT id, n, unnest(s) AS g FROM n),
p AS (SELECT a.id AS u, b.id AS v FROM x a JOIN x b ON a.g = b.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT u, v FROM p UNION SELECT v, u FROM p),
c AS (SELECT id AS u, id AS v FROM n UNION SELECT c.u, e.v FROM c JOIN e ON c.v = e.u WHERE e.v < c.u OR e.v IS NOT NULL),
k AS (SELECT u AS id, min(v) AS component_id FROM c GROUP BY u)
SELECT doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(k.component_id, doc_id) AS component_id, doc_id = coalesce(k.component_id, doc_id) AS kept
FROM s LEFT JOIN n ON list_sort(s.s) = n.s LEFT JOIN k USING (id)
"""
