"""What the operators of this subpackage share: byte words, keyed hashes, saved tables."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stripweave.session import shared_folder

U64 = np.uint64
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """Write as Parquet in the shared folder and read back: columnar, prunable, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text whose A-Z are lower-cased; none of null."""
    return text.translate(_WORD_BYTES).split() if text else []


def binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def word_array(text: Column) -> Column:
    """The same words as an array of strings, in Spark's own functions."""
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(folded, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over uint64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_slot: list = []


def slot(owner, make):
    """What a worker process keeps between batches for ``owner``; only the last owner's is kept, whatever ran before."""
    if not _slot or _slot[0] is not owner:
        _slot[:] = [owner, make()]
    return _slot[1]


class HashedWords(dict):
    """Word -> 64-bit hash, computed once per distinct word; emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def bounds(counts) -> np.ndarray:
    """Offsets of consecutive runs of the given lengths."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def lists(flat: np.ndarray, counts, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds(counts), pa.int32()), pa.array(flat, kind))


def held(doc_id: Column, folds: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest`` modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == rest

