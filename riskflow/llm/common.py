"""Shared helpers of the training-data operators: table access, word spans and 64-bit hashes over Arrow buffers.

A word everywhere is a maximal run of `[^\\x20\\x09-\\x0D]+`. Hashes are computed on whole Arrow batches with
numpy (no Python loop per word); batches are cut into chunks of bounded bytes so that the memory of a task does
not depend on how many rows a batch has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from riskflow.session import configure, scratch_path

SPACE_CLASS = r"[ \t-\r]"          # Java / Python regex for one space character
WORD_CLASS = r"[^ \t-\r]"
CHUNK_BYTES = 1 << 21               # text bytes hashed at once in a task
BATCH_ROWS, BATCH_BYTES = "512", "8m"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

U = np.uint64


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: shared folder, package for workers, small Arrow batches (texts are long)."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise once as Parquet in the shared folder (survives lost executors) and read it back."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "llm")
    kept = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # the plan runs once; its shuffle files go as soon as the table is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, kept)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table from `cut` once nothing reads it any more (other frames are left alone)."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def null_safe_eq(a, b):
    return a.eqNullSafe(b)


# ---------------------------------------------------------------- hashing in tasks

def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element-wise on uint64."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers = {"n": 0, "up": np.ones(1, U), "down": np.ones(1, U)}
_BYTE = mix64(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n (cached, grown when needed)."""
    if _powers["n"] < n:
        m = max(n, CHUNK_BYTES + 1024)
        up = np.full(m, _BASE, U)
        up[0] = 1
        down = np.full(m, _INV, U)
        down[0] = 1
        _powers.update(n=m, up=np.cumprod(up), down=np.cumprod(down))
    return _powers["up"][:n], _powers["down"][:n]


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type != pa.string():
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, offs


def chunks(data: np.ndarray, offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0): whole texts, together at most `most` bytes unless one text is longer."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of words; first[d]:first[d+1] are the words of text d."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~_IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash for each span: a polynomial over random byte values, then mixed."""
    if len(starts) == 0:
        return np.zeros(0, U)
    up, down = powers(len(data) + 1)
    part = _BYTE[_LOWER[data] if lower else data]
    part *= up[:len(data)]
    total = np.empty(len(data) + 1, U)
    total[0] = 0
    np.cumsum(part, out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U) * U(0xA0761D6478BD642F))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each text, sorted; a text of 1..k-1 words has one shingle, its whole
    sequence; an empty text none. Returns (hashes, first) like `word_spans`."""
    n_docs, counts = len(first) - 1, np.diff(first)
    out_n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    total = int(out_n.sum())
    if total == 0:
        return np.zeros(0, U), np.zeros(n_docs + 1, np.int64)
    doc = np.repeat(np.arange(n_docs), out_n)
    start = np.concatenate([[0], np.cumsum(out_n)])[:-1]
    at = np.arange(total) - start[doc] + first[:-1][doc]
    length = np.minimum(counts[doc], k)
    value = np.zeros(total, U)
    for j in range(k):
        inside = j < length
        pos = np.where(inside, at + j, 0)
        value = np.where(inside, mix64(value * U(0xE7037ED1A0B428DB) + hashes[pos] + U(j + 1)), value)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    fresh = np.ones(total, bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[fresh], doc[fresh]
    return value, np.searchsorted(doc, np.arange(n_docs + 1))


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as the int64 with the same bits (Spark has no unsigned type)."""
    return np.ascontiguousarray(x, U).view(np.int64)
