"""LM scoring: stupid-backoff scores from n-gram count tables partitioned by hash, joined to the exploded n-grams.

Words are lower-cased; the model is the corpus itself, 1- to 3-grams within documents. No n-gram is pruned unless
`min_count` is set above 1: then bigrams and trigrams seen fewer times count as unknown, and words back off. S(w | uv) = c(uvw) / c(uv) if uvw was kept, else 0.4 * S(w | v), S(w | v) = c(vw) / c(v) if vw
was kept, else 0.4 * c(w) / N; the first words of a document have shorter contexts and no factor for that. A document's
score is the sum of ln S over its words; the mean is per word.

Rows of n-grams would be many times the text. So they travel in packed blocks:
1. Scan: documents are put into chunks of about `CHUNK` bytes (ids, compressed texts), written once.
2. Every chunk explodes its n-grams and sends each *distinct* one with its frequency to the part that the leading hash
   bits name: sorted 48-bit hashes, delta-coded. A frequent n-gram is one entry a chunk, so no part is hot.
3. A part sums the frequencies of its hashes (its share of the count table) and answers each block with its counts, in
   the block's order.
4. A chunk meets its answers, explodes its n-grams again, looks the counts up by position and sums per document.
All counts cover the whole table. The number of parts grows with the bytes read, so a part's memory stays bounded; what
reaches the driver are two sums. 48 bits leave a chance of (distinct n-grams / 2**48) that an n-gram shares its count.

Defined results: null or empty text has 0 words and score 0, its mean is null; repeated rows are counted and scored each;
empty tables give no rows; only the two named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from riskflow.llm.common import U, cut, drop_cut, flat, mix64, table, word_hashes, word_spans

ORDER, MIN_COUNT, BACKOFF = 3, 1, 0.4
CHUNK = 3 << 20
PART_BYTES = 8 << 20                 # text bytes a hash part
TASK_BYTES = 32 << 20                # text bytes whose chunks a task scores
HASH_BITS = 48


def _zstd():
    import zstandard
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _chunked(id_type: pa.DataType):
    """Task function: (id, text) -> (chunk, ids, ends, blob, words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, _ = _zstd()
        part, number = TaskContext.get().partitionId(), 0
        ids, sizes, texts, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            raw = b"".join(texts)
            ends = np.cumsum(sizes)
            words = len(word_spans(np.frombuffer(raw, np.uint8), np.concatenate([[0], ends]))[0])
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) | number], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([ends.tolist()], pa.list_(pa.int64())),
                 pa.array([pack.compress(raw)], pa.binary()), pa.array([words], pa.int64())], names=["chunk", "ids", "ends", "blob", "words"])
        for batch in batches:
            data, offs = flat(batch.column(1))
            raw = memoryview(data)
            for d, name in enumerate(batch.column(0).to_pylist()):
                size = int(offs[d + 1] - offs[d])
                if ids and held + size > CHUNK:
                    yield block()
                    ids, sizes, texts, held, number = [], [], [], 0, number + 1
                ids.append(name)
                sizes.append(size)
                texts.append(bytes(raw[offs[d]:offs[d + 1]]))
                held += size
        if ids:
            yield block()
    return run


def ngrams(raw: bytes, ends: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """([hashes of the n-gram that ends at each word] for n = 1..ORDER, first word of each document). Positions without
    n words before them in the document hold the shorter n-gram's hash of another family, which is never looked up."""
    data = np.frombuffer(raw, np.uint8)
    offs = np.concatenate([[0], np.asarray(ends, np.int64)])
    starts, stops, first = word_spans(data, offs)
    word = word_hashes(data, starts, stops, lower=True)
    out = [word]
    for n in range(2, ORDER + 1):
        prev = out[-1]
        here = np.zeros_like(word)
        here[1:] = mix64(prev[:-1] * U(0xE7037ED1A0B428DB) + word[1:] + U(n))
        out.append(here)
    return [h >> U(64 - HASH_BITS) for h in out], first


def with_context(n_words: int, first: np.ndarray, n: int) -> np.ndarray:
    """Which words have n - 1 words before them in their document."""
    ok = np.ones(n_words, bool)
    for k in range(n - 1):
        at = first[:-1] + k
        ok[at[at < first[1:]]] = False
    return ok


def _distinct(hashes: list[np.ndarray], first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sorted distinct hashes, place of each word's n-gram among them, frequencies) by order, of words with full context."""
    out = []
    for n, h in enumerate(hashes, 1):
        own = h[with_context(len(h), first, n)]
        out.append(np.unique(own, return_inverse=True, return_counts=True))
    return out


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """First place of each part in sorted hashes; a part is a range of hashes."""
    bounds = (np.arange(parts + 1, dtype=object) * (1 << HASH_BITS) // parts).astype(np.float64)
    return np.searchsorted(keys, bounds.astype(U))


def _delta(keys: np.ndarray) -> bytes:
    """Sorted hashes as gaps: their low 32 bits, and (place, high bits) of the few gaps that need more."""
    gaps = np.diff(keys, prepend=U(0))
    wide = np.flatnonzero(gaps >> U(32))
    return b"".join([len(wide).to_bytes(4, "little"), wide.astype("<u4").tobytes(), (gaps[wide] >> U(32)).astype("<u4").tobytes(),
                     (gaps & U(0xFFFFFFFF)).astype("<u4").tobytes()])


def _undelta(blob: bytes) -> np.ndarray:
    n, ints = int.from_bytes(blob[:4], "little"), np.frombuffer(blob, "<u4", offset=4)
    gaps = ints[2 * n:].astype(U)
    gaps[ints[:n]] += ints[n:2 * n].astype(U) << U(32)
    return np.cumsum(gaps, dtype=U)


def _small_ints(x: np.ndarray, pack) -> bytes:
    kind = "<u1" if not len(x) or x.max() < 256 else "<u2" if x.max() < 65536 else "<u8"
    return kind[1:].encode() + pack.compress(x.astype(kind).tobytes())


def _ints(blob: bytes, unpack) -> np.ndarray:
    return np.frombuffer(unpack.decompress(blob[2:]), "<" + blob[:2].decode()).astype(np.int64)


def _requests(parts: int):
    """Task function: chunks -> (part, n, chunk, hashes, frequencies)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = _zstd()
        for batch in batches:
            for chunk, ends, blob in zip(*(batch.column(c).to_pylist() for c in range(3))):
                hashes, first = ngrams(unpack.decompress(blob, max_output_size=ends[-1] + 1), ends)
                rows = []
                for n, (keys, _, tf) in enumerate(_distinct(hashes, first), 1):
                    at = _cuts(keys, parts)
                    for p in range(parts):
                        if at[p] < at[p + 1]:
                            own = slice(at[p], at[p + 1])
                            rows.append((p, n, chunk, _delta(keys[own]), _small_ints(tf[own], pack)))
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                                                 names=["part", "n", "chunk", "hashes", "tf"])
    return run


def _answers(min_count: int):
    """Task function: blocks in order of (part, n) -> (chunk, n, part, counts), the count table of one part and order at a time."""
    def solve(pack, key, blocks: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        part, n = key
        keys = np.concatenate([b[1] for b in blocks])
        _, back = np.unique(keys, return_inverse=True)
        counts = np.bincount(back, np.concatenate([b[2] for b in blocks])).astype(np.int64)[back]
        if n > 1:
            counts[counts < min_count] = 0
        ends = np.cumsum([len(b[1]) for b in blocks])[:-1]
        return pa.RecordBatch.from_arrays(
            [pa.array([b[0] for b in blocks], pa.int64()), pa.array([n] * len(blocks), pa.int32()), pa.array([part] * len(blocks), pa.int32()),
             pa.array([_small_ints(c, pack) for c in np.split(counts, ends)], pa.binary())], names=["chunk", "n", "part", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = _zstd()
        key, blocks = None, []
        for batch in batches:
            part, n, chunk, hashes, tf = (c.to_pylist() for c in batch.columns)
            for k, c, h, f in zip(zip(part, n), chunk, hashes, tf):
                if k != key:
                    if blocks:
                        yield solve(pack, key, blocks)
                    key, blocks = k, []
                blocks.append((c, _undelta(h), _ints(f, unpack)))
        if blocks:
            yield solve(pack, key, blocks)
    return run


def _scores(id_type: pa.DataType, total: int):
    """Task function: (chunk's ids, ends, blob, answers) -> (id, n_words, score, n_backed_off)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, unpack = _zstd()
        for batch in batches:
            for i in range(batch.num_rows):
                ids, ends = batch.column(0)[i].values, batch.column(1)[i].as_py()
                hashes, first = ngrams(unpack.decompress(batch.column(2)[i].as_py(), max_output_size=ends[-1] + 1), ends)
                answers = batch.column(3)[i].as_py() or []
                words = len(hashes[0])
                by_word = []                                         # count of the n-gram that ends at each word, 0: none
                for n, (keys, back, _) in enumerate(_distinct(hashes, first), 1):
                    own = sorted((a["part"], a["counts"]) for a in answers if a["n"] == n)
                    counts = np.concatenate([_ints(c, unpack) for _, c in own]) if own else np.zeros(0, np.int64)
                    here = np.zeros(words, np.int64)
                    here[with_context(words, first, n)] = counts[back]
                    by_word.append(here)
                before = [np.concatenate([[0], c[:-1]]) for c in by_word]
                factor = np.zeros(words)
                prob = np.zeros(words)
                left = np.ones(words, bool)
                for n in range(ORDER, 0, -1):
                    full = with_context(words, first, n)
                    hit = left & full & (by_word[n - 1] > 0)
                    below = before[n - 2][hit] if n > 1 else total
                    prob[hit] = np.log(by_word[n - 1][hit]) - np.log(below)
                    left &= ~hit
                    factor[left & full] += math.log(BACKOFF)
                sizes = np.diff(first)
                value, steps = np.zeros(len(sizes)), np.zeros(len(sizes), np.int64)
                if words:
                    own = first[:-1][sizes > 0]
                    value[sizes > 0] = np.add.reduceat(prob + factor, own)
                    steps[sizes > 0] = np.add.reduceat((factor < 0).astype(np.int64), own)
                yield pa.RecordBatch.from_arrays(
                    [ids.cast(id_type), pa.array(sizes, pa.int64()), pa.array(value), pa.array(steps)], names=["id", "n_words", "score", "n_backed_off"])
    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """id, n_words, score (sum of ln S), mean (per word), n_backed_off (words scored with a shorter context)."""
    from pyspark.sql.pandas.types import to_arrow_type
    spark = docs.sparkSession
    spark_id = docs.schema[id_col].dataType
    id_type = to_arrow_type(spark_id)
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(spark_id)), T.StructField("ends", T.ArrayType(T.LongType())),
                           T.StructField("blob", T.BinaryType()), T.StructField("words", T.LongType())])
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    chunked = cut(base.mapInArrow(_chunked(id_type), schema))
    total, size = chunked.agg(F.sum("words"), F.sum(F.element_at("ends", -1))).first()
    parts = max(1, math.ceil((size or 0) / PART_BYTES))
    asked = chunked.select("chunk", "ends", "blob").mapInArrow(_requests(parts), "part int, n int, chunk long, hashes binary, tf binary")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, min(parts, 100_000))
    asked = asked.repartition(n, "part", "n").sortWithinPartitions("part", "n")
    answers = cut(asked.mapInArrow(_answers(min_count), "chunk long, n int, part int, counts binary"))
    tasks = max(least, math.ceil((size or 0) / TASK_BYTES))          # grows with the input, so what a task reads does not
    per = answers.repartition(tasks, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("n", "part", "counts")).alias("answers"))
    rows = chunked.select("chunk", "ids", "ends", "blob").repartition(tasks, "chunk").join(per, "chunk", "left").select("ids", "ends", "blob", "answers")
    out = T.StructType([T.StructField("id", spark_id), T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType()),
                        T.StructField("n_backed_off", T.LongType())])
    scored = rows.mapInArrow(_scores(id_type, int(total or 0)), out)
    return scored.withColumn("mean", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")))


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
