"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Classic harmonic packing puts an item of length in (C/(k+1), C/k] into class k, whose bins hold k items each: a bin is
known from the item's number in its class alone, so workers fill bins without talking to each other. Documents may be
cut, so lengths are made to fit: of what is left of a document, the longest exact reciprocal C//k is cut off while at
least `TAIL` tokens are left; the tail of 1..TAIL-1 tokens is its own class of that length. So every class has one length
L and bins of C//L pieces, offsets are (number in bin) * L, and padding is below C//L or L tokens a full bin.

Tasks tokenise, cut and number their pieces by class; a table (task, length, count) with running sums gives each task's
first number in each class. The last, partly filled bin of each class (at most 2 * TAIL classes, so a constant number of
pieces whatever the input) is packed together with the others by first fit, decreasing.

A pre-token (letters, a digit, other marks) is tokenised once and looked up afterwards: the tokenizer never joins two.

Defined results: null text is empty, its only token is the end id; repeated rows are packed each; empty tables give no
rows; only the two named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from riskflow.llm.common import chunks, cut, flat, table

CAPACITY, TAIL, END_ID = 4096, 64, 2
TOKENIZER = "word_bpe_49k.json"
CACHED_WORDS = 300_000


# The pre-tokens of the tokenizer's own pattern, for lower-cased Latin-1 text: contractions, letters, one digit, the rest.
_LETTERS, _DIGITS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SPACES = " \\t\\n\\x0b\\x0c\\r"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACES}{_LETTERS}{_DIGITS}]+")
# Text for which those pieces are certain: printable Latin-1 and ASCII space. Other texts go through the tokenizer by word.
_PLAIN = re.compile(f"[{_SPACES}!-~\u00a1-\u00ff]*")
_END_OF_WORD = "</w>"


class WordIds:
    """Token ids by pre-token, from a bounded cache over the tokenizer; a worker keeps it for all its tasks.

    New pre-tokens are tokenised together, separated by spaces: each ends with its only end-of-word token."""

    def __init__(self, path: str | None):
        from tokenizers import Tokenizer
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(vocab.values()) + 1, bool)
        self.is_end[[i for t, i in vocab.items() if t.endswith(_END_OF_WORD)]] = True
        self.clear()

    def clear(self) -> None:
        self.pieces: dict[str, int] = {}
        self.words: dict[bytes, int] = {}
        self.pool, self.used, self.n = np.zeros(1 << 16, np.uint32), 0, 0
        self.at, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Adds entries with the given numbers of ids; returns the first entry's number."""
        first, n = self.n, self.n + len(sizes)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.pool[self.used:self.used + len(ids)] = ids
        self.at[first:n] = self.used + np.cumsum(sizes) - sizes
        self.size[first:n] = sizes
        self.used, self.n = self.used + len(ids), n
        return first

    def _learn_pieces(self, new: list[str]) -> None:
        for i in range(0, len(new), 500):
            part = new[i:i + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int64)   # no offsets
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the tokenizer does not end each pre-token with one end-of-word token")
            first = self._store(ids, np.diff(ends, prepend=0))
            self.pieces.update(zip(part, range(first, first + len(part))))

    def _learn_words(self, new: list[bytes]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in new], add_special_tokens=False)]
        first = self._store(np.array([x for ids in found for x in ids], np.int64), np.array([len(ids) for ids in found], np.int64))
        self.words.update(zip(new, range(first, first + len(new))))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts, each followed by END_ID."""
        if self.n > CACHED_WORDS:
            self.clear()
        found, gaps = [], []
        fresh: tuple[dict, dict] = {}, {}
        for t, raw in enumerate(texts):
            text = raw.decode("utf-8", "replace")
            plain = bool(_PLAIN.fullmatch(text)) and "<|" not in text
            keys, index = (_PIECES.findall(text.lower()), self.pieces) if plain else (raw.split(), self.words)
            at = list(map(index.get, keys))
            if None in at:
                missing = [(j, keys[j]) for j, i in enumerate(at) if i is None]
                fresh[plain].update((k, None) for _, k in missing)
                gaps.append((t, index, missing))
            found.append(at)
        # what is new in any of the texts is tokenised together
        if fresh[False]:
            self._learn_words(list(fresh[False]))
        if fresh[True]:
            self._learn_pieces(list(fresh[True]))
        for t, index, missing in gaps:
            for j, k in missing:
                found[t][j] = index[k]
        entries = [np.array(at, np.int64) for at in found]
        at = np.concatenate(entries) if entries else np.zeros(0, np.int64)
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        total = int(ends[-1])
        ids = self.pool[np.repeat(self.at[at] - ends[:-1], size) + np.arange(total)]
        doc_end = ends[np.concatenate([[0], np.cumsum([len(e) for e in entries])])]   # ids before each text's end
        out = np.full(total + len(texts), END_ID, np.uint32)
        out[np.arange(total) + np.repeat(np.arange(len(texts)), np.diff(doc_end))] = ids
        return out, doc_end + np.arange(len(texts) + 1)


@lru_cache(maxsize=1)
def word_ids(path: str | None) -> WordIds:
    return WordIds(path)


def pieces_of(n: int) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    out, rest = [CAPACITY] * (n // CAPACITY), n % CAPACITY
    while rest >= TAIL:
        cut_off = CAPACITY // -(-CAPACITY // rest)
        out.append(cut_off)
        rest -= cut_off
    return out + [rest] * (rest > 0)


def cutter(id_type: pa.DataType, path: str | None):
    """Task function: (id, text) batches -> pieces with their number in the task's class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, seen = word_ids(path), TaskContext.get().partitionId(), {}
        cuts: dict[int, list[int]] = {}
        for batch in batches:
            data, offs = flat(batch.column(1))
            for i, j, text, at in chunks(data, offs):
                raw = text.tobytes()
                toks, ends = ids.encode([raw[at[d]:at[d + 1]] for d in range(j - i)])
                doc, start, length, crc, tokens, number = [], [], [], [], [], []
                for d in range(j - i):
                    own = toks[ends[d]:ends[d + 1]]
                    n = len(own)
                    if n not in cuts:
                        if len(cuts) > 50_000:
                            cuts.clear()
                        cuts[n] = pieces_of(n)
                    p = 0
                    for size in cuts[n]:
                        doc.append(i + d)
                        start.append(p)
                        length.append(size)
                        crc.append(zlib.crc32(own[p:p + size]))
                        tokens.append(n)
                        k = seen.get(size, 0)
                        number.append(k)
                        seen[size] = k + 1
                        p += size
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(id_type).take(pa.array(doc, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens)),
                     pa.array([part] * len(doc), pa.int64()), pa.array(number, pa.int64())],
                    names=["id", "start", "length", "ids_crc32", "doc_tokens", "part", "number"])
    return run


def first_fit(left: dict[int, int], first_sequence: int) -> list[tuple[int, int, int, int]]:
    """(length, number among the left ones, sequence, offset) for the pieces of the partly filled bins."""
    room, rows = [], []
    for length in sorted(left, reverse=True):
        for j in range(left[length]):
            b = next((b for b, r in enumerate(room) if r >= length), None)
            if b is None:
                b = len(room)
                room.append(CAPACITY)
            rows.append((length, j, first_sequence + b, CAPACITY - room[b]))
            room[b] -= length
    return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """A row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `tokenizer_path` is a file that every worker can read; by default the one of the installed package."""
    from pyspark.sql.pandas.types import to_arrow_type
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), *(T.StructField(c, T.LongType()) for c in (
        "start", "length", "ids_crc32", "doc_tokens", "part", "number"))])
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = cut(base.mapInArrow(cutter(to_arrow_type(id_type), tokenizer_path), schema))
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("length").orderBy("part")
    counts = cut(counts.withColumn("first", F.sum("n").over(run) - F.col("n")))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= 2 * TAIL rows
    base_row, classes, left, sequence = [], {}, {}, 0
    for length in sorted(totals, reverse=True):
        in_bin = CAPACITY // length
        full = totals[length] // in_bin
        classes[length] = (sequence, full * in_bin)
        left[length] = totals[length] - full * in_bin
        sequence += full
    base_row = [(k, s, f) for k, (s, f) in classes.items()] or [(0, 0, 0)]
    # both tables have a constant number of rows (classes; pieces of partly filled bins)
    class_table = spark.createDataFrame(base_row, "length long, first_sequence long, in_full long")
    rest = spark.createDataFrame(first_fit(left, sequence) or [(0, 0, 0, 0)], "length long, left_number long, left_sequence long, left_offset long")
    rows = pieces.join(counts.select("length", "part", "first"), ["length", "part"]).join(F.broadcast(class_table), "length")
    rows = rows.withColumn("n", F.col("first") + F.col("number"))
    rows = rows.withColumn("left_number", F.when(F.col("n") >= F.col("in_full"), F.col("n") - F.col("in_full")))
    rows = rows.join(F.broadcast(rest), ["length", "left_number"], "left")
    in_bin = F.lit(CAPACITY) / F.col("length")
    in_bin = F.floor(in_bin)
    full = F.col("left_number").isNull()
    return rows.select(
        "id", "start", "length", "ids_crc32", "doc_tokens",
        F.when(full, F.col("first_sequence") + F.floor(F.col("n") / in_bin)).otherwise(F.col("left_sequence")).cast("long").alias("sequence_id"),
        F.when(full, (F.col("n") % in_bin) * F.col("length")).otherwise(F.col("left_offset")).cast("long").alias("offset"))


def op10_pack_harmonic(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
