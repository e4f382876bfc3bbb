"""Hard negatives by segment summary filtering.

Every vector of whole numbers is cut into segments at three depths (16, 4 and 2 components). Stored for a segment are its sum
(its mean times its length) and its deviation (the length of what is left without the mean). For two vectors the product of the
means plus or minus the product of the deviations, summed over the segments, encloses the inner product, so a pair whose
enclosure misses the scores an anchor still needs is dropped; a pair that stays goes to the next depth, and only what stays at
the last one is scored exactly. The scores that an anchor needs tighten as its list of best rows fills.

The anchors are the stated query set against all rows, in blocks: they go in waves of bounded bytes; a wave is sent to the
tasks, each scans its own part of the stored vectors tile by tile and keeps `k` rows an anchor, and Spark merges those lists. A
first scan finds each anchor's positives, a second the negatives of each positive, whose score must lie in a share of the
positive's score. No task sees more than a tile of scores, and the driver holds one wave and its positives. A wave's result is
written to the shared folder, so lost executors repeat a scan at most.

Defined results: a row with a null label, a null vector or a null, NaN or infinite component takes no part, nor does one whose
whole numbers have a squared length of 2^51 or more (scores would no longer be exact); vectors of different lengths are compared
as if the shorter ended in zeros; an empty vector scores 0 with all. Equal scores go by id, null ids last; rows that repeat an id
are rows of their own, repeated anchors repeat their results, and a row of the anchor's own id is never its positive. A null id
is no anchor. A positive with a negative score has no negatives, since no number lies between.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from riskflow.llm.common import cut, table
from riskflow.session import scratch_path

SCALE = 256
DEPTHS = (16, 4, 2)                   # components of a segment, coarse to fine
TILE = 1024                           # anchors and rows of a tile
WAVE_BYTES = 32 << 20                 # anchors sent to the tasks at once, with their summaries
MOST_SQUARED = float(2 ** 51)
SPARSE = 0.15                         # below this share of open pairs they are scored one by one, not as a matrix
NO_ID, NO_SCORE = np.iinfo(np.int64).max, np.iinfo(np.int64).min

STORED = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.LongType()), T.StructField("v", T.ArrayType(T.IntegerType())),
                       *(f for d in DEPTHS for f in (T.StructField(f"sum{d}", T.ArrayType(T.IntegerType())),
                                                     T.StructField(f"dev{d}", T.ArrayType(T.FloatType()))))])


# ---------------------------------------------------------------- stored vectors

def summaries(v: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, deviations) of the segments of each row; the last segment ends in zeros. Deviations are rounded up."""
    n, dim = v.shape
    parts = -(-dim // depth)
    seg = np.zeros((n, parts * depth))
    seg[:, :dim] = v
    seg = seg.reshape(n, parts, depth)
    sums = seg.sum(axis=2)
    dev = np.sqrt(np.maximum((seg * seg).sum(axis=2) - sums * sums / depth, 0))
    return sums, np.nextafter(dev.astype(np.float32), np.float32(np.inf))


def padded(lists: pa.Array, dim: int | None = None) -> np.ndarray:
    """A list column as a float64 matrix; short rows end in zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offs = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(offs)
    values = lists.values.to_numpy(zero_copy_only=False)[offs[0]:offs[-1]].astype(np.float64)
    width = max(int(size.max(initial=0)), dim or 0)
    if len(size) and (size == width).all():
        return values.reshape(len(size), width)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(values)) - (offs[:-1] - offs[0])[row]] = values
    return out


def as_lists(matrix: np.ndarray, size: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Rows of a matrix as lists of the given sizes."""
    keep = np.arange(matrix.shape[1])[None, :] < size[:, None]
    offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(matrix[keep], kind))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.int32())),
                        *(f for d in DEPTHS for f in ((f"sum{d}", pa.list_(pa.int32())), (f"dev{d}", pa.list_(pa.float32()))))])
    for batch in batches:
        batch = batch.filter(pa.compute.is_valid(batch.column(2)))
        if not batch.num_rows:
            continue
        lists = batch.column(2)
        offs = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        x = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)[offs[0]:offs[-1]]
        offs = offs - offs[0]
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
        whole = np.floor(SCALE * np.where(np.isfinite(x), x, 0.0))
        row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        with np.errstate(over="ignore"):
            squared = np.bincount(row, whole * whole, len(offs) - 1)
        good = (bad[offs[1:]] == bad[offs[:-1]]) & (squared < MOST_SQUARED)
        keep = pa.array(good)
        size = np.diff(offs)[good]
        x = whole[good[row]]
        v = padded(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(x)))
        columns = [batch.column(0).filter(keep), batch.column(1).filter(keep), as_lists(v, size, pa.int32())]
        for depth in DEPTHS:
            sums, dev = summaries(v, depth)
            columns += [as_lists(sums, -(-size // depth), pa.int32()), as_lists(dev, -(-size // depth), pa.float32())]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def store(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """The rows that take part, with whole numbers and segment summaries, written once."""
    v = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                    F.col(vector_col).cast("array<double>").alias("v"))
    return cut(v.where("label is not null and v is not null").mapInArrow(_store, STORED))


# ---------------------------------------------------------------- tiles

@dataclass
class Vectors:
    """A block of vectors with its summaries."""
    id: np.ndarray
    label: np.ndarray
    v: np.ndarray
    sums: list[np.ndarray] = field(default_factory=list)
    devs: list[np.ndarray] = field(default_factory=list)

    def __getitem__(self, at) -> "Vectors":
        return Vectors(self.id[at], self.label[at], self.v[at], [s[at] for s in self.sums], [d[at] for d in self.devs])


def ids_of(column: pa.Array) -> np.ndarray:
    return pa.compute.fill_null(column, int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def block(batch: pa.RecordBatch) -> Vectors:
    at = dict(zip(batch.schema.names, batch.columns))
    return Vectors(ids_of(at["id"]), at["label"].to_numpy(zero_copy_only=False).astype(np.int64), padded(at["v"]),
                   [padded(at[f"sum{d}"]) for d in DEPTHS], [padded(at[f"dev{d}"]) for d in DEPTHS])


def meet(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without the columns in which one of them has only zeros."""
    w = min(a.shape[1], b.shape[1])
    return a[:, :w], b[:, :w]


def products(a: np.ndarray, b: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """All inner products of the rows of a and b, or those of the given pairs."""
    a, b = meet(a, b)
    if pairs is None:
        return a @ b.T
    out = np.empty(len(pairs[0]))
    for i in range(0, len(out), 1 << 15):
        s = slice(i, i + (1 << 15))
        out[s] = np.einsum("ij,ij->i", a[pairs[0][s]], b[pairs[1][s]])
    return out


def enclosure(a: Vectors, b: Vectors, k: int, pairs=None) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the scores from the summaries of the k-th depth."""
    middle = products(a.sums[k], b.sums[k], pairs) / DEPTHS[k]
    radius = products(a.devs[k], b.devs[k], pairs) * (1 + 1e-6) + 1e-9 * np.abs(middle) + 0.25
    return middle - radius, middle + radius


def open_scores(a: Vectors, b: Vectors, open_: np.ndarray, low: np.ndarray, high: np.ndarray, seen: list[int] | None = None) -> np.ndarray:
    """Scores of the open pairs that can lie in [low, high] of their anchor, NO_SCORE elsewhere: bounds of all depths, then exact.

    `seen`, if given, collects the number of open pairs before each depth and before exact scoring."""
    for k in range(len(DEPTHS) + 1):
        count = int(np.count_nonzero(open_))
        if seen is not None:
            seen.append(count)
        pairs = np.nonzero(open_) if count < SPARSE * open_.size else None
        if k == len(DEPTHS):
            break
        lower, upper = enclosure(a, b, k, pairs)
        if pairs is None:
            open_ = open_ & (upper >= low[:, None]) & (lower <= high[:, None])
        else:
            stay = (upper >= low[pairs[0]]) & (lower <= high[pairs[0]])
            open_ = np.zeros_like(open_)
            open_[pairs[0][stay], pairs[1][stay]] = True
    out = np.full(open_.shape, NO_SCORE, np.int64)
    exact = products(a.v, b.v, pairs)
    if pairs is None:
        out[open_] = np.rint(exact[open_]).astype(np.int64)
    else:
        out[pairs] = np.rint(exact).astype(np.int64)
    return out


class Best:
    """The best k (score, id) of each slot, best first; equal scores go by id."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score = np.full((slots, k), NO_SCORE, np.int64)
        self.id = np.full((slots, k), NO_ID, np.int64)

    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def offer(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores[i] belong to slots[i]; NO_SCORE is no offer; `ids` of the columns ascend."""
        some = (scores >= np.maximum(self.worst()[slots], NO_SCORE + 1)[:, None]).any(axis=1)
        slots, scores = slots[some], scores[some]
        if not len(slots):
            return
        n = scores.shape[1]
        if n > self.k:
            place = np.arange(n - 1, -1, -1)           # of equal scores the first columns are taken
            key = np.where(scores == NO_SCORE, NO_SCORE, scores * n + place)
            at = np.argpartition(key, n - self.k, axis=1)[:, n - self.k:]
        else:
            at = np.broadcast_to(np.arange(n), scores.shape)
        score = np.concatenate([self.score[slots], np.take_along_axis(scores, at, 1)], axis=1)
        id_ = np.concatenate([self.id[slots], ids[at]], axis=1)
        order = np.lexsort((id_, -np.maximum(score, NO_SCORE + 1)), axis=-1)[:, :self.k]
        self.score[slots] = np.take_along_axis(score, order, 1)
        self.id[slots] = np.take_along_axis(id_, order, 1)

    def rows(self) -> pa.RecordBatch:
        slot, at = np.nonzero(self.score != NO_SCORE)
        ids = self.id[slot, at]
        return pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(ids, pa.int64(), mask=ids == NO_ID),
                                           pa.array(self.score[slot, at])], names=["slot", "id", "score"])


LISTS = T.StructType([T.StructField(c, T.LongType()) for c in ("slot", "id", "score")])


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[Vectors]:
    """The rows of a task in blocks of about TILE, by id inside a block."""
    held, n = [], 0

    def joined() -> Vectors:
        rows = block(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
        return rows[np.argsort(rows.id, kind="stable")]
    for batch in batches:
        for i in range(0, batch.num_rows, TILE):
            held.append(batch.slice(i, TILE))
            n += held[-1].num_rows
            if n >= TILE:
                yield joined()
                held, n = [], 0
    if n:
        yield joined()


def nearest_of(anchors: Vectors, k: int):
    """Task function: each anchor's best k rows of its own label and another id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, slots = Best(len(anchors.id), k), np.arange(len(anchors.id))
        for rows in tiles(batches):
            for i in range(0, len(slots), TILE):
                at = slots[i:i + TILE]
                a = anchors[at]
                open_ = (a.label[:, None] == rows.label) & (a.id[:, None] != rows.id)
                low = best.worst()[at].astype(np.float64)
                best.offer(at, open_scores(a, rows, open_, low, np.full(len(at), np.inf)), rows.id)
        yield best.rows()
    return run


def negatives_of(anchors: Vectors, positive: np.ndarray, k: int, least: int, most: int):
    """Task function: for each anchor's j-th positive (score positive[:, j], NO_SCORE: none) the best k rows of another label
    with least * positive <= 100 * score <= most * positive; slot = anchor * width + j."""
    width = positive.shape[1]
    there = positive != NO_SCORE
    p = np.where(there, positive, 0)
    # bounds in whole numbers; |p| < 2^51, so nothing overflows
    floor_ = np.where(there, -((-least * p) // 100), NO_ID)
    ceiling = np.where(there, (most * p) // 100, NO_SCORE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(positive.size, k)
        for rows in tiles(batches):
            for i in range(0, len(anchors.id), TILE):
                at = np.arange(i, min(i + TILE, len(anchors.id)))
                a = anchors[at]
                needed = np.maximum(floor_[at], best.worst().reshape(-1, width)[at])
                needed = np.where(needed <= ceiling[at], needed, NO_ID)      # a full list or an empty band needs nothing
                low, high = needed.min(axis=1).astype(np.float64), ceiling[at].max(axis=1).astype(np.float64)
                scores = open_scores(a, rows, (a.label[:, None] != rows.label) & (low < NO_ID)[:, None], low, high)
                for j in range(width):
                    fits = (scores >= needed[:, j, None]) & (scores <= ceiling[at, j, None])
                    some = np.flatnonzero(fits.any(axis=1))
                    best.offer(at[some] * width + j, np.where(fits[some], scores[some], NO_SCORE), rows.id)
        yield best.rows()
    return run


# ---------------------------------------------------------------- waves

def scan(stored: DataFrame, task, k: int) -> DataFrame:
    """The tasks' lists merged: slot, id, score, rank for the best k of each slot."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return stored.mapInArrow(task, LISTS).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_wave(spark: SparkSession, stored: DataFrame, wave: DataFrame, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    got = wave.toArrow().combine_chunks()                       # bounded by WAVE_BYTES
    if not got.num_rows:
        return None
    v = padded(got.column("v").combine_chunks())
    a = Vectors(ids_of(got.column("id").combine_chunks()), got.column("label").to_numpy().astype(np.int64), v)
    for depth in DEPTHS:
        sums, dev = summaries(v, depth)
        a.sums.append(sums)
        a.devs.append(dev.astype(np.float64))
    sent = spark.sparkContext.broadcast(a)
    found = scan(stored, lambda b: nearest_of(sent.value, positives)(b), positives).toArrow()   # positives a wave's anchor
    score = np.full((len(a.id), positives), NO_SCORE, np.int64)
    slot, rank = found.column("slot").to_numpy(), found.column("rank").to_numpy() - 1
    score[slot, rank] = found.column("score").to_numpy()
    names = spark.createDataFrame(found.rename_columns(["anchor", "positive_id", "positive_score", "j"]))
    names = names.withColumn("slot", F.col("anchor") * positives + F.col("j") - 1)
    who = spark.createDataFrame(pa.table({"anchor": pa.array(np.arange(len(a.id))), "anchor_id": a.id, "copies": got.column("copies")}))
    bands = spark.sparkContext.broadcast(score)
    hits = scan(stored, lambda b: negatives_of(sent.value, bands.value, negatives, least, most)(b), negatives)
    hits = hits.select("slot", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    out = hits.join(F.broadcast(names), "slot").join(F.broadcast(who), "anchor")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(stored: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100) -> DataFrame:
    """Hard negatives of every anchor (rows of `store`) among all stored rows."""
    spark = stored.sparkSession
    distinct = cut(anchors.where("id is not null").groupBy("id", "label", "v").agg(F.count("*").alias("copies")))
    size = distinct.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    per_anchor = 8 * (3 * max(size["dim"] or 0, max(DEPTHS)) + 64)
    waves = max(1, -(-size["n"] * per_anchor * 2 // WAVE_BYTES)) if size["n"] * per_anchor > WAVE_BYTES else 1
    done = []
    for w in range(waves):
        wave = distinct.where(F.pmod(F.xxhash64("id", "label", "v"), F.lit(waves)) == w)
        out = mine_wave(spark, stored, wave, positives, negatives, least, most)
        if out is not None:
            path = scratch_path(spark, "negatives")
            out.write.parquet(path)
            done.append((path, out.schema))
    if not done:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.IntegerType() if c == "rank" else T.LongType()) for c in (
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")]))
    return spark.read.schema(done[0][1]).parquet(*(path for path, _ in done))


def relabelled(rows: DataFrame) -> DataFrame:
    """The query's labels: where vec_id is divisible by 7, (label + 1) % 10."""
    label = F.col("label").cast("long")
    return rows.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    stored = store(relabelled(table(spark, sf_dir, "embeddings")))
    return mine(stored, stored.where(F.col("id") % 100 == 0))


OP11_SQL = """
with v as (
  select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.rid, a.vec_id as anchor_id, v.vec_id as id, a.label = v.label as same, list_dot_product(a.q, v.q)::bigint as score
  from v a, v where a.vec_id % 100 = 0),
p as (
  select rid, anchor_id, id as positive_id, score as positive_score,
         row_number() over (partition by rid order by score desc, id nulls last) as k
  from s where same and id is distinct from anchor_id),
n as (
  select p.anchor_id, p.positive_id, p.positive_score, s.id as negative_id, s.score as negative_score,
         row_number() over (partition by p.rid, p.k order by s.score desc, s.id nulls last)::int as rank
  from p join s on p.rid = s.rid and not s.same and 80 * p.positive_score <= 100 * s.score and s.score <= p.positive_score
  where p.k <= 5)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 5"""
