"""Spatial density index = min-max of the log of a gaussian kernel density of (lat, lon) on itself.

Constants of the kernel cancel under the min-max, so the index is minmax(ln sum_j w_j exp(-d_ij^2 / 2h^2)).

One algorithm at every table size, cell to cell (a fast Gauss transform); nothing is emitted per pair of points:
  1. equal coordinates become one row with a weight (map-side combine);
  2. a grid cell (side = bandwidth * `kde_cell`) keeps the moments of its points about its centre, a small matrix;
  3. the kernel is separable, so cells send their moments along their row first, then along their column, each time to
     the cells within the radius, where they become the coefficients of a local polynomial (Hermite coefficients of
     the offset between the two centres). Rows and columns are streamed in order, with a window of cells in memory;
  4. every distinct point evaluates its cell's polynomial: points and polynomials meet by cell, salted by the cell's
     point count, and a task streams the points of a cell past its one matrix.
Work is O(points) + O(cells x cells in a row within the radius). Radius and order follow the total weight N and the
tolerance: what lies beyond the radius adds less than `kde_tolerance` to a sum (N exp(-k^2 / 2)), and so does what the
order leaves out. Every sum has its own term of at least 1, so the error of a log density is about the tolerance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskflow.params import Params
from riskflow.session import cut_lineage

_HELD_CELLS = 2_000          # cells whose moments a task holds before it passes them on
_SALT_POINTS = 200_000       # points of one cell that one task evaluates
_CELL = "bx long, by long, m binary"


def radius_in_bandwidths(n: float, tolerance: float) -> float:
    """k with N exp(-k^2 / 2) = tolerance."""
    return math.sqrt(2.0 * math.log(max(n, 1.0) / tolerance))


def expansion_order(n: float, tolerance: float, cell: float) -> int:
    """Smallest p for which the terms above p are below the tolerance, with |He_n(x)| exp(-x^2 / 2) <= 1.09 sqrt(n!)
    and two points of two cells at most `cell` bandwidths off the centre distance, in each dimension."""
    p, term = 0, 1.0
    while True:
        p += 1
        term *= cell / math.sqrt(p)
        if 4.0 * n * term <= tolerance:
            return p


def _powers(x: np.ndarray, p: int) -> np.ndarray:
    """x^a / a! for a = 0..p, one row per value."""
    out = np.ones((len(x), p + 1))
    for a in range(1, p + 1):
        out[:, a] = out[:, a - 1] * x / a
    return out


def _transfer(d: float, p: int) -> np.ndarray:
    """(p + 1, p + 1) matrix of the (a + i)-th derivative of exp(-x^2 / 2) at x = d (in bandwidths)."""
    g = np.empty(2 * p + 2)
    g[0] = math.exp(-d * d / 2.0)
    g[1] = -d * g[0]
    for k in range(2, 2 * p + 1):
        g[k] = -d * g[k - 1] - (k - 1) * g[k - 2]
    i = np.arange(p + 1)
    return g[i[:, None] + i[None, :]]


def _batch(rows: list[tuple], with_flag: bool = False) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())],
                                      names=["bx", "by", "m"])


def _moments(side: float, h: float, p: int):
    """(lat, lon, w) -> partial moment matrices of cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            lat, lon, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            bx, by = np.floor(lat / side), np.floor(lon / side)
            order = np.lexsort((by, bx))
            lat, lon, w, bx, by = lat[order], lon[order], w[order].astype(float), bx[order], by[order]
            u = _powers(-(lat - (bx + 0.5) * side) / h, p)
            v = _powers(-(lon - (by + 0.5) * side) / h, p)
            edges = np.flatnonzero(np.concatenate([[True], (bx[1:] != bx[:-1]) | (by[1:] != by[:-1])])) if len(bx) else []
            for a, b in zip(edges, [*edges[1:], len(bx)]):
                key = (int(bx[a]), int(by[a]))
                m = (u[a:b] * w[a:b, None]).T @ v[a:b]
                held[key] = held[key] + m if key in held else m
            if len(held) > _HELD_CELLS:
                yield _batch([(*k, m.tobytes()) for k, m in held.items()])
                held = {}
        yield _batch([(*k, m.tobytes()) for k, m in held.items()])
    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (bx, by): partial matrices of a cell -> their sum."""
    key, total, out = None, None, []
    for batch in batches:
        for bx, by, m in zip(*(c.to_pylist() for c in batch.columns)):
            m = np.frombuffer(m)
            if (bx, by) == key:
                total = total + m
                continue
            if key is not None:
                out.append((*key, total.tobytes()))
            key, total = (bx, by), m
        if len(out) > _HELD_CELLS:
            yield _batch(out)
            out = []
    if key is not None:
        out.append((*key, total.tobytes()))
    yield _batch(out)


def _along(strip: int, reach: int, step: float, p: int, only_marked: bool):
    """Rows in order of (strip, place): matrices spread to the places within `reach`, summed there.

    `strip` is the column (0: bx, 1: by) that stays, the other one is the place. The first dimension of a matrix belongs
    to bx, the second to by. With `only_marked` only places that a row with an empty matrix marks come out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transfer = {d: _transfer(d * step, p) for d in range(-reach, reach + 1)}
        line, sums, marked = None, {}, set()

        def done(below: int | None) -> list[tuple]:
            ready = [q for q in sums if below is None or q < below]
            rows = []
            for q in sorted(ready):
                m = sums.pop(q)
                if not only_marked or q in marked:
                    rows.append((line, q, m.tobytes()) if strip == 0 else (q, line, m.tobytes()))
                marked.discard(q)
            return rows
        for batch in batches:
            out = []
            bx, by, ms = (c.to_pylist() for c in batch.columns)
            for own, place, m in zip(*((bx, by) if strip == 0 else (by, bx)), ms):
                if own != line:
                    out += done(None) if line is not None else []
                    line, marked = own, set()
                out += done(place - reach)
                if not m:
                    marked.add(place)
                    continue
                m = np.frombuffer(m).reshape(p + 1, p + 1)
                for q in range(place - reach, place + reach + 1):
                    g = transfer[q - place]
                    part = g @ m if strip == 1 else m @ g.T
                    sums[q] = sums[q] + part if q in sums else part
            yield _batch(out)
        yield _batch(done(None) if line is not None else [])
    return run


def _evaluate(side: float, h: float, p: int, tolerance: float):
    """Rows in order of (bx, by, salt, kind): a cell's polynomial (kind 0), then its points -> (lat, lon, log_density)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, poly = None, None
        for batch in batches:
            bx, by, salt, kind, lat, lon = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            ms = batch.column(6)
            starts = np.flatnonzero(np.concatenate([[True], (bx[1:] != bx[:-1]) | (by[1:] != by[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1])]))
            out = []
            for a, b in zip(starts, [*starts[1:], len(bx)]):
                own = (bx[a], by[a], salt[a])
                if kind[a] == 0:
                    key, poly = own, np.frombuffer(ms[int(a)].as_py()).reshape(p + 1, p + 1)
                    continue
                x, y = lat[a:b], lon[a:b]
                if own == key:
                    u = _powers((x - (bx[a] + 0.5) * side) / h, p)
                    v = _powers((y - (by[a] + 0.5) * side) / h, p)
                    value = ((u @ poly) * v).sum(axis=1)
                else:
                    value = np.zeros(b - a)                       # no source within the radius
                out.append((x, y, np.log(np.maximum(value, tolerance))))
            cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in cols], names=["plat", "plon", "log_density"])
    return run


def distinct_points(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """(plat, plon, w) of the non-null, finite coordinate pairs, written once."""
    pts = (df.select(F.col(f"`{lat}`").cast("double").alias("plat"), F.col(f"`{lon}`").cast("double").alias("plon"))
             .where((F.abs("plat") < F.lit(math.inf)) & (F.abs("plon") < F.lit(math.inf))
                    & ~F.isnan("plat") & ~F.isnan("plon")))
    return cut_lineage(pts.groupBy("plat", "plon").agg(F.count("*").alias("w")))


class DensityField:
    """Moments of the source cells: what is needed to evaluate the density anywhere, kept with a fitted model.

    `cells` has at most one row a grid cell. `weight` is the number of source rows; it fixes radius and order."""

    def __init__(self, cells: DataFrame, weight: int, p: Params = Params()):
        self.cells, self.weight, self.h = cells, weight, float(p.kde_bandwidth)
        self.side, self.tolerance = self.h * p.kde_cell, p.kde_tolerance
        self.order = expansion_order(max(weight, 1), self.tolerance, p.kde_cell)
        self.reach = math.ceil(radius_in_bandwidths(max(weight, 1), self.tolerance) / p.kde_cell) + 1

    @classmethod
    def fit(cls, pts: DataFrame, p: Params = Params()) -> "DensityField":
        weight = pts.agg(F.sum("w")).first()[0] or 0
        field = cls(None, weight, p)
        partial = pts.mapInArrow(_moments(field.side, field.h, field.order), _CELL)
        field.cells = cut_lineage(_dealt(partial, "bx", "by").mapInArrow(_summed, _CELL))
        return field

    def save(self, path: str) -> None:
        self.cells.withColumn("weight", F.lit(self.weight).cast("long")).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str, p: Params = Params()) -> "DensityField":
        rows = spark.read.parquet(path)
        first = rows.first()
        return cls(rows.drop("weight"), first["weight"] if first else 0, p)

    def _cell_of(self, c: str):
        return F.floor(F.col(c) / F.lit(self.side)).cast("long")

    def log_density(self, pts: DataFrame) -> DataFrame:
        """(plat, plon, log_density) of points (plat, plon); a sum below the tolerance counts as the tolerance."""
        at = pts.select("plat", "plon", self._cell_of("plat").alias("bx"), self._cell_of("plon").alias("by"))
        targets = cut_lineage(at.groupBy("bx", "by").agg(F.ceil(F.count("*") / _SALT_POINTS).cast("int").alias("salts")))
        step = self.side / self.h
        rows = _dealt(self.cells, "by", "bx").mapInArrow(_along(1, self.reach, step, self.order, False), _CELL)
        marks = targets.select("bx", "by", F.lit(None).cast("binary").alias("m"))
        polys = _dealt(rows.unionByName(marks), "bx", "by").mapInArrow(_along(0, self.reach, step, self.order, True), _CELL)
        polys = polys.join(targets, ["bx", "by"]).select(
            "bx", "by", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"),
            F.lit(0.0).alias("plat"), F.lit(0.0).alias("plon"), "m")
        points = at.join(targets, ["bx", "by"]).select(
            "bx", "by", F.pmod(F.xxhash64("plat", "plon"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"),
            "plat", "plon", F.lit(None).cast("binary").alias("m"))
        n = _tasks(pts)
        ready = polys.unionByName(points).repartition(n, "bx", "by", "salt").sortWithinPartitions("bx", "by", "salt", "kind")
        return ready.mapInArrow(_evaluate(self.side, self.h, self.order, self.tolerance), "plat double, plon double, log_density double")


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _dealt(cells: DataFrame, strip: str, place: str) -> DataFrame:
    """Whole strips in a partition, in order."""
    return cells.repartition(_tasks(cells), strip).sortWithinPartitions(strip, place)


def log_density_points(df: DataFrame, lat: str, lon: str, p: Params = Params(),
                       field: DensityField | None = None) -> tuple[DataFrame, int]:
    """(lat, lon, log_density) for every distinct coordinate pair of `df`, and their count. The sources are the rows of
    `df` itself, or those of a fitted `field`."""
    pts = distinct_points(df, lat, lon)
    field = field or DensityField.fit(pts, p)
    out = field.log_density(pts)
    return out.withColumnsRenamed({"plat": lat, "plon": lon}), pts.count()


def attach_log_density(df: DataFrame, dens: DataFrame, n_points: int, lat: str, lon: str, p: Params, out: str) -> DataFrame:
    """`df` plus column `out` from (lat, lon, log_density); NULL where a coordinate is missing. The points are broadcast
    only under the row and byte bounds (24 bytes each)."""
    dens = dens.select(F.col(lat).alias("__jlat"), F.col(lon).alias("__jlon"), F.col("log_density").alias(out))
    if n_points <= p.broadcast_max_rows and n_points * 24 <= p.broadcast_max_bytes:
        dens = F.broadcast(dens)
    keyed = df.withColumn("__jlat", F.col(f"`{lat}`").cast("double")).withColumn("__jlon", F.col(f"`{lon}`").cast("double"))
    return keyed.join(dens, ["__jlat", "__jlon"], "left").drop("__jlat", "__jlon")
