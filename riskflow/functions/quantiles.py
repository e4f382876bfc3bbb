"""Exact quantiles and order statistics with bounded memory.

Spark's exact `percentile` keeps a value -> count map for a group in one task, which does not hold for a
continuous column over billions of rows. Here the k-th smallest value is found by histogram refinement:
every pass is one scan with a partial (map-side) aggregation into at most `buckets` counts per target;
the driver only sees those counts. The bracket around each target rank shrinks by a factor of about
`buckets` per pass; once a bracket holds few values they are fetched and ranked exactly.

Linear interpolation between order statistics follows the usual rule (position (n-1)*p), the same as
Spark's `percentile`, DuckDB's `quantile_cont` and pandas' default.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

_BUCKETS = 4096
_FETCH_LIMIT = 5_000


@dataclass
class _Target:
    gkey: tuple
    cidx: int
    rank: int          # 0-based rank among non-null values
    lo: float
    hi: float
    below: int         # values strictly below lo
    value: float | None = None


def _q(c: str):
    return F.col(f"`{c}`")


def _long_form(df: DataFrame, cols: list[str], group_cols: list[str], only=None) -> DataFrame:
    """(groups, c, v): the finite values of the columns, or of those whose numbers are in `only`."""
    items = [F.struct(F.lit(i).alias("c"), _q(c).cast("double").alias("v")) for i, c in enumerate(cols) if only is None or i in only]
    return (df.select(*[_q(g) for g in group_cols], F.explode(F.array(*items)).alias("cv"))
              .select(*[_q(g) for g in group_cols], F.col("cv.c").alias("c"), F.col("cv.v").alias("v"))
              .where(F.abs("v") < F.lit(math.inf)))


def _gkey(row, group_cols) -> tuple:
    return tuple(row[g] for g in group_cols)


def order_statistics(df: DataFrame, cols: list[str], ranks_fn, group_cols=(), buckets: int = _BUCKETS):
    """k-th smallest values. `ranks_fn(n)` gives the 0-based ranks wanted for a (group, column) with n values.

    Returns ({(gkey, col): n}, {(gkey, col, rank): value}).
    """
    group_cols = list(group_cols)
    # first pass: count, min, max per column in one wide aggregate (no explode)
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(f"`{c}`").cast("double")
        v = F.when(~F.isnan(v), v)
        inside = F.when(F.abs(v) < F.lit(math.inf), v)
        aggs += [F.count(v).alias(f"n{i}"), F.min(inside).alias(f"lo{i}"), F.max(inside).alias(f"hi{i}"),
                 F.count_if(v == F.lit(-math.inf)).alias(f"low{i}"), F.count_if(v == F.lit(math.inf)).alias(f"top{i}")]
    base = df.groupBy(*[_q(g) for g in group_cols]).agg(*aggs).collect()
    counts, targets = {}, []
    for r in base:
        g = _gkey(r, group_cols)
        for i, c in enumerate(cols):
            n, lo, hi = r[f"n{i}"], r[f"lo{i}"], r[f"hi{i}"]
            if n == 0:
                continue
            counts[(g, c)] = n
            for k in sorted(set(ranks_fn(n))):
                # infinities lie below and above all brackets: ranks among them need no search
                low, top = r[f"low{i}"], r[f"top{i}"]
                t = _Target(g, i, k, lo, hi, low)
                if k < low or k >= n - top:
                    t.value = -math.inf if k < low else math.inf
                elif lo == hi:
                    t.value = lo
                targets.append(t)
    small = [t for t in targets if t.value is None and counts[(t.gkey, cols[t.cidx])] <= _FETCH_LIMIT]
    if small:
        _fetch_exact_targets(df, cols, group_cols, small)
    while any(t.value is None for t in targets):
        open_t = [t for t in targets if t.value is None]
        # targets with the same bracket share one histogram (at the first pass all ranks of a column do)
        shared: dict[tuple, list] = {}
        for t in open_t:
            shared.setdefault((t.gkey, t.cidx, t.lo, t.hi), []).append(t)
        reps = [ts[0] for ts in shared.values()]
        joined = _bracketed(df, cols, group_cols, reps)
        # halves keep the width finite for the largest doubles
        width = F.col("hi") / 2 - F.col("lo") / 2
        bucket = F.least(F.lit(buckets - 1),
                         F.floor((F.col("v") / 2 - F.col("lo") / 2) / width * F.lit(float(buckets))).cast("int"))
        hist = (joined.groupBy("t", bucket.alias("b"))
                      .agg(F.count("*").alias("m"), F.min("v").alias("vmin"), F.max("v").alias("vmax"))
                      .collect())
        by_t: dict[int, list] = {}
        for r in hist:
            by_t.setdefault(r["t"], []).append((r["b"], r["m"], r["vmin"], r["vmax"]))
        small = []
        for i, ts in enumerate(shared.values()):
            bins = sorted(by_t.get(i, []))
            for t in ts:
                cum = t.below
                for b, m, vmin, vmax in bins:
                    if cum + m > t.rank:
                        t.lo, t.hi, t.below = vmin, vmax, cum
                        if vmin == vmax:
                            t.value = vmin
                        elif m <= _FETCH_LIMIT:
                            small.append(t)
                        break
                    cum += m
        if small:
            _fetch_exact_targets(df, cols, group_cols, small)
    return counts, {(t.gkey, cols[t.cidx], t.rank): t.value for t in targets}


def _bracketed(df: DataFrame, cols: list[str], group_cols, targets: list[_Target]) -> DataFrame:
    """Values inside each open target's bracket, tagged with the target index `t`; settled columns are not read.

    The bracket table has one row per open target (bounded by groups x columns x ranks): broadcast.
    """
    spark = df.sparkSession
    long = _long_form(df, cols, group_cols, {t.cidx for t in targets})
    types = dict(df.dtypes)
    schema = ", ".join([f"`{g}` {types[g]}" for g in group_cols] + ["c int", "t int", "lo double", "hi double"])
    rows = [(*t.gkey, t.cidx, i, float(t.lo), float(t.hi)) for i, t in enumerate(targets)]
    names = [f"__g{i}" for i in range(len(group_cols))]
    brackets = spark.createDataFrame(rows, schema).toDF(*names, "__c", "t", "lo", "hi")
    # null-safe on the groups: rows without a group value are a group as well
    same = F.col("c") == F.col("__c")
    for g, n in zip(group_cols, names):
        same = same & F.col(f"`{g}`").eqNullSafe(F.col(n))
    return long.join(F.broadcast(brackets), same).where(
        (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).drop(*names, "__c")


def _fetch_exact_targets(df: DataFrame, cols: list[str], group_cols, targets: list[_Target]) -> None:
    """Fetch the values of each distinct bracket once (<= _FETCH_LIMIT values each) and rank exactly."""
    shared: dict[tuple, list] = {}
    for t in targets:
        shared.setdefault((t.gkey, t.cidx, t.lo, t.hi), []).append(t)
    reps = [ts[0] for ts in shared.values()]
    vals: dict[int, list] = {}
    for r in _bracketed(df, cols, group_cols, reps).select("t", "v").collect():
        vals.setdefault(r["t"], []).append(r["v"])
    for i, ts in enumerate(shared.values()):
        vs = sorted(vals.get(i, []))
        for t in ts:
            t.value = vs[t.rank - t.below]


def _interp_ranks(probs):
    def fn(n):
        out = []
        for p in probs:
            pos = (n - 1) * p
            k = int(math.floor(pos))
            out += [k, min(k + 1, n - 1)]
        return out
    return fn


def quantiles(df: DataFrame, cols: list[str], probs: list[float], group_cols=(), mode: str = "exact",
              accuracy: int = 10000, with_counts: bool = False):
    """{(gkey, col): [q(p) for p in probs]} over non-null values; None for a column with no values.
    With `with_counts` also {(gkey, col): non-null count}."""
    group_cols = list(group_cols)
    if not cols:
        return ({}, {}) if with_counts else {}
    if mode == "approx":
        long = _long_form(df, cols, group_cols)
        rows = long.groupBy(*[_q(g) for g in group_cols], "c").agg(
            F.percentile_approx("v", list(probs), accuracy).alias("q"), F.count("*").alias("n")).collect()
        out = {(_gkey(r, group_cols), cols[r["c"]]): list(r["q"]) for r in rows}
        cnt = {(_gkey(r, group_cols), cols[r["c"]]): r["n"] for r in rows}
        return (out, cnt) if with_counts else out
    if mode != "exact":
        raise ValueError(f"unknown quantile mode {mode!r}; use 'exact' or 'approx'")
    counts, stats = order_statistics(df, cols, _interp_ranks(probs), group_cols)
    out = {}
    for (g, c), n in counts.items():
        qs = []
        for p in probs:
            pos = (n - 1) * p
            k = int(math.floor(pos))
            lo, hi = stats[(g, c, k)], stats[(g, c, min(k + 1, n - 1))]
            qs.append(lo if lo == hi or pos == k else lo + (hi - lo) * (pos - k))
        out[(g, c)] = qs
    return (out, counts) if with_counts else out


def column_quantiles(df: DataFrame, cols: list[str], probs: list[float], mode: str = "exact",
                     accuracy: int = 10000, with_counts: bool = False):
    """{col: [q(p)...]} without groups; columns with no values map to [None...] (and count 0)."""
    res, cnt = quantiles(df, cols, probs, (), mode, accuracy, with_counts=True)
    out = {c: res.get(((), c), [None] * len(probs)) for c in cols}
    return (out, {c: cnt.get(((), c), 0) for c in cols}) if with_counts else out
