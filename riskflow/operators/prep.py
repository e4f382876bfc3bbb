"""Preparation chain C1-C24: `Prep(p).fit(df, target)` -> `PrepModel`, `PrepModel.transform(df)`.

Fit decides the schema once in a few aggregate passes whose results are bounded by the number of
columns / categories; every fitted number becomes a literal, so `transform` is a pure projection (plus,
only for very large category maps, one join) and runs on a batch or a stream alike.

Fit passes over the de-duplicated rows (checkpointed once, since several jobs read them):
  1. aggregates: constant flags and numeric-parse failures per column, masks of text columns that may hold times;
  2. category distincts (bounded by the category count);
  3. outlier statistics: exact quartiles (histogram refinement) or mean / population std;
  4. imputation statistics on the outlier-handled values (the median equals the pre-clip one);
  5. scaler statistics on the clipped + imputed values.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from riskflow.functions.geo import geo_feature_columns
from riskflow.functions.hashing import bucket, row_hash
from riskflow.functions.group_cuts import with_cuts
from riskflow.functions.quantiles import column_quantiles
from riskflow.functions.temporal import calendar_parts, parse_time
from riskflow.functions.time_formats import induce
from riskflow.operators.profile import infer_coords, nan_to_null
from riskflow.params import Params
from riskflow.session import cut_lineage
from riskflow.sources.store import Store

# Number text accepted by the numeric coercion (Spark's cast also takes '1d' / '1f', pandas does not).
NUMBER_RE = r"^\s*[+-]?((\d+\.?\d*)|(\.\d+))([eE][+-]?\d+)?\s*$"
INTEGER_RE = r"^\s*[+-]?\d+\s*$"
# Maps up to this many entries become a literal map expression (a linear search per row); larger ones a join.
LITERAL_MAP_MAX = 64

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_TIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _num(c: str) -> Column:
    """A column as double; NaN is missing, as NULL is."""
    return F.nanvl(_q(c).cast("double"), F.lit(None).cast("double"))


# ---------------------------------------------------------------------------------------------------
# single operators (each usable alone; the chain below composes them)

def drop_duplicates(df: DataFrame) -> DataFrame:
    """Whole-row de-duplication (NULLs equal)."""
    return df.dropDuplicates()


# A text target with more distinct values than this is not a class label: fitting stops with an error
# instead of collecting an unbounded value list.
MAX_CLASSES = 10_000


def _class_values(df: DataFrame, col: str) -> list:
    """Sorted distinct non-NULL values of a text target (at most MAX_CLASSES reach the driver)."""
    got = [r[0] for r in df.select(_q(col)).where(_q(col).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()]
    if len(got) > MAX_CLASSES:
        raise ValueError(f"target {col!r} has more than {MAX_CLASSES} distinct values; it is not a class label")
    return sorted(got)


def with_label(df: DataFrame, target: str, out: str = "label") -> tuple[DataFrame, dict | None]:
    """The target renamed to `out`; text labels become codes of their sorted values (the map is
    returned, bounded by the class count). NULL labels stay NULL."""
    if target not in df.columns:
        return df, None
    x = df.withColumnRenamed(target, out) if target != out else df
    if not isinstance(df.schema[target].dataType, T.StringType):
        return x, None
    values = _class_values(x, out)
    mapping = {v: i for i, v in enumerate(values)}
    lm = F.create_map(*[z for k, v in mapping.items() for z in (F.lit(k), F.lit(v))])
    return x.withColumn(out, F.try_element_at(lm, _q(out))), mapping


def drop_constant(df: DataFrame, keep: list[str] | tuple = ()) -> tuple[DataFrame, list[str]]:
    """Drop columns with at most one distinct non-null value (one min <=> max pass)."""
    fields = [f for f in df.schema.fields if f.name not in keep
              and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    if not fields:
        return df, []
    r = df.agg(*[F.min(_q(f.name)).eqNullSafe(F.max(_q(f.name))).alias(f"k{i}") for i, f in enumerate(fields)]).first()
    const = [f.name for i, f in enumerate(fields) if r[f"k{i}"]]
    return df.drop(*const), const


def _is_long(x: Column) -> Column:
    """Integer text that fits 64 bits (longer digits stay numbers, as double)."""
    return x.rlike(INTEGER_RE) & F.trim(x).try_cast("bigint").isNotNull()


def coerce_plan(df: DataFrame, cols: list[str] | None = None) -> dict[str, str]:
    """C4 decision: string columns whose every non-null value is a number -> 'bigint' (all integers) or
    'double'. One aggregate pass."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        x = _q(c)
        aggs += [F.count_if(x.isNotNull() & ~x.rlike(NUMBER_RE)).alias(f"bad{i}"),
                 F.count_if(x.isNotNull() & ~_is_long(x)).alias(f"nonint{i}")]
    r = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(cols):
        if r[f"bad{i}"] == 0:
            out[c] = "bigint" if r[f"nonint{i}"] == 0 else "double"
    return out


def apply_coercion(df: DataFrame, plan: dict[str, str]) -> DataFrame:
    """C4 apply: cast the chosen columns (a value that no longer parses becomes NULL)."""
    if not plan:
        return df
    return df.withColumns({c: F.when(_q(c).rlike(NUMBER_RE), F.trim(_q(c))).try_cast(t) for c, t in plan.items()})


def coerce_types(df: DataFrame) -> DataFrame:
    return apply_coercion(df, coerce_plan(df))


def add_geo_features(df: DataFrame, lat: str | None, lon: str | None) -> DataFrame:
    """C5-C7."""
    if not (lat and lon):
        return df
    return df.withColumns(geo_feature_columns(lat, lon))


def detect_temporal(df: DataFrame, cols: list[str] | None = None) -> dict[str, str | None]:
    """Time columns as they are (format None) and string columns with the one format that parses every
    non-null value (derived from the values' masks). Two aggregate passes."""
    out: dict[str, str | None] = {}
    strings = []
    for f in df.schema.fields:
        if cols is not None and f.name not in cols:
            continue
        if isinstance(f.dataType, _TIME):
            out[f.name] = None
        elif isinstance(f.dataType, T.StringType):
            strings.append(f.name)
    out.update(induce(df, strings))
    return out


def add_temporal_features(df: DataFrame, plan: dict[str, str | None]) -> DataFrame:
    """Five calendar parts per time column; the source column is dropped."""
    if not plan:
        return df
    cols = {}
    for c, fmt in plan.items():
        if c in df.columns:
            cols.update(calendar_parts(parse_time(c, fmt), c))
    return df.withColumns(cols).drop(*[c for c in plan if c in df.columns])


def _distinct_values(df: DataFrame, cols: list[str]) -> DataFrame:
    items = [F.struct(F.lit(c).alias("column"), _q(c).cast("string").alias("value")) for c in cols]
    return (df.select(F.explode(F.array(*items)).alias("cv")).select("cv.column", "cv.value")
              .where(F.col("value").isNotNull()).distinct())


def _ranked_codes(distinct: DataFrame, n_values: int) -> DataFrame:
    """Codes 0..K-1 per column in value order without holding a column in one task: range-partition the
    distinct values on (column, value), fix the partition ids once (reliable checkpoint), add the counts of
    the lower ranges (one row per range) to a row number inside each range."""
    from pyspark.sql import Window
    spark = distinct.sparkSession
    n_parts = max(spark.sparkContext.defaultParallelism, n_values // 1_000_000)
    d = cut_lineage(distinct.repartitionByRange(n_parts, "column", "value")
                            .withColumn("pid", F.spark_partition_id()))
    counts = d.groupBy("column", "pid").agg(F.count("*").alias("m"))
    below = Window.partitionBy("column").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("column", "pid", F.coalesce(F.sum("m").over(below), F.lit(0)).alias("off"))
    inside = Window.partitionBy("column", "pid").orderBy("value")
    return (d.join(F.broadcast(offsets), ["column", "pid"])
             .select("column", "value", (F.col("off") + F.row_number().over(inside) - 1).cast("int").alias("code")))


def fit_categories(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, code): distinct non-null values as text, sorted, coded 0..K-1.

    The distinct table is bounded by the category count (partial aggregation before the shuffle); codes
    come from ranges of it (`_ranked_codes`), never from a window over the rows.
    """
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, code int")
    distinct = cut_lineage(_distinct_values(df, cols))
    return _ranked_codes(distinct, distinct.count())


class CategoryEncoder:
    """C11: code per value; unseen and NULL -> -1. Small maps are literal map expressions (no join, a pure
    projection); large ones a join on (value) - broadcast when its counted size allows."""

    def __init__(self, mapping: dict[str, dict[str, int]] | None = None, table: DataFrame | None = None,
                 broadcast_max_rows: int = 2_000_000, broadcast_max_bytes: int = 128 << 20):
        self.mapping = mapping
        self.table = table
        self.broadcast_max_rows = broadcast_max_rows
        self.broadcast_max_bytes = broadcast_max_bytes
        self._measured: dict[str, tuple[int, int]] | None = None

    def _sizes(self) -> dict[str, tuple[int, int]]:
        """Rows and value bytes of each column's map, measured once (one row a column)."""
        if self._measured is None:
            rows = self.table.groupBy("column").agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("b")).collect()
            self._measured = {r["column"]: (r["n"], r["b"] or 0) for r in rows}
        return self._measured

    @classmethod
    def fit(cls, df: DataFrame, cols: list[str], p: Params = Params()) -> "CategoryEncoder":
        if not cols:
            return cls(mapping={})
        # one job decides: at most LITERAL_MAP_MAX + 1 distinct rows ever reach the driver
        head = _distinct_values(df, cols).limit(LITERAL_MAP_MAX + 1).collect()
        if len(head) <= LITERAL_MAP_MAX:
            # small: codes on the driver (text sorts by code point, as Spark's UTF-8 byte order does)
            mapping: dict[str, list] = {c: [] for c in cols}
            for r in head:
                mapping[r["column"]].append(r["value"])
            return cls(mapping={c: {v: i for i, v in enumerate(sorted(vs))} for c, vs in mapping.items()})
        distinct = cut_lineage(_distinct_values(df, cols))
        return cls(table=cut_lineage(_ranked_codes(distinct, distinct.count())),
                   broadcast_max_rows=p.broadcast_max_rows, broadcast_max_bytes=p.broadcast_max_bytes)

    @property
    def columns(self) -> list[str]:
        if self.mapping is not None:
            return list(self.mapping)
        return list(self._sizes())

    def apply(self, df: DataFrame) -> DataFrame:
        if self.mapping is not None:
            exprs = {}
            for c, m in self.mapping.items():
                if c not in df.columns:
                    continue
                if m:
                    lit_map = F.create_map(*[x for k, v in sorted(m.items()) for x in (F.lit(k), F.lit(v))])
                    exprs[c] = F.coalesce(F.try_element_at(lit_map, _q(c).cast("string")), F.lit(-1))
                else:
                    exprs[c] = F.lit(-1)
            return df.withColumns(exprs) if exprs else df
        out = df
        # a map side is broadcast only when rows and bytes are both under the limits (text has no fixed width)
        sizes = self._sizes()
        for c, (n, nbytes) in sizes.items():
            if c not in out.columns:
                continue
            t = self.table.where(F.col("column") == c).select(F.col("value").alias(f"__v_{c}"),
                                                               F.col("code").alias(f"__code_{c}"))
            if n <= self.broadcast_max_rows and nbytes + 16 * n <= self.broadcast_max_bytes:
                t = F.broadcast(t)
            out = (out.join(t, _q(c).cast("string") == F.col(f"__v_{c}"), "left")
                      .withColumn(c, F.coalesce(F.col(f"__code_{c}"), F.lit(-1)))
                      .drop(f"__v_{c}", f"__code_{c}"))
        return out

    def to_rows(self):
        if self.mapping is not None:
            return [(c, v, code) for c, m in self.mapping.items() for v, code in m.items()]
        return None


def encode(df: DataFrame, encoder: "CategoryEncoder") -> DataFrame:
    """C11: apply a fitted category encoder (unseen and NULL -> -1)."""
    return encoder.apply(df)


def iqr_bounds(df: DataFrame, cols: list[str], p: Params = Params(), with_counts: bool = False):
    """C13 fit: Q1, median, Q3 (linear) and the clip bounds Q1 - 1.5 IQR, Q3 + 1.5 IQR per column
    (and, with `with_counts`, the non-null count per column from the same pass)."""
    qs, counts = column_quantiles(df, cols, [0.25, 0.5, 0.75], p.quantiles, p.approx_accuracy, with_counts=True)
    out = {}
    for c in cols:
        q1, q2, q3 = qs[c]
        if q1 is None:
            out[c] = (None, None, None, None, None)
            continue
        iqr = q3 - q1
        out[c] = (q1 - 1.5 * iqr, q3 + 1.5 * iqr, q1, q2, q3)
    return (out, counts) if with_counts else out


def clip_expr(c: Column, lo, hi) -> Column:
    """NULL-safe clip (NULL stays NULL)."""
    if lo is None:
        return c
    return F.when(c.isNull(), c).otherwise(F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def clip_iqr(df: DataFrame, cols: list[str], p: Params = Params()) -> DataFrame:
    b = iqr_bounds(df, cols, p)
    return df.withColumns({c: clip_expr(_num(c), b[c][0], b[c][1]) for c in cols})


def zscore_stats(df: DataFrame, cols: list[str]) -> dict[str, tuple]:
    """C14 fit: mean and population std of the values with NULL read as 0."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.coalesce(_num(c), F.lit(0.0))
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    r = df.agg(*aggs).first()
    return {c: (r[f"m{i}"], r[f"s{i}"]) for i, c in enumerate(cols)}


def zscore_expr(c: Column, mean, std, thr: float) -> Column:
    """Keep values with |z| < thr, else NULL; std 0 keeps the value (no z defined)."""
    if mean is None or not std:
        return c
    z = F.abs((F.coalesce(c, F.lit(0.0)) - F.lit(mean)) / F.lit(std))
    return F.when(z < thr, c)


def null_zscore(df: DataFrame, cols: list[str], thr: float = 3.0) -> DataFrame:
    st = zscore_stats(df, cols)
    return df.withColumns({c: zscore_expr(_num(c), *st[c], thr) for c in cols})


def impute_values(df: DataFrame, cols: list[str], strategy: str, p: Params = Params(),
                  medians: dict | None = None) -> dict[str, float | None]:
    """C15-C17 fit: median (exact), mean, or most frequent (ties -> smallest) per column.

    Most frequent: counts per (column, value) with a map-side partial aggregation, then the best
    (count desc, value asc) per column - no value -> count map is held by one task.
    """
    if not cols:
        return {}
    if strategy == "median":
        if medians is not None:
            return {c: medians[c] for c in cols}
        qs = column_quantiles(df, cols, [0.5], p.quantiles, p.approx_accuracy)
        return {c: qs[c][0] for c in cols}
    if strategy == "mean":
        r = df.agg(*[F.avg(_num(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        return {c: r[f"m{i}"] for i, c in enumerate(cols)}
    if strategy == "most_frequent":
        items = [F.struct(F.lit(i).alias("c"), _num(c).alias("v")) for i, c in enumerate(cols)]
        long = df.select(F.explode(F.array(*items)).alias("cv")).select("cv.c", "cv.v").where(F.col("v").isNotNull())
        counts = long.groupBy("c", "v").count()
        best = counts.groupBy("c").agg(F.max(F.struct(F.col("count"), (-F.col("v")).alias("nv"))).alias("b"))
        got = {r["c"]: -r["b"]["nv"] for r in best.collect()}
        return {c: got.get(i) for i, c in enumerate(cols)}
    raise ValueError(f"unknown imputation strategy {strategy!r}; use median, mean or most_frequent")


def impute(df: DataFrame, cols: list[str], strategy: str = "median", p: Params = Params()) -> DataFrame:
    fill = impute_values(df, cols, strategy, p)
    return df.withColumns({c: F.coalesce(_num(c), F.lit(fill[c])) for c in cols if fill[c] is not None})


def scaler_stats(df: DataFrame, cols: list[str], method: str, p: Params = Params()) -> dict[str, tuple]:
    """C18-C20 fit: (center, scale) per column. standard: mean, population std; minmax: min, range;
    robust: median, IQR. A zero scale becomes 1."""
    if not cols:
        return {}
    if method == "standard":
        aggs = []
        for i, c in enumerate(cols):
            aggs += [F.avg(_num(c)).alias(f"m{i}"), F.stddev_pop(_num(c)).alias(f"s{i}")]
        r = df.agg(*aggs).first()
        return {c: (r[f"m{i}"], r[f"s{i}"] if r[f"s{i}"] else 1.0) for i, c in enumerate(cols)}
    if method == "minmax":
        aggs = []
        for i, c in enumerate(cols):
            aggs += [F.min(_num(c)).alias(f"lo{i}"), F.max(_num(c)).alias(f"hi{i}")]
        r = df.agg(*aggs).first()
        out = {}
        for i, c in enumerate(cols):
            lo, hi = r[f"lo{i}"], r[f"hi{i}"]
            rng = (hi - lo) if lo is not None else None
            out[c] = (lo, rng if rng else 1.0)
        return out
    if method == "robust":
        qs = column_quantiles(df, cols, [0.25, 0.5, 0.75], p.quantiles, p.approx_accuracy)
        out = {}
        for c in cols:
            q1, q2, q3 = qs[c]
            rng = (q3 - q1) if q1 is not None else None
            out[c] = (q2, rng if rng else 1.0)
        return out
    raise ValueError(f"unknown scaling {method!r}; use standard, minmax or robust")


def scale_expr(c: Column, center, scale) -> Column:
    if center is None:
        return c
    return (c - F.lit(float(center))) / F.lit(float(scale))


def scale(df: DataFrame, cols: list[str], method: str = "standard", p: Params = Params()) -> DataFrame:
    st = scaler_stats(df, cols, method, p)
    return df.withColumns({c: scale_expr(_num(c), *st[c]) for c in cols})


def assign_split(df: DataFrame, key_cols: list[str], p: Params = Params(), stratify: str | None = None,
                 out: str = "split", exact: bool = False) -> DataFrame:
    """Train / val / test from a hash of the key and the seed.

    Plain: bucket = hash % 1000; < 1000*test_size -> test, then the next validation_size share -> val
    (val is validation_size / (1 - test_size) of the rest, as in the original). Stable under
    repartitioning and needs no sort.
    Stratified (`stratify` = label column): per class the cut is an exact order statistic of the hash (any number of
    classes, none on the driver), so each class holds exactly ceil(test_size*n_c) test rows and ceil(val_ratio*rest) val rows. `exact`
    does the same over the whole table (sizes ceil(test_size*n), ceil(val_ratio*rest) as the original).
    """
    test_cut = int(round(1000 * p.test_size))
    val_ratio = p.validation_size / (1 - p.test_size)
    if exact and stratify is None:
        x = df.withColumn("__one", F.lit(1))
        return assign_split(x, key_cols, p, stratify="__one", out=out).drop("__one")
    if stratify is None:
        b = bucket(key_cols, p.seed)
        val_cut = test_cut + int(round(1000 * (1 - p.test_size) * val_ratio))
        return df.withColumn(out, F.when(b < test_cut, "test").when(b < val_cut, "val").otherwise("train"))

    def ranks(n: Column) -> list[Column]:
        n_test = F.ceil(F.lit(float(p.test_size)) * n)
        return [n_test - 1, n_test + F.ceil(F.lit(float(val_ratio)) * (n - n_test)) - 1]

    x = with_cuts(df, _q(stratify), row_hash(key_cols, p.seed), ranks, "__h", "__cuts")
    test, val = (F.coalesce(F.col("__cuts")[i], F.lit(-1)) for i in range(2))
    place = F.when(F.col("__h") <= test, "test").when(F.col("__h") <= val, "val").otherwise("train")
    return x.withColumn(out, place).drop("__h", "__cuts")


# ---------------------------------------------------------------------------------------------------
# the chain

class PrepModel:
    """Fitted preparation: frozen decisions and statistics; `transform` is a projection."""

    def __init__(self, state: dict, encoder: CategoryEncoder, p: Params):
        self.state = state
        self.encoder = encoder
        self.p = p

    @property
    def feature_names(self) -> list[str]:
        return list(self.state["features"])

    @property
    def stats(self) -> dict:
        return dict(self.state["stats"])

    def _features_frame(self, df: DataFrame, outliers: bool, extra=()) -> DataFrame:
        s = self.state
        x = apply_coercion(df, s["coerce"])
        if s["geo"]:
            lat, lon = s["geo"]
            if lat in x.columns and lon in x.columns:
                x = add_geo_features(x, lat, lon)
        x = add_temporal_features(x, s["temporal"])
        x = self.encoder.apply(x)
        cols = {}
        for c in s["features"]:
            v = _num(c) if c in x.columns else F.lit(None).cast("double")   # C24: absent -> NULL
            if outliers and c in s["clip"]:
                v = clip_expr(v, *s["clip"][c][:2])
            if outliers and c in s["zscore"]:
                v = zscore_expr(v, *s["zscore"][c], self.p.outlier_threshold)
            if s["fill"].get(c) is not None:
                v = F.coalesce(v, F.lit(float(s["fill"][c])))
            v = scale_expr(v, *s["scale"][c])
            cols[c] = v
        keep = [k for k in s["keys"] if k in x.columns] + [e for e in extra if e in x.columns]
        label = []
        if s["target"] and s["label_out"] in x.columns:
            lab = _q(s["label_out"])
            if s.get("label_map"):
                # Text labels -> sorted codes (unknown -> NULL)
                lm = F.create_map(*[z for k, v in sorted(s["label_map"].items()) for z in (F.lit(k), F.lit(v))])
                lab = F.try_element_at(lm, lab.cast("string"))
            label = [lab.alias(s["label_out"])]
        return x.select(*[_q(k) for k in keep], *label, *[v.alias(c) for c, v in cols.items()])

    def transform(self, df: DataFrame, outliers: bool | None = None, passthrough=(),
                  prefix: str = "__src_") -> DataFrame:
        """New rows -> key columns, label (when present), features in fitted order. No dedup; outlier
        handling only when `clip_on_transform` (the original applies it at fit only).

        `passthrough` source columns come along unchanged as `<prefix><name>`, so scoring can attach its
        results to the source rows in the same narrow pipeline (no join back on a key)."""
        extra = [f"{prefix}{c}" for c in passthrough]
        x = df.select("*", *[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in passthrough]) if passthrough else df
        if self.state["target"] and self.state["target"] in df.columns:
            x = x.withColumnRenamed(self.state["target"], self.state["label_out"])
        return self._features_frame(x, self.p.clip_on_transform if outliers is None else outliers, extra)

    def fitted_frame(self, df: DataFrame | None = None, with_split: bool = True, stratify: bool = False,
                     exact: bool = False) -> DataFrame:
        """The training frame of the fit: de-duplicated, clipped, imputed, scaled, with the split column.

        Without `df` the de-duplicated rows checkpointed by `fit` are reused (no second dedup shuffle).
        """
        if with_split and self.p.fit_on == "train" and (stratify or exact):
            raise ValueError("fit_on='train' learns from the plain split; stratify and exact would mix its rows")
        base = getattr(self, "_base", None)
        x = base if (df is None and base is not None) else drop_duplicates(nan_to_null(df))
        if self.state["target"] and self.state["target"] in x.columns:
            x = x.withColumnRenamed(self.state["target"], self.state["label_out"])
        keys = [k for k in self.state["keys"] if k in x.columns]
        if with_split and not keys:
            x = _with_row_key(x)
        out = self._features_frame(x, outliers=True, extra=[] if keys else ["__row_key"])
        if with_split:
            label = self.state["label_out"] if (stratify and self.state["target"]) else None
            out = assign_split(out, keys or ["__row_key"], self.p, stratify=label, exact=exact)
        return out.drop("__row_key") if "__row_key" in out.columns else out

    # S6 / S7
    def save(self, path: str) -> int:
        """A new committed version under `path` (`sources.store`); returns its number."""
        return Store(SparkSession.getActiveSession(), path).save(self._write)

    def _write(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        state = dict(self.state)
        state["params"] = {k: v for k, v in self.p.__dict__.items() if k != "weights"}
        state["params"]["weights"] = dict(self.p.weights)
        meta = spark.createDataFrame([(json.dumps(state, default=_json_default),)], "state string")
        meta.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "state"))
        rows = self.encoder.to_rows()
        table = (spark.createDataFrame(rows, "column string, value string, code int") if rows is not None
                 else self.encoder.table)
        table.write.mode("overwrite").parquet(os.path.join(path, "category_map"))

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> "PrepModel":
        path = Store(spark, path).folder(version)
        state = json.loads(spark.read.parquet(os.path.join(path, "state")).first()["state"])
        pd = state.pop("params")
        pd["models"] = tuple(pd.get("models", ()))
        p = Params(**{k: v for k, v in pd.items() if k in Params.__dataclass_fields__})      # settings of older versions are left out
        for k in ("clip", "zscore", "scale"):
            state[k] = {c: tuple(v) for c, v in state[k].items()}
        if state["geo"]:
            state["geo"] = tuple(state["geo"])
        table = spark.read.parquet(os.path.join(path, "category_map"))
        n = table.count()
        if n <= LITERAL_MAP_MAX:
            mapping: dict[str, dict[str, int]] = {c: {} for c in state["categorical"]}
            for r in table.collect():
                mapping.setdefault(r["column"], {})[r["value"]] = r["code"]
            enc = CategoryEncoder(mapping=mapping)
        else:
            enc = CategoryEncoder(table=table, broadcast_max_rows=p.broadcast_max_rows,
                                  broadcast_max_bytes=p.broadcast_max_bytes)
        return cls(state, enc, p)


def _json_default(o):
    if isinstance(o, tuple):
        return list(o)
    raise TypeError(type(o))


def _with_row_key(x: DataFrame) -> DataFrame:
    """No id: rows are distinct after the dedup, so their content is a key."""
    return x.withColumn("__row_key", F.md5(F.to_json(F.struct(*[_q(c) for c in x.columns]))))


def _split_rows(base: DataFrame, target: str | None, label_out: str, keys: list[str], p: Params) -> DataFrame:
    """The rows with the plain split of `fitted_frame` as `__split`."""
    keys = [k for k in keys if k in base.columns]
    if keys:
        return assign_split(base, keys, p, out="__split")
    x = _with_row_key(base.withColumnRenamed(target, label_out) if target else base)
    x = assign_split(x, ["__row_key"], p, out="__split")
    return x.withColumnRenamed(label_out, target) if target else x


class Prep:
    """Fit the whole chain."""

    def __init__(self, p: Params = Params()):
        if p.outlier_method not in ("iqr", "zscore", "none"):
            raise ValueError(f"unknown outlier method {p.outlier_method!r}; use iqr, zscore or none")
        if p.scaling not in ("standard", "minmax", "robust"):
            raise ValueError(f"unknown scaling {p.scaling!r}; use standard, minmax or robust")
        if p.imputation not in ("median", "mean", "most_frequent"):
            raise ValueError(f"unknown imputation {p.imputation!r}")
        if p.fit_on not in ("all", "train"):
            raise ValueError(f"unknown fit_on {p.fit_on!r}; use all or train")
        self.p = p

    def fit(self, df: DataFrame, target: str | None = None, keys: list[str] | tuple = (),
            label_out: str = "label") -> PrepModel:
        p = self.p
        keys = list(keys)
        lowered = [c.lower() for c in df.columns]
        if len(set(lowered)) != len(lowered):
            raise ValueError("column names that differ only in case are not supported")
        # C1 dedup, checkpointed: every later pass reads it
        base = cut_lineage(drop_duplicates(nan_to_null(df)))
        # C2 target
        target = target if (target and target in base.columns) else None
        label_map = None
        if target and isinstance(base.schema[target].dataType, T.StringType):
            values = _class_values(base, target)
            label_map = {v: i for i, v in enumerate(values)}        # bounded by the class count
        rows = base
        if p.fit_on == "train":       # D8: everything below is learnt from the rows that fitted_frame() calls train
            rows = _split_rows(base, target, label_out, keys, p)
            rows = cut_lineage(rows.where(F.col("__split") == "train").select(*[_q(c) for c in base.columns]))
        x = rows.drop(target) if target else rows
        cand = [c for c in x.columns if c not in keys]
        # pass 1: constants + numeric coercion, one aggregate; then time formats
        fields = {f.name: f.dataType for f in x.schema.fields}
        strings = [c for c in cand if isinstance(fields[c], T.StringType)]
        orderable = [c for c in cand if not isinstance(fields[c], (T.ArrayType, T.MapType, T.StructType))]
        aggs = [F.count("*").alias("__rows")]
        aggs += [F.min(_q(c)).eqNullSafe(F.max(_q(c))).alias(f"k{i}") for i, c in enumerate(orderable)]
        for i, c in enumerate(strings):
            aggs += [F.count_if(_q(c).isNotNull() & ~_q(c).rlike(NUMBER_RE)).alias(f"bad{i}"),
                     F.count_if(_q(c).isNotNull() & ~_is_long(_q(c))).alias(f"nonint{i}"),
                     F.count(_q(c)).alias(f"nn{i}")]
        r = x.agg(*aggs).first()
        n_rows = r["__rows"]
        constant = [c for i, c in enumerate(orderable) if r[f"k{i}"]]
        cand = [c for c in cand if c not in constant]
        coerce = {}
        temporal: dict[str, str | None] = {}
        for i, c in enumerate(strings):
            if c in constant:
                continue
            if r[f"bad{i}"] == 0:
                coerce[c] = "bigint" if r[f"nonint{i}"] == 0 else "double"
                continue
        if p.temporal_features:
            temporal.update(induce(x, [c for c in strings if c not in constant and c not in coerce]))
            for c in cand:
                if isinstance(fields[c], _TIME):
                    temporal[c] = None
        x = apply_coercion(x.drop(*constant), coerce)
        # C5-C7
        geo = None
        if p.geo_features:
            lat, lon = infer_coords([c for c in x.columns if c not in keys])
            if lat and lon:
                geo = (lat, lon)
                x = add_geo_features(x, lat, lon)
        # C8-C9
        x = add_temporal_features(x, temporal)
        # C10-C11
        types = dict(x.dtypes)
        categorical = [c for c in x.columns if c not in keys and types[c] == "string"]
        encoder = CategoryEncoder.fit(x, categorical, p)
        x = encoder.apply(x)
        # C12 numeric only (bool is not numeric)
        num_fields = [f.name for f in x.schema.fields
                      if f.name not in keys and isinstance(f.dataType, _NUMERIC)]
        x = x.select(*[_q(k) for k in keys], *[_q(c).cast("double").alias(c) for c in num_fields])
        # pass 3: outliers
        clip: dict[str, tuple] = {}
        zs: dict[str, tuple] = {}
        medians = None
        nonnull = None
        if p.outlier_method == "iqr":
            b, nonnull = iqr_bounds(x, num_fields, p, with_counts=True)
            clip = {c: v[:2] for c, v in b.items() if v[0] is not None}
            medians = {c: v[3] for c, v in b.items()}
            handled = x.withColumns({c: clip_expr(_q(c), *clip[c]) for c in clip})
        elif p.outlier_method == "zscore":
            zs = zscore_stats(x, num_fields)
            handled = x.withColumns({c: zscore_expr(_q(c), *zs[c], p.outlier_threshold) for c in num_fields})
        else:
            handled = x
        # P11 (before imputation) and D10: all-NULL columns leave the feature list
        if nonnull is None:       # clipping keeps NULLs as they are; the z-score rule makes new ones
            miss = handled.agg(*[F.count(_q(c)).alias(f"c{i}") for i, c in enumerate(num_fields)]).first() \
                if num_fields else None
            nonnull = {c: miss[f"c{i}"] for i, c in enumerate(num_fields)} if miss else {}
        features = [c for c in num_fields if nonnull.get(c, 0) > 0]
        missing_pct = (sum(1.0 - nonnull[c] / n_rows for c in num_fields) / len(num_fields) * 100.0
                       if num_fields and n_rows else 0.0)
        # pass 4: imputation
        fill = impute_values(handled, features, p.imputation, p,
                             medians if (p.imputation == "median" and medians is not None) else None)
        imputed = handled.withColumns({c: F.coalesce(_q(c), F.lit(float(fill[c]))) for c in features
                                       if fill.get(c) is not None})
        # pass 5: scaler
        sc = scaler_stats(imputed, features, p.scaling, p)
        stats = {"n_rows": n_rows, "n_features": len(features), "missing_pct": missing_pct}
        if target:
            # a share a class is for class labels; a target with more values than those has none
            dist = rows.groupBy(_q(target)).count().limit(MAX_CLASSES + 1).collect()
            if len(dist) <= MAX_CLASSES:
                stats["class_distribution"] = {str(rr[0]): rr[1] / n_rows for rr in dist}
        state = {
            "keys": keys, "target": target, "label_out": label_out, "constant": constant, "coerce": coerce,
            "geo": geo, "temporal": temporal, "categorical": categorical, "features": features,
            "clip": clip if p.outlier_method == "iqr" else {}, "zscore": zs, "fill": fill, "scale": sc,
            "stats": stats, "label_map": label_map,
        }
        model = PrepModel(state, encoder, p)
        model._base = base            # the checkpointed de-duplicated rows, for fitted_frame()
        return model


def prep_stats_frame(spark: SparkSession, model: PrepModel) -> DataFrame:
    """P11 as a one-row frame."""
    s = model.stats
    return spark.createDataFrame([(int(s["n_rows"]), int(s["n_features"]), float(s["missing_pct"]))],
                                 "n_rows long, n_features int, missing_pct double")
