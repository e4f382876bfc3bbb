"""Profiling and validation (P1-P11). Each is one aggregate pass whose result is bounded by the number of
columns or classes; nothing row-level reaches the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskflow.params import LAT_NAMES, LON_NAMES, TARGET_NAMES

_ORDERABLE = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType,
              T.BinaryType)


def missing(c: str, dtype: T.DataType) -> Column:
    """Missing = NULL, or NaN for floating columns (one concept, as in pandas)."""
    x = F.col(f"`{c}`")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return x.isNull() | F.isnan(x)
    return x.isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in floating columns (done at ingest: Spark counts NaN as a value)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def profile_schema(df: DataFrame) -> DataFrame:
    """One row per column: position, name, Spark type, and the table shape (rows, columns)."""
    spark = df.sparkSession
    meta = spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
                                 "position int, column_name string, dtype string")
    shape = df.agg(F.count("*").alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))
    return meta.crossJoin(F.broadcast(shape))


def profile_missing(df: DataFrame, digits: int = 4) -> DataFrame:
    """Share of missing values per column, rounded; one aggregate, then unpivoted."""
    aggs = [F.avg(missing(f.name, f.dataType).cast("double")).alias(f"m{i}") for i, f in enumerate(df.schema.fields)]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{f.name.replace(chr(39), chr(39) * 2)}', m{i}" for i, f in enumerate(df.schema.fields))
    return (wide.selectExpr(f"stack({len(df.columns)}, {pairs}) as (column_name, missing_pct)")
                .withColumn("missing_pct", F.round("missing_pct", digits)))


def preview(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """The first n rows by a key, values as text with NULL shown as ''."""
    ordered = df.orderBy(*[F.col(f"`{c}`") for c in order_by or df.columns[:1]]).limit(n)
    return ordered.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def constant_flags(df: DataFrame) -> DataFrame:
    """One row per column, is_constant = at most one distinct non-null value.

    min <=> max in one pass (an all-NULL column counts as constant), no distinct shuffle.
    """
    fields = [f for f in df.schema.fields if isinstance(f.dataType, _ORDERABLE)]
    aggs = []
    for i, f in enumerate(fields):
        aggs.append(F.min(F.col(f"`{f.name}`")).eqNullSafe(F.max(F.col(f"`{f.name}`"))).alias(f"k{i}"))
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{f.name.replace(chr(39), chr(39) * 2)}', k{i}" for i, f in enumerate(fields))
    return wide.selectExpr(f"stack({len(fields)}, {pairs}) as (column_name, is_constant)")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row (NULLs equal). Group on all columns; the partial aggregation
    collapses a hot duplicated row before the shuffle."""
    g = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).count()
    return g.agg(F.sum("count").alias("n_rows"), F.count("*").alias("n_distinct")).select(
        F.col("n_rows").cast("long").alias("n_rows"), F.col("n_distinct").cast("long").alias("n_distinct"),
        (F.col("n_rows") - F.col("n_distinct")).cast("long").alias("n_duplicates"))


def validate(df: DataFrame, min_rows: int = 10) -> DataFrame:
    """One row per issue found - (issue, n, columns).

    issue: empty | too_few_rows | high_missing (> 50 %) | duplicates | constant. `empty` stops the checks.
    Columns are listed in table order, comma separated.
    """
    fields = df.schema.fields
    aggs = [F.count("*").alias("__n")]
    for i, f in enumerate(fields):
        aggs.append(F.avg(missing(f.name, f.dataType).cast("double")).alias(f"__m{i}"))
        if isinstance(f.dataType, _ORDERABLE):
            aggs.append(F.min(F.col(f"`{f.name}`")).eqNullSafe(F.max(F.col(f"`{f.name}`"))).alias(f"__k{i}"))
    wide = df.agg(*aggs).crossJoin(F.broadcast(duplicate_count(df).select("n_duplicates")))
    n = F.col("__n")
    high = [F.when(F.col(f"__m{i}") > 0.5, F.lit(f.name)) for i, f in enumerate(fields)]
    const = [F.when(F.col(f"__k{i}"), F.lit(f.name)) for i, f in enumerate(fields) if f"__k{i}" in wide.columns]
    n_high = sum((F.col(f"__m{i}") > 0.5).cast("long") for i in range(len(fields)))
    n_const = sum(F.col(f"__k{i}").cast("long") for i, f in enumerate(fields) if f"__k{i}" in wide.columns)
    def issue(name, count, cols, hit):
        return F.struct(F.lit(name).alias("issue"), count.cast("long").alias("n"),
                        cols.cast("string").alias("columns"), hit.alias("hit"))

    none = F.lit(None).cast("string")
    rows = F.array(
        issue("empty", n, none, n == 0),
        issue("too_few_rows", n, none, (n > 0) & (n < min_rows)),
        issue("high_missing", n_high, F.concat_ws(",", *high), (n > 0) & (n_high > 0)),
        issue("duplicates", F.col("n_duplicates"), none, (n > 0) & (F.col("n_duplicates") > 0)),
        issue("constant", n_const, F.concat_ws(",", *const), (n > 0) & (n_const > 0)),
    )
    return (wide.select(F.explode(rows).alias("r"))
                .where("r.hit").select("r.issue", F.col("r.n").cast("long").alias("n"), "r.columns"))


def _names(columns) -> list[str]:
    return list(columns.columns) if isinstance(columns, DataFrame) else list(columns)


def infer_target(columns) -> str | None:
    """First column, in table order, whose lower-cased name is a target name (a DataFrame or names)."""
    return next((c for c in _names(columns) if c.lower() in TARGET_NAMES), None)


def infer_coords(columns, target: str | None = None) -> tuple[str | None, str | None]:
    """First latitude-like and longitude-like columns in table order; the target is taken off first."""
    cols = [c for c in _names(columns) if c != target]
    lat = next((c for c in cols if c.lower() in LAT_NAMES), None)
    lon = next((c for c in cols if c.lower() in LON_NAMES), None)
    return lat, lon


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """P10: (label, n, share) per label value; NULL labels are a class of their own, as counted rows."""
    counts = df.groupBy(F.col(f"`{label}`").alias("label")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("__total"))
    return (counts.crossJoin(F.broadcast(total))
                  .select("label", "n", (F.col("n") / F.col("__total")).alias("share")))


def profile(df: DataFrame, n_sample: int = 5, order_by: list[str] | None = None) -> dict[str, DataFrame]:
    """P1-P3 together: schema with shape, missing share per column, and the head sample."""
    return {"schema": profile_schema(df), "missing": profile_missing(df), "sample": preview(df, n_sample, order_by)}
