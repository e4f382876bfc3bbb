"""Risk engine: min-max normalisation, composite score, levels, summary.

Global statistics (min, max) are one aggregate whose single row is broadcast to the rows
(`crossJoin(broadcast(1-row))`): never a window without keys, which would pull all rows into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskflow.functions.levels import clip01, known, risk_level
from riskflow.functions.quantiles import column_quantiles
from riskflow.operators.density import DensityField, attach_log_density, distinct_points, log_density_points
from riskflow.params import Params
from riskflow.session import cut_lineage


def _norm(x: Column, lo: Column, hi: Column) -> Column:
    """R2 rule: (x - min) / (max - min); all equal -> 0; a missing x stays NULL."""
    return F.when(x.isNull(), x).when(hi == lo, F.lit(0.0)).otherwise((x - lo) / (hi - lo))


def minmax(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """R2 on one column; NULL and NaN are missing: they count for no bound and have no value."""
    out = out or f"{col}_norm"
    stats = df.agg(F.min(known(col)).alias("__lo"), F.max(known(col)).alias("__hi"))
    return (df.crossJoin(F.broadcast(stats))
              .withColumn(out, _norm(known(col), F.col("__lo"), F.col("__hi")))
              .drop("__lo", "__hi"))


def time_ns(c: str, dtype: str) -> Column:
    """Epoch nanoseconds as double (timestamps carry microseconds)."""
    x = F.col(c)
    if dtype == "timestamp_ntz":
        x = x.cast("timestamp")
    elif dtype not in ("timestamp", "date"):
        x = F.try_to_timestamp(x.cast("string"))
    elif dtype == "date":
        x = x.cast("timestamp")
    return (F.unix_micros(x) * F.lit(1000)).cast("double")


def spatial_density(df: DataFrame, lat: str, lon: str, p: Params = Params(), out: str = "spatial_density") -> DataFrame:
    """`df` plus the min-max normalised log kernel density at each row's coordinates."""
    dens, n_points = log_density_points(df, lat, lon, p)
    dens = cut_lineage(dens)
    st = dens.agg(F.min("log_density").alias("__lo"), F.max("log_density").alias("__hi"))
    x = attach_log_density(df, dens, n_points, lat, lon, p, "__ld").crossJoin(F.broadcast(st))
    return x.withColumn(out, _norm(F.col("__ld"), F.col("__lo"), F.col("__hi"))).drop("__ld", "__lo", "__hi")


def recency(df: DataFrame, ts: str, out: str = "recency") -> DataFrame:
    """Linear recency (t - t_min) / (t_max - t_min + 1e-9) in nanoseconds; text that does not parse
    gives 0.5 for every row; a row without a time gives 0."""
    dtype = dict(df.dtypes)[ts]
    t = time_ns(ts, dtype)
    aggs = [F.min(t).alias("__lo"), F.max(t).alias("__hi")]
    text = dtype not in ("timestamp", "timestamp_ntz", "date")
    if text:
        aggs.append(F.count_if(F.col(ts).isNotNull() & t.isNull()).alias("__bad"))
    x = df.crossJoin(F.broadcast(df.agg(*aggs)))
    rec = F.coalesce((t - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + F.lit(1e-9)), F.lit(0.0))
    if text:
        rec = F.when(F.col("__bad") > 0, F.lit(0.5)).otherwise(rec)
    return x.withColumn(out, rec).drop(*[c for c in ("__lo", "__hi", "__bad") if c in x.columns])


def composite_risk(df: DataFrame, prob: str, anomaly: str | None = None, lat: str | None = None,
                   lon: str | None = None, ts: str | None = None, p: Params = Params(),
                   keep_parts: bool = False, bounds: dict | None = None, field: DensityField | None = None) -> DataFrame:
    """`df` plus model_prob, risk_score, risk_level (and the parts when `keep_parts`).

    s = w_m*clip(p) + w_a*A + w_s*D, where A = minmax(-anomaly) or clip(p) without scores and
    D = minmax(log density) or clip(p) without coordinates; with times s *= 1 + w_t*T with
    T = (t - t_min) / (t_max - t_min + 1e-9) in nanoseconds; finally clip to [0, 1].
    `bounds` freezes the min/max and `field` the density's sources (both from `fitted_bounds`), for scoring new rows or a
    stream against the fitted table: such parts are clipped to [0, 1]. A row without coordinates, or without an anomaly
    score (NULL or NaN), moves that part's weight to the model, as a table without them does; a row without a model
    probability has no risk and no level.
    """
    if bounds and lat and lon and field is None:
        raise ValueError("frozen bounds need the fitted density field as well")
    w = p.norm_weights()
    types = dict(df.dtypes)
    x = df.withColumn("model_prob", clip01(prob))
    m = F.col("model_prob")
    row_aggs, stat_cols = [], []
    if anomaly:
        x = x.withColumn("__a", -known(anomaly))
        row_aggs += [F.min("__a").alias("__a_lo"), F.max("__a").alias("__a_hi")]
    if ts:
        x = x.withColumn("__t", time_ns(ts, types[ts]))
        row_aggs += [F.min("__t").alias("__t_lo"), F.max("__t").alias("__t_hi")]
        if types[ts] not in ("timestamp", "timestamp_ntz", "date"):
            row_aggs.append(F.count_if(F.col(ts).isNotNull() & F.col("__t").isNull()).alias("__t_bad"))
    geo = bool(lat and lon)
    if geo:
        dens, n_points = log_density_points(df, lat, lon, p, field)
        # the sums feed both the rows and their min/max: compute them once
        dens = cut_lineage(dens)
        dstats = dens.agg(F.min("log_density").alias("__d_lo"), F.max("log_density").alias("__d_hi"))
        x = attach_log_density(x, dens, n_points, lat, lon, p, "__ld")
    if bounds:
        stats = x.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(k) for k, v in bounds.items()])
        if "__t" in x.columns and types[ts] not in ("timestamp", "timestamp_ntz", "date"):
            bad = df.agg(F.count_if(F.col(ts).isNotNull() & time_ns(ts, types[ts]).isNull()).alias("__t_bad"))
            stats = stats.crossJoin(bad)
    else:
        stats = None
        if row_aggs:
            # min/max over the source rows only: the density join is not evaluated twice
            cols = []
            if anomaly:
                cols.append((-known(anomaly)).alias("__a"))
            if ts:
                cols += [time_ns(ts, types[ts]).alias("__t"), F.col(ts)]
            stats = df.select(*cols).agg(*row_aggs)
        if geo:
            stats = dstats if stats is None else stats.crossJoin(dstats)
    if stats is not None:
        x = x.crossJoin(F.broadcast(stats))
    def part(c):
        return F.when(c.isNull(), m).otherwise(clip01(c) if bounds else c)
    a = part(_norm(F.col("__a"), F.col("__a_lo"), F.col("__a_hi"))) if anomaly else m
    d = part(_norm(F.col("__ld"), F.col("__d_lo"), F.col("__d_hi"))) if geo else m
    x = x.withColumn("anomaly_part", a).withColumn("spatial_density", d)
    s = (F.lit(w["model_score"]) * m + F.lit(w["anomaly_score"]) * F.col("anomaly_part")
         + F.lit(w["spatial_density"]) * F.col("spatial_density"))
    if ts:
        rec = F.coalesce((F.col("__t") - F.col("__t_lo")) / (F.col("__t_hi") - F.col("__t_lo") + F.lit(1e-9)),
                         F.lit(0.0))
        if "__t_bad" in (stats.columns if stats is not None else []):
            rec = F.when(F.col("__t_bad") > 0, F.lit(0.5)).otherwise(rec)
        x = x.withColumn("recency", rec)
        s = s * (F.lit(1.0) + F.lit(w["temporal_weight"]) * F.col("recency"))
    x = x.withColumn("risk_score", clip01(s)).withColumn("risk_level", risk_level("risk_score", p.level_low_max,
                                                                                    p.level_medium_max))
    drop = [c for c in x.columns if c.startswith("__")]
    if not keep_parts:
        drop += [c for c in ("anomaly_part", "spatial_density", "recency") if c in x.columns]
    return x.drop(*drop)


def fitted_bounds(df: DataFrame, anomaly: str | None = None, lat: str | None = None, lon: str | None = None,
                  ts: str | None = None, p: Params = Params()) -> tuple[dict, DensityField | None]:
    """The min/max a composite uses, as literals, and the density's sources (to score new rows against a fitted table)."""
    types = dict(df.dtypes)
    aggs = []
    if anomaly:
        aggs += [F.min(-known(anomaly)).alias("__a_lo"), F.max(-known(anomaly)).alias("__a_hi")]
    if ts:
        t = time_ns(ts, types[ts])
        aggs += [F.min(t).alias("__t_lo"), F.max(t).alias("__t_hi")]
    out = df.agg(*aggs).first().asDict() if aggs else {}
    field = None
    if lat and lon:
        pts = distinct_points(df, lat, lon)
        field = DensityField.fit(pts, p)
        dens = cut_lineage(field.log_density(pts))
        out.update(dens.agg(F.min("log_density").alias("__d_lo"), F.max("log_density").alias("__d_hi")).first().asDict())
    return out, field


def risk_summary(df: DataFrame, score: str = "risk_score", p: Params = Params()) -> DataFrame:
    """One row - n, mean, median, max, min, population std, per-level counts and % (1 decimal, present
    levels only, else NULL), count and % of scores >= medium_max."""
    lv = risk_level(score, p.level_low_max, p.level_medium_max)
    # the scores feed several jobs (quantile passes + the summary): cut the lineage once
    df = cut_lineage(df.select(known(score).alias(score)))
    med = column_quantiles(df, [score], [0.5], p.quantiles, p.approx_accuracy)[score][0]
    n = F.count(F.col(score))
    aggs = [n.alias("n_samples"), F.avg(score).alias("mean_risk"), F.lit(med).cast("double").alias("median_risk"),
            F.max(score).cast("double").alias("max_risk"), F.min(score).cast("double").alias("min_risk"),
            F.stddev_pop(score).alias("std_risk")]
    for level in ("low", "medium", "high"):
        c = F.count_if(lv == level)
        aggs.append(F.when(c > 0, c).alias(f"n_{level}"))
        aggs.append(F.when(c > 0, F.round(F.try_divide(c, n) * 100.0, 1)).alias(f"pct_{level}"))
    hi = F.count_if(F.col(score) >= p.level_medium_max)
    aggs += [hi.alias("high_risk_count"), (F.try_divide(hi, n) * 100.0).alias("high_risk_pct")]
    return df.agg(*aggs)


def score_frame(df: DataFrame, prob: str, anomaly: str | None = None, flag: str | None = None,
                lat: str | None = None, lon: str | None = None, ts: str | None = None,
                p: Params = Params()) -> DataFrame:
    """The source columns plus model_prob, risk_score, risk_level, anomaly_flag."""
    out = composite_risk(df, prob, anomaly, lat, lon, ts, p)
    return out.withColumn("anomaly_flag", F.col(flag).cast("boolean") if flag else F.lit(False))
