"""Risk engine queries (R2-R9) over `scored_events` (a fixed linear score stands in for a model)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow.operators.risk import composite_risk, fitted_bounds, minmax, recency, risk_summary, score_frame
from riskflow.params import Params
from riskflow.plans.fixtures import frame, with_frames
from riskflow.plans.registry import DIGITS, query
from riskflow.session import configure

P = Params()
_W = P.norm_weights()
WM, WA, WS, WT = (repr(_W[k]) for k in ("model_score", "anomaly_score", "spatial_density", "temporal_weight"))
H2 = repr(2.0 * P.kde_bandwidth * P.kde_bandwidth)


def _scored(spark, sf_dir):
    configure(spark)
    return frame(spark, sf_dir, "scored_events")


def r9(c):
    return F.round(c, DIGITS)


# DuckDB text of the exact density (all pairs of distinct points) and of the composite.
_DENS = f"""
pts as (select latitude, longitude, count(*) as w from scored_events
        where latitude is not null and longitude is not null group by latitude, longitude),
dens as (select a.latitude, a.longitude,
           ln(sum(b.w * exp(-((a.latitude-b.latitude)*(a.latitude-b.latitude)
                              + (a.longitude-b.longitude)*(a.longitude-b.longitude)) / {H2}))) as ld
         from pts a, pts b
         group by a.latitude, a.longitude)"""

_PARTS = _DENS + """,
x as (select s.*, d.ld, -anomaly_score as a, (epoch_us(ts) * 1000)::double as t
      from scored_events s left join dens d using (latitude, longitude)),
st as (select min(a) as a_lo, max(a) as a_hi, min(ld) as d_lo, max(ld) as d_hi, min(t) as t_lo, max(t) as t_hi
       from x),
y as (select x.*, least(greatest(model_prob, 0e0), 1e0) as m,
        case when a_hi = a_lo then 0e0 else (a - a_lo) / (a_hi - a_lo) end as an,
        case when d_hi = d_lo then 0e0 else (ld - d_lo) / (d_hi - d_lo) end as dn,
        coalesce((t - t_lo) / (t_hi - t_lo + 1e-9), 0e0) as rec
      from x, st)"""

_LEVEL = """case when {s} is null then null when {s} >= 0 and {s} < 0.33 then 'low'
  when {s} >= 0.33 and {s} < 0.66 then 'medium' else 'high' end"""

_COMPOSITE = _PARTS + f""",
z as (select *, least(greatest(({WM}*m + {WA}*an + {WS}*dn) * (1e0 + {WT}*rec), 0e0), 1e0) as risk from y)"""


def _composite(spark, sf_dir):
    return composite_risk(_scored(spark, sf_dir), "model_prob", "anomaly_score", "latitude", "longitude", "ts", P,
                          keep_parts=True)


@query("minmax_norm", with_frames(["scored_events"], """
select event_id, round(case when mx = mn then 0e0 else (-anomaly_score - mn) / (mx - mn) end, 6) as anomaly_norm
from scored_events, (select min(-anomaly_score) as mn, max(-anomaly_score) as mx from scored_events)"""))
def q_minmax_norm(spark, sf_dir):
    df = _scored(spark, sf_dir).withColumn("neg_anomaly", -F.col("anomaly_score"))
    return minmax(df, "neg_anomaly", "anomaly_norm").select("event_id", r9(F.col("anomaly_norm")).alias("anomaly_norm"))


@query("spatial_density", with_frames(["scored_events"], "with " + _PARTS.strip() + """
select event_id, round(dn, 6) as spatial_density from y""").replace("\nwith ", ",\n", 1))
def q_spatial_density(spark, sf_dir):
    return _composite(spark, sf_dir).select("event_id", r9(F.col("spatial_density")).alias("spatial_density"))


@query("recency", with_frames(["scored_events"], "with " + _PARTS.strip() + """
select event_id, round(rec, 6) as recency from y""").replace("\nwith ", ",\n", 1))
def q_recency(spark, sf_dir):
    return recency(_scored(spark, sf_dir), "ts").select("event_id", r9(F.col("recency")).alias("recency"))


@query("score_frame", with_frames(["scored_events"], "with " + _COMPOSITE.strip() + f"""
select event_id, round(m, 6) as model_prob, round(risk, 6) as risk_score, {_LEVEL.format(s='risk')} as risk_level,
       prediction = 1 as anomaly_flag
from z""").replace("\nwith ", ",\n", 1))
def q_score_frame(spark, sf_dir):
    """The scored table with its flag."""
    out = score_frame(_scored(spark, sf_dir), "model_prob", "anomaly_score", "prediction", "latitude", "longitude", "ts", P)
    return out.select("event_id", r9(F.col("model_prob")).alias("model_prob"), r9(F.col("risk_score")).alias("risk_score"),
                      "risk_level", "anomaly_flag")


@query("frozen_scoring", with_frames(["scored_events"], "with " + _COMPOSITE.strip() + f"""
select event_id, round(risk, 6) as risk_score, {_LEVEL.format(s='risk')} as risk_level from z
where category = 'click'""").replace("\nwith ", ",\n", 1))
def q_frozen_scoring(spark, sf_dir):
    """One event type scored alone against bounds and density field of the whole table, as a stream's batch is."""
    rows = _scored(spark, sf_dir)
    bounds, field = fitted_bounds(rows, "anomaly_score", "latitude", "longitude", "ts", P)
    out = composite_risk(rows.where("category = 'click'"), "model_prob", "anomaly_score", "latitude", "longitude", "ts", P,
                         bounds=bounds, field=field)
    return out.select("event_id", r9(F.col("risk_score")).alias("risk_score"), "risk_level")


@query("composite_risk", with_frames(["scored_events"], "with " + _COMPOSITE.strip() + f"""
select event_id, round(m, 6) as model_prob, round(risk, 6) as risk_score, {_LEVEL.format(s='risk')} as risk_level
from z""").replace("\nwith ", ",\n", 1))
def q_composite_risk(spark, sf_dir):
    return _composite(spark, sf_dir).select("event_id", r9(F.col("model_prob")).alias("model_prob"),
                                            r9(F.col("risk_score")).alias("risk_score"), "risk_level")


@query("composite_stream", with_frames(["scored_events"], "with " + _COMPOSITE.strip() + f"""
select event_id, round(m, 6) as model_prob, round(risk, 6) as risk_score, {_LEVEL.format(s='risk')} as risk_level
from z""").replace("\nwith ", ",\n", 1))
def q_composite_stream(spark, sf_dir):
    """The scored events land as three files, the last one after the stream has stopped; each is a micro-batch scored
    against the bounds and the density field of the whole table, and the restarted stream goes on where it was."""
    from riskflow.session import scratch_path
    from riskflow.streaming.score_stream import composite_stream, file_stream, read_scored
    rows = _scored(spark, sf_dir)
    bounds, field = fitted_bounds(rows, "anomaly_score", "latitude", "longitude", "ts", P)
    landing, sink, checkpoint = (scratch_path(spark, f"composite-{x}") for x in ("landing", "sink", "checkpoint"))

    def land(part: int) -> None:
        rows.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(landing)

    def run() -> None:
        stream = file_stream(spark, landing, rows.schema)
        composite_stream(stream, sink, "model_prob", "anomaly_score", "latitude", "longitude", "ts", P, bounds, field,
                         checkpoint=checkpoint).awaitTermination()
    land(0)
    land(1)
    run()
    land(2)
    run()
    return read_scored(spark, sink).select("event_id", r9(F.col("model_prob")).alias("model_prob"), r9(F.col("risk_score")).alias("risk_score"), "risk_level")


@query("composite_missing_parts", with_frames(["scored_events"], f"""
select event_id, round(r, 6) as risk_score, {_LEVEL.format(s='r')} as risk_level from (
  select event_id, least(greatest({WM}*m + {WA}*m + {WS}*m, 0e0), 1e0) as r
  from (select event_id, least(greatest(model_prob, 0e0), 1e0) as m from scored_events))"""))
def q_composite_missing_parts(spark, sf_dir):
    out = composite_risk(_scored(spark, sf_dir), "model_prob", p=P)
    return out.select("event_id", r9(F.col("risk_score")).alias("risk_score"), "risk_level")


# Parts that are missing: NULL and NaN probabilities, anomaly scores and coordinates, by fixed rules on the event id.
_GAPS = """
gaps as (
  select event_id, ts, case when event_id % 11 = 3 then null when event_id % 13 = 5 then 'nan'::double else model_prob end as model_prob,
    case when event_id % 7 = 2 then null when event_id % 17 = 4 then 'nan'::double else anomaly_score end as anomaly_score,
    case when event_id % 19 = 6 then null when event_id % 23 = 8 then 'nan'::double else latitude end as latitude,
    case when event_id % 29 = 9 then null else longitude end as longitude
  from scored_events),
known as (
  select event_id, ts, case when not isnan(model_prob) then least(greatest(model_prob, 0e0), 1e0) end as m,
    case when not isnan(anomaly_score) then -anomaly_score end as a, case when not isnan(latitude) then latitude end as la, longitude as lo
  from gaps)"""
_GAPS_SQL = f"""with {_GAPS.strip()},
pts as (select la, lo, count(*) as w from known where la is not null and lo is not null group by la, lo),
dens as (select x.la, x.lo, ln(sum(y.w * exp(-((x.la-y.la)*(x.la-y.la) + (x.lo-y.lo)*(x.lo-y.lo)) / {H2}))) as ld
         from pts x, pts y group by x.la, x.lo),
x as (select k.*, d.ld, (epoch_us(ts) * 1000)::double as t from known k left join dens d using (la, lo)),
st as (select min(a) as a_lo, max(a) as a_hi, min(ld) as d_lo, max(ld) as d_hi, min(t) as t_lo, max(t) as t_hi from x),
y as (select event_id, m, coalesce((a - a_lo) / (a_hi - a_lo), m) as an, coalesce((ld - d_lo) / (d_hi - d_lo), m) as dn,
        coalesce((t - t_lo) / (t_hi - t_lo + 1e-9), 0e0) as rec from x, st),
z as (select *, case when m is not null then least(greatest(({WM}*m + {WA}*an + {WS}*dn) * (1e0 + {WT}*rec), 0e0), 1e0) end as risk from y)
select event_id, round(m, 6) as model_prob, round(risk, 6) as risk_score, {_LEVEL.format(s='risk')} as risk_level from z"""


@query("composite_gaps", with_frames(["scored_events"], _GAPS_SQL).replace("\nwith ", ",\n", 1))
def q_composite_gaps(spark, sf_dir):
    """R2-R8 over rows with NULL and NaN in probability, anomaly score and coordinates."""
    def gap(c, null, nan=None):
        x = F.when(F.col("event_id") % null[0] == null[1], F.lit(None).cast("double"))
        return (x.when(F.col("event_id") % nan[0] == nan[1], F.lit(float("nan"))) if nan else x).otherwise(F.col(c)).alias(c)
    df = _scored(spark, sf_dir).select("event_id", "ts", gap("model_prob", (11, 3), (13, 5)), gap("anomaly_score", (7, 2), (17, 4)),
                                       gap("latitude", (19, 6), (23, 8)), gap("longitude", (29, 9)))
    out = composite_risk(df, "model_prob", "anomaly_score", "latitude", "longitude", "ts", P)
    return out.select("event_id", r9(F.col("model_prob")).alias("model_prob"), r9(F.col("risk_score")).alias("risk_score"), "risk_level")


@query("risk_levels", with_frames(["scored_events"], "with " + _COMPOSITE.strip() + f"""
select {_LEVEL.format(s='risk')} as risk_level, count(*) as n, round(avg(risk), 6) as mean_risk
from z group by 1""").replace("\nwith ", ",\n", 1))
def q_risk_levels(spark, sf_dir):
    return (_composite(spark, sf_dir).groupBy("risk_level")
            .agg(F.count("*").alias("n"), r9(F.avg("risk_score")).alias("mean_risk")))


_SUMMARY_SQL = "with " + _COMPOSITE.strip() + f""",
lv as (select risk, {_LEVEL.format(s='risk')} as level from z)
select count(risk) as n_samples, round(avg(risk), 6) as mean_risk, round(median(risk), 6) as median_risk,
  round(max(risk), 6) as max_risk, round(min(risk), 6) as min_risk, round(stddev_pop(risk), 6) as std_risk,
  nullif(count_if(level = 'low'), 0)::bigint as n_low,
  case when count_if(level = 'low') > 0 then round(count_if(level = 'low') / count(risk) * 100e0, 1) end as pct_low,
  nullif(count_if(level = 'medium'), 0)::bigint as n_medium,
  case when count_if(level = 'medium') > 0 then round(count_if(level = 'medium') / count(risk) * 100e0, 1) end
    as pct_medium,
  nullif(count_if(level = 'high'), 0)::bigint as n_high,
  case when count_if(level = 'high') > 0 then round(count_if(level = 'high') / count(risk) * 100e0, 1) end as pct_high,
  count_if(risk >= 0.66)::bigint as high_risk_count, round(count_if(risk >= 0.66) / count(risk) * 100e0, 6) as high_risk_pct
from lv"""


@query("risk_summary", with_frames(["scored_events"], _SUMMARY_SQL).replace("\nwith ", ",\n", 1))
def q_risk_summary(spark, sf_dir):
    s = risk_summary(_composite(spark, sf_dir), "risk_score", P)
    return s.select(*[r9(F.col(c)).alias(c) if c in ("mean_risk", "median_risk", "max_risk", "min_risk",
                                                      "std_risk", "high_risk_pct") else F.col(c) for c in s.columns])


@query("scored_preview", with_frames(["scored_events"], "with " + _COMPOSITE.strip() + f"""
select event_id, round(risk, 6) as risk_score, {_LEVEL.format(s='risk')} as risk_level
from z order by event_id limit 500""").replace("\nwith ", ",\n", 1))
def q_scored_preview(spark, sf_dir):
    """The first 500 scored records by key (the original's response cap - the limit is the feature)."""
    from riskflow.sources.readers import preview_records
    out = _composite(spark, sf_dir).select("event_id", r9(F.col("risk_score")).alias("risk_score"), "risk_level")
    return preview_records(out, 500, ["event_id"])
