"""Chart-table queries (V1, V2, V4, V5, V6) over the composite scores of `scored_events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow.functions.quantiles import column_quantiles
from riskflow.operators import chartdata as cd
from riskflow.operators import evaluate as ev
from riskflow.params import Params
from riskflow.plans import q_eval, q_risk
from riskflow.plans.fixtures import frame, with_frames
from riskflow.plans.registry import DIGITS, query
from riskflow.session import configure

P = Params()
_BAND = """case when {s} >= 0 and {s} <= 0.33 then 'Low' when {s} > 0.33 and {s} <= 0.66 then 'Medium'
  when {s} > 0.66 and {s} <= 1.01 then 'High' end"""


@query("chart_histogram", with_frames(["scored_events"], "with " + q_risk._COMPOSITE.strip() + f""",
b as (select least(greatest(floor(risk * 40), 0), 39)::int as bin, count(*) as n from z where risk is not null
      group by 1),
allb as (select range::int as bin from range(40))
select allb.bin, allb.bin / 40e0 as lo, (allb.bin + 1) / 40e0 as hi, coalesce(b.n, 0) as n,
  {q_risk._LEVEL.format(s='(allb.bin / 40e0)')} as band
from allb left join b using (bin)""").replace("\nwith ", ",\n", 1))
def q_chart_histogram(spark, sf_dir):
    return cd.chart_histogram(q_risk._composite(spark, sf_dir), "risk_score", 40, P)


def _model_metrics(spark, sf_dir):
    df = q_eval._scored(spark, sf_dir)
    rows = []
    for pos, (name, t) in enumerate(q_eval.THRESHOLDS.items()):
        pred = df.select("label", "model_prob", (F.col("model_prob") >= t).cast("int").alias("prediction"))
        m = ev.weighted_metrics(pred).crossJoin(ev.roc_auc(pred, "label", "model_prob"))
        rows.append(m.select(F.lit(name).alias("model"), F.lit(pos).alias("position"), *m.columns))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _comparison_sql():
    parts = []
    for name, t in q_eval.THRESHOLDS.items():
        src = f"(select label, case when model_prob >= {t!r} then 1 else 0 end as prediction from scored_events)"
        parts.append(f"""select * from (
  with {q_eval._per_class_sql(src).strip()},
  {q_eval._SCORE_TABLE.strip()}
  select '{name}' as model,
    (select sum(case when support > 0 then recall * support end) / sum(support) from pc) as accuracy,
    (select sum(precision * support) / sum(support) from pc) as precision,
    (select sum(recall * support) / sum(support) from pc) as recall,
    (select sum(f1 * support) / sum(support) from pc) as f1,
    (select sum(pos * (neg_below + 0.5 * neg)) / (max(p_all) * max(n_all)) from t) as roc_auc)""")
    metrics = "\nunion all\n".join(parts)
    unpivot = "\nunion all\n".join(
        f"select model, '{cd.METRIC_TITLES[m]}' as metric, round(coalesce({m}, 0e0), 6) as value from metrics"
        for m in cd.METRICS)
    # names here are one word plus a number, so capitalising the first letter equals initcap
    return with_frames(["scored_events"], f"""select model,
  upper(substr(model, 1, 1)) || substr(replace(model, '_', ' '), 2) as title, metric, value
from (with metrics as ({metrics})
{unpivot})""")


@query("chart_model_comparison", _comparison_sql())
def q_chart_model_comparison(spark, sf_dir):
    m = cd.chart_model_comparison(_model_metrics(spark, sf_dir))
    return m.select("model", "title", "metric", F.round("value", 6).alias("value"))


@query("chart_confusion", with_frames(["scored_events"], "with " + q_eval._per_class_sql("scored_events").strip()
                                      + """
select cast(actual as varchar) as actual, cast(predicted as varchar) as predicted, n from grid""")
       .replace("\nwith ", ",\n", 1))
def q_chart_confusion(spark, sf_dir):
    return cd.chart_confusion(ev.confusion_matrix(q_eval._scored(spark, sf_dir), "label", "prediction"))


@query("chart_map_points", with_frames(["scored_events"], "with " + q_risk._COMPOSITE.strip() + f"""
select event_id, latitude as lat, longitude as lon, round(risk, 6) as score, {_BAND.format(s='risk')} as band,
  round(risk, 6) as size
from z where latitude is not null and longitude is not null and risk is not null""").replace("\nwith ", ",\n", 1))
def q_chart_map_points(spark, sf_dir):
    pts = cd.chart_map_points(q_risk._composite(spark, sf_dir), "latitude", "longitude", "risk_score", ["event_id"], P)
    return pts.select("event_id", "lat", "lon", F.round("score", 6).alias("score"), "band",
                      F.round("size", 6).alias("size"))


@query("chart_map_grid", with_frames(["scored_events"], "with " + q_risk._COMPOSITE.strip() + f"""
select floor(latitude / 0.5e0) * 0.5e0 as lat_lo, floor(longitude / 0.5e0) * 0.5e0 as lon_lo, count(*) as n,
  round(avg(risk), 6) as mean_score, round(max(risk), 6) as max_score, {_BAND.format(s='avg(risk)')} as band
from z where latitude is not null and longitude is not null and risk is not null
group by floor(latitude / 0.5e0), floor(longitude / 0.5e0)""").replace("\nwith ", ",\n", 1))
def q_chart_map_grid(spark, sf_dir):
    g = cd.chart_map_grid(q_risk._composite(spark, sf_dir), "latitude", "longitude", "risk_score", 0.5, P)
    return g.select("lat_lo", "lon_lo", "n", F.round("mean_score", 6).alias("mean_score"),
                    F.round("max_score", 6).alias("max_score"), "band")


@query("chart_timeline", with_frames(["scored_events"], """
select date_trunc('hour', ts) as bucket, count(*) as n, round(min(anomaly_score), 6) as min_score,
  round(avg(anomaly_score), 6) as mean_score,
  count_if(anomaly_score < (select quantile_cont(anomaly_score, 0.1) from scored_events))::bigint as n_flagged
from scored_events group by 1"""))
def q_chart_timeline(spark, sf_dir):
    configure(spark)
    df = frame(spark, sf_dir, "scored_events")
    offset = column_quantiles(df, ["anomaly_score"], [P.if_contamination], P.quantiles)["anomaly_score"][0]
    flagged = df.withColumn("flag", F.col("anomaly_score") < F.lit(offset))
    t = cd.chart_timeline(flagged, "anomaly_score", "flag", "ts", bucket="hour")
    return t.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "n",
                    F.round("min_score", 6).alias("min_score"), F.round("mean_score", 6).alias("mean_score"),
                    "n_flagged")
