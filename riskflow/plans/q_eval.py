"""Evaluation queries (E1-E8, M4, M12, M15) on `scored_events`: label, a fixed-threshold prediction and the
linear score `model_prob` (deterministic stand-ins for a model, so every metric has an oracle)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow.operators import evaluate as ev
from riskflow.params import Params
from riskflow.plans.fixtures import frame, with_frames
from riskflow.plans.registry import DIGITS, query
from riskflow.session import configure

P = Params()
THRESHOLDS = {"threshold_20": 0.2, "threshold_30": 0.3, "threshold_40": 0.4}


def _scored(spark, sf_dir):
    configure(spark)
    return frame(spark, sf_dir, "scored_events")


def r9(c):
    return F.round(c, DIGITS)


def _per_class_sql(src: str, label: str = "label", pred: str = "prediction") -> str:
    return f"""
cm as (select {label} as actual, {pred} as predicted, count(*) as n from {src} group by all),
labels as (select actual as c from cm union select predicted from cm),
grid as (select a.c as actual, b.c as predicted, coalesce(cm.n, 0) as n
         from labels a cross join labels b left join cm on cm.actual = a.c and cm.predicted = b.c),
pc0 as (select c,
          (select sum(n) from grid where actual = c and predicted = c) as tp,
          (select sum(n) from grid where predicted = c) as pred_n,
          (select sum(n) from grid where actual = c) as support
        from labels),
pc1 as (select c, support, case when pred_n > 0 then tp / pred_n else 0e0 end as precision,
          case when support > 0 then tp / support else 0e0 end as recall from pc0),
pc as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0e0 end
          as f1 from pc1)"""


_WEIGHTED = """select round(sum(case when support > 0 then recall * support end) / sum(support), 6) as accuracy,
  round(sum(precision * support) / sum(support), 6) as precision,
  round(sum(recall * support) / sum(support), 6) as recall,
  round(sum(f1 * support) / sum(support), 6) as f1 from pc"""


@query("confusion_matrix", with_frames(["scored_events"], "with " + _per_class_sql("scored_events").strip()
                                       + "\nselect actual, predicted, n from grid").replace("\nwith ", ",\n", 1))
def q_confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix(_scored(spark, sf_dir), "label", "prediction")


@query("weighted_metrics", with_frames(["scored_events"], "with " + _per_class_sql("scored_events").strip()
                                       + "\n" + _WEIGHTED).replace("\nwith ", ",\n", 1))
def q_weighted_metrics(spark, sf_dir):
    m = ev.weighted_metrics(_scored(spark, sf_dir), "label", "prediction")
    return m.select(*[r9(F.col(c)).alias(c) for c in m.columns])


@query("classification_report", with_frames(["scored_events"], "with " + _per_class_sql("scored_events").strip() + """
select cast(c as varchar) as class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1,
  support::bigint as support from pc
union all
select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::bigint from pc
union all
select 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), sum(support)::bigint from pc""").replace("\nwith ", ",\n", 1))
def q_classification_report(spark, sf_dir):
    r = ev.classification_report(_scored(spark, sf_dir), "label", "prediction")
    return r.select("class", *[r9(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


_SCORE_TABLE = """
d as (select model_prob as s, count_if(label = 1) as pos, count_if(label <> 1) as neg from scored_events
      where model_prob is not null and label is not null group by model_prob),
t as (select s, pos, neg,
        coalesce(sum(pos) over (order by s rows between unbounded preceding and 1 preceding), 0) as pos_below,
        coalesce(sum(neg) over (order by s rows between unbounded preceding and 1 preceding), 0) as neg_below,
        sum(pos) over () as p_all, sum(neg) over () as n_all from d)"""


@query("roc_auc", with_frames(["scored_events"], "with " + _SCORE_TABLE.strip() + """
select round(sum(pos * (neg_below + 0.5 * neg)) / (max(p_all) * max(n_all)), 6) as roc_auc from t""")
       .replace("\nwith ", ",\n", 1))
def q_roc_auc(spark, sf_dir):
    return ev.roc_auc(_scored(spark, sf_dir), "label", "model_prob").select(r9(F.col("roc_auc")).alias("roc_auc"))


@query("average_precision", with_frames(["scored_events"], "with " + _SCORE_TABLE.strip() + """
select round(sum(pos / p_all * (p_all - pos_below) / ((p_all - pos_below) + (n_all - neg_below))), 6)
  as average_precision from t""").replace("\nwith ", ",\n", 1))
def q_average_precision(spark, sf_dir):
    a = ev.average_precision(_scored(spark, sf_dir), "label", "model_prob")
    return a.select(r9(F.col("average_precision")).alias("average_precision"))


@query("class_weight", with_frames(["geo_events"], """
select label, count(*) as n, round((select count(*) from geo_events where label is not null)
  / ((select count(distinct label) from geo_events) * count(*))::double, 6) as weight
from geo_events where label is not null group by label"""))
def q_class_weight(spark, sf_dir):
    configure(spark)
    w = ev.class_weights(frame(spark, sf_dir, "geo_events"), "label")
    return w.withColumn("weight", r9(F.col("weight")))


@query("fold_assign", with_frames(["geo_events"], """
select event_id, label, cast(floor((rn - 1) * 5 / n) as int) as fold from (
  select event_id, label,
    row_number() over (partition by label
                       order by ('0x' || substr(md5(concat_ws('#', event_id, '42')), 1, 13))::BIGINT) as rn,
    count(*) over (partition by label) as n
  from geo_events)"""))
def q_fold_assign(spark, sf_dir):
    configure(spark)
    df = frame(spark, sf_dir, "geo_events").select("event_id", "label")
    return ev.assign_folds(df, ["event_id"], P.cv_folds, P.seed, label="label")


@query("fold_many_classes", with_frames(["line_risk"], """
select l_orderkey, l_linenumber, l_partkey, cast(floor((rn - 1) * 5 / n) as int) as fold from (
  select l_orderkey, l_linenumber, l_partkey,
    rank() over (partition by l_partkey
                       order by ('0x' || substr(md5(concat_ws('#', l_orderkey, l_linenumber, l_partkey, l_suppkey, '42')), 1, 13))::BIGINT) as rn,
    count(*) over (partition by l_partkey) as n
  from line_risk)"""))
def q_fold_many_classes(spark, sf_dir):
    """M12 with a class a part; rows of the same key stay together."""
    configure(spark)
    df = frame(spark, sf_dir, "line_risk").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return ev.assign_folds(df, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], P.cv_folds, P.seed, label="l_partkey").drop("l_suppkey")


def _select_best_sql():
    parts = []
    for pos, (name, t) in enumerate(THRESHOLDS.items()):
        src = f"(select label, case when model_prob >= {t!r} then 1 else 0 end as prediction from scored_events)"
        parts.append(f"select '{name}' as model, {pos} as position, (with " + _per_class_sql(src).strip()
                     + " select sum(f1 * support) / sum(support) from pc) as f1")
    return with_frames(["scored_events"], "select model, round(f1, 6) as f1 from (\n"
                       + "\nunion all\n".join(parts) + "\n) order by f1 desc, position asc limit 1")


@query("select_best", _select_best_sql())
def q_select_best(spark, sf_dir):
    df = _scored(spark, sf_dir)
    rows = []
    for pos, (name, t) in enumerate(THRESHOLDS.items()):
        pred = df.select("label", (F.col("model_prob") >= t).cast("int").alias("prediction"))
        rows.append(ev.weighted_metrics(pred).select(F.lit(name).alias("model"), F.lit(pos).alias("position"), "f1"))
    metrics = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return ev.select_best(metrics).select("model", r9(F.col("f1")).alias("f1"))
