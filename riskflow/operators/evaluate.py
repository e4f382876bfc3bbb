"""Evaluation (E1-E8), class weights (M4), folds (M12) and best-model choice.

Classification metrics are SQL over the confusion counts `groupBy(label, prediction).count()` - K^2 rows.
Ranking metrics (ROC-AUC, average precision) need, per distinct score, the positives and negatives
strictly below it. That is a prefix sum: distinct scores are cut into ranges by approximate quantiles
(`Bucketizer`, any monotone cut keeps the result exact), the per-range totals (one row per range) give the
offsets, and a window *inside* each range gives the rest - no window over the whole table.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskflow.functions.hashing import row_hash
from riskflow.functions.group_cuts import with_cuts
from riskflow.session import cut_lineage

_RANGE_ROWS = 200_000


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return (df.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted"))
              .agg(F.count("*").alias("n")))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """E5 long form: (actual, predicted, n) over the sorted union of true and predicted labels, zeros filled."""
    # at most K x K rows, written once: the table itself is scanned once, whatever is derived from the counts
    counts = cut_lineage(confusion_counts(df, label, prediction))
    labels = (counts.select(F.col("actual").alias("c")).union(counts.select(F.col("predicted").alias("c")))
                    .where(F.col("c").isNotNull()).distinct())
    # every class against every class is the result's own shape (K x K rows)
    grid = labels.select(F.col("c").alias("actual")).crossJoin(labels.select(F.col("c").alias("predicted")))
    return (grid.join(counts, ["actual", "predicted"], "left")
                .select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def per_class(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class, precision, recall, f1, support) per class of the union of true and predicted labels;
    zero_division -> 0 as in the original."""
    cm = confusion_matrix(df, label, prediction)
    tp = cm.where(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("class"), F.col("n").alias("tp"))
    pred = cm.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("pred_n"))
    true = cm.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("support"))
    x = tp.join(pred, "class").join(true, "class")
    prec = F.when(F.col("pred_n") > 0, F.col("tp") / F.col("pred_n")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    x = x.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return x.withColumn("f1", f1).select("class", "precision", "recall", "f1", F.col("support").cast("long"))


def weighted_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row - accuracy, support-weighted precision, recall, F1."""
    pc = per_class(df, label, prediction)
    tot = F.sum("support")
    return pc.agg(
        (F.sum(F.when(F.col("support") > 0, F.col("recall") * F.col("support"))) / tot).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class rows plus 'macro avg' and 'weighted avg' (class column as text)."""
    pc = per_class(df, label, prediction).withColumn("class", F.col("class").cast("string"))
    tot = F.sum("support")
    macro = pc.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), tot.cast("long").alias("support"))
    weighted = pc.agg(F.lit("weighted avg").alias("class"),
                      (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                      (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
                      (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"), tot.cast("long").alias("support"))
    return pc.unionByName(macro).unionByName(weighted)


def score_table(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """Per distinct score: pos, neg, and pos_below / neg_below (strictly smaller scores), plus totals P, N."""
    s = F.col(score).cast("double")
    d = (df.where(s.isNotNull() & ~F.isnan(s) & F.col(label).isNotNull())      # a NaN score is missing
           .groupBy(s.alias("s"))
           .agg(F.count_if(F.col(label) == positive).alias("pos"), F.count_if(F.col(label) != positive).alias("neg")))
    d = cut_lineage(d)      # read for the count, the ranges, the offsets and the sums; the source is scanned once
    n_d = d.count()
    # at least one range per core (never one task for all distinct scores), more when they are many
    n_ranges = min(max(d.sparkSession.sparkContext.defaultParallelism, math.ceil(n_d / _RANGE_ROWS)), max(n_d, 1))
    if n_ranges > 1:
        probs = [i / n_ranges for i in range(1, n_ranges)]
        cuts = d.agg(F.percentile_approx("s", probs, 10 * n_ranges).alias("q")).first()["q"]
        splits = [-math.inf] + sorted(set(cuts)) + [math.inf]
        d = Bucketizer(splits=splits, inputCol="s", outputCol="rng").transform(d)
    else:
        d = d.withColumn("rng", F.lit(0.0))
    totals = d.groupBy("rng").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"))
    # one row per range (bounded): exclusive offsets over the ranges
    wo = Window.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("rng", F.coalesce(F.sum("rp").over(wo), F.lit(0)).alias("pos_off"),
                            F.coalesce(F.sum("rn").over(wo), F.lit(0)).alias("neg_off"))
    allt = totals.agg(F.sum("rp").alias("P"), F.sum("rn").alias("N"))
    wi = Window.partitionBy("rng").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    return (d.join(F.broadcast(offsets), "rng")
             .withColumn("pos_below", F.col("pos_off") + F.coalesce(F.sum("pos").over(wi), F.lit(0)))
             .withColumn("neg_below", F.col("neg_off") + F.coalesce(F.sum("neg").over(wi), F.lit(0)))
             .crossJoin(F.broadcast(allt))
             .select("s", "pos", "neg", "pos_below", "neg_below", "P", "N"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    """Exact ROC-AUC (ties count one half); NULL unless both classes are present."""
    t = score_table(df, label, score, positive)
    return t.agg(F.when((F.first("P") > 0) & (F.first("N") > 0),
                        F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg")))
                        / (F.first("P") * F.first("N"))).alias("roc_auc"))


def average_precision(df: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    """Sum over distinct scores (descending) of (R_i - R_{i-1}) * P_i - not the trapezoid area."""
    t = score_table(df, label, score, positive)
    tp = F.col("P") - F.col("pos_below")
    fp = F.col("N") - F.col("neg_below")
    return t.agg(F.when(F.first("P") > 0, F.sum(F.col("pos") / F.col("P") * tp / (tp + fp))).alias("average_precision"))


def evaluate(df: DataFrame, label: str = "label", prediction: str = "prediction",
             score: str | None = None, positive=1) -> DataFrame:
    """E1-E4 (+ E7, E8 with a score column) as a long (metric, value) table."""
    m = weighted_metrics(df, label, prediction)
    cols = ["accuracy", "precision", "recall", "f1"]
    if score is not None:
        m = m.crossJoin(ranking_metrics(df, label, score, positive))
        cols += ["roc_auc", "average_precision"]
    stack = ", ".join(f"'{c}', cast({c} as double)" for c in cols)
    return m.selectExpr(f"stack({len(cols)}, {stack}) as (metric, value)")


confusion = confusion_matrix
class_report = classification_report


def ranking_metrics(df: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    """E7 and E8 from one score table in one aggregate."""
    t = score_table(df, label, score, positive)
    tp = F.col("P") - F.col("pos_below")
    fp = F.col("N") - F.col("neg_below")
    return t.agg(
        F.when((F.first("P") > 0) & (F.first("N") > 0),
               F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))) / (F.first("P") * F.first("N")))
        .alias("roc_auc"),
        F.when(F.first("P") > 0, F.sum(F.col("pos") / F.col("P") * tp / (tp + fp))).alias("average_precision"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """M4: (label, n, weight) with weight = n_total / (K * n_class)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    tot = counts.agg(F.sum("n").alias("__t"), F.count("*").alias("__k"))
    return (counts.crossJoin(F.broadcast(tot))
                  .select("label", "n", (F.col("__t") / (F.col("__k") * F.col("n"))).alias("weight")))


def with_class_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    w = class_weights(df, label).select(F.col("label").alias("__l"), F.col("weight").alias(out))
    return df.join(w, F.col(label) == F.col("__l"), "left").drop("__l")


def assign_folds(df: DataFrame, key_cols: list[str], k: int = 5, seed: int = 42, label: str | None = None,
                 out: str = "fold") -> DataFrame:
    """K folds from the key hash. Stratified (with `label`): per class the rows, ordered by hash, are
    cut into k blocks of sizes differing by at most one, with cuts that are exact order statistics."""
    h = row_hash(key_cols, seed)
    if label is None or k < 2:
        return df.withColumn(out, F.pmod(h, F.lit(max(k, 1))).cast("int"))

    def ranks(n: Column) -> list[Column]:
        return [F.ceil(F.lit(i) * n / F.lit(k)) - 1 for i in range(1, k)]

    x = with_cuts(df, F.col(f"`{label}`"), h, ranks, "__h", "__cuts")
    above = [(F.col("__h") > F.col("__cuts")[i]).cast("int") for i in range(k - 1)]
    return x.withColumn(out, sum(above[1:], above[0])).drop("__h", "__cuts")


def select_best(metrics: DataFrame, metric: str = "f1", order_col: str = "position") -> DataFrame:
    """The row with the highest metric; ties -> the first trained (lowest position)."""
    return metrics.where(F.col(metric).isNotNull()).orderBy(F.desc(metric), F.asc(order_col)).limit(1)
