"""End-to-end jobs (J1-J6): ingest + profile, prepare, train, score the test split, score new rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskflow.operators import profile as pr
from riskflow.operators.models import RiskModels, train
from riskflow.operators.prep import Prep, PrepModel
from riskflow.operators.risk import composite_risk, risk_summary
from riskflow.params import Params
from riskflow.session import cut_lineage
from riskflow.sources.readers import read_table


@dataclass
class Ingested:
    df: DataFrame
    schema: DataFrame
    missing: DataFrame
    sample: DataFrame
    target: str | None
    lat: str | None
    lon: str | None
    warnings: DataFrame


def ingest(spark: SparkSession, path: str, fmt: str | None = None) -> Ingested:
    """Read, profile (P1-P3), validate (P4-P7), infer the target and coordinates."""
    df = read_table(spark, path, fmt)
    target = pr.infer_target(df.columns)
    lat, lon = pr.infer_coords(df.columns, target)
    return Ingested(df, pr.profile_schema(df), pr.profile_missing(df), pr.preview(df, 5), target, lat, lon,
                    pr.validate(df))


def prepare(df: DataFrame, target: str | None, keys: list[str], p: Params = Params()) -> tuple[PrepModel, DataFrame]:
    """Fit the chain, return the model and the split training frame (checkpointed once: training,
    validation, cross-validation and the forest all read it)."""
    model = Prep(p).fit(df, target=target, keys=keys)
    return model, cut_lineage(model.fitted_frame())


def fit_all(df: DataFrame, target: str, keys: list[str], p: Params = Params(), only=None, cv: bool = True):
    """J2 + J3."""
    prep_model, frame = prepare(df, target, keys, p)
    models = train(frame, prep_model.feature_names, keys, p, only=only, cv=cv)
    return prep_model, frame, models


def score_test(models: RiskModels, frame: DataFrame, model_name: str | None = None,
               p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Predictions on the held-out test split and the summary of the model probability (as the
    original does, D5)."""
    test = frame.where(F.col("split") == "test")
    pred = models.predict(test, model_name)
    return pred, risk_summary(pred, "risk_prob", p)


def score_new(df: DataFrame, prep_model: PrepModel, models: RiskModels, keys: list[str],
              lat: str | None = None, lon: str | None = None, ts: str | None = None,
              model_name: str | None = None, p: Params = Params(), bounds: dict | None = None, field=None) -> DataFrame:
    """New rows -> prepared features -> model probability + anomaly score/flag -> composite
    risk and level, attached to the source columns (carried through the pipeline: no join, no positional
    zip). `keys` identify rows for the caller; the scoring itself needs no join on them."""
    # the source columns ride along through the features and the model: one narrow pipeline, no join
    feats = prep_model.transform(df, passthrough=df.columns)
    pred = models.predict(feats, model_name)
    cols = [F.col(f"`__src_{c}`").alias(c) for c in df.columns] + [F.col("risk_prob").alias("__prob")]
    if "anomaly_score" in pred.columns:
        cols += [F.col("anomaly_score").alias("__anom"), F.col("anomaly_flag")]
    rows = pred.select(*cols)
    anomaly = "__anom" if "anomaly_score" in pred.columns else None
    if (lat and lon) or (bounds is None and (anomaly or ts)):
        # the rows feed the density points, the min/max and the result, and a Python scan (the forest)
        # stops column pruning: materialise them once so the models run once per row, not per consumer
        rows = cut_lineage(rows)
    out = composite_risk(rows, "__prob", anomaly, lat, lon, ts, p, bounds=bounds, field=field)
    if "anomaly_flag" not in out.columns:
        out = out.withColumn("anomaly_flag", F.lit(False))
    return out.drop("__prob", "__anom")
