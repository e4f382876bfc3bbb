"""Risk engine: hand-worked cases (FIXTURES F7, G9, G10), weights, density against brute force, plans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.functions.levels import map_band, risk_level
from riskflow.operators.density import DensityField, log_density_points
from riskflow.operators.risk import composite_risk, minmax, risk_summary
from riskflow.params import Params


def test_probability_only(spark):
    # model, anomaly and density weights (0.50 + 0.25 + 0.15) all fall to the probability
    probs = [0.05, 0.35, 0.37, 0.72, 0.74, 1.0]
    df = spark.createDataFrame(list(enumerate(probs)), "k int, p double")
    out = {r["k"]: r for r in composite_risk(df, "p").collect()}
    for k, prob in enumerate(probs):
        assert out[k]["risk_score"] == pytest.approx(0.9 * prob, abs=1e-12)
    assert [out[k]["risk_level"] for k in range(6)] == ["low", "low", "medium", "medium", "high", "high"]


def test_g9_band_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.33,), (0.66,), (1.0,), (None,)], "s double")
    rows = df.select(risk_level("s").alias("lv"), map_band("s").alias("band")).collect()
    assert [r["lv"] for r in rows] == ["low", "medium", "high", "high", None]
    assert [r["band"] for r in rows] == ["Low", "Low", "Medium", "High", None]


def test_g10_equal_values(spark):
    df = spark.createDataFrame([(i, 0.5, -0.2, 1.0, 2.0) for i in range(4)], "k int, p double, a double, la double, lo double")
    df = df.withColumn("t", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    out = composite_risk(df, "p", "a", "la", "lo", "t", keep_parts=True).collect()
    for r in out:
        assert r["anomaly_part"] == 0.0 and r["spatial_density"] == 0.0 and r["recency"] == 0.0
        assert r["risk_score"] == pytest.approx(0.25)


def test_minmax_constant_is_zero(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r["x_norm"] for r in minmax(df, "x").collect()] == [0.0, 0.0]


def test_weights_normalisation():
    p = Params(weights={"model_score": 2.0, "anomaly_score": 2.0})
    w = p.norm_weights()
    assert w["model_score"] == 0.5 and w["anomaly_score"] == 0.5
    assert w["spatial_density"] == 0.15 and w["temporal_weight"] == 0.10      # missing keys: raw defaults
    assert Params(weights={"model_score": 0.0}).norm_weights()["model_score"] == 0.0


def test_unparseable_times_give_half(spark):
    df = spark.createDataFrame([(0.5, "not a time"), (0.2, "2024-01-01 00:00:00")], "p double, t string")
    rows = composite_risk(df, "p", ts="t", keep_parts=True).collect()
    assert all(r["recency"] == 0.5 for r in rows)


def _brute_log_density(pts, h=0.5):
    pts = np.asarray(pts)
    d2 = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1)
    return np.log(np.exp(-d2 / (2 * h * h)).sum(1))


def _fixture_points(n=400, seed=7):
    rng = np.random.default_rng(seed)
    a = rng.normal([1.0, 36.0], 0.3, size=(n // 2, 2))
    b = rng.uniform([-5, 30], [5, 42], size=(n // 2, 2))
    pts = np.vstack([a, b, a[:20]])          # exact duplicates too
    return pts


def test_density_against_brute_force(spark):
    pts = _fixture_points()
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "lat double, lon double")
    dens, _ = log_density_points(df, "lat", "lon", Params())
    got = {(r["lat"], r["lon"]): r["log_density"] for r in dens.collect()}
    g = np.array([got[(float(a), float(b))] for a, b in pts])
    assert np.max(np.abs(_brute_log_density(pts) - g)) < 1e-8


def test_density_of_a_heavy_point_far_away(spark):
    # 4,000,000 rows on one coordinate, one row 6.6 bandwidths off: ln(1 + 4e6 exp(-6.6^2 / 2))
    pts = spark.createDataFrame([(0.0, 0.0, 4_000_000), (0.0, 3.3, 1)], "plat double, plon double, w long")
    field = DensityField.fit(pts, Params())
    got = {r["plon"]: r["log_density"] for r in field.log_density(pts).collect()}
    assert got[3.3] == pytest.approx(math.log(1 + 4e6 * math.exp(-6.6 ** 2 / 2)), rel=1e-5)
    assert got[0.0] == pytest.approx(math.log(4e6 + math.exp(-6.6 ** 2 / 2)), abs=1e-9)


def test_density_plan_has_no_pairs_of_points(spark):
    pts = _fixture_points(100)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "lat double, lon double")
    dens, _ = log_density_points(df, "lat", "lon", Params())
    plan = dens._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_frozen_field_scores_new_rows_like_the_fitted_table(spark):
    from riskflow.operators.risk import fitted_bounds
    pts = _fixture_points(200)
    df = spark.createDataFrame([(i, float(a), float(b), i / len(pts), -float(i)) for i, (a, b) in enumerate(pts)],
                               "k int, lat double, lon double, p double, a double")
    want = {r["k"]: r["risk_score"] for r in composite_risk(df, "p", "a", "lat", "lon").collect()}
    bounds, field = fitted_bounds(df, "a", "lat", "lon")
    some = df.where("k % 7 = 0")
    got = {r["k"]: r["risk_score"] for r in composite_risk(some, "p", "a", "lat", "lon", bounds=bounds, field=field).collect()}
    assert len(got) > 20 and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    far = spark.createDataFrame([(1, 80.0, 170.0, 0.5, 0.0), (2, None, 1.0, 0.5, None)], "k int, lat double, lon double, p double, a double")
    rows = {r["k"]: r for r in composite_risk(far, "p", "a", "lat", "lon", bounds=bounds, field=field, keep_parts=True).collect()}
    assert rows[1]["spatial_density"] == 0.0 and rows[2]["spatial_density"] == 0.5 and rows[2]["anomaly_part"] == 0.5


def test_composite_plan_has_no_single_partition_exchange(spark):
    df = spark.createDataFrame([(i, i / 10.0, -float(i), float(i % 7), float(i % 5)) for i in range(50)],
                               "k int, p double, a double, la double, lo double")
    out = composite_risk(df, "p", "a", "la", "lo")
    assert_no_row_level_single_partition(out)


def assert_no_row_level_single_partition(df):
    """A SinglePartition exchange may only carry partial aggregates (one row per partition)."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            child = lines[i + 1]
            assert "HashAggregate" in child and "partial_" in child, (line, child)


def test_risk_summary_levels_present_only(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.5,)], "risk_score double")
    r = risk_summary(df).first()
    assert r["n_samples"] == 3 and r["n_high"] is None and r["pct_low"] == pytest.approx(66.7)
    assert r["median_risk"] == pytest.approx(0.2) and r["std_risk"] == pytest.approx(np.std([0.1, 0.2, 0.5]))
    assert r["high_risk_count"] == 0


def test_standalone_density_and_recency(spark):
    from riskflow.operators.risk import recency, spatial_density
    df = spark.createDataFrame([(1, 0.0, 0.0, "2024-01-01 00:00:00"), (2, 0.1, 0.1, "2024-01-02 00:00:00"),
                                (3, 3.0, 3.0, "2024-01-03 00:00:00")], "k int, la double, lo double, t string")
    d = {r["k"]: r["spatial_density"] for r in spatial_density(df, "la", "lo").collect()}
    assert d[3] == 0.0 and max(d.values()) == 1.0
    r = {x["k"]: x["recency"] for x in recency(df.withColumn("t", F.to_timestamp("t")), "t").collect()}
    assert r[1] == 0.0 and r[2] == pytest.approx(0.5) and r[3] == pytest.approx(1.0)


def test_evaluate_long_form(spark):
    from riskflow.operators.evaluate import evaluate
    df = spark.createDataFrame([(1, 1, 0.9), (0, 0, 0.1), (1, 0, 0.4), (0, 1, 0.6)], "label int, prediction int, s double")
    m = {r["metric"]: r["value"] for r in evaluate(df, score="s").collect()}
    assert m["accuracy"] == 0.5 and m["roc_auc"] == pytest.approx(0.75)


def test_with_label_and_drop_constant(spark):
    from riskflow.operators.prep import drop_constant, with_label
    df = spark.createDataFrame([("b", 1, 5), ("a", 2, 5), (None, 3, 5)], "t string, x int, c int")
    out, m = with_label(df, "t")
    assert m == {"a": 0, "b": 1} and [r["label"] for r in out.collect()] == [1, 0, None]
    kept, const = drop_constant(df)
    assert const == ["c"] and kept.columns == ["t", "x"]
