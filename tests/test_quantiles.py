"""Exact quantiles by histogram refinement equal numpy's linear quantiles, whatever the pass count."""

import numpy as np
import pytest

import riskflow.functions.quantiles as qq


@pytest.mark.parametrize("fetch", [5, 5000])
def test_exact_quantiles_match_numpy(spark, monkeypatch, fetch):
    monkeypatch.setattr(qq, "_FETCH_LIMIT", fetch)
    rng = np.random.default_rng(1)
    a = rng.normal(0, 1, 3000)
    b = np.round(rng.exponential(2, 3000), 1)          # many ties
    b[::7] = np.nan                                    # NULLs are ignored
    rows = [(float(x), None if np.isnan(y) else float(y), int(i % 3)) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, g int")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = qq.column_quantiles(df, ["a", "b"], probs)
    assert got["a"] == pytest.approx(list(np.quantile(a, probs)), abs=1e-12)
    assert got["b"] == pytest.approx(list(np.quantile(b[~np.isnan(b)], probs)), abs=1e-12)
    grouped = qq.quantiles(df, ["a"], [0.5], ["g"])
    for g in range(3):
        assert grouped[((g,), "a")][0] == pytest.approx(np.median(a[np.arange(3000) % 3 == g]), abs=1e-12)


def test_approx_mode_close(spark):
    df = spark.range(10000).selectExpr("cast(id as double) as x")
    got = qq.column_quantiles(df, ["x"], [0.5], mode="approx")["x"][0]
    assert abs(got - 4999.5) <= 2


def test_all_null_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert qq.column_quantiles(df, ["x"], [0.5])["x"] == [None]
