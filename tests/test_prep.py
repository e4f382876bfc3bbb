"""Preparation chain: the G cases of FIXTURES section 2 and the D decisions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.operators import prep as pp
from riskflow.params import Params


def test_g2_numeric_coercion(spark):
    df = spark.createDataFrame([("1", "1", "1d", "1.5"), ("2", "x", "2", "2"), (None, "3", "3", None)],
                               "a string, b string, c string, d string")
    plan = pp.coerce_plan(df)
    assert plan == {"a": "bigint", "d": "double"}          # 'x' and '1d' keep b, c as text
    out = pp.apply_coercion(df, plan).collect()
    assert [r["a"] for r in out] == [1, 2, None] and [r["d"] for r in out] == [1.5, 2.0, None]


def test_g3_temporal_detection(spark):
    df = spark.createDataFrame([("2024-01-05", "2024-01-05", "2024-01-05 10:00:00", None),
                                ("2024-03-09", "03/09/2024", None, None)],
                               "one string, mixed string, withnull string, empty string")
    plan = pp.detect_temporal(df)
    assert plan == {"one": "yyyy-MM-dd", "withnull": "yyyy-MM-dd HH:mm:ss"}
    out = pp.add_temporal_features(df, plan).first()
    assert (out["one_year"], out["one_month"], out["one_dayofweek"], out["one_quarter"]) == (2024, 1, 4, 1)
    assert out["withnull_hour"] == 10 and "one" not in out.asDict()


def test_g4_categories_null_and_unseen(spark):
    fit = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    enc = pp.CategoryEncoder.fit(fit, ["c"])
    new = spark.createDataFrame([("a",), ("b",), ("zzz",), (None,)], "c string")
    assert [r["c"] for r in enc.apply(new).collect()] == [0, 1, -1, -1]


def test_g4_large_map_uses_join(spark, monkeypatch):
    monkeypatch.setattr(pp, "LITERAL_MAP_MAX", 2)
    fit = spark.createDataFrame([(v,) for v in "dcba"], "c string")
    enc = pp.CategoryEncoder.fit(fit, ["c"])
    assert enc.mapping is None
    new = spark.createDataFrame([("a",), ("d",), ("q",)], "c string")
    assert sorted(r["c"] for r in enc.apply(new).collect()) == [-1, 0, 3]


def test_g5_iqr_zero_becomes_constant(spark):
    vals = [1.0] * 8 + [5.0, -3.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    out = [r["x"] for r in pp.clip_iqr(df, ["x"]).collect()]
    assert out == [1.0] * 10


def test_iqr_matches_pandas_rule(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, 500)
    x[:5] = [10, -10, 8, 9, -7]
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    q1, q3 = np.quantile(x, [0.25, 0.75])
    want = np.clip(x, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    got = np.array([r["x"] for r in pp.clip_iqr(df.coalesce(1), ["x"]).collect()])
    assert np.allclose(got, want, atol=1e-12)


def test_g6_zscore(spark):
    vals = [1.0] * 20 + [100.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    out = [r["x"] for r in pp.null_zscore(df.coalesce(1), ["x"], 3.0).collect()]
    assert out[:20] == [1.0] * 20 and out[20] is None and out[21] is None


def test_imputers(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (2.0,), (None,)], "x double")
    assert pp.impute_values(df, ["x"], "median")["x"] == 2.0
    assert pp.impute_values(df, ["x"], "mean")["x"] == pytest.approx(3.6)
    assert pp.impute_values(df, ["x"], "most_frequent")["x"] == 2.0
    ties = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (1.0,)], "x double")
    assert pp.impute_values(ties, ["x"], "most_frequent")["x"] == 1.0      # ties -> smallest
    even = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert pp.impute_values(even, ["x"], "median")["x"] == 2.5            # not Imputer's 2.0


def test_scalers_constant_and_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    st = pp.scaler_stats(df, ["x", "c"], "standard")
    assert st["x"] == (2.0, 1.0) and st["c"] == (5.0, 1.0)
    mm = pp.scale(df, ["c"], "minmax").collect()
    assert [r["c"] for r in mm] == [0.0, 0.0]
    with pytest.raises(ValueError):
        pp.scaler_stats(df, ["x"], "fancy")


def _sites_frame(spark, n=200, seed=11):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        depth = None if i % 23 == 5 else float(rng.gamma(3.0, 4.0))
        rows.append((i, float(rng.normal(48.0, 2.5)), float(rng.normal(11.0, 4.0)), depth, float(rng.beta(2, 5)),
                     int(rng.integers(1, 5000)), int(i % 3 == 0), True, 7, None))
    return spark.createDataFrame(rows, "id long, latitude double, longitude double, depth double, "
                                       "porosity double, wells long, label int, flag boolean, "
                                       "const int, empty double")


def test_chain_g7_g12_and_transform(spark, tmp_path):
    df = _sites_frame(spark)
    model = pp.Prep(Params()).fit(df, "label", ["id"])
    s = model.state
    assert set(s["constant"]) == {"const", "empty", "flag"}                  # G7 (flag is constant here too)
    feats = model.feature_names
    assert feats[:5] == ["latitude", "longitude", "depth", "porosity", "wells"]
    assert feats[5:] == ["geo_lat_rad", "geo_lon_rad", "geo_distance_eq", "geo_quadrant"]
    fr = model.fitted_frame(df)
    assert fr.count() == 200 and set(fr.columns) >= {"id", "label", "split", *feats}
    means = fr.agg(*[F.avg(c).alias(c) for c in feats]).first()
    assert all(abs(means[c]) < 1e-9 for c in feats)                          # standard-scaled
    # A training column missing at transform comes back NULL -> imputed -> scaled, no job is started
    new = df.drop("depth", "label")
    out = model.transform(new)
    assert out.columns == ["id", *feats]
    vals = {r["depth"] for r in out.select("depth").collect()}
    assert len(vals) == 1
    # S6 / S7 round trip
    path = str(tmp_path / "prep")
    model.save(path)
    again = pp.PrepModel.load(spark, path)
    a = sorted(model.transform(df).collect())
    b = sorted(again.transform(df).collect())
    assert a == b


def test_g12_boolean_not_a_feature(spark):
    rows = [(i, float(i), i % 2 == 0, i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, x double, b boolean, label int")
    model = pp.Prep(Params()).fit(df, "label", ["id"])
    assert model.feature_names == ["x"]


def test_split_properties(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = pp.assign_split(df, ["k"], Params())
    b = pp.assign_split(df.repartition(7), ["k"], Params())
    ca = {r["split"]: r["count"] for r in a.groupBy("split").count().collect()}
    assert sum(ca.values()) == 5000 and 900 <= ca["test"] <= 1100 and 350 <= ca["val"] <= 650
    assert sorted(a.collect()) == sorted(b.collect())                         # stable under repartitioning


def test_split_stratified_exact(spark):
    df = spark.range(1003).selectExpr("id as k", "cast(id % 3 = 0 as int) as y")
    out = pp.assign_split(df, ["k"], Params(), stratify="y")
    counts = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    for y, n in ((0, 668), (1, 335)):
        n_test = math.ceil(0.2 * n)
        n_val = math.ceil(0.125 * (n - n_test))
        assert counts[(y, "test")] == n_test and counts[(y, "val")] == n_val


def test_unknown_options_raise():
    with pytest.raises(ValueError):
        pp.Prep(Params(outlier_method="isolation_forest"))
    with pytest.raises(ValueError):
        pp.Prep(Params(scaling="unknown"))


def test_c2_text_labels_and_no_key_split(spark):
    rows = [(float(i), "yes" if i % 3 == 0 else "no") for i in range(60)]
    df = spark.createDataFrame(rows, "x double, target string")
    model = pp.Prep(Params()).fit(df, "target")
    assert model.state["label_map"] == {"no": 0, "yes": 1}
    fr = model.fitted_frame()
    labels = {r["label"] for r in fr.select("label").collect()}
    assert labels == {0, 1} and fr.count() == 60
    assert {r["split"] for r in fr.select("split").collect()} <= {"train", "val", "test"}


def test_exact_plain_split_sizes(spark):
    df = spark.range(777).withColumnRenamed("id", "k")
    out = pp.assign_split(df, ["k"], Params(), exact=True)
    c = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    n_test = math.ceil(0.2 * 777)
    assert c["test"] == n_test and c["val"] == math.ceil(0.125 * (777 - n_test))


def test_ranked_codes_many_ranges(spark):
    vals = [f"v{i:05d}" for i in range(3000)] + ["a", "b"]
    df = spark.createDataFrame([(v, str(i % 7)) for i, v in enumerate(vals)], "c string, d string")
    distinct = pp._distinct_values(df, ["c", "d"])
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    codes = {(r["column"], r["value"]): r["code"] for r in pp._ranked_codes(distinct, 3009).collect()}
    for i, v in enumerate(sorted(vals)):
        assert codes[("c", v)] == i
    assert [codes[("d", str(k))] for k in range(7)] == list(range(7))


def test_text_target_class_bound(spark, monkeypatch):
    from riskflow.operators import prep as pp
    df = spark.createDataFrame([(i, f"c{i % 5}") for i in range(50)], "id long, y string")
    x, mapping = pp.with_label(df, "y")
    assert mapping == {f"c{i}": i for i in range(5)}
    assert sorted(r["label"] for r in x.select("label").distinct().collect()) == list(range(5))
    monkeypatch.setattr(pp, "MAX_CLASSES", 4)
    import pytest
    with pytest.raises(ValueError, match="not a class label"):
        pp.with_label(df, "y")


def test_large_map_broadcast_needs_byte_bound(spark, monkeypatch):
    monkeypatch.setattr(pp, "LITERAL_MAP_MAX", 2)
    fit = spark.createDataFrame([(v,) for v in "dcba"], "c string")
    new = spark.createDataFrame([("a",), ("d",), ("q",)], "c string")
    small = pp.CategoryEncoder.fit(fit, ["c"])
    tight = pp.CategoryEncoder.fit(fit, ["c"], Params(broadcast_max_bytes=1))
    plans = {}
    for name, enc in (("small", small), ("tight", tight)):
        out = enc.apply(new)
        assert sorted(r["c"] for r in out.collect()) == [-1, 0, 3]
        plans[name] = out._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plans["small"].lower()
    assert "broadcast" not in plans["tight"].lower()


NAN = float("nan")


def test_nan_is_missing_in_every_fitting_operator(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (NAN,), (None,)], "x double")
    clipped = sorted((r["x"] for r in pp.clip_iqr(df, ["x"]).collect()), key=lambda v: (v is None, v))
    assert clipped == [1.0, 2.0, 3.0, 4.0, None, None]
    for how, fill in (("median", 2.5), ("mean", 2.5), ("most_frequent", 1.0)):
        assert sorted(r["x"] for r in pp.impute(df, ["x"], how).collect()) == sorted([1.0, 2.0, 3.0, 4.0, fill, fill])
    for how, want in (("standard", 2.5), ("minmax", 1.0), ("robust", 2.5)):
        center, scale = pp.scaler_stats(df, ["x"], how)["x"]
        assert center == want and scale > 0
    assert sum(r["x"] is None for r in pp.scale(df, ["x"]).collect()) == 2
    assert sorted(r["x"] for r in pp.null_zscore(df, ["x"]).collect() if r["x"] is not None) == [1.0, 2.0, 3.0, 4.0]
    wide = df.selectExpr("x", "monotonically_increasing_id() as id", "coalesce(nanvl(x, 9e0), 8e0) as y")
    model = pp.Prep(Params()).fit(wide, None, ["id"])
    assert all(v == v for r in model.transform(wide).collect() for v in r[1:])


def test_infinities_rank_at_the_ends(spark):
    from riskflow.functions.quantiles import column_quantiles
    inf = float("inf")
    df = spark.range(20_000).selectExpr("case when id = 0 then double('Infinity') when id = 1 then double('-Infinity') else id end as x",
                                        "case when id = 5 then 1.7e308 when id = 6 then -1.7e308 else id end as y")
    q = column_quantiles(df, ["x", "y"], [0.0, 0.5, 1.0])
    assert q["x"][0] == -inf and q["x"][2] == inf and q["x"][1] == pytest.approx(10_000.5)
    assert q["y"][0] == -1.7e308 and q["y"][2] == 1.7e308


def test_rows_without_a_label_split_and_fold(spark):
    from riskflow.operators.evaluate import assign_folds
    df = spark.range(300).selectExpr("id", "case when id % 10 = 3 then null else int(id % 2) end as label")
    split = pp.assign_split(df, ["id"], Params(), stratify="label").groupBy("label", "split").count().collect()
    assert sum(r["count"] for r in split) == 300 and sum(r["count"] for r in split if r["label"] is None) == 30
    assert {r["split"] for r in split if r["label"] is None} == {"train", "val", "test"}
    folds = assign_folds(df, ["id"], 5, 42, label="label").groupBy("label", "fold").count().collect()
    assert {r["count"] for r in folds if r["label"] is None} == {6}


def test_integers_beyond_64_bits_stay_numbers(spark):
    df = spark.createDataFrame([("123456789012345678901", "9223372036854775807"), ("5", "-1"), (None, " 12 ")], "a string, b string")
    out = pp.coerce_types(df)
    assert dict(out.dtypes) == {"a": "double", "b": "bigint"}
    assert sorted(r["a"] for r in out.collect() if r["a"] is not None) == [5.0, 1.2345678901234568e20]
    assert sorted(r["b"] for r in out.collect()) == [-1, 12, 9223372036854775807]


def test_fit_on_train_ignores_other_rows(spark):
    from riskflow.operators.prep import Prep
    from riskflow.params import Params
    data = [(i, float(i % 50), "abc"[i % 3], i % 2) for i in range(400)]
    p = Params(fit_on="train")
    for keys in (["id"], []):
        df = spark.createDataFrame(data, "id long, v double, c string, y int")
        split = Prep(p).fit(df, target="y", keys=keys)
        n_train = split.fitted_frame().where("split = 'train'").count()
        assert split.stats["n_rows"] == n_train < 400
    ids = {r["id"] for r in Prep(p).fit(df, target="y", keys=["id"]).fitted_frame().where("split <> 'train'").collect()}
    other = spark.createDataFrame([(i, 1e6 + i, "zzz", y) if i in ids else (i, v, c, y) for i, v, c, y in data], df.schema)
    a, b = (Prep(p).fit(x, target="y", keys=["id"]).state for x in (df, other))
    assert a == b and Prep(Params()).fit(other, target="y", keys=["id"]).state["fill"] != a["fill"]
