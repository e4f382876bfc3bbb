"""Missing values in the risk engine, column names with dots, CSV line breaks and truth words, cuts of many groups."""

import math

import pytest
from pyspark.sql import functions as F, types as T

from riskflow.functions import group_cuts as gc
from riskflow.functions.quantiles import column_quantiles, quantiles
from riskflow.operators import evaluate as ev, prep as pp, profile as pr
from riskflow.operators.prep import Prep
from riskflow.operators.risk import composite_risk, fitted_bounds, minmax, risk_summary
from riskflow.params import Params
from riskflow.sources import readers

NAN = float("nan")


def test_missing_probability_has_no_risk(spark):
    df = spark.createDataFrame([(1, 0.1), (2, NAN), (3, None), (4, 0.9)], "id int, p double")
    got = {r["id"]: (r["model_prob"], r["risk_score"], r["risk_level"]) for r in composite_risk(df, "p").collect()}
    assert got[2] == got[3] == (None, None, None)
    assert got[1][0] == 0.1 and got[1][2] == "low" and got[4][2] == "high"


def test_missing_anomaly_scores_leave_the_others_alone(spark):
    rows = [(1, 0.4, -0.2), (2, 0.4, -0.6), (3, 0.4, NAN), (4, 0.4, None)]
    df = spark.createDataFrame(rows, "id int, p double, a double")
    got = {r["id"]: r["risk_score"] for r in composite_risk(df, "p", "a").collect()}
    assert got[3] == got[4] == pytest.approx(0.9 * 0.4)
    assert got[1] == pytest.approx(0.65 * 0.4) and got[2] == pytest.approx(0.65 * 0.4 + 0.25)
    bounds, _ = fitted_bounds(df, "a")
    assert bounds == {"__a_lo": 0.2, "__a_hi": 0.6}
    even = spark.createDataFrame([(1, 0.4, -0.5), (2, 0.4, -0.5), (3, 0.4, None)], "id int, p double, a double")
    got = {r["id"]: r["risk_score"] for r in composite_risk(even, "p", "a").collect()}
    assert got[3] == pytest.approx(0.36) and got[1] == pytest.approx(0.26)


def test_minmax_of_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (NAN,), (None,)], "`a.b` double")
    assert [r[1] for r in minmax(df, "a.b", "n").orderBy("n").collect()] == [None, None, 0.0, 1.0]
    flat = minmax(spark.createDataFrame([(2.0,), (None,), (2.0,)], "v double"), "v").collect()
    assert [r["v_norm"] for r in flat] == [0.0, None, 0.0]


def test_summary_of_nothing_and_of_missing_scores(spark):
    none = risk_summary(spark.createDataFrame([], "risk_score double")).first()
    assert none["n_samples"] == 0 and none["mean_risk"] is None and none["high_risk_pct"] is None and none["high_risk_count"] == 0
    some = risk_summary(spark.createDataFrame([(0.2,), (NAN,), (None,), (0.8,)], "risk_score double")).first()
    assert some["n_samples"] == 2 and some["mean_risk"] == 0.5 and some["pct_low"] == 50.0 and some["n_high"] == 1


def test_nan_scores_are_no_scores(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, NAN), (0, None), (1, 0.4), (0, 0.5)], "label int, score double")
    assert ev.roc_auc(df).first()[0] == 0.75
    assert ev.ranking_metrics(df).first()["average_precision"] == pytest.approx(1 / 2 + 1 / 3)


def _dotted(spark):
    rows = [(i, float(i % 50) + (1000 if i == 7 else 0), ["u", "v", "w"][i % 3], f"2024-01-{1 + i % 28:02d}", None if i % 9 == 0 else i / 3, i % 2)
            for i in range(200)]
    return spark.createDataFrame(rows, "`id.k` long, `c.x` double, `c.t` string, `c.d` string, `c.n` double, `la.bel` int")


def test_dotted_names_in_every_operator(spark):
    df = _dotted(spark)
    assert column_quantiles(df, ["c.x"], [0.5])["c.x"][0] == pytest.approx(24.5, abs=1)
    assert len(quantiles(df, ["c.x"], [0.5], ["c.t"])) == 3
    assert len(quantiles(df, ["c.x"], [0.5], ["c.t"], mode="approx")) == 3
    assert {r["issue"] for r in pr.validate(df.withColumn("o.ne", F.lit(1))).collect()} == {"constant"}
    assert [r["column_name"] for r in pr.constant_flags(df.withColumn("o'ne.x", F.lit(1))).where("is_constant").collect()] == ["o'ne.x"]
    assert pr.profile_missing(df).where("column_name = 'c.n'").first()["missing_pct"] > 0.1
    assert pr.class_distribution(df, "la.bel").count() == 2
    assert pr.preview(df, 3).count() == 3
    for out in (pp.clip_iqr(df, ["c.x"]), pp.impute(df, ["c.n"]), pp.impute(df, ["c.n"], "mean"), pp.impute(df, ["c.n"], "most_frequent"),
                pp.scale(df, ["c.x"], "robust"), pp.scale(df, ["c.x"], "minmax"), pp.null_zscore(df, ["c.x"]), pp.drop_constant(df)[0]):
        assert out.columns == df.columns and out.count() == 200
    assert pp.clip_iqr(df, ["c.x"]).agg(F.max("`c.x`")).first()[0] < 200
    assert pp.assign_split(df, ["id.k"], stratify="la.bel").groupBy("split").count().count() == 3
    assert ev.assign_folds(df, ["id.k"], 4, label="la.bel").groupBy("fold").count().count() == 4
    for p in (Params(), Params(outlier_method="zscore", scaling="robust", imputation="most_frequent")):
        model = Prep(p).fit(df, target="la.bel", keys=["id.k"])
        frame = model.fitted_frame()
        assert "c.x" in model.feature_names
        assert frame.count() == 200 and model.transform(df).count() == 200
        assert set(model.feature_names) <= set(frame.columns)


def test_dotted_names_in_models(spark):
    from riskflow.operators import models as mo
    rows = [(i, float(i % 2), ["train", "train", "train", "val"][i // 2 % 4], float(i % 2) + i % 7 / 10, float(i % 5)) for i in range(160)]
    df = spark.createDataFrame(rows, "`i.d` long, label double, split string, `a.x` double, b double").withColumnRenamed("i.d", "id")
    p = Params(gbt_rounds=3, gbt_depth=2, rf_trees=3, rf_depth=3, lr_max_iter=10, if_trees=5, cv_folds=2)
    m = mo.train(df, ["a.x", "b"], ["id"], p)
    assert set(m.models) == {"random_forest", "gradient_boosting", "logistic_regression"}, m.results
    assert all(mo.predict(model, df).count() == 160 for model in m.models.values())
    assert m.predict(df).count() == 160


def test_csv_line_breaks_and_truth_words(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    with open(path, "w") as f:
        f.write('n,text,flag,gap,word\n1,"x\ny ""z"", w",True,True,true\n2,plain,False,,yes\n3,"a,b",TRUE,False,false\n')
    df = readers.read_table(spark, path)
    assert dict(df.dtypes) == {"n": "bigint", "text": "string", "flag": "boolean", "gap": "string", "word": "string"}
    got = {r["n"]: (r["text"], r["flag"], r["gap"]) for r in df.collect()}
    assert got == {1: ('x\ny "z", w', True, "True"), 2: ("plain", False, None), 3: ("a,b", True, "False")}
    from riskflow.plans import jobs
    assert jobs.ingest(spark, path).df.count() == 3
    flat = str(tmp_path / "b.csv")
    with open(flat, "w") as f:
        f.write('n,text\n1,"a ""b"" c"\n2,d\n')
    assert not readers.open_quotes(spark, flat) and readers.open_quotes(spark, path)
    assert readers.read_csv(spark, flat).count() == 2


def test_order_of_a_long_first_record(spark, tmp_path):
    path = str(tmp_path / "a.jsonl")
    with open(path, "w") as f:
        f.write('{"z": "' + "x" * 3_000_000 + '", "a": 1, "m": 2}\n{"z": "y", "a": 2, "m": 3}\n')
    assert readers.read_json(spark, path).columns == ["z", "a", "m"]


@pytest.mark.parametrize("bits, step, numbered", [(52, 12, 4096), (52, 12, 3), (9, 3, 1), (6, 2, 1)])
def test_cuts_of_groups_are_order_statistics(spark, bits, step, numbered):
    rows = [(None if g == 5 else g, hash((g, i)) % (1 << bits) if bits > 10 else (g * 7 + i * i) % (1 << bits)) for g in range(9) for i in range(g * g * 3 + 1)]
    df = spark.createDataFrame(rows, "g int, h long").repartition(4)

    def ranks(n):
        return [F.ceil(n * 0.2) - 1, n - 1, F.lit(-1), F.floor(n / 2)]
    got = {r["g"]: r["cuts"] for r in gc.cuts_by_group(df, ranks, bits, step, numbered).collect()}
    by: dict = {}
    for g, h in rows:
        by.setdefault(g, []).append(h)
    want = {}
    for g, hs in by.items():
        hs.sort()
        n = len(hs)
        want[g] = [hs[math.ceil(n * 0.2) - 1], hs[-1], -1, hs[n // 2]]
    assert got == want


def test_plan_does_not_grow_with_the_classes(spark):
    sizes = []
    for classes in (3, 3000):
        df = spark.range(6000).selectExpr("id", f"id % {classes} as label")
        sizes.append(len(pp.assign_split(df, ["id"], stratify="label")._jdf.queryExecution().optimizedPlan().toString()))
    assert sizes[1] < 1.2 * sizes[0]
