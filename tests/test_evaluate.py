"""Evaluation against brute force (numpy) and hand-worked cases."""

import numpy as np
import pytest

import riskflow.operators.evaluate as ev


def _auc_brute(y, s):
    pos, neg = s[y == 1], s[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return gt / (len(pos) * len(neg))


def _ap_brute(y, s):
    order = np.argsort(-s, kind="stable")
    ap, prev_r, P = 0.0, 0.0, y.sum()
    for t in sorted(set(s), reverse=True):
        sel = s >= t
        tp, fp = (y[sel] == 1).sum(), (y[sel] == 0).sum()
        r = tp / P
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    del order
    return ap


@pytest.mark.parametrize("range_rows", [200_000, 37])
def test_auc_ap_brute_force(spark, monkeypatch, range_rows):
    monkeypatch.setattr(ev, "_RANGE_ROWS", range_rows)      # 37 forces many ranges and offsets
    rng = np.random.default_rng(5)
    s = np.round(rng.random(800), 2)                        # many ties
    y = (rng.random(800) < 0.2 + 0.6 * s).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    assert ev.roc_auc(df).first()[0] == pytest.approx(_auc_brute(y, s), abs=1e-12)
    assert ev.average_precision(df).first()[0] == pytest.approx(_ap_brute(y, s), abs=1e-12)


def test_ap_six_rows_not_trapezoid(spark):
    y = [0, 0, 1, 1, 0, 1]
    s = [0.1, 0.4, 0.35, 0.8, 0.5, 0.2]
    df = spark.createDataFrame(list(zip(y, s)), "label int, score double")
    got = ev.average_precision(df).first()[0]
    assert got == pytest.approx(_ap_brute(np.array(y), np.array(s)))


def test_g11_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 0), (0, 0)], "label int, prediction int")
    pc = {r["class"]: r for r in ev.per_class(df).collect()}
    assert pc[1]["precision"] == 0.0 and pc[1]["recall"] == 0.0 and pc[1]["f1"] == 0.0
    m = ev.weighted_metrics(df).first()
    assert m["accuracy"] == 0.5 and m["precision"] == pytest.approx(0.25)
    cm = {(r["actual"], r["predicted"]): r["n"] for r in ev.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 2, (0, 1): 0, (1, 0): 2, (1, 1): 0}


def test_folds_stratified_sizes(spark):
    df = spark.range(1000).selectExpr("id as k", "cast(id % 4 = 0 as int) as y")
    out = ev.assign_folds(df, ["k"], 5, 42, label="y")
    counts = {(r["y"], r["fold"]): r["count"] for r in out.groupBy("y", "fold").count().collect()}
    for y in (0, 1):
        sizes = [counts[(y, f)] for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    w = {r["label"]: r["weight"] for r in ev.class_weights(df).collect()}
    assert w == {0: 8 / (2 * 6), 1: 8 / (2 * 2)}


def test_select_best_ties_first(spark):
    m = spark.createDataFrame([("a", 0, 0.5), ("b", 1, 0.7), ("c", 2, 0.7)], "model string, position int, f1 double")
    assert ev.select_best(m).first()["model"] == "b"
