import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from riskflow.llm import hard_negatives as h

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                       T.StructField("id", T.StringType()), T.StructField("v", T.StringType()), T.StructField("score", T.StringType())])


def whole(x):
    if x is None or any(c is None or not math.isfinite(c) for c in x):
        return None
    y = [math.floor(256 * float(np.float32(c))) for c in x]
    return y if sum(c * c for c in y) < 2 ** 51 else None


def brute(rows, positives=5, negatives=5):
    data = [(i, label, whole(x)) for i, x, label, *_ in rows if label is not None]
    data = [d for d in data if d[2] is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    last = lambda i: (i is None, i or 0)
    out = Counter()
    for a_id, a_label, a in data:
        if a_id is None or a_id % 100:
            continue
        scored = sorted(((-dot(a, v), last(i), i, label) for i, label, v in data), key=lambda r: r[:2])
        for s, _, p_id, _ in [r for r in scored if r[3] == a_label and r[2] != a_id][:positives]:
            fit = [r for r in scored if r[3] != a_label and 80 * -s <= 100 * -r[0] <= 100 * -s][:negatives]
            out.update((a_id, p_id, k + 1, r[2], -s, -r[0]) for k, r in enumerate(fit))
    return out


def data(seed, n=700, dim=20):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [x + rng.gauss(0, 0.15) for x in c], rng.randrange(3)))
    for i in range(150, 380):
        rows[i] = (i, rows[200][1], rows[i][2])                      # one vector many times, with ties
    rows[5] = (5, None, 1)
    rows[6] = (6, [], 1)
    rows[7] = (7, [1.0, None] + [0.0] * 18, 1)
    rows[8] = (8, [float("nan")] * dim, 1)
    rows[9] = (9, [float("inf")] + [0.0] * 19, 2)
    rows[10] = (10, [3e38] * dim, 2)
    rows[11] = (11, rows[0][1], None)
    rows[12] = (None, rows[0][1], rows[0][2])
    rows[13] = (None, rows[0][1], rows[0][2] + 1)
    rows[100] = (100, rows[100][1][:7], 1)                           # an anchor of another length
    rows[14] = (14, rows[100][1][:3] + rows[100][1], 1)
    rows += [rows[300], rows[300], (400, rows[401][1], 2), (0, [0.0] * dim, 0)]    # repeated rows, ids, an anchor without length
    return [r + ("x", "y", "z") for r in rows]


def result(spark, rows, parts=5, **kw):
    stored = h.store(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    return Counter(tuple(r) for r in h.mine(stored, stored.where("id % 100 = 0"), **kw).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = data(seed)
    assert result(spark, rows) == brute(rows)
    assert result(spark, rows, parts=1, positives=2, negatives=7) == brute(rows, 2, 7)


def test_many_waves_and_small_tiles_change_nothing(spark, monkeypatch):
    rows = data(3)
    monkeypatch.setattr(h, "WAVE_BYTES", 4000)
    assert result(spark, rows) == brute(rows)


def test_enclosures_hold_and_drop_pairs():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 300, (12, 64)).repeat(1, axis=1)
    v = np.floor(centres[rng.integers(0, 12, 600)] + rng.normal(0, 20, (600, 64)))
    rows = h.Vectors(np.arange(600), np.zeros(600, np.int64), v, *map(list, zip(*(h.summaries(v, d) for d in h.DEPTHS))))
    a, exact = rows[np.arange(40)], v[:40] @ v.T
    for k in range(len(h.DEPTHS)):
        lower, upper = h.enclosure(a, rows, k)
        assert (lower <= exact).all() and (exact <= upper).all()
    low, high = np.sort(exact, axis=1)[:, -20], np.full(40, np.inf)
    seen: list[int] = []
    got = h.open_scores(a, rows, np.ones(exact.shape, bool), low, high, seen)
    assert seen == sorted(seen, reverse=True) and seen[-1] < 0.3 * seen[0]
    needed = exact >= low[:, None]
    assert (got[needed] == exact[needed]).all()
    middle = np.partition(exact, 300, axis=1)[:, 300]
    got = h.open_scores(a, rows, np.ones(exact.shape, bool), middle, middle + 9000)
    needed = (exact >= middle[:, None]) & (exact <= middle[:, None] + 9000)
    assert (got[needed] == exact[needed]).all() and (got == h.NO_SCORE).any()


def test_query_labels_and_empty_tables(spark):
    rows = data(5)
    moved = [(i, x, label if label is None or i is None or i % 7 else (label + 1) % 10) + tuple(r) for i, x, label, *r in rows]
    stored = h.store(h.relabelled(spark.createDataFrame(rows, SCHEMA)))
    assert Counter(tuple(r) for r in h.mine(stored, stored.where(F.col("id") % 100 == 0)).collect()) == brute(moved)
    for few in ([], rows[5:6], rows[1:4]):
        assert result(spark, few, parts=2) == Counter()
