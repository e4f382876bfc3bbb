"""Versioned stores, the streaming digest, and streams over several files that die and start again."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from riskflow.operators import models as mo
from riskflow.operators.iforest import IsolationForest
from riskflow.operators.prep import Prep, PrepModel
from riskflow.operators.risk import composite_risk, fitted_bounds
from riskflow.params import Params
from riskflow.sources import readers
from riskflow.sources.store import Store
from riskflow.streaming.score_stream import composite_stream, file_stream, read_scored


def _write(spark, value):
    return lambda folder: spark.range(value).write.parquet(f"{folder}/rows")


def test_manifest_is_the_commit_point(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError):
        store.folder()
    assert store.save(_write(spark, 3)) == 1 and store.save(_write(spark, 5)) == 2

    def dies(folder):
        spark.range(9).write.parquet(f"{folder}/rows")
        raise RuntimeError("lost")
    with pytest.raises(RuntimeError):
        store.save(dies)

    def rows(v=None):
        return spark.read.parquet(store.folder(v) + "/rows").count()
    assert store.versions() == [1, 2] and rows() == 5 and rows(1) == 3
    with pytest.raises(FileNotFoundError):
        store.folder(7)
    assert store.prune(keep=1) == [1] and store.versions() == [2] and rows() == 5
    assert len(os.listdir(tmp_path / "s" / "versions")) == 1
    assert store.save(_write(spark, 7)) == 3 and rows() == 7


def test_writers_at_the_same_time_get_numbers_of_their_own(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    real, late = store.versions, [True]

    def stale():                      # the first look misses a version that another writer commits meanwhile
        if late:
            late.clear()
            Store(spark, store.root)._commit({"id": "other"})
            return []
        return real()
    store.versions = stale
    assert store.save(_write(spark, 2)) == 2 and real() == [1, 2]


def test_a_save_that_dies_between_two_models_keeps_the_old_ones(spark, tmp_path, monkeypatch):
    rows = [(i, float(i % 2), ["train", "train", "train", "val"][i // 2 % 4], float(i % 2) + i % 7 / 10, float(i % 5)) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, label double, split string, a double, b double")
    p = Params(gbt_rounds=2, gbt_depth=2, rf_trees=2, rf_depth=2, lr_max_iter=5, if_trees=5)
    models = mo.train(df, ["a", "b"], ["id"], p, cv=False)
    path = str(tmp_path / "m")
    assert models.save(path) == 1
    before = [r["risk_prob"] for r in mo.RiskModels.load(spark, path).predict(df).orderBy("id").collect()]
    again = mo.train(df, ["a", "b"], ["id"], p.with_(gbt_rounds=3, seed=1), cv=False)
    with monkeypatch.context() as m:
        m.setattr(mo.BoostedTrees, "save", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            again.save(path)
    assert [r["risk_prob"] for r in mo.RiskModels.load(spark, path).predict(df).orderBy("id").collect()] == before
    assert again.save(path) == 2
    assert [r["risk_prob"] for r in mo.RiskModels.load(spark, path, version=1).predict(df).orderBy("id").collect()] == before
    report = models.report_frame(spark)
    assert {r["model"] for r in report.where("is_best").collect()} == {models.best}
    assert report.where("part = 'validation' and measure = 'f1'").count() == 3


def test_prep_versions_and_older_folders(spark, tmp_path):
    df = spark.createDataFrame([(i, i * 1.5, "ab"[i % 2], i % 2) for i in range(40)], "id long, x double, c string, label int")
    model = Prep().fit(df, "label", ["id"])
    want = model.transform(df).orderBy("id").collect()
    path = str(tmp_path / "p")
    assert model.save(path) == 1 and PrepModel.load(spark, path).transform(df).orderBy("id").collect() == want
    model._write(str(tmp_path / "old"))           # as saved before there were versions
    assert PrepModel.load(spark, str(tmp_path / "old")).transform(df).orderBy("id").collect() == want


def test_digest_of_a_file_longer_than_a_row(spark, tmp_path):
    big, small = tmp_path / "d" / "big.bin", tmp_path / "d" / "small.bin"
    os.makedirs(tmp_path / "d")
    with open(big, "wb") as f:
        f.seek((2 << 30) + 12345)     # a hole: nothing of it takes up disk
        f.write(b"end")
    small.write_bytes(b"abc")
    want = hashlib.sha256()
    with open(big, "rb") as f:
        while piece := f.read(1 << 22):
            want.update(piece)
    got = {os.path.basename(r["path"]): r["sha256"] for r in readers.fingerprint(spark, str(tmp_path / "d")).collect()}
    assert got == {"big.bin": want.hexdigest(), "small.bin": hashlib.sha256(b"abc").hexdigest()}


def _scored(spark, n=300):
    return spark.createDataFrame([(i, (i * 37 % 100) / 100.0, -((i * 13) % 50) / 10.0, 10.0 + i % 17 / 10, 20.0 + i % 13 / 10,
                                   1_700_000_000 + i * 60) for i in range(n)],
                                 "id long, p double, a double, la double, lo double, s long").withColumn("t", F.timestamp_seconds("s"))


def _land(df, landing, k):
    df.where(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(landing)


def test_stream_dies_between_write_and_commit_and_goes_on(spark, tmp_path, monkeypatch):
    from riskflow.streaming import score_stream as ss
    df, landing, sink, checkpoint = _scored(spark), *(str(tmp_path / x) for x in ("in", "out", "check"))
    bounds, field = fitted_bounds(df, "a", "la", "lo", "t")
    for k in range(3):
        _land(df, landing, k)
    real, calls = ss.composite_risk, []

    def start():
        return composite_stream(file_stream(spark, landing, df.schema), sink, "p", "a", "la", "lo", "t", Params(), bounds, field, checkpoint=checkpoint)

    class Dies:
        """Writes the batch in full, then fails before the stream can commit it."""
        def __init__(self, frame):
            self.write = self
            self.frame = frame

        def mode(self, how):
            return self

        def parquet(self, path):
            self.frame.write.mode("overwrite").parquet(path)
            raise RuntimeError("lost between write and commit")

    def second_dies(batch, *a, **kw):
        calls.append(1)
        out = real(batch, *a, **kw)
        return Dies(out) if len(calls) == 2 else out
    monkeypatch.setattr(ss, "composite_risk", second_dies)
    with pytest.raises(Exception, match="lost between write and commit"):
        start().awaitTermination()
    assert read_scored(spark, sink).count() == 200                  # written, not committed
    start().awaitTermination()
    assert len(calls) == 4                                          # the second batch ran again
    got = {r["id"]: r["risk_score"] for r in read_scored(spark, sink).collect()}
    want = {r["id"]: r["risk_score"] for r in composite_risk(df, "p", "a", "la", "lo", "t", bounds=bounds, field=field).collect()}
    assert read_scored(spark, sink).count() == 300 and got == pytest.approx(want, abs=1e-12)
    _land(df.withColumn("id", F.col("id") + 300), landing, 0)      # a file that comes later
    start().awaitTermination()
    assert read_scored(spark, sink).count() == 400


def test_running_bounds_follow_the_rows_seen(spark, tmp_path):
    df = _scored(spark, 90).withColumn("id", F.col("id"))
    landing, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    seen = None
    for k in range(3):
        _land(df, landing, k)
        composite_stream(file_stream(spark, landing, df.schema), sink, "p", "a", ts="t", running=True, checkpoint=checkpoint).awaitTermination()
        part = df.where(F.col("id") % 3 == k)
        seen = part if seen is None else seen.union(part)
        bounds, _ = fitted_bounds(seen, "a", ts="t")
        want = {r["id"]: r["risk_score"] for r in composite_risk(part, "p", "a", ts="t", bounds=bounds).collect()}
        got = {r["id"]: r["risk_score"] for r in read_scored(spark, sink).where(F.col("batch_id") == k).collect()}
        assert got == pytest.approx(want, abs=1e-12)
    from riskflow.streaming.score_stream import RunningBounds
    state = RunningBounds(spark, sink + "/_state")
    assert state.after(2, {"__a_lo": 0.0}) == state.before(3)      # run again: the same bounds
    with pytest.raises(ValueError):
        composite_stream(file_stream(spark, landing, df.schema), sink, "p", lat="la", lon="lo", running=True)
    with pytest.raises(FileNotFoundError):
        read_scored(spark, str(tmp_path / "none"))


def test_forest_store(spark, tmp_path):
    df = _scored(spark, 100)
    forest = IsolationForest(Params(if_trees=10)).fit(df, ["p", "la"], ["id"]).fit_offset(df, 0.1)
    models = mo.RiskModels({}, {}, None, ["p", "la"], forest, [])
    models.save(str(tmp_path / "f"))
    again = mo.RiskModels.load(spark, str(tmp_path / "f"))
    assert again.predict(df).orderBy("id").collect() == models.predict(df).orderBy("id").collect()


def test_scored_rows_as_files(spark, tmp_path):
    df = _scored(spark, 20).select("id", "p")
    for fmt, read in (("parquet", spark.read.parquet), ("json", spark.read.json), ("csv", lambda f: readers.read_csv(spark, f))):
        readers.write_scored(df, str(tmp_path / fmt), fmt)
        assert sorted((r["id"], r["p"]) for r in read(str(tmp_path / fmt)).collect()) == sorted((r["id"], r["p"]) for r in df.collect())
    with pytest.raises(ValueError):
        readers.write_scored(df, str(tmp_path / "x"), "xlsx")
