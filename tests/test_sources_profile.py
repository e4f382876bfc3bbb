"""Readers (S1-S5, S10), profiling and validation (P1-P10, FIXTURES F3, F5, G1)."""

import hashlib
import json

import pytest

from riskflow.operators import profile as pr
from riskflow.sources import readers as rd


def test_csv_na_tokens_and_types(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("latitude,longitude,label,name,t\n1.5,36,1,a,NA\n,37,0,b,2\nnan,38,1,N/A,3\n")
    df = rd.read_table(spark, str(p))
    types = dict(df.dtypes)
    assert types["latitude"] == "double" and types["longitude"] == "bigint" and types["t"] == "bigint"
    rows = df.orderBy("longitude").collect()
    assert rows[1]["latitude"] is None and rows[2]["name"] is None and rows[0]["t"] is None


def test_json_array_and_lines(spark, tmp_path):
    recs = [{"lat": 7.5, "lon": -3.25, "val": i * i, "label": i % 2} for i in range(60)]
    p = tmp_path / "r.json"
    p.write_text(json.dumps(recs))
    df = rd.read_table(spark, str(p))
    assert df.count() == 60
    q = tmp_path / "r.jsonl"
    q.write_text("\n".join(json.dumps(r) for r in recs))
    assert rd.read_table(spark, str(q)).count() == 60
    # lat / lon constant -> dropped before features, so no geo features appear
    from riskflow.operators.prep import Prep
    from riskflow.params import Params
    m = Prep(Params()).fit(df, "label")
    assert m.feature_names == ["val"]


def test_geojson_g1(spark, tmp_path):
    gj = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [36.5, 1.25]}, "properties": {"a": 1}},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]},
         "properties": {"a": 2, "b": "x"}},
        {"type": "Feature", "geometry": None, "properties": {"a": 3}}]}
    p = tmp_path / "g.geojson"
    p.write_text(json.dumps(gj))
    rows = sorted(rd.read_table(spark, str(p)).collect(), key=lambda r: r["a"])
    assert (rows[0]["longitude"], rows[0]["latitude"]) == (36.5, 1.25)
    assert rows[1]["longitude"] is None and rows[1]["b"] == "x" and rows[2]["latitude"] is None


def test_unsupported_suffix(spark, tmp_path):
    with pytest.raises(ValueError, match="no reader"):
        rd.read_table(spark, str(tmp_path / "data.txt"))


def test_fingerprint(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_bytes(b"col1,col2\n1,2\n")
    r = rd.fingerprint(spark, str(p)).first()
    assert r["sha256"] == hashlib.sha256(b"col1,col2\n1,2\n").hexdigest()


def test_validate_f5_and_empty(spark):
    df = spark.range(50).selectExpr("id as a", "id as b")
    assert pr.validate(df).count() == 0
    empty = spark.createDataFrame([], "a long")
    assert [r["issue"] for r in pr.validate(empty).collect()] == ["empty"]
    few = spark.createDataFrame([(1, None), (2, None), (2, None)], "a long, b double")
    issues = {r["issue"]: r for r in pr.validate(few).collect()}
    assert set(issues) == {"too_few_rows", "high_missing", "duplicates", "constant"}
    assert issues["duplicates"]["n"] == 1 and issues["constant"]["columns"] == "b"


def test_infer_roles():
    cols = ["latitude", "longitude", "temperature", "label"]
    assert pr.infer_target(cols) == "label" and pr.infer_coords(cols) == ("latitude", "longitude")
    assert pr.infer_target(["x", "y"]) == "y" and pr.infer_coords(["x", "y"], "y") == (None, "x")
    assert pr.infer_target(["a", "Target"]) == "Target"


def test_profile_and_preview(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 2.0, None)], "k long, x double, s string")
    m = {r["column_name"]: r["missing_pct"] for r in pr.profile_missing(df).collect()}
    assert m == {"k": 0.0, "x": 0.5, "s": 0.5}
    sch = pr.profile_schema(df).collect()
    assert [(r["column_name"], r["dtype"], r["n_rows"], r["n_cols"]) for r in sch] == [
        ("k", "bigint", 2, 3), ("x", "double", 2, 3), ("s", "string", 2, 3)]
    assert pr.preview(df, 5, ["k"]).collect()[0]["x"] == ""
    dist = {r["label"]: r["share"] for r in pr.class_distribution(df.withColumnRenamed("k", "label"), "label").collect()}
    assert dist == {1: 0.5, 2: 0.5}


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('a,b,c\n"say ""hi"", you",2,x\n"two\nlines",3,"y,z"\n')
    rows = rd.read_csv(spark, str(p), multi_line=True).orderBy("b").collect()
    assert [tuple(r) for r in rows] == [('say "hi", you', 2, "x"), ("two\nlines", 3, "y,z")]
    q = tmp_path / "s.csv"
    q.write_text('a,b\n"x ""y"", z",2\n')
    assert tuple(rd.read_table(spark, str(q)).first()) == ('x "y", z', 2)


def test_json_keeps_file_order_and_converts(spark, tmp_path):
    recs = [{"zeta": "12", "target": 1, "label": 0, "created_at": "2024-03-01 10:00:00", "date": 1_700_000_000, "note": "x1"},
            {"zeta": "7", "target": 0, "label": 1, "created_at": None, "date": 1_700_000_060, "note": "2", "extra": 1.5}]
    for name, text in (("r.json", json.dumps(recs)), ("r.jsonl", "\n".join(map(json.dumps, recs)))):
        (tmp_path / name).write_text(text)
        df = rd.read_table(spark, str(tmp_path / name))
        assert df.columns == ["zeta", "target", "label", "created_at", "date", "note", "extra"]
        types = dict(df.dtypes)
        assert types["zeta"] == "bigint" and types["created_at"] == types["date"] == "timestamp" and types["note"] == "string"
        assert pr.infer_target(df.columns) == "target"
        assert df.selectExpr("unix_timestamp(date) as s").orderBy("s").first()["s"] == 1_700_000_000


def test_geojson_property_named_like_a_coordinate(spark, tmp_path):
    feats = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}, "properties": {"latitude": 9, "k": 1}},
             {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, "properties": {"latitude": 8, "k": 2}}]
    (tmp_path / "g.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    (tmp_path / "g.geojsonl").write_text("\n".join(map(json.dumps, feats)))
    for name in ("g.geojson", "g.geojsonl"):
        rows = rd.read_table(spark, str(tmp_path / name)).orderBy("k").collect()
        assert [(r["latitude"], r["longitude"]) for r in rows] == [(2.5, 1.5), (8.0, None)]
