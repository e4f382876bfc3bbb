"""Model, forest, scoring and source queries. The forest's draws are hashes, so its score and flag have a SQL oracle; the
classifiers are iterative and have none (rows-only check): the tests check them by brute force or their properties.

The prepared geo_events frame (J2) feeds the models, with the service defaults of `Params()`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow.operators import models as mo
from riskflow.operators.iforest import IsolationForest, forest_sql
from riskflow.params import Params
from riskflow.plans import jobs
from riskflow.plans.fixtures import frame, with_frames
from riskflow.plans.q_prep import CHAIN_FEATURES, _chain_ctes, _hash_sql
from riskflow.plans.registry import DIGITS, query
from riskflow.session import configure, scratch_path
from riskflow.sources.readers import read_geojson

QP = Params()
KEYS = ["event_id"]
_CACHE: dict = {}


def fitted(spark, sf_dir, p: Params = QP):
    """(prep model, prepared frame, trained models) for geo_events, once per session and scale."""
    configure(spark)
    k = (id(spark.sparkContext), sf_dir, repr(p))
    if k not in _CACHE:
        prep_model, fr = prepared(spark, sf_dir, p)
        models = mo.train(fr, prep_model.feature_names, KEYS, p, cv=False)
        _CACHE[k] = (prep_model, fr, models)
    return _CACHE[k]


def prepared(spark, sf_dir, p: Params = QP):
    """(prep model, prepared frame) for geo_events, once per session and scale."""
    configure(spark)
    k = (id(spark.sparkContext), sf_dir, repr(p), "prep")
    if k not in _CACHE:
        _CACHE[k] = jobs.prepare(frame(spark, sf_dir, "geo_events"), "label", KEYS, p)
    return _CACHE[k]


def _test_predictions(spark, sf_dir, name):
    prep_model, fr, models = fitted(spark, sf_dir)
    test = fr.where(F.col("split") == "test")
    pred = mo.predict(models.models[name], test)
    return pred.select("event_id", F.col("label").cast("int").alias("label"),
                       F.col("prediction").cast("int").alias("prediction"), "risk_prob")


@query("random_forest")
def q_random_forest(spark, sf_dir):
    return _test_predictions(spark, sf_dir, "random_forest")


@query("gradient_boosting")
def q_gradient_boosting(spark, sf_dir):
    return _test_predictions(spark, sf_dir, "gradient_boosting")


@query("logistic_regression")
def q_logistic_regression(spark, sf_dir):
    return _test_predictions(spark, sf_dir, "logistic_regression")


def _folds(spark, sf_dir, p: Params = QP) -> dict[str, dict]:
    """The cross-validation metrics of every model, once per session and scale; the models themselves are not fitted."""
    configure(spark)
    k = (id(spark.sparkContext), sf_dir, repr(p), "folds")
    if k not in _CACHE:
        prep_model, fr = prepared(spark, sf_dir, p)
        _CACHE[k] = mo.cross_validate_models(fr, prep_model.feature_names, KEYS, p)
    return _CACHE[k]


@query("cross_validate")
def q_cross_validate(spark, sf_dir):
    rows = [(n, k, float(v)) for n, m in _folds(spark, sf_dir).items() for k, v in m.items() if isinstance(v, (int, float))]
    return spark.createDataFrame(rows, "model string, metric string, value double")


@query("feature_importance")
def q_feature_importance(spark, sf_dir):
    _, _, models = fitted(spark, sf_dir)
    name = models.best
    return mo.importance_frame(spark, models.results[name]["feature_importance"]) \
             .withColumn("model", F.lit(name))


def _forest(spark, sf_dir):
    configure(spark)
    k = (id(spark.sparkContext), sf_dir, "forest")
    if k not in _CACHE:
        prep_model, fr = prepared(spark, sf_dir)
        train = fr.where(F.col("split") == "train")
        forest = IsolationForest(QP).fit(train, prep_model.feature_names, KEYS)
        forest.fit_offset(train, QP.if_contamination, QP.quantiles)
        _CACHE[k] = (prep_model, fr, forest)
    return _CACHE[k]


def _forest_oracle(select: str) -> str:
    """DuckDB text: the prepared rows, then the forest as unrolled levels over them."""
    scaled = ", ".join(f"(({c} - m_{c}) / case when s_{c} = 0 then 1e0 else s_{c} end) as {c}" for c in CHAIN_FEATURES)
    bucket = f"{_hash_sql('event_id')} % 1000"
    rows = f"""prepared as (
  select event_id, {scaled}, case when {bucket} < 200 then 'test' when {bucket} < 300 then 'val' else 'train' end as split from filled, st)"""
    body = f"{_chain_ctes().strip()},\n{rows},\n{forest_sql('prepared', CHAIN_FEATURES, 'event_id', QP)}\n{select}"
    return with_frames(["geo_events"], "with " + body).replace("\nwith ", ",\n", 1)


@query("isolation_forest_score", _forest_oracle("select key as event_id, round(score, 6) as anomaly_score from forest_scores"))
def q_isolation_forest_score(spark, sf_dir):
    _, fr, forest = _forest(spark, sf_dir)
    scored = forest.score(fr.select("event_id", *forest.features))
    return scored.select("event_id", F.round("anomaly_score", DIGITS).alias("anomaly_score"))


@query("isolation_forest_flag", _forest_oracle("""select key as event_id, round(score, 6) as anomaly_score, score < cut as anomaly_flag
from forest_scores, forest_offset"""))
def q_isolation_forest_flag(spark, sf_dir):
    _, fr, forest = _forest(spark, sf_dir)
    flagged = forest.flag(fr.select("event_id", *forest.features))
    return flagged.select("event_id", F.round("anomaly_score", DIGITS).alias("anomaly_score"), "anomaly_flag")


@query("model_store", _forest_oracle("""select key as event_id, round(score, 6) as anomaly_score, score < cut as anomaly_flag
from forest_scores, forest_offset"""))
def q_model_store(spark, sf_dir):
    """The fitted forest is saved as a version of the model store, loaded again and applied."""
    prep_model, fr, forest = _forest(spark, sf_dir)
    path = scratch_path(spark, "model-store")
    models = mo.RiskModels({}, {}, None, prep_model.feature_names, forest, [])
    again = mo.RiskModels.load(spark, path, version=models.save(path))
    out = again.predict(fr.select("event_id", *forest.features))
    return out.select("event_id", F.round("anomaly_score", DIGITS).alias("anomaly_score"), "anomaly_flag")


@query("file_fingerprint", """
select o_orderpriority, sha256(string_agg(o_orderkey || '|' || o_orderstatus || chr(10), '' order by o_orderkey)) as sha256,
  sha256(string_agg(o_orderkey || '|' || o_orderstatus || chr(10), '' order by o_orderkey)) as streamed_sha256
from orders group by o_orderpriority""")
def q_file_fingerprint(spark, sf_dir):
    """One file an order priority, digested by tasks and, as files too long for a row are, through the file system's stream."""
    from riskflow.plans.fixtures import table
    from riskflow.sources.readers import fingerprint
    configure(spark)
    path = scratch_path(spark, "fingerprint")
    lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.concat_ws("|", "o_orderkey", "o_orderstatus").alias("value"))
    files = lines.repartition("o_orderpriority").sortWithinPartitions("o_orderpriority", "o_orderkey").drop("o_orderkey")
    files.write.partitionBy("o_orderpriority").text(path)
    both = fingerprint(spark, path).join(fingerprint(spark, path, streamed_above=0).withColumnRenamed("sha256", "streamed_sha256"), "path")
    name = F.url_decode(F.regexp_extract("path", "o_orderpriority=([^/]*)/", 1))
    return both.select(F.url_decode(name).alias("o_orderpriority"), "sha256", "streamed_sha256")


@query("training_report")
def q_training_report(spark, sf_dir):
    """Every model's measures as a table."""
    return fitted(spark, sf_dir)[2].report_frame(spark)


@query("score_new")
def q_score_new(spark, sf_dir):
    """The whole geo_events table scored as new rows by the fitted chain and the best model."""
    prep_model, _, models = fitted(spark, sf_dir)
    df = frame(spark, sf_dir, "geo_events")
    out = jobs.score_new(df, prep_model, models, KEYS, "latitude", "longitude", None, p=QP)
    return out.select("event_id", "model_prob", "risk_score", "risk_level", "anomaly_flag")


@query("score_test")
def q_score_test(spark, sf_dir):
    """Predictions on the held-out test split with the model-probability summary attached."""
    _, fr, models = fitted(spark, sf_dir)
    pred, summary = jobs.score_test(models, fr, p=QP)
    return pred.select("event_id", F.col("prediction").cast("int").alias("prediction"), "risk_prob",
                       "anomaly_flag").crossJoin(F.broadcast(summary.select("n_samples", "mean_risk")))


@query("geojson_source", with_frames(["geo_events"], """
select event_id, category, label::bigint as label, temperature, longitude, latitude from geo_events"""))
def q_geojson_source(spark, sf_dir):
    """S3: geo_events written as GeoJSON Point features (one per line, GeoJSON text sequence) into the
    shared scratch folder, then read back; properties become columns, coordinates longitude / latitude."""
    configure(spark)
    df = frame(spark, sf_dir, "geo_events")
    feature = F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"),
        F.struct("event_id", "category", "label", "temperature").alias("properties")))
    path = scratch_path(spark, "geojson") + ".geojsonl"
    df.select(feature.alias("value")).write.mode("overwrite").text(path)
    return read_geojson(spark, path, lines=True)


@query("score_stream")
def q_score_stream(spark, sf_dir):
    """`events` read as a file stream, derived to geo_events by the same SQL, scored per micro-batch by
    the fitted chain and model into a Parquet sink in the shared scratch folder; returns the sink."""
    from riskflow.plans.fixtures import frame_over, table
    from riskflow.streaming.score_stream import file_stream, score_stream
    prep_model, _, models = fitted(spark, sf_dir)
    schema = table(spark, sf_dir, "events").schema
    stream = file_stream(spark, sf_dir, schema, pattern="events.parquet")
    view = f"events_stream_{abs(hash(sf_dir)) % 10**8}"
    stream.createOrReplaceTempView(view)
    geo = frame_over(spark, "geo_events", {"events": view})
    out = scratch_path(spark, "score-stream-sink")
    q = score_stream(geo, prep_model, models, KEYS, out, "latitude", "longitude", None, p=QP)
    q.awaitTermination()
    return spark.read.parquet(out).select("event_id", "model_prob", "risk_score", "risk_level", "anomaly_flag")


@query("csv_source", with_frames(["geo_events"], """
select event_id, latitude, longitude, temperature, category, label::bigint as label, cast(k_text as bigint) as k_text
from geo_events"""))
def q_csv_source(spark, sf_dir):
    """S1 + S4: geo_events written as CSV (in parallel, NULL as empty field) into the shared scratch
    folder and read back: NA tokens -> NULL, number columns typed by the coercion pass."""
    from riskflow.sources.readers import read_table
    configure(spark)
    df = frame(spark, sf_dir, "geo_events").select("event_id", "latitude", "longitude", "temperature",
                                                   "category", "label", "k_text")
    path = scratch_path(spark, "csv") + ".csv"
    df.write.mode("overwrite").option("header", True).csv(path)
    return read_table(spark, path)


@query("csv_quoted_source", """
select doc_id, case when text not in ('', 'NA', 'NULL', 'NaN', 'None', 'null', 'nan', 'n/a', 'N/A') then text end as text, lang, n_chars > 500 as is_long
from documents""")
def q_csv_quoted_source(spark, sf_dir):
    """Whole texts with quotes, commas and line breaks written as CSV and read back on the default path; a truth column
    comes back as boolean."""
    from riskflow.plans.fixtures import table
    from riskflow.sources.readers import read_table
    configure(spark)
    df = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", "lang", "n_chars > 500 as is_long")
    path = scratch_path(spark, "csv-quoted") + ".csv"
    writer = df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return read_table(spark, path)


@query("ingest", with_frames(["geo_events"], "select * from (" + " union all ".join(
    f"select {i} as position, '{c}' as column_name, '{t}' as dtype, round(avg(({c} is null)::int), 4) as missing_pct, count(*) as n_rows, "
    f"{'true' if c == 'label' else 'false'} as is_target, {'true' if c in ('latitude', 'longitude') else 'false'} as is_coordinate from geo_events"
    for i, (c, t) in enumerate([("event_id", "bigint"), ("latitude", "double"), ("longitude", "double"), ("temperature", "double"),
                                ("category", "string"), ("label", "bigint"), ("k_text", "bigint")])) + ")"))
def q_ingest(spark, sf_dir):
    """geo_events as an uploaded CSV file: read, profiled, roles inferred."""
    configure(spark)
    df = frame(spark, sf_dir, "geo_events").select("event_id", "latitude", "longitude", "temperature", "category", "label", "k_text")
    path = scratch_path(spark, "ingest") + ".csv"
    df.write.option("header", True).csv(path)
    got = jobs.ingest(spark, path)
    out = got.schema.join(got.missing, "column_name").select("position", "column_name", "dtype", "missing_pct", "n_rows")
    return out.withColumns({"is_target": F.col("column_name").eqNullSafe(F.lit(got.target)),
                            "is_coordinate": F.col("column_name").isin([got.lat, got.lon])})


@query("json_source", with_frames(["geo_events"], """
select event_id, latitude, longitude, temperature, category, label::bigint as label from geo_events"""))
def q_json_source(spark, sf_dir):
    """geo_events written as JSON Lines and read back (splittable form)."""
    from riskflow.sources.readers import read_table
    configure(spark)
    df = frame(spark, sf_dir, "geo_events").select("event_id", "latitude", "longitude", "temperature",
                                                   "category", "label")
    path = scratch_path(spark, "json") + ".jsonl"
    df.write.mode("overwrite").json(path)
    return read_table(spark, path).select("event_id", "latitude", "longitude", "temperature", "category", "label")


@query("map_scores")
def q_map_scores(spark, sf_dir):
    """The whole table scored by the fitted chain and best model, as map points (V5)."""
    from riskflow.operators import chartdata as cd
    prep_model, _, models = fitted(spark, sf_dir)
    scored = jobs.score_new(frame(spark, sf_dir, "geo_events"), prep_model, models, KEYS, "latitude", "longitude",
                            None, p=QP)
    return cd.chart_map_points(scored, "latitude", "longitude", "risk_score", KEYS, QP)


@query("chart_importance")
def q_chart_importance(spark, sf_dir):
    """V3: top 15 features of the best model."""
    from riskflow.operators import chartdata as cd
    _, _, models = fitted(spark, sf_dir)
    imp = mo.importance_frame(spark, models.results[models.best]["feature_importance"])
    return cd.chart_importance(imp, 15)


@query("chart_cv")
def q_chart_cv(spark, sf_dir):
    """V7: cross-validation F1 mean and std per model."""
    from riskflow.operators import chartdata as cd
    return cd.chart_cv(mo.cv_frame(spark, _folds(spark, sf_dir)))
