"""Preparation queries (C1-C24, P11) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow.operators import prep as pp
from riskflow.params import Params
from riskflow.plans.fixtures import frame, table, with_frames
from riskflow.plans.registry import DIGITS, query
from riskflow.session import configure, scratch_path

P = Params()
LINE_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
GEO_NUM = ["latitude", "longitude", "temperature", "infrastructure_score"]


def _f(spark, sf_dir, name):
    configure(spark)
    return frame(spark, sf_dir, name)


def r9(c):
    return F.round(c, DIGITS)


def _hash_sql(key: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5(concat_ws('#', {key}, '{seed}')), 1, 13))::BIGINT"


@query("coerce_types", with_frames(["geo_events"], """
select event_id, cast(k_text as bigint) as k_text, category from geo_events"""))
def q_coerce_types(spark, sf_dir):
    df = _f(spark, sf_dir, "geo_events").select("event_id", "k_text", "category")
    return pp.coerce_types(df)


@query("geo_features", with_frames(["geo_events"], """
select event_id, round(radians(latitude), 6) as geo_lat_rad, round(radians(longitude), 6) as geo_lon_rad,
  round(sqrt(latitude*latitude + longitude*longitude), 6) as geo_distance_eq,
  coalesce((latitude >= 0)::int, 0) * 2 + coalesce((longitude >= 0)::int, 0) as geo_quadrant
from geo_events"""))
def q_geo_features(spark, sf_dir):
    df = pp.add_geo_features(_f(spark, sf_dir, "geo_events"), "latitude", "longitude")
    return df.select("event_id", *[r9(F.col(c)).alias(c) for c in ("geo_lat_rad", "geo_lon_rad", "geo_distance_eq")],
                     "geo_quadrant")


@query("temporal_features", """
select o_orderkey, year(o_orderdate)::int as o_orderdate_year, month(o_orderdate)::int as o_orderdate_month,
  (isodow(o_orderdate) - 1)::int as o_orderdate_dayofweek, hour(o_orderdate)::int as o_orderdate_hour,
  quarter(o_orderdate)::int as o_orderdate_quarter
from orders""")
def q_temporal_features(spark, sf_dir):
    configure(spark)
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    plan = pp.detect_temporal(df, ["o_orderdate"])
    return pp.add_temporal_features(df, plan)


@query("temporal_text", """
select o_orderkey, year(o_orderdate)::int as day_text_year, month(o_orderdate)::int as day_text_month,
  (isodow(o_orderdate) - 1)::int as day_text_dayofweek, 0::int as day_text_hour, quarter(o_orderdate)::int as day_text_quarter
from orders""")
def q_temporal_text(spark, sf_dir):
    """C8 on text: the one format that parses every value is found, then split into calendar parts."""
    configure(spark)
    df = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "date_format(o_orderdate, 'yyyy-MM-dd') as day_text")
    return pp.add_temporal_features(df, pp.detect_temporal(df, ["day_text"]))


@query("temporal_formats", """
with t as (select event_id, ts, (event_id * 997 % 86400)::int as s, ts::date as d from events),
u as (select event_id, d, date_trunc('day', ts) + to_seconds(s) as w from t)
select event_id, case when event_id % 2 = 0 then strftime(d, '%Y-%m-%d') else strftime(d, '%d.%m.%Y') end as mixed,
  """ + ", ".join(f"year({e})::int as {c}_year, month({e})::int as {c}_month, (isodow({e}) - 1)::int as {c}_dayofweek, "
                 f"{h}::int as {c}_hour, quarter({e})::int as {c}_quarter" for c, e, h in (
                     ("named", "d", "0"), ("short_year", "d", "0"), ("clock", "w", "hour(w)"), ("zoned", "w", "hour(w)"), ("letter", "w", "hour(w)"),
                     ("day_first", "d", "0"), ("fractions", "w", "hour(w)"))) + """
from u""")
def q_temporal_formats(spark, sf_dir):
    """C8 on month names, two-digit years, a 12-hour clock, zones, weekday names, day before month and optional fractions; a
    column that mixes two forms stays text."""
    configure(spark)
    df = table(spark, sf_dir, "events").selectExpr("event_id", "date_trunc('day', ts) + make_dt_interval(0, 0, 0, event_id * 997 % 86400) as w")
    texts = {"named": "MMMM d, yyyy", "short_year": "dd-MMM-yy", "clock": "M/d/yyyy h:mm:ss a", "zoned": "yyyy-MM-dd'T'HH:mm:ss'+05:30'",
             "letter": "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "day_first": "dd/MM/yyyy"}
    cols = {c: F.date_format("w", f) for c, f in texts.items()}
    cols["fractions"] = F.when(F.col("event_id") % 3 == 0, F.date_format("w", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("w", "yyyy-MM-dd HH:mm:ss.SSS"))
    cols["mixed"] = F.when(F.col("event_id") % 2 == 0, F.date_format("w", "yyyy-MM-dd")).otherwise(F.date_format("w", "dd.MM.yyyy"))
    df = df.select("event_id", *[e.alias(c) for c, e in cols.items()])
    return pp.add_temporal_features(df, pp.detect_temporal(df))


@query("encode_categories", """
select o_orderkey,
  (dense_rank() over (order by o_orderstatus) - 1)::int as o_orderstatus,
  (dense_rank() over (order by o_orderpriority) - 1)::int as o_orderpriority
from orders""")
def q_encode_categories(spark, sf_dir):
    configure(spark)
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    enc = pp.CategoryEncoder.fit(df, ["o_orderstatus", "o_orderpriority"], P)
    return enc.apply(df)


@query("encode_unseen", """
with fit as (select * from part where p_size <= 5),
m_name as (select p_name as v, dense_rank() over (order by p_name) - 1 as code from (select distinct p_name from fit)),
m_brand as (select p_brand as v, dense_rank() over (order by p_brand) - 1 as code
            from (select distinct p_brand from fit))
select p_partkey, coalesce(a.code, -1)::int as p_name, coalesce(b.code, -1)::int as p_brand
from part left join m_name a on part.p_name = a.v left join m_brand b on part.p_brand = b.v""")
def q_encode_unseen(spark, sf_dir):
    configure(spark)
    parts = table(spark, sf_dir, "part")
    enc = pp.CategoryEncoder.fit(parts.where(F.col("p_size") <= 5), ["p_name", "p_brand"], P)
    return enc.apply(parts.select("p_partkey", "p_name", "p_brand"))


def _clip_sql():
    qs = ", ".join(f"quantile_cont({c}, 0.25) as q1_{c}, quantile_cont({c}, 0.75) as q3_{c}" for c in LINE_FEATS)
    cols = ", ".join(
        f"round(case when {c} is null then null else least(greatest({c}, q1_{c} - 1.5*(q3_{c}-q1_{c})), "
        f"q3_{c} + 1.5*(q3_{c}-q1_{c})) end, 6) as {c}" for c in LINE_FEATS)
    return with_frames(["line_risk"], f"select {', '.join(LINE_KEYS)}, {cols} from line_risk, (select {qs} from line_risk)")


@query("clip_iqr", _clip_sql())
def q_clip_iqr(spark, sf_dir):
    df = _f(spark, sf_dir, "line_risk").select(*LINE_KEYS, *LINE_FEATS)
    out = pp.clip_iqr(df, LINE_FEATS, P)
    return out.select(*LINE_KEYS, *[r9(F.col(c)).alias(c) for c in LINE_FEATS])


def _zscore_sql():
    st = ", ".join(f"avg(coalesce({c}, 0e0)) as m_{c}, stddev_pop(coalesce({c}, 0e0)) as s_{c}" for c in GEO_NUM)
    cols = ", ".join(
        f"round(case when s_{c} = 0 then {c} when abs((coalesce({c}, 0e0) - m_{c}) / s_{c}) < 3e0 then {c} end, 6)"
        f" as {c}" for c in GEO_NUM)
    return with_frames(["geo_events"], f"select event_id, {cols} from geo_events, (select {st} from geo_events)")


@query("null_zscore", _zscore_sql())
def q_null_zscore(spark, sf_dir):
    df = _f(spark, sf_dir, "geo_events").select("event_id", *GEO_NUM)
    out = pp.null_zscore(df, GEO_NUM, P.outlier_threshold)
    return out.select("event_id", *[r9(F.col(c)).alias(c) for c in GEO_NUM])


def _impute_q(name, strategy, fill_sql):
    @query(name, with_frames(["geo_events"], f"""
select event_id, round(coalesce(temperature, ({fill_sql})), 6) as temperature from geo_events"""))
    def q(spark, sf_dir):
        df = _f(spark, sf_dir, "geo_events").select("event_id", "temperature")
        out = pp.impute(df, ["temperature"], strategy, P)
        return out.select("event_id", r9(F.col("temperature")).alias("temperature"))
    return q


_impute_q("impute_median", "median", "select median(temperature) from geo_events")
_impute_q("impute_mean", "mean", "select avg(temperature) from geo_events")
_impute_q("impute_mode", "most_frequent", """select temperature from geo_events where temperature is not null
  group by temperature order by count(*) desc, temperature asc limit 1""")


def _scale_q(name, method, center, scale):
    st = ", ".join(f"{center.format(c=c)} as c_{c}, {scale.format(c=c)} as s_{c}" for c in LINE_FEATS)
    cols = ", ".join(f"round(({c} - c_{c}) / case when s_{c} = 0 then 1e0 else s_{c} end, 6) as {c}"
                     for c in LINE_FEATS)

    @query(name, with_frames(["line_risk"], f"select {', '.join(LINE_KEYS)}, {cols} from line_risk, "
                                            f"(select {st} from line_risk)"))
    def q(spark, sf_dir):
        df = _f(spark, sf_dir, "line_risk").select(*LINE_KEYS, *LINE_FEATS)
        out = pp.scale(df, LINE_FEATS, method, P)
        return out.select(*LINE_KEYS, *[r9(F.col(c)).alias(c) for c in LINE_FEATS])
    return q


_scale_q("scale_standard", "standard", "avg({c})", "stddev_pop({c})")
_scale_q("scale_minmax", "minmax", "min({c})", "max({c}) - min({c})")
_scale_q("scale_robust", "robust", "quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)")


@query("assign_split", with_frames(["geo_events"], f"""
select event_id, case when {_hash_sql('event_id')} % 1000 < 200 then 'test'
  when {_hash_sql('event_id')} % 1000 < 300 then 'val' else 'train' end as split
from geo_events"""))
def q_assign_split(spark, sf_dir):
    df = _f(spark, sf_dir, "geo_events").select("event_id")
    return pp.assign_split(df, ["event_id"], P)


@query("split_stratified", with_frames(["geo_events"], f"""
select event_id, label,
  case when rn <= n_test then 'test' when rn <= n_test + n_val then 'val' else 'train' end as split
from (
  select event_id, label, rn, n_test, ceil(0.125 * (n - n_test)) as n_val from (
    select event_id, label, row_number() over (partition by label order by {_hash_sql('event_id')}) as rn,
      count(*) over (partition by label) as n, ceil(0.2 * count(*) over (partition by label)) as n_test
    from geo_events))"""))
def q_split_stratified(spark, sf_dir):
    df = _f(spark, sf_dir, "geo_events").select("event_id", "label")
    return pp.assign_split(df, ["event_id"], P, stratify="label")


@query("split_many_classes", with_frames(["line_risk"], f"""
select l_orderkey, l_linenumber,
  case when rn <= n_test then 'test' when rn <= n_test + n_val then 'val' else 'train' end as split
from (
  select *, ceil(0.125e0 * (n - n_test)) as n_val from (
    select l_orderkey, l_linenumber, count(*) over (partition by l_orderkey) as n,
      rank() over (partition by l_orderkey order by {_hash_sql("l_orderkey, l_linenumber, l_partkey, l_suppkey")}) as rn,
      ceil(0.2e0 * count(*) over (partition by l_orderkey)) as n_test
    from line_risk))"""))
def q_split_many_classes(spark, sf_dir):
    """C22 with a class an order, so classes grow with the table; rows of the same key stay together."""
    df = _f(spark, sf_dir, "line_risk").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = pp.assign_split(df, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], P, stratify="l_orderkey")
    return out.select("l_orderkey", "l_linenumber", "split")


# ---- the whole chain on geo_events (key event_id, target label) ----------------------------------------
# Feature order of the fitted chain: numeric columns in table order (const_col dropped, k_text coerced,
# category coded in place), then the geo features, then the calendar parts of ts.
_CHAIN_RAW = {
    "latitude": "latitude",
    "longitude": "longitude",
    "temperature": "temperature",
    "infrastructure_score": "infrastructure_score",
    "k_text": "cast(k_text as bigint)",
    "category": "dense_rank() over (order by category) - 1",
    "geo_lat_rad": "radians(latitude)",
    "geo_lon_rad": "radians(longitude)",
    "geo_distance_eq": "sqrt(latitude*latitude + longitude*longitude)",
    "geo_quadrant": "coalesce((latitude >= 0)::int, 0) * 2 + coalesce((longitude >= 0)::int, 0)",
    "ts_year": "year(ts)",
    "ts_month": "month(ts)",
    "ts_dayofweek": "isodow(ts) - 1",
    "ts_hour": "hour(ts)",
    "ts_quarter": "quarter(ts)",
}
CHAIN_FEATURES = list(_CHAIN_RAW)


def _chain_ctes(source: str = "geo_events", apply_from: str | None = None) -> str:
    raw = ", ".join(f"({e})::double as {c}" for c, e in _CHAIN_RAW.items())
    qs = ", ".join(f"quantile_cont({c}, 0.25) as q1_{c}, quantile_cont({c}, 0.75) as q3_{c}, "
                   f"median({c}) as med_{c}" for c in CHAIN_FEATURES)
    clipped = ", ".join(f"case when {c} is null then null else least(greatest({c}, q1_{c} - 1.5*(q3_{c}-q1_{c})), "
                        f"q3_{c} + 1.5*(q3_{c}-q1_{c})) end as {c}" for c in CHAIN_FEATURES)
    filled = ", ".join(f"coalesce({c}, med_{c}) as {c}" for c in CHAIN_FEATURES)
    st = ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in CHAIN_FEATURES)
    return f"""
raw as (select event_id, label, {raw} from (select distinct * from {source})),
qs as (select {qs} from raw),
clipped as (select event_id, label, {clipped} from raw, qs),
filled as (select event_id, label, {filled} from clipped, qs),
st as (select {st} from filled)"""


def _scaled(src: str) -> str:
    return ", ".join(f"round(({c} - m_{c}) / case when s_{c} = 0 then 1e0 else s_{c} end, 6) as {c}"
                     for c in CHAIN_FEATURES)


def _geo_fit(spark, sf_dir):
    df = _f(spark, sf_dir, "geo_events")
    return df, pp.Prep(P).fit(df, target="label", keys=["event_id"])


@query("prep_pipeline", with_frames(["geo_events"], "with " + _chain_ctes().strip() + f"""
select event_id, label, {_scaled('filled')},
  case when {_hash_sql('event_id')} % 1000 < 200 then 'test'
       when {_hash_sql('event_id')} % 1000 < 300 then 'val' else 'train' end as split
from filled, st""").replace("\nwith ", ",\n", 1))
def q_prep_pipeline(spark, sf_dir):
    df, model = _geo_fit(spark, sf_dir)
    out = model.fitted_frame(df)
    return out.select("event_id", "label", *[r9(F.col(c)).alias(c) for c in model.feature_names], "split")


@query("prep_stats", with_frames(["geo_events"], "with " + _chain_ctes().strip() + f"""
select count(*) as n_rows, {len(CHAIN_FEATURES)} as n_features,
  round(({' + '.join(f'avg(({c} is null)::int)' for c in CHAIN_FEATURES)}) / {len(CHAIN_FEATURES)}e0 * 100e0, 6)
    as missing_pct
from clipped""").replace("\nwith ", ",\n", 1))
def q_prep_stats(spark, sf_dir):
    _, model = _geo_fit(spark, sf_dir)
    return pp.prep_stats_frame(spark, model).withColumn("missing_pct", r9(F.col("missing_pct")))


def _align_sql():
    raw_new = ", ".join(f"({e})::double as {c}" if c != "temperature" else "cast(null as double) as temperature"
                        for c, e in _CHAIN_RAW.items())
    filled = ", ".join(f"coalesce({c}, med_{c}) as {c}" for c in CHAIN_FEATURES)
    return with_frames(["geo_events"], "with " + _chain_ctes().strip() + f""",
new_raw as (select event_id, {raw_new} from geo_events),
new_filled as (select event_id, {filled} from new_raw, qs)
select event_id, {_scaled('new_filled')} from new_filled, st""").replace("\nwith ", ",\n", 1)


@query("prep_store", _align_sql())
def q_prep_store(spark, sf_dir):
    """The fitted chain is saved as a version, loaded again and applied to new rows, as `transform_align` does directly."""
    df, model = _geo_fit(spark, sf_dir)
    path = scratch_path(spark, "prep-store")
    again = pp.PrepModel.load(spark, path, version=model.save(path))
    out = again.transform(df.drop("temperature", "label"))
    return out.select("event_id", *[r9(F.col(c)).alias(c) for c in again.feature_names])


@query("transform_align", _align_sql())
def q_transform_align(spark, sf_dir):
    """New rows without a training column (temperature) and without the target: the column comes back as
    NULL, is imputed and scaled with the fitted numbers; no dedup, no clip."""
    df, model = _geo_fit(spark, sf_dir)
    new = df.drop("temperature", "label")
    out = model.transform(new)
    return out.select("event_id", *[r9(F.col(c)).alias(c) for c in model.feature_names])
