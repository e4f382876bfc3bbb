"""Profiling / validation queries (P1-P10) and whole-row dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow.operators import profile as pr
from riskflow.plans.fixtures import frame, with_frames
from riskflow.plans.registry import DIGITS, query
from riskflow.session import configure

GEO_COLS = ["event_id", "ts", "latitude", "longitude", "temperature", "infrastructure_score", "k_text",
            "category", "const_col", "label"]
_DUCK_TYPE = ("case typeof({c}) when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' "
              "when 'VARCHAR' then 'string' when 'TIMESTAMP' then 'timestamp_ntz' when 'BOOLEAN' then 'boolean' "
              "else lower(typeof({c})) end")


def _geo(spark, sf_dir, name="geo_events"):
    configure(spark)
    return frame(spark, sf_dir, name)


@query("profile_schema", with_frames(["geo_events"], "\nunion all\n".join(
    f"select {i} as position, '{c}' as column_name, (select {_DUCK_TYPE.format(c=c)} from geo_events limit 1) as dtype, "
    f"(select count(*) from geo_events) as n_rows, {len(GEO_COLS)} as n_cols" for i, c in enumerate(GEO_COLS))))
def q_profile_schema(spark, sf_dir):
    return pr.profile_schema(_geo(spark, sf_dir))


@query("profile_missing", with_frames(["geo_events"], "\nunion all\n".join(
    f"select '{c}' as column_name, round(avg(case when {c} is null then 1e0 else 0e0 end), 4) as missing_pct "
    f"from geo_events" for c in GEO_COLS)))
def q_profile_missing(spark, sf_dir):
    return pr.profile_missing(_geo(spark, sf_dir))


@query("preview", with_frames(["geo_events"], "select " + ", ".join(
    f"coalesce(cast({c} as varchar), '') as {c}" if c != "ts" else
    "coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '') as ts" for c in GEO_COLS)
    + " from (select * from geo_events order by event_id limit 5)"))
def q_preview(spark, sf_dir):
    df = _geo(spark, sf_dir)
    df = df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return pr.preview(df, 5, ["event_id"])


@query("duplicate_count", with_frames(["geo_events_dirty"], """
select count(*) as n_rows, (select count(*) from (select distinct * from geo_events_dirty)) as n_distinct,
  count(*) - (select count(*) from (select distinct * from geo_events_dirty)) as n_duplicates
from geo_events_dirty"""))
def q_duplicate_count(spark, sf_dir):
    return pr.duplicate_count(_geo(spark, sf_dir, "geo_events_dirty"))


@query("constant_columns", with_frames(["geo_events_dirty"], "\nunion all\n".join(
    f"select '{c}' as column_name, coalesce(min({c}) = max({c}), min({c}) is null) as is_constant "
    f"from geo_events_dirty" for c in GEO_COLS)))
def q_constant_columns(spark, sf_dir):
    return pr.constant_flags(_geo(spark, sf_dir, "geo_events_dirty"))


@query("validate_issues", with_frames(["geo_events_dirty"], """
select 'duplicates' as issue, count(*) - (select count(*) from (select distinct * from geo_events_dirty)) as n,
  cast(null as varchar) as columns from geo_events_dirty
union all
select 'constant' as issue, 1 as n, 'const_col' as columns"""))
def q_validate_issues(spark, sf_dir):
    return pr.validate(_geo(spark, sf_dir, "geo_events_dirty"))


@query("class_distribution", with_frames(["geo_events"], """
select label, count(*) as n, round(count(*) / (select count(*) from geo_events)::double, 6) as share
from geo_events group by label"""))
def q_class_distribution(spark, sf_dir):
    d = pr.class_distribution(_geo(spark, sf_dir), "label")
    return d.withColumn("share", F.round("share", 6))


@query("drop_duplicates", with_frames(["geo_events_dirty"], "select distinct * from geo_events_dirty"))
def q_drop_duplicates(spark, sf_dir):
    return _geo(spark, sf_dir, "geo_events_dirty").dropDuplicates()


@query("validate_small", with_frames(["geo_events"], """
select 'few' as part, 'too_few_rows' as issue, 7::bigint as n, null::varchar as columns from (select 1)
union all select 'few', 'high_missing', 1::bigint, 'temperature' from (select 1)
union all select 'few', 'constant', count(*), string_agg(c, ',' order by i) from (
  select 1 as i, 'temperature' as c where (select count(distinct temperature) from geo_events where event_id % 20 = 7 and event_id < 140) <= 1
  union all select 2, 'const_col') t
union all select 'none', 'empty', 0::bigint, null::varchar from (select 1)"""))
def q_validate_small(spark, sf_dir):
    """A handful of rows whose temperature is missing, and no rows at all."""
    geo = _geo(spark, sf_dir).select("event_id", "latitude", "temperature", "const_col")
    few = pr.validate(geo.where("event_id % 20 = 7 and event_id < 140")).withColumn("part", F.lit("few"))
    none = pr.validate(geo.where("event_id < 0")).withColumn("part", F.lit("none"))
    return few.unionByName(none).select("part", "issue", "n", "columns")


@query("infer_roles", with_frames(["geo_events"], """
select 'geo_events' as source, 'label' as target, 'latitude' as lat, 'longitude' as lon, count(*) as n_rows from geo_events
union all select 'labels', null, null, null, count(*) from labels"""))
def q_infer_roles(spark, sf_dir):
    """Target and coordinate columns inferred from the names of a table."""
    out = None
    for name, df in (("geo_events", _geo(spark, sf_dir)), ("labels", spark.read.parquet(f"{sf_dir}/labels.parquet"))):
        target = pr.infer_target(df)
        lat, lon = pr.infer_coords(df.columns, target)
        row = df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("source"), *[F.lit(v).cast("string").alias(c) for c, v in (("target", target), ("lat", lat), ("lon", lon))], "n_rows")
        out = row if out is None else out.unionByName(row)
    return out
