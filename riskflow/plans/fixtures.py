"""Derived frames over the given tables, one SQL text for Spark and for DuckDB.

The test tables carry no coordinates and no missing values, so the geospatial frame derives both from
`events` by fixed integer rules (same ranges as the original service's own test fixture).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixed derivation rules of the test frames.
_GEO_COLS = """event_id, ts,
  (event_id*7919 % 10007)/10007e0*10e0 - 5e0  as latitude,
  (event_id*6091 % 10009)/10009e0*12e0 + 30e0 as longitude,
  case when event_id % 20 = 7 then null else value end as temperature,
  (event_id*31 % 101)/101e0 as infrastructure_score,
  {k_text} as k_text,
  event_type as category,
  1 as const_col,
  case when value + (event_id*37 % 100) >= 120 then 1 else 0 end as label"""

_GEO_EVENTS = "select " + _GEO_COLS + "\nfrom {events}"

_GEO_EVENTS_DIRTY = """
select * from {geo_events}
union all
select * from {geo_events} where event_id % 50 = 0
"""

_SCORED_EVENTS = "select " + _GEO_COLS + """,
  least(greatest(value/500e0, 0e0), 1e0) as model_prob,
  -abs(value - 100e0) as anomaly_score,
  case when least(greatest(value/500e0, 0e0), 1e0) >= 3e-1 then 1 else 0 end as prediction
from {events}"""

_LINE_RISK = """
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate,
  case when l_returnflag = 'R' then 1 else 0 end as label
from {lineitem}
"""

FRAMES = {
    "geo_events": (_GEO_EVENTS, ()),
    "geo_events_dirty": (_GEO_EVENTS_DIRTY, ("geo_events",)),
    "scored_events": (_SCORED_EVENTS, ()),
    "line_risk": (_LINE_RISK, ()),
}

_SPARK_FUNCS = {"k_text": "get_json_object(props, '$.k')"}
_DUCK_FUNCS = {"k_text": "json_extract_string(props, '$.k')"}


def _deps(name: str) -> list[str]:
    out = []
    for d in FRAMES[name][1]:
        for x in _deps(d) + [d]:
            if x not in out:
                out.append(x)
    return out


def duck_sql(name: str) -> str:
    """SELECT text of a derived frame for DuckDB, where base tables and earlier frames are views/CTEs."""
    text, deps = FRAMES[name]
    return text.format(**{t: t for t in TABLES}, **{d: d for d in deps}, **_DUCK_FUNCS).strip()


def with_frames(names: list[str], body: str) -> str:
    """`WITH <frames> <body>` for DuckDB, frames in dependency order."""
    order = []
    for n in names:
        for x in _deps(n) + [n]:
            if x not in order:
                order.append(x)
    ctes = ",\n".join(f"{n} as (\n{duck_sql(n)}\n)" for n in order)
    return f"with {ctes}\n{body}"


def spark_sql(sf_dir: str, name: str) -> str:
    """SELECT text of a derived frame for Spark: base tables are Parquet paths, frames sub-queries."""
    text, deps = FRAMES[name]
    paths = {t: f"parquet.`{sf_dir.rstrip('/')}/{t}.parquet`" for t in TABLES}
    subs = {d: f"({spark_sql(sf_dir, d)}) {d}" for d in deps}
    return text.format(**paths, **subs, **_SPARK_FUNCS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived frame as a lazy Spark DataFrame (base tables read as Parquet: pruning and pushdown apply)."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    return spark.sql(spark_sql(sf_dir, name))


def frame_over(spark: SparkSession, name: str, views: dict[str, str]) -> DataFrame:
    """A derived frame over given temp views (e.g. a streaming `events`), same SQL text."""
    text, deps = FRAMES[name]
    if deps:
        raise ValueError(f"{name} depends on other frames; derive those first")
    names = {t: views.get(t, t) for t in TABLES}
    return spark.sql(text.format(**names, **_SPARK_FUNCS))
