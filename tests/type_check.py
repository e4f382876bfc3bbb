"""Compare Spark result types with DuckDB oracle types for every oracle query."""
import sys
sys.path.insert(0, "/root/repo")
import duckdb
from riskflow.plans.fixtures import TABLES

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                 "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "float": "FLOAT",
                 "smallint": "SMALLINT", "tinyint": "TINYINT", "date": "DATE"}


def run(spark, sf_dir, names=None):
    from riskflow.plans.registry import load_all
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    bad = {}
    for name, (fn, sql) in load_all().items():
        if sql is None or (names and name not in names):
            continue
        sdf = fn(spark, sf_dir)
        st = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
        rel = con.sql(sql)
        dt = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        diffs = {c: (st.get(c), dt.get(c)) for c in set(st) | set(dt) if SPARK_TO_DUCK.get(st.get(c), st.get(c)) != dt.get(c)}
        if diffs:
            bad[name] = diffs
            print(name, diffs, flush=True)
    return bad


if __name__ == "__main__":
    from riskflow.session import get_spark
    spark = get_spark("local[8]", 8)
    names = sys.argv[2].split(",") if len(sys.argv) > 2 else None
    print("BAD", run(spark, sys.argv[1], names))
