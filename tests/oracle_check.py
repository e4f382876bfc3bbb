"""Run registered queries in Spark and their oracle SQL in DuckDB; compare rows, schema and values."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

sys.path.insert(0, "/root/repo")

from riskflow.plans.fixtures import TABLES  # noqa: E402


DIGITS = 6


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if DIGITS is None else round(v, DIGITS)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    return v


def compare(spark, sf_dir, names=None, verbose=True):
    from riskflow.plans.registry import load_all
    reg = load_all()
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    results = {}
    for name, (fn, sql) in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            srows = sdf.collect()
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            results[name] = f"spark error: {e!r}"[:300]
            print(name, results[name], flush=True)
            continue
        ts = time.time() - t0
        if sql is None:
            results[name] = f"rows-only {len(srows)}"
            print(f"{name}: {results[name]} ({ts:.1f}s)", flush=True)
            continue
        try:
            d = con.sql(sql)
            dcols = d.columns
            drows = d.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = f"duck error: {e!r}"[:400]
            print(name, results[name], flush=True)
            continue
        ok_cols = sorted(scols) == sorted(dcols)
        sidx = sorted(range(len(scols)), key=lambda i: scols[i])
        didx = sorted(range(len(dcols)), key=lambda i: dcols[i])
        sset = sorted((tuple(norm(r[i]) for i in sidx) for r in srows), key=repr)
        dset = sorted((tuple(norm(r[i]) for i in didx) for r in drows), key=repr)
        ok = ok_cols and sset == dset
        results[name] = "OK" if ok else "MISMATCH"
        msg = f"{name}: {results[name]} rows {len(srows)}/{len(drows)} ({ts:.1f}s)"
        if not ok_cols:
            msg += f" cols {scols} vs {dcols}"
        elif not ok and verbose:
            diff = [(a, b) for a, b in zip(sset, dset) if a != b][:3]
            msg += f" first diffs {diff}"
        print(msg, flush=True)
    return results


if __name__ == "__main__":
    from riskflow.session import get_spark
    spark = get_spark("local[8]", 8)
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2].split(",") if len(sys.argv) > 2 and sys.argv[2] else None
    if len(sys.argv) > 3:
        DIGITS = None if sys.argv[3] == "exact" else int(sys.argv[3])
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if not (v == "OK" or v.startswith("rows-only"))}
    print("SUMMARY", len(res), "queries,", len(bad), "bad:", bad)
