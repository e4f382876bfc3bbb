"""Every deterministic registered query equals its DuckDB oracle (rows, column names, values)."""

import pytest

from tests.oracle_check import compare
from tests.conftest import SF_SMALL


def test_all_oracles_match(spark):
    from riskflow.plans.registry import load_all
    reg = load_all()
    names = [n for n, (_, sql) in reg.items() if sql is not None and n not in ("prep_pipeline",)]
    res = compare(spark, SF_SMALL, names, verbose=True)
    bad = {k: v for k, v in res.items() if v != "OK"}
    assert not bad, bad


def test_prep_pipeline_oracle(spark):
    res = compare(spark, SF_SMALL, ["prep_pipeline"])
    assert res["prep_pipeline"] == "OK"


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    rows = df.collect()
    assert {r["risk_level"] for r in rows} <= {"low", "medium", "high"}
    assert sum(r["n"] for r in rows) == 1000
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_oracle_types_match(spark):
    from tests.type_check import run
    assert run(spark, SF_SMALL) == {}
