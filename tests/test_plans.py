"""Plan shapes of every oracle-checked query: no cartesian product, and a SinglePartition exchange only over
aggregates or a top-k (bounded), never over row-level data."""

from tests.conftest import SF_SMALL

_BOUNDED_CHILDREN = ("HashAggregate", "ObjectHashAggregate", "SortAggregate", "TakeOrderedAndProject", "GlobalLimit",
                     "LocalLimit", "CollectLimit")


def check_plan(name, df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan, name
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            child = lines[i + 1]
            assert any(k in child for k in _BOUNDED_CHILDREN), (name, line, child)


def test_query_plans(spark):
    from riskflow.plans.registry import load_all
    for name, (fn, sql) in load_all().items():
        if sql is None:
            continue
        check_plan(name, fn(spark, SF_SMALL))
