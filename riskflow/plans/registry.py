"""Query catalogue: every registered operator query with its DuckDB oracle (or none, for the random and
iterative ones, which are checked against brute force or properties in the tests)."""

from __future__ import annotations

from typing import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}

# Floating outputs are rounded to this many decimals in both engines: sums of floats depend on the order
# of partial sums (partitioning in Spark, threads in DuckDB); the differences (~1e-14) are far below it.
DIGITS = 6


def query(name: str, oracle: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = (fn, oracle)
        return fn
    return deco


def load_all() -> dict:
    # importing the modules fills the registry
    from riskflow.plans import (q_risk, q_profile, q_prep, q_eval, q_models, q_charts)  # noqa: F401
    return REGISTRY
