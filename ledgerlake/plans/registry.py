"""The query registry behind ``__spark_entry__.queries()`` / ``oracle_sql()``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def duck_count_if(sql: str) -> str:
    """``count_if(x)`` -> ``count(*) FILTER (WHERE x)``: BIGINT, and 0 (not NULL) on all-NULL input."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = duck_count_if(sql[j + len(key):k - 1])
        out.append(sql[i:j] + f"(count(*) FILTER (WHERE {inner}))")
        i = k


def register(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is its DuckDB twin (None -> rows-only check)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = duck_count_if(oracle)
        return fn
    return deco


def load_all():
    # importing the modules fills the registry
    from ledgerlake.plans import (q_positions, q_risk, q_scenarios, q_series,  # noqa: F401
                                  q_quality, q_stats, q_forecast, q_ml)
    return QUERIES, ORACLE
