"""Queries A1, A2 (correlations and their p-values) over the features fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions.exprs import rnd
from ledgerlake.operators import stats as ST
from ledgerlake.plans.oracle_fixtures import R, with_fixtures
from ledgerlake.plans.registry import register
from ledgerlake.plans.sqlbits import band_sql, p_value_sql
from ledgerlake.sources import fixtures as FX
from ledgerlake.sources.tables import Tables

_COLS = ["x2", "x3", "x4"]
_C = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", corr(x1, {c}) AS r, count(*) FILTER (WHERE x1 IS NOT NULL AND {c} IS NOT NULL) AS n
    FROM features""" for c in _COLS)


def _corr(spark, d):
    return ST.correlations(FX.features(Tables(spark, d)), "x1", _COLS)


@register("correlations", with_fixtures(f"""
WITH c AS ({_C}),
t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t_stat FROM c)
SELECT 'x1' AS target, "column", {R('r', 4)} AS r, n, {R('t_stat', 4)} AS t_stat,
  CASE WHEN r IS NULL THEN 'no correlation' ELSE {band_sql('correlation_strength', 'abs(r)')} END AS strength,
  CAST(row_number() OVER (ORDER BY abs(r) DESC NULLS LAST, "column") AS INTEGER) AS rank_abs FROM t""", "features"))
def correlations(spark, d):
    c = _corr(spark, d)
    return c.select("target", "column", rnd("r", 4).alias("r"), "n", rnd("t_stat", 4).alias("t_stat"),
                    "strength", "rank_abs")


@register("correlation_pvalue", with_fixtures(f"""
WITH c AS ({_C}), p AS (SELECT *, {p_value_sql('r', 'n')} AS p FROM c)
SELECT 'x1' AS target, "column", {R('r', 4)} AS r, n, {R('p', 4)} AS p_value, p < 0.05 AS significant,
  CASE WHEN r IS NULL THEN 'no correlation' ELSE {band_sql('correlation_strength', 'abs(r)')} END AS strength,
  CAST(row_number() OVER (ORDER BY abs(r) DESC NULLS LAST, "column") AS INTEGER) AS rank_abs FROM p""", "features"))
def correlation_pvalue(spark, d):
    p = ST.correlation_pvalue(_corr(spark, d))
    return p.select("target", "column", rnd("r", 4).alias("r"), "n", rnd("p_value", 4).alias("p_value"),
                    "significant", "strength", "rank_abs")
