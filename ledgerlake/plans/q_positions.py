"""Queries K1–K6 and R1–R4, R9 over the positions fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions.bands import band_lookup, bands_table
from ledgerlake.functions.exprs import exact_sum, rnd
from ledgerlake.operators import positions as P
from ledgerlake.operators import risk as RK
from ledgerlake.plans.oracle_fixtures import R, with_fixtures
from ledgerlake.plans.registry import register
from ledgerlake.session import materialize
from ledgerlake.plans.sqlbits import band_sql, kpis_cte, risk_cte
from ledgerlake.sources import fixtures as FX
from ledgerlake.sources.tables import Tables


def _pos(spark, d):
    return FX.positions(Tables(spark, d))


@register("positions_rollup", with_fixtures(f"""
SELECT entity_id, segment, {R('revenue', 6)} AS revenue, {R('expenses', 6)} AS expenses,
       {R('liabilities', 6)} AS liabilities, {R('cash', 6)} AS cash FROM positions""", "positions"))
def positions_rollup(spark, d):
    p = _pos(spark, d)
    return p.select("entity_id", "segment", *[rnd(c, 6).alias(c) for c in P.MEASURES])


@register("risk_factors", with_fixtures(f"""
WITH {risk_cte()}
SELECT entity_id, CAST(liquidity_risk AS DOUBLE) AS liquidity_risk, CAST(leverage_risk AS DOUBLE) AS leverage_risk,
       CAST(burn_risk AS DOUBLE) AS burn_risk FROM risk""", "positions"))
def risk_factors(spark, d):
    f = RK.risk_factors(_pos(spark, d))
    return f.select("entity_id", *[F.col(c).cast("double").alias(c) for c in RK.FACTORS])


@register("risk_summary", with_fixtures(f"""
WITH {risk_cte()}
SELECT entity_id, segment, CAST(score AS DOUBLE) AS risk_score, {band_sql('risk_level', 'score')} AS risk_level
FROM risk""", "positions"))
def risk_summary(spark, d):
    s = RK.risk_summary(RK.risk_factors(_pos(spark, d)))
    return s.select("entity_id", "segment", "risk_score", "risk_level")


@register("risk_distribution", with_fixtures(f"""
WITH {risk_cte()}
SELECT segment, {band_sql('risk_level', 'score')} AS risk_level, count(*) AS customers,
       sum(CAST(floor(revenue * 10000.0 + 0.5) AS BIGINT)) / 10000.0 AS revenue
FROM risk GROUP BY 1, 2""", "positions"))
def risk_distribution(spark, d):
    """R2 per segment: the flagship slice (entities per risk level)."""
    s = RK.risk_summary(RK.risk_factors(_pos(spark, d)))
    return s.groupBy("segment", "risk_level").agg(F.count(F.lit(1)).alias("customers"),
                                                  exact_sum("revenue", 4).alias("revenue"))


@register("risk_factor_long", with_fixtures(f"""
WITH {risk_cte()}
SELECT entity_id, factor, value FROM (
  SELECT entity_id, 'liquidity_risk' AS factor, CAST(liquidity_risk AS DOUBLE) AS value FROM risk
  UNION ALL SELECT entity_id, 'leverage_risk', CAST(leverage_risk AS DOUBLE) FROM risk
  UNION ALL SELECT entity_id, 'burn_risk', CAST(burn_risk AS DOUBLE) FROM risk)""", "positions"))
def risk_factor_long(spark, d):
    return RK.risk_factor_long(RK.risk_factors(_pos(spark, d)))


@register("kpis", with_fixtures(f"""
WITH {kpis_cte()}
SELECT entity_id, {R('profit', 6)} AS profit, {R('debt_ratio', 2)} AS debt_ratio,
       {R('burn_rate', 6)} AS burn_rate, {R('runway_months', 2)} AS runway_months FROM k""", "positions"))
def kpis(spark, d):
    k = P.kpis(_pos(spark, d))
    return k.select("entity_id", rnd("profit", 6).alias("profit"), rnd("debt_ratio", 2).alias("debt_ratio"),
                    rnd("burn_rate", 6).alias("burn_rate"), rnd("runway_months", 2).alias("runway_months"))


@register("margin_ratios", with_fixtures(f"""
SELECT entity_id,
  {R("CASE WHEN revenue > 0 THEN (revenue - expenses) / revenue * 100 ELSE 0 END", 4)} AS profit_margin_pct,
  {R("CASE WHEN revenue > 0 THEN expenses / revenue * 100 ELSE 0 END", 4)} AS expense_ratio_pct,
  {R("CASE WHEN expenses > 0 THEN coalesce(cash, 0) / expenses * 100 ELSE 0 END", 4)} AS cash_ratio_pct
FROM positions""", "positions"))
def margin_ratios(spark, d):
    m = P.margin_ratios(_pos(spark, d))
    return m.select("entity_id", *[rnd(c, 4).alias(c) for c in
                                   ("profit_margin_pct", "expense_ratio_pct", "cash_ratio_pct")])


@register("financial_ratios", with_fixtures(f"""
SELECT entity_id,
  {R("coalesce(cash,0) / CASE WHEN expenses > 0 THEN expenses / 12 ELSE 1 END", 4)} AS cash_runway_months,
  {R("CASE WHEN revenue > 0 THEN liabilities / revenue ELSE 0 END", 4)} AS debt_to_revenue,
  {R("CASE WHEN coalesce(cash,0) > 0 THEN liabilities / greatest(cash, 1) ELSE 0 END", 4)} AS debt_to_equity,
  {R("CASE WHEN revenue > 0 THEN (revenue - expenses) / revenue ELSE 0 END", 4)} AS profit_margin,
  {R("CASE WHEN revenue > 0 THEN expenses / revenue ELSE 0 END", 4)} AS expense_ratio,
  {R("revenue / 12", 6)} AS revenue_per_month, {R("expenses / 12", 6)} AS expense_per_month
FROM positions""", "positions"))
def financial_ratios(spark, d):
    r = RK.financial_ratios(_pos(spark, d))
    return r.select("entity_id", *[rnd(c, 6 if c.endswith("_per_month") else 4).alias(c)
                                   for c in RK.RATIO_COLUMNS])


@register("band_lookup", with_fixtures(f"""
WITH {kpis_cte()}, {risk_cte()},
long AS (
  SELECT entity_id, 'debt_ratio' AS metric, debt_ratio AS value FROM k
  UNION ALL SELECT entity_id, 'runway_months', runway_months FROM k
  UNION ALL SELECT entity_id, 'risk_score', CAST(score AS DOUBLE) FROM risk)
SELECT entity_id, metric, {R('value', 6)} AS value,
  CASE metric WHEN 'debt_ratio' THEN 'debt_status' WHEN 'runway_months' THEN 'runway_status' ELSE 'risk_level' END AS family,
  CASE metric WHEN 'debt_ratio' THEN {band_sql('debt_status', 'value')}
              WHEN 'runway_months' THEN {band_sql('runway_status', 'value')}
              ELSE {band_sql('risk_level', 'value')} END AS label,
  CASE metric WHEN 'debt_ratio' THEN {band_sql('debt_status', 'value', 'severity')}
              WHEN 'runway_months' THEN {band_sql('runway_status', 'value', 'severity')}
              ELSE {band_sql('risk_level', 'value', 'severity')} END AS severity
FROM long""", "positions"))
def band_lookup_q(spark, d):
    pos = materialize(_pos(spark, d))  # read by the KPI and the risk branch
    k = P.kpis(pos).select("entity_id", "debt_ratio", "runway_months")
    r = RK.risk_summary(RK.risk_factors(pos)).select("entity_id", "risk_score")
    long = (k.unpivot("entity_id", ["debt_ratio", "runway_months"], "metric", "value")
             .unionByName(r.unpivot("entity_id", ["risk_score"], "metric", "value")))
    bands = bands_table(spark, ["debt_status", "runway_status", "risk_level"])
    out = band_lookup(long, bands)
    return out.select("entity_id", "metric", rnd("value", 6).alias("value"), "family", "label", "severity")


@register("segment_breakdown", with_fixtures(f"""
WITH c AS (SELECT entity_id, business, TRY_CAST(regexp_replace(adj_revenue, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS amt,
               TRY_CAST(regexp_replace(adj_ebitda, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS eb FROM segment_pnl),
g AS (SELECT entity_id, business, sum(amt) AS amount FROM c WHERE amt IS NOT NULL AND eb IS NOT NULL GROUP BY 1, 2)
SELECT entity_id, business, {R('amount', 4)} AS amount,
       {R('amount / sum(amount) OVER (PARTITION BY entity_id)', 6)} AS share FROM g""",
    "segment_pnl"))
def segment_breakdown(spark, d):
    clean = P.clean_pnl(FX.segment_pnl(Tables(spark, d)))
    b = P.segment_breakdown(clean)
    return b.select("entity_id", "business", rnd("amount", 4).alias("amount"), rnd("share", 6).alias("share"))


@register("segment_pnl_rollup", with_fixtures(f"""
WITH c AS (SELECT entity_id, TRY_CAST(regexp_replace(adj_revenue, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS amt,
             TRY_CAST(regexp_replace(adj_ebitda, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS eb FROM segment_pnl),
g AS (SELECT entity_id, sum(amt) AS revenue, sum(eb) AS ebitda FROM c WHERE amt IS NOT NULL AND eb IS NOT NULL GROUP BY 1)
SELECT entity_id, {R('revenue', 4)} AS revenue, {R('ebitda', 4)} AS ebitda, {R('revenue - ebitda', 4)} AS expenses,
       0.0 AS liabilities, 0.0 AS cash,
       {R('CASE WHEN revenue - ebitda > 0 THEN (revenue - ebitda) / 12 ELSE 0 END', 4)} AS burn_rate FROM g""",
    "segment_pnl"))
def segment_pnl_rollup(spark, d):
    k = P.segment_pnl_rollup(P.clean_pnl(FX.segment_pnl(Tables(spark, d))))
    return k.select("entity_id", *[rnd(c, 4).alias(c) for c in
                                   ("revenue", "ebitda", "expenses", "liabilities", "cash", "burn_rate")])


@register("runway_series", with_fixtures(f"""
SELECT entity_id, ds,
  {R('cb', 6)} AS cash_balance, {R('mb', 6)} AS monthly_burn,
  {R('CASE WHEN mb > 0 THEN greatest(cb, 0) / mb ELSE 0 END', 6)} AS runway_months
FROM (SELECT entity_id, ds,
        sum(revenue - expenses) OVER (PARTITION BY entity_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cb,
        sum(expenses) OVER (PARTITION BY entity_id ORDER BY ds RANGE BETWEEN INTERVAL 2 MONTH PRECEDING AND CURRENT ROW)
          / least(3, date_diff('month', min(ds) OVER (PARTITION BY entity_id), ds) + 1) AS mb
      FROM (SELECT * FROM monthly_flows WHERE (entity_id + month(ds)) % 5 <> 0))""", "monthly_flows"))
def runway_series(spark, d):
    """K5 over flows in which every entity lacks some calendar months."""
    flows = FX.monthly_flows(Tables(spark, d)).where((F.col("entity_id") + F.month("ds")) % 5 != 0)
    r = P.runway_series(flows)
    return r.select("entity_id", "ds", *[rnd(c, 6).alias(c) for c in ("cash_balance", "monthly_burn", "runway_months")])
