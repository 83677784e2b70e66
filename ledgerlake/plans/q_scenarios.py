"""Queries X1–X3 (stress scenarios) and P1–P6 (path risk)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions.exprs import exact_sum, rnd
from ledgerlake.functions.fixed import STABLE_SCENARIO
from ledgerlake.operators import paths as PT
from ledgerlake.operators import scenario as SC
from ledgerlake.plans.oracle_fixtures import R, with_fixtures
from ledgerlake.plans.registry import register
from ledgerlake.plans.sqlbits import band_sql, risk_cte, values_sql
from ledgerlake.sources import fixtures as FX
from ledgerlake.sources.tables import Tables

_ST = """st AS (SELECT p.*, s.scenario_id, s.name, s.revenue_change, s.expense_change,
    p.revenue * (1 + s.revenue_change / 100) AS adjusted_revenue,
    p.expenses * (1 + s.expense_change / 100) AS adjusted_expenses
  FROM positions p CROSS JOIN scenarios s),
st2 AS (SELECT *, adjusted_expenses / 12 AS monthly, adjusted_revenue - adjusted_expenses AS profit_loss FROM st)"""


def _stressed(spark, d, scenarios=None):
    return SC.stress_test(FX.positions(Tables(spark, d)), scenarios or FX.scenarios(spark))


@register("stress_test", with_fixtures(f"""
WITH {_ST}
SELECT entity_id, scenario_id, name AS scenario, {R('adjusted_revenue', 6)} AS adjusted_revenue,
  {R('adjusted_expenses', 6)} AS adjusted_expenses,
  {R('CASE WHEN monthly > 0 THEN coalesce(cash, 0) / monthly END', 4)} AS runway_months,
  monthly <= 0 AS unlimited_runway, {R('profit_loss', 6)} AS profit_loss,
  revenue_change AS revenue_change_pct, expense_change AS expense_change_pct
FROM st2""", "positions", "scenarios"))
def stress_test(spark, d):
    s = _stressed(spark, d)
    return s.select("entity_id", "scenario_id", F.col("name").alias("scenario"),
                    rnd("adjusted_revenue", 6).alias("adjusted_revenue"),
                    rnd("adjusted_expenses", 6).alias("adjusted_expenses"),
                    rnd("runway_months", 4).alias("runway_months"), "unlimited_runway",
                    rnd("profit_loss", 6).alias("profit_loss"),
                    F.col("revenue_change").alias("revenue_change_pct"),
                    F.col("expense_change").alias("expense_change_pct"))


def _groups_sql():
    from ledgerlake.functions.fixed import COMBINED_SCENARIOS, EXPENSE_SCENARIOS, REVENUE_SCENARIOS
    rows, i = [], 0
    for g, lst in (("revenue", REVENUE_SCENARIOS), ("expense", EXPENSE_SCENARIOS), ("combined", COMBINED_SCENARIOS)):
        for n, r, e in lst:
            i += 1
            rows.append((i, g, n, r, e))
    return values_sql(rows, ["scenario_id", "scenario_group", "name", "revenue_change", "expense_change"])


@register("scenario_union", with_fixtures(f"""
WITH sg AS {_groups_sql()},
st AS (SELECT s.scenario_group, s.name,
    p.revenue * (1 + s.revenue_change / 100) - p.expenses * (1 + s.expense_change / 100) AS profit_loss
  FROM positions p CROSS JOIN sg s)
SELECT scenario_group, name AS scenario, count(*) AS entities,
  count(*) FILTER (WHERE profit_loss < 0) AS loss_making,
  sum(CAST(floor(profit_loss * 1000000.0 + 0.5) AS BIGINT)) / 1000000.0 AS total_profit_loss
FROM st GROUP BY 1, 2""", "positions"))
def scenario_union(spark, d):
    """The three scenario lists as one table, applied to every entity, summed per scenario."""
    sc = SC.scenario_groups(spark)
    s = SC.stress_test(FX.positions(Tables(spark, d)), sc)
    return s.groupBy("scenario_group", F.col("name").alias("scenario")).agg(
        F.count(F.lit(1)).alias("entities"), F.count_if(F.col("profit_loss") < 0).alias("loss_making"),
        exact_sum("profit_loss", 6).alias("total_profit_loss"))


@register("scenario_compare", with_fixtures(f"""
WITH {_ST},
st3 AS (SELECT entity_id, name, liabilities, cash, profit_loss,
    adjusted_revenue AS revenue, adjusted_expenses AS expenses,
    profit_loss - max(CASE WHEN name = '{STABLE_SCENARIO}' THEN profit_loss END) OVER (PARTITION BY entity_id) AS delta,
    rank() OVER (PARTITION BY entity_id ORDER BY profit_loss DESC) AS rk FROM st2),
{risk_cte('st3')}
SELECT entity_id, name AS scenario, {R('profit_loss', 6)} AS profit_loss, {R('delta', 6)} AS delta_vs_stable,
  CAST(rk AS INTEGER) AS profit_rank, CAST(score AS DOUBLE) AS risk_score,
  {band_sql('risk_level', 'score')} AS risk_level FROM risk""", "positions", "scenarios"))
def scenario_compare(spark, d):
    c = SC.scenario_compare(_stressed(spark, d))
    return c.select("entity_id", F.col("name").alias("scenario"), rnd("profit_loss", 6).alias("profit_loss"),
                    rnd("delta_vs_stable", 6).alias("delta_vs_stable"), "profit_rank", "risk_score", "risk_level")


# ---------------------------------------------------------------- P1–P6
def _params(spark, d):
    return PT.flow_params(FX.monthly_flows(Tables(spark, d)))


def _paths(spark, d):
    return PT.outcome_paths(FX.supplier_flows(Tables(spark, d)))


def _summary(spark, d):
    return PT.path_summary(_paths(spark, d))


_PARAMS = f"""mf AS (SELECT entity_id, ds, sum(revenue) AS revenue, sum(expenses) AS expenses FROM monthly_flows GROUP BY 1, 2),
sp AS (SELECT entity_id, unnest(generate_series(min(ds), max(ds), INTERVAL 1 MONTH)) AS ds FROM mf GROUP BY 1),
ff AS (SELECT sp.entity_id, coalesce(mf.revenue, 0) AS revenue, coalesce(mf.expenses, 0) AS expenses
       FROM sp LEFT JOIN mf ON mf.entity_id = sp.entity_id AND mf.ds = CAST(sp.ds AS DATE)),
params AS (SELECT entity_id, count(*) AS n_months, {R('avg(revenue)', 2)} AS revenue_mean,
   {R('coalesce(stddev_samp(revenue), 0)', 2)} AS revenue_std, {R('avg(expenses)', 2)} AS expense_mean,
   {R('coalesce(stddev_samp(expenses), 0)', 2)} AS expense_std FROM ff GROUP BY 1),
params2 AS (SELECT *, {R('expense_mean * 6.0', 2)} AS initial_cash FROM params)"""


_RUNS = f"""sm AS (SELECT entity_id, ds, sum(revenue) AS revenue, sum(expenses) AS expenses FROM supplier_flows GROUP BY 1, 2),
ss AS (SELECT entity_id, unnest(generate_series(min(ds), max(ds), INTERVAL 1 MONTH)) AS ds FROM sm GROUP BY 1),
sg AS (SELECT ss.entity_id, date_diff('month', min(ss.ds) OVER w, ss.ds) AS i, count(*) OVER w AS n,
    CAST(floor(coalesce(revenue, 0) * 100.0 + 0.5) AS BIGINT) AS rc, CAST(floor(coalesce(expenses, 0) * 100.0 + 0.5) AS BIGINT) AS ec,
    {R('avg(coalesce(expenses, 0)) OVER w', 2)} AS mean_expenses
  FROM ss LEFT JOIN sm ON sm.entity_id = ss.entity_id AND sm.ds = CAST(ss.ds AS DATE) WINDOW w AS (PARTITION BY ss.entity_id)),
dr AS (SELECT a.entity_id, a.i AS path_id, b.i - a.i + 1 AS step, b.rc, b.ec,
    CAST(floor({R('b.mean_expenses * 6.0', 2)} * 100.0 + 0.5) AS BIGINT) AS initial_cents
  FROM sg a JOIN sg b ON a.entity_id = b.entity_id AND b.i BETWEEN a.i AND a.i + 11 WHERE a.i <= greatest(a.n - 12, 0)),
bal AS (SELECT *, initial_cents + sum(rc - ec) OVER (PARTITION BY entity_id, path_id ORDER BY step
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bc FROM dr),
fin AS (SELECT entity_id, path_id, max(initial_cents) + sum(rc - ec) AS final_cents, min(bc) AS min_cents
   FROM bal GROUP BY 1, 2)"""


@register("flow_params", with_fixtures(f"""
WITH {_PARAMS}
SELECT * FROM params2""", "monthly_flows"))
def flow_params(spark, d):
    return _params(spark, d)


@register("outcome_paths", with_fixtures(f"""
WITH {_RUNS}
SELECT entity_id, CAST(path_id AS BIGINT) AS path_id, CAST(step AS INTEGER) AS step,
  rc / 100.0 AS revenue, ec / 100.0 AS expenses FROM dr""", "supplier_flows"))
def outcome_paths(spark, d):
    p = _paths(spark, d)
    return p.select("entity_id", "path_id", "step", (F.col("revenue_cents") / 100.0).alias("revenue"),
                    (F.col("expense_cents") / 100.0).alias("expenses"))


@register("running_balance", with_fixtures(f"""
WITH {_RUNS}
SELECT entity_id, CAST(path_id AS BIGINT) AS path_id, CAST(step AS INTEGER) AS step, bc / 100.0 AS balance FROM bal""",
    "supplier_flows"))
def running_balance(spark, d):
    p = _paths(spark, d)
    return PT.running_balance(p).select("entity_id", "path_id", "step",
                                        (F.col("balance_cents") / 100.0).alias("balance"))


@register("tail_risk", with_fixtures(f"""
WITH {_RUNS}
SELECT entity_id, {R('avg(final_cents) / 100.0', 6)} AS expected_final_cash,
  {R('quantile_cont(final_cents, 0.05) / 100.0', 6)} AS var_95,
  {R('quantile_cont(final_cents, 0.01) / 100.0', 6)} AS var_99,
  {R('quantile_cont(final_cents, 0.025) / 100.0', 6)} AS ci_95_lower,
  {R('quantile_cont(final_cents, 0.975) / 100.0', 6)} AS ci_95_upper
FROM fin GROUP BY 1""", "supplier_flows"))
def tail_risk(spark, d):
    t = PT.tail_risk(_summary(spark, d))
    return t.select("entity_id", *[rnd(c, 6).alias(c) for c in
                                   ("expected_final_cash", "var_95", "var_99", "ci_95_lower", "ci_95_upper")])


@register("breach_probability", with_fixtures(f"""
WITH {_RUNS}
SELECT entity_id, {R('avg(CASE WHEN min_cents < 0 THEN 1.0 ELSE 0.0 END)', 4)} AS breach_probability,
  count(*) AS paths FROM fin GROUP BY 1""", "supplier_flows"))
def breach_probability(spark, d):
    b = PT.breach_probability(_summary(spark, d))
    return b.select("entity_id", rnd("breach_probability", 4).alias("breach_probability"), "paths")


@register("final_cash_histogram", with_fixtures(f"""
WITH {_RUNS},
fv AS (SELECT entity_id, final_cents / 100.0 AS v FROM fin),
mm AS (SELECT *, min(v) OVER (PARTITION BY entity_id) AS mn, max(v) OVER (PARTITION BY entity_id) AS mx FROM fv),
bb AS (SELECT entity_id, mn, mx, CAST(CASE WHEN mx - mn > 0 THEN least(50, floor((v - mn) / (mx - mn) * 50) + 1) ELSE 1 END AS INTEGER) AS bin FROM mm)
SELECT entity_id, bin, {R('mn + (bin - 1) * ((mx - mn) / 50)', 4)} AS lower_edge,
  {R('mn + bin * ((mx - mn) / 50)', 4)} AS upper_edge, count(*) AS paths
FROM bb GROUP BY entity_id, bin, mn, mx""", "supplier_flows"))
def final_cash_histogram(spark, d):
    h = PT.final_cash_histogram(_summary(spark, d))
    return h.select("entity_id", "bin", rnd("lower_edge", 4).alias("lower_edge"),
                    rnd("upper_edge", 4).alias("upper_edge"), "paths")
