"""Golden vectors worked by hand from the reference formulas."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import advice as AD
from ledgerlake.operators import benchmark as BM
from ledgerlake.operators import positions as P
from ledgerlake.operators import risk as RK
from ledgerlake.operators import scenario as SC
from ledgerlake.operators import series as SR

ROWS = [(1, 1000.0, 800.0, 300.0, 200.0), (2, 500.0, 900.0, 400.0, 0.0),
        (3, 0.0, 0.0, 10.0, 5.0), (4, 1000.0, 600.0, 100.0, 900.0)]


@pytest.fixture(scope="module")
def pos(spark):
    return spark.createDataFrame(ROWS, "entity_id long, revenue double, expenses double, liabilities double, cash double")


def by_id(df, *cols):
    return {r["entity_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_kpis(pos):
    k = by_id(P.kpis(pos), "profit", "debt_ratio", "runway_months")
    assert k[1] == pytest.approx((200, 0.3, 3.0))
    assert k[2] == pytest.approx((-400, 0.8, 0.0))
    assert k[3] == pytest.approx((0, 0, 0))
    assert k[4] == pytest.approx((400, 0.1, 18.0))


def test_risk_factors_and_summary(pos):
    s = RK.risk_summary(RK.risk_factors(pos))
    got = by_id(s, "liquidity_risk", "leverage_risk", "burn_risk", "risk_score", "risk_level")
    assert [float(x) for x in got[1][:4]] == pytest.approx([0.5, 0.3, 0.0, 0.29])
    assert got[1][4] == "low"
    assert [float(x) for x in got[2][:4]] == pytest.approx([1.0, 0.8, 0.8, 0.88])
    assert got[2][4] == "high"
    assert [float(x) for x in got[3][:4]] == pytest.approx([1.0, 0.0, 0.0, 0.4])
    assert got[3][4] == "medium"
    assert [float(x) for x in got[4][:4]] == pytest.approx([0.0, 0.1, 0.0, 0.03])
    assert got[4][4] == "low"


def test_financial_ratios(pos):
    r = by_id(RK.financial_ratios(pos), *RK.RATIO_COLUMNS[:5])
    assert r[1] == pytest.approx((3.0, 0.3, 1.5, 0.2, 0.8))
    assert r[2] == pytest.approx((0, 0.8, 0, -0.8, 1.8))
    assert r[3] == pytest.approx((5, 0, 2, 0, 0))
    assert r[4] == pytest.approx((18, 0.1, 1 / 9, 0.4, 0.6))


def test_health_score(pos):
    h = by_id(RK.health_score(pos), "health_score", "health_level")
    assert h[1][0] == pytest.approx(57.5) and h[1][1] == "fair"
    assert h[2][0] == pytest.approx(10.0) and h[2][1] == "critical"
    assert h[3][0] == pytest.approx(62.5) and h[3][1] == "good"
    assert h[4][0] == pytest.approx(85.0) and h[4][1] == "excellent"


def test_stress_test(spark, pos):
    sc = spark.createDataFrame([(1, "Optimistic Growth", 25, 0), (2, "Crisis Scenario", -35, -20),
                                (3, "Stable Scenario", 0, 0)],
                               "scenario_id int, name string, revenue_change int, expense_change int")
    s = SC.stress_test(pos.where("entity_id = 1"), sc)
    got = {r["name"]: (r["adjusted_revenue"], r["adjusted_expenses"], r["runway_months"], r["profit_loss"])
           for r in s.collect()}
    assert got["Optimistic Growth"] == pytest.approx((1250, 800, 3.0, 450))
    assert got["Crisis Scenario"] == pytest.approx((650, 640, 3.75, 10))
    assert got["Stable Scenario"] == pytest.approx((1000, 800, 3.0, 200))


def test_stress_duplicate_names_last_wins_and_defaults(spark, pos):
    sc = spark.createDataFrame([(1, "A", 10, 0), (2, "A", 20, None), (3, None, 5, 5)],
                               "scenario_id int, name string, revenue_change int, expense_change int")
    s = SC.stress_test(pos.where("entity_id = 1"), sc).collect()
    names = sorted(r["name"] for r in s)
    assert names == ["A", "Scenario_3"]
    a = [r for r in s if r["name"] == "A"][0]
    assert a["adjusted_revenue"] == pytest.approx(1200) and a["adjusted_expenses"] == pytest.approx(800)


def test_unlimited_runway(spark):
    p = spark.createDataFrame([(1, 100.0, 0.0, 0.0, 50.0)], "entity_id long, revenue double, expenses double, liabilities double, cash double")
    sc = spark.createDataFrame([(1, "S", 0, 0)], "scenario_id int, name string, revenue_change int, expense_change int")
    r = SC.stress_test(p, sc).first()
    assert r["runway_months"] is None and r["unlimited_runway"] is True


def test_esg(spark):
    r = spark.createDataFrame([(1, 0.6, 0.7, 0.8)], "entity_id long, environmental double, social double, governance double")
    e = RK.esg_score(r).first()
    assert e["esg_score"] == pytest.approx(0.71) and e["risk_level"] == "medium"
    recs = RK.esg_recommendations(RK.esg_score(r)).orderBy("ordinal").collect()
    assert [x["message"] for x in recs][0] == "Optimize ESG metrics tracking"


def test_percentile_rank(spark):
    df = spark.createDataFrame([(v,) for v in (0.3, 0.22, 0.15, 0.05, -0.1, 0.5)], "v double")
    ranks = [r[0] for r in df.select(BM.percentile_rank(F.col("v"), F.lit(0.1), F.lit(0.2), F.lit(0.25))).collect()]
    assert ranks == pytest.approx([100, 60, 37.5, 12.5, 0, 200])  # beyond p75 the rank goes on above 100


def test_monthly_resample_fills_gaps(spark):
    s = spark.createDataFrame([(1, dt.date(2024, 1, 31), 1.0), (1, dt.date(2024, 4, 2), 2.0)],
                              "entity_id long, ds date, y double")
    got = [(r["ds"], r["y"]) for r in SR.monthly_resample(s).orderBy("ds").collect()]
    assert got == [(dt.date(2024, 1, 1), 1.0), (dt.date(2024, 2, 1), 0.0), (dt.date(2024, 3, 1), 0.0),
                   (dt.date(2024, 4, 1), 2.0)]
    mean = [r["y"] for r in SR.monthly_resample(s, how="mean").orderBy("ds").collect()]
    assert mean == [1.0, None, None, 2.0]


def test_advice(spark, pos):
    k = P.kpis(pos)
    adv = by_id(AD.advisory_messages(k), "advisory")
    assert adv[2][0].startswith("⚠ Your expenses exceed revenue.")
    assert "✅ You have a healthy runway." in adv[4][0]
    sw = by_id(AD.swot(pos), "strengths", "weaknesses", "swot_risk_level", "overall_health")
    assert sw[4] == (3, 0, "medium", "good")
    assert sw[2][2] == "high"
    top = AD.top_recommendations(pos).where("entity_id = 2").orderBy("rank").collect()
    assert [r["recommendation"] for r in top] == ["Review and optimize operational expenses",
                                                  "Implement automation to reduce labor costs",
                                                  "Negotiate better terms with suppliers"]


def test_edges_null_cash_negative_revenue(spark):
    p = spark.createDataFrame([(1, 1000.0, 600.0, 0.0, None), (2, -100.0, 50.0, 10.0, 0.0)],
                              "entity_id long, revenue double, expenses double, liabilities double, cash double")
    k = by_id(P.kpis(p), "runway_months", "debt_ratio")
    assert k[1][0] == pytest.approx(8.0)          # NULL cash falls through to max(profit, 0) / burn
    r = by_id(RK.risk_summary(RK.risk_factors(p)), "leverage_risk", "burn_risk", "risk_level")
    assert float(r[2][0]) == 1.0 and float(r[2][1]) == 1.0 and r[2][2] == "high"
    h = by_id(RK.health_score(p), "health_score")
    assert 0 <= h[2][0] <= 100


def test_missing_measure_counts_as_zero(spark):
    facts = spark.createDataFrame([(1, 10.0), (1, 5.0), (2, 1.0)], "entity_id long, Revenue double")
    got = by_id(P.rollup_positions(facts), "revenue", "expenses", "liabilities", "cash")
    assert got[1] == (15.0, 0.0, 0.0, 0.0) and got[2] == (1.0, 0.0, 0.0, 0.0)
