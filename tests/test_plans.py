"""Plan checks: broadcast range join for bands, pushed filters, no Python in the SQL-only operators."""

from ledgerlake.functions.bands import band_lookup, bands_table
from ledgerlake.operators import positions as P
from ledgerlake.operators import risk as RK
from ledgerlake.sources import fixtures as FX
from ledgerlake.sources.tables import Tables

from conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_band_lookup_is_broadcast_hash_join(spark):
    pos = FX.positions(Tables(spark, SF_SMALL))
    long = P.kpis(pos).select("entity_id", "debt_ratio").unpivot("entity_id", ["debt_ratio"], "metric", "value")
    out = band_lookup(long, bands_table(spark, ["debt_status"]))
    s = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in s and "NestedLoop" not in s


def test_risk_plan_has_no_python(spark):
    s = plan(RK.risk_summary(RK.risk_factors(FX.positions(Tables(spark, SF_SMALL)))))
    assert "Python" not in s and "ArrowEval" not in s


def test_series_filter_reaches_the_scan(spark):
    li = Tables(spark, SF_SMALL).lineitem.where("l_suppkey = 3").select("l_extendedprice")
    s = li._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_suppkey), EqualTo(l_suppkey,3)]" in s
    assert "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double>" in s
