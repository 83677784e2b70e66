"""Properties: partitioning does not change results; bounds hold; cleaning is idempotent."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.functions.quantiles import exact_quantiles
from ledgerlake.operators import clean as CL
from ledgerlake.operators import paths as PT
from ledgerlake.sources import fixtures as FX
from ledgerlake.sources.tables import Tables

from conftest import SF_SMALL


def _flows(spark):
    rng = np.random.default_rng(5)
    rows = []
    for e, n in ((1, 40), (2, 12), (3, 7), (4, 1)):
        for k in range(n):
            if not (e == 1 and k in (9, 10, 25)):  # months without a row count as zero
                rows.append((e, dt.date(2015 + k // 12, k % 12 + 1, 1), float(rng.uniform(0, 900)), float(rng.uniform(0, 1000))))
    return spark.createDataFrame(rows, "entity_id long, ds date, revenue double, expenses double"), rows


def test_paths_are_runs_of_real_months(spark):
    df, rows = _flows(spark)
    got = {}
    for r in PT.running_balance(PT.outcome_paths(df.repartition(5))).collect():
        got.setdefault((r["entity_id"], r["path_id"]), {})[r["step"]] = r
    summary = {(r["entity_id"], r["path_id"]): r for r in PT.path_summary(PT.outcome_paths(df)).collect()}
    for e, n in ((1, 40), (2, 12), (3, 7), (4, 1)):
        months = [(0, 0)] * n
        for k, d, rev, exp in rows:
            if k == e:
                months[(d.year - 2015) * 12 + d.month - 1] = (int(rev * 100 + 0.5), int(exp * 100 + 0.5))
        mean = np.floor(np.mean([r[3] for r in rows if r[0] == e] + [0] * (n - sum(r[0] == e for r in rows))) * 100 + 0.5) / 100
        cash = int(np.floor(np.floor(mean * 6 * 100 + 0.5) / 100 * 100 + 0.5))
        starts = range(max(n - 12, 0) + 1)
        assert {p for k, p in got if k == e} == set(starts)
        for p in starts:
            flows = months[p:p + 12]
            balance = cash + np.cumsum([a - b for a, b in flows])
            assert [got[e, p][s + 1]["balance_cents"] for s in range(len(flows))] == balance.tolist()
            assert (summary[e, p]["final_cents"], summary[e, p]["min_cents"]) == (balance[-1], balance.min())


def test_tail_risk_order_breach_range_and_histogram(spark):
    s = PT.path_summary(PT.outcome_paths(_flows(spark)[0]))
    for r in PT.tail_risk(s).collect():
        assert r["var_99"] <= r["var_95"] <= r["ci_95_upper"]
    low = {(r["entity_id"]): [] for r in s.collect()}
    for r in s.collect():
        low[r["entity_id"]].append(r["min_cents"] < 0)
    for r in PT.breach_probability(s).collect():
        assert r["breach_probability"] == pytest.approx(np.mean(low[r["entity_id"]])) and r["paths"] == len(low[r["entity_id"]])
    bins = PT.final_cash_histogram(s, bins=5).groupBy("entity_id").agg(F.sum("paths").alias("n"), F.max("bin").alias("b")).collect()
    assert {r["entity_id"]: r["n"] for r in bins} == {1: 29, 2: 1, 3: 1, 4: 1} and all(r["b"] <= 5 for r in bins)


def test_exact_quantiles_match_numpy_any_partitioning(spark):
    rng = np.random.default_rng(0)
    vals = [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, 3000), rng.lognormal(size=3000))]
    df = spark.createDataFrame(vals, "k long, v double")
    for parts in (1, 7):
        q = {r["k"]: (r["a"], r["b"]) for r in exact_quantiles(df.repartition(parts), ["k"], "v", [0.1, 0.75],
                                                                ["a", "b"], num_partitions=parts + 2).collect()}
        for k in range(3):
            xs = np.array([v for kk, v in vals if kk == k])
            assert q[k] == pytest.approx(tuple(np.percentile(xs, [10, 75])))


def test_dedupe_and_cleaning_idempotent(spark):
    m = FX.messy(Tables(spark, SF_SMALL))
    once = CL.dedupe_rows(m)
    assert once.count() == CL.dedupe_rows(once).count()
    c1 = CL.clean_numeric_text(m)
    c2 = CL.clean_numeric_text(c1)
    assert c1.schema == c2.schema
    assert c1.exceptAll(c2).count() == 0


def test_shares_sum_to_one(spark):
    from ledgerlake.operators import positions as P
    clean = P.clean_pnl(FX.segment_pnl(Tables(spark, SF_SMALL)))
    s = P.segment_breakdown(clean).groupBy("entity_id").agg(F.sum("share").alias("t")).collect()
    assert all(abs(r["t"] - 1) < 1e-9 for r in s)


def test_stable_scenario_equals_base(spark):
    from ledgerlake.operators import scenario as SC
    pos = FX.positions(Tables(spark, SF_SMALL))
    s = SC.stress_test(pos, FX.scenarios(spark)).where(F.col("name") == "Stable Scenario")
    bad = s.where((F.col("adjusted_revenue") != F.col("revenue")) | (F.col("adjusted_expenses") != F.col("expenses")))
    assert bad.count() == 0
