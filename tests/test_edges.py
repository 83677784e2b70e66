"""Inputs at the edge: large values, NULL keys and dates, short and all-zero series, empty tables, long parameter lists."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.functions.exprs import exact_sum, rnd
from ledgerlake.functions.quantiles import exact_quantiles
from ledgerlake.operators import forecast as FC
from ledgerlake.operators import quality as QU
from ledgerlake.operators import scenario as SC
from ledgerlake.operators import series as SR
from ledgerlake.functions.student import beta_half


def _months(n, start=2015):
    return [dt.date(start + i // 12, i % 12 + 1, 1) for i in range(n)]


def test_large_values(spark):
    df = spark.createDataFrame([(1e14,), (1e14,), (0.25,)], "x double")
    assert [r[0] for r in df.select(rnd("x", 6)).collect()] == [1e14, 1e14, 0.25]
    assert df.agg(exact_sum("x", 6)).first()[0] == 200000000000000.25


def test_quantiles_keep_a_null_key(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0), (None, 7.0)], "k string, v double")
    got = {r["k"]: (r["n"], r["median"]) for r in exact_quantiles(df, ["k"], "v", [0.5], ["median"]).collect()}
    assert got == {"a": (2, 2.0), None: (3, 7.0)}


def test_rows_without_a_date_are_left_out(spark):
    df = spark.createDataFrame([(1, dt.date(2020, 1, 5), 2.0), (1, None, 9.0), (1, dt.date(2020, 3, 5), 4.0)],
                               "entity_id long, ds date, y double")
    assert [r["y"] for r in SR.monthly_resample(df).orderBy("ds").collect()] == [2.0, 0.0, 4.0]


def test_completeness_of_an_empty_table(spark):
    stats = spark.createDataFrame([("a", 0, 0)], "column string, n_rows long, non_null long")
    assert QU.completeness(stats).first()["completeness"] is None


def test_short_and_zero_series(spark):
    rng = np.random.default_rng(1)
    rows = [(1, d, float(100 + rng.normal())) for d in _months(40)] + [(2, d, 5.0) for d in _months(20)]
    rows += [(3, d, 0.0) for d in _months(40)] + [(4, d, 7.0) for d in _months(3)]
    rows += [(5, d, 50.0 + i) for i, d in enumerate(_months(6))] + [(6, d, 1.0) for d in _months(4)]
    df = spark.createDataFrame(rows, "entity_id long, ds date, y double")
    for model in ("random_forest", "gradient_boosting"):
        got = FC.ml_forecast(df, model, steps=2, num_trees=5).collect()
        by = {e: [r for r in got if r["entity_id"] == e] for e in range(1, 7)}
        assert [len(by[e]) for e in range(1, 7)] == [2, 2, 2, 1, 2, 2]
        assert by[4][0]["status"] == "no lag row: fewer than 4 months (3)" and by[4][0]["forecast"] is None
        assert {r["status"] for e in (1, 2, 3, 5, 6) for r in by[e]} == {"ok"}
        assert abs(by[1][0]["forecast"] - 100) < 5 and abs(by[2][0]["forecast"] - 5) < 0.5
        assert 45 < by[5][0]["forecast"] < 60


def test_many_scenarios_and_none(spark):
    pos = spark.createDataFrame([(1, 100.0, 50.0, 10.0)], "entity_id long, revenue double, expenses double, cash double")
    many = spark.range(12_000).select(F.col("id").cast("int").alias("scenario_id"), F.concat(F.lit("s"), "id").alias("name"),
                                      F.lit(1).alias("revenue_change"), F.lit(0).alias("expense_change"))
    assert SC.stress_test(pos, many).count() == 12_000
    assert SC.stress_test(pos, many.where("false")).count() == 0


def test_incomplete_beta(spark):
    # I_x(2, 1/2) and I_x(1/2, 1/2) have closed forms
    x = np.array([0.1, 0.3, 0.6, 0.9, 0.99])
    u = 1 - x
    want = 0.75 * ((2 - 2 / 3) - (2 * np.sqrt(u) - 2 / 3 * u ** 1.5))
    df = spark.createDataFrame([(float(v),) for v in x], "x double").orderBy("x")
    at = lambda a: [r[0] for r in df.select(beta_half(F.lit(a), F.col("x"), 1 - F.col("x"))).collect()]
    assert at(2.0) == pytest.approx(want, abs=1e-12)
    assert at(0.5) == pytest.approx(2 / np.pi * np.arcsin(np.sqrt(x)), abs=1e-12)


def test_empty_table_does_not_score_best(spark):
    df = spark.createDataFrame([], "revenue double, note string")
    s = QU.quality_score(df).first()
    assert (s["quality_score"], s["errors"], s["completeness"]) == (0.0, 1, None)
    assert [tuple(r) for r in QU.findings(df).collect()] == [("empty_table", None, "error", 0)]
    assert QU.suggestions(df).collect() == []


def test_every_finding_and_suggestion(spark):
    rows = [(float(i % 5), f"{i}.5", f"2024-01-{i % 28 + 1:02d}", None, None, 3e10 if i == 7 else 1.0) for i in range(100)]
    rows += [(-1.0, "x", None, None, None, 1.0), (None,) * 6, (-1.0, "x", None, None, None, 1.0)] + [(900.0 + i, "1", None, None, "t", 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "revenue double, amount string, day string, blank string, rare string, cash double")
    found = {(r["code"], r["column"]): (r["severity"], r["n"]) for r in QU.findings(df).collect()}
    assert found == {
        ("empty_columns", None): ("error", 1), ("stored_as_text_numeric", "amount"): ("warning", 120),
        ("stored_as_text_date", "day"): ("warning", 100), ("negative_values", "revenue"): ("warning", 2),
        ("extreme_values", "cash"): ("warning", 1), ("outliers", "revenue"): ("warning", 20),
        ("low_completeness", None): ("warning", 123 * 6 - 122 * 2 - 122 - 100 - 20), ("empty_rows", None): ("warning", 1), ("duplicate_rows", None): ("warning", 1)}
    told = {(r["code"], r["column"]) for r in QU.suggestions(df).collect()}
    assert told == {("convert_to_numeric", "amount"), ("convert_to_datetime", "day"), ("impute_missing", "day"),
                    ("impute_missing", "blank"), ("impute_missing", "rare"), ("review_outliers", "revenue")}


def test_runway_of_a_gapped_entity_averages_calendar_months(spark):
    from ledgerlake.operators.positions import runway_series
    rows = [(1, dt.date(2024, 1, 1), 100.0, 30.0), (1, dt.date(2024, 2, 1), 0.0, 60.0), (1, dt.date(2024, 5, 1), 0.0, 9.0),
            (1, dt.date(2024, 6, 1), 0.0, 12.0)]
    got = runway_series(spark.createDataFrame(rows, "entity_id long, ds date, revenue double, expenses double")).orderBy("ds").collect()
    assert [r["monthly_burn"] for r in got] == [30.0, 45.0, 3.0, 7.0]


def test_coercion_counts_what_it_loses(spark):
    from pyspark.sql import Observation
    from ledgerlake.operators import clean as CL
    df = spark.createDataFrame([("2024-01-05", "1.5"), (None, "2"), ("soon", "3"), ("2024-02-01", "many"), ("2024-03-01", None)], "d string, v string")
    seen = Observation()
    kept = CL.coerce_series(df, "d", "v", observation=seen)
    assert sorted((str(r.ds), r.y) for r in kept.collect() if r.y) == [("2024-01-05", 1.5)]
    assert seen.get == {"rows": 5, "null_dates": 1, "rejected_dates": 1, "rejected_values": 1}


def test_text_to_number_keeps_signs_and_exponents(spark):
    from ledgerlake.functions.exprs import strip_to_number, text_to_number
    rows = ["1e5", "(100)", "12%", "$1,234.5", "1_000", "-3", "($2.5e1)", "abc", "", None, "Rs 7"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i")
    got = [tuple(r) for r in df.select(text_to_number("t"), strip_to_number("t")).collect()]
    assert [g[0] for g in got] == [1e5, -100.0, 12.0, 1234.5, 1000.0, -3.0, -25.0, None, None, None, 7.0]
    assert [g[1] for g in got] == [15.0, 100.0, 12.0, 1234.5, 1000.0, -3.0, 2.51, None, None, None, 7.0]


def test_long_band_tables_are_not_broadcast(spark, monkeypatch):
    from ledgerlake.functions import bands as BD
    table = BD.bands_table(spark)
    df = spark.createDataFrame([("risk_score", 0.5), ("risk_score", 0.1)], "metric string, value double")
    want = sorted(map(str, BD.band_lookup(df, table).collect()))
    monkeypatch.setattr(BD, "FEW_BANDS", 3)
    assert sorted(map(str, BD.band_lookup(df, table).collect())) == want


def test_scenarios_in_blocks(spark, monkeypatch):
    pos = spark.createDataFrame([(i, 100.0, 50.0, 10.0) for i in range(5)], "entity_id long, revenue double, expenses double, cash double")
    sc = spark.range(70).select(F.col("id").cast("int").alias("scenario_id"), F.concat(F.lit("s"), "id").alias("name"),
                                F.col("id").cast("int").alias("revenue_change"), F.lit(None).cast("int").alias("expense_change"))
    want = sorted(map(str, SC.stress_test(pos, sc).collect()))
    monkeypatch.setattr(SC, "BLOCK", 8)
    assert sorted(map(str, SC.stress_test(pos, sc).collect())) == want and len(want) == 350
