"""Bands exactly on a cut: both forms (CASE expression and broadcast range join) agree."""

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions.bands import band_expr, band_lookup, bands_table

CASES = [
    ("risk_level", 0.33, "medium"), ("risk_level", 0.3299, "low"), ("risk_level", 0.66, "high"),
    ("esg_level", 0.8, "low"), ("esg_level", 0.6, "medium"), ("esg_level", 0.5999, "high"),
    ("health_level", 80.0, "excellent"), ("health_level", 20.0, "poor"), ("health_level", 19.99, "critical"),
    ("runway_status", 12.0, "Concerning"), ("runway_status", 12.01, "Healthy"), ("runway_status", 6.0, "Critical"),
    ("debt_swot", 0.30, "Low debt levels"), ("debt_swot", 0.5, "Manageable debt levels"),
    ("debt_swot", 0.7000001, "Very high debt levels - high risk"),
    ("margin_swot", 0.05, "Low profit margin"), ("margin_swot", 0.0499, "Negative profit margin - unsustainable"),
    ("correlation_strength", 0.8, "very strong"), ("correlation_strength", 0.1999, "very weak"),
    ("performance", 90.0, "excellent"), ("performance", 24.9, "poor"),
]


@pytest.mark.parametrize("family,value,label", CASES)
def test_case_form(spark, family, value, label):
    got = spark.range(1).select(band_expr(family, F.lit(value)).alias("l")).first()["l"]
    assert got == label


def test_join_form_matches_case_form(spark):
    from ledgerlake.functions.fixed import BAND_METRIC
    rows = [(i, BAND_METRIC[f], float(v)) for i, (f, v, _) in enumerate(CASES)]
    long = spark.createDataFrame(rows, "entity_id long, metric string, value double")
    fams = sorted({f for f, _, _ in CASES})
    out = band_lookup(long, bands_table(spark, fams))
    got = {(r["entity_id"], r["family"]): r["label"] for r in out.collect()}
    for i, (f, v, label) in enumerate(CASES):
        assert got[(i, f)] == label
    # a value outside a bounded ladder keeps a NULL label
    gauge = band_lookup(spark.createDataFrame([(1, "risk_score", 1.5)], "entity_id long, metric string, value double"),
                        bands_table(spark, ["risk_gauge"])).first()
    assert gauge["label"] is None


# Every ladder, written out: at each cut and just below it. These are literals on purpose: the code and its SQL
# twins read one catalogue, so only this table can tell that the catalogue itself is right.
LADDERS = {
    "risk_level": [(0.0, "low"), (0.32999, "low"), (0.33, "medium"), (0.65999, "medium"), (0.66, "high"), (1.0, "high")],
    "esg_level": [(1.0, "low"), (0.8, "low"), (0.79999, "medium"), (0.6, "medium"), (0.59999, "high"), (0.0, "high")],
    "esg_advice": [(0.0, "below_0.4"), (0.39999, "below_0.4"), (0.4, "below_0.6"), (0.59999, "below_0.6"), (0.6, "below_0.8"),
                   (0.79999, "below_0.8"), (0.8, "top")],
    "health_level": [(80.0, "excellent"), (79.999, "good"), (60.0, "good"), (59.999, "fair"), (40.0, "fair"), (39.999, "poor"),
                     (20.0, "poor"), (19.999, "critical"), (-5.0, "critical")],
    "correlation_strength": [(1.0, "very strong"), (0.8, "very strong"), (0.79999, "strong"), (0.6, "strong"), (0.59999, "moderate"),
                             (0.4, "moderate"), (0.39999, "weak"), (0.2, "weak"), (0.19999, "very weak"), (0.0, "very weak")],
    "performance": [(200.0, "excellent"), (90.0, "excellent"), (89.999, "above average"), (75.0, "above average"), (74.999, "average"),
                    (50.0, "average"), (49.999, "below average"), (25.0, "below average"), (24.999, "poor"), (0.0, "poor")],
    "margin_swot": [(0.2, "Excellent profit margin"), (0.19999, "Good profit margin"), (0.1, "Good profit margin"),
                    (0.09999, "Low profit margin"), (0.05, "Low profit margin"), (0.04999, "Negative profit margin - unsustainable")],
    "debt_swot": [(0.3, "Low debt levels"), (0.30001, "Manageable debt levels"), (0.5, "Manageable debt levels"),
                  (0.50001, "High debt levels"), (0.7, "High debt levels"), (0.70001, "Very high debt levels - high risk")],
    "runway_swot": [(18.0, "Strong cash position"), (17.999, "Adequate cash runway"), (12.0, "Adequate cash runway"),
                    (11.999, "Short cash runway"), (6.0, "Short cash runway"), (5.999, "Critical cash shortage")],
    "debt_status": [(0.29999, "Low"), (0.3, "Medium"), (0.49999, "Medium"), (0.5, "High")],
    "runway_status": [(12.001, "Healthy"), (12.0, "Concerning"), (6.001, "Concerning"), (6.0, "Critical")],
    "risk_gauge": [(0.0, "green"), (0.29999, "green"), (0.3, "yellow"), (0.69999, "yellow"), (0.7, "red"), (1.0, "red"), (1.01, None)],
}


def test_every_ladder(spark):
    from ledgerlake.functions.fixed import BANDS
    assert set(LADDERS) == set(BANDS)
    cases = [(f, v, label) for f, steps in LADDERS.items() for v, label in steps]
    cols = [band_expr(f, F.lit(v)).alias(f"c{i}") for i, (f, v, _) in enumerate(cases)]
    got = spark.range(1).select(*cols).first()
    assert [(f, v, got[i]) for i, (f, v, _) in enumerate(cases)] == cases
