"""K1–K6: facts rolled up to positions, KPIs and ratios.

Rollups are one ``groupBy`` with map-side partial aggregation, so a hot
entity costs one pre-aggregated row per task, not a hot reducer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.exprs import col_or_zero, sdiv, strip_to_number

MEASURES = ("revenue", "expenses", "liabilities", "cash")


def rollup_positions(facts: DataFrame, by=("entity_id",), measures=MEASURES) -> DataFrame:
    """K2: sum each measure per entity; a measure the facts lack counts as 0."""
    aggs = [F.sum(col_or_zero(facts, m)).alias(m) for m in measures]
    return facts.groupBy(*by).agg(*aggs)


def clean_pnl(pnl: DataFrame, columns=("gov", "adj_revenue", "adj_ebitda"),
              required=("adj_revenue", "adj_ebitda")) -> DataFrame:
    """Strip P&L text to numbers; drop rows whose revenue or EBITDA is unusable."""
    out = pnl
    for c in columns:
        out = out.withColumn(c, strip_to_number(F.col(c)))
    return out.na.drop(subset=list(required))


def segment_pnl_rollup(clean: DataFrame, by=("entity_id",), revenue="adj_revenue",
                       ebitda="adj_ebitda") -> DataFrame:
    """K1: revenue and EBITDA over segments; expenses = revenue − EBITDA; monthly burn."""
    g = clean.groupBy(*by).agg(F.sum(revenue).alias("revenue"), F.sum(ebitda).alias("ebitda"))
    exp = F.col("revenue") - F.col("ebitda")
    return g.select(*by, "revenue", "ebitda", exp.alias("expenses"),
                    F.lit(0.0).alias("liabilities"), F.lit(0.0).alias("cash"),
                    F.when(exp > 0, exp / 12).otherwise(F.lit(0.0)).alias("burn_rate"))


def segment_breakdown(df: DataFrame, by=("entity_id",), segment="business", amount="adj_revenue") -> DataFrame:
    """K3: amount per segment and its share of the entity total."""
    g = df.groupBy(*by, segment).agg(F.sum(amount).alias("amount"))
    w = Window.partitionBy(*by)
    return g.withColumn("share", sdiv(F.col("amount"), F.sum("amount").over(w)))


def monthly_burn(expenses) -> F.Column:
    e = F.col(expenses) if isinstance(expenses, str) else expenses
    return F.when(e > 0, e / 12).otherwise(F.lit(0.0))


def kpis(pos: DataFrame, burn_col: str | None = None) -> DataFrame:
    """K4: profit, debt ratio, burn rate and runway.

    runway = (cash, or max(profit, 0) when cash is NULL or zero) / burn; 0 without burn.
    """
    burn = F.col(burn_col) if burn_col else monthly_burn("expenses")
    profit = F.col("revenue") - F.col("expenses")
    cash = F.col("cash")
    numer = F.when(F.coalesce(cash, F.lit(0.0)) != 0, cash).otherwise(F.greatest(profit, F.lit(0.0)))
    return pos.select(
        "*", profit.alias("profit"),
        F.when(F.col("revenue") != 0, sdiv(F.col("liabilities"), F.col("revenue"))).otherwise(F.lit(0.0)).alias("debt_ratio"),
        burn.alias("burn_rate"),
        F.when(burn != 0, sdiv(numer, burn)).otherwise(F.lit(0.0)).alias("runway_months"))


def runway_series(flows: DataFrame, by=("entity_id",), ds="ds", window_months: int = 3) -> DataFrame:
    """K5: monthly runway = running cash balance / mean expenses of the last ``window_months`` calendar months.

    A month without a row counts as a month without expenses; an entity's first months average over the
    months since its first row.
    """
    month = F.year(ds) * 12 + F.month(ds)
    w = Window.partitionBy(*by).orderBy(month)
    cash = F.sum(F.col("revenue") - F.col("expenses")).over(w.rangeBetween(Window.unboundedPreceding, 0))
    months = F.least(F.lit(window_months), month - F.min(month).over(Window.partitionBy(*by)) + 1)
    burn = F.sum("expenses").over(w.rangeBetween(-(window_months - 1), 0)) / months
    out = flows.select(*by, ds, cash.alias("cash_balance"), burn.alias("monthly_burn"))
    return out.withColumn("runway_months", F.when(F.col("monthly_burn") > 0,
                                                  sdiv(F.greatest(F.col("cash_balance"), F.lit(0.0)),
                                                       F.col("monthly_burn"))).otherwise(F.lit(0.0)))


def margin_ratios(pos: DataFrame) -> DataFrame:
    """K6: profit margin %, expense ratio %, cash ratio %; 0 for a non-positive denominator."""
    rev, exp, cash = F.col("revenue"), F.col("expenses"), F.col("cash")
    return pos.select(
        "*",
        F.when(rev > 0, (rev - exp) / rev * 100).otherwise(F.lit(0.0)).alias("profit_margin_pct"),
        F.when(rev > 0, exp / rev * 100).otherwise(F.lit(0.0)).alias("expense_ratio_pct"),
        F.when(exp > 0, F.coalesce(cash, F.lit(0.0)) / exp * 100).otherwise(F.lit(0.0)).alias("cash_ratio_pct"))
