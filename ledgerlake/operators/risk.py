"""Risk factors, summary, ratios, health and ESG scores.

All column expressions over one positions row per entity: no shuffle unless
the caller's input needs one. Message lists are small fixed tables joined by
broadcast (their size is the catalogue's, not the data's).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.bands import band_expr
from ledgerlake.functions.exprs import rnd, sdiv, clip
from ledgerlake.functions.fixed import (RISK_WEIGHTS, ESG_WEIGHTS, HEALTH_WEIGHTS,
                                        HEALTH_RECOMMENDATIONS, ESG_RECOMMENDATIONS)

FACTORS = ("liquidity_risk", "leverage_risk", "burn_risk")
DEC = "decimal(18,3)"


def risk_factors(pos: DataFrame) -> DataFrame:
    """Liquidity, leverage and burn risk in [0, 1], rounded to 3 places (exact decimals)."""
    rev, exp, liab = F.col("revenue"), F.col("expenses"), F.col("liabilities")
    cash = F.coalesce(F.col("cash"), F.lit(0.0))
    monthly = F.when(exp != 0, exp / 12).otherwise(F.lit(0.0))
    liquidity = F.when(monthly == 0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), 1 - sdiv(cash, monthly * 6)))
    floor_rev = F.greatest(rev, F.lit(1e-6))
    leverage = F.when(rev == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), liab / floor_rev))
    burn = F.when(rev == 0, F.lit(0.0)).otherwise(clip((exp - rev) / floor_rev, 0.0, 1.0))
    return pos.select("*", *[rnd(c, 3).try_cast(DEC).alias(n)
                             for c, n in zip((liquidity, leverage, burn), FACTORS)])


def risk_summary(factors: DataFrame) -> DataFrame:
    """R2: weighted score of the rounded factors, in exact decimal; level from the score.

    The score carries 4 decimals (0.4·a + 0.3·b + 0.3·c is exact there), so
    cut-offs at 0.33 / 0.66 are compared without binary noise.
    """
    score = None
    for name, w in RISK_WEIGHTS.items():
        term = F.col(name) * F.lit(Decimal(w))
        score = term if score is None else score + term
    lvl = (F.when(score < F.lit(Decimal("0.33")), "low")
            .when(score < F.lit(Decimal("0.66")), "medium").otherwise("high"))
    return factors.select("*", score.cast("double").alias("risk_score"), lvl.alias("risk_level"))


def risk_factor_long(factors: DataFrame, keys=("entity_id",)) -> DataFrame:
    """Factors as (factor, value) rows."""
    return factors.select(*keys, *[F.col(f).cast("double").alias(f) for f in FACTORS]).unpivot(
        list(keys), list(FACTORS), "factor", "value")


def financial_ratios(pos: DataFrame) -> DataFrame:
    """Runway, leverage, profitability and per-month ratios (0 for bad denominators)."""
    rev, exp, liab = F.col("revenue"), F.col("expenses"), F.col("liabilities")
    cash = F.coalesce(F.col("cash"), F.lit(0.0))
    monthly = F.when(exp > 0, exp / 12).otherwise(F.lit(1.0))
    return pos.select(
        "*",
        (cash / monthly).alias("cash_runway_months"),
        F.when(rev > 0, liab / rev).otherwise(F.lit(0.0)).alias("debt_to_revenue"),
        F.when(cash > 0, liab / F.greatest(cash, F.lit(1.0))).otherwise(F.lit(0.0)).alias("debt_to_equity"),
        F.when(rev > 0, (rev - exp) / rev).otherwise(F.lit(0.0)).alias("profit_margin"),
        F.when(rev > 0, exp / rev).otherwise(F.lit(0.0)).alias("expense_ratio"),
        (rev / 12).alias("revenue_per_month"),
        (exp / 12).alias("expense_per_month"))


RATIO_COLUMNS = ["cash_runway_months", "debt_to_revenue", "debt_to_equity", "profit_margin",
                 "expense_ratio", "revenue_per_month", "expense_per_month"]


def health_score(pos: DataFrame, growth: DataFrame | None = None, keys=("entity_id",),
                 growth_col: str = "growth_rate") -> DataFrame:
    """Four component scores, weighted overall score, five levels.

    ``growth`` (e.g. from ``growth_rate``) is left-joined on the keys; a missing
    growth counts as 0 like the reference's default.
    """
    df = pos if growth is None else pos.join(growth.select(*keys, growth_col), list(keys), "left")
    g = F.coalesce(F.col(growth_col), F.lit(0.0)) if growth is not None else F.lit(0.0)
    rev, exp, liab = F.col("revenue"), F.col("expenses"), F.col("liabilities")
    cash = F.coalesce(F.col("cash"), F.lit(0.0))
    margin = F.when(rev > 0, (rev - exp) / rev).otherwise(F.lit(0.0))
    runway = cash / F.when(exp > 0, exp / 12).otherwise(F.lit(1.0))
    debt = F.when(rev > 0, liab / rev).otherwise(F.lit(0.0))
    comps = {
        "profitability": clip((margin + 0.2) * 250, 0.0, 100.0),
        "liquidity": clip(runway * 10, 0.0, 100.0),
        "leverage": F.greatest(F.lit(0.0), 100 - debt * 200),
        "growth": clip((g + 0.1) * 500, 0.0, 100.0),
    }
    out = df.select("*", *[v.alias(k) for k, v in comps.items()])
    overall = sum((F.col(k) * F.lit(w) for k, w in HEALTH_WEIGHTS.items()), F.lit(0.0))
    out = out.withColumn("health_score", overall)
    return out.withColumn("health_level", band_expr("health_level", "health_score"))


def _messages(spark: SparkSession, table: dict, key_name: str) -> DataFrame:
    rows = [(k, i + 1, m) for k, msgs in table.items() for i, m in enumerate(msgs)]
    return spark.createDataFrame(rows, f"{key_name} string, ordinal int, message string")


def health_recommendations(health: DataFrame, keys=("entity_id",)) -> DataFrame:
    """The four fixed messages for each entity's health level (broadcast join)."""
    msgs = _messages(health.sparkSession, HEALTH_RECOMMENDATIONS, "health_level")
    return health.select(*keys, "health_level").join(F.broadcast(msgs), "health_level")


def esg_score(ratings: DataFrame, keys=("entity_id",)) -> DataFrame:
    """Mean rating per entity, 0.3 E + 0.3 S + 0.4 G, level ≥ .8 low / ≥ .6 medium / high."""
    g = ratings.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ESG_WEIGHTS])
    score = sum((F.col(c) * F.lit(w) for c, w in ESG_WEIGHTS.items()), F.lit(0.0))
    return (g.withColumn("esg_score", score)
             .withColumn("risk_level", band_expr("esg_level", "esg_score")))


def esg_recommendations(esg: DataFrame, keys=("entity_id",)) -> DataFrame:
    """Three fixed messages per score band (< .4, < .6, < .8, else)."""
    msgs = _messages(esg.sparkSession, ESG_RECOMMENDATIONS, "esg_band")
    return (esg.select(*keys, "esg_score", band_expr("esg_advice", "esg_score").alias("esg_band"))
               .join(F.broadcast(msgs), "esg_band"))
