"""Stress scenarios applied to every entity.

The scenario list is a parameter table of any length, joined to each entity row by block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.fixed import (REVENUE_SCENARIOS, EXPENSE_SCENARIOS, COMBINED_SCENARIOS,
                                        STABLE_SCENARIO)
from ledgerlake.operators.risk import risk_factors, risk_summary


#: Scenarios of a block.
BLOCK = 10_000


def scenario_groups(spark) -> DataFrame:
    """The revenue, expense and combined scenario lists as one table (union by name)."""
    frames = []
    start = 0
    for group, rows in (("revenue", REVENUE_SCENARIOS), ("expense", EXPENSE_SCENARIOS),
                        ("combined", COMBINED_SCENARIOS)):
        data = [(start + i + 1, group, n, r, e) for i, (n, r, e) in enumerate(rows)]
        start += len(rows)
        frames.append(spark.createDataFrame(
            data, "scenario_id int, scenario_group string, name string, revenue_change int, expense_change int"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def clean_scenarios(scenarios: DataFrame) -> DataFrame:
    """Default names ``Scenario_<i>``, missing changes 0, duplicate names: last one wins."""
    named = scenarios.withColumn("name", F.coalesce(F.col("name"),
                                                    F.concat(F.lit("Scenario_"), F.col("scenario_id").cast("string"))))
    w = Window.partitionBy("name").orderBy(F.col("scenario_id").desc())
    return (named.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
                 .withColumn("revenue_change", F.coalesce("revenue_change", F.lit(0)))
                 .withColumn("expense_change", F.coalesce("expense_change", F.lit(0))))


def stress_test(pos: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every entity under every scenario; runway NULL + ``unlimited_runway`` without burn.

    The scenarios are dealt into blocks of about ``BLOCK`` rows, and an entity row is repeated once per block, so
    that the two meet in an equi-join on the block: no list is gathered in one task or on the driver. A single
    block, which has a counted size, is broadcast. Without scenarios there are no rows.
    """
    sc = clean_scenarios(scenarios)
    blocks = -(-sc.count() // BLOCK)
    sc = sc.withColumn("_block", F.pmod(F.xxhash64("name"), F.lit(max(blocks, 1))).cast("int"))
    each = pos.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))))
    j = each.join(F.broadcast(sc) if blocks <= 1 else sc, "_block").drop("_block")
    adj_rev = F.col("revenue") * (1 + F.col("revenue_change") / 100)
    adj_exp = F.col("expenses") * (1 + F.col("expense_change") / 100)
    out = j.withColumn("adjusted_revenue", adj_rev).withColumn("adjusted_expenses", adj_exp)
    monthly = F.col("adjusted_expenses") / 12
    cash = F.coalesce(F.col("cash"), F.lit(0.0))
    return out.select(
        "*",
        F.when(monthly > 0, cash / monthly).alias("runway_months"),
        (monthly <= 0).alias("unlimited_runway"),
        (F.col("adjusted_revenue") - F.col("adjusted_expenses")).alias("profit_loss"))


def scenario_compare(stressed: DataFrame, keys=("entity_id",)) -> DataFrame:
    """Change against the Stable scenario, profit rank per entity, risk level per scenario.

    Windows are per entity over its scenarios (a bounded group).
    """
    w = Window.partitionBy(*keys)
    stable = F.max(F.when(F.col("name") == STABLE_SCENARIO, F.col("profit_loss"))).over(w)
    ranked = stressed.select(
        "*", (F.col("profit_loss") - stable).alias("delta_vs_stable"),
        F.rank().over(w.orderBy(F.col("profit_loss").desc())).alias("profit_rank"))
    as_pos = ranked.withColumn("revenue", F.col("adjusted_revenue")).withColumn("expenses", F.col("adjusted_expenses"))
    return risk_summary(risk_factors(as_pos))
