"""Cash-flow path risk per entity, from the months that the entity has had.

* Parameters are estimated from each entity's monthly flows (P1).
* A path is a run of consecutive months: every month of an entity's filled grid
  begins one, so an entity of n months has n − 11 paths of 12 months (P2). Its
  revenue and expenses are the real ones; the question is what the entity's
  cash would be after any year like one it has lived through. Nothing is drawn.
* Amounts are integer cents, so running balances, finals and their means are
  exact and order-independent.
* A month is repeated once per path that holds it; there is no self-join. All
  steps work per entity, whose months are bounded by its calendar span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.exprs import rnd
from ledgerlake.functions.quantiles import group_percentiles
from ledgerlake.operators.series import monthly_resample


def flow_params(flows: DataFrame, by=("entity_id",), ds="ds", cash_months: float = 6.0) -> DataFrame:
    """Mean / sample std of gap-filled monthly revenue and expenses; amounts in cents."""
    filled = monthly_resample(flows, by, ds, ["revenue", "expenses"])
    g = filled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_months"),
        F.avg("revenue").alias("revenue_mean"), F.stddev_samp("revenue").alias("revenue_std"),
        F.avg("expenses").alias("expense_mean"), F.stddev_samp("expenses").alias("expense_std"))
    g = g.select(*by, "n_months", *[rnd(F.coalesce(F.col(c), F.lit(0.0)), 2).alias(c)
                                    for c in ("revenue_mean", "revenue_std", "expense_mean", "expense_std")])
    return g.withColumn("initial_cash", rnd(F.col("expense_mean") * cash_months, 2))


def _cents(x):
    return F.floor(F.col(x) * 100.0 + 0.5).cast("bigint")


def outcome_paths(flows: DataFrame, by=("entity_id",), ds="ds", months: int = 12, cash_months: float = 6.0) -> DataFrame:
    """One row per (entity, path, step): every run of ``months`` consecutive months of the filled grid, in cents.

    ``path_id`` counts the months from the entity's first one to the path's start; an entity with fewer months
    has one path of all of them. Every path starts from ``cash_months`` mean months of expenses.
    """
    filled = monthly_resample(flows, by, ds, ["revenue", "expenses"])
    w = Window.partitionBy(*by)
    grid = filled.select(
        *by, (F.row_number().over(w.orderBy(ds)) - 1).alias("_i"), F.count(F.lit(1)).over(w).alias("_n"),
        _cents("revenue").alias("revenue_cents"), _cents("expenses").alias("expense_cents"),
        rnd(rnd(F.avg("expenses").over(w), 2) * cash_months, 2).alias("_cash"))
    last = F.greatest(F.col("_n") - months, F.lit(0))
    steps = F.sequence(F.greatest(F.lit(1), F.col("_i") + 1 - last), F.least(F.lit(months), F.col("_i") + 1))
    return grid.select(*by, "_i", F.explode(steps).alias("step"), "_cash", "revenue_cents", "expense_cents").select(
        *by, (F.col("_i") + 1 - F.col("step")).cast("bigint").alias("path_id"), F.col("step").cast("int").alias("step"),
        _cents("_cash").alias("initial_cents"), "revenue_cents", "expense_cents")


def running_balance(paths: DataFrame, by=("entity_id",)) -> DataFrame:
    """Balance after each month = initial + running sum of (revenue − expenses), in cents."""
    w = (Window.partitionBy(*by, "path_id").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return paths.withColumn("balance_cents", F.col("initial_cents")
                            + F.sum(F.col("revenue_cents") - F.col("expense_cents")).over(w))


def path_summary(paths: DataFrame, by=("entity_id",)) -> DataFrame:
    """Final and minimum balance per path (cents)."""
    rb = running_balance(paths, by)
    return rb.groupBy(*by, "path_id").agg(
        (F.first("initial_cents") + F.sum(F.col("revenue_cents") - F.col("expense_cents"))).alias("final_cents"),
        F.min("balance_cents").alias("min_cents"))


def tail_risk(summary: DataFrame, by=("entity_id",)) -> DataFrame:
    """Expected final cash, VaR95 / VaR99 (5th / 1st percentile, a level), 95% interval.

    Percentiles are per entity over its paths: a group bounded by its months,
    so Spark's exact ``percentile`` is safe here.
    """
    j = group_percentiles(summary, by, "final_cents", [0.01, 0.025, 0.05, 0.975],
                          ["p01", "p025", "p05", "p975"], extra=[F.avg("final_cents").alias("_mean")])
    return j.select(*by, (F.col("_mean") / 100.0).alias("expected_final_cash"),
                    (F.col("p05") / 100.0).alias("var_95"), (F.col("p01") / 100.0).alias("var_99"),
                    (F.col("p025") / 100.0).alias("ci_95_lower"), (F.col("p975") / 100.0).alias("ci_95_upper"))


def breach_probability(summary: DataFrame, by=("entity_id",)) -> DataFrame:
    """P5: share of paths whose balance goes below zero in any month."""
    return summary.groupBy(*by).agg(
        F.avg(F.when(F.col("min_cents") < 0, 1.0).otherwise(0.0)).alias("breach_probability"),
        F.count(F.lit(1)).alias("paths"))


def final_cash_histogram(summary: DataFrame, by=("entity_id",), bins: int = 50) -> DataFrame:
    """Equal-width histogram of final cash per entity (non-empty bins)."""
    w = Window.partitionBy(*by)
    v = F.col("final_cents") / 100.0
    s = summary.select(*by, v.alias("v"), F.min(v).over(w).alias("mn"), F.max(v).over(w).alias("mx"))
    width = F.col("mx") - F.col("mn")
    b = F.when(width > 0, F.least(F.lit(bins), F.floor((F.col("v") - F.col("mn")) / width * bins) + 1)).otherwise(1)
    g = s.groupBy(*by, b.cast("int").alias("bin"), "mn", "mx").agg(F.count(F.lit(1)).alias("paths"))
    return g.select(*by, "bin", (F.col("mn") + (F.col("bin") - 1) * (width / bins)).alias("lower_edge"),
                    (F.col("mn") + F.col("bin") * (width / bins)).alias("upper_edge"), "paths")
