"""Monthly grids, lags, growth, accuracy, history ∪ forecast.

A monthly series is bounded per entity by its calendar span, so per-entity
windows and per-entity month maps are bounded groups (not data-sized).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def month_start(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.trunc(c.cast("date"), "month")


def month_index(ds) -> F.Column:
    ds = F.col(ds) if isinstance(ds, str) else ds
    return F.year(ds) * 12 + F.month(ds)


def monthly_resample(series: DataFrame, by=("entity_id",), ds="ds", y="y", how: str = "sum") -> DataFrame:
    """T1 (``how='sum'``: empty months 0) and T2 (``how='mean'``: empty months NULL).

    One aggregate to (entity, month), one per-entity aggregate that collects the
    entity's months into a map (bounded by its calendar span) and a generated
    month spine — no join back. ``y`` may be one column or a list. Rows without a date are left out.
    """
    ys = [y] if isinstance(y, str) else list(y)
    m = month_start(ds)
    if how == "sum":
        aggs = [F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in ys]
    else:
        aggs = [F.avg(c).alias(c) for c in ys]
    monthly = series.where(F.col(ds).isNotNull()).groupBy(*by, m.alias("_m")).agg(*aggs)
    per = monthly.groupBy(*by).agg(
        F.min("_m").alias("_lo"), F.max("_m").alias("_hi"),
        F.map_from_entries(F.collect_list(F.struct("_m", F.struct(*ys)))).alias("_mp"))
    spine = per.select(*by, "_mp", F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 month"))).alias(ds))
    vals = []
    for c in ys:
        v = F.element_at(F.col("_mp"), F.col(ds)).getField(c)
        vals.append((F.coalesce(v, F.lit(0.0)) if how == "sum" else v).alias(c))
    return spine.select(*by, ds, *vals)


def lag_count(n, max_lags: int = 12) -> F.Column:
    """Number of lags of a series of n months: min(max_lags, max(3, n // 6))."""
    return F.least(F.lit(max_lags), F.greatest(F.lit(3), F.floor(n / 6).cast("int")))


def lag_features(series: DataFrame, by=("entity_id",), ds="ds", y="y", max_lags: int = 12,
                 fixed_k: int | None = None) -> DataFrame:
    """lag_1..lag_k with k = min(12, max(3, n // 6)) per entity; rows with a missing lag dropped.

    Lags beyond an entity's k are NULL (masked), so all entities share one schema.
    ``fixed_k`` uses the same k for every entity (pooled models need one width).
    """
    w = Window.partitionBy(*by).orderBy(ds)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    k = F.lit(fixed_k) if fixed_k else lag_count(n, max_lags)
    out = series.withColumn("k", k)
    for i in range(1, max_lags + 1):
        out = out.withColumn(f"lag_{i}", F.when(F.col("k") >= i, F.lag(y, i).over(w)))
    complete = F.lit(True)
    for i in range(1, max_lags + 1):
        complete = complete & ((F.col("k") < i) | F.col(f"lag_{i}").isNotNull())
    return out.where(complete)


def growth_rate(series: DataFrame, by=("entity_id",), ds="ds", y="y", months: int = 12) -> DataFrame:
    """Trailing-``months`` total vs the ``months`` before it, relative to each entity's last month.

    Facts are first summed to (entity, month) with partial aggregation, so the
    per-entity window only sees the entity's months.
    """
    monthly = series.groupBy(*by, month_start(ds).alias(ds)).agg(F.sum(y).alias(y))
    last = F.max(ds).over(Window.partitionBy(*by))
    s = monthly.withColumn("_last", last)
    cur = F.col(ds) > F.add_months("_last", -months)
    prev = (F.col(ds) > F.add_months("_last", -2 * months)) & ~cur
    g = s.groupBy(*by).agg(F.coalesce(F.sum(F.when(cur, F.col(y))), F.lit(0.0)).alias("last_total"),
                           F.coalesce(F.sum(F.when(prev, F.col(y))), F.lit(0.0)).alias("prior_total"))
    return g.withColumn("growth_rate", F.when(F.col("prior_total") > 0,
                                              (F.col("last_total") - F.col("prior_total")) / F.col("prior_total"))
                        .otherwise(F.lit(0.0)))


def forecast_accuracy(actual: DataFrame, forecast: DataFrame, by=("entity_id",), ds="ds",
                      y="y", yhat="forecast", extra_keys=()) -> DataFrame:
    """Join on (entity, date) — only dates in both count; MAE, MSE, RMSE, MAPE %.

    Zero actuals are left out of MAPE and counted in ``zero_actuals``.
    """
    j = actual.select(*by, ds, F.col(y).alias("_a")).join(
        forecast.select(*by, *extra_keys, ds, F.col(yhat).alias("_f")), [*by, ds])
    err = F.col("_a") - F.col("_f")
    g = j.groupBy(*by, *extra_keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"),
        F.avg(F.abs(F.try_divide(err, F.col("_a")))).alias("_mape"),
        F.count_if(F.col("_a") == 0).alias("zero_actuals"))
    return g.select(*by, *extra_keys, "n", "mae", "mse", F.sqrt("mse").alias("rmse"),
                    (F.col("_mape") * 100).alias("mape"), "zero_actuals")


def history_forecast_union(history: DataFrame, forecast: DataFrame, by=("entity_id",), ds="ds",
                           y="y") -> DataFrame:
    """History rows (kind 'actual') and forecast rows (kind 'forecast') in one table."""
    h = history.select(*by, ds, F.lit("actual").alias("kind"), F.col(y).alias("value"))
    f = forecast.select(*by, ds, F.lit("forecast").alias("kind"), F.col("forecast").alias("value"),
                        "lower_bound", "upper_bound")
    return h.unionByName(f, allowMissingColumns=True)
