"""Peer benchmarks computed from the data, and percentile ranks against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.bands import band_expr
from ledgerlake.functions.fixed import KPI_BENCHMARKS
from ledgerlake.functions.quantiles import exact_quantiles


def industry_benchmarks(long: DataFrame, by=("segment",), metric="metric", value="value") -> DataFrame:
    """B1: p25 / median / p75 per (segment, metric), exact and distributed."""
    q = exact_quantiles(long, [*by, metric], value, [0.25, 0.5, 0.75], ["p25", "median", "p75"])
    return q.drop("n")


def percentile_rank(v, p25, med, p75):
    """Piecewise-linear rank against (p25, median, p75). Values far above p75 rank above 100."""
    v, p25, med, p75 = (F.col(x) if isinstance(x, str) else x for x in (v, p25, med, p75))
    r = (F.when(v >= p75, F.when(p75 > med, 75 + (v - p75) / (p75 - med) * 25).otherwise(F.lit(100.0)))
          .when(v >= med, F.when(p75 > med, 50 + (v - med) / (p75 - med) * 25).otherwise(F.lit(50.0)))
          .when(v >= p25, F.when(med > p25, 25 + (v - p25) / (med - p25) * 25).otherwise(F.lit(25.0)))
          .otherwise(F.when(p25 > 0, F.greatest(F.lit(0.0), v / p25 * 25)).otherwise(F.lit(0.0))))
    return r


def benchmark_compare(long: DataFrame, bench: DataFrame, keys=("entity_id",), by=("segment",),
                      metric="metric", value="value") -> DataFrame:
    """B2: metrics that have a benchmark only (inner join), rank, the rank clipped to 100, and performance label.

    ``bench`` has one row per (segment, metric); how many segments there are
    depends on the data, so the broadcast decision is left to AQE's runtime size.
    """
    j = long.join(bench, [*by, metric])
    rank = percentile_rank(F.col(value), F.col("p25"), F.col("median"), F.col("p75"))
    return j.select(*keys, *by, metric, value, "p25", "median", "p75",
                    rank.alias("percentile_rank")).withColumns({
        "clipped_rank": F.least("percentile_rank", F.lit(100.0)),
        "performance": band_expr("performance", "percentile_rank")})


def benchmark_overall(entities: DataFrame, compared: DataFrame, keys=("entity_id",)) -> DataFrame:
    """Mean percentile per entity -> level; entities without comparisons -> 'unknown'."""
    g = compared.groupBy(*keys).agg(F.avg("percentile_rank").alias("avg_percentile"))
    j = entities.select(*keys).distinct().join(g, list(keys), "left")
    return j.withColumn("overall_performance",
                        F.when(F.col("avg_percentile").isNull(), "unknown")
                         .otherwise(band_expr("performance", "avg_percentile")))


def static_benchmark_rating(long: DataFrame, metric="metric", value="value") -> DataFrame:
    """Rate metrics against the static KPI thresholds (excellent / good / poor / critical).

    For ratios where lower is better (debt, burn) the ladder is read downwards.
    """
    rows = [(m, float(t["excellent"]), float(t["good"]), float(t["poor"])) for m, t in KPI_BENCHMARKS.items()]
    th = long.sparkSession.createDataFrame(rows, f"{metric} string, excellent double, good double, poor double")
    j = long.join(F.broadcast(th), metric)
    v = F.col(value)
    lower_better = F.col(metric).isin("debt_ratio", "burn_rate")
    up = (F.when(v >= F.col("excellent"), "excellent").when(v >= F.col("good"), "good")
           .when(v >= F.col("poor"), "poor").otherwise("critical"))
    down = (F.when(v <= F.col("excellent"), "excellent").when(v <= F.col("good"), "good")
             .when(v <= F.col("poor"), "poor").otherwise("critical"))
    return j.withColumn("rating", F.when(lower_better, down).otherwise(up))
