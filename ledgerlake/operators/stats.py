"""A1–A4: correlations, p-values, trends, seasonality flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.bands import band_expr
from ledgerlake.functions.quantiles import ordered_moments
from ledgerlake.functions.student import two_sided_p


def correlations(df: DataFrame, target: str, columns=None, by=()) -> DataFrame:
    """A1: Pearson r of ``target`` with each other numeric column, pairwise-complete, in one pass.

    t = r·√((n−2)/(1−r²)); rows ordered by |r| descending through ``rank_abs``.
    """
    cols = columns or [f.name for f in df.schema.fields
                       if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal")
                       and f.name != target and f.name not in by]
    aggs = []
    for c in cols:
        both = F.col(target).isNotNull() & F.col(c).isNotNull()
        aggs += [F.corr(target, c).alias(f"r__{c}"), F.count_if(both).alias(f"n__{c}")]
    wide = df.groupBy(*by).agg(*aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r__{c}").alias("r"),
                                         F.col(f"n__{c}").alias("n")) for c in cols])).alias("s")
    long = wide.select(*by, stack).select(*by, "s.column", "s.r", "s.n")
    r = F.col("r")
    t = r * F.sqrt(F.try_divide((F.col("n") - 2).cast("double"), 1 - r * r))
    long = long.select(*by, F.lit(target).alias("target"), "column", "r", "n", t.alias("t_stat"),
                       F.when(r.isNull(), F.lit("no correlation"))
                        .otherwise(band_expr("correlation_strength", F.abs(r))).alias("strength"))
    w = Window.partitionBy(*by).orderBy(F.abs(F.col("r")).desc_nulls_last(), F.col("column"))
    return long.withColumn("rank_abs", F.row_number().over(w))


def correlation_pvalue(corr: DataFrame) -> DataFrame:
    """A2: two-sided p of each r (n - 2 degrees of freedom); significant = p < 0.05. Without a correlation p is 1."""
    out = corr.withColumn("p_value", two_sided_p(F.col("r"), F.col("n")))
    return out.withColumn("significant", F.col("p_value") < 0.05)


def trend(series: DataFrame, by=("entity_id",), ds="ds", y="y") -> DataFrame:
    """A3: slope / r² / p / direction / strength against the row number after a date sort.

    Rows of one date are ordered by value. The moments come from ``ordered_moments``, so an entity with a third
    of all rows is ranked by many tasks. A constant or single value has p 1.
    """
    g = ordered_moments(series.select(*by, ds, y), by, [ds, y], y)
    r = F.try_divide("sxy", F.sqrt(F.col("sxx") * F.col("syy")))
    slope = F.try_divide("sxy", "sxx")
    g = g.select(*by, slope.alias("slope"), r.alias("_r"), F.when((F.col("syy") == 0) & (F.col("sxx") > 0), F.lit(1.0))
                 .otherwise(F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy"))).alias("r_squared"),
                 "first", "last", "n", "n_values", F.sqrt(F.try_divide("syy", "n_values")).alias("volatility"),
                 F.datediff("highest", "lowest").alias("span_days"))
    return g.select(
        *by, "slope", "r_squared", two_sided_p(F.col("_r"), F.col("n_values")).alias("p_value"),
        F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing")
         .otherwise("stable").alias("direction"),
        band_expr("correlation_strength", F.abs(F.coalesce(F.col("_r"), F.lit(0.0)))).alias("strength"),
        F.when(F.col("first") != 0, (F.col("last") - F.col("first")) / F.col("first") * 100)
         .otherwise(F.lit(0.0)).alias("pct_change"),
        "volatility", F.col("n").alias("n_points"), "span_days")


def seasonality_flag(series: DataFrame, by=("entity_id",), ds="ds", y="y", min_points: int = 12,
                     cv_cut: float = 0.1) -> DataFrame:
    """A4: ≥ 12 rows, ≥ 12 calendar months, and CV of the monthly means > 0.1."""
    m = F.trunc(F.col(ds).cast("date"), "month")
    mm = series.groupBy(*by, m.alias("_m")).agg(F.avg(y).alias("_v"), F.count(F.lit(1)).alias("_c"))
    g = mm.groupBy(*by).agg(
        F.sum("_c").alias("n_points"),
        (F.months_between(F.max("_m"), F.min("_m")).cast("long") + 1).alias("n_months"),
        F.stddev_samp("_v").alias("_sd"), F.avg("_v").alias("_mu"))
    cv = F.when(F.col("_mu") != 0, F.col("_sd") / F.col("_mu")).otherwise(F.lit(0.0))
    return g.select(*by, "n_points", "n_months", cv.alias("cv"),
                    ((F.col("n_points") >= min_points) & (F.col("n_months") >= 12)
                     & F.coalesce(cv > cv_cut, F.lit(False))).alias("seasonality_present"))
