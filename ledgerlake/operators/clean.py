"""Cleaning as projections, filters and casts.

Column choices and column statistics that depend on the data (empty columns,
numeric-looking text, means, standard deviations) come from ONE aggregate pass
that returns one row; only that row (size ∝ number of columns) reaches the
driver, the way Spark ML's Imputer / StandardScaler fit their models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions.exprs import PLAIN_NUMBER, numeric_like, parse_date_any, strip_to_number, text_to_number


def string_columns(df: DataFrame):
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame):
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.LongType, T.IntegerType))]


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Rows whose every cell is NULL go."""
    return df.na.drop(how="all")


def empty_columns(df: DataFrame):
    """Names of all-NULL columns (one aggregate pass, one small row to the driver)."""
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c] == 0]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """All-NULL columns go."""
    empty = set(empty_columns(df))
    return df.select(*[c for c in df.columns if c not in empty])


def trim_column_names(df: DataFrame) -> DataFrame:
    """Column names as stripped strings."""
    return df.toDF(*[str(c).strip() for c in df.columns])


def dedupe_rows(df: DataFrame) -> DataFrame:
    """C4: duplicate rows go (NULLs compare equal)."""
    return df.dropDuplicates()


def numeric_text_ratios(df: DataFrame, columns=None) -> dict:
    """Share of numeric-looking values among non-NULL values, per text column (one pass)."""
    cols = columns or string_columns(df)
    if not cols:
        return {}
    row = df.agg(*[F.avg(numeric_like(F.col(c)).cast("double")).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def clean_numeric_text(df: DataFrame, threshold: float = 0.8, compat: bool = False) -> DataFrame:
    """Text columns that are > 80% numeric become numbers: ``(x)`` is -x, exponents count.

    ``compat`` strips to digits, '.' and '-' instead (``1e5`` is 15, ``(100)`` is 100).
    """
    number = strip_to_number if compat else text_to_number
    ratios = numeric_text_ratios(df)
    conv = {c for c, r in ratios.items() if r is not None and r > threshold}
    return df.select(*[number(F.col(c)).alias(c) if c in conv else F.col(c)
                       for c in df.columns])


def coerce_series(df: DataFrame, date_col: str, value_col: str, keys=(),
                  observation: Observation | None = None) -> DataFrame:
    """First column to a date, second to a number; bad values NULL; rows without a date dropped.

    An ``observation`` counts what the coercion loses while the result is computed, without a second scan:
    rows, null_dates, rejected_dates (text that is no date), rejected_values (text that is no number).
    """
    ds = parse_date_any(F.col(date_col)).cast("date")
    v = F.col(value_col).cast("string")
    y = F.when(v.rlike(PLAIN_NUMBER), F.trim(v).try_cast("double"))
    out = df.select(*keys, ds.alias("ds"), y.alias("y"), F.col(date_col).isNull().alias("_no_date"), v.isNull().alias("_no_value"))
    if observation is not None:
        out = out.observe(observation, F.count(F.lit(1)).alias("rows"), F.count_if("_no_date").alias("null_dates"),
                          F.count_if(~F.col("_no_date") & F.col("ds").isNull()).alias("rejected_dates"),
                          F.count_if(~F.col("_no_value") & F.col("y").isNull()).alias("rejected_values"))
    return out.where(F.col("ds").isNotNull()).drop("_no_date", "_no_value")


def impute_mean(df: DataFrame, columns, by=()) -> DataFrame:
    """NULLs -> column mean (per group when ``by`` is given), via one aggregate row."""
    if by:
        from pyspark.sql import Window
        w = Window.partitionBy(*by)
        return df.select(*[F.coalesce(F.col(c), F.avg(c).over(w)).alias(c) if c in columns else F.col(c)
                           for c in df.columns])
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()  # one row of k numbers
    return df.select(*[F.coalesce(F.col(c), F.lit(means[c]).cast("double")).alias(c) if c in columns
                       else F.col(c) for c in df.columns])


def standardize(df: DataFrame, columns, keep=()) -> DataFrame:
    """Z-scores with the population std; a zero std divides by 1."""
    st = df.agg(*[F.avg(c).alias(f"_mu_{c}") for c in columns],
                *[F.stddev_pop(c).alias(f"_sd_{c}") for c in columns]).first()  # one row of 2k numbers
    out = []
    for c in columns:
        mu, sd = st[f"_mu_{c}"], st[f"_sd_{c}"]
        div = 1.0 if not sd else sd
        out.append(((F.col(c) - F.lit(mu).cast("double")) / F.lit(float(div))).alias(c))
    return df.select(*keep, *out)
