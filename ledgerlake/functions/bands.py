"""Threshold ladders: one catalogue, two forms.

* ``band_expr`` turns a ladder into a CASE expression (codegen, no join) for
  operators that band a column they just computed.
* ``bands_table`` + ``band_lookup`` is the R9 operator: a long table of
  (entity, metric, value) range-joined to the band table. The join is an
  equi-join on ``metric`` with the range as a residual predicate. A band table
  of up to ``FEW_BANDS`` rows, counted first, is broadcast; how a longer one
  is joined is left to the planner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions.fixed import BANDS, BAND_METRIC

BAND_SCHEMA = T.StructType([
    T.StructField("family", T.StringType(), False),
    T.StructField("metric", T.StringType(), False),
    T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("label", T.StringType(), False),
    T.StructField("lo", T.DoubleType(), True),
    T.StructField("lo_incl", T.BooleanType(), False),
    T.StructField("hi", T.DoubleType(), True),
    T.StructField("hi_incl", T.BooleanType(), False),
    T.StructField("severity", T.IntegerType(), False),
])


#: Rows up to which a caller's band table is broadcast (each a few hundred bytes at most).
FEW_BANDS = 10_000


def band_rows(families=None):
    fams = families or list(BANDS)
    out = []
    for fam in fams:
        for i, (label, lo, lo_incl, hi, hi_incl, sev) in enumerate(BANDS[fam]):
            out.append((fam, BAND_METRIC[fam], i, label,
                        None if lo is None else float(lo), lo_incl,
                        None if hi is None else float(hi), hi_incl, sev))
    return out


def bands_table(spark: SparkSession, families=None) -> DataFrame:
    return spark.createDataFrame(band_rows(families), BAND_SCHEMA)


def _in_band(v: Column, lo, lo_incl, hi, hi_incl) -> Column:
    conds = []
    if lo is not None:
        conds.append(v >= F.lit(float(lo)) if lo_incl else v > F.lit(float(lo)))
    if hi is not None:
        conds.append(v <= F.lit(float(hi)) if hi_incl else v < F.lit(float(hi)))
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


def band_expr(family: str, value, what: str = "label") -> Column:
    """CASE expression mapping ``value`` to the band's label (or severity)."""
    v = F.col(value) if isinstance(value, str) else value
    expr = None
    for label, lo, lo_incl, hi, hi_incl, sev in BANDS[family]:
        out = F.lit(label) if what == "label" else F.lit(sev)
        cond = _in_band(v, lo, lo_incl, hi, hi_incl)
        expr = F.when(cond, out) if expr is None else expr.when(cond, out)
    return expr


def band_lookup(long_df: DataFrame, bands: DataFrame, metric_col: str = "metric",
                value_col: str = "value", family: str | None = None) -> DataFrame:
    """Range-join a long (…, metric, value) table to the band table.

    Values that fall in no band keep a NULL label (left join).
    """
    b = bands if family is None else bands.where(F.col("family") == family)
    b = b.select(F.col("metric").alias("_b_metric"), "family", "label", "severity", "ordinal",
                 "lo", "lo_incl", "hi", "hi_incl")
    v = F.col(value_col)
    in_range = ((F.col("lo").isNull() | (v > F.col("lo")) | (F.col("lo_incl") & (v == F.col("lo"))))
                & (F.col("hi").isNull() | (v < F.col("hi")) | (F.col("hi_incl") & (v == F.col("hi")))))
    few = b.limit(FEW_BANDS + 1).count() <= FEW_BANDS
    joined = long_df.join(F.broadcast(b) if few else b, (F.col(metric_col) == F.col("_b_metric")) & in_range, "left")
    return joined.drop("_b_metric", "lo", "lo_incl", "hi", "hi_incl")
