"""Built-in column expressions used everywhere.

All helpers return ``Column`` objects so the work stays inside whole-stage
codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rnd(x, d: int) -> Column:
    """Round half up on the binary value: ``floor(x * 10^d + 0.5) / 10^d``.

    Spark's ``round`` rounds the decimal text of a double, DuckDB rounds the
    scaled double, Python rounds half-even. This form is plain IEEE
    arithmetic, so it gives the same bits in every engine.
    """
    s = float(10 ** d)
    scaled = _c(x) * F.lit(s) + F.lit(0.5)
    # ``floor`` gives a BIGINT; from 2^53 on a double has no fraction left, so its value is its floor
    return (F.when(F.abs(scaled) < F.lit(2.0 ** 53), F.floor(scaled).cast("double")).otherwise(scaled) / F.lit(s))


def sdiv(a, b) -> Column:
    """Division that yields NULL for a zero or NULL divisor (ANSI-safe)."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def clip(x, lo=None, hi=None) -> Column:
    c = _c(x)
    if lo is not None:
        c = F.greatest(c, F.lit(lo))
    if hi is not None:
        c = F.least(c, F.lit(hi))
    return c


def col_or_zero(df: DataFrame, name: str) -> Column:
    """A column, or 0.0 when the frame lacks it (missing counts as zero)."""
    lower = {c.lower(): c for c in df.columns}
    if name.lower() in lower:
        return F.coalesce(F.col(lower[name.lower()]).cast("double"), F.lit(0.0))
    return F.lit(0.0)


# ---- fixed values: what Python's float() accepts once , $ % are removed ----
FLOAT_TEXT = (r"(?i)^\s*[+-]?((\d(_?\d)*(\.(\d(_?\d)*)?)?|\.\d(_?\d)*)([e][+-]?\d(_?\d)*)?"
              r"|nan|inf|infinity)\s*$")


def numeric_like(x) -> Column:
    """True when the text is a number after dropping ``, $ %`` (NULL stays NULL)."""
    return F.regexp_replace(_c(x), r"[,$%]", "").rlike(FLOAT_TEXT)


def strip_to_number(x) -> Column:
    """Strip every character but digits, '.' and '-', then cast; bad text -> NULL."""
    c = _c(x).cast("string")
    stripped = F.regexp_replace(c, r"[^0-9.\-]", "")
    return stripped.try_cast("double")


PLAIN_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def text_to_number(x) -> Column:
    """A number from text: ``, $ %`` go, ``(x)`` is -x and exponents count; other text is stripped to digits, '.' and '-'."""
    t = F.trim(F.regexp_replace(_c(x).cast("string"), r"[,$%]", ""))
    inner = F.regexp_replace(t, r"^\((.*)\)$", "$1")
    value = F.when(inner.rlike(PLAIN_NUMBER), F.trim(inner).try_cast("double")).otherwise(strip_to_number(inner))
    return F.when(t.rlike(r"^\(.*\)$"), -value).otherwise(value)


# ---- fixed values: accepted date formats, in the order they are tried ----
DATE_FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy-MM", "MM-yyyy", "yyyy"]
ISO_TIMESTAMP_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss"]


# The text shape each format can parse. A failed parse is costly (the parser
# throws), so the parser only sees text of the right shape.
FORMAT_SHAPES = {
    "yyyy-MM-dd": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "MM/dd/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "dd/MM/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "yyyy-MM": r"^\d{4}-\d{1,2}$",
    "MM-yyyy": r"^\d{1,2}-\d{4}$",
    "yyyy": r"^\d{4}$",
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$",
    "yyyy-MM-dd'T'HH:mm:ss": r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}$",
}


def parse_date_any(x, formats=None) -> Column:
    """First format that parses the whole text wins; none -> NULL. By default the declared formats and ISO timestamps."""
    c = F.trim(_c(x).cast("string"))
    return F.coalesce(*[F.when(c.rlike(FORMAT_SHAPES[f]), F.try_to_timestamp(c, F.lit(f)))
                        for f in formats or DATE_FORMATS + ISO_TIMESTAMP_FORMATS])


def to_units(x, d: int = 6) -> Column:
    """Value in integer units of 10^-d, as DECIMAL(28, 0): exact, order-independent sums. NaN counts as 0."""
    scaled = F.nanvl(_c(x).cast("double") * F.lit(float(10 ** d)) + F.lit(0.5), F.lit(0.0))
    # from 2^53 on a double has no fraction left
    return F.when(F.abs(scaled) < F.lit(2.0 ** 53), F.floor(scaled).cast("decimal(28,0)")).otherwise(scaled.cast("decimal(28,0)"))


def exact_sum(x, d: int = 6) -> Column:
    """Sum on a 10^-d grid in DECIMAL(38, 0): the same bits whatever the partitioning or engine."""
    return F.sum(to_units(x, d)).cast("double") / F.lit(float(10 ** d))
