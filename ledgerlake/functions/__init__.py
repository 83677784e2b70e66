"""Column-expression helpers shared by the operators (all JVM-side)."""

from ledgerlake.functions.exprs import (  # noqa: F401
    rnd, sdiv, clip, col_or_zero, numeric_like, parse_date_any, strip_to_number,
)
