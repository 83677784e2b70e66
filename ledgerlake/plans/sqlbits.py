"""Reusable DuckDB fragments for the oracle texts (built from the same fixed values)."""

from __future__ import annotations

from ledgerlake.functions.fixed import BANDS, RISK_WEIGHTS
from ledgerlake.plans.oracle_fixtures import R


def band_sql(family: str, v: str, what: str = "label") -> str:
    parts = []
    for label, lo, lo_incl, hi, hi_incl, sev in BANDS[family]:
        conds = []
        if lo is not None:
            conds.append(f"({v}) {'>=' if lo_incl else '>'} {float(lo)!r}")
        if hi is not None:
            conds.append(f"({v}) {'<=' if hi_incl else '<'} {float(hi)!r}")
        out = "'" + label.replace("'", "''") + "'" if what == "label" else str(sev)
        parts.append(f"WHEN {' AND '.join(conds) or 'TRUE'} THEN {out}")
    return "CASE " + " ".join(parts) + " END"


def risk_cte(src: str = "positions") -> str:
    """``risk`` CTE: R1 factors as DECIMAL(18,3) and the exact R2 score."""
    f = f"""
    SELECT *, CAST(CASE WHEN expenses <> 0 THEN expenses / 12 ELSE 0 END AS DOUBLE) AS monthly FROM {src}"""
    liq = "CASE WHEN monthly = 0 THEN 1.0 ELSE greatest(0.0, 1 - coalesce(cash,0) / (monthly * 6)) END"
    lev = "CASE WHEN revenue = 0 THEN 0.0 ELSE least(1.0, liabilities / greatest(revenue, 1e-6)) END"
    brn = ("CASE WHEN revenue = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, (expenses - revenue) / "
           "greatest(revenue, 1e-6))) END")
    w = RISK_WEIGHTS
    return f"""risk0 AS (SELECT *, TRY_CAST({R(liq, 3)} AS DECIMAL(18,3)) AS liquidity_risk,
        TRY_CAST({R(lev, 3)} AS DECIMAL(18,3)) AS leverage_risk,
        TRY_CAST({R(brn, 3)} AS DECIMAL(18,3)) AS burn_risk FROM ({f})),
risk AS (SELECT *, liquidity_risk * {w['liquidity_risk']} + leverage_risk * {w['leverage_risk']}
        + burn_risk * {w['burn_risk']} AS score FROM risk0)"""


def kpis_cte(src: str = "positions") -> str:
    return f"""k AS (SELECT *, revenue - expenses AS profit,
    CASE WHEN revenue <> 0 THEN liabilities / revenue ELSE 0 END AS debt_ratio,
    CASE WHEN expenses > 0 THEN expenses / 12 ELSE 0 END AS burn_rate,
    CASE WHEN (CASE WHEN expenses > 0 THEN expenses / 12 ELSE 0 END) <> 0 THEN
      (CASE WHEN coalesce(cash, 0) <> 0 THEN cash ELSE greatest(revenue - expenses, 0) END)
      / (CASE WHEN expenses > 0 THEN expenses / 12 ELSE 0 END) ELSE 0 END AS runway_months
  FROM {src})"""


def sq(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def metrics_cte(src: str = "positions", name: str = "m") -> str:
    """Margin, debt ratio, runway (cash / monthly expenses) with 0 for bad denominators."""
    return f"""{name} AS (SELECT *,
    CASE WHEN revenue > 0 THEN (revenue - expenses) / revenue ELSE 0 END AS profit_margin,
    CASE WHEN revenue > 0 THEN liabilities / revenue ELSE 0 END AS debt_ratio,
    CASE WHEN expenses > 0 THEN coalesce(cash, 0) / (expenses / 12) ELSE 0 END AS runway_months
  FROM {src})"""


def growth_cte(src: str, name: str = "gr") -> str:
    return f"""{name}0 AS (SELECT *, max(ds) OVER (PARTITION BY entity_id) AS last FROM {src}),
{name}1 AS (SELECT entity_id,
    coalesce(sum(CASE WHEN ds > last - INTERVAL 12 MONTH THEN y END), 0) AS last_total,
    coalesce(sum(CASE WHEN ds > last - INTERVAL 24 MONTH AND NOT (ds > last - INTERVAL 12 MONTH) THEN y END), 0) AS prior_total
  FROM {name}0 GROUP BY 1),
{name} AS (SELECT *, CASE WHEN prior_total > 0 THEN (last_total - prior_total) / prior_total ELSE 0 END AS growth_rate
  FROM {name}1)"""


def values_sql(rows, cols) -> str:
    def lit(v):
        if isinstance(v, str):
            return sq(v)
        if v is None:
            return "NULL"
        return repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(cols)}))"


def p_value_sql(r: str, n: str) -> str:
    """Two-sided p of a correlation by Simpson's rule: the share of cos^(n - 3) beyond asin |r| in a quarter turn.

    Both integrals stop where the integrand has fallen beyond any digit.
    """
    def integral(low: str) -> str:
        width = f"least(pi() / 2 - {low}, 14 / sqrt(greatest({n} - 2, 1)))"
        return (f"{width} * list_sum(list_transform(generate_series(0, 2000), lambda i: "
                f"(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
                f"* pow(cos({low} + i * {width} / 2000), {n} - 3)))")
    return (f"CASE WHEN {r} IS NULL OR {n} < 3 THEN 1.0 WHEN abs({r}) >= 1 THEN 0.0 "
            f"ELSE ({integral(f'asin(abs({r}))')}) / ({integral('0.0')}) END")
