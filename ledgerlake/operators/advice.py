"""Rule-based advice as columns (no text model).

Every rule is a CASE over one entity row; recommendation lists are arrays
built from the fixed catalogue, so "first three" is ``slice`` — no window
and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.bands import band_expr
from ledgerlake.functions.exprs import rnd
from ledgerlake.functions.fixed import (ADVICE_RECOMMENDATIONS, ADVICE_TRIGGERS, ADVISORY, INSIGHTS,
                                        ANSWER_HEADER, ANSWER_MARGIN, ANSWER_RUNWAY, ANSWER_DEBT,
                                        ANSWER_RECS_HEADER, TOPIC_WORDS)


def health_metrics(pos: DataFrame) -> DataFrame:
    """Margin, debt ratio and runway (cash / monthly expenses) with 0 for bad denominators."""
    rev, exp, liab = F.col("revenue"), F.col("expenses"), F.col("liabilities")
    cash = F.coalesce(F.col("cash"), F.lit(0.0))
    return pos.select(
        "*",
        F.when(rev > 0, (rev - exp) / rev).otherwise(F.lit(0.0)).alias("profit_margin"),
        F.when(rev > 0, liab / rev).otherwise(F.lit(0.0)).alias("debt_ratio"),
        F.when(exp > 0, cash / (exp / 12)).otherwise(F.lit(0.0)).alias("runway_months"))


def swot(pos: DataFrame) -> DataFrame:
    """Three ladders -> strengths / weaknesses, risk level and overall health."""
    m = health_metrics(pos)
    fams = [("margin", "margin_swot", "profit_margin"), ("debt", "debt_swot", "debt_ratio"),
            ("runway", "runway_swot", "runway_months")]
    cols = []
    for short, fam, metric in fams:
        cols += [band_expr(fam, metric).alias(f"{short}_label"),
                 band_expr(fam, metric, "severity").alias(f"{short}_severity")]
    out = m.select("*", *cols)
    sev = [F.col(f"{s}_severity") for s, _, _ in fams]
    strengths = sum((F.when(s == 0, 1).otherwise(0) for s in sev), F.lit(0))
    weaknesses = sum((F.when(s > 0, 1).otherwise(0) for s in sev), F.lit(0))
    out = out.withColumn("strengths", strengths).withColumn("weaknesses", weaknesses)
    return out.select(
        "*",
        F.when(F.greatest(*sev) == 2, "high").otherwise("medium").alias("swot_risk_level"),
        F.when(F.col("strengths") > F.col("weaknesses"), "good")
         .when(F.col("weaknesses") > F.col("strengths"), "poor").otherwise("fair").alias("overall_health"))


def recommendation_list(metrics: DataFrame) -> Column:
    """Triggered recommendation lists, concatenated in trigger order (an array column)."""
    parts = []
    for cat, metric, op, cut in ADVICE_TRIGGERS:
        cond = F.col(metric) < cut if op == "<" else F.col(metric) > cut
        msgs = F.array(*[F.lit(x) for x in ADVICE_RECOMMENDATIONS[cat]])
        parts.append(F.when(cond, msgs).otherwise(F.array().cast("array<string>")))
    return F.flatten(F.array(*parts))


def top_recommendations(pos: DataFrame, keys=("entity_id",), top: int = 3) -> DataFrame:
    """The first ``top`` recommendations per entity, one row each."""
    m = health_metrics(pos)
    recs = F.slice(recommendation_list(m), 1, top)
    return m.select(*keys, F.posexplode(recs).alias("pos", "recommendation")).select(
        *keys, (F.col("pos") + 1).alias("rank"), "recommendation")


def advisory_messages(k: DataFrame, keys=("entity_id",)) -> DataFrame:
    """Three sentences from K4 KPIs (profit, debt ratio, runway), joined by a space."""
    parts = []
    for metric, bad, good in ADVISORY:
        if metric == "profit":
            cond = F.coalesce(F.col("profit"), F.lit(0.0)) < 0
        elif metric == "debt_ratio":
            cond = F.coalesce(F.col("debt_ratio"), F.lit(0.0)) > 0.5
        else:
            cond = F.coalesce(F.col("runway_months"), F.lit(0.0)) < 6
        parts.append(F.when(cond, F.lit(bad)).otherwise(F.lit(good)))
    return k.select(*keys, F.concat_ws(" ", *parts).alias("advisory"))


def insights(k: DataFrame, keys=("entity_id",)) -> DataFrame:
    """Margin %, runway and debt ladders -> three insight rows per entity.

    ``k`` carries revenue, profit, runway_months and debt_ratio (K4 rounds the
    last two to 2 places, as the dashboard reads them).
    """
    margin = F.when(F.col("revenue") > 0, F.col("profit") / F.col("revenue") * 100).otherwise(F.lit(0.0))
    runway, debt = F.col("runway_months"), F.col("debt_ratio")
    m, r, d = INSIGHTS["margin"], INSIGHTS["runway"], INSIGHTS["debt"]
    arr = F.array(
        F.when(margin > 20, m[0]).when(margin > 10, m[1]).otherwise(m[2]),
        F.when(runway > 18, r[0]).when(runway > 12, r[1]).otherwise(r[2]),
        F.when(debt < 0.3, d[0]).when(debt < 0.5, d[1]).otherwise(d[2]))
    return k.select(*keys, F.posexplode(arr).alias("pos", "insight")).select(
        *keys, (F.col("pos") + 1).alias("ordinal"), "insight")


def _fmt(template: str, value: Column, decimals: int) -> Column:
    head, tail = template.split("{v}")
    return F.concat(F.lit(head), F.format_string(f"%.{decimals}f", rnd(value, decimals)), F.lit(tail))


def question_answers(questions: DataFrame, pos: DataFrame, keys=("entity_id",)) -> DataFrame:
    """Topic flags from the question text select ladder sentences; top 3 recommendations follow."""
    m = health_metrics(pos)
    j = questions.join(m, list(keys))
    q = F.lower(F.col("question"))
    has = {t: F.lit(False) for t in TOPIC_WORDS}
    for t, words in TOPIC_WORDS.items():
        for w in words:
            has[t] = has[t] | (F.instr(q, w) > 0)
    margin_pct = F.col("profit_margin") * 100
    runway, debt = F.col("runway_months"), F.col("debt_ratio")
    s_margin = (F.when(margin_pct > 20, _fmt(ANSWER_MARGIN[0], margin_pct, 1))
                 .when(margin_pct > 10, _fmt(ANSWER_MARGIN[1], margin_pct, 1))
                 .otherwise(_fmt(ANSWER_MARGIN[2], margin_pct, 1)))
    s_runway = (F.when(runway > 18, _fmt(ANSWER_RUNWAY[0], runway, 1))
                 .when(runway > 12, _fmt(ANSWER_RUNWAY[1], runway, 1))
                 .otherwise(_fmt(ANSWER_RUNWAY[2], runway, 1)))
    s_debt = (F.when(debt < 0.3, _fmt(ANSWER_DEBT[0], debt, 2))
               .when(debt < 0.5, _fmt(ANSWER_DEBT[1], debt, 2))
               .otherwise(_fmt(ANSWER_DEBT[2], debt, 2)))
    recs = F.slice(recommendation_list(j), 1, 3)
    numbered = F.transform(recs, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.lit("\n")))
    rec_text = F.when(F.size(recs) > 0, F.concat(F.lit(ANSWER_RECS_HEADER), F.array_join(numbered, "")))
    text = F.concat(F.lit(ANSWER_HEADER),
                    F.when(has["margin"], s_margin).otherwise(""),
                    F.when(has["runway"], s_runway).otherwise(""),
                    F.when(has["debt"], s_debt).otherwise(""),
                    F.coalesce(rec_text, F.lit("")))
    return j.select("q_id", *keys, text.alias("answer"))
