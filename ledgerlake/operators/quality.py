"""The data-quality profile.

One wide aggregate computes every per-column count (non-NULL, numeric-looking,
date-looking, negatives, max) and the table counts (rows, empty rows, losses,
excess cash) in a single scan; IQR fences come from the distributed exact
quantiles; duplicates from one ``groupBy`` over all columns. Findings,
suggestions and the quality score follow from these few rows (``Profile``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions.exprs import DATE_FORMATS, numeric_like, parse_date_any
from ledgerlake.functions.fixed import FINANCIAL_RULES, NEGATIVE_CHECK_WORDS, TEXT_RULES
from ledgerlake.functions.quantiles import exact_quantiles
from ledgerlake.operators.clean import numeric_columns, string_columns


def _column_structs(df: DataFrame) -> list:
    text, nums = string_columns(df), numeric_columns(df)
    structs = []
    for c in df.columns:
        if c in text:
            isnum = numeric_like(F.col(c))
            isdate = parse_date_any(F.col(c)).isNotNull()
            s = F.struct(F.lit(c).alias("column"), F.lit("text").alias("kind"),
                         F.count(F.col(c)).alias("non_null"),
                         F.count_if(isnum).alias("numeric_count"),
                         F.count_if(~isnum & isdate).alias("date_count"),
                         F.count_if(isdate).alias("date_like"),
                         F.lit(None).cast("long").alias("negative_count"),
                         F.lit(None).cast("double").alias("max_value"))
        elif c in nums:
            s = F.struct(F.lit(c).alias("column"), F.lit("number").alias("kind"),
                         F.count(F.col(c)).alias("non_null"),
                         F.lit(None).cast("long").alias("numeric_count"),
                         F.lit(None).cast("long").alias("date_count"),
                         F.lit(None).cast("long").alias("date_like"),
                         F.count_if(F.col(c) < 0).alias("negative_count"),
                         F.max(F.col(c)).cast("double").alias("max_value"))
        else:
            s = F.struct(F.lit(c).alias("column"), F.lit("other").alias("kind"),
                         F.count(F.col(c)).alias("non_null"),
                         *[F.lit(None).cast("long").alias(n) for n in
                           ("numeric_count", "date_count", "date_like", "negative_count")],
                         F.lit(None).cast("double").alias("max_value"))
        structs.append(s)
    return structs


def column_stats(df: DataFrame) -> DataFrame:
    """Long (column, kind, n_rows, non_null, numeric_count, date_count, negative_count, max_value)."""
    structs = _column_structs(df)
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*structs).alias("_cols"))
    return wide.select("n_rows", F.explode("_cols").alias("s")).select("s.*", "n_rows")


def _table_counts(df: DataFrame) -> list:
    cols = set(df.columns)
    allnull = F.lit(True)
    for c in df.columns:
        allnull = allnull & F.col(c).isNull()
    loss = (F.count_if(F.col("revenue") - F.col("expenses") < 0) if {"revenue", "expenses"} <= cols
            else F.lit(None).cast("long"))
    excess = (F.count_if(F.col("cash") > F.col("expenses") / 12 * 24) if {"cash", "expenses"} <= cols
              else F.lit(None).cast("long"))
    return [F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"),
            F.count_if(allnull).alias("empty_rows"), loss.alias("loss_records"), excess.alias("excess_cash_records")]


def table_stats(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns, empty_rows, loss_records, excess_cash_records."""
    return df.agg(*_table_counts(df))


def structure_check(df: DataFrame) -> DataFrame:
    """Row count, column count, duplicate and blank names -> (check, value, failed)."""
    names = [str(c) for c in df.columns]
    dups = len(names) - len(set(names))
    blanks = sum(1 for c in names if not c.strip())
    n = df.agg(F.count(F.lit(1)).alias("v"))
    meta = df.sparkSession.createDataFrame(
        [("column_count", len(names), len(names) < 2), ("duplicate_names", dups, dups > 0),
         ("blank_names", blanks, blanks > 0)], "check_name string, value long, failed boolean")
    return n.select(F.lit("row_count").alias("check_name"), F.col("v").alias("value"),
                    (F.col("v") < 1).alias("failed")).unionByName(meta)


def type_ratio_profile(stats: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Numeric / date / text counts per text column and the 'stored as text' flag."""
    t = stats.where(F.col("kind") == "text")
    nr = F.try_divide(F.col("numeric_count").cast("double"), F.col("non_null"))
    dr = F.try_divide(F.col("date_count").cast("double"), F.col("non_null"))
    return t.select("column", "non_null", "numeric_count", "date_count",
                    (F.col("non_null") - F.col("numeric_count") - F.col("date_count")).alias("text_count"),
                    nr.alias("numeric_ratio"), dr.alias("date_ratio"),
                    F.when(nr > threshold, "numeric").when(dr > threshold, "date").alias("flag"))


def negative_value_check(stats: DataFrame, words=NEGATIVE_CHECK_WORDS) -> DataFrame:
    """D3: numeric columns named like revenue / cash / assets with negative values."""
    like = F.lit(False)
    for w in words:
        like = like | F.lower(F.col("column")).contains(w)
    t = stats.where((F.col("kind") == "number") & (F.col("non_null") > 0) & like)
    return t.select("column", "negative_count", (F.col("negative_count") > 0).alias("flagged"))


def extreme_value_check(stats: DataFrame, limit: float = 1e10) -> DataFrame:
    """Max above 1e10."""
    t = stats.where((F.col("kind") == "number") & (F.col("non_null") > 0))
    return t.select("column", "max_value", (F.col("max_value") > limit).alias("flagged"))


def iqr_outliers(df: DataFrame, n_rows: int | None = None) -> DataFrame:
    """Linear-interpolated Q1/Q3 per numeric column, fences ±1.5·IQR, outlier counts."""
    nums = numeric_columns(df)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in nums]).unpivot(
        [], nums, "column", "value").where(F.col("value").isNotNull())
    q = exact_quantiles(long, ["column"], "value", [0.25, 0.75], ["q1", "q3"])
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    q = q.withColumn("lower", F.col("q1") - 1.5 * F.col("iqr")).withColumn("upper", F.col("q3") + 1.5 * F.col("iqr"))
    n_rows = df.count() if n_rows is None else n_rows
    # fences: one row per numeric column (bounded by the schema) -> broadcast
    cnt = long.join(F.broadcast(q.select("column", "lower", "upper")), "column").groupBy("column").agg(
        F.count_if((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).alias("outliers"))
    out = q.join(cnt, "column").withColumn("n_rows", F.lit(n_rows))
    ratio = F.col("outliers") / F.col("n")
    return out.select("column", "q1", "q3", "iqr", "lower", "upper", "outliers", F.col("n").alias("non_null"),
                      ratio.alias("outlier_ratio"), (ratio > 0.1).alias("warn"),
                      (F.col("outliers") > F.col("n_rows") * 0.05).alias("review"))


def completeness(stats: DataFrame, warn_below: float = 0.8) -> DataFrame:
    """Filled cells / all cells; NULL for an empty table."""
    g = stats.agg(F.sum(F.col("n_rows")).alias("total_cells"), F.sum("non_null").alias("filled_cells"))
    c = F.try_divide("filled_cells", "total_cells")
    return g.select("total_cells", "filled_cells", c.alias("completeness"), (c < warn_below).alias("warn"))


def empty_columns(stats: DataFrame) -> DataFrame:
    """Per column non-NULL count and the all-NULL flag."""
    return stats.select("column", "non_null", (F.col("non_null") == 0).alias("is_empty"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows repeating an earlier row = Σ(count − 1) over groups of identical rows."""
    g = df.groupBy(*df.columns).count()
    return g.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def missing_heavy_columns(stats: DataFrame, share: float = 0.1) -> DataFrame:
    """Columns with more than 10% NULLs (suggest imputing)."""
    nulls = F.col("n_rows") - F.col("non_null")
    return stats.where(nulls > F.col("n_rows") * share).select(
        "column", nulls.alias("null_count"), (nulls / F.col("n_rows")).alias("null_ratio"))


FINDING = "code string, column string, severity string, n long"
TYPE_SHARE, FILLED_SHARE, MISSING_SHARE = 0.8, 0.8, 0.1


class Profile:
    """What all checks of one table need, from one aggregate, one selection of quantiles and one count of duplicates.

    Only rows per column reach the driver: their number is the schema's, not the data's.
    """

    def __init__(self, df: DataFrame):
        self.spark, self.names = df.sparkSession, list(df.columns)
        row = df.agg(*_table_counts(df), F.array(*_column_structs(df)).alias("_cols")).first()
        self.table, self.columns = row, row["_cols"]
        self.n = row["n_rows"]
        self.outliers = iqr_outliers(df, self.n).collect() if self.n else []
        self.duplicates = duplicate_rows(df).first()[0]
        cells = self.n * len(self.columns)
        self.completeness = sum(c["non_null"] for c in self.columns) / cells if cells else None

    def text_flags(self):
        """(column, 'numeric' or 'date', values of that kind) of text columns that hold something else than text."""
        for c in self.columns:
            if c["kind"] == "text" and c["non_null"]:
                if c["numeric_count"] / c["non_null"] > TYPE_SHARE:
                    yield c["column"], "numeric", c["numeric_count"]
                elif c["date_count"] / c["non_null"] > TYPE_SHARE:
                    yield c["column"], "date", c["date_count"]

    def findings(self) -> list[tuple]:
        """(code, column, severity, count) of every error and warning: of values, columns or rows, and of empty cells
        where the table is incomplete. An empty table has one error and no other finding."""
        if not self.n:
            return [("empty_table", None, "error", 0)]
        out = []
        names = [str(c) for c in self.names]
        if len(names) < 2:
            out.append(("column_count", None, "error", len(names)))
        if len(names) > len(set(names)):
            out.append(("duplicate_names", None, "error", len(names) - len(set(names))))
        if blank := sum(not c.strip() for c in names):
            out.append(("blank_names", None, "error", blank))
        if empty := sum(c["non_null"] == 0 for c in self.columns):
            out.append(("empty_columns", None, "error", empty))
        out += [(f"stored_as_text_{kind}", c, "warning", k) for c, kind, k in self.text_flags()]
        for c in self.columns:
            if c["kind"] == "number" and c["non_null"]:
                if c["negative_count"] and any(w in c["column"].lower() for w in NEGATIVE_CHECK_WORDS):
                    out.append(("negative_values", c["column"], "warning", c["negative_count"]))
                if c["max_value"] > 1e10:
                    out.append(("extreme_values", c["column"], "warning", 1))
        out += [("outliers", o["column"], "warning", o["outliers"]) for o in self.outliers if o["warn"]]
        if self.completeness is not None and self.completeness < FILLED_SHARE:
            out.append(("low_completeness", None, "warning", self.n * len(self.columns) - sum(c["non_null"] for c in self.columns)))
        for count, code in (("empty_rows", "empty_rows"), ("loss_records", "loss_records"), ("excess_cash_records", "excess_cash")):
            if self.table[count]:
                out.append((code, None, "warning", self.table[count]))
        if self.duplicates:
            out.append(("duplicate_rows", None, "warning", self.duplicates))
        return out

    def suggestions(self) -> list[tuple]:
        """(code, column, count): text to convert, columns to impute, outliers to review. Here a column of
        dates may hold numbers that read as dates too."""
        out = []
        for c in self.columns:
            if c["kind"] == "text" and c["non_null"]:
                if c["numeric_count"] / c["non_null"] > TYPE_SHARE:
                    out.append(("convert_to_numeric", c["column"], c["numeric_count"]))
                elif c["date_like"] / c["non_null"] > TYPE_SHARE:
                    out.append(("convert_to_datetime", c["column"], c["date_like"]))
        out += [("impute_missing", c["column"], self.n - c["non_null"]) for c in self.columns
                if self.n - c["non_null"] > self.n * MISSING_SHARE]
        return out + [("review_outliers", o["column"], o["outliers"]) for o in self.outliers if o["review"]]

    def score(self) -> tuple:
        """(errors, warnings, completeness, share of numeric-looking text columns, score). An empty table scores 0."""
        found = self.findings()
        errors, warnings = (sum(f[2] == s for f in found) for s in ("error", "warning"))
        text = [c for c in self.columns if c["kind"] == "text"]
        numeric = sum(kind == "numeric" for _, kind, _ in self.text_flags()) / len(text) if text else 0.0
        if not self.n:
            return errors, warnings, None, numeric, 0.0
        score = 1.0 - errors * 0.2 - warnings * 0.05 - (1 - self.completeness) * 0.3 - numeric * 0.2
        return errors, warnings, self.completeness, numeric, max(0.0, min(1.0, score))


def findings(df: DataFrame) -> DataFrame:
    """Errors and warnings of all checks as rows (code, column, severity, n)."""
    return df.sparkSession.createDataFrame(Profile(df).findings(), FINDING)


def suggestions(df: DataFrame) -> DataFrame:
    """Improvements to make, as rows (code, column, n)."""
    return df.sparkSession.createDataFrame(Profile(df).suggestions(), "code string, column string, n long")


def quality_score(df: DataFrame) -> DataFrame:
    """1 − .2·errors − .05·warnings − .3·(1 − completeness) − .2·(numeric-looking text share), in [0, 1].

    An empty table has one error, no completeness and score 0.
    """
    return df.sparkSession.createDataFrame([Profile(df).score()], "errors long, warnings long, completeness double, "
                                           "type_issue_ratio double, quality_score double")


def financial_validation(df: DataFrame, by=(), revenue="revenue", expenses="expenses") -> DataFrame:
    """Totals, profit, margin (0 when revenue ≤ 0) and the two warnings, per group."""
    from ledgerlake.functions.exprs import exact_sum
    g = df.groupBy(*by).agg(exact_sum(revenue, 4).alias("total_revenue"),
                            exact_sum(expenses, 4).alias("total_expenses"))
    profit = F.col("total_revenue") - F.col("total_expenses")
    return g.select(*by, "total_revenue", "total_expenses", profit.alias("total_profit"),
                    F.when(F.col("total_revenue") > 0, profit / F.col("total_revenue")).otherwise(F.lit(0.0))
                     .alias("profit_margin"),
                    (profit < 0).alias("loss_warning"),
                    (F.col("total_expenses") > F.col("total_revenue") * 0.9).alias("high_expense_warning"))


def rule_range_check(df: DataFrame, column_map: dict | None = None) -> DataFrame:
    """The declared rules applied — ranges and required columns, text patterns, date formats.

    The date rule holds for the column that ``column_map`` names ``date`` (or a column of that name): a value that none
    of the declared formats reads is a violation.

    One aggregate row with a count per rule, unpivoted to
    (rule_column, source_column, rule, present, n_checked, n_violations).
    """
    cmap = column_map or {}
    cols = {c.lower(): c for c in df.columns}
    structs = []
    for name, lo, hi, required in FINANCIAL_RULES:
        src = cmap.get(name, cols.get(name))
        if src is not None:
            v = F.col(src)
            structs.append(F.struct(F.lit(name).alias("rule_column"), F.lit(src).alias("source_column"),
                                    F.lit("range").alias("rule"), F.lit(True).alias("present"),
                                    F.count(v).alias("n_checked"),
                                    F.count_if((v < lo) | (v > hi)).alias("n_violations")))
            if required:
                structs.append(F.struct(F.lit(name).alias("rule_column"), F.lit(src).alias("source_column"),
                                        F.lit("required").alias("rule"), F.lit(True).alias("present"),
                                        F.count(F.lit(1)).alias("n_checked"),
                                        F.count_if(v.isNull()).alias("n_violations")))
        elif required:
            structs.append(F.struct(F.lit(name).alias("rule_column"), F.lit(None).cast("string").alias("source_column"),
                                    F.lit("required").alias("rule"), F.lit(False).alias("present"),
                                    F.count(F.lit(1)).alias("n_checked"), F.count(F.lit(1)).alias("n_violations")))
    for name, pattern in TEXT_RULES:
        src = cmap.get(name, cols.get(name))
        if src is None:
            continue
        v = F.col(src)
        structs.append(F.struct(F.lit(name).alias("rule_column"), F.lit(src).alias("source_column"),
                                F.lit("pattern").alias("rule"), F.lit(True).alias("present"),
                                F.count(v).alias("n_checked"), F.count_if(~v.rlike(pattern)).alias("n_violations")))
    src = cmap.get("date", cols.get("date"))
    if src is not None:
        v = F.col(src)
        structs.append(F.struct(F.lit("date").alias("rule_column"), F.lit(src).alias("source_column"),
                                F.lit("date_format").alias("rule"), F.lit(True).alias("present"),
                                F.count(v).alias("n_checked"),
                                F.count_if(v.isNotNull() & parse_date_any(v, DATE_FORMATS).isNull()).alias("n_violations")))
    return df.agg(F.array(*structs).alias("_r")).select(F.explode("_r").alias("r")).select("r.*")
