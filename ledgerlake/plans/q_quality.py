"""Queries S1–S6, C1–C9, D1–D15 over the messy, features, segment_pnl and cells fixtures."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions.exprs import FLOAT_TEXT, PLAIN_NUMBER, rnd
from ledgerlake.functions.fixed import FINANCIAL_RULES, NA_STRINGS, TEXT_RULES
from ledgerlake.operators import clean as CL
from ledgerlake.operators import positions as P
from ledgerlake.operators import quality as Q
from ledgerlake.plans.oracle_fixtures import R, with_fixtures
from ledgerlake.plans.registry import register
from ledgerlake.plans.sqlbits import sq
from ledgerlake.session import materialize, scratch_path
from ledgerlake.sources import fixtures as FX
from ledgerlake.sources import ingest as IN
from ledgerlake.sources.tables import Tables

TEXT = ["amount_text", "date_text", "note", "blank"]
NUMS = ["row_id", "revenue", "expenses", "cash"]
ALL = ["row_id", "amount_text", "date_text", "note", "blank", "revenue", "expenses", "cash"]
DUCK_FORMATS = ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y-%m", "%m-%Y", "%Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S"]


def NUM(v):
    return f"regexp_matches(regexp_replace({v}, '[,$%]', '', 'g'), {sq(FLOAT_TEXT)})"


def DATE(v, first=None):
    from ledgerlake.functions.exprs import DATE_FORMATS, FORMAT_SHAPES, ISO_TIMESTAMP_FORMATS
    shapes = [FORMAT_SHAPES[f] for f in DATE_FORMATS + ISO_TIMESTAMP_FORMATS]
    return "coalesce(" + ", ".join(
        f"CASE WHEN regexp_matches(trim({v}), {sq(sh)}) THEN try_strptime(trim({v}), '{f}') END"
        for f, sh in list(zip(DUCK_FORMATS, shapes))[:first]) + ")"


def _messy(spark, d):
    return FX.messy(Tables(spark, d))


def _messy_all(spark, d):
    return FX.messy_all(Tables(spark, d))


# ---------------------------------------------------------------- S1–S6
_NA = ", ".join(sq(x) for x in NA_STRINGS)


@register("csv_scan", with_fixtures(f"""
SELECT row_id, {", ".join(f"CASE WHEN {c} IN ({_NA}) THEN NULL ELSE {c} END AS {c}" for c in TEXT)},
  revenue, expenses, cash FROM messy""", "messy"))
def csv_scan(spark, d):
    """Write the messy table as CSV to the shared scratch folder, scan it back with a declared schema."""
    m = _messy(spark, d)
    path = IN.write_csv(m, scratch_path(spark, "csv_scan"))
    return IN.read_csv(spark, path, schema=m.schema)


@register("csv_quarantine", with_fixtures("""
SELECT row_id, CASE WHEN row_id % 29 = 0 OR row_id % 31 = 0 THEN NULL ELSE expenses END AS expenses,
  nullif(concat_ws(',', CASE WHEN row_id % 31 = 0 AND row_id % 29 <> 0 THEN 'expenses' END,
    CASE WHEN ends_with(amount_text, 'e2') THEN '_record' END), '') AS failed FROM messy""", "messy"))
def csv_quarantine(spark, d):
    """Numbers written as N/A or as other text, and lines with a cell too many, scanned with the failing fields named."""
    k = F.col("row_id")
    dirty = (F.when(k % 29 == 0, "N/A").when(k % 31 == 0, "oops").otherwise(F.col("expenses").cast("string")))
    extra = F.when(F.col("amount_text").endswith("e2"), ",surplus").otherwise("")
    lines = _messy(spark, d).select(F.concat(F.coalesce(k.cast("string"), F.lit("")), F.lit(","), F.coalesce(dirty, F.lit("")), extra))
    path = scratch_path(spark, "csv_quarantine")
    lines.write.text(path)
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("expenses", T.DoubleType())])
    return IN.read_csv(spark, path, schema, corrupt_column="failed", header=False)


_S3 = """sh AS (SELECT doc_id, page, strategy, table_no, count(DISTINCT row_idx) AS n_rows, count(DISTINCT col_idx) AS n_cols
      FROM cells GROUP BY 1, 2, 3, 4),
cand AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, CASE WHEN strategy = 'lattice' THEN 0 ELSE 1 END) AS rk
      FROM sh WHERE table_no = 0 AND n_rows > 3 AND n_cols > 3),
docs AS (SELECT DISTINCT doc_id FROM cells),
s3 AS (SELECT d.doc_id, CAST(coalesce(c.page, 0) AS BIGINT) AS page, c.strategy,
        CAST(coalesce(c.table_no, -1) AS INTEGER) AS table_no, coalesce(c.n_rows, 0) AS n_rows,
        coalesce(c.n_cols, 0) AS n_cols, c.page IS NOT NULL AS found
      FROM docs d LEFT JOIN (SELECT * FROM cand WHERE rk = 1) c USING (doc_id))"""


@register("first_usable_table", with_fixtures(f"WITH {_S3}\nSELECT * FROM s3", "cells"))
def first_usable_table(spark, d):
    return IN.first_usable_table(FX.cells(Tables(spark, d)))


@register("promote_header", with_fixtures(f"""
WITH {_S3},
c AS (SELECT cells.*, CASE WHEN regexp_matches(text, '^\\s*$') THEN NULL ELSE text END AS t
      FROM cells JOIN (SELECT * FROM s3 WHERE found) ch USING (doc_id, page, strategy, table_no)),
rws AS (SELECT doc_id, row_idx, count(t) AS filled FROM c GROUP BY 1, 2),
hdr AS (SELECT doc_id, coalesce(min(CASE WHEN filled > 2 THEN row_idx END), min(row_idx)) AS h FROM rws GROUP BY 1),
nm AS (SELECT c.doc_id, c.col_idx, coalesce(c.t, 'col_' || CAST(c.col_idx AS VARCHAR)) AS column_name
      FROM c JOIN hdr ON hdr.doc_id = c.doc_id AND c.row_idx = hdr.h)
SELECT c.doc_id, CAST(c.row_idx - hdr.h - 1 AS BIGINT) AS row_no, c.col_idx,
  coalesce(nm.column_name, 'col_' || CAST(c.col_idx AS VARCHAR)) AS column_name, c.t AS value
FROM c JOIN hdr ON hdr.doc_id = c.doc_id
JOIN rws r ON r.doc_id = c.doc_id AND r.row_idx = c.row_idx AND r.filled > 0
LEFT JOIN nm ON nm.doc_id = c.doc_id AND nm.col_idx = c.col_idx
WHERE c.row_idx > hdr.h""", "cells"))
def promote_header(spark, d):
    out = IN.promote_header(FX.cells(Tables(spark, d)), first_only=True)
    return out.select("doc_id", F.col("row_no").cast("bigint").alias("row_no"), "col_idx", "column_name", "value")


@register("promote_all_headers", with_fixtures("""
WITH c AS (SELECT cells.*, CASE WHEN regexp_matches(text, '^\\s*$') THEN NULL ELSE text END AS t FROM cells),
rws AS (SELECT doc_id, page, strategy, table_no, row_idx, count(t) AS filled FROM c GROUP BY ALL),
hdr AS (SELECT doc_id, page, strategy, table_no, coalesce(min(CASE WHEN filled > 2 THEN row_idx END), min(row_idx)) AS h
        FROM rws GROUP BY ALL),
b AS (SELECT c.*, hdr.h FROM c JOIN hdr USING (doc_id, page, strategy, table_no)
      JOIN rws USING (doc_id, page, strategy, table_no, row_idx) WHERE filled > 0 AND c.row_idx > h),
nm AS (SELECT c.doc_id, c.page, c.strategy, c.table_no, c.col_idx, c.t AS name
       FROM c JOIN hdr ON hdr.doc_id = c.doc_id AND hdr.page = c.page AND hdr.strategy = c.strategy AND hdr.table_no = c.table_no
         AND c.row_idx = hdr.h)
SELECT b.doc_id, CAST(b.page AS BIGINT) AS page, b.strategy, b.table_no, CAST(b.row_idx - b.h - 1 AS BIGINT) AS row_no, b.col_idx,
  coalesce(nm.name, 'col_' || b.col_idx) AS column_name, b.t AS value
FROM b LEFT JOIN nm USING (doc_id, page, strategy, table_no, col_idx)""", "cells"))
def promote_all_headers(spark, d):
    """S4 over every table of every document."""
    out = IN.promote_header(FX.cells(Tables(spark, d)))
    return out.withColumn("row_no", F.col("row_no").cast("bigint"))


@register("result_sink", with_fixtures("""
SELECT row_id, coalesce(x1, 0) AS x1, coalesce(x2, 0) AS x2, coalesce(x3, 0) AS x3, coalesce(x4, 0) AS x4
FROM features""", "features"))
def result_sink(spark, d):
    return IN.result_sink(FX.features(Tables(spark, d)), scratch_path(spark, "result_sink"))


@register("preview_summary", with_fixtures("""
SELECT count(*) AS n_rows, CAST(8 AS BIGINT) AS n_columns, CAST(3 AS BIGINT) AS n_dtypes FROM messy""", "messy"))
def preview_summary(spark, d):
    return IN.preview_summary(_messy(spark, d))


# ---------------------------------------------------------------- C1–C9
@register("drop_empty_rows", with_fixtures("""
SELECT amount_text, note, blank FROM messy WHERE NOT (amount_text IS NULL AND note IS NULL AND blank IS NULL)""", "messy"))
def drop_empty_rows(spark, d):
    return CL.drop_empty_rows(_messy(spark, d).select("amount_text", "note", "blank"))


@register("drop_empty_columns", with_fixtures(
    "SELECT row_id, amount_text, date_text, note, revenue, expenses, cash FROM messy", "messy"))
def drop_empty_columns(spark, d):
    return CL.drop_empty_columns(_messy(spark, d))


@register("trim_column_names", with_fixtures(f"SELECT {', '.join(ALL)} FROM messy", "messy"))
def trim_column_names(spark, d):
    m = _messy(spark, d)
    padded = m.toDF(*[f"  {c} " for c in m.columns])
    return CL.trim_column_names(padded)


@register("dedupe_rows", with_fixtures("SELECT DISTINCT * FROM messy", "messy"))
def dedupe_rows(spark, d):
    return CL.dedupe_rows(_messy(spark, d))


@register("clean_numeric_text_compat", with_fixtures("""
SELECT row_id, TRY_CAST(regexp_replace(amount_text, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS amount_text,
  date_text, note, blank, revenue, expenses, cash FROM messy""", "messy"))
def clean_numeric_text_compat(spark, d):
    """C5 as the plain strip."""
    return CL.clean_numeric_text(_messy(spark, d), compat=True)


@register("clean_numeric_text", with_fixtures(f"""
WITH t AS (SELECT *, trim(regexp_replace(amount_text, '[,$%]', '', 'g')) AS t0 FROM messy),
u AS (SELECT *, CASE WHEN starts_with(t0, '(') AND ends_with(t0, ')') THEN t0[2:-2] ELSE t0 END AS t1,
        CASE WHEN starts_with(t0, '(') AND ends_with(t0, ')') THEN -1 ELSE 1 END AS sign FROM t)
SELECT row_id, sign * CASE WHEN regexp_matches(t1, {sq(PLAIN_NUMBER)}) THEN TRY_CAST(t1 AS DOUBLE)
    ELSE TRY_CAST(regexp_replace(t1, '[^0-9.\\-]', '', 'g') AS DOUBLE) END AS amount_text,
  date_text, note, blank, revenue, expenses, cash FROM u""", "messy"))
def clean_numeric_text(spark, d):
    return CL.clean_numeric_text(_messy(spark, d))


@register("clean_pnl_columns", with_fixtures("""
WITH c AS (SELECT entity_id, business,
    TRY_CAST(regexp_replace(gov, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS gov,
    TRY_CAST(regexp_replace(adj_revenue, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS adj_revenue,
    TRY_CAST(regexp_replace(adj_ebitda, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS adj_ebitda FROM segment_pnl)
SELECT * FROM c WHERE adj_revenue IS NOT NULL AND adj_ebitda IS NOT NULL""", "segment_pnl"))
def clean_pnl_columns(spark, d):
    return P.clean_pnl(FX.segment_pnl(Tables(spark, d)))


@register("coerce_series", with_fixtures(f"""
SELECT row_id, CAST({DATE('date_text')} AS DATE) AS ds,
  CASE WHEN regexp_matches(amount_text, {sq(PLAIN_NUMBER)}) THEN TRY_CAST(trim(amount_text) AS DOUBLE) END AS y
FROM messy WHERE {DATE('date_text')} IS NOT NULL""", "messy"))
def coerce_series(spark, d):
    return CL.coerce_series(_messy(spark, d), "date_text", "amount_text", keys=["row_id"])


@register("coercion_report", with_fixtures(f"""
WITH c AS (SELECT date_text, amount_text, {DATE('date_text')} AS ds,
    CASE WHEN regexp_matches(amount_text, {sq(PLAIN_NUMBER)}) THEN TRY_CAST(trim(amount_text) AS DOUBLE) END AS y FROM messy)
SELECT count(*) AS n_rows, count_if(date_text IS NULL) AS null_dates, count_if(date_text IS NOT NULL AND ds IS NULL) AS rejected_dates,
  count_if(amount_text IS NOT NULL AND y IS NULL) AS rejected_values, count_if(ds IS NOT NULL) AS n_kept FROM c""", "messy"))
def coercion_report(spark, d):
    """What the coercion loses, observed while its result is written."""
    seen = Observation()
    kept = materialize(CL.coerce_series(_messy(spark, d), "date_text", "amount_text", observation=seen))
    got = seen.get
    return kept.agg(F.count(F.lit(1)).alias("n_kept")).select(
        F.lit(got["rows"]).alias("n_rows"), *[F.lit(got[c]).alias(c) for c in ("null_dates", "rejected_dates", "rejected_values")], "n_kept")


@register("impute_mean", with_fixtures(f"""
SELECT row_id, x1, {R('coalesce(x2, avg(x2) OVER ())', 6)} AS x2, x3, x4 FROM features""", "features"))
def impute_mean(spark, d):
    f = CL.impute_mean(FX.features(Tables(spark, d)), ["x2"])
    return f.select("row_id", "x1", rnd("x2", 6).alias("x2"), "x3", "x4")


@register("standardize", with_fixtures(f"""
SELECT row_id, {", ".join(
    R(f"(x{i} - avg(x{i}) OVER ()) / CASE WHEN stddev_pop(x{i}) OVER () = 0 THEN 1 ELSE stddev_pop(x{i}) OVER () END", 6)
    + f" AS x{i}" for i in range(1, 5))} FROM features""", "features"))
def standardize(spark, d):
    z = CL.standardize(FX.features(Tables(spark, d)), ["x1", "x2", "x3", "x4"], keep=["row_id"])
    return z.select("row_id", *[rnd(f"x{i}", 6).alias(f"x{i}") for i in range(1, 5)])


# ---------------------------------------------------------------- D1–D15
@register("structure_check", with_fixtures("""
SELECT 'row_count' AS check_name, count(*) AS value, count(*) < 1 AS failed FROM messy_all
UNION ALL SELECT 'column_count', 8, false UNION ALL SELECT 'duplicate_names', 0, false
UNION ALL SELECT 'blank_names', 0, false""", "messy_all"))
def structure_check(spark, d):
    return Q.structure_check(_messy_all(spark, d))


def _d2_sql():
    parts = []
    for c in TEXT:
        parts.append(f"""SELECT '{c}' AS "column", count({c}) AS non_null,
      count_if({NUM(c)}) AS numeric_count, count_if(NOT {NUM(c)} AND {DATE(c)} IS NOT NULL) AS date_count FROM messy_all""")
    return " UNION ALL ".join(parts)


_D2 = f"""d2 AS ({_d2_sql()}),
d2b AS (SELECT *, non_null - numeric_count - date_count AS text_count,
    CASE WHEN non_null > 0 THEN numeric_count / non_null END AS numeric_ratio,
    CASE WHEN non_null > 0 THEN date_count / non_null END AS date_ratio FROM d2),
d2c AS (SELECT *, CASE WHEN numeric_ratio > 0.8 THEN 'numeric' WHEN date_ratio > 0.8 THEN 'date' END AS flag FROM d2b)"""


@register("type_ratio_profile", with_fixtures(f"""
WITH {_D2}
SELECT "column", non_null, numeric_count, date_count, text_count, {R('numeric_ratio', 6)} AS numeric_ratio,
  {R('date_ratio', 6)} AS date_ratio, flag FROM d2c""", "messy_all"))
def type_ratio_profile(spark, d):
    t = Q.type_ratio_profile(Q.column_stats(_messy_all(spark, d)))
    return t.select("column", "non_null", "numeric_count", "date_count", "text_count",
                    rnd("numeric_ratio", 6).alias("numeric_ratio"), rnd("date_ratio", 6).alias("date_ratio"), "flag")


@register("negative_value_check", with_fixtures("""
SELECT 'revenue' AS "column", count_if(revenue < 0) AS negative_count, count_if(revenue < 0) > 0 AS flagged FROM messy_all
UNION ALL SELECT 'cash', count_if(cash < 0), count_if(cash < 0) > 0 FROM messy_all""", "messy_all"))
def negative_value_check(spark, d):
    return Q.negative_value_check(Q.column_stats(_messy_all(spark, d)))


@register("extreme_value_check", with_fixtures(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(max({c}) AS DOUBLE) AS max_value, max({c}) > 1e10 AS flagged FROM messy_all"""
    for c in NUMS), "messy_all"))
def extreme_value_check(spark, d):
    return Q.extreme_value_check(Q.column_stats(_messy_all(spark, d)))


def _d5_sql():
    parts = []
    for c in NUMS:
        parts.append(f"""SELECT '{c}' AS "column", quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3,
      count({c}) AS nn, (SELECT count(*) FROM messy_all) AS n_rows FROM messy_all""")
    return " UNION ALL ".join(parts)


def _d5_cnt_sql():
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count_if({c} < f.lower OR {c} > f.upper) AS outliers
      FROM messy_all, (SELECT * FROM d5b WHERE "column" = '{c}') f""" for c in NUMS)


_D5 = f"""d5 AS ({_d5_sql()}),
d5b AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM d5),
d5c AS ({_d5_cnt_sql()}),
d5d AS (SELECT b.*, c.outliers, c.outliers / b.nn AS ratio FROM d5b b JOIN d5c c USING ("column"))"""


@register("iqr_outliers", with_fixtures(f"""
WITH {_D5}
SELECT "column", {R('q1', 6)} AS q1, {R('q3', 6)} AS q3, {R('iqr', 6)} AS iqr, {R('lower', 6)} AS lower,
  {R('upper', 6)} AS upper, outliers, nn AS non_null, {R('ratio', 6)} AS outlier_ratio, ratio > 0.1 AS warn,
  outliers > n_rows * 0.05 AS review FROM d5d""", "messy_all"))
def iqr_outliers(spark, d):
    o = Q.iqr_outliers(_messy_all(spark, d))
    return o.select("column", *[rnd(c, 6).alias(c) for c in ("q1", "q3", "iqr", "lower", "upper")], "outliers",
                    "non_null", rnd("outlier_ratio", 6).alias("outlier_ratio"), "warn", "review")


_COUNTS = " + ".join(f"count({c})" for c in ALL)
_D6 = f"d6 AS (SELECT count(*) * 8 AS total_cells, {_COUNTS} AS filled_cells FROM messy_all)"


@register("completeness", with_fixtures(f"""
WITH {_D6}
SELECT total_cells, filled_cells, {R('filled_cells / total_cells', 6)} AS completeness,
  filled_cells / total_cells < 0.8 AS warn FROM d6""", "messy_all"))
def completeness(spark, d):
    c = Q.completeness(Q.column_stats(_messy_all(spark, d)))
    return c.select("total_cells", "filled_cells", rnd("completeness", 6).alias("completeness"), "warn")


@register("empty_columns", with_fixtures(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS non_null, count({c}) = 0 AS is_empty FROM messy_all""" for c in ALL),
    "messy_all"))
def empty_columns(spark, d):
    return Q.empty_columns(Q.column_stats(_messy_all(spark, d)))


_ALLNULL = " AND ".join(f"{c} IS NULL" for c in ALL)


@register("empty_rows", with_fixtures(f"""
SELECT count_if({_ALLNULL}) AS empty_rows, count_if({_ALLNULL}) > 0 AS warn FROM messy_all""", "messy_all"))
def empty_rows(spark, d):
    t = Q.table_stats(_messy_all(spark, d))
    return t.select("empty_rows", (F.col("empty_rows") > 0).alias("warn"))


@register("duplicate_rows", with_fixtures("""
SELECT (SELECT count(*) FROM messy_all) - (SELECT count(*) FROM (SELECT DISTINCT * FROM messy_all)) AS duplicate_rows""",
    "messy_all"))
def duplicate_rows(spark, d):
    return Q.duplicate_rows(_messy_all(spark, d))


@register("loss_records", with_fixtures("""
SELECT count_if(revenue - expenses < 0) AS loss_records, count_if(revenue - expenses < 0) > 0 AS warn FROM messy_all""",
    "messy_all"))
def loss_records(spark, d):
    t = Q.table_stats(_messy_all(spark, d))
    return t.select("loss_records", (F.col("loss_records") > 0).alias("warn"))


@register("excess_cash_records", with_fixtures("""
SELECT count_if(cash > expenses / 12 * 24) AS excess_cash_records, count_if(cash > expenses / 12 * 24) > 0 AS warn
FROM messy_all""", "messy_all"))
def excess_cash_records(spark, d):
    t = Q.table_stats(_messy_all(spark, d))
    return t.select("excess_cash_records", (F.col("excess_cash_records") > 0).alias("warn"))


@register("missing_heavy_columns", with_fixtures(f"""
WITH n AS (SELECT count(*) AS n FROM messy_all),
c AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, count(*) - count({c}) AS null_count FROM messy_all" for c in ALL)})
SELECT col AS "column", null_count, {R('null_count / n', 6)} AS null_ratio FROM c, n WHERE null_count > n * 0.1""",
    "messy_all"))
def missing_heavy_columns(spark, d):
    m = Q.missing_heavy_columns(Q.column_stats(_messy_all(spark, d)))
    return m.select("column", "null_count", rnd("null_ratio", 6).alias("null_ratio"))


_FOUND = " UNION ALL ".join(
    ["SELECT 'empty_columns' AS code, NULL AS \"column\", 'error' AS severity, empty_cols AS n, empty_cols > 0 AS yes FROM ec",
     """SELECT 'stored_as_text_' || flag, "column", 'warning', CASE WHEN flag = 'numeric' THEN numeric_count ELSE date_count END,
  flag IS NOT NULL FROM d2c"""]
    + [f"SELECT 'negative_values', '{c}', 'warning', count_if({c} < 0), count_if({c} < 0) > 0 FROM messy_all" for c in ("revenue", "cash")]
    + [f"SELECT 'extreme_values', '{c}', 'warning', 1, max({c}) > 1e10 FROM messy_all" for c in NUMS]
    + ["""SELECT 'outliers', "column", 'warning', outliers, ratio > 0.1 FROM d5d""",
       "SELECT 'low_completeness', NULL, 'warning', total_cells - filled_cells, filled_cells / total_cells < 0.8 FROM d6",
       "SELECT 'empty_rows', NULL, 'warning', er, er > 0 FROM ts", "SELECT 'loss_records', NULL, 'warning', loss, loss > 0 FROM ts",
       "SELECT 'excess_cash', NULL, 'warning', excess, excess > 0 FROM ts",
       "SELECT 'duplicate_rows', NULL, 'warning', dups, dups > 0 FROM dup"])
_CHECKS = f"""{_D2}, {_D5}, {_D6},
ts AS (SELECT count_if(revenue - expenses < 0) AS loss, count_if(cash > expenses / 12 * 24) AS excess,
         count_if({_ALLNULL}) AS er FROM messy_all),
dup AS (SELECT (SELECT count(*) FROM messy_all) - (SELECT count(*) FROM (SELECT DISTINCT * FROM messy_all)) AS dups),
ec AS (SELECT {" + ".join(f"CASE WHEN count({c}) = 0 THEN 1 ELSE 0 END" for c in ALL)} AS empty_cols FROM messy_all),
found AS (SELECT code, "column", severity, n FROM ({_FOUND}) WHERE yes)"""


@register("findings", with_fixtures(f"""
WITH {_CHECKS}
SELECT code, "column", severity, CAST(n AS BIGINT) AS n FROM found""", "messy_all"))
def findings(spark, d):
    """Every error and warning of a table, with its count."""
    return Q.findings(materialize(_messy_all(spark, d)))


@register("suggestions", with_fixtures(f"""
WITH {_D2}, {_D5},
s AS ({" UNION ALL ".join(f"""SELECT '{c}' AS c, count({c}) AS nn, count_if({NUM(c)}) AS num, count_if({DATE(c)} IS NOT NULL) AS dt FROM messy_all"""
                         for c in TEXT)}),
m AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, count(*) - count({c}) AS k, count(*) AS n FROM messy_all" for c in ALL)})
SELECT 'convert_to_numeric' AS code, c AS "column", num AS n FROM s WHERE nn > 0 AND num / nn > 0.8
UNION ALL SELECT 'convert_to_datetime', c, dt FROM s WHERE nn > 0 AND num / nn <= 0.8 AND dt / nn > 0.8
UNION ALL SELECT 'impute_missing', c, k FROM m WHERE k > n * 0.1
UNION ALL SELECT 'review_outliers', "column", outliers FROM d5d WHERE outliers > n_rows * 0.05""", "messy_all"))
def suggestions(spark, d):
    """What to convert, impute or review."""
    return Q.suggestions(materialize(_messy_all(spark, d)))


@register("quality_score", with_fixtures(f"""
WITH {_CHECKS},
cnt AS (SELECT (SELECT count_if(severity = 'error') FROM found) AS errors, (SELECT count_if(severity = 'warning') FROM found) AS warnings,
   (SELECT filled_cells / total_cells FROM d6) AS comp, (SELECT count_if(flag = 'numeric') / count(*) FROM d2c) AS tir)
SELECT CAST(errors AS BIGINT) AS errors, CAST(warnings AS BIGINT) AS warnings, {R('comp', 6)} AS completeness,
  {R('tir', 6)} AS type_issue_ratio,
  {R('greatest(0.0, least(1.0, 1.0 - errors * 0.2 - warnings * 0.05 - (1 - comp) * 0.3 - tir * 0.2))', 6)} AS quality_score
FROM cnt""", "messy_all"))
def quality_score(spark, d):
    s = Q.quality_score(materialize(_messy_all(spark, d)))  # one profile reads it several times
    return s.select("errors", "warnings", rnd("completeness", 6).alias("completeness"),
                    rnd("type_issue_ratio", 6).alias("type_issue_ratio"), rnd("quality_score", 6).alias("quality_score"))


@register("structure_errors", with_fixtures("""
SELECT 'row_count' AS check_name, count(*) AS value, count(*) < 1 AS failed FROM messy_all
UNION ALL SELECT 'column_count', 3, false UNION ALL SELECT 'duplicate_names', 1, true
UNION ALL SELECT 'blank_names', 1, true""", "messy_all"))
def structure_errors(spark, d):
    """D1 on a table with a repeated and a blank name."""
    return Q.structure_check(_messy_all(spark, d).select("revenue", F.col("cash").alias("revenue"), F.col("note").alias("  ")))


@register("financial_validation", with_fixtures(f"""
WITH g AS (SELECT note, sum(CAST(floor(revenue * 10000.0 + 0.5) AS BIGINT)) / 10000.0 AS tr,
     sum(CAST(floor(expenses * 10000.0 + 0.5) AS BIGINT)) / 10000.0 AS te FROM messy_all GROUP BY 1)
SELECT note, tr AS total_revenue, te AS total_expenses, tr - te AS total_profit,
  {R('CASE WHEN tr > 0 THEN (tr - te) / tr ELSE 0 END', 6)} AS profit_margin,
  tr - te < 0 AS loss_warning, te > tr * 0.9 AS high_expense_warning FROM g""", "messy_all"))
def financial_validation(spark, d):
    v = Q.financial_validation(_messy_all(spark, d), by=["note"])
    return v.select("note", "total_revenue", "total_expenses", "total_profit",
                    rnd("profit_margin", 6).alias("profit_margin"), "loss_warning", "high_expense_warning")


def _d15_sql():
    parts = []
    present = {"revenue", "expenses", "cash"}
    for name, lo, hi, req in FINANCIAL_RULES:
        if name in present:
            parts.append(f"""SELECT '{name}' AS rule_column, '{name}' AS source_column, 'range' AS rule, true AS present,
      count({name}) AS n_checked, count_if({name} < {lo!r} OR {name} > {hi!r}) AS n_violations FROM messy_all""")
            if req:
                parts.append(f"""SELECT '{name}', '{name}', 'required', true, count(*), count_if({name} IS NULL) FROM messy_all""")
        elif req:
            parts.append(f"""SELECT '{name}', NULL, 'required', false, count(*), count(*) FROM messy_all""")
    for name, pat in TEXT_RULES:
        if name == "category":
            parts.append(f"""SELECT '{name}', 'note', 'pattern', true, count(note),
      count_if(NOT regexp_matches(note, {sq(pat)})) FROM messy_all""")
    parts.append(f"""SELECT 'date', 'date_text', 'date_format', true, count(date_text),
      count_if(date_text IS NOT NULL AND {DATE('date_text', 6)} IS NULL) FROM messy_all""")
    return " UNION ALL ".join(parts)


@register("rule_range_check", with_fixtures(_d15_sql(), "messy_all"))
def rule_range_check(spark, d):
    return Q.rule_range_check(_messy_all(spark, d), column_map={"category": "note", "date": "date_text"})
