"""File scans, landing-folder manifest, table picking in cell grids, sinks.

Files are read by Spark's own sources (CSV, Parquet, binaryFile); nothing is
parsed on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions.exprs import PLAIN_NUMBER
from ledgerlake.functions.fixed import ALLOWED_EXTENSIONS, MAX_UPLOAD_BYTES, NA_STRINGS, UPLOAD_BAD_TYPE, UPLOAD_TOO_LARGE


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, na_values=NA_STRINGS,
             rejected: str = "_rejected", header: bool = True) -> DataFrame:
    """CSV with a declared schema, read as text first.

    Missing-value text becomes NULL in columns of every type, then cells are cast. ``rejected`` lists the
    fields of a row whose text is not of their type (their cell is NULL), and ``_record`` for a line with too few
    or too many cells.
    """
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField("_record", T.StringType())])
    text = (spark.read.option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_record")
            .schema(raw).csv(path))
    cells, bad = [], []
    for f in schema.fields:
        t = F.when(~F.col(f.name).isin(list(na_values)), F.col(f.name))
        v = t
        if isinstance(f.dataType, T.NumericType):
            v = F.when(t.rlike(PLAIN_NUMBER), F.trim(t).try_cast(f.dataType))
        elif not isinstance(f.dataType, T.StringType):
            v = F.trim(t).try_cast(f.dataType)
        cells.append(v.alias(f.name))
        bad.append(F.when(t.isNotNull() & v.isNull(), F.lit(f.name)))
    bad.append(F.when(F.col("_record").isNotNull(), F.lit("_record")))
    return text.select(*cells, F.filter(F.array(*bad), lambda b: b.isNotNull()).alias(rejected))


def split_rejected(scanned: DataFrame, rejected: str = "_rejected") -> tuple[DataFrame, DataFrame]:
    """The good rows of a scan, and the quarantined rows with the failing fields named."""
    bad = F.size(rejected) > 0
    return scanned.where(~bad).drop(rejected), scanned.where(bad)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, na_values=NA_STRINGS,
             corrupt_column: str | None = None, header: bool = True) -> DataFrame:
    """CSV files, with a header line each unless told otherwise; declared schema (or inference); missing-value text -> NULL.

    With a schema all rows are kept, a cell that is not of its type is NULL, and ``corrupt_column`` names the failing
    fields of a row (NULL for a good one); see ``scan_csv``.
    """
    if schema is not None:
        df = scan_csv(spark, path, schema, na_values, header=header)
        named = F.when(F.size("_rejected") > 0, F.array_join("_rejected", ","))
        return df.withColumn(corrupt_column, named).drop("_rejected") if corrupt_column else df.drop("_rejected")
    df = spark.read.option("header", header).option("inferSchema", True).csv(path)
    return df.select(*[F.when(~F.col(f.name).isin(list(na_values)), F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def ingest_manifest(spark: SparkSession, landing_dir: str, allowed=ALLOWED_EXTENSIONS,
                    max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """One verdict row per file of a landing folder (content is never read)."""
    files = spark.read.format("binaryFile").load(landing_dir).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ext = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))
    out = files.select(name.alias("file_name"), ext.alias("extension"), F.col("length").alias("size_bytes"))
    too_big = F.col("size_bytes") > max_bytes
    bad_ext = ~F.col("extension").isin(list(allowed))
    errors = F.concat_ws("; ",
                         F.when(too_big, F.lit(UPLOAD_TOO_LARGE.format(mb=max_bytes // (1024 * 1024)))),
                         F.when(bad_ext, F.concat(F.lit(UPLOAD_BAD_TYPE), F.col("extension"))))
    return out.select("*", (~too_big & ~bad_ext).alias("is_valid"), errors.alias("errors"))


TABLE = ["doc_id", "page", "strategy", "table_no"]


def table_shapes(cells: DataFrame) -> DataFrame:
    """Per table its rows and columns, from the cells' places alone (a cell without a row or column index counts as of one more)."""
    size = lambda c: (F.size(F.collect_set(c)) + F.max(F.isnull(c).cast("int"))).cast("long")
    return cells.groupBy(*TABLE).agg(size("row_idx").alias("n_rows"), size("col_idx").alias("n_cols"))


def _usable(first_page, last_page, min_rows: int, min_cols: int) -> Column:
    """Whether a table of ``n_rows`` rows and ``n_cols`` columns may be a document's first one."""
    usable = (F.col("table_no") == 0) & (F.col("n_rows") > min_rows) & (F.col("n_cols") > min_cols)
    if first_page is not None:
        usable &= F.col("page") >= first_page
    if last_page is not None:
        usable &= F.col("page") <= last_page
    return usable


def _place() -> Column:
    """Order of a document's tables: by page, then lattice before stream."""
    return F.struct("page", F.when(F.col("strategy") == "lattice", 0).otherwise(1).alias("r"), "strategy")


def first_usable_table(cells: DataFrame, first_page: int | None = None, last_page: int | None = None, min_rows: int = 3,
                       min_cols: int = 3) -> DataFrame:
    """S3: per document, the first table (by page, then lattice before stream) with > 3 rows and > 3 columns.

    All pages are read unless the caller names a first or last one.
    """
    own = F.struct("page", "strategy", "table_no", "n_rows", "n_cols")
    place = F.when(_usable(first_page, last_page, min_rows, min_cols), _place())
    # tables that are not usable have a NULL ordering and never win, so a document without any keeps its row
    j = table_shapes(cells).groupBy("doc_id").agg(F.min_by(own, place).alias("b"))
    # documents without a usable table keep a row: found = false, page 0, table -1, shape 0 x 0
    return j.select("doc_id", F.coalesce("b.page", F.lit(0)).cast("bigint").alias("page"), "b.strategy",
                    F.coalesce("b.table_no", F.lit(-1)).cast("int").alias("table_no"),
                    F.coalesce("b.n_rows", F.lit(0)).alias("n_rows"), F.coalesce("b.n_cols", F.lit(0)).alias("n_cols"),
                    F.col("b").isNotNull().alias("found"))


def promote_header(cells: DataFrame, first_only: bool = False, min_cells: int = 2, first_page: int | None = None,
                   last_page: int | None = None, min_rows: int = 3, min_cols: int = 3) -> DataFrame:
    """Blanks -> NULL; header = first row with > 2 filled cells (the first row if none); rows above it and
    all-NULL rows go. Long output: the table's keys, row_no, col_idx, column_name, value.

    ``first_only`` keeps each document's first usable table (S3). The cells are dealt out by document and sorted by
    table and row once, or not even that where they come dealt by document; all else are windows over that order.
    """
    in_doc, table, row = Window.partitionBy("doc_id"), Window.partitionBy(*TABLE), Window.partitionBy(*TABLE, "row_idx")
    c = cells.select(*TABLE, "row_idx", "col_idx", F.when(~F.col("text").rlike(r"^\s*$"), F.col("text")).alias("text"))
    # a row's place in its document comes first: its order serves every window below
    c = c.withColumn("_place", F.dense_rank().over(in_doc.orderBy(*TABLE[1:], "row_idx")))
    c = c.withColumn("_filled", F.count("text").over(row))
    c = c.withColumn("_top", F.min("_place").over(table)).withColumn("_head", F.coalesce(F.min(F.when(F.col("_filled") > min_cells, F.col("row_idx"))).over(table), F.min("row_idx").over(table)))
    if first_only:
        c = c.withColumns({"n_rows": (F.max("_place").over(table) - F.col("_top") + 1).cast("long"), "n_cols": (
            F.size(F.collect_set("col_idx").over(table)) + F.max(F.isnull("col_idx").cast("int")).over(table)).cast("long")})
        c = c.withColumn("_first", F.min(F.when(_usable(first_page, last_page, min_rows, min_cols), _place())).over(in_doc)).where(
            "table_no = 0 AND page = _first.page AND strategy = _first.strategy")
    default_name = F.concat(F.lit("col_"), F.col("col_idx").cast("string"))
    header = F.when(F.col("row_idx") == F.col("_head"), F.struct("col_idx", F.coalesce("text", default_name)))
    c = c.withColumn("_header", F.collect_list(header).over(table))
    known = F.lit(True)
    for k in TABLE:
        known &= F.col(k).isNotNull()
    # a table's first row is never in its body; read here, the places and their order are not pruned from the plan
    body = c.where(known & (F.col("_place") > F.col("_top")) & (F.col("row_idx") > F.col("_head")) & (F.col("_filled") > 0))
    name = F.try_element_at(F.map_from_entries("_header"), F.col("col_idx"))
    return body.select(*TABLE, (F.col("row_idx") - F.col("_head") - 1).alias("row_no"), "col_idx",
                       F.coalesce(name, default_name).alias("column_name"), F.col("text").alias("value"))


def result_sink(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Numeric NULLs -> 0 (text stays NULL), write, and read back what was written."""
    nums = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    filled = df.na.fill(0, subset=nums) if nums else df
    filled.write.mode("overwrite").format(fmt).save(path)
    return df.sparkSession.read.format(fmt).load(path)


def preview_summary(df: DataFrame) -> DataFrame:
    """Record count, column count and number of distinct column types, as one row."""
    kinds = len({f.dataType.simpleString() for f in df.schema.fields})
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), F.lit(kinds).cast("long").alias("n_dtypes"))
