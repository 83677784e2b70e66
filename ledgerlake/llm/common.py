"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SPACE = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A text of ASCII alone can take the much faster ``lower``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null and blank texts have none."""
    trimmed = F.regexp_replace(text_or_empty(text), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the cluster's shared checkpoint folder and read it back.

    Cuts lineage (a lost executor re-reads the files), and the scan has no partitioning of its
    own, so that a later join shuffles both sides and the adaptive planner may split hot keys.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that later ones, written by now, have replaced."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows that an Arrow batch of whole texts holds in a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def uniform(*cols: Column) -> Column:
    """Uniform double in [0, 1) from a hash of the columns: the same in every run and partitioning."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) * F.lit(2.0 ** -53)
