"""Exact deduplication by skew-safe combining.

1. Local: each map task folds equal texts (the partial aggregation), one row per text and task.
2. Salted: the local rows meet by (digest, salt, text); the salt comes from the map task, so a
   text with very many copies is merged by ``salts`` tasks.
3. Global: the salt winners, at most ``salts`` a text, meet by (digest, text).

The whole text is a grouping key in all three steps, so texts are compared, not only digests.
The answer goes back to the rows by digest; should two different texts ever share a SHA-256
digest, the job stops with an error rather than merge them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import ascii_lower, staged, text_or_empty


def combine(texts: DataFrame, salts: int = 16) -> DataFrame:
    """(_h, _t, _id) rows -> one row per digest: keep_id, group_size, number of texts."""
    local = (texts.withColumn("_s", F.pmod(F.spark_partition_id(), F.lit(salts)))
             .groupBy("_h", "_s", "_t").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_k")))
    whole = local.groupBy("_h", "_t").agg(F.sum("_n").alias("_n"), F.max("_k").alias("_k"))
    return whole.groupBy("_h").agg(F.count(F.lit(1)).alias("_texts"), F.sum("_n").alias("group_size"),
                                   F.max("_k").alias("keep_id"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the
    largest id stays. Null text counts as empty. Rows that repeat an id and its text: one of
    them stays. A null id stays only where its whole group has null ids (keep_id null, one row
    kept). Further columns of the input are ignored; an empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).alias("_id"), ascii_lower(text_or_empty(F.col(text_col))).alias("_t"))
    rows = rows.withColumn("_h", F.unhex(F.sha2(F.col("_t"), 256)))
    groups = staged(combine(rows, salts), "exact-groups")
    one = F.when(F.col("_texts") == 1, F.col("group_size")).otherwise(
        F.raise_error(F.lit("two different texts share a SHA-256 digest")).cast("long"))
    groups = groups.select("_h", "keep_id", one.alias("group_size"))
    # dealt anew by id, so that the join itself may split a digest with very many rows
    joined = rows.select("_id", "_h").join(groups, "_h").repartition("_id")
    nth = F.row_number().over(Window.partitionBy("_h", "_id").orderBy("keep_id"))
    return joined.select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (nth == 1)).alias("kept"),
        F.lower(F.hex("_h")).alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns (ids must be unique and not null)."""
    keep = exact_dedup(df, id_col, text_col).where("kept").select(F.col(id_col).alias("__keep"))
    return df.join(keep, df[id_col] == keep["__keep"], "left_semi")
