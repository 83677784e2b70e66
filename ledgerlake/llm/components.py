"""Connected components of a link table by alternating star contraction.

Each round hangs every node's larger neighbours on its least neighbour (large star), then a
node's smaller neighbours and itself on the least of them (small star). Links turn into stars
around the least node of each component in a few rounds. Rounds are written to the shared
checkpoint folder; the driver reads one number a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import discard, staged


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    inner = links.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.union(least.toDF("u", "v"))


def _stars(e: DataFrame) -> bool:
    """Whether every node has one root and no root has another: then each component is one star."""
    rooted = e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
    return not rooted.union(e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")).limit(1).count()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) links -> (node, root) for every linked node that is not the least of its component.

    Links may be repeated, in either direction, or join a node to itself. Null ends are no links.
    The result is a staged table; those of earlier rounds are removed.
    """
    a, b = links.columns
    e = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = staged(e, name)
    while not _stars(e):
        large = staged(_large_star(e).distinct(), name)
        small = staged(_small_star(large).distinct(), name)
        discard(e, large)
        e = small
    out = e.toDF("node", "root")
    out.staged_path = e.staged_path
    return out
