"""Reproducible shuffle into shards: a Feistel permutation, with cycle walking, of row numbers.

Every row gets a global number 0..N-1 from its content (bucket by hash, then order within the
bucket), so the number does not depend on files or partitions. The permutation is a generalised
Feistel network on Z_a x Z_b with a*b just over N; a value that lands outside 0..N-1 is permuted
again until it lands inside (cycle walking). Position p goes to shard ``p mod S``, slot
``p div S``: shard sizes differ by one row at most, slots have no gaps, and both directions can
be computed without looking at any other row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6
WALKS = 64  # outside values are fewer than a + b, about 2 sqrt(N): 64 in a row do not occur


def _sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _quotient(x: Column, d: int) -> Column:
    """Whole-number quotient of long values (``/`` would go through doubles)."""
    return F.call_function("div", x, F.lit(d))


def _network(x: Column, n: int, key: int, inverse: bool = False) -> Column:
    a, b = _sides(n)
    start = F.struct(_quotient(x, b).alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
    sign = -1 if inverse else 1

    def mix(s, i):
        f = F.xxhash64(F.when(i % 2 == 0, s["r"]).otherwise(s["l"]), i, F.lit(key))
        left = F.pmod(s["l"] + F.lit(sign) * F.pmod(f, F.lit(a)), F.lit(a)).cast("long")
        right = F.pmod(s["r"] + F.lit(sign) * F.pmod(f, F.lit(b)), F.lit(b)).cast("long")
        return F.struct(F.when(i % 2 == 0, left).otherwise(s["l"]).alias("l"),
                        F.when(i % 2 == 0, s["r"]).otherwise(right).alias("r"))

    steps = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    return F.aggregate(F.array(*[F.lit(i) for i in steps]), start, mix, lambda s: s["l"] * F.lit(b) + s["r"])


def permute(x: Column, n: int, key: int = 0, inverse: bool = False) -> Column:
    """Image of 0 <= x < n under the keyed permutation of 0..n-1 (or its inverse)."""
    walked = F.aggregate(F.array_repeat(F.lit(0), WALKS), _network(x, n, key, inverse),
                         lambda v, _: F.when(v < n, v).otherwise(_network(v, n, key, inverse)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def position(shard: Column, slot: Column, n: int, shards: int, key: int = 0) -> Column:
    """The global row number that sits at (shard, slot)."""
    return permute(slot * F.lit(shards) + shard, n, key, inverse=True)


def global_rows(df: DataFrame, order: list[Column], buckets: int = 4096) -> tuple[DataFrame, int]:
    """Add ``_row``, a gapless number that the content alone decides, and return the row count.

    ``buckets`` bounds what the driver reads: one count for each bucket.
    """
    keyed = df.withColumn("_key", F.struct(*order)).withColumn(
        "_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int"))
    counts = {r[0]: r[1] for r in keyed.groupBy("_bucket").count().collect()}
    offsets, total = [], 0
    for b in range(buckets):
        offsets.append(total)
        total += counts.get(b, 0)
    nth = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key"))
    before = F.element_at(F.lit(offsets).cast("array<bigint>"), F.col("_bucket") + 1)
    return keyed.withColumn("_row", before + nth - 1).drop("_key", "_bucket"), total


def assign_shards(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
                  key: int = 0, buckets: int = 4096) -> DataFrame:
    """All rows and columns of ``df`` with ``shard`` (int) and ``slot`` (long).

    Law ``rows``: shard sizes differ by one at most. Equal rows are interchangeable; null ids
    and texts are values like others. Input columns named shard or slot are replaced. An empty
    table gives an empty result.
    """
    df = df.drop("shard", "slot")
    content = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    numbered, n = global_rows(df, [F.col(id_col), content], buckets)
    p = permute(F.col("_row"), max(n, 1), key)
    return (numbered.withColumn("_p", p)
            .withColumn("shard", F.pmod("_p", F.lit(shards)).cast("int"))
            .withColumn("slot", _quotient(F.col("_p"), shards))
            .drop("_row", "_p"))


def write_shards(df: DataFrame, path: str, shards: int, **how) -> None:
    """Write the shards as folders ``shard=k`` whose files are in slot order."""
    (assign_shards(df, shards, **how).repartition(shards, "shard").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
