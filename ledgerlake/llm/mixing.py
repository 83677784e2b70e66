"""Mixing sources to target weights by pivotal dependent rounding.

Every row of a source should be copied ``target / source size`` times. The whole part is taken
outright; the fraction is rounded dependently. Two rows at a time meet: mass (words) moves from
one to the other, in a random direction whose odds keep both expectations, until one of them
has a whole number of copies. The other goes on. The words taken therefore stay constant
through every step.

The steps form a reduction tree. At its leaves, rows of a source meet in small blocks chosen by
a hash; each block leaves one open row at most, and ``FAN_IN`` open rows meet at the next level,
until a source has one. That last row is rounded to the nearer side, so the words of a source
differ from its target by half of one row's size at most. Rows meet in order of falling size: a
large row settles early, in many small steps, and the last open row tends to be small.
All randomness is a hash of row contents: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import n_words, staged, text_or_empty, uniform

LEAF, FAN_IN = 128, 64
ITEM = "struct<size: bigint, h: bigint, id: {id}, mass: double, base: int>"


def source_targets(rows: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """(_s, _size) rows -> one row per source: source_size, _n, target, _ratio.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all
    sizes. A target stops at ``most`` times its source's size; the excess goes to the others
    by weight. The common level is where the sum fits: sources are sorted by the level at
    which they fill, and the first whose level is not below the remaining share sets it.
    """
    per = rows.groupBy("_s").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    per = staged(per, "mix-sources")  # read several times below; one row a source
    rank = F.row_number().over(Window.orderBy(F.col("_s").asc_nulls_last()))
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                            F.pmod(rank - 1, F.lit(len(weights))) + 1))
    total = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (per.withColumn("_cap", F.col("source_size") * F.lit(most)).withColumn("_fill", F.col("_cap") / F.col("_w"))
           .withColumn("_budget", F.sum("source_size").over(total) * F.lit(share)))
    by_fill = Window.orderBy("_fill", "_w", "_s")
    before = F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("_w").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("_level", (F.col("_budget") - before) / onward)
    fits = F.when(F.col("_level") <= F.col("_fill"), F.struct("_fill", "_w", "_s", "_level"))
    per = per.withColumn("_common", F.min(fits).over(total)["_level"])
    full = F.col("_common").isNull() | (F.col("_fill") <= F.col("_common"))
    return per.select(
        "_s", "_n", "source_size",
        F.when(full, F.col("_cap")).otherwise(F.col("_common") * F.col("_w")).alias("target"),
        F.when(F.col("source_size") == 0, F.lit(0.0)).when(full, F.lit(most))
        .otherwise(F.col("_common") * F.col("_w") / F.col("source_size")).alias("_ratio"))


def _meet(seed: int, id_type: str):
    """One step of the fold: the open item meets the next one."""
    nothing = F.lit(None).cast(ITEM.format(id=id_type))

    def item(x, mass):
        return F.struct(x["size"].alias("size"), x["h"].alias("h"), x["id"].alias("id"),
                        mass.cast("double").alias("mass"), x["base"].alias("base"))

    def settled(x, take):
        return F.array(F.struct(x["id"].alias("id"), x["size"].alias("size"),
                                (x["base"] + F.lit(take)).cast("int").alias("copies")))

    def step(state, x):
        c, out = state["open"], state["done"]
        up = F.least(c["size"] - c["mass"], x["mass"])      # c gains until full, or x is empty
        down = F.least(c["mass"], x["size"] - x["mass"])    # c gives until empty, or x is full
        gains = uniform(c["h"], x["h"], F.lit(seed)) * (up + down) < down

        def result(open_, add):
            return F.struct(open_.alias("open"), F.concat(out, add).alias("done"))

        return (F.when(c.isNull(), F.struct(item(x, x["mass"]).alias("open"), out.alias("done")))
                .when(gains & (c["size"] - c["mass"] <= x["mass"]), result(item(x, x["mass"] - up), settled(c, 1)))
                .when(gains, result(item(c, c["mass"] + up), settled(x, 0)))
                .when(c["mass"] <= x["size"] - x["mass"], result(item(x, x["mass"] + down), settled(c, 0)))
                .otherwise(result(item(c, c["mass"] - down), settled(x, 1))))

    done = F.expr(f"cast(array() as array<struct<id: {id_type}, size: bigint, copies: int>>)")
    return lambda items: F.aggregate(items, F.struct(nothing.alias("open"), done.alias("done")), step)


def mix(rows: DataFrame, id_col: str, source_col: str, size: Column, content: Column, seed: int = 0,
        weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies.

    ``size`` is the row's size (long, null counts as 0), ``content`` any hash that tells rows
    apart. Rows of size 0 take no part in the rounding; they are copied as often as the whole
    part says. Null ids and sources are values like others; equal rows are interchangeable.
    An empty table gives no rows. Other columns are ignored.
    """
    rows = rows.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_s"),
                       F.coalesce(size, F.lit(0)).cast("long").alias("_size"),
                       F.xxhash64(F.col(id_col), content, F.lit(seed)).alias("_h"))
    rows = staged(rows, "mix-rows")
    id_type = rows.schema["_id"].dataType.simpleString()
    sources = staged(source_targets(rows, weights, share, most), "mix-targets")
    base = F.floor("_ratio").cast("int")
    x = (rows.join(sources.withColumnRenamed("_s", "_t"), F.col("_s").eqNullSafe(F.col("_t")))
         .withColumn("_base", base).withColumn("_mass", (F.col("_ratio") - base) * F.col("_size")))
    whole = (F.col("_mass") <= 0) | (F.col("_size") == 0)
    done = x.where(whole).select("_s", F.col("_id").alias("id"), F.col("_size").alias("size"),
                                 F.col("_base").alias("copies"))
    leaves = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(LEAF))).cast("long")
    level = x.where(~whole).select(
        "_s", F.pmod("_h", leaves).alias("_block"),
        F.struct(F.col("_size").alias("size"), F.col("_h").alias("h"), F.col("_id").alias("id"),
                 F.col("_mass").alias("mass"), F.col("_base").alias("base")).alias("_item"))
    most_rows = sources.agg(F.max("_n")).first()[0] or 0
    blocks, depth = max(1, -(-most_rows // LEAF)), 0
    while True:
        fold = _meet(seed + depth, id_type)
        met = level.groupBy("_s", "_block").agg(F.sort_array(F.collect_list("_item"), asc=False).alias("_items")).select(
            "_s", "_block", fold(F.col("_items")).alias("_f"))
        met = staged(met.select("_s", "_block", F.col("_f.open").alias("_open"), F.col("_f.done").alias("_done")),
                     f"mix-level{depth}")
        done = done.unionByName(met.select("_s", F.explode("_done").alias("_d")).select("_s", "_d.*"))
        open_ = met.where(F.col("_open").isNotNull())
        if blocks == 1:
            break
        level = open_.select("_s", F.call_function("div", F.col("_block"), F.lit(FAN_IN)).alias("_block"),
                             F.col("_open").alias("_item"))
        blocks, depth = -(-blocks // FAN_IN), depth + 1
    nearer = F.col("_open.base") + F.when(F.col("_open.mass") * 2 >= F.col("_open.size"), 1).otherwise(0)
    done = done.unionByName(open_.select("_s", F.col("_open.id").alias("id"), F.col("_open.size").alias("size"),
                                         nearer.cast("int").alias("copies")))
    targets = sources.select(F.col("_s").alias("_t"), "source_size", "target")
    return done.join(targets, F.col("_s").eqNullSafe(F.col("_t"))).select(
        F.col("id").alias(id_col), F.col("_s").alias(source_col), "size", "source_size", "target", "copies")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                  **how) -> DataFrame:
    """``mix`` with the number of words of the whole text as size."""
    return mix(docs, id_col, source_col, n_words(F.col(text_col)), F.xxhash64(text_or_empty(F.col(text_col))), **how)


def apply_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
              **how) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as ``mix_documents`` says, all columns.

    Rows that share id, source and size get the copies of their key dealt out one by one.
    """
    size = n_words(F.col(text_col))
    dealt = (mix_documents(docs, id_col, source_col, text_col, **how)
             .groupBy(F.col(id_col).alias("_i"), F.col(source_col).alias("_s"), F.col("size").alias("_z"))
             .agg(F.count(F.lit(1)).alias("_rows"), F.min("copies").alias("_least"),
                  F.sum("copies").alias("_copies")))
    dealt = staged(dealt, "mix-dealt")
    keyed = docs.withColumn("__z", size).join(
        dealt, F.col(id_col).eqNullSafe(F.col("_i")) & F.col(source_col).eqNullSafe(F.col("_s"))
        & (F.col("__z") == F.col("_z")))
    single = keyed.where("_rows = 1").withColumn("__c", F.col("_copies"))
    # of the rows of one key, those first in order take what exceeds the least number of copies
    nth = F.row_number().over(Window.partitionBy("_i", "_s", "_z").orderBy(F.xxhash64(F.col(text_col))))
    extra = F.col("_copies") - F.col("_rows") * F.col("_least")
    many = keyed.where("_rows > 1").withColumn("__n", nth).withColumn(
        "__c", F.col("_least") + F.when(F.col("__n") <= extra, 1).otherwise(0)).drop("__n")
    out = single.unionByName(many).withColumn("__e", F.explode(F.sequence(F.lit(1), F.greatest(F.col("__c"), F.lit(1)))))
    return out.where("__c > 0").select(*[F.col(c) for c in docs.columns])
