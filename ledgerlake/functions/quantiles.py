"""Exact quantiles and ranks without holding a group, or all its values, in one place.

``percentile`` (Spark's exact aggregate) buffers every distinct value of a group in one task: fine for
groups that are bounded by design (one entity's months), wrong for a column or a segment that may hold a
third of all rows. ``exact_quantiles`` selects instead:

1. **Sketch.** One aggregate per key merges quantile summaries (``percentile_approx`` on a fixed grid). They
   bracket each needed rank: a summary is off by at most 1/ACCURACY of the rows, a bracket is a grid cell
   (20 times that) wider on both sides.
2. **Narrow.** While a bracket may hold more than ``KEEP`` rows, a second summary of the rows inside it
   narrows it again, 1/300 a time.
3. **Count.** One aggregate counts the rows below each bracket and the rows inside it by value, so that
   heavy ties are one row. Running counts over these few rows give the values at the needed ranks,
   and interpolation is linear like NumPy's.

All exchanges carry partial aggregates; no data-sized shuffle, sort or write. A rank that its bracket should
miss (the summaries' bound says none does) is selected again without a bracket.

``ordered_moments`` gives the regression moments of a value against its row's rank, from one range sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID, ACCURACY = 1000, 20_000
#: Rows that a bracket may hold at the last step, and keys up to which their brackets are broadcast.
KEEP, FEW_KEYS = 1_000_000, 20_000


def _beside(v: DataFrame, brackets: DataFrame, keys, few: bool) -> DataFrame:
    """Rows with their key's brackets: by broadcast for a counted few keys, else by the planner's join."""
    b = brackets.select(*[F.col(k).alias(f"{k}b") for k in keys], *[c for c in brackets.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}b"))
    return v.join(F.broadcast(b) if few else b, same).drop(*[f"{k}b" for k in keys])


def _cell(rank: Column, n: Column, grid: Column, up: bool) -> Column:
    """The grid value one cell beyond a rank's share; open at the ends."""
    share = rank.cast("double") / n * GRID
    i = (F.ceil(share) + 1 if up else F.floor(share) - 1).cast("int")
    edge = i >= GRID if up else i <= 0
    return F.when(edge, F.lit(math.inf if up else -math.inf)).otherwise(F.try_element_at(grid, i + 1))


def _inside(i: int) -> Column:
    return (F.col("_v") >= F.col(f"_lo{i}")) & (F.col("_v") <= F.col(f"_hi{i}"))


def _brackets(v: DataFrame, keys, n_probs: int, ranks) -> tuple[DataFrame, bool]:
    """Per key its row count and, for each probability, values that enclose the needed ranks."""
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    rough = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", grid, ACCURACY).alias("_g"))
    rough = rough.select(*keys, "_n", *[c for i in range(n_probs) for c in (
        _cell(ranks(i)[0], F.col("_n"), F.col("_g"), False).alias(f"_lo{i}"),
        _cell(ranks(i)[1], F.col("_n"), F.col("_g"), True).alias(f"_hi{i}"))])
    rough = rough.checkpoint()  # one row per key
    count, most = rough.agg(F.count(F.lit(1)), F.coalesce(F.max("_n"), F.lit(0))).first()
    few, held = count <= FEW_KEYS, most * 4 / GRID
    while held > KEEP:
        both = _beside(v, rough, keys, few)
        finer = both.groupBy(*keys).agg(F.first("_n").alias("_n"), *[c for i in range(n_probs) for c in (
            F.first(f"_lo{i}").alias(f"_lo{i}"), F.first(f"_hi{i}").alias(f"_hi{i}"),
            F.count_if(F.col("_v") < F.col(f"_lo{i}")).alias(f"_b{i}"), F.count_if(_inside(i)).alias(f"_c{i}"),
            F.percentile_approx(F.when(_inside(i), F.col("_v")), grid, ACCURACY).alias(f"_g{i}"))])
        rough = finer.select(*keys, "_n", *[c for i in range(n_probs) for c in (
            F.greatest(f"_lo{i}", _cell(ranks(i)[0] - F.col(f"_b{i}"), F.col(f"_c{i}"), F.col(f"_g{i}"), False)).alias(f"_lo{i}"),
            F.least(f"_hi{i}", _cell(ranks(i)[1] - F.col(f"_b{i}"), F.col(f"_c{i}"), F.col(f"_g{i}"), True)).alias(f"_hi{i}"))]).checkpoint()
        held *= 4 / GRID
    return rough, few


def _select(v: DataFrame, brackets: DataFrame, keys, n_probs: int, ranks, few: bool) -> DataFrame:
    """Per key the values at both ranks of each probability."""
    both = _beside(v, brackets, keys, few)
    kept = F.lit(False)
    for i in range(n_probs):
        kept |= _inside(i)
    counted = both.groupBy(*keys, F.when(kept, F.col("_v")).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"), *[F.count_if(F.col("_v") < F.col(f"_lo{i}")).alias(f"_b{i}") for i in range(n_probs)])
    of_key = Window.partitionBy(*keys)
    counted = counted.select(*keys, "_v", "_c", *[F.sum(f"_b{i}").over(of_key).alias(f"_b{i}") for i in range(n_probs)])
    # NULL stands for the rows outside all brackets, which are in the counts below them already
    values = _beside(counted.where(F.col("_v").isNotNull()), brackets, keys, few)
    per = values.select(*keys, "_n", "_v", "_c", F.explode(F.array(*[F.when(_inside(i), F.struct(
        F.lit(i).alias("i"), F.col(f"_b{i}").alias("below"))) for i in range(n_probs)])).alias("_s")).where(F.col("_s").isNotNull())
    in_turn = Window.partitionBy(*keys, "_s.i").orderBy("_v")
    per = per.withColumn("_to", F.col("_s.below") + F.sum("_c").over(in_turn))
    at = lambda i, k: F.max(F.when((F.col("_s.i") == i) & (k >= F.col("_to") - F.col("_c")) & (k < F.col("_to")), F.col("_v")))
    return per.groupBy(*keys).agg(F.first("_n").alias("_n"), *[c for i in range(n_probs) for c in (
        at(i, ranks(i)[0]).alias(f"_at{i}"), at(i, ranks(i)[1]).alias(f"_up{i}"))])


def exact_quantiles(df: DataFrame, keys, value: str, probs, names=None,
                    num_partitions: int | None = None) -> DataFrame:
    """keys, n and one column per probability, interpolated linearly; NULL values are left out.

    ``num_partitions`` bounds the partitions of the result.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    names = names or [f"q{int(round(p * 1000)):03d}" for p in probs]
    ks = [f"_k{i}" for i in range(len(keys))]
    v = df.select(*[F.col(k).alias(a) for k, a in zip(keys, ks, strict=True)], F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull())

    def place(i):
        return (F.col("_n") - 1) * F.lit(probs[i])

    def ranks(i):
        return F.floor(place(i)), F.ceil(place(i))

    brackets, few = _brackets(v, ks, len(probs), ranks)
    found = _select(v, brackets, ks, len(probs), ranks, few).checkpoint()  # one row per key
    missed = F.lit(False)
    for i in range(len(probs)):
        missed |= F.col(f"_at{i}").isNull() | F.col(f"_up{i}").isNull()
    if found.where(missed).limit(1).count():
        whole = brackets.select(*ks, "_n", *[c for i in range(len(probs)) for c in (
            F.lit(-math.inf).alias(f"_lo{i}"), F.lit(math.inf).alias(f"_hi{i}"))])
        found = _select(v, whole, ks, len(probs), ranks, few)
    out = found.select(*[F.col(a).alias(k) for k, a in zip(keys, ks, strict=True)], F.col("_n").alias("n"), *[
        (F.col(f"_at{i}") + (F.col(f"_up{i}") - F.col(f"_at{i}")) * (place(i) - F.floor(place(i)))).alias(nm)
        for i, nm in enumerate(names)])
    return out.coalesce(num_partitions) if num_partitions else out


def ordered_moments(df: DataFrame, keys, order, value: str, num_partitions: int | None = None) -> DataFrame:
    """Moments of ``value`` against its row's 0-based rank within its key, ordered by ``order``.

    Columns: keys, ``n`` (rows), ``n_values`` (rows with a value), ``sxx``, ``sxy``, ``syy`` (centred sums over the latter),
    ``first`` and ``last`` value, ``lowest`` and ``highest`` of the first order column. Range partitioning on (keys, order) spreads a hot key over many tasks;
    runs of 8,192 sorted rows are summed where they lie, and a run's rank follows from the counts of the runs before
    it. Ties in ``order`` get distinct ranks. Nothing is written.
    """
    keys, order = list(keys), list(order)
    spark = df.sparkSession
    n_part = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (df.repartitionByRange(n_part, *keys, *order).sortWithinPartitions(*keys, *order)
            .withColumn("_id", F.monotonically_increasing_id()))  # partition, then place in it
    rows = rows.withColumn("_run", F.shiftright("_id", 13)).withColumn("_x", F.col("_id").bitwiseAND(8191).cast("double"))
    y = F.col(value).cast("double")
    x = F.when(y.isNotNull(), F.col("_x"))
    runs = rows.groupBy(*keys, "_run").agg(
        F.count(F.lit(1)).alias("_m"), F.count(y).alias("_k"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.min("_x").alias("_x0"),
        F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"), F.covar_pop(x, y).alias("_cxy"),
        F.min_by(value, "_x").alias("_first"), F.max_by(value, "_x").alias("_last"),
        F.min(order[0]).alias("_low"), F.max(order[0]).alias("_high"))
    of_key = Window.partitionBy(*keys)
    before = F.sum("_m").over(of_key.orderBy("_run")) - F.col("_m")
    runs = runs.withColumn("_mx", F.col("_mx") - F.col("_x0") + before)
    for c in ("x", "y"):  # each run's distance from the mean of its key
        mean = F.sum(F.col(f"_m{c}") * F.col("_k")).over(of_key) / F.nullif(F.sum("_k").over(of_key), F.lit(0))
        runs = runs.withColumn(f"_d{c}", F.col(f"_m{c}") - mean)
    total = lambda inner, a, b: F.sum(F.col("_k") * (F.col(inner) + F.col(a) * F.col(b)))
    return runs.groupBy(*keys).agg(
        F.sum("_m").alias("n"), F.sum("_k").alias("n_values"), total("_vx", "_dx", "_dx").alias("sxx"), total("_cxy", "_dx", "_dy").alias("sxy"),
        total("_vy", "_dy", "_dy").alias("syy"), F.min_by("_first", "_run").alias("first"), F.max_by("_last", "_run").alias("last"),
        F.min("_low").alias("lowest"), F.max("_high").alias("highest"))


def group_percentiles(df: DataFrame, keys, value: str, probs, names=None, extra=()) -> DataFrame:
    """Spark's exact ``percentile`` per group, for groups bounded by design.

    ``extra`` aggregates ride along in the same pass.
    """
    names = names or [f"q{int(round(p * 1000)):03d}" for p in probs]
    arr = F.percentile(F.col(value), F.array(*[F.lit(float(p)) for p in probs]))
    g = df.groupBy(*keys).agg(arr.alias("_q"), F.count(F.col(value)).alias("n"), *extra)
    extra_names = [e._jc.toString().split(" AS ")[-1].strip("`") for e in extra]
    return g.select(*keys, "n", *[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)], *extra_names)
