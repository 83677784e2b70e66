"""Quality rules: robust multivariate outliers by the minimum covariance determinant.

Every document has a vector of transformed statistics. For each language and source the
location and scatter of the ``half`` of its rows with the smallest covariance determinant are
estimated (fast MCD; that half, (n + d + 1) / 2 rows, bears the largest share of junk). Every group goes the same way,
whatever its size:

1. rows of a group with one vector are a point with a weight; about ``SAMPLE`` rows are drawn from the points,
   copies by copies, so that a pile of equal rows neither fills nor empties the draw (a group of up to ``SAMPLE`` rows
   is drawn whole);
2. many small random starts take two concentration steps on the draw, and the ``GOOD`` best of them go on;
3. each of these is concentrated on all rows of the group by distributed steps until its determinant stops
   falling; starts that have met are one; the least determinant gives the estimate.

A step measures all points, finds the group's h-th distance from counts on a fixed logarithmic grid, and
sums the moments of the nearer rows. A document whose Mahalanobis distance from its group's
estimate is beyond the cut-off is rejected.

Scatter has a floor in each direction (``FLOORS``), as in the regularised estimator: where more
than half of a group share a value (no symbols, no repeated lines) the determinant would be zero
and any other value infinitely far. Groups with fewer than ``least`` rows are pooled: first all
small sources of a language, then all small languages. What is left of these is judged like any group: with few
rows the estimate rests on most of them, so only a row far beyond the floors of the rest is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import discard, small_batches, staged, text_or_empty, uniform
from ledgerlake.llm.textstats import basic

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DIMS = 4
FLOORS = (0.08, 0.03, 0.08, 0.08)
CUTOFF = 90.0        # squared distance: far beyond Gaussian tails, since clean texts have heavy tails and must stay
SAMPLE, STARTS, GOOD = 1500, 200, 10
ROUNDS = 100          # far more than the steps that a determinant takes to stop falling
GRID = 16            # cells of the distance grid in a factor of two


def stats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and the five counts of the whole text (null text: none)."""
    rows = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], text_or_empty(F.col(text_col)).alias("_t"))
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            out = [basic(t) for t in batch.column(len(keep)).to_pylist()]
            columns = [pa.array([x[i] for x in out], pa.int64()) for i in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], *columns],
                                             names=[*(f"_{i}" for i in range(len(keep))), *STATS])

    fields = [f"_{i} {rows.schema[f'_{i}'].dataType.simpleString()}" for i in range(len(keep))]
    out = rows.mapInArrow(run, ", ".join(fields + [f"{c} bigint" for c in STATS]))
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], *STATS)


def vector() -> list:
    """Transformed statistics: log mean word length, root of the symbol share, repeated lines and words."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return [F.log(chars / words), F.sqrt(F.col("n_symbols") / chars),
            F.log1p(F.col("n_dup_lines") / F.lit(4.0)), F.sqrt(F.col("n_repeat_words") / words)]


def _pooled(rows: DataFrame, least: int) -> DataFrame:
    """Add the group (language, source) that judges a row; null marks a pooled part."""
    counts = staged(rows.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("_c")), "mcd-counts")
    small = counts.where(F.col("_c") < least)
    langs = small.groupBy("_lang").agg(F.sum("_c").alias("_lc")).withColumnRenamed("_lang", "_l")
    group = counts.join(langs, F.col("_lang").eqNullSafe(F.col("_l")), "left").select(
        F.col("_lang").alias("_gl"), F.col("_source").alias("_gs"),
        F.when(F.col("_c") >= least, F.struct(F.lit(0).alias("level"), F.col("_lang").alias("lang"), F.col("_source").alias("source")))
        .when(F.col("_lc") >= least, F.struct(F.lit(1).alias("level"), F.col("_lang").alias("lang"), F.lit(None).cast("string").alias("source")))
        .otherwise(F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"))).alias("_group"))
    group = staged(group.withColumn("_group", F.to_json("_group", {"ignoreNullFields": "false"})), "mcd-groups")
    return rows.join(group, F.col("_lang").eqNullSafe(F.col("_gl")) & F.col("_source").eqNullSafe(F.col("_gs"))).drop("_gl", "_gs")


def half(n: int) -> int:
    """Rows that an estimate of ``n`` rows rests on: with (n + d + 1) / 2 it holds while clean rows are the majority."""
    return min(n, (n + DIMS + 1) // 2)


def _floor_diag():
    import numpy as np
    return np.diag(np.square(FLOORS))


def _moments(x, weight, used):
    """Mean and floored scatter of the first rows by ``used`` that hold half the weight, the last of them in part."""
    import numpy as np
    left = half(int(weight.sum()))
    w = np.clip(left - (np.cumsum(weight[used]) - weight[used]), 0, weight[used])
    mean = w @ x[used] / left
    off = x[used] - mean
    return mean, (off * w[:, None]).T @ off / left + _floor_diag()


def good_starts(x, weight, seed: int):
    """The best (determinant, mean, scatter) of many random starts after two concentration steps on weighted rows."""
    import numpy as np
    rng, found = np.random.default_rng(seed), []
    share = weight / weight.sum()
    for _ in range(STARTS):
        part = x[rng.choice(len(x), DIMS + 1, p=share)]
        mean = part.mean(axis=0)
        cov = (part - mean).T @ (part - mean) / len(part) + _floor_diag()
        for _ in range(2):
            off = x - mean
            mean, cov = _moments(x, weight, np.argsort(np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off), kind="stable"))
        found.append((np.linalg.slogdet(cov)[1], mean, cov))
    found.sort(key=lambda f: f[0])
    return found[:GOOD]


ESTIMATE = "_group string, _start int, _det double, _mean array<double>, _inv array<double>"
X = [f"x{i}" for i in range(DIMS)]


def _estimate(group, start, det, mean, cov):
    import numpy as np
    return group, start, float(det), mean.tolist(), np.linalg.inv(cov).ravel().tolist()


def _first_estimates(points: DataFrame, sizes: DataFrame, seed: int) -> DataFrame:
    """The good starts of each group, from about ``SAMPLE`` of its rows."""
    share = SAMPLE / F.col("_size")
    # Of m equal rows as many are drawn as of the first m arrivals, in order of time, fall within the share: the gaps
    # between the arrivals are exponential variates over the number still to come.
    gap = lambda j: -F.log1p(-uniform(F.lit(seed), j, F.col("_group"), *X)) / (F.col("_m") - j + 1)
    within = -F.log1p(-share)
    many = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_m"), F.lit(4 * SAMPLE)).cast("int")),
                       F.struct(F.lit(0.0).alias("at"), F.lit(0).cast("long").alias("n")),
                       lambda s, j: F.struct((s["at"] + gap(j)).alias("at"), (s["n"] + (s["at"] + gap(j) <= within).cast("long")).alias("n")),
                       lambda s: s["n"])
    drawn = points.join(sizes, "_group").withColumn("_w", F.when(share >= 1, F.col("_m")).otherwise(many)).where("_w > 0")

    def run(key, part):
        import numpy as np
        import pandas as pd
        x, weight = part[X].to_numpy(float), part["_w"].to_numpy(float)
        by = np.lexsort(x.T)  # the same rows give the same estimate in any order
        found = good_starts(x[by], weight[by], seed)
        return pd.DataFrame([_estimate(key[0], k, *f) for k, f in enumerate(found)], columns=["_group", "_start", "_det", "_mean", "_inv"])

    return drawn.select("_group", "_w", *X).groupBy("_group").applyInPandas(run, ESTIMATE)


def _distance():
    off = [F.col(f"x{i}") - F.col("_mean")[i] for i in range(DIMS)]
    total = F.lit(0.0)
    for i in range(DIMS):
        for j in range(DIMS):
            total = total + off[i] * off[j] * F.col("_inv")[i * DIMS + j]
    return F.greatest(total, F.lit(0.0))


def _step(points: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step of each start over all rows: the moments of the ``half`` nearest to the estimate."""
    near = points.join(estimates, "_group").withColumn(
        "_cell", F.floor(F.log2(_distance() + F.lit(2.0 ** -20)) * GRID).cast("int"))
    pairs = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
    sums = [F.sum(F.col("_m") * F.col(f"x{i}")).alias(f"s{i}") for i in range(DIMS)] + [
        F.sum(F.col("_m") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in pairs]
    # moments by cell (a few hundred cells at most), so the rows are read once
    cells = near.groupBy("_group", "_start", "_cell").agg(F.sum("_m").alias("n"), *sums)
    names = ["n", *[f"s{i}" for i in range(DIMS)], *[f"s{i}_{j}" for i, j in pairs]]

    def run(key, part):
        import numpy as np
        import pandas as pd
        out = []
        for start, own in part.sort_values(["_start", "_cell"]).groupby("_start"):
            reach = np.cumsum(own["n"].to_numpy())
            used = int(np.searchsorted(reach, half(int(reach[-1])))) + 1
            n, *rest = own[names].to_numpy(float)[:used].sum(axis=0)
            mean = np.array(rest[:DIMS]) / n
            cov = np.zeros((DIMS, DIMS))
            cov[np.triu_indices(DIMS)] = np.array(rest[DIMS:]) / n
            cov = cov + np.triu(cov, 1).T - np.outer(mean, mean) + _floor_diag()
            out.append(_estimate(key[0], start, np.linalg.slogdet(cov)[1], mean, cov))
        return pd.DataFrame(out, columns=["_group", "_start", "_det", "_mean", "_inv"])

    return cells.groupBy("_group").applyInPandas(run, ESTIMATE)


def _concentrated(points: DataFrame, sizes: DataFrame, seed: int) -> DataFrame:
    """(_group, _mean, _inv) of the least determinant that any good start comes to."""
    now = staged(_first_estimates(points, sizes, seed).withColumn("_open", F.lit(True)), "mcd-start")
    for k in range(ROUNDS):
        new = _step(points, now.where("_open").select("_group", "_start", "_mean", "_inv")).select(
            "_group", "_start", *[F.col(c).alias(f"_new{c}") for c in ("_det", "_mean", "_inv")])
        # the first distributed determinant is of all rows, so it replaces that of the draw
        first = F.lit(k == 0)
        falls = F.col("_new_det").isNotNull() & (first | (F.col("_new_det") < F.col("_det") - 1e-7))
        after = now.join(new, ["_group", "_start"], "left").select("_group", "_start", *[
            F.when(falls, F.col(f"_new{c}")).otherwise(F.col(c)).alias(c) for c in ("_det", "_mean", "_inv")], falls.alias("_open"))
        met = F.row_number().over(Window.partitionBy("_group", F.round("_det", 6)).orderBy(F.desc("_open"), "_start"))
        after = staged(after.withColumn("_met", met).where("_met = 1").drop("_met"), "mcd-step")
        discard(now)
        now = after
        if not now.where("_open").limit(1).count():
            break
    return now.groupBy("_group").agg(F.min_by(F.struct("_mean", "_inv"), F.struct("_det", "_start")).alias("_e")).select("_group", "_e.*")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source", least: int = 60, cutoff: float = CUTOFF, seed: int = 0) -> DataFrame:
    """One row per document: id, the five counts, base_failed, distance (squared), kept.

    Base rules: fewer than 20 words, or over 30 in 100 words inside repeated windows. The
    estimates rest on the documents that pass them, repeated ones as often as they stand there. Null text has no words and fails; null
    language and source are groups of their own; ids may be null or repeated. An empty table
    gives no rows. Other columns are ignored.
    """
    named = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"),
                        F.col(source_col).cast("string").alias("_source"), F.col(text_col).alias("_text"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = stats(named, ["_id", "_lang", "_source"], "_text").withColumn("base_failed", failed)
    rows = rows.select("*", *[x.alias(f"x{i}") for i, x in enumerate(vector())])
    rows = staged(rows, "mcd-rows")
    good = staged(_pooled(rows.where(~F.col("base_failed")), least), "mcd-grouped")
    points = staged(good.groupBy("_group", *X).agg(F.count(F.lit(1)).alias("_m")), "mcd-points")
    sizes = staged(points.groupBy("_group").agg(F.sum("_m").alias("_size")), "mcd-sizes")
    estimates = staged(_concentrated(points, sizes, seed), "mcd-estimates")
    far = good.join(estimates, "_group").withColumn("distance", _distance())
    out = ["_id", *STATS, "base_failed", "distance"]
    bad = rows.where("base_failed").withColumn("distance", F.lit(None).cast("double"))
    return far.select(*out).unionByName(bad.select(*out)).select(
        F.col("_id").alias(id_col), *STATS, "base_failed", "distance",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(False))).alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns. Rows that share an id stay if one of them does."""
    kept = judge(docs, id_col, **how).where("kept").select(F.col(id_col).alias("__keep"))
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__keep"]), "left_semi")
