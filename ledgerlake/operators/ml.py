"""Clustering and anomaly detection over many rows.

* k-means: Spark ML ``KMeans`` on z-scored, mean-imputed columns.
* Isolation forest (Liu, Ting & Zhou, 2008), written from the paper:
  1. sampling — rows equal in all columns are one point with a weight. A point
     joins tree t by the rank −ln(1 − u)/m, u from xxhash64(seed, t, values) and m
     its rows: the order in which draws without replacement meet new points.
     Each tree keeps its ψ points of least rank, cut to ψ in every task before
     the exchange. The draw depends only on (seed, tree, values, m): any
     partitioning or retry gives the same forest;
  2. growing — ``groupBy(tree).applyInPandas``: ≤ ψ points per group, trees grow
     in parallel; a tree is at most 2ψ−1 nodes, so the forest is bounded by
     T·(2ψ−1) rows and is broadcast for scoring;
  3. scoring — ``mapInArrow`` walks the trees over an Arrow batch of rows with
     NumPy, one level a step; the anomaly cut-off is the exact (1 − contamination)
     quantile of the scores, selected distributed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions.quantiles import exact_quantiles


def _scaled(df: DataFrame, columns, aggs=()):
    """A function that mean-imputes and z-scores (population std) the columns of a frame by ``df``'s statistics, and
    the row of ``aggs`` from the same ONE aggregate pass.

    Imputed values sit on the mean, so the population std of the imputed column
    is std_pop(non-NULL) · sqrt(count / n); a zero std divides by 1.
    """
    stats = [F.count(F.lit(1)).alias("_n"), *aggs]
    for c in columns:
        stats += [F.avg(c).alias(f"_mu_{c}"), F.stddev_pop(c).alias(f"_sd_{c}"), F.count(c).alias(f"_k_{c}")]
    st = df.agg(*stats).first()  # one row of 3k + 1 numbers

    def scale(frame: DataFrame) -> DataFrame:
        new = {}
        for c in columns:
            n, k = st["_n"], st[f"_k_{c}"]
            sd = (st[f"_sd_{c}"] or 0.0) * math.sqrt(k / n) if n else 0.0
            mu = F.lit(st[f"_mu_{c}"] if st[f"_mu_{c}"] is not None else 0.0).cast("double")
            new[c] = (F.coalesce(F.col(c), mu) - mu) / F.lit(float(sd) if sd else 1.0)
        return frame.withColumns(new)
    return scale, st


def prepare(df: DataFrame, columns, id_col: str = "row_id", originals: bool = False) -> DataFrame:
    """Mean-imputed, z-scored feature columns beside the id."""
    scale, _ = _scaled(df, columns)
    # the values before scaling, beside the scaled ones: ids may repeat, so no later join could find them
    kept = {f"_o_{c}": F.col(c) for c in columns} if originals else {}
    out = scale(df.withColumns(kept))
    return out.select(id_col, *columns, *kept)


# ---------------------------------------------------------------- A5–A7
def kmeans(df: DataFrame, columns, k: int = 3, seed: int = 42, id_col: str = "row_id"):
    """A5: cluster labels on the scaled columns. Returns (labelled frame, model); with fewer than k rows every cluster is NULL and the model None."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    scaled = prepare(df, columns, id_col, originals=True)
    if scaled.limit(k).count() < k:
        return scaled.withColumn("cluster", F.lit(None).cast("int")), None
    va = VectorAssembler(inputCols=list(columns), outputCol="features")
    feats = va.transform(scaled)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(feats)
    return model.transform(feats), model


def cluster_profile(labelled: DataFrame, columns) -> DataFrame:
    """Size, share %, centroid (scaled space), mean and sample std of the original values per cluster."""
    g = labelled.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"),
        F.array(*[F.avg(c) for c in columns]).alias("centroid"),
        *[F.avg(f"_o_{c}").alias(f"mean_{c}") for c in columns],
        *[F.stddev_samp(f"_o_{c}").alias(f"std_{c}") for c in columns])
    # k rows: the window over all of them is tiny
    return g.withColumn("percentage", F.col("size") / F.sum("size").over(Window.partitionBy()) * 100)


#: Clusters whose statistics may become literals of a plan.
MOST_CLUSTERS = 256


def silhouette(labelled: DataFrame, columns=None) -> float | None:
    """Mean silhouette in its squared-Euclidean form; None with fewer than two clusters.

    The mean squared distance of x to a cluster of n rows with sum s and sum of squared norms q is
    ``|x|^2 + q/n - 2 x.s/n``, so one row of statistics per cluster gives each row's silhouette in one more
    pass. A row alone in its cluster counts 0; rows without a cluster are left out.
    """
    columns = list(columns or [c[3:] for c in labelled.columns if c.startswith("_o_")])
    rows = labelled.where(F.col("cluster").isNotNull())
    norm = sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0))
    stats = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(norm).alias("q"),
                                        F.array(*[F.sum(c) for c in columns]).alias("s")).limit(MOST_CLUSTERS + 1).collect()
    if len(stats) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")
    if len(stats) < 2:
        return None

    def total(k):  # squared distances to all rows of a cluster, added up
        return norm * k["n"] + k["q"] - 2 * sum((F.col(c) * v for c, v in zip(columns, k["s"], strict=True)), F.lit(0.0))
    own = F.coalesce(*[F.when(F.col("cluster") == k["cluster"], F.lit(0.0) if k["n"] == 1 else total(k) / (k["n"] - 1)) for k in stats])
    alone = F.col("cluster").isin([k["cluster"] for k in stats if k["n"] == 1])
    other = F.array_min(F.array(*[F.when(F.col("cluster") != k["cluster"], total(k) / k["n"]) for k in stats]))
    s = F.when(alone, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(other - own, F.greatest(own, other)), F.lit(0.0)))
    return float(rows.agg(F.avg(s)).first()[0])


def nearest_centre_check(labelled: DataFrame, model, columns) -> DataFrame:
    """One row: records, clusters, and whether every row lies in the cluster of its nearest centre."""
    far = [sum(((F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(columns, centre, strict=True)), F.lit(0.0))
           for centre in model.clusterCenters()]
    own = F.element_at(F.array(*far), F.col("cluster") + 1)
    return labelled.agg(F.count(F.lit(1)).alias("total_records"), F.countDistinct("cluster").alias("n_clusters"),
                        F.every(own <= F.array_min(F.array(*far)) * (1 + 1e-9) + 1e-12).alias("nearest"))


# ---------------------------------------------------------------- A8, A9
def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("split", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.LongType())])


def _grow(features, seed: int, psi: int):
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_rank", "_row"])
        tree = int(pdf["tree"].iloc[0])
        X, weight = pdf[features].to_numpy(dtype=float), pdf["_m"].to_numpy()
        rng = np.random.default_rng([seed, tree])
        nodes = []

        def build(idx, depth):
            node = len(nodes)
            nodes.append(None)
            sub, size = X[idx], int(weight[idx].sum())
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            usable = np.nonzero(hi > lo)[0]
            if depth >= max_depth or usable.size == 0:
                nodes[node] = (tree, node, -1, 0.0, -1, -1, size)
                return node
            f = int(rng.choice(usable))
            s = float(rng.uniform(lo[f], hi[f]))
            left = build(idx[sub[:, f] < s], depth + 1) if (sub[:, f] < s).any() else -1
            if left < 0:  # the draw fell on the lowest value
                s = float(np.nextafter(lo[f], hi[f]))
                left = build(idx[sub[:, f] < s], depth + 1)
            right = build(idx[sub[:, f] >= s], depth + 1)
            nodes[node] = (tree, node, f, s, left, right, size)
            return node

        build(np.arange(len(X)), 0)
        return pd.DataFrame(nodes, columns=[f.name for f in NODE_SCHEMA.fields])
    return grow


def _score(features, forest: pd.DataFrame, names):
    """Mean share of the usual path length over all trees, for Arrow batches whose last columns are the features.

    Each tree is laid out as a complete one: the children of node i are 2i + 1 and 2i + 2, and a leaf above the
    lowest level hands its value down to all places below it. So a row's leaf is met in a fixed number of steps, and a
    step over a batch is three ``take``s and a comparison.
    """
    trees = sorted(forest["tree"].unique())
    usual = np.maximum(corr_of_root(forest, {t: i for i, t in enumerate(trees)}), 1e-300)
    by_tree = {t: {n.node: n for n in g.itertuples()} for t, g in forest.groupby("tree")}

    def deepest(nodes, node=0):
        n = nodes[node]
        return 0 if n.feature < 0 else 1 + max(deepest(nodes, n.left), deepest(nodes, n.right))
    laid = []
    for t, u in zip(trees, usual, strict=True):
        nodes = by_tree[t]
        depth = deepest(nodes)
        inner = 2 ** depth - 1
        feat, split, share = np.zeros(inner, dtype=np.intp), np.zeros(inner), np.zeros(inner + 1)

        def place(node, at, level):
            n = nodes[node]  # noqa: B023
            if n.feature >= 0:
                feat[at], split[at] = n.feature, n.split  # noqa: B023
                place(n.left, 2 * at + 1, level + 1)
                place(n.right, 2 * at + 2, level + 1)
            else:
                below = depth - level  # noqa: B023
                first = (at + 1) * 2 ** below - 1 - inner  # noqa: B023
                share[first:first + 2 ** below] = (level + _c(float(n.size))) / u  # noqa: B023
        place(0, 0, 0)
        laid.append((depth, inner, feat, split, share))

    def score(batches):
        for batch in batches:
            b = batch.num_rows
            if not b:
                continue
            k = batch.num_columns - len(features)
            x = np.concatenate([batch.column(k + i).to_numpy(zero_copy_only=False) for i in range(len(features))])
            rows, total = np.arange(b), np.zeros(b)
            for depth, inner, feat, split, share in laid:
                node, start = np.zeros(b, dtype=np.intp), feat * b
                for _ in range(depth):
                    at = start.take(node)
                    at += rows
                    left = x.take(at) < split.take(node)
                    node += node
                    node += 2
                    node -= left
                node -= inner
                total += share.take(node)
            found = pa.array(np.power(2.0, -(total / len(laid))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], found], names=names)
    return score


def corr_of_root(forest: pd.DataFrame, pos: dict) -> np.ndarray:
    """Average path length for the number of rows that each tree stands for."""
    roots = forest[forest["node"] == 0]
    out = np.zeros(len(pos))
    out[roots["tree"].map(pos).to_numpy()] = [_c(float(x)) for x in roots["size"].to_numpy()]
    return out


def isolation_forest(df: DataFrame, columns, id_col: str = "row_id", n_trees: int = 100, psi: int = 256,
                     contamination: float = 0.1, seed: int = 42, min_rows: int = 10,
                     partitions: int | None = None) -> DataFrame:
    """Each row's id and values, its anomaly score (higher = more isolated) and the contamination flag.

    Rows equal in all columns are one point with a weight, so that a pile of them fills no tree and no task: a tree
    draws rows until it has ψ different points, and a leaf counts the rows it stands for. Without equal rows this
    is the published algorithm. Under ``min_rows`` rows there are no scores and no flags.
    ``partitions`` deals the rows out anew before they are scored, for input in few partitions.
    """
    feats = [f"_f{i}" for i in range(len(columns))]
    own = df.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(columns)],
                    *[F.col(c).cast("double").alias(f) for c, f in zip(columns, feats, strict=True)])
    row = F.xxhash64(*feats)
    aggs = [F.count(F.lit(1)).alias("n"), F.approx_count_distinct(row).alias("points")]
    scaled, st = _scaled(own, feats, aggs)
    out = [F.col("_id").alias(id_col), *[F.col(f"_o{i}").alias(c) for i, c in enumerate(columns)]]
    if st["n"] < min_rows:
        return own.select(*out, F.lit(None).cast("double").alias("anomaly_score"), F.lit(False).alias("is_anomaly"))
    # A point of m rows is drawn as soon as the first of them: its rank is the least of m exponential variates.
    # Points beyond the cut are not needed: about 3 psi different ones are within it.
    share = 3.0 * psi / max(st["points"], 1)
    cut = F.lit(-math.log1p(-share) if share < 0.9 else math.inf)
    points = own.groupBy(*feats).agg(F.count(F.lit(1)).alias("_m")).withColumn("_row", row)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "tree", "_row"), 11) * F.lit(2.0 ** -53)
    rank = -F.log1p(-u) / F.col("_m")
    # no rank is below u/m, so one comparison rules out almost all pairs of a point and a tree before any logarithm
    drawn = points.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))).where(
        u <= cut * F.lit(1 + 1e-9) * F.col("_m")).withColumn("_rank", rank).where(F.col("_rank") <= cut)
    first = F.row_number().over(Window.partitionBy("tree").orderBy("_rank", "_row"))  # cut to psi in every task before the exchange
    drawn = drawn.withColumn("_n", first).where(F.col("_n") <= psi)
    forest = scaled(drawn.select("tree", "_m", "_row", "_rank", *feats)).groupBy("tree").applyInPandas(_grow(feats, seed, psi), NODE_SCHEMA)
    # the forest is ≤ n_trees·(2ψ−1) rows: a proven bound, collected once and shipped to the scorers
    forest_pd = forest.toPandas()
    ids = df.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(columns)])
    if partitions:
        ids = ids.repartition(partitions)
    to_score = scaled(ids.select("*", *[F.col(f"_o{i}").cast("double").alias(f) for i, f in enumerate(feats)]))
    schema = T.StructType([*ids.schema.fields, T.StructField("_s", T.DoubleType())])
    # scored once: the cut-off quantile and the output both read this copy
    scores = to_score.mapInArrow(_score(feats, forest_pd, schema.names), schema).checkpoint(eager=True)
    # one group for all rows; its key is a column, so that its bracket meets the rows by an equi-join
    one = scores.select(F.isnull("_s").alias("_k"), "_s")
    cutoff = exact_quantiles(one, ["_k"], "_s", [1.0 - contamination], ["cutoff"]).first()["cutoff"]
    return scores.select(*out, F.col("_s").alias("anomaly_score"), (F.col("_s") > F.lit(cutoff)).alias("is_anomaly"))


def anomalies(flagged: DataFrame) -> DataFrame:
    """The flagged rows with their ids, values and scores."""
    return flagged.where("is_anomaly").drop("is_anomaly")


def forest_check(flagged: DataFrame, contamination: float = 0.1) -> DataFrame:
    """One row: records, and whether scores lie within (0, 1), the flagged share keeps to the contamination and
    every flagged score is above all others."""
    a = F.col("is_anomaly")
    return flagged.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.coalesce(F.every((F.col("anomaly_score") > 0) & (F.col("anomaly_score") < 1)), F.lit(True)).alias("scores_in_range"),
        (F.count_if(a) <= F.count(F.lit(1)) * contamination + 1).alias("share_kept"),
        F.coalesce(F.min(F.when(a, F.col("anomaly_score"))) > F.max(F.when(~a, F.col("anomaly_score"))), F.lit(True)).alias("flagged_on_top"))


def anomaly_rate(flagged: DataFrame) -> DataFrame:
    """Anomalies, records and their ratio."""
    return flagged.agg(F.count_if("is_anomaly").alias("total_anomalies"), F.count(F.lit(1)).alias("total_records")
                       ).withColumn("anomaly_rate", F.try_divide("total_anomalies", "total_records"))
