"""Queries A5–A9 (clusters, silhouette, isolation forest, anomaly rate): rows-only checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions.exprs import rnd
from ledgerlake.operators import ml as ML
from ledgerlake.plans.oracle_fixtures import R, with_fixtures
from ledgerlake.plans.registry import register
from ledgerlake.sources import fixtures as FX
from ledgerlake.sources.tables import Tables

COLS = ["x1", "x2", "x3", "x4"]


def _features(spark, d):
    return FX.features(Tables(spark, d))


@register("kmeans")
def kmeans(spark, d):
    lab, _ = ML.kmeans(_features(spark, d), COLS)
    return lab.select("row_id", "cluster")


@register("cluster_profile")
def cluster_profile(spark, d):
    f = _features(spark, d)
    lab, _ = ML.kmeans(f, COLS)
    p = ML.cluster_profile(lab, COLS)
    return p.select("cluster", "size", rnd("percentage", 2).alias("percentage"), "centroid",
                    *[rnd(f"mean_{c}", 6).alias(f"mean_{c}") for c in COLS],
                    *[rnd(f"std_{c}", 6).alias(f"std_{c}") for c in COLS])


@register("silhouette")
def silhouette(spark, d):
    f = _features(spark, d)
    lab, _ = ML.kmeans(f, COLS)
    s = ML.silhouette(lab) if lab is not None else None
    n = f.count()
    return spark.createDataFrame([(3, None if s is None else round(s, 4), n)],
                                 "n_clusters int, silhouette_score double, total_records long")


@register("kmeans_check", with_fixtures("""
SELECT count(*) AS total_records, 3 AS n_clusters, true AS nearest FROM features""", "features"))
def kmeans_check(spark, d):
    lab, model = ML.kmeans(_features(spark, d), COLS)
    c = ML.nearest_centre_check(lab, model, COLS)
    return c.select("total_records", F.col("n_clusters").cast("int").alias("n_clusters"), "nearest")


# Clusters by a fixed rule on a column, so that profile and silhouette can be held by value.
_RULE = "CASE WHEN x1 < 17 THEN 0 WHEN x1 < 34 THEN 1 ELSE 2 END"
_SCALED = "st AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) * sqrt(count({c}) / count(*)) AS s_{c}" for c in COLS) + f""" FROM features),
z AS (SELECT row_number() OVER () AS i, {_RULE} AS c, """ + ", ".join(
    f"(coalesce({c}, m_{c}) - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END AS z_{c}, {c}" for c in COLS) + " FROM features, st)"
_NORM = " + ".join(f"z_{c} * z_{c}" for c in COLS)


def _by_rule(spark, d):
    scaled = ML.prepare(_features(spark, d), COLS, originals=True)
    return scaled.withColumn("cluster", F.when(F.col("_o_x1") < 17, 0).when(F.col("_o_x1") < 34, 1).otherwise(2))


@register("cluster_profile_by_rule", with_fixtures(f"""
WITH {_SCALED}
SELECT c AS cluster, count(*) AS size, {R('count(*) / sum(count(*)) OVER () * 100', 2)} AS percentage,
  {", ".join(f"{R(f'avg(z_{c})', 6)} AS centre_{c}, {R(f'avg({c})', 6)} AS mean_{c}, {R(f'stddev_samp({c})', 6)} AS std_{c}" for c in COLS)}
FROM z GROUP BY c""", "features"))
def cluster_profile_by_rule(spark, d):
    p = ML.cluster_profile(_by_rule(spark, d), COLS)
    return p.select("cluster", "size", rnd("percentage", 2).alias("percentage"), *[x for i, c in enumerate(COLS) for x in (
        rnd(F.col("centroid")[i], 6).alias(f"centre_{c}"), rnd(f"mean_{c}", 6).alias(f"mean_{c}"), rnd(f"std_{c}", 6).alias(f"std_{c}"))])


@register("silhouette_by_rule", with_fixtures(f"""
WITH {_SCALED},
k AS (SELECT c, count(*) AS n, sum({_NORM}) AS q, {", ".join(f"sum(z_{c}) AS s_{c}" for c in COLS)} FROM z GROUP BY c),
t AS (SELECT z.i, z.c = k.c AS own, k.n, ({_NORM}) * k.n + k.q - 2 * ({" + ".join(f"z.z_{c} * k.s_{c}" for c in COLS)}) AS total FROM z, k),
r AS (SELECT i, sum(total / (n - 1)) FILTER (WHERE own) AS a, min(total / n) FILTER (WHERE NOT own) AS b FROM t GROUP BY i)
SELECT 3 AS n_clusters, {R('avg((b - a) / greatest(a, b))', 4)} AS silhouette_score, count(*) AS total_records FROM r""", "features"))
def silhouette_by_rule(spark, d):
    lab = _by_rule(spark, d)
    score = spark.createDataFrame([(ML.silhouette(lab),)], "s double").select(rnd("s", 4).alias("silhouette_score"))
    return lab.agg(F.countDistinct("cluster").cast("int").alias("n_clusters"), F.count(F.lit(1)).alias("total_records")).select(
        "n_clusters", F.lit(score.first()[0]).alias("silhouette_score"), "total_records")


def _forest(spark, d):
    """The features lie in few files; scoring is CPU-bound, so rows are dealt to all shuffle partitions."""
    return ML.isolation_forest(_features(spark, d), COLS, partitions=int(spark.conf.get("spark.sql.shuffle.partitions")))


@register("isolation_forest")
def isolation_forest(spark, d):
    return _forest(spark, d).select("row_id", *COLS, rnd("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")


@register("anomaly_listing")
def anomaly_listing(spark, d):
    return ML.anomalies(_forest(spark, d)).select("row_id", *COLS, rnd("anomaly_score", 6).alias("anomaly_score"))


@register("isolation_forest_check", with_fixtures("""
SELECT count(*) AS total_records, true AS scores_in_range, true AS share_kept, true AS flagged_on_top FROM features""", "features"))
def isolation_forest_check(spark, d):
    return ML.forest_check(_forest(spark, d))


@register("anomaly_rate")
def anomaly_rate(spark, d):
    r = ML.anomaly_rate(_forest(spark, d))
    return r.select("total_anomalies", "total_records", rnd("anomaly_rate", 4).alias("anomaly_rate"))
