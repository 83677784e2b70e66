"""Model checks: AR vs NumPy least squares, p-values, isolation forest, k-means."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import forecast as FC
from ledgerlake.operators import ml as ML
from ledgerlake.operators import stats as ST


def _series(spark, ys, entity=1):
    start = dt.date(2015, 1, 1)
    rows = []
    for i, y in enumerate(ys):
        m = start.month - 1 + i
        rows.append((entity, dt.date(start.year + m // 12, m % 12 + 1, 1), float(y)))
    return spark.createDataFrame(rows, "entity_id long, ds date, y double")


def test_ar_statistics_match_lstsq(spark):
    rng = np.random.default_rng(1)
    y = np.cumsum(rng.normal(size=80)) * 10 + 100
    st = FC.ar_statistics(_series(spark, y)).first()
    dy = np.diff(y)
    p = 5
    X = np.column_stack([dy[p - i:len(dy) - i] for i in range(1, p + 1)])
    t = dy[p:]
    A = np.array([[st[f"xx_{min(i, j)}_{max(i, j)}"] for j in range(1, p + 1)] for i in range(1, p + 1)])
    b = np.array([st[f"xy_{i}"] for i in range(1, p + 1)])
    phi = np.linalg.solve(A, b)
    ref = np.linalg.lstsq(X, t, rcond=None)[0]
    assert phi == pytest.approx(ref, rel=1e-8, abs=1e-10)


def test_ar_forecast_follows_a_linear_trend(spark):
    y = 100 + 5 * np.arange(40) + np.sin(np.arange(40))
    f = FC.ar_forecast(_series(spark, y)).orderBy("step").toPandas()
    assert len(f) == 12 and (f["lower_bound"] <= f["forecast"]).all() and (f["forecast"] <= f["upper_bound"]).all()
    assert f["forecast"].iloc[-1] > y[-1]


def _ar_by_hand(y, p=5, steps=12):
    """Conditional least squares, psi weights and the roll-out with NumPy."""
    dy = np.diff(y)
    q = min(p, max(0, (len(y) - 2) // 2))
    X = np.column_stack([dy[q - i:len(dy) - i] for i in range(1, q + 1)]) if q else np.zeros((len(dy), 0))
    t = dy[q:]
    A = X.T @ X
    phi = np.linalg.solve(A + 1e-9 * np.trace(A) * np.eye(q), X.T @ t) if q else np.zeros(0)
    sigma2 = ((t - X @ phi) ** 2).sum() / max(len(t) - q, 1)
    phi = np.r_[phi, np.zeros(p - q)]
    d, level, path = list(dy[::-1][:p]) + [0.0] * p, y[-1], []
    for _ in range(steps):
        d = [float(phi @ d[:p])] + d
        level += d[0]
        path.append(level)
    impulse, shock = [], np.r_[1.0, np.zeros(steps)]  # the response of the level to one shock
    for h in range(steps):
        impulse.append(shock[h] + sum(phi[i] * impulse[h - 1 - i] for i in range(p) if h - 1 - i >= 0))
    psi = np.cumsum(impulse)
    return np.array(path), 1.96 * np.sqrt(sigma2 * np.cumsum(psi ** 2))


@pytest.mark.parametrize("n", [2, 3, 4, 5, 7, 9, 12, 40, 90])
def test_ar_forecast_matches_numpy_at_every_length(spark, n):
    rng = np.random.default_rng(n)
    y = 500 + np.cumsum(rng.normal(size=n)) * 20
    f = FC.ar_forecast(_series(spark, y)).orderBy("step").toPandas()
    path, half = _ar_by_hand(y)
    assert f["forecast"].to_numpy() == pytest.approx(path, rel=1e-7)
    assert ((f["upper_bound"] - f["lower_bound"]) / 2).to_numpy() == pytest.approx(half, rel=1e-5, abs=1e-4)


def test_ar_forecast_of_constant_and_single_months(spark):
    flat = FC.ar_forecast(_series(spark, [7.0] * 20)).collect()
    assert {(r.forecast, r.lower_bound, r.upper_bound, r.status) for r in flat} == {(7.0, 7.0, 7.0, "ok")}
    one = FC.ar_forecast(_series(spark, [7.0]).withColumnRenamed("entity_id", "shop"), by=("shop",)).collect()
    assert {(r.shop, r.forecast, r.status) for r in one} == {(1, 7.0, "no differences: fewer than 2 months")}


def test_seasonal_forecast_beats_naive_on_seasonal_series(spark):
    t = np.arange(48)
    y = 1000 + 10 * t + 200 * np.sin(2 * np.pi * t / 12)
    train, test = y[:36], y[36:]
    f = FC.seasonal_forecast(_series(spark, train)).orderBy("step").toPandas()["forecast"].to_numpy()
    rmse = np.sqrt(np.mean((f - test) ** 2))
    naive = np.sqrt(np.mean((train[-12:] - test) ** 2))
    assert rmse < naive


def test_t_pvalue_matches_known_values(spark):
    # two-sided p for t = 2.228 with 10 dof is 0.05; t = 0 gives 1
    rows = [(i, t / (t * t + 10) ** 0.5, 12) for i, t in enumerate([2.228138851986, 0.0, 3.169272672617])]
    df = spark.createDataFrame(rows, "i int, r double, n long").orderBy("i")
    p = [r["p_value"] for r in ST.correlation_pvalue(df).collect()]
    assert p == pytest.approx([0.05, 1.0, 0.01], abs=1e-6)


def test_isolation_forest_finds_planted_outliers(spark):
    rng = np.random.default_rng(3)
    n = 3000
    X = rng.normal(size=(n, 2))
    X[:30] += 12
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(X)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double")
    out = ML.isolation_forest(df, ["a", "b"], n_trees=50).toPandas().sort_values("anomaly_score", ascending=False)
    top = set(out["row_id"].head(30))
    assert len(top & set(range(30))) >= 28
    assert out["is_anomaly"].mean() == pytest.approx(0.1, abs=0.01)


def test_kmeans_recovers_blobs(spark):
    rng = np.random.default_rng(4)
    centers = np.array([[0, 0], [20, 0], [0, 20]])
    X = np.vstack([c + rng.normal(size=(200, 2)) for c in centers])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(X)], "row_id long, a double, b double")
    lab, _ = ML.kmeans(df, ["a", "b"])
    p = lab.select("row_id", "cluster").toPandas().sort_values("row_id")["cluster"].to_numpy()
    for k in range(3):
        assert len(set(p[k * 200:(k + 1) * 200])) == 1
    assert len(set(p)) == 3
    assert ML.silhouette(lab) > 0.8


def test_isolation_forest_with_repeated_ids_is_independent_of_partitioning(spark):
    rows = [(i % 100, float(i * 37 % 101), float(i * 53 % 89)) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double")

    def scores(d):
        return sorted((r.row_id, round(r.anomaly_score, 9)) for r in ML.isolation_forest(d, ["a", "b"], n_trees=10, psi=64).collect())

    assert scores(df.repartition(3)) == scores(df.repartition(7, "b"))
    few = ML.isolation_forest(df.limit(5), ["a", "b"]).collect()
    assert len(few) == 5 and all(r.anomaly_score is None and not r.is_anomaly for r in few)


@pytest.mark.parametrize("seed", range(40, 50))
def test_isolation_forest_with_a_pile_of_equal_rows(spark, seed):
    """200,000 equal rows and three far outliers: exactly the three are flagged, whatever the seed."""
    pile = spark.range(200_000).select(F.lit(None).cast("long").alias("row_id"), F.lit(1.0).alias("a"), F.lit(2.0).alias("tree"))
    far = spark.createDataFrame([(1, 50.0, 2.0), (2, 1.0, -40.0), (3, -30.0, 30.0)], "row_id long, a double, tree double")
    out = ML.isolation_forest(pile.union(far), ["a", "tree"], seed=seed, n_trees=20)
    assert sorted(tuple(r) for r in ML.anomalies(out).select("row_id", "a", "tree").collect()) == [
        (1, 50.0, 2.0), (2, 1.0, -40.0), (3, -30.0, 30.0)]
    assert ML.anomaly_rate(out).first()["total_records"] == 200_003


def test_isolation_forest_of_one_point_flags_nothing(spark):
    df = spark.range(50).select(F.col("id").alias("row_id"), F.lit(3.0).alias("a"))
    out = ML.isolation_forest(df, ["a"], n_trees=5)
    assert {(round(r.anomaly_score, 9), r.is_anomaly) for r in out.collect()} == {(0.5, False)}
    assert ML.forest_check(out).first()["total_records"] == 50


def test_isolation_forest_piles_under_two_partitionings(spark):
    rows = [(i, float(i % 7), float(i % 3) if i % 11 else None) for i in range(2000)] + [(5000 + i, 100.0 + i, 9.0) for i in range(5)]
    df = spark.createDataFrame(rows, "row_id long, row double, b double")
    scores = [sorted((r.row_id, round(r.anomaly_score, 9), r.is_anomaly) for r in ML.isolation_forest(
        d, ["row", "b"], n_trees=15, psi=16, partitions=p).collect()) for d, p in ((df.repartition(2), None), (df.repartition(9), 4))]
    assert scores[0] == scores[1]
    assert {5000, 5001, 5002, 5003, 5004} <= {i for i, _, flagged in scores[0] if flagged}


def test_silhouette_matches_all_pairs(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 2)) + np.repeat([[0, 0], [4, 0], [0, 5]], 20, axis=0)
    labels = [0] * 20 + [1] * 20 + [2] * 19 + [3]
    rows = [(i, float(a), float(b), c) for i, ((a, b), c) in enumerate(zip(x, labels, strict=True))] + [(99, 0.0, 0.0, None)]
    got = ML.silhouette(spark.createDataFrame(rows, "row_id long, a double, b double, cluster int"), ["a", "b"])
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    c, want = np.array(labels), []
    for i in range(60):
        if (c == c[i]).sum() == 1:
            want.append(0.0)
            continue
        a = d[i][c == c[i]].sum() / ((c == c[i]).sum() - 1)
        b = min(d[i][c == k].mean() for k in set(labels) - {c[i]})
        want.append((b - a) / max(a, b))
    assert got == pytest.approx(np.mean(want))
    assert ML.silhouette(spark.createDataFrame(rows[:20], "row_id long, a double, b double, cluster int"), ["a", "b"]) is None


def test_isolation_forest_scores_keep_long_ids_beside_null_ones(spark):
    """2^53 + 1 is no double: ids must not pass through one on their way through the scorer."""
    rows = [(2 ** 53 + 1, 50.0), (None, 49.0)] + [(i, float(i % 7)) for i in range(60)]
    out = ML.isolation_forest(spark.createDataFrame(rows, "row_id long, a double").coalesce(1), ["a"], n_trees=5, psi=16)
    assert {r.row_id for r in out.where("a > 40").collect()} == {2 ** 53 + 1, None}


def test_forest_scores_match_a_walk_node_by_node():
    import pyarrow as pa
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    forest = []
    for tree in range(7):
        pick = pd.DataFrame(x[rng.choice(300, 32, replace=False)], columns=["f0", "f1", "f2"]).assign(
            tree=tree, _m=1, _rank=np.arange(32.0), _row=np.arange(32))
        forest.append(ML._grow(["f0", "f1", "f2"], 1, 32)(pick))
    forest = pd.concat(forest)
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), *[pa.array(x[:, i]) for i in range(3)]], names=["id", "f0", "f1", "f2"])
    got, = ML._score(["f0", "f1", "f2"], forest, ["id", "_s"])([batch])
    for i, row in enumerate(x):
        shares = []
        for _, nodes in forest.groupby("tree"):
            at = {n.node: n for n in nodes.itertuples()}
            n, depth = at[0], 0
            while n.feature >= 0:
                n, depth = at[n.left if row[n.feature] < n.split else n.right], depth + 1
            shares.append((depth + ML._c(n.size)) / ML._c(32))
        assert got.column("_s")[i].as_py() == pytest.approx(2.0 ** -np.mean(shares), rel=1e-12)
