"""Selection by sketched brackets, moments against ranks, and the t tail: against NumPy, in awkward shapes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import quantiles as QT
from ledgerlake.functions.student import two_sided_p
from ledgerlake.operators import stats as ST


def check(got, want):
    got = {r["k"]: (r["n"], r["a"], r["b"], r["c"]) for r in got.collect()}
    assert got.keys() == want.keys()
    for k, values in want.items():
        assert got[k] == pytest.approx((len(values), *np.percentile(values, [25, 50, 99.9])), rel=1e-12), k


def sample():
    rng = np.random.default_rng(7)
    groups = {"hot": np.concatenate([np.full(6000, 2.5), rng.normal(size=9000), [np.inf, -1e300]]),
              None: np.repeat(rng.normal(size=3), 700), "tied": np.full(500, -1.0), "one": np.array([4.0]),
              "two": np.array([1.0, 2.0]), "wide": rng.lognormal(sigma=8, size=5000)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None), ("empty", None)]
    rng.shuffle(rows)
    return [(k, None if v is None else float(v)) for k, v in rows], groups


@pytest.mark.parametrize("keep,few", [(1_000_000, 20_000), (40, 20_000), (40, 0)])
def test_quantiles_in_one_and_more_rounds(spark, monkeypatch, keep, few):
    monkeypatch.setattr(QT, "KEEP", keep)
    monkeypatch.setattr(QT, "FEW_KEYS", few)  # 0: no broadcast
    rows, groups = sample()
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    check(QT.exact_quantiles(df, ["k"], "v", [0.25, 0.5, 0.999], ["a", "b", "c"]), groups)


def test_a_missed_rank_is_selected_again(spark, monkeypatch):
    rows, groups = sample()
    df = spark.createDataFrame(rows, "k string, v double")
    whole = QT._brackets

    def wrong(*args):
        b, few = whole(*args)
        return b.withColumn("_hi1", F.lit(-1e9)), few
    monkeypatch.setattr(QT, "_brackets", wrong)
    check(QT.exact_quantiles(df, ["k"], "v", [0.25, 0.5, 0.999], ["a", "b", "c"]), groups)


def test_no_sort_or_shuffle_of_the_values(spark):
    """What is exchanged are partial aggregates and running counts: no plan sorts or moves the rows themselves."""
    df = spark.range(200_000).select((F.col("id") % 2).alias("k"), F.rand(1).alias("v"))
    brackets, few = QT._brackets(df.select(F.col("k").alias("_k0"), F.col("v").alias("_v")), ["_k0"], 1,
                                 lambda i: (F.floor(F.col("_n") / 2), F.ceil(F.col("_n") / 2)))
    s = QT._select(df.select(F.col("k").alias("_k0"), F.col("v").alias("_v")), brackets, ["_k0"], 1,
                   lambda i: (F.floor(F.col("_n") / 2), F.ceil(F.col("_n") / 2)), few)
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "SortMergeJoin" not in plan
    counted = s.collect()
    assert len(counted) == 2


@pytest.mark.parametrize("parts", [1, 5])
def test_ordered_moments(spark, parts):
    rng = np.random.default_rng(3)
    rows = []
    for k, n in (("hot", 30_000), ("a", 3), (None, 9), ("one", 1), ("flat", 40)):
        for i in range(n):
            y = 5.0 if k == "flat" else float(1e6 + rng.normal() + i * 0.01)
            rows.append((k, int(rng.integers(0, max(n // 3, 1))), None if k == "hot" and i % 17 == 0 else y))
    df = spark.createDataFrame(rows, "k string, d int, y double").repartition(7)
    got = {r["k"]: r for r in QT.ordered_moments(df, ["k"], ["d", "y"], "y", num_partitions=parts).collect()}
    for k in ("hot", "a", None, "one", "flat"):
        own = sorted(((d, y) for kk, d, y in rows if kk == k), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        x = np.array([i for i, (_, y) in enumerate(own) if y is not None], float)
        y = np.array([y for _, y in own if y is not None])
        r = got[k]
        assert (r["n"], r["n_values"], r["lowest"], r["highest"]) == (len(own), len(y), own[0][0], own[-1][0])
        assert (r["first"], r["last"]) == (own[0][1], own[-1][1])
        dx, dy = x - x.mean(), y - y.mean()
        assert r["sxx"] == pytest.approx((dx * dx).sum(), rel=1e-9)
        assert r["sxy"] == pytest.approx((dx * dy).sum(), rel=1e-7, abs=1e-7)
        assert r["syy"] == pytest.approx((dy * dy).sum(), rel=1e-7, abs=1e-9)


def simpson_p(r, n):
    """Share of cos^(n-3) beyond asin |r|."""
    def integral(a):
        b = min(math.pi / 2, a + 14 / math.sqrt(max(n - 2, 1)))
        x, w = np.linspace(a, b, 20_001), np.ones(20_001)
        w[1:-1:2], w[2:-1:2] = 4, 2
        return (b - a) / 60_000 * (w * np.cos(x) ** (n - 3)).sum()
    return integral(math.asin(abs(r))) / integral(0.0)


def test_p_values_over_many_sizes(spark):
    rows = [(r, n) for n in (3, 4, 5, 10, 37, 400, 10_000, 1_000_000) for r in (0.0, 1e-4, 0.01, -0.2, 0.5, 0.9, -0.999)]
    got = spark.createDataFrame(rows, "r double, n long").select("r", "n", two_sided_p(F.col("r"), F.col("n")).alias("p")).collect()
    for g in got:
        assert g["p"] == pytest.approx(simpson_p(g["r"], g["n"]), rel=1e-6, abs=1e-12), (g["r"], g["n"])


def test_p_values_at_the_edges(spark):
    rows = [(None, 10), (0.5, 2), (1.0, 10), (-1.0, 3), (0.0, 3), (float("nan"), 8)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r double, n long").orderBy("i")
    assert [r[0] for r in df.select(two_sided_p(F.col("r"), F.col("n"))).collect()] == [1.0, 1.0, 0.0, 0.0, 1.0, 1.0]


def test_trend_of_flat_short_and_perfect_series(spark):
    import datetime as dt
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    rows = [("flat", day(i), 3.0) for i in range(5)] + [("one", day(0), 2.0)] + [("up", day(i), 2.0 * i + 1) for i in range(6)]
    got = {r["entity_id"]: r for r in ST.trend(spark.createDataFrame(rows, "entity_id string, ds date, y double")).collect()}
    assert (got["flat"]["slope"], got["flat"]["p_value"], got["flat"]["direction"]) == (0.0, 1.0, "stable")
    assert (got["one"]["slope"], got["one"]["p_value"], got["one"]["span_days"]) == (None, 1.0, 0)
    assert got["up"]["slope"] == pytest.approx(2.0) and got["up"]["p_value"] == pytest.approx(0.0, abs=1e-9)
    assert got["up"]["pct_change"] == pytest.approx(1000.0)
