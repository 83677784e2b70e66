"""The vector operators against brute force: odd vectors, ties, repeated rows, several cells and blocks."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.errors import PythonException, SparkRuntimeException  # noqa: F401
from pyspark.sql import functions as F

from ledgerlake.llm import cover_search, gnat_codes
from ledgerlake.llm.vectors import whole_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, cell string, part string, v string, id string"


def vectors(n, dim, seed, spread=1.0, copies=True):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, dim))
    x = (middle[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, dim))).astype(np.float32) / 4
    rows = [(i, x[i].tolist(), [None, 1, 2][i % 3], "c", "p", "v", "i") for i in range(n)]
    if copies:
        rows += [(n + i, x[7].tolist(), 1, "c", "p", "v", "i") for i in range(60)]  # a hot vector
        rows += [(50, x[50].tolist(), 2, "c", "p", "v", "i"), (None, x[3].tolist(), 2, "c", "p", "v", "i"),
                 (-50, [0.0] * dim, 3, "c", "p", "v", "i"), (10_000, None, 1, "c", "p", "v", "i"),
                 (10_050, [None] + [0.1] * (dim - 1), 1, "c", "p", "v", "i"),
                 (10_100, [float("nan")] + [0.1] * (dim - 1), 1, "c", "p", "v", "i"),
                 (10_150, [float("inf")] + [0.1] * (dim - 1), 1, "c", "p", "v", "i")]
    random.Random(seed).shuffle(rows)
    return rows


def usable(rows):
    ok = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    return ok, [[math.floor(256 * float(np.float32(c))) for c in r[1]] for r in ok]


def brute_top(rows, every=50, k=5):
    ok, x = usable(rows)
    out = []
    for i, r in enumerate(ok):
        if r[0] is None or r[0] % every:
            continue
        scores = sorted(((-sum(a * b for a, b in zip(x[i], x[j], strict=False)), o[0] is None, o[0])
                         for j, o in enumerate(ok) if j != i), key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(r[0], n + 1, s[2], -s[0]) for n, s in enumerate(scores[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block,spread", [(2048, 1.0), (24, 1.0), (24, 0.05)])
def test_top_products_against_brute_force(spark, block, spread):
    rows = vectors(300, 12, 3, spread)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = cover_search.top_products(df, every=25, block=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_top(rows, 25)


def test_top_products_few_and_no_rows(spark):
    rows = [(0, [0.5, 0.25], 1, "", "", "", ""), (1, [1.0], 1, "", "", "", ""), (50, [], 1, "", "", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, cover_search.top_products(df).collect()))
    assert got == [(0, 1, 1, 128 * 256), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0)]
    assert cover_search.top_products(df.where("vec_id = 1")).collect() == []
    assert cover_search.top_products(df.limit(0)).dtypes == [
        ("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]


def test_cover_tree_nodes_hold_their_points():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (3000, 8))
    x[100:400] = x[0]
    t = cover_search.cover_tree(x)
    assert sorted(t.order) == list(range(3000)) and len(t.lo) > 40
    for lo, hi, radius, child, last in zip(t.lo, t.hi, t.radius, t.child, t.last, strict=True):
        own = x[t.order[lo:hi]]
        assert ((own - own[0]) ** 2).sum(axis=1).max(initial=0) <= radius ** 2
        if child:
            assert t.lo[child] == lo and t.hi[last - 1] == hi and (t.lo[child + 1:last] == t.hi[child:last - 1]).all()
            centres = x[t.order[t.lo[child:last]]]
            gaps = ((centres[:, None] - centres) ** 2).sum(axis=2) + np.eye(len(centres), dtype=int) * 10 ** 9
            inside = max(((x[t.order[t.lo[i]:t.hi[i]]] - x[t.order[t.lo[i]]]) ** 2).sum(axis=1).max() for i in range(child, last))
            assert gaps.min() >= inside  # centres lie at least as far apart as what they cover
        else:
            assert hi - lo <= cover_search.LEAF or radius == 0


def test_search_prunes_clusters_and_keeps_ties(monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-5, 5, (500, 6)) + c for c in np.eye(6, dtype=int) * 4000])
    q = x[:40].copy()
    seen = []
    product = cover_search._product
    monkeypatch.setattr(cover_search, "_product", lambda a, b: (seen.append(len(a) * len(b)), product(a, b))[1])
    first = np.arange(len(x))
    i, j, s = cover_search.search(q, cover_search.cover_tree(q), x, cover_search.cover_tree(x), np.full(40, cover_search.NONE), 4, first)
    whole = q @ x.T
    want = {(a, b) for a in range(40) for b in np.lexsort((first, -whole[a]))[:4]}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and (whole[i, j] == s).all()
    assert sum(seen) < 0.5 * whole.size


def brute_codes(rows, parts=16, entries=64, rounds=2):
    ok, x = usable(rows)
    x = np.array(x)
    order = sorted(range(len(ok)), key=lambda i: (ok[i][0] is None, ok[i][0] or 0, x[i].tolist()))[:entries]
    x = x.reshape(len(ok), parts, -1)
    books = x[order].transpose(1, 0, 2).copy()

    def nearest():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2)
    for _ in range(rounds):
        code, _ = nearest()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = x[code[:, p] == e, p]
                if len(own):
                    books[p, e] = [int(s) // len(own) for s in own.sum(axis=0)]
    code, d = nearest()
    error = d.sum(axis=1)
    by = {}
    for r, e in zip(ok, error, strict=True):
        by[r[2]] = by.get(r[2], 0) + int(e)
    digest = hashlib.sha256(",".join(str(c) for c in books.ravel()).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{e:02x}" for e in c), int(e2), by[r[2]], digest)
                   for r, c, e2 in zip(ok, code, error, strict=True)), key=str)


@pytest.mark.parametrize("n", [400, 20])
def test_codes_against_brute_force(spark, n):
    rows = vectors(n, 32, 5, copies=n > 100)
    got = gnat_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert sorted(map(tuple, got.collect()), key=str) == brute_codes(rows)


def test_codes_of_nothing_and_of_odd_widths(spark):
    df = spark.createDataFrame([(1, None, 1, "", "", "", "")], SCHEMA)
    assert gnat_codes.compress(df).collect() == []
    odd = spark.createDataFrame([(1, [0.5] * 5, 1, "", "", "", ""), (2, [0.5] * 3, None, "", "", "", "")], SCHEMA)
    assert [(r.vec_id, r.code[:10], r.error) for r in gnat_codes.compress(odd).orderBy("vec_id").collect()] == [
        (1, "0000000000", 0), (2, "0000000101", 0)]


def test_gnat_finds_the_lowest_of_equal_entries():
    rng = np.random.default_rng(4)
    for width, span in ((1, 6), (2, 4), (4, 200)):
        entries = rng.integers(-span, span, (200, width))
        x = rng.integers(-2 * span, 2 * span, (3000, width))
        tree = gnat_codes.Gnat(entries)
        d = gnat_codes.squared(x, entries)
        at, best = tree.nearest(x)
        assert (at == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_gnat_rules_out_children(monkeypatch):
    rng = np.random.default_rng(6)
    entries = np.concatenate([rng.integers(-3, 3, (40, 3)) + 1000 * c for c in rng.integers(-9, 9, (8, 3))])
    seen = []
    squared = gnat_codes.squared
    tree = gnat_codes.Gnat(entries)
    monkeypatch.setattr(gnat_codes, "squared", lambda a, b: (seen.append(len(a) * len(b)), squared(a, b))[1])
    x = entries[rng.integers(0, len(entries), 500)] + rng.integers(-2, 2, (500, 3))
    tree.nearest(x)
    assert sum(seen) < 0.4 * len(x) * len(entries)


def test_large_components_raise(spark):
    df = spark.createDataFrame([(1, [1e6])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="beyond 65536"):
        whole_vectors(df).select(F.sum(F.col("v")[0])).collect()
