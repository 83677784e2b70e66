"""Exact top-k inner products by a dual-tree search over cover trees.

Queries and data are indexed together. The top of the tree is a net of centres, taken by farthest-first from
a bounded sample of all vectors (``CELLS`` at most; the sample only places the centres, every vector is
indexed). Every distinct vector, query or not, goes to the cell of its nearest centre; cells are dealt into
blocks, and a block holds the cover tree of its vectors: nets of shrinking radius, each node with its centre
and covering radius. The queries of a cell form trees of the same kind.

A pair of nodes (queries within radius a of p, data within b of c) holds no product above
``p.c + a |c| + b |p| + a b``. It goes if that is below the worst kth score among the queries of the node.
First every query group meets one block of its own cell, which sets its kth scores; then Spark drops the
(group, cell) pairs whose bound is too low, joins the others' blocks, and each task descends both trees of a
pair. All arithmetic is on integers, radii and norms rounded up, and a bound equal to the kth score stays, so
that ties are whole.

Equal vectors are one entry with its ``k + 1`` smallest ids: a hot vector costs one entry, and no more of its
rows can rank. One more than k results are kept, so that a query's own row can be taken out at the end.

Defined results:

* vectors that are null or hold null or non-finite components take no part (``vectors.whole_vectors``);
* a repeated row is a candidate of its own, and a query of its own with the same results as its copy; a
  query loses exactly one row with its id and vector, its own;
* a row with a null vec_id is no query; as a candidate it ranks after all ids of the same score;
* vectors of different length multiply as if filled up with zeros; an empty vector scores 0;
* with fewer than k other rows all are returned; an empty table gives no rows;
* other columns are not read, so they may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import staged
from ledgerlake.llm.vectors import longest, matrix, whole_vectors

#: Vectors of a block, queries of a group, cells at most, sampled vectors for each cell.
BLOCK, GROUP, CELLS, SAMPLED = 2048, 512, 4096, 4
#: Vectors of a leaf, children of a node, leaves scored at a time.
LEAF, FANOUT, STEP = 64, 64, 8
NONE = np.iinfo(np.int64).min


def _up(d2) -> np.ndarray:
    """Whole square roots, rounded up."""
    return np.array([isqrt(int(d) - 1) + 1 if d > 0 else 0 for d in np.ravel(d2)], np.int64).reshape(np.shape(d2))


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products, exact: by floats where no sum can leave 53 bits."""
    if len(x) and len(y) and x.shape[1] * int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) < 1 << 53:
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    return x @ y.T


def _away(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


@dataclass
class Tree:
    """A cover tree in arrays. ``order`` lists the points so that a node's are ``order[lo:hi]``; a node's centre is
    its first point; its children, if any, are the nodes ``child`` to ``last``."""
    order: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    last: np.ndarray

    def __iter__(self):
        return iter((self.order, self.lo, self.hi, self.radius, self.child, self.last))


def net(x: np.ndarray, most: int, radius2: int = -1) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres farthest-first from the first point, until all points lie within the radius or there are ``most``;
    each point's nearest centre and squared distance. Centres lie farther apart than what they cover."""
    centres, owner, d2 = [0], np.zeros(len(x), int), _away(x, x[0])
    while len(centres) < most and (far := int(d2.argmax())) >= 0 and d2[far] > max(radius2, 0):
        new = _away(x, x[far])
        owner[new < d2] = len(centres)
        d2 = np.minimum(d2, new)
        centres.append(far)
    return centres, owner, d2


def cover_tree(x: np.ndarray) -> Tree:
    """The tree over the rows of x. Each level's net halves the covering radius, with ``FANOUT`` centres at most."""
    order = np.arange(len(x))
    lo, hi, radius, child, last = [0], [len(x)], [0], [0], [0]
    i = 0
    while i < len(lo):
        own = order[lo[i]:hi[i]]
        d2 = _away(x[own], x[own[0]]) if len(own) else np.zeros(1, np.int64)
        radius[i] = isqrt(int(d2.max()) - 1) + 1 if d2.max() > 0 else 0
        if len(own) > LEAF and radius[i]:
            centres, owner, _ = net(x[own], FANOUT, int(d2.max()) // 4)
            first = np.ones(len(own), bool)
            first[centres] = False
            by = np.lexsort((first, owner))  # the centre comes first in its part
            order[lo[i]:hi[i]] = own[by]
            ends = lo[i] + np.cumsum(np.bincount(owner, minlength=len(centres)))
            child[i], last[i] = len(lo), len(lo) + len(centres)
            lo += [lo[i], *ends[:-1].tolist()]
            hi += ends.tolist()
            radius += [0] * len(centres)
            child += [0] * len(centres)
            last += [0] * len(centres)
        i += 1
    return Tree(order, *(np.array(a, np.int64) for a in (lo, hi, radius, child, last)))


def search(q: np.ndarray, qt: Tree, x: np.ndarray, xt: Tree, kth: np.ndarray, k: int, first: np.ndarray) -> tuple:
    """(query, point, score) of the k best points of every query that score at least its ``kth``; ``first`` orders ties."""
    q, x, first = q[qt.order], x[xt.order], first[xt.order]
    qn, xn = _up(np.einsum("ij,ij->i", q, q)), _up(np.einsum("ij,ij->i", x, x))
    kth = kth[qt.order].copy()
    best = np.full((len(q), k), NONE)
    bound_of = np.empty(len(xt.lo), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    todo = [(0, np.array([0]))] if len(q) and len(x) else []
    while todo:
        a, nodes = todo.pop()
        rows = slice(qt.lo[a], qt.hi[a])
        # The node's centre is a point of its own, so that the products with all centres bound all pairs at once.
        p, c = qt.lo[a], xt.lo[nodes]
        bound = (_product(q[p:p + 1], x[c])[0] + qt.radius[a] * xn[c] + xt.radius[nodes] * qn[p] + qt.radius[a] * xt.radius[nodes])
        bound_of[nodes] = bound
        nodes = nodes[np.argsort(-bound, kind="stable")]
        nodes = nodes[bound_of[nodes] >= kth[rows].min()]
        leaves, inner = nodes[xt.child[nodes] == 0], nodes[xt.child[nodes] > 0]
        if qt.child[a] and len(nodes):
            todo += [(b, nodes) for b in range(qt.child[a], qt.last[a])]
            continue
        if len(inner):
            todo.append((a, np.concatenate([np.arange(xt.child[n], xt.last[n]) for n in inner])))
        for n in range(0, len(leaves), STEP):  # the best bounds first, since their scores rule others out
            some = leaves[n:n + STEP][bound_of[leaves[n:n + STEP]] >= kth[rows].min()]
            if not len(some):
                break
            points = np.concatenate([np.arange(xt.lo[m], xt.hi[m]) for m in some])
            score = _product(q[rows], x[points])
            i, j = np.nonzero(score >= kth[rows, None])
            found.append((i + qt.lo[a], points[j], score[i, j]))
            both = np.concatenate([best[rows], score], axis=1)
            best[rows] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            kth[rows] = np.maximum(kth[rows], best[rows].min(axis=1))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(3))
    i, j, score = (np.concatenate(f) for f in zip(*found, strict=True))
    some = score >= kth[i]
    i, j, score = i[some], j[some], score[some]
    by = np.lexsort((first[j], -score, i))
    i, j, score = i[by], j[by], score[by]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    top = rank < k
    return qt.order[i[top]], xt.order[j[top]], score[top]


def _pack(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a, np.int64).tobytes() for a in arrays]


def _unpack(*buffers: bytes) -> list[np.ndarray]:
    return [np.frombuffer(b, np.int64) for b in buffers]


PACKED = ["id", "x", "first", "order", "lo", "hi", "radius", "child", "last"]
BLOCKS = "cell int, part int, " + ", ".join(f"{c} binary" for c in PACKED)


def _block(rows: pd.DataFrame, width: int) -> pd.DataFrame:
    """One block: its vectors, their ids, the order of ties and the cover tree."""
    x = matrix(pa.array(rows["v"], pa.list_(pa.int64())), width)
    by = np.lexsort((rows["id"], rows["first"]))
    x = x[by]
    return pd.DataFrame([[rows["cell"].iat[0], rows["part"].iat[0],
                          *_pack(rows["id"].to_numpy()[by], x, rows["first"].to_numpy()[by], *cover_tree(x))]],
                        columns=["cell", "part", *PACKED])


def _found(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """Dual-tree search of each joined pair of a query group and a block."""
    for batch in batches:
        for r in batch.to_pylist():
            qid, q, _, *qt = _unpack(*[r[f"q_{c}"] for c in PACKED])
            xid, x, first, *xt = _unpack(*[r[c] for c in PACKED])
            kth = np.frombuffer(r["kth"], np.int64) if r["kth"] else np.full(len(qid), NONE)
            # Blocks list their points by (first id, entry); the position orders ties like that.
            i, j, score = search(q.reshape(len(qid), width), Tree(*qt), x.reshape(len(xid), width), Tree(*xt), kth, k,
                                 np.arange(len(xid)))
            if len(i):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["q_cell"]] * len(i), pa.int32()), pa.array([r["q_part"]] * len(i), pa.int32()),
                     pa.array(qid[i]), pa.array(xid[j]), pa.array(first[j]), pa.array(score)],
                    names=["q_cell", "q_part", "query", "entry", "first", "score"])


FOUND = "q_cell int, q_part int, query long, entry long, first long, score long"


def _centres(entries: DataFrame, cells: int, width: int) -> np.ndarray:
    """The top net: so many centres out of ``SAMPLED`` times as many vectors, those of least hash."""
    some = entries.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLED * cells).collect()
    x = matrix(pa.array([r["v"] for r in some], pa.list_(pa.int64())), width)
    return x[net(x, cells)[0]]


def _nearest(centres: np.ndarray):
    """Arrow batches with the cell of each vector and its squared distance from the centre."""
    norms = np.einsum("ij,ij->i", centres, centres)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("v"), centres.shape[1])
            d2 = norms - 2 * _product(x, centres)  # without the vector's own norm, which all centres share
            cell = d2.argmin(axis=1)
            away = d2.min(axis=1, initial=np.iinfo(np.int64).max) + np.einsum("ij,ij->i", x, x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away, pa.int64())],
                                             names=[*batch.schema.names, "cell", "away"])
    return run


def _surviving(centres: np.ndarray, radii: dict[int, int], blocks: dict[int, int], width: int):
    """(group, block) pairs that may hold a score of at least the group's worst kth, but for the group's first block."""
    cells = np.array(sorted(blocks), int)
    c, away = centres[cells], np.array([radii[i] for i in cells], np.int64)
    norms = _up(np.einsum("ij,ij->i", c, c))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q = np.frombuffer(r["q_x"], np.int64).reshape(-1, width)
                p = centres[r["q_cell"]]
                reach = _up(_away(q, p).max())
                bound = _product(p[None], c)[0] + reach * norms + away * _up(p @ p) + reach * away
                worst = np.frombuffer(r["kth"], np.int64).min() if r["kth"] else NONE
                pairs = [(int(i), b) for i in cells[bound >= worst] for b in range(blocks[int(i)])
                         if (i, b) != (r["q_cell"], r["q_part"] % blocks[int(i)])]
                if pairs:
                    n = len(pairs)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["q_cell"]] * n, pa.int32()), pa.array([r["q_part"]] * n, pa.int32()),
                         pa.array([i for i, _ in pairs], pa.int32()), pa.array([b for _, b in pairs], pa.int32())],
                        names=["q_cell", "q_part", "cell", "part"])
    return run


def top_products(df: DataFrame, every: int = 50, k: int = 5, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for every vec_id divisible by ``every`` its k best other rows."""
    keep = k + 1
    rows = staged(whole_vectors(df.select(F.col("vec_id").cast("long"), "embedding")).select("vec_id", "v"), "top-rows")
    asks = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    in_turn = Window.partitionBy("v", "asks").orderBy(F.col("vec_id").asc_nulls_last())
    ids = F.array_sort(F.collect_list(F.struct(F.col("vec_id").isNull().alias("no"), F.col("vec_id").alias("id"))))
    entries = (rows.withColumn("asks", asks).withColumn("_n", F.row_number().over(in_turn)).where(F.col("_n") <= keep)
               .groupBy("v").agg(F.slice(ids, 1, keep).alias("ids"), F.max("asks").alias("asks"))
               .select(F.monotonically_increasing_id().alias("id"), "v", "asks", F.col("ids.id").alias("ids"),
                       F.coalesce(F.col("ids")[0]["id"], F.lit((1 << 63) - 1)).alias("first")))
    entries = staged(entries, "top-entries")  # written, so that the numbers stay
    n, width = entries.agg(F.count(F.lit(1)), longest("v")).first()
    if not n:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, 1)
    centres = _centres(entries, min(CELLS, max(1, n // block)), width)
    placed = staged(entries.select("id", "v", "asks", "first").mapInArrow(
        _nearest(centres), "id long, v array<long>, asks boolean, first long, cell int, away long"), "top-cells")
    # One row per cell, at most CELLS.
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away"),
                                       F.count_if("asks").alias("asks")).collect()
    blocks = {r["cell"]: -(-r["n"] // block) for r in cells}
    groups = {r["cell"]: -(-r["asks"] // GROUP) for r in cells if r["asks"]}
    if not groups:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    radii = {r["cell"]: int(_up(r["away"])) for r in cells}

    def parts(of: dict[int, int], cell: str) -> DataFrame:
        return F.broadcast(df.sparkSession.createDataFrame(list(of.items()), f"{cell} int, parts int"))

    def dealt(points: DataFrame, of: dict[int, int]) -> DataFrame:
        return (points.join(parts(of, "cell"), "cell")
                .withColumn("part", F.pmod(F.xxhash64("v"), "parts").cast("int"))
                .groupBy("cell", "part").applyInPandas(lambda r: _block(r, width), BLOCKS))

    data = staged(dealt(placed, blocks), "top-blocks")
    asked = staged(dealt(placed.where("asks"), groups), "top-groups").select(*[F.col(c).alias(f"q_{c}") for c in ["cell", "part", *PACKED]])
    first = asked.withColumn("kth", F.lit(None).cast("binary")).join(parts(blocks, "q_cell"), "q_cell").join(
        data, (F.col("q_cell") == F.col("cell")) & (F.col("part") == F.col("q_part") % F.col("parts")))
    run = lambda b: _found(b, width, keep)
    first = staged(first.mapInArrow(run, FOUND), "top-first")
    kths = first.groupBy("q_cell", "q_part", "query").agg(
        F.when(F.count(F.lit(1)) >= keep, F.min("score")).otherwise(F.lit(NONE)).alias("kth"))
    kths = kths.groupBy("q_cell", "q_part").agg(F.map_from_entries(F.collect_list(F.struct("query", "kth"))).alias("kths"))
    asked = staged(asked.join(kths, ["q_cell", "q_part"], "left").mapInArrow(_with_kth, asked_schema()), "top-asked")
    pairs = asked.select("q_cell", "q_part", "q_x", "kth").mapInArrow(
        _surviving(centres, radii, blocks, width), "q_cell int, q_part int, cell int, part int")
    later = pairs.join(asked, ["q_cell", "q_part"]).join(data, ["cell", "part"]).mapInArrow(run, FOUND)
    best = first.unionByName(later).select("query", "entry", "first", "score")
    by_entry = Window.partitionBy("query").orderBy(F.desc("score"), "first", "entry")
    best = best.withColumn("_n", F.row_number().over(by_entry)).where(F.col("_n") <= keep)
    by_row = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "entry")
    best = (best.join(entries.select(F.col("id").alias("entry"), "ids"), "entry")
            .select("query", "entry", "score", F.explode("ids").alias("vec_id"))
            .withColumn("_n", F.row_number().over(by_row)).where(F.col("_n") <= keep)
            .groupBy("query").agg(F.array_sort(F.collect_list(F.struct("_n", "entry", "vec_id", "score"))).alias("best")))
    asking = (rows.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
              .join(entries.where("asks").select("v", F.col("id").alias("query")), "v"))
    mine = F.filter("best", lambda b: (b["entry"] == F.col("query")) & b["vec_id"].eqNullSafe(F.col("query_id")))
    mine = F.coalesce(F.try_element_at(mine, F.lit(1))["_n"], F.lit(0))
    return (asking.join(best, "query")
            .select("query_id", F.posexplode(F.slice(F.filter("best", lambda b: b["_n"] != mine), 1, k)).alias("_p", "b"))
            .select("query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"),
                    F.col("b.score").alias("score")))


def asked_schema() -> str:
    return "q_cell int, q_part int, " + ", ".join(f"q_{c} binary" for c in PACKED) + ", kth binary"


def _with_kth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kth score of every query of a group, in the group's order."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            known = dict(r["kths"] or [])
            kth = np.array([known.get(i, NONE) for i in np.frombuffer(r["q_id"], np.int64).tolist()], np.int64)
            out.append({c: r[c] for c in ("q_cell", "q_part", *[f"q_{c}" for c in PACKED])} | {"kth": kth.tobytes()})
        schema = pa.schema([("q_cell", pa.int32()), ("q_part", pa.int32()), *[(f"q_{c}", pa.binary()) for c in PACKED], ("kth", pa.binary())])
        yield pa.RecordBatch.from_pylist(out, schema)
