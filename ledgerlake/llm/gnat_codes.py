"""Vector code compression: each vector becomes one byte per part, an entry of that part's codebook.

Nearest entries are found by a geometric near-neighbour access tree (GNAT) over a part's entries. A node keeps
split points, and for every split point and child the range of distances between them. A query's distances to
the split points rule out whole children by the triangle inequality. Distances are integers under the root;
the roots are rounded apart by more than their error and a child goes only if it is strictly farther than the
best entry so far, so that every entry that could tie is compared by its whole squared distance, then index.

Spark assigns parts in Arrow batches, adds the sums of each (part, entry) up over tasks and groups, and the
driver holds only the codebooks: parts x entries rows, whatever the number of vectors.

Defined results:

* rows whose vector is null or holds a null or non-finite component are dropped (``vectors.whole_vectors``);
* every repeated row counts and gets its code; null vec_ids come last among the first entries;
* with fewer kept rows than entries, the codebooks have as many entries as there are rows;
* vectors shorter than the longest, or not divisible into equal parts, are filled up with zeros;
* equal labels add up, null labels together; an empty table gives no rows;
* other columns are not read, so they may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import staged
from ledgerlake.llm.vectors import longest, matrix, whole_vectors

DEGREE, LEAF = 8, 6
#: Roots of whole numbers below 2^63 are off by far less than this share.
APART = 2.0 ** -48


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y."""
    d = x[:, None, :] - y[None, :, :]
    return np.einsum("ijk,ijk->ij", d, d)


def _below(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2) * (1 - APART)


def _above(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2) * (1 + APART)


class Gnat:
    """A node over the entries ``index`` of a codebook: split points, distance ranges and children."""

    def __init__(self, entries: np.ndarray, index: np.ndarray | None = None, degree: int = DEGREE):
        index = np.arange(len(entries)) if index is None else index
        split, near = [0], squared(entries[index], entries[index[:1]])[:, 0]
        while len(split) < min(degree, len(index)):  # each next split point is the farthest from the others
            split.append(far := int(np.where(np.isin(np.arange(len(index)), split), -1, near).argmax()))
            near = np.minimum(near, squared(entries[index], entries[index[far:far + 1]])[:, 0])
        self.index, self.points = index[split], entries[index[split]]
        rest = np.delete(index, split)
        away = squared(entries[rest], self.points)
        owner = away.argmin(axis=1) if len(rest) else np.empty(0, int)
        self.children = []
        for j in range(len(split)):
            if (own := rest[owner == j]).size:
                d = away[owner == j]
                child = Gnat(entries, own, degree) if len(own) > LEAF else (own, entries[own])
                self.children.append((j, _below(d.min(axis=0)), _above(d.max(axis=0)), child))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry to each row; the lower index of equal distances."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        at = np.full(len(x), np.iinfo(np.int64).max)
        self._search(x, np.arange(len(x)), best, at)
        return at, best

    def _search(self, x, rows, best, at):
        d2 = squared(x[rows], self.points)
        _better(rows, d2, self.index, best, at)
        low, high, own = _below(d2), _above(d2), d2.argmin(axis=1)
        for first in (True, False):  # the child of the nearest split point sets a close bound for the others
            for j, least, most, child in self.children:
                some = np.flatnonzero((own == j) == first)
                away = np.maximum(low[some] - most, least - high[some]).max(axis=1, initial=0)
                some = rows[some[away <= _above(best[rows[some]])]]
                if not len(some):
                    continue
                if isinstance(child, Gnat):
                    child._search(x, some, best, at)
                else:
                    _better(some, squared(x[some], child[1]), child[0], best, at)


def _better(rows, d2, index, best, at):
    """Whole distances decide, and of equal ones the lower index."""
    least = d2.min(axis=1)
    lowest = np.where(d2 == least[:, None], index[None, :], np.iinfo(np.int64).max).min(axis=1)
    won = (least < best[rows]) | ((least == best[rows]) & (lowest < at[rows]))
    best[rows[won]], at[rows[won]] = least[won], lowest[won]


def _assign(x: np.ndarray, trees: list[Gnat]) -> tuple[np.ndarray, np.ndarray]:
    """Entries and squared distances of all parts of all rows."""
    found = [t.nearest(p) for t, p in zip(trees, np.split(x, len(trees), axis=1), strict=True)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _sums(books: np.ndarray):
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            x = matrix(batch.column("v"), parts * width)
            code, _ = _assign(x, trees)
            for p in range(parts):
                np.add.at(count[p], code[:, p], 1)
                np.add.at(total[p], code[:, p], x[:, p * width:(p + 1) * width])
        part, entry = np.nonzero(count)
        if len(part):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]),
                 pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])
    return run


def _codes(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        for batch in batches:
            code, d2 = _assign(matrix(batch.column("v"), books.shape[0] * books.shape[2]), trees)
            digits = [bytes(row).hex() for row in code.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(digits, pa.string()),
                 pa.array(d2.sum(axis=1), pa.int64())], names=["vec_id", "label", "code", "error"])
    return run


def train(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray | None:
    """Codebooks (parts, entries, width) of whole vectors ``v``; None without rows."""
    width = -(-vectors.agg(longest("v")).first()[0] // parts)
    first = vectors.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return None
    width = max(width, 1)
    start = matrix(pa.array([r["v"] for r in first], pa.list_(pa.int64())), parts * width)
    books = start.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = (vectors.select("v").mapInArrow(_sums(books), "part int, entry int, n long, total array<long>")
                .groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(
                    *[F.sum(F.col("total")[i].cast("decimal(20,0)")) for i in range(width)]).alias("total")))
        for r in sums.collect():  # at most parts x entries rows
            books[r["part"], r["entry"]] = [int(t) // r["n"] for t in r["total"]]
    return books


def compress(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row with a usable vector."""
    if entries > 256:
        raise ValueError("a code has one byte per part")
    vectors = whole_vectors(df.select("vec_id", "embedding", "label")).select("vec_id", "label", "v")
    books = train(vectors, parts, entries, rounds)
    if books is None:
        books = np.zeros((parts, 1, 1), np.int64)
    kinds = dict(vectors.dtypes)
    coded = staged(vectors.mapInArrow(_codes(books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"),
                   "vector-codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_of")
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    return (coded.join(by_label, F.col("label").eqNullSafe(F.col("_of")))
            .select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))
