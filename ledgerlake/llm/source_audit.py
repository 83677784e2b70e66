"""Source divergence audit: which sources of a language use other words than the rest.

Token-start pointer sort. Inside an Arrow task the lower-cased text bytes of a slice of documents lie in one
buffer. Every word start is a pointer into it; the pointers are sorted by the bytes they point at (multikey
quicksort, eight bytes at a time), and a run of equal terms gives the term's occurrences and its number of
documents for each (lang, source) group. Spark adds the runs of all shards up, keeps terms by document
frequency and compares the smoothed shares of sources exactly, in integers.

Defined results:

* null text, lang and source read as ``''``; a null and an empty source are one group;
* a repeated row (same doc_id or not) is a document of its own;
* a text without words gives its group no occurrence, but the group has its rows;
* a language with no kept term has value 0 for every pair of its sources, and no ``term`` rows;
* a language with one source has no ``pair`` rows; equal values rank by item in UTF-8 order;
* an empty table gives no rows; other columns are not read, so they may have any name.

Texts are read whole; a slice ends after ``SLICE_BYTES`` or with one longer text. A task holds one slice, the
terms of a language are spread over all tasks, and a row with one number per source of the language is the
largest group that meets in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import staged

SLICE_BYTES = 4 << 20
#: Pointer slices up to this length are sorted by numpy; longer ones are partitioned around a pivot first.
CUT = 1 << 16
#: Terms still equal after so many bytes are compared as whole byte strings.
DEEP = 64
SCALE = 1_000_000_000

_LOWERED = np.zeros(256, np.uint8)
_LOWERED[0x41:0x5B] = np.arange(0x61, 0x7B)
_LOWERED[0x61:0x7B] = np.arange(0x61, 0x7B)
_LOWERED[0x80:] = np.arange(0x80, 0x100)
_LEADING = np.array([(1 << 64) - (1 << (64 - 8 * n)) for n in range(9)], np.uint64)


def _keys(windows: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes of each term as a number that sorts like them; bytes beyond the term are zero."""
    return windows[at].view(">u8").ravel().astype(np.uint64) & _LEADING[np.clip(left, 0, 8)]


def _quicksort(keys: np.ndarray) -> np.ndarray:
    """Stable order of keys by three-way partitions of pointer slices."""
    done, todo = [], [(np.arange(len(keys)), False)]
    while todo:
        part, equal = todo.pop()
        if equal:
            done.append(part)
            continue
        k = keys[part]
        if len(part) <= CUT:
            done.append(part[np.argsort(k, kind="stable")])
            continue
        some = np.sort(k[:: len(k) // 31])
        less, more = k < some[len(some) // 2], k > some[len(some) // 2]
        todo += [(part[more], False), (part[~(less | more)], True), (part[less], False)]
    return np.concatenate(done) if done else np.empty(0, int)


def sort_pointers(low: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pointers by term (equal terms stay in text order), and where a new term begins."""
    if not len(start):
        return np.empty(0, int), np.empty(0, bool)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([low, np.zeros(DEEP + 8, np.uint8)]), 8)
    keys = _keys(windows, start, size)
    order = _quicksort(keys)
    keys = keys[order]
    new = np.r_[True, keys[1:] != keys[:-1]]
    for depth in range(8, DEEP + 1, 8):
        run = np.cumsum(new) - 1
        at = np.flatnonzero((np.bincount(run)[run] > 1) & (size[order] >= depth))
        ptr = order[at]
        if not (size[ptr] > depth).any():
            break
        if depth == DEEP:
            rest = [bytes(low[s + depth:s + n]) for s, n in zip(start[ptr], size[ptr], strict=True)]
            sub = np.array(sorted(range(len(ptr)), key=lambda i: (run[at[i]], rest[i])))
            differ = [False] + [rest[a] != rest[b] for a, b in zip(sub[:-1], sub[1:], strict=True)]
        else:
            keys = _keys(windows, start[ptr] + depth, size[ptr] - depth)
            sub = np.lexsort((keys, run[at]))
            differ = np.r_[False, np.diff(keys[sub]) != 0]
        order[at] = ptr[sub]
        new[at] |= differ
    return order, new


def _runs(text: pa.Array, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Per term and group of a slice: term, group, occurrences, documents. The texts come sorted by group."""
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if offsets[-1] > offsets[0] \
        else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    low = _LOWERED[data]
    word = low != 0
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    seams = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(low))]  # words end with their text
    begins[seams] |= word[seams]
    ends[seams - 1] |= word[seams - 1]
    start = np.flatnonzero(begins).astype(np.int32)
    size = (np.flatnonzero(ends) + 1).astype(np.int32) - start
    del word, begins, ends
    order, new = sort_pointers(low, start, size)
    doc = np.searchsorted(offsets, start[order], side="right") - 1
    g = group[doc]
    first_of_doc = new.copy()
    first_of_doc[1:] |= doc[1:] != doc[:-1]
    new[1:] |= g[1:] != g[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.r_[at, len(order)])
    docs = np.add.reduceat(first_of_doc.astype(np.int64), at) if len(at) else np.empty(0, np.int64)
    n = size[order[at]]
    to = np.r_[0, np.cumsum(n)]
    terms = low[np.repeat(start[order[at]] - to[:-1], n) + np.arange(to[-1])]
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(to.astype(np.int64)), pa.py_buffer(terms)), \
        g[at], count, docs


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of each slice of a shard: lang, source, term, occurrences, documents.

    A batch is cut into slices by group, so that a slice has few groups and a term few runs.
    """
    for batch in batches:
        text = batch.column("text").cast(pa.large_string())
        names = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
        known = {x: i for i, x in enumerate(sorted(set(names)))}
        group = np.array([known[x] for x in names], np.int64)
        by_group = np.argsort(group, kind="stable")
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        ends = np.cumsum(np.diff(offsets)[by_group])
        langs, sources = (pa.array([x[k] for x in known], pa.string()) for k in (0, 1))
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            own = by_group[at:to]
            terms, g, count, docs = _runs(text.take(pa.array(own)), group[own])
            if len(g):
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(g)), sources.take(pa.array(g)), terms.cast(pa.string()),
                     pa.array(count, pa.int64()), pa.array(docs, pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])
            at = to


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences and documents of every term in every (lang, source) group."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    runs = read.mapInArrow(_shard, "lang string, source string, term string, n long, docs long")
    return runs.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)), in decimals, so that no count is too large."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + _div(F.lit(SCALE).cast("decimal(10,0)") * wide(n + 2), wide(total + 2 * kept))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so a long holds the square."""
    return _div((p - q) * (p - q), p + q)


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over a batch of terms of the divergence of every two sources of a language."""
    for batch in batches:
        lang = np.array(batch.column("lang").to_pylist(), object)
        for name in dict.fromkeys(lang):
            shares = batch.column("shares").filter(pa.array(lang == name))
            p = shares.flatten().to_numpy().reshape(len(shares), -1)
            n = p.shape[1]
            sums = np.zeros((n, n), np.int64)
            for i in range(n - 1):
                a, b = p[:, i:i + 1], p[:, i + 1:]
                sums[i, i + 1:] = ((a - b) * (a - b) // (a + b)).sum(axis=0)
            sums += sums.T
            one, other = np.nonzero(~np.eye(n, dtype=bool))
            if len(one):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(one), pa.string()), pa.array(one, pa.int32()), pa.array(other, pa.int32()),
                     pa.array(sums[one, other], pa.int64())], names=["lang", "i", "j", "value"])


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: every two sources of a language by their divergence over all kept terms. Part ``term``: a
    source's terms that it uses more than its language does, the ``top`` of highest divergence.
    """
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    kept = (term_counts(docs).groupBy("lang", "term")
            .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"),
                 F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("n"))
            .where(F.col("docs") >= least_docs).drop("docs"))
    kept = staged(kept, "audit-terms")
    totals = kept.select("lang", F.explode("n").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n_lang").alias("total_lang"))
    # One row per language with its sources in order; rows of the result of part `pair` grow with their square.
    meta = (groups.join(totals, ["lang", "source"], "left")
            .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("sources"))
            .join(langs, "lang", "left")
            .select("lang", "sources", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("total_lang", F.lit(0)).alias("total_lang")))
    meta = staged(meta, "audit-langs")

    terms = kept.join(meta, "lang")
    shares = terms.select("lang", F.transform("sources", lambda s: share(
        F.coalesce(F.try_element_at("n", s["source"]), F.lit(0)), s["total"], F.col("kept"))).alias("shares"))
    sums = (shares.mapInArrow(_pair_sums, "lang string, i int, j int, value long")
            .groupBy("lang", "i", "j").agg(F.sum("value").alias("value")))
    pairs = (meta.select("lang", "sources", F.posexplode("sources").alias("i", "one"))
             .select("lang", "i", F.col("one.source").alias("source"), F.posexplode("sources").alias("j", "other"))
             .where(F.col("i") != F.col("j"))
             .join(sums, ["lang", "i", "j"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), F.col("other.source").alias("item"),
                     F.coalesce("value", F.lit(0)).alias("value")))
    in_order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(in_order))

    by_source = terms.select("lang", "term", "kept", "total_lang", "n_lang", "n", F.explode("sources").alias("s")).select(
        "lang", F.col("s.source").alias("source"), F.col("term").alias("item"), F.try_element_at("n", "s.source").alias("n"),
        F.col("s.total").alias("total"), "kept", "total_lang", "n_lang").where(F.col("n") > 0)
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("n_lang"), F.col("total_lang"), F.col("kept"))
    own = (by_source.select("lang", "source", "item", p.alias("p"), q.alias("q")).where("p > q")
           .select("lang", "source", F.lit("term").alias("part"), "item", divergence(F.col("p"), F.col("q")).alias("value"))
           .withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= top))
    return pairs.unionByName(own)
