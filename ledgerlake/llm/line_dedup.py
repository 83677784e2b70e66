"""Fuzzy line deduplication by MinHash, with Spark expressions only.

1. Distinct lines (map-side combined) are exploded into character shingles of ``SHINGLE`` code
   points. One 64-bit hash a shingle gives all minima: rotated by 0, 16, 32 or 48 bits and
   exclusive-or-ed with one of ``MASKS``, its least value over the line is one MinHash. The
   aggregate keeps ``4 * ROWS`` minima a line and needs no shuffle beyond that of the distinct lines.
2. A band is four minima, one of each rotation. The minima form a grid of ``ROWS`` by four; bands
   are its rows and its diagonals, so each minimum serves in two bands. Lines of similarity 0.8
   share a band with probability 0.991, of 0.85 with 0.998, of 0.9 with 0.9998.
3. A bucket's hub is its line that meets most others over all its buckets (pairs with a hub form a star, not
   all pairs). Every line is compared with one hub by the exact Jaccard similarity of the shingle sets, then with its
   other hubs and with a second hub of the lines outside the first one's component, but only across components.
   Links from ``SIMILARITY`` on join.
4. A line may still be similar to another line of its hub though not to the hub. Then the two must share
   more than a given part of their differences from the hub (see ``_open_pairs``), so an index over
   that part of the differences finds every such pair, and the exact similarity decides. No link of a
   bucket is lost: lines left outside meet the hub's component at the first hub and one another at the second.
5. Components come from distributed star contraction; the first line of each stays.

Lines are identified by a 64-bit hash in steps 1 to 4 and by that hash and a second one where lines are
dropped, so a clash costs a fuzzy link at worst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import discard, staged, text_or_empty
from ledgerlake.llm.components import components

SHINGLE, ROWS, SIMILARITY = 8, 6, 0.8
# shingles of a line that one row brings to the aggregate: one look-up and one update of the minima for all of them
BATCH = 8


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


# multiples of the golden ratio: masks whose leading bits are spread evenly
MASKS = [_signed(i * 0x9E3779B97F4A7C15) for i in range(ROWS)]
# (mask row of each of the four rotations), for every band
BANDS = [[(slope * r + c) % ROWS for r in range(4)] for slope in (0, 1) for c in range(ROWS)]


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _doc, _no, _line, _k, _k2): the lines that hold a character other than white space."""
    text = text_or_empty(F.col(text_col))
    lines = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_doc"),
                        F.posexplode(F.split(text, "\n")).alias("_no", "_line"))
    lines = lines.where(F.col("_line").rlike(r"[^\x20\x09-\x0D]"))
    return lines.withColumns({"_k": F.xxhash64("_line"), "_k2": _second(F.col("_line"))})


def _second(line: Column) -> Column:
    """A second hash, for where lines are dropped."""
    return F.xxhash64(F.lit(1), line)


def _offsets(chars: Column) -> Column:
    """Where each shingle of a line begins, in bytes of UTF-32 (four a code point), from 1."""
    return F.sequence(F.lit(1), F.greatest(chars - F.lit(SHINGLE - 1), F.lit(1)) * 4 - 3, F.lit(4))


def _shingle_hash(utf32: Column, offset: Column) -> Column:
    return F.xxhash64(F.substr(utf32, offset, F.lit(4 * SHINGLE)))  # a slice, however long the line


def _rotated(h: Column, bits: int) -> Column:
    return F.shiftleft(h, bits).bitwiseOR(F.shiftrightunsigned(h, 64 - bits)) if bits else h


def _hashed(lines: DataFrame) -> DataFrame:
    """(_k, _line) -> _k and _h{j}_{r}: hash j of ``BATCH`` neighbouring shingles, rotated r times by 16 bits.

    The last row of a line repeats the last shingle, which no minimum minds.
    """
    last = F.greatest(F.length("_line") - SHINGLE, F.lit(0))
    # encoded below the explode, so once a line
    encoded = lines.select("_k", F.encode("_line", "UTF-32").alias("_b"), last.alias("_last"))
    rows = encoded.select("_k", "_b", "_last", F.explode(F.sequence(F.lit(0), F.col("_last"), F.lit(BATCH))).alias("_p"))
    hashes = rows.select("_k", *[_shingle_hash(F.col("_b"), F.least(F.col("_p") + j, F.col("_last")) * 4 + 1).alias(f"_h{j}")
                                 for j in range(BATCH)])
    return hashes.select("_k", *[_rotated(F.col(f"_h{j}"), 16 * r).alias(f"_h{j}_{r}") for j in range(BATCH) for r in range(4)])


def _bands(lines: DataFrame) -> DataFrame:
    """(_k, _line) distinct lines -> (_k, _band), one row for each band of a line."""
    minima = _hashed(lines).groupBy("_k").agg(*[
        F.min(F.least(*[F.col(f"_h{j}_{r}").bitwiseXOR(F.lit(m)) for j in range(BATCH)])).alias(f"m{r}_{i}")
        for i, m in enumerate(MASKS) for r in range(4)])
    keys = [F.xxhash64(F.lit(n), *[F.col(f"m{r}_{i}") for r, i in enumerate(band)]) for n, band in enumerate(BANDS)]
    return minima.select("_k", F.explode(F.array(*keys)).alias("_band"))


def candidates(lines: DataFrame) -> DataFrame:
    """Lines that share a bucket with another: _k, _k2, _line, _in (its buckets). Of lines with one ``_k`` one stands here."""
    distinct = lines.groupBy("_k").agg(F.max("_line").alias("_line"))
    shared = (_bands(distinct).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_band")))
              .where("_n > 1").groupBy("_k").agg(F.collect_list("_band").alias("_in")))
    return distinct.join(shared, "_k").withColumn("_k2", _second(F.col("_line")))


def hubs(within: DataFrame) -> DataFrame:
    """(_band, _k) lines in buckets -> with _hub, the bucket's line that meets most lines in all its buckets, and how
    many it meets, _met."""
    bucket = Window.partitionBy("_band")
    met = within.withColumn("_n", F.count(F.lit(1)).over(bucket)).where("_n > 1").withColumn(
        "_met", F.sum("_n").over(Window.partitionBy("_k")))
    hub = F.max(F.struct("_met", F.col("_k").alias("_hub"))).over(bucket)
    return met.select("_band", "_k", hub.alias("_h")).select("_band", "_k", "_h.*").where("_k <> _hub")


def _shingles(line: Column) -> Column:
    # the one-element array holds the encoded line, so that it is encoded once
    return F.transform(F.array(F.encode(line, "UTF-32")), lambda u: F.transform(
        _offsets((F.octet_length(u) / 4).cast("int")), lambda p: _shingle_hash(u, p)))[0]


def jaccard(a: Column, b: Column) -> Column:
    """Exact similarity of two shingle sets, given as arrays that may repeat members."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def _with_lines(pairs: DataFrame, found: DataFrame) -> DataFrame:
    text = found.select("_k", "_line")
    return pairs.join(text.toDF("_a", "_x"), "_a").join(text.toDF("_b", "_y"), "_b")


def _with_shingles(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs with the shingles of both lines, _x and _y: columns, as set functions run compiled on columns only."""
    return _with_lines(pairs, found).select(*pairs.columns, _shingles(F.col("_x")).alias("_x"), _shingles(F.col("_y")).alias("_y"))


def _compared(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(_a, _b, _j): pairs of lines with their similarity."""
    return _with_shingles(pairs, found).select("_a", "_b", jaccard(F.col("_x"), F.col("_y")).alias("_j"))


def _similar(pairs: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """The (_a, _b) pairs of lines that are similar."""
    # written first: a filter above the comparison would be pushed below the shingles and make them again
    return staged(_compared(pairs, found), "line-compared").where(F.col("_j") >= similarity).select("_a", "_b")


def line_links(lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of the lines that are similar to another: see ``components``."""
    found = staged(candidates(lines), "line-candidates")
    return _links(found, similarity)[0]


def _links(found: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The links' components, and (_k, _k2) of all lines in them."""
    first = hubs(found.select("_k", F.explode("_in").alias("_band")))
    # A line is compared with one hub first: the one of its buckets that meets most lines.
    lead = F.max(F.struct("_met", "_hub")).over(Window.partitionBy("_k"))["_hub"]
    first = staged(first.select("_band", "_k", "_hub", (lead == F.col("_hub")).alias("_lead")), "line-hubs")
    star = first.where("_lead").select(F.col("_hub").alias("_a"), F.col("_k").alias("_b")).distinct()
    seen = staged(_compared(star, found), "line-compared")
    linked = F.col("_j") >= similarity
    near = components(seen.where(linked).select("_a", "_b"), "line-near")
    # Then with the other hubs, and with a second one among the lines outside the hub's component, but only where
    # two components are left.
    apart = staged(_placed(first, near).where("_out").select("_band", "_k", "_hub", "_lead"), "line-apart")
    second = staged(hubs(apart.select("_band", "_k")), "line-second")
    rest = apart.where("NOT _lead").select("_hub", "_k").union(_placed(second, near).where("_out").select("_hub", "_k")).distinct()
    again = staged(_compared(rest.toDF("_a", "_b"), found), "line-compared")
    roots = components(near.toDF("_a", "_b").union(again.where(linked).select("_a", "_b")), "line-near")
    discard(near, apart)
    seen = seen.union(again)
    pairs = _open_pairs(first, seen, roots, found, similarity, False).union(
        _open_pairs(second, seen, roots, found, similarity, True))
    more = _similar(pairs.distinct(), found, similarity)
    out = components(roots.toDF("_a", "_b").union(more), "line-components")
    ends = out.select(F.col("node").alias("_k")).union(out.select("root")).distinct()
    return out, found.select("_k", "_k2").join(ends, "_k", "left_semi")


def _placed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with _k and _hub, and with _c, the line's component, and _out: the hub is of another."""
    node, root = F.col("node"), F.col("root")
    return rows.join(roots.select(node.alias("_k"), root.alias("_rk")), "_k", "left").join(
        roots.select(node.alias("_hub"), root.alias("_rh")), "_hub", "left").select(
        *rows.columns, F.coalesce("_rk", "_k").alias("_c"), (F.coalesce("_rk", "_k") != F.coalesce("_rh", "_hub")).alias("_out"))


def _open_pairs(first: DataFrame, seen: DataFrame, roots: DataFrame, found: DataFrame, similarity: float, outside: bool) -> DataFrame:
    """(_a, _b): lines of one hub, in different components, that may be similar.

    One is outside the hub's component; the other is of it or, with ``outside``, of any but the first's.

    Sets x and y are similar if they differ in at most ``r * (|x| + |y|)`` members, with
    ``r = (1 - similarity) / (1 + similarity)``. Dx are the members in which x differs from the hub h.
    x and y differ in ``|Dx| + |Dy| - 2 * |Dx & Dy|`` members, so similar ones share at least
    ``o = (|Dx| + |Dy| - r * (|x| + |y|)) / 2`` differences. One of two lines in different components is
    not similar to h: call it x, so ``|Dx| > r * (|x| + |h|)`` and ``o > t = (|Dy| + r * (|h| - |y|)) / 2``,
    which is no less than 0. Differences are kept in one order for all lines of a hub, the rarest first. The first shared
    one then stands among the first ``|Dy| - floor(t)`` of y and, as no similar y is larger than ``|x| / similarity``, among
    the first ``|Dx| + 1 - (|Dx| - r * (|x| + |x| / similarity)) / 2`` of x, and at least o members follow it, itself
    included, in both lists. Those that one line alone has are shared by none.
    Members count by 32 bits of their hash; a clash makes a needless pair at worst. Pairs whose distances from the hub
    differ by more than 1 - similarity are left out before that.
    """
    at = _placed(first.select("_hub", "_k").distinct(), roots).toDF("_a", "_b", "_c", "_out")
    at = staged(at.join(seen, ["_a", "_b"], "left").withColumn("_far", 1 - F.col("_j")).drop("_j"), "line-placed")
    # Jaccard distance is a metric: similar lines lie about equally far from the hub. All lines outside the hub's
    # component have been compared with it; one that has not been may lie at any distance.
    apart, inner = F.lit(1 - similarity + 1e-9), F.lit(outside) | ~F.col("_out")
    mixed = at.groupBy("_a").agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi"),
                                 F.min(F.when(F.col("_out"), F.coalesce("_far", F.lit(0.0)))).alias("_least"),
                                 F.max(F.when(inner, F.coalesce("_far", F.lit(1.0)))).alias("_most"))
    mixed = mixed.where((F.col("_lo") != F.col("_hi")) & (F.col("_least") <= F.col("_most") + apart)).select("_a", "_least", "_most")
    at = at.join(mixed, "_a").where(
        (F.col("_out") & (F.coalesce("_far", F.lit(0.0)) <= F.col("_most") + apart))
        | (inner & (F.coalesce("_far", F.lit(1.0)) >= F.col("_least") - apart))).select("_a", "_b", "_c", "_out")
    r = (1 - similarity) / (1 + similarity)

    x, y = F.col("_x"), F.col("_y")
    lost_or_new = F.transform(F.concat(F.array_except(y, x), F.array_except(x, y)), lambda h: F.shiftright(h, 32).cast("int"))
    at = _with_shingles(at, found).select(
        F.col("_a").alias("_hub"), "_b", "_c", "_out", lost_or_new.alias("_d"),
        F.size(F.array_distinct(x)).alias("_nx"), F.size(F.array_distinct(y)).alias("_ny"))
    at = staged(at, "line-differences")
    nd, n, nx = F.size("_d"), F.col("_ny"), F.col("_nx")
    head = at.select("_hub", "_b", "_c", "_out", n.alias("_n"), nd.alias("_nd"),
                     (2 * nd / (nd + n + nx)).alias("_far"), (nd - r * n).alias("_need"),
                     # how many of its differences a line is found by, and how many it looks with
                     (nd - F.floor((nd + r * (nx - n)) / 2 - 1e-6)).alias("_part"),
                     (nd + 1 - F.greatest(F.lit(1), F.ceil((nd - r * (1 + 1 / similarity) * n) / 2 - 1e-6))).alias("_looks"))
    each = at.select("_hub", "_b", F.explode("_d").alias("_d"))
    shared = each.withColumn("_often", F.count(F.lit(1)).over(Window.partitionBy("_hub", "_d"))).where("_often > 1")
    # counted from the end, so that the differences which one line alone has need no place
    from_end = Window.partitionBy("_hub", "_b").orderBy(F.desc("_often"), F.desc("_d"))
    placed = shared.select("_hub", "_b", "_d", F.row_number().over(from_end).alias("_back")).join(head, ["_hub", "_b"])
    placed = staged(placed.withColumn("_at", F.col("_nd") - F.col("_back")).drop("_back").where(
        (F.col("_out") & (F.col("_at") < F.col("_looks"))) | (inner & (F.col("_at") < F.col("_part")))), "line-index")
    # the smaller of two similar sets has at least this share of the larger one's members
    allowed = F.least("_n", "_n1") >= similarity * F.greatest("_n", "_n1") - 1e-6
    sides = ["_hub", "_b", "_c", "_n", "_far", "_nd", "_need"]
    far = placed.where(F.col("_out") & (F.col("_at") < F.col("_looks"))).select(*sides, "_at", "_d").toDF(
        "_hub", "_b1", "_c1", "_n1", "_far1", "_nd1", "_need1", "_at1", "_d")
    indexed = placed.where(inner & (F.col("_at") < F.col("_part"))).select(*sides, "_at", "_d")
    left = F.least(F.col("_nd") - F.col("_at"), F.col("_nd1") - F.col("_at1"))
    both = (far["_hub"] == indexed["_hub"]) & (far["_d"] == indexed["_d"]) & (F.col("_c") != F.col("_c1")) & (
        allowed) & (F.abs(F.col("_far") - F.col("_far1")) <= apart) & (left >= (F.col("_need") + F.col("_need1")) / 2 - 1e-6)
    return far.join(indexed, both).select(F.least("_b", "_b1").alias("_a"), F.greatest("_b", "_b1").alias("_b")).distinct()


def near_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per line that is not blank: id, line_no (from 0), class_id, class_size, kept; and text_hash.

    Lines are the parts of the text between line feeds. Equal lines, and lines connected by links
    of Jaccard similarity ``similarity`` or more over sets of eight-character shingles (shorter
    lines: the whole line is the one shingle), are one class; its first line by (id, text,
    line_no) stays, null ids first. Blank lines are no part of it and always stay. Null text has no lines;
    rows that repeat id and text count as one document. Empty tables give no rows; other columns
    are ignored.
    """
    lines = occurrences(docs, id_col, text_col)
    found = staged(candidates(lines), "line-candidates")
    roots, ends = _links(found, similarity)
    members = ends.join(roots.toDF("_k", "_root"), "_k", "left").select(
        F.col("_k").alias("_node"), F.col("_k2").alias("_node2"), F.coalesce("_root", "_k").alias("_root"))
    members = staged(members, "line-members")
    discard(found)
    # a line is a member by both hashes; one that has but the first in common with a member stays alone
    own = (F.col("_k") == F.col("_node")) & (F.col("_k2") == F.col("_node2"))
    placed = lines.select("_id", "_doc", "_no", "_k", "_k2").join(members, own, "left").select(
        "_id", "_doc", "_no", F.coalesce("_root", "_k").alias("_c"),
        F.when(F.col("_root").isNull(), F.col("_k2")).otherwise(0).alias("_c2"))
    placed = staged(placed, "line-placed")  # numbers only; the texts are not read again
    firsts = placed.groupBy("_c", "_c2").agg(F.min(F.struct("_id", "_doc", "_no")).alias("_first"),
                                             F.count(F.lit(1)).alias("class_size"))
    firsts = staged(firsts.where("class_size > 1"), "line-firsts").toDF("_f", "_f2", "_first", "class_size")
    here = F.struct("_id", "_doc", "_no")
    return placed.join(firsts, (F.col("_c") == F.col("_f")) & (F.col("_c2") == F.col("_f2")), "left").select(
        F.col("_id").alias(id_col), F.col("_no").alias("line_no"), F.col("_c").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (F.col("_first").isNull() | here.eqNullSafe(F.col("_first"))).alias("kept"), F.col("_doc").alias("text_hash"))


def drop_near_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """All rows and columns of ``docs``; the texts lose the lines that ``near_lines`` does not keep.

    No row goes: a document all of whose lines stand in earlier ones ends with an empty text.
    Null texts stay null.
    """
    gone = near_lines(docs, id_col, text_col, similarity).where(~F.col("kept")).groupBy(
        F.col(id_col).alias("__i"), F.col("text_hash").alias("__h")).agg(
        F.sort_array(F.collect_set("line_no")).alias("__gone"))
    gone = staged(gone, "line-gone")

    def rest(lines):
        # what stands between the lines that go: one slice for each gap
        before = F.concat(F.array(F.lit(-1)), F.col("__gone"))
        after = F.concat(F.col("__gone"), F.array(F.size(lines)))
        return F.flatten(F.zip_with(before, after, lambda s, e: F.slice(lines, s + 2, e - s - 1)))

    left = F.array_join(F.transform(F.array(F.split(F.col(text_col), "\n")), rest)[0], "\n")
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone["__i"]) & (F.xxhash64(text_or_empty(F.col(text_col))) == gone["__h"]), "left")
    return joined.select(*[F.when(F.col("__gone").isNull(), F.col(c)).otherwise(left).alias(c) if c == text_col else docs[c]
                           for c in docs.columns])
