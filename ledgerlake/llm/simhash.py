"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are cut into tiles in order of their population count; two tiles are
compared by numpy exclusive-or and bit counts, unless their population counts differ by more
than the radius. So that the tiles compared grow far slower than all pairs of tiles, they are
built within exact buckets: of ``radius + 2`` blocks of bits, fingerprints within ``radius`` bits agree fully on two,
so every such pair meets in a bucket of two equal blocks (about 21 bits), and no pair
is missed. A compared tile pair returns its links as a spanning forest, not as all pairs.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import small_batches, staged, text_or_empty
from ledgerlake.llm.components import components
from ledgerlake.llm.textstats import word_bounds

SHINGLE, RADIUS, TILE = 4, 4, 1024
EQUAL = 2  # blocks that a bucket's fingerprints agree on


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of word shingles (A-Z lower-cased, XXH64 with seed 42); 0 without words."""
    import numpy as np
    import xxhash
    digest = xxhash.xxh64_digest
    words = text.encode().lower().split()  # bytes: lower-cases A-Z, splits at ASCII white space
    if not words:
        return 0
    joined, begins, ends = word_bounds(words)
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    ones, chunk = np.zeros(64, np.int64), 1 << 16
    for at in range(0, n, chunk):
        hashes = b"".join([digest(joined[b:e], 42) for b, e in zip(begins[at:min(n, at + chunk)].tolist(),
                                                                  last[at:at + chunk].tolist())])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(_id, _fp) of every whole text; null text counts as empty."""
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(F.col(text_col)).alias("_t"))
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            prints = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["_id", "_fp"])

    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, _fp bigint")


def tile_forest(a, b, radius: int):
    """Links within ``radius`` bits between tiles ``a`` and ``b`` (or within ``a``), as stars: nodes and their centres."""
    import numpy as np
    x = np.asarray(a, np.int64).view(np.uint64)
    y = x if b is None else np.asarray(b, np.int64).view(np.uint64)
    near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
    if near.sum() <= (len(x) if b is None else 0):
        return np.empty(0, np.int64), np.empty(0, np.int64)  # each fingerprint is near itself only
    left, right = np.arange(len(x)), np.arange(len(y)) + (0 if b is None else len(x))
    far = len(x) + len(y)
    while True:
        new_right = np.minimum(right, np.where(near, left[:, None], far).min(axis=0))
        new_left = np.minimum(left, np.where(near, new_right[None, :], far).min(axis=1))
        if b is None:
            new_left = new_right = np.minimum(new_left, new_right)
        if (new_left == left).all() and (new_right == right).all():
            break
        left, right = new_left, new_right
    own = x if b is None else np.concatenate([x, y])
    label = left if b is None else np.concatenate([left, right])
    node = np.flatnonzero(label != np.arange(len(own)))
    return own[node].view(np.int64), own[label[node]].view(np.int64)


def block_keys(radius: int, equal: int = EQUAL) -> list[tuple[tuple[int, int], ...]]:
    """The choices of ``equal`` blocks, as (first bit, bits), out of ``radius + equal`` that 64 bits are cut into.

    Fingerprints that differ in ``radius`` bits differ in as many blocks at most, so they agree on one of the choices.
    """
    n = radius + equal
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [tuple((cuts[i], cuts[i + 1] - cuts[i]) for i in some) for some in combinations(range(n), equal)]


def tiles_of(prints: DataFrame, radius: int, tile: int) -> DataFrame:
    """Buckets (i, v) of fingerprints that agree on a choice of blocks, cut into tiles t by population count."""
    def value(blocks):
        at, v = 0, F.lit(0).cast("long")
        for first, bits in blocks:
            v, at = v.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1)), at)), at + bits
        return v

    keys = [F.struct(F.lit(i).alias("i"), value(blocks).alias("v")) for i, blocks in enumerate(block_keys(radius))]
    spread = prints.select("fp", F.bit_count("fp").alias("ones"), F.explode(F.array(*keys)).alias("k")).select("fp", "ones", "k.i", "k.v")
    nth = F.row_number().over(Window.partitionBy("i", "v").orderBy("ones", "fp"))
    return (spread.withColumn("t", F.floor((nth - 1) / F.lit(tile)).cast("int")).groupBy("i", "v", "t")
            .agg(F.collect_list("fp").alias("fps"), F.min("ones").alias("low"), F.max("ones").alias("high"))
            .where((F.size("fps") > 1) | (F.col("t") > 0)))


def tile_pairs(tiles: DataFrame, radius: int) -> DataFrame:
    """(i, v, t, t2): the tiles of a bucket that population counts do not rule out, by their numbers alone."""
    heads = tiles.select("i", "v", "t", "low", "high")
    later = heads.select("i", "v", F.col("t").alias("t2"), F.col("low").alias("low2"))
    return heads.join(later.where("t2 > 0"), ["i", "v"]).where(
        (F.col("t") < F.col("t2")) & (F.col("low2") - F.col("high") <= radius)).select("i", "v", "t", "t2")


def near_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b) links that connect the distinct fingerprints (column ``fp``) within ``radius`` bits."""
    tiles = staged(tiles_of(prints, radius, tile), "simhash-tiles")
    within = tiles.where(F.size("fps") > 1).select("fps", F.lit(None).cast("array<bigint>").alias("other"))
    content = tiles.select("i", "v", "t", "fps")
    # pairs are made of numbers; a pair's earlier tile then travels to its later one
    across = (tile_pairs(tiles, radius).join(content, ["i", "v", "t"])
              .join(content.toDF("i", "v", "t2", "other"), ["i", "v", "t2"]).select("fps", "other"))

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):  # a pair's links go out before the next pair comes in
                links = tile_forest(a.values.to_numpy(), b.values.to_numpy() if b.is_valid else None, radius)
                if len(links[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in links], names=["a", "b"])

    return within.unionByName(across).mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the least id among the documents reachable over links of ``radius`` bits
    or fewer. Null and blank texts have fingerprint zero, linked like any other. Rows with a null
    id have a component too (null where all its ids are null); repeated rows stay. An empty table
    gives no rows. Other columns are ignored.
    """
    rows = staged(fingerprints(docs, id_col, text_col, shingle), "simhash-rows")
    prints = staged(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min("_id").alias("least")), "simhash-prints")
    roots = components(near_links(prints.select("fp"), radius, tile), "simhash-links")
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    answer = staged(rooted.join(firsts, F.col("root") == F.col("r")).select("fp", "component_id"), "simhash-answer")
    return rows.join(answer, F.col("_fp") == F.col("fp")).select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One document of each component, all columns: the one with the least id.

    Rows that repeat that id all stay only if they are rows of one document; ids are taken as keys.
    Documents with a null id stay where no id is known in their component.
    """
    found = near_duplicates(docs, id_col, text_col, **how)
    first = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__keep")).distinct()
    return docs.join(first, docs[id_col].eqNullSafe(first["__keep"]), "left_semi")
