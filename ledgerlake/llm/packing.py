"""Best-fit packing of token sequences by minimum bin slack.

Documents are tokenised (Arrow batches), cut into pieces only where they are longer than a
sequence, and the pieces are dealt by hash into groups of about ``group`` pieces. In a group,
each bin takes the longest piece left and then the fullest feasible set of other pieces: a
dynamic program over the available lengths keeps the reachable sums as the bits of one integer,
and walking back through it gives the lengths. Those pieces are removed and the next bin opens.
A group loses about one sequence at its end, so the loss is one in thousands.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import small_batches, staged, text_or_empty


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of a text, the same as the ``tokenizers`` library's for the vocabulary file.

    That library is four times slower than the file's byte-pair ranks under ``tiktoken``; the
    tests hold both against each other. A text on which tiktoken's matcher gives up (white space of some
    hundred thousand characters in a row) goes to the library itself. With ``added_tokens`` a text is split at the file's added
    tokens first, which give their own ids, as in the library's default; without, their strings
    are ordinary text.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, added = file["model"]["vocab"], file.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("an added token that takes in its surroundings is not supported")
        # longest first: where several begin at one place, the library takes the longest
        self.added = {t["content"]: t["id"] for t in sorted(added, key=lambda t: -len(t["content"]))} if added_tokens else {}
        byte = _byte_of_char()
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if all(c in byte for c in token)}
        ranks.pop(b"<|endoftext|>", None)
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.engine = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.added)
        self.path, self.library = path, None

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit words."""
        try:
            ids = self.engine.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        except ValueError:  # the matcher's stack is full
            ids = np.array(self._by_library(text), np.uint32)
        return ids.astype("<u4", copy=False).tobytes()

    def _by_library(self, text: str) -> list[int]:
        if self.library is None:
            from tokenizers import Tokenizer
            self.library = Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = not self.added
        return self.library.encode(text, add_special_tokens=False).ids


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``total`` ids; only the first may be shorter than the capacity."""
    if total <= capacity:
        return [(0, total)]
    first = total % capacity
    starts = ([0] if first else []) + list(range(first, total, capacity))
    return [(s, (first if s == 0 and first else capacity)) for s in starts]


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and ``ids`` (binary) if asked for.

    A document is the ids of its whole text (the vocabulary's added tokens among them) and then ``end_id``; a null text is empty, so it is
    the end id alone.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(F.col(text_col)).alias("_t"))
    small_batches(docs.sparkSession)
    id_type = rows.schema["_id"].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def run(batches):
        import pyarrow as pa
        encode = Encoder(vocabulary or default_vocabulary(), added_tokens=True)
        for batch in batches:
            out = [[] for _ in range(6)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + end
                for n, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start:4 * (start + length)]
                    for column, value in zip(out, (key, n, start, length, zlib.crc32(part), part)):
                        column.append(value)
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)][:5 + with_ids],
                                             names=names[:5 + with_ids])

    schema = f"_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def fill_bins(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, by minimum bin slack. Longer ones than the capacity are errors."""
    by_length: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        by_length.setdefault(lengths[i], []).append(i)
    left = sorted(by_length)
    if left and left[-1] > capacity:
        raise ValueError("a piece is longer than a sequence")
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)

    def take(length):
        waiting = by_length[length]
        item = waiting.pop()
        if not waiting:
            del left[bisect_left(left, length)]
        return item

    n = 0
    while left:
        longest = left[-1]
        chosen = [(take(longest), longest)]
        for length in _fullest(left, by_length, capacity - longest):
            chosen.append((take(length), length))
        offset = 0
        for item, length in chosen:
            placed[item] = (n, offset)
            offset += length
        n += 1
    return placed


def _fullest(left: list[int], by_length: dict[int, list[int]], room: int) -> list[int]:
    """Available lengths whose sum comes nearest to ``room`` from below: bit s of ``reach`` says that s can be made."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for k in range(bisect_right(left, room) - 1, -1, -1):
        length = left[k]
        if length == 0:
            continue
        for _ in range(min(len(by_length[length]), room // length)):
            more = (reach | reach << length) & mask
            if more == reach:
                break
            steps.append((length, reach))
            reach = more
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> total & 1:
            taken.append(length)
            total -= length
    return taken


def pack(parts: DataFrame, capacity: int = 2048, id_col: str = "doc_id", group: int = 16384) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (both long) to the rows of ``pieces``.

    Rows with one id and piece number (repeated documents) are pieces like others. An empty
    table gives an empty result.
    """
    parts = staged(parts, "pieces")
    groups = max(1, -(-parts.count() // group))
    keyed = parts.withColumn("_g", F.pmod(F.xxhash64(F.col(id_col), "piece", "ids_crc32"), F.lit(groups)))

    def run(rows):
        rows = rows.sort_values(["length", "ids_crc32", id_col, "piece"], ascending=False, kind="stable")
        placed = fill_bins(rows["length"].tolist(), capacity)
        base = int(rows["_g"].iloc[0]) << 32
        return rows.drop(columns="_g").assign(sequence_id=[base + b for b, _ in placed],
                                              offset=[o for _, o in placed])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return keyed.groupBy("_g").applyInPandas(run, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None,
                   id_col: str = "doc_id", text_col: str = "text", group: int = 16384) -> DataFrame:
    """Pieces of all documents with their places. Null ids and repeated rows are documents like others."""
    return pack(pieces(docs, capacity, end_id, vocabulary, id_col, text_col), capacity, id_col, group)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves (sequence_id, ids as little-endian 32-bit words), from pieces with ``ids``."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    return rows.select("sequence_id", F.aggregate("_p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
