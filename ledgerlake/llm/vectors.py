"""Integer vectors, as the vector operators of this subpackage use them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components this large would not keep sums of products within 63 bits; they raise.
LARGEST = 1 << 16


def whole_vectors(df: DataFrame, vector: str = "embedding", to: str = "v") -> DataFrame:
    """Rows whose vector has only finite components, with ``floor(256 x)`` of each as ``to``.

    Rows whose vector is null or holds a null or non-finite component go. A finite component beyond +-65536
    raises: its products could not be added exactly.
    """
    x = F.transform(vector, lambda c: c.cast("double"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    small = F.forall(x, lambda c: F.abs(c) <= F.lit(float(LARGEST)))
    whole = F.transform(x, lambda c: F.floor(c * F.lit(256.0)).cast("long"))
    return df.where(F.forall(x, finite)).withColumn(
        to, F.when(small, whole).otherwise(F.raise_error(F.lit("a vector component is beyond 65536"))))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of int64; shorter vectors are filled up with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    begin = np.cumsum(size) - size
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - begin[row]] = flat
    return out


def longest(v: str) -> Column:
    return F.coalesce(F.max(F.size(v)), F.lit(0))
