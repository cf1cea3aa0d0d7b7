"""Helpers for tables of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length, as a matrix of doubles."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the vectors of each length, and their matrix."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, matrix(vectors.take(pa.array(rows)))


def sample(vectors: DataFrame, column: str, size: int) -> np.ndarray:
    """About ``size`` vectors, at most, by the hash of their components: equal vectors are taken all or none, once."""
    n = vectors.select(F.count_distinct(F.xxhash64(F.col(column)))).first()[0]  # copies do not make the sample smaller
    share = min(1.0, size / max(1, n))
    unit = F.pmod(F.xxhash64(F.col(column), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    rows = vectors.where(unit < share).select(column).distinct().orderBy(F.xxhash64(F.col(column))).limit(size).collect()
    return np.array([r[0] for r in rows], dtype=np.float64)
