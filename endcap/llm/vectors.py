"""Valid vectors of a table, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array | pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """Equally long lists without nulls as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float32()))
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(kind) if n else \
        np.empty((0, 0), kind)


def lists(m: np.ndarray) -> pa.Array:
    n, k = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(m.ravel()))


def usable() -> F.Column:
    """Neither null, empty nor zero, and no null or non-finite component."""
    v = F.col("embedding")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def valid(table: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and embedding of the vectors that take part, and their length.

    Vectors of another length than the most frequent one (the longer, of equally
    frequent ones) take no part.
    """
    rows = table.select(F.col("vec_id").cast("long"), "embedding").where(
        F.col("vec_id").isNotNull() & usable())
    sizes = rows.groupBy(F.size("embedding").alias("k")).count().orderBy(
        F.col("count").desc(), F.col("k").desc()).first()
    if sizes is None:
        return rows, 0
    return rows.where(F.size("embedding") == sizes["k"]), sizes["k"]
