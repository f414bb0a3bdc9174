"""What the vector operators share: which vectors take part, and arrays from Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for vectors that are not null, empty or zero and hold finite numbers only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of equal length as a matrix of their own type."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths, in double precision; scaled first, so that no square overflows."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True, initial=np.finfo(float).tiny)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
