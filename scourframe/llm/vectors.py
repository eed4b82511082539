"""What the two operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column | str) -> Column:
    """Whether a vector takes part: not null, not empty, no null or non-finite component, not zero throughout."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def one_width(df: DataFrame, vector: str) -> int:
    """The number of components of all vectors, 0 if there are none; vectors of several widths are an error."""
    low, high = df.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low != high:
        raise ValueError(f"vectors have {low} to {high} components")
    return low or 0


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of lists without nulls as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as a column of lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).ravel()).cast(kind))
