"""What the operators on vectors share: which rows take part, and vectors as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """The vector is there, and so are all its entries, none of which is NaN or infinite."""
    inside = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vector.isNotNull() & inside & (F.size(vector) > 0)


def main_length(rows: DataFrame, vector: str) -> int:
    """The most frequent length (of equally frequent ones the largest); 0 if there is no row."""
    best = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return best[0]["d"] if best else 0


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """The lists of a column, all of one length, as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def list_array(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), pa.array(values.ravel()))
