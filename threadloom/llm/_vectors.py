"""Vectors as Arrow columns and NumPy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """_id, _v and more columns, of rows with an id and a vector that has only finite components, not all zero."""
    ok = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector_col, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_v"), *more).where(F.col("_id").isNotNull() & ok.alias("_ok"))


def by_length(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their matrix) for each length of the vectors of a batch."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    rows = [np.flatnonzero(sizes == n) for n in np.unique(sizes)]
    return [(r, matrix(column.take(pa.array(r)))) for r in rows]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of every entry of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray([len(x) if x is not None else 0 for x in column.to_pylist()], dtype=np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), np.asarray(column.flatten().to_numpy(zero_copy_only=False))
