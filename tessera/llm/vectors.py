"""Vectors as Arrow columns: which take part, and as doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A fixed width for random projections and folds.
SEED = 20240229


def dimension(df: DataFrame, column: str) -> int:
    """The most common length of the vectors (the smaller of two); vectors of other lengths take no part."""
    got = df.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return int(got["n"]) if got else 0


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the vectors that take part, and those as doubles: not null or zero, finite, of length dim."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    whole = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False) if len(column.values) else np.zeros(0)
    ok = np.diff(offsets) == dim
    if column.null_count:
        ok &= column.is_valid().to_numpy(zero_copy_only=False)
    if not dim:
        ok &= False
    at = np.flatnonzero(ok)
    x = whole[offsets[at][:, None] + np.arange(dim)] if len(at) else np.zeros((0, dim))
    good = np.isfinite(x).all(1)  # a null component became NaN
    with np.errstate(over="ignore"):
        norm = np.sqrt((x * x).sum(1))
    good &= (norm > 0) & np.isfinite(norm)
    return at[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the same for the same two vectors wherever they stand."""
    return np.clip((a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))), -1, 1)
