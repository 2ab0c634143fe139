"""Helpers for vector columns: which rows count, whole numbers made of components, exact squared distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole components are held within +-2^27, so that squared distances of up to 64 components fit a long exactly.
LARGEST = 1 << 27
#: Distances in doubles are widened by this share before they may rule anything out; rounding is far below it.
SLACK = 1e-12


def finite(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components; a null vector is not finite."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def whole_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as an integer, held within +-LARGEST."""
    def whole(x):
        scaled = F.greatest(F.least(x.cast("double") * float(scale), F.lit(float(LARGEST))), F.lit(float(-LARGEST)))
        return F.floor(scaled).cast("int")

    return F.transform(vector, whole)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column whose lists all have ``dim`` components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def plain_products(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether squared distances of these whole numbers are exact in doubles: every sum stays below 2^53."""
    high = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    return 4 * high * high * max(a.shape[1], 1) < 1 << 53


def squared_gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``, exact; numbers too wide for doubles take 64-bit differences."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if plain_products(a, b):
        x, y = a.astype(float), b.astype(float)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)).astype(np.int64)
    out = np.empty((len(a), len(b)), np.int64)
    wide = a.astype(np.int64)
    for j, row in enumerate(b.astype(np.int64)):
        out[:, j] = ((wide - row) ** 2).sum(1)
    return out


def up(distance2) -> np.ndarray:
    """A double not below the distance whose square is given."""
    return np.sqrt(np.asarray(distance2, float)) * (1 + SLACK)


def down(distance2) -> np.ndarray:
    """A double not above the distance whose square is given."""
    return np.sqrt(np.asarray(distance2, float)) * (1 - SLACK)


def group_sums(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(groups that occur, rows in each, exact sums of the rows of each)."""
    if not len(group):
        return group, np.zeros(0, np.int64), np.zeros((0, values.shape[1]), np.int64)
    order = np.argsort(group, kind="stable")
    sorted_group = group[order]
    starts = np.flatnonzero(np.r_[True, sorted_group[1:] != sorted_group[:-1]])
    counts = np.diff(np.r_[starts, len(group)])
    return sorted_group[starts], counts, np.add.reduceat(values[order].astype(np.int64), starts, axis=0)


def one_length(vectors: DataFrame, column: str, dim: int | None) -> int | None:
    """``dim``, or the length most vectors have (the greater of equally common ones); None for an empty table."""
    if dim is not None:
        return dim
    found = vectors.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else None
