"""Sparse vectors: a column of (size, indices, values) and its rows as one compressed matrix inside a task.

One-hot and multi-hot codes hold one or a few numbers whatever their dictionary, so a wide sample is written, read and
multiplied by what it holds. Indices are increasing and below ``size``; a slot that is not named is 0.
Everything on the column side is a built-in expression.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackwise.functions.random import uniform_at

SPARSE_DDL = "struct<size: int, indices: array<int>, values: array<double>>"
SPARSE = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))])
DENSE_SLICE = 1 << 22  # numbers of a dense slice


def is_sparse(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StructType) and dtype.names == SPARSE.names


def sparse_vector(size, indices: Column, values: Column) -> Column:
    size = size if isinstance(size, Column) else F.lit(int(size))
    return F.struct(size.cast("int").alias("size"), indices.cast("array<int>").alias("indices"), values.cast("array<double>").alias("values"))


def filled(size: int, fill: float | None) -> Column:
    """The vector of a missing cell: NULL without a fill, nothing for 0, every slot else."""
    if fill is None:
        return F.lit(None).cast(SPARSE_DDL)
    if fill == 0:
        return sparse_vector(size, F.array(), F.array())
    return sparse_vector(size, F.sequence(F.lit(0), F.lit(size - 1)), F.array_repeat(F.lit(float(fill)), size))


def ones(size: int, indices: Column) -> Column:
    """1 at every index (in any order, repeated or not); indices beyond the size are left out."""
    kept = F.array_sort(F.array_distinct(F.filter(indices, lambda i: i < size)))
    return sparse_vector(size, kept, F.array_repeat(F.lit(1.0), F.size(kept)))


def from_dense(col: Column) -> Column:
    held = F.filter(F.transform(col, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~s["x"].eqNullSafe(F.lit(0.0)))
    return F.when(col.isNotNull(), sparse_vector(F.size(col), held["i"], held["x"]))


def to_dense(col: Column) -> Column:
    at = F.map_from_arrays(col["indices"], col["values"])
    slots = F.transform(F.sequence(F.lit(0), col["size"] - 1), lambda i: F.when(F.map_contains_key(at, i), F.try_element_at(at, i)).otherwise(F.lit(0.0)))
    return F.when(col.isNull(), F.lit(None)).when(col["size"] == 0, F.array().cast("array<double>")).otherwise(slots)


def concatenated(parts: Sequence[Column]) -> Column:
    """Sparse vectors one after another as one vector; NULL if one of them is."""
    def moved(indices: Column, by: Column) -> Column:
        return F.transform(indices, lambda i: i + by)

    at, indices = F.lit(0), []
    for p in parts:
        indices.append(moved(p["indices"], at))
        at = at + p["size"]
    whole = sparse_vector(at, F.flatten(F.array(*indices)), F.flatten(F.array(*(p["values"] for p in parts))))
    bad = F.lit(False)
    for p in parts:
        bad = bad | p.isNull()
    return F.when(~bad, whole)


class SparseRows:
    """Rows of a batch: row r holds ``values[k]`` at ``indices[k]`` for k from ``start[r]`` to ``start[r + 1]``."""

    def __init__(self, width: int, start: np.ndarray, indices: np.ndarray, values: np.ndarray):
        self.width, self.start, self.indices, self.values = width, start, indices, values

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.start) - 1, self.width

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))

    def times(self, m: np.ndarray) -> np.ndarray:
        """X m for a dense m of ``width`` rows."""
        out = np.zeros((self.shape[0], m.shape[1]))
        held = np.flatnonzero(np.diff(self.start))
        if len(held):
            out[held] = np.add.reduceat(m[self.indices] * self.values[:, None], self.start[held], axis=0)
        return out

    def under(self, delta: np.ndarray) -> np.ndarray:
        """delta^T X."""
        rows = self.rows
        return np.stack([np.bincount(self.indices, weights=self.values * delta[rows, j], minlength=self.width) for j in range(delta.shape[1])])

    def scaled(self, per_slot: np.ndarray) -> SparseRows:
        return SparseRows(self.width, self.start, self.indices, self.values / per_slot[self.indices])

    def kept(self, ids: np.ndarray, fraction: float, seed: int) -> SparseRows:
        """C3 on the slots that hold something: 0 where the draw lies below the fraction."""
        keep = uniform_at(np.asarray(ids)[self.rows], self.indices, seed) >= fraction
        return SparseRows(self.width, self.start, self.indices, self.values * keep)

    def dense(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        hi = self.shape[0] if hi is None else hi
        out = np.zeros((hi - lo, self.width))
        at = slice(self.start[lo], self.start[hi])
        out[np.repeat(np.arange(hi - lo), np.diff(self.start[lo:hi + 1])), self.indices[at]] = self.values[at]
        return out

    def dense_slices(self) -> Iterator[tuple[slice, np.ndarray]]:
        step = max(1, DENSE_SLICE // max(1, self.width))
        for lo in range(0, self.shape[0], step):
            hi = min(lo + step, self.shape[0])
            yield slice(lo, hi), self.dense(lo, hi)


def sparse_rows(arr: pa.StructArray, width: int | None = None) -> SparseRows:
    """Arrow structs as rows; raises on NULL, on rows of another width and on indices that are not increasing within it."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        raise ValueError("vector column holds NULL rows")
    size, at, held = (arr.field(n) for n in SPARSE.names)
    indices, values = at.flatten(), held.flatten()
    if size.null_count or at.null_count or held.null_count or indices.null_count or values.null_count:
        raise ValueError("vector column holds NULL values")
    sizes = np.unique(size.to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError("vector column has rows of different widths")
    if width is not None and len(sizes) and sizes[0] != width:
        raise ValueError(f"vector column must hold {width} numbers in every row")
    start = at.offsets.to_numpy().astype(np.int64)
    start = start - start[0]
    k, v = indices.to_numpy(zero_copy_only=False).astype(np.int64), values.to_numpy(zero_copy_only=False).astype(np.float64)
    full = int(sizes[0]) if len(sizes) else (width or 0)
    inner = np.ones(len(k), bool)
    inner[start[:-1][start[:-1] < len(k)]] = False
    if len(v) != len(k) or not np.array_equal(np.diff(start), np.diff(held.offsets.to_numpy())) or (len(k) and (k.min() < 0 or k.max() >= full or (np.diff(k) <= 0)[inner[1:]].any())):
        raise ValueError("vector column holds a sparse vector whose indices are not increasing, inside its size and as many as its values")
    return SparseRows(full, start, k, v)
