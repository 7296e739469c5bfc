"""Global aggregates over vector columns.

Each is one aggregation over the rows (partial per partition, then a tiny final merge);
results come back long form ``(unit, value)`` / ``(out, in, value)`` as DataFrames.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackwise.functions import vectors as V
from stackwise.operators.step import list_matrix
from stackwise.session import ship_package


def _width(df: DataFrame, col: str) -> int:
    return len(df.select(col).first()[0])


def count_samples(df: DataFrame) -> DataFrame:
    """E1."""
    return df.agg(F.count(F.lit(1)).cast("long").alias("n"))


def _long(df_one_row: DataFrame, names: list, key: str = "unit") -> DataFrame:
    stack = ", ".join(f"{i}, `{n}`" for i, n in enumerate(names))
    return df_one_row.selectExpr(f"stack({len(names)}, {stack}) AS ({key}, value)")


def vector_mean(df: DataFrame, col: str = "features", width: int | None = None) -> DataFrame:
    """Elementwise mean of a vector column -> (unit, value)."""
    w = width or _width(df, col)
    one = df.agg(*[F.avg(F.col(col)[i]).alias(f"u{i}") for i in range(w)])
    return _long(one, [f"u{i}" for i in range(w)])


def outer_product_mean(df: DataFrame, left: str = "label", right: str = "features") -> DataFrame:
    """Mean over rows of left^T . right as (out, in, value): numpy per Arrow batch, one row per task and
    product, summed by one aggregation. The widths are found inside the pass, so the input is read once."""
    ship_package(df.sparkSession)

    def run(batches):
        acc, n = None, 0
        for rb in batches:
            if rb.num_rows:
                y, x = list_matrix(rb.column(0)), list_matrix(rb.column(1))
                acc = y.T @ x if acc is None else acc + y.T @ x
                n += rb.num_rows
        if acc is not None:
            j, i = np.indices(acc.shape, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(j.ravel()), pa.array(i.ravel()), pa.array(acc.ravel()), pa.array(np.full(acc.size, n, np.int64))],
                                             names=["out", "in", "s", "n"])

    partial = df.select(F.col(left).alias("left"), F.col(right).alias("right")).mapInArrow(run, "out int, `in` int, s double, n long")
    return partial.groupBy("out", "in").agg((F.sum("s") / F.sum("n")).alias("value"))


def reconstruction_error(df: DataFrame, original: str, reconstructed: str) -> DataFrame:
    """Mean over rows of ||v0 - v1||^2."""
    return df.agg(F.avg(V.squared_distance(original, reconstructed)).alias("error"))


def half_mse(df: DataFrame, error: str = "error") -> DataFrame:
    """E5: 0.5 * mean over rows of ||e||^2."""
    return df.agg((F.lit(0.5) * F.avg(V.squared_norm(error))).alias("loss"))


def tuple_sum(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    """Several sums in one pass (one aggregation, one row)."""
    return df.agg(*[F.sum(e).alias(k) for k, e in exprs.items()])


def mean_activation(df: DataFrame, col: str, old: np.ndarray, decay: float = 0.99, width: int | None = None) -> DataFrame:
    """Running average activity 0.01 * batch mean + decay * old, per unit."""
    w = width or _width(df, col)
    old = np.asarray(old, dtype=float).reshape(-1)
    one = df.agg(*[(F.lit(0.01) * F.avg(F.col(col)[i]) + F.lit(float(decay) * float(old[i]))).alias(f"u{i}")
                   for i in range(w)])
    return _long(one, [f"u{i}" for i in range(w)])
