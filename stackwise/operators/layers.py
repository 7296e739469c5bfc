"""Dense projections of wide layers on Arrow batches (numpy), appended as a new column.

Small layers are better served by :func:`stackwise.functions.vectors.dense` (code-generated
arithmetic); above ``EXPRESSION_MAX`` weights the expression would be too large, so the layer
is applied per Arrow batch instead, with the same results and the same errors. Parameters
travel as a broadcast variable.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackwise.functions import vectors as V
from stackwise.functions.activations import np_act
from stackwise.functions.sparse import SparseRows, is_sparse
from stackwise.operators.step import features_matrix, times
from stackwise.session import ship_package


def arrow_list(M: np.ndarray) -> pa.Array:
    n, w = M.shape
    offsets = pa.array(np.arange(0, (n + 1) * w, w, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(M).ravel(), type=pa.float64()))


def dense_arrow(df: DataFrame, col: str, W: np.ndarray, c: np.ndarray | None, act: str, out: str,
                scale: np.ndarray | None = None) -> DataFrame:
    ship_package(df.sparkSession)
    W = np.asarray(W, dtype=float)
    c = np.zeros(W.shape[0]) if c is None else np.asarray(c, dtype=float).reshape(-1)
    s = None if scale is None else np.asarray(scale, dtype=float)
    sent = df.sparkSession.sparkContext.broadcast({"W": W, "c": c, "s": s})  # the context cleaner drops it with the frame
    made = T.StructField(out, T.ArrayType(T.DoubleType()))
    fields = [made if f.name == out else f for f in df.schema.fields]  # like withColumn: an existing column keeps its place
    schema = T.StructType(fields if made in fields else [*fields, made])
    names = schema.names

    def run(batches):
        p = sent.value
        for rb in batches:
            if rb.num_rows == 0:
                continue
            X = features_matrix(rb.column(col), p["W"].shape[1])
            if p["s"] is not None:
                X = X.scaled(p["s"]) if isinstance(X, SparseRows) else X / p["s"]
            H = np_act(act, times(X, p["W"].T) + p["c"])
            made = arrow_list(H)
            yield pa.RecordBatch.from_arrays([made if n == out else rb.column(n) for n in names], names=names)

    return df.mapInArrow(run, schema)


def dense_layer(df: DataFrame, col: str, W: np.ndarray, c: np.ndarray | None, act: str, out: str,
                scale: np.ndarray | None = None, method: str = "auto") -> DataFrame:
    """D3 at DataFrame level: code-generated expression for small layers, Arrow for wide ones and sparse vectors."""
    W = np.asarray(W, dtype=float)
    if method == "arrow" or (method == "auto" and (W.size > V.EXPRESSION_MAX or is_sparse(df.schema[col].dataType))):
        return dense_arrow(df, col, W, c, act, out, scale)
    return df.withColumn(out, V.dense(F.col(col), W, c, act, scale=scale))
