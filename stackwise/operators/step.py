"""The one distributed step every trainer uses.

``step_sums(df, fn, params)`` runs ``fn`` over the rows of ``df`` one Arrow batch at a
time (numpy, vectorised), accumulates the partial sums of each partition inside the task
and emits one small row per partition and named quantity; the partials are then added up
(see below). The driver receives only parameter-sized sums.

* One Spark job per training step; n, errors and every gradient travel together.
* No row ever leaves its task. The partials are summed by two shuffles of chunked parameter
  rows, so the driver receives one parameter set, whatever the input.
* Parameters go to the tasks as a broadcast variable, released after the step.
* ``fn`` must be a pure function of the rows and parameters (draws are seeded per row), so
  a retried or speculative task produces the same partial sums.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackwise.functions.sparse import SparseRows, sparse_rows
from stackwise.session import ship_package

FAN = 64  # tasks that share the partials of one chunk

RowFn = Callable[[Mapping[str, np.ndarray], np.ndarray | None, np.ndarray | None, np.ndarray | None], Mapping[str, np.ndarray]]


def list_matrix(arr: pa.Array, width: int | None = None) -> np.ndarray:
    """Arrow list<double> column -> 2-D numpy matrix; raises on NULL and on rows of another width."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if arr.null_count:
        raise ValueError("vector column holds NULL rows")
    if arr.flatten().null_count:
        raise ValueError("vector column holds NULL values")
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if n == 0:
        return flat.reshape(0, 0)
    if flat.size % n:
        raise ValueError("vector column has rows of different widths")
    if width is not None and flat.size != n * width:
        raise ValueError(f"vector column must hold {width} numbers in every row")
    width = flat.size // n
    lengths = np.diff(arr.offsets.to_numpy())
    if (lengths != width).any():
        raise ValueError("vector column has rows of different widths")
    return flat.reshape(n, width)


def features_matrix(arr: pa.Array, width: int | None = None) -> np.ndarray | SparseRows:
    """A batch of vectors: dense ones as a matrix, sparse ones as compressed rows."""
    return sparse_rows(arr, width) if pa.types.is_struct(arr.type) else list_matrix(arr, width)


def times(X: np.ndarray | SparseRows, m: np.ndarray) -> np.ndarray:
    """X m."""
    return X.times(m) if isinstance(X, SparseRows) else X @ m


def step_sums(
    df: DataFrame,
    fn: RowFn,
    params: Mapping[str, np.ndarray],
    shapes: Mapping[str, tuple],
    *,
    row_id: str | None = "row_id",
    features: str = "features",
    label: str | None = "label",
    width: int | None = None,
    label_width: int | None = None,
    sparse: bool = False,
    factors: Mapping[str, int] | None = None,
) -> dict[str, np.ndarray]:
    """Sum ``fn(params, ids, X, Y)`` over all rows of ``df``.

    A vector that is NULL, holds NULL or is not ``width`` (``label_width``) wide raises. Sparse features go to ``fn`` as
    :class:`SparseRows` if it takes them (``sparse``), else as dense slices of bounded size. ``factors`` names quantities of a
    row each (name -> width) that come back as the triangular factor of their QR decomposition over all rows, made by
    QR of stacked factors in the tasks and between them. ``shapes`` names every quantity ``fn`` returns with its shape; quantities absent from the
    result (empty input) come back as zeros, including ``n``.
    """
    have = df.columns
    cols = [c for c in (row_id, features, label) if c is not None and c in have]
    if features not in cols:
        raise ValueError(f"column {features!r} missing")
    if label_width is not None and label not in cols:
        raise ValueError(f"column {label!r} missing")
    sub = df if have == cols else df.select(*cols)
    spark = df.sparkSession
    ship_package(spark)

    bc = spark.sparkContext.broadcast({k: np.asarray(v) for k, v in params.items()})
    names, tall = list(shapes), dict(factors or {})
    chunk = CHUNK  # read once: the tasks and the driver must agree on it
    has_id = row_id is not None and row_id in cols
    has_label = label is not None and label in cols

    def run(batches):
        p = bc.value
        acc: dict[str, np.ndarray] = {}
        for rb in batches:
            if rb.num_rows == 0:
                continue
            ids = rb.column(row_id).to_numpy(zero_copy_only=False).astype(np.int64) if has_id else None
            X = features_matrix(rb.column(features), width)
            Y = list_matrix(rb.column(label), label_width) if has_label else None
            slices = [(slice(None), X)] if sparse or not isinstance(X, SparseRows) else X.dense_slices()
            for at, rows in slices:
                out = fn(p, None if ids is None else ids[at], rows, None if Y is None else Y[at])
                for k, v in out.items():
                    v = np.asarray(v, dtype=np.float64)
                    if k in tall:
                        acc[k] = np.linalg.qr(np.vstack([acc[k], v]) if k in acc else v, mode="r")
                    else:
                        acc[k] = acc[k] + v if k in acc else v.copy()
        if not acc:
            return
        yield _chunked_batch({k: acc[k].ravel() for k in names if k in acc}, {f"{k}{FACTOR}{w}": acc[k].ravel() for k, w in tall.items()}, chunk)

    partial = sub.mapInArrow(run, PARTIAL_SCHEMA)
    result = {k: np.zeros(int(np.prod(s)) if len(s) else 1, dtype=np.float64) for k, s in shapes.items()}
    found = {k: np.zeros((0, w)) for k, w in tall.items()}
    for r in _reduce_partials(partial):
        if FACTOR in r["name"]:
            k, w = r["name"].split(FACTOR)
            found[k] = np.linalg.qr(np.vstack([found[k], np.reshape(r["vals"], (-1, int(w)))]), mode="r")
            continue
        start = r["chunk"] * chunk
        vals = np.asarray(r["vals"], dtype=np.float64)
        result[r["name"]][start:start + vals.size] += vals
    bc.destroy()
    return {**{k: (v.reshape(shapes[k]) if len(shapes[k]) else float(v[0])) for k, v in result.items()}, **found}


PARTIAL_SCHEMA = T.StructType([T.StructField("name", T.StringType()), T.StructField("chunk", T.IntegerType()),
                               T.StructField("vals", T.ArrayType(T.DoubleType()))])
CHUNK = 1 << 16  # values per partial row
FACTOR = "#"     # a partial named name#width is a triangular factor, always one row


def _chunked_batch(acc: Mapping[str, np.ndarray], factors: Mapping[str, np.ndarray], chunk: int) -> pa.RecordBatch:
    names, chunks, vals = list(factors), [0] * len(factors), list(factors.values())
    for k, v in acc.items():
        for c in range(max(1, -(-v.size // chunk))):
            names.append(k)
            chunks.append(c)
            vals.append(v[c * chunk:(c + 1) * chunk])
    return pa.RecordBatch.from_arrays(
        [pa.array(names, type=pa.string()), pa.array(chunks, type=pa.int32()), pa.array(vals, type=pa.list_(pa.float64()))],
        names=["name", "chunk", "vals"])


def _sum_partials(batches):
    """Streaming sum (or QR, of factors) of partial rows per (name, chunk) inside one task."""
    acc: dict[tuple, np.ndarray] = {}
    for rb in batches:
        names = rb.column("name").to_pylist()
        chunks = rb.column("chunk").to_pylist()
        vals = rb.column("vals")
        for i in range(rb.num_rows):
            v = vals[i].values.to_numpy(zero_copy_only=False)
            key = (names[i], chunks[i])
            if FACTOR in names[i]:
                r = v.reshape(-1, int(names[i].split(FACTOR)[1]))
                acc[key] = np.linalg.qr(np.vstack([acc[key].reshape(-1, r.shape[1]), r]) if key in acc else r, mode="r").ravel()
            elif key in acc:
                acc[key] += v
            else:
                acc[key] = v.astype(np.float64, copy=True)
    if acc:
        keys = list(acc)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], type=pa.string()), pa.array([k[1] for k in keys], type=pa.int32()),
             pa.array([acc[k] for k in keys], type=pa.list_(pa.float64()))], names=["name", "chunk", "vals"])


def _reduce_partials(partial: DataFrame):
    """Rows (name, chunk, vals) whose sum per (name, chunk) is the total, a few per (name, chunk).

    Partials are dealt by (name, chunk, salt) and summed in a stream, then by (name, chunk). Adaptive
    execution merges the shuffle partitions of small steps into one task.
    """
    salted = partial.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    level1 = salted.repartition("name", "chunk", "salt").drop("salt").mapInArrow(_sum_partials, PARTIAL_SCHEMA)
    return level1.repartition("name", "chunk").mapInArrow(_sum_partials, PARTIAL_SCHEMA).collect()
