"""Dense layers whose weights are a table: products of blocks that meet by a join.

A layer of any size is a table of square blocks (out_block, in_block, weights) and of bias blocks. Rows are cut the same way:
a group of rows gives one piece per column block. Pieces and weight blocks meet by the column block, every pair is one matrix
product, and the partial products of an output block are added up as they stream by. No parameter array exists on the
driver or in one task; a task holds one block of weights, one piece of rows and one sum.

A column block is a join key of which there are few, so pieces are dealt over ``salts`` and the weights are copied to
each: keys times salts are at least the shuffle partitions, whatever the layer's shape. A task of that join keeps the
weight blocks of one column block, 0.5 MB for every 256 outputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackwise.functions.activations import np_act
from stackwise.operators.step import features_matrix
from stackwise.session import ship_package, scratch_path

BLOCK = 256   # rows and columns of a weight block
GROUP = 1024  # rows that travel together


def weight_blocks(weights: DataFrame, block: int = BLOCK) -> DataFrame:
    """(out_block, in_block, w) of a long table (out, in, w), w a full block row by row; what is not named is 0."""
    at = [F.floor(F.col(c) / block).cast("int").alias(f"{c}_block") for c in ("out", "in")]
    entry = F.struct(((F.col("out") % block) * block + F.col("in") % block).cast("int").alias("k"), F.col("w").cast("double").alias("w"))
    return _filled(weights.groupBy(*at).agg(F.collect_list(entry).alias("entries")), ["out_block", "in_block"], block * block)


def bias_blocks(bias: DataFrame, block: int = BLOCK) -> DataFrame:
    """(out_block, bias) of a long table (out, w)."""
    entry = F.struct((F.col("out") % block).cast("int").alias("k"), F.col("w").cast("double").alias("w"))
    blocks = bias.groupBy(F.floor(F.col("out") / block).cast("int").alias("out_block")).agg(F.collect_list(entry).alias("entries"))
    return _filled(blocks, ["out_block"], block).withColumnRenamed("w", "bias")


def _filled(blocks: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Lists of (k, w) as full arrays."""
    ship_package(blocks.sparkSession)

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                out, e = np.zeros(size), b.column(len(keys))[r].values
                out[e.field("k").to_numpy()] = e.field("w").to_numpy()
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(r, 1) for i in range(len(keys))), pa.array([out], pa.list_(pa.float64()))], names=[*keys, "w"])

    return blocks.select(*keys, "entries").mapInArrow(run, ", ".join(f"{k} int" for k in keys) + ", w array<double>")


def dense_blocked(df: DataFrame, col: str, weights: DataFrame, bias: DataFrame | None, act: str, out: str, *, n_in: int, n_out: int, block: int = BLOCK) -> DataFrame:
    """D3, F9 for layers larger than a task: ``act(x W^T + c)`` appended to every row.

    ``weights`` is :func:`weight_blocks`, ``bias`` :func:`bias_blocks` (or None). Rows are written once with the
    number of their group and their place in it, as the result is joined to them again. A vector that is NULL, holds NULL or is not ``n_in``
    wide raises. The order of additions is fixed, so a retried task gives the same bits.
    """
    spark = df.sparkSession
    ship_package(spark)
    if out in df.columns:
        raise ValueError(f"the table already has a column {out!r}")
    if {"_rows", "_at"} & set(df.columns):
        raise ValueError("columns _rows and _at are used by the blocked product")
    path = scratch_path(spark, "blocked-rows")
    _grouped(df, col, n_in).write.parquet(path)
    kept = spark.read.parquet(path)
    n_blocks = -(-n_in // block)
    salts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n_blocks))
    pieces = _cut(kept, col, n_in, block).withColumn("salt", F.pmod(F.col("_rows"), F.lit(salts)).cast("int"))
    # an output block without weights has products too: of nothing
    nothing = spark.range(-(-n_out // block)).select(F.col("id").cast("int").alias("out_block"), F.lit(0).alias("in_block"), F.array().cast("array<double>").alias("w"))
    copied = weights.select("out_block", "in_block", "w").union(nothing).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = pieces.join(copied, ["in_block", "salt"]).select("_rows", "out_block", "in_block", "n", "x", "w")
    partial = met.mapInArrow(_products(n_in, n_out, block), "_rows long, out_block int, in_block int, n int, y array<double>")
    ordered = partial.repartition("_rows", "out_block").sortWithinPartitions("_rows", "out_block", "in_block")
    summed = ordered.mapInArrow(_sums, "_rows long, out_block int, n int, y array<double>")
    if bias is not None:
        summed = summed.join(bias, "out_block", "left")
    else:
        summed = summed.withColumn("bias", F.lit(None).cast("array<double>"))
    active = summed.select("_rows", "out_block", "n", "y", "bias").mapInArrow(_activated(n_out, block, act), f"_rows long, _at int, out_block int, h array<double>")
    vector = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("out_block", "h"))), lambda s: s["h"]))
    rows = active.groupBy("_rows", "_at").agg(vector.alias(out))
    return kept.join(rows, ["_rows", "_at"]).select(*(F.col(f"`{c}`") for c in df.columns), out)


def _grouped(df: DataFrame, col: str, width: int) -> DataFrame:
    """The rows with the number of their group and their place in it; vectors are checked on the way."""
    schema = T.StructType([*df.schema.fields, T.StructField("_rows", T.LongType()), T.StructField("_at", T.IntegerType())])

    def run(batches):
        number, at = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            if not b.num_rows:
                continue
            features_matrix(b.column(col), width)
            place = np.arange(at, at + b.num_rows)
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number + place // GROUP), pa.array((place % GROUP).astype(np.int32))], names=[*b.schema.names, "_rows", "_at"])

    return df.mapInArrow(run, schema)


def _cut(kept: DataFrame, col: str, width: int, block: int) -> DataFrame:
    """(_rows, in_block, n, x): column blocks of a group's rows, in the order of their places."""
    group = kept.groupBy("_rows").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(col).alias("v")))), lambda s: s["v"]).alias("vs"))

    def run(batches):
        for b in batches:
            for number, vs in zip(b.column(0).to_pylist(), b.column(1)):
                X = features_matrix(vs.values, width)
                X = X if isinstance(X, np.ndarray) else X.dense()
                cut = [X[:, i:i + block].ravel() for i in range(0, width, block)]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(cut), pa.int64()), pa.array(range(len(cut)), pa.int32()), pa.array([len(X)] * len(cut), pa.int32()),
                                                  pa.array(cut, pa.list_(pa.float64()))], names=["_rows", "in_block", "n", "x"])

    return group.select("_rows", "vs").mapInArrow(run, "_rows long, in_block int, n int, x array<double>")


def _products(n_in: int, n_out: int, block: int):
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                j, i, n = (b.column(c)[r].as_py() for c in (1, 2, 3))
                high, wide = min(block, n_out - j * block), min(block, n_in - i * block)
                w = b.column(5)[r].values.to_numpy()
                if len(w):
                    y = b.column(4)[r].values.to_numpy().reshape(n, wide) @ w.reshape(block, block)[:high, :wide].T
                else:
                    y = np.zeros((n, high))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(r, 1) for c in (0, 1, 2, 3)), pa.array([y.ravel()], pa.list_(pa.float64()))],
                                                 names=["_rows", "out_block", "in_block", "n", "y"])
    return run


def _sums(batches):
    key, n, acc = None, 0, None
    names = ["_rows", "out_block", "n", "y"]

    def row():
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([n], pa.int32()), pa.array([acc], pa.list_(pa.float64()))], names=names)

    for b in batches:
        for r in range(b.num_rows):
            now = b.column(0)[r].as_py(), b.column(1)[r].as_py()
            y = b.column(4)[r].values.to_numpy()
            if now == key:
                acc = acc + y
            else:
                if key is not None:
                    yield row()
                key, n, acc = now, b.column(3)[r].as_py(), y.copy()
    if key is not None:
        yield row()


def _activated(n_out: int, block: int, act: str):
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                j, n = b.column(1)[r].as_py(), b.column(2)[r].as_py()
                high = min(block, n_out - j * block)
                c = b.column(4)[r].values.to_numpy()[:high] if b.column(4)[r].is_valid else np.zeros(high)
                H = np_act(act, b.column(3)[r].values.to_numpy().reshape(n, high) + c)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[r].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([j] * n, pa.int32()),
                                                  pa.array(list(H), pa.list_(pa.float64()))], names=["_rows", "_at", "out_block", "h"])
    return run
