"""Tables and fixed-size summaries that pass between the jobs of one operator."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackwise.session import scratch_path, ship_package

__all__ = ["written", "ship", "merged_counters", "counter_rows", "arrow_batch", "COUNTER_SCHEMA"]

COUNTER_SCHEMA = "chunk int, blob binary"
_CHUNK = 1 << 16


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back.

    Later jobs read the files, so lineage is cut and a lost executor costs a re-read only.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(df: DataFrame) -> None:
    """Send the package to the Python workers, and keep their Arrow batches small, as rows hold whole texts.

    A batch size that the application was started with is left as it is.
    """
    spark = df.sparkSession
    ship_package(spark)
    if not spark.sparkContext.getConf().contains(BATCH_ROWS):
        spark.conf.set(BATCH_ROWS, "1000")


def arrow_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def counter_rows(values: np.ndarray) -> list[tuple[int, bytes]]:
    """A fixed-size counter array as compressed chunk rows."""
    return [(i, zlib.compress(values[i * _CHUNK:(i + 1) * _CHUNK].tobytes(), 1)) for i in range(-(-len(values) // _CHUNK))
            if values[i * _CHUNK:(i + 1) * _CHUNK].any()]


def merged_counters(rows: DataFrame, size: int, dtype, how: str = "sum") -> np.ndarray:
    """Sum (or bitwise or) of the chunk rows of all tasks; the driver gets ``size`` values, whatever the input.

    A task adds the rows of its chunks up in a stream, one array per chunk.
    """
    dt = np.dtype(dtype)

    def merge(batches):
        acc: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = np.frombuffer(zlib.decompress(blob), dtype=dt)
                if c not in acc:
                    acc[c] = v.copy()
                elif how == "sum":
                    acc[c] += v
                else:
                    acc[c] |= v
        schema = pa.schema([("chunk", pa.int32()), ("blob", pa.binary())])
        for c, v in acc.items():
            yield arrow_batch({"chunk": [c], "blob": [zlib.compress(v.tobytes(), 1)]}, schema)

    n = -(-size // _CHUNK)
    out = np.zeros(size, dtype=dt)
    merged = rows.select("chunk", "blob").repartition(n, F.col("chunk")).mapInArrow(merge, COUNTER_SCHEMA)
    for r in merged.collect():
        v = np.frombuffer(zlib.decompress(bytes(r["blob"])), dtype=dt)
        out[r["chunk"] * _CHUNK:r["chunk"] * _CHUNK + len(v)] = v
    return out
