"""Model parameters <-> the model table ``(layer int, out int, in int, w double)``.

``in = 0`` is the bias column, as in the network's weight layout ``[c | W]``. The table is
as large as the model (never the data), so reading it back to the driver is bounded.
Saved as parquet under the shared checkpoint folder (or any path given).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def to_table(spark: SparkSession, W) -> DataFrame:
    rows = [(l, j, i, float(w[j, i])) for l, w in enumerate(W) for j in range(w.shape[0]) for i in range(w.shape[1])]
    return spark.createDataFrame(rows, "layer int, out int, `in` int, w double")


def from_table(df: DataFrame) -> list:
    rows = df.select("layer", "out", "in", "w").collect()
    shapes = {}
    for r in rows:
        o, i = shapes.get(r["layer"], (0, 0))
        shapes[r["layer"]] = (max(o, r["out"] + 1), max(i, r["in"] + 1))
    W = [np.zeros(shapes[l]) for l in sorted(shapes)]
    for r in rows:
        W[r["layer"]][r["out"], r["in"]] = r["w"]
    return W


def save(spark: SparkSession, W, path: str) -> None:
    to_table(spark, W).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> list:
    return from_table(spark.read.parquet(path))
