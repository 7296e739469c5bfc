"""Scoring streams with a trained model.

The reference is batch-only; what carries over to Structured Streaming is scoring (G7):
it is a stateless per-row projection, so the same plan runs on a streaming DataFrame,
micro-batch by micro-batch, with no state store and no watermark needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from stackwise.operators.nn import NNModel, nn_predict


def score_stream(stream: DataFrame, model: NNModel, *, features: str = "features", label: str = "label",
                 keep=("row_id",), method: str = "auto") -> DataFrame:
    """(row_id, label, features, predict_label, error) for every arriving row."""
    return nn_predict(stream, model.weights, model.config, features=features, label=label, keep=keep, method=method)


def write_scores(scored: DataFrame, path: str, checkpoint: str, *, available_now: bool = True):
    """Append scored rows as parquet; the checkpoint makes restarts exactly-once for file sinks."""
    w = scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
