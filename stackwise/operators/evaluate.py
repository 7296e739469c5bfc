"""Evaluation (H1, H2), and scoring that is written and judged in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from stackwise.functions import vectors as V

HIT_THRESHOLD = 0.3333333  # fixed value of the reference's hit rate


def threshold_labels(df: DataFrame, col: str = "predict_label", t: float = HIT_THRESHOLD, out: str = "predicted",
                     width: int | None = None) -> DataFrame:
    """H1: score > t -> 1 else 0, per slot."""
    return df.withColumn(out, V.threshold(col, t, width))


def label_hit_rate(pred: DataFrame, t: float = HIT_THRESHOLD, *, width: int | None = None) -> DataFrame:
    """H2: mean over all rows of label . threshold(prediction) (Q23)."""
    return pred.agg(F.avg(V.dot("label", V.threshold("predict_label", t, width), width)).alias("hit_rate"))


def write_judged(pred: DataFrame, path: str, *, t: float = HIT_THRESHOLD, width: int | None = None, out: str = "predicted") -> dict:
    """G7, G8, H1, H2 in one pass: predictions (label, predict_label, error, ...) go to Parquet with their thresholded labels,
    and the loss, the hit rate and the number of rows are observed on the way -> {"loss", "hit_rate", "n"}.

    Every row is scored once and no second job reads the scores. No rows: loss and hit rate are None.
    """
    seen = Observation()
    scored = threshold_labels(pred, t=t, out=out, width=width)
    loss = F.lit(0.5) * F.avg(V.squared_norm("error", width))
    hits = F.avg(V.dot("label", out, width))
    scored.observe(seen, loss.alias("loss"), hits.alias("hit_rate"), F.count(F.lit(1)).alias("n")).write.parquet(path)
    got = seen.get
    return {"loss": got.get("loss"), "hit_rate": got.get("hit_rate"), "n": got.get("n", 0)}
