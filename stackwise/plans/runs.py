"""Training runs that survive the driver: parameters and errors of every epoch, committed one by one.

A run has a folder on shared storage. After an epoch its arrays (parameters, velocities, running means) and errors are
written to ``epoch-<n>`` as rows of chunks, and then an empty marker file ``epoch-<n>.done`` commits it. A run that
is started again on the folder takes the last committed epoch and goes on with the next one; draws and batches are
functions of the epoch, so it ends like a run that never stopped. An epoch without marker is written anew.

The first commit stores the run's settings (not the number of epochs); a run with others is refused. Everything here is as
large as the model, never as the data. ``run_history`` shows the committed errors to any session while the run goes on.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 14  # numbers per row
_SCHEMA = "name string, shape array<int>, chunk int, vals array<double>"

#: called after every epoch with (epoch, train_error, val_error)
OnEpoch = Callable[[int, float, float], None]


class RunLog:
    def __init__(self, spark: SparkSession, path: str, settings: Mapping):
        self.spark, self.path = spark, path.rstrip("/")
        self.settings = json.dumps(settings, sort_keys=True, default=str)
        known = _settings(spark, self.path)
        if known is not None and known != self.settings:
            raise ValueError(f"{path} holds a run with other settings: {known}, not {self.settings}")
        self._new = known is None

    def commit(self, epoch: int, arrays: Mapping[str, np.ndarray], train: float, val: float) -> None:
        rows = []
        for name, a in {**arrays, "errors": np.array([train, val])}.items():
            a = np.asarray(a, dtype=float)
            flat = a.ravel()
            rows += [(name, list(a.shape), c, flat[c * CHUNK:(c + 1) * CHUNK].tolist()) for c in range(max(1, -(-flat.size // CHUNK)))]
        if self._new:
            self.spark.createDataFrame([(self.settings,)], "settings string").coalesce(1).write.mode("overwrite").text(f"{self.path}/settings")
            _touch(self.spark, f"{self.path}/settings.done")
            self._new = False
        self.spark.createDataFrame(rows, _SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/epoch-{epoch:06d}")
        _touch(self.spark, f"{self.path}/epoch-{epoch:06d}.done")

    def last(self, most: int) -> tuple[int, dict[str, np.ndarray]]:
        """The last committed epoch up to ``most`` and its arrays; (0, {}) for a new run."""
        epoch = max((e for e in committed_epochs(self.spark, self.path) if e <= most), default=0)
        if not epoch:
            return 0, {}
        parts: dict[str, list] = {}
        for r in self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/epoch-{epoch:06d}").collect():
            parts.setdefault(r["name"], []).append(r)
        return epoch, {n: np.concatenate([np.array(r["vals"], dtype=float) for r in sorted(rs, key=lambda r: r["chunk"])]).reshape(rs[0]["shape"]) for n, rs in parts.items()}

    def errors(self, most: int) -> list[tuple[int, float, float]]:
        """(epoch, train_error, val_error) of the committed epochs up to ``most``."""
        return [(r["epoch"], r["train_error"], r["val_error"]) for r in run_history(self.spark, self.path).filter(F.col("epoch") <= most).orderBy("epoch").collect()]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _touch(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.create(p, True).close()


def _settings(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, f"{path}/settings.done")
    return spark.read.text(f"{path}/settings").first()[0] if fs.exists(p) else None


def committed_epochs(spark: SparkSession, path: str) -> list[int]:
    """Epochs with a marker, in order."""
    fs, p = _fs(spark, path.rstrip("/"))
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[6:-5]) for n in names if n.startswith("epoch-") and n.endswith(".done"))


def run_history(spark: SparkSession, path: str, stage: str = "run") -> DataFrame:
    """A5 of a run that goes on, stopped or ended: (stage, epoch, train_error, val_error) of its committed epochs."""
    epochs = committed_epochs(spark, path)
    if not epochs:
        return spark.createDataFrame([], "stage string, epoch int, train_error double, val_error double")
    rows = spark.read.schema(_SCHEMA).parquet(*(f"{path.rstrip('/')}/epoch-{e:06d}" for e in epochs)).filter("name = 'errors'")
    epoch = F.regexp_extract("_metadata.file_path", r"epoch-([0-9]+)/[^/]*$", 1).cast("int")
    return rows.select(F.lit(stage).alias("stage"), epoch.alias("epoch"), F.col("vals")[0].alias("train_error"), F.col("vals")[1].alias("val_error"))
