"""Session helpers: a local session for tests/bench and a shared scratch location.

The scratch location is the folder named by ``spark.checkpoint.dir`` (a shared file system such
as HDFS/S3). Without that setting a cluster session raises an error, since executors
would each write to a disk of their own; a local session, where driver and
executor are one process, gets a private temporary folder. What operators write there stays until the caller
ends a :func:`scratch_run`, since lazy results may still read it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "stackwise") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # call sites of thousands of column expressions
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a private one only in a local session without one."""
    sc = spark.sparkContext
    path = sc.getCheckpointDir()
    if not path:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not path:
            path = tempfile.mkdtemp(prefix="stackwise-ckpt-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir() or path
    return path


_RUNS: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-path under the current run's folder, or under the shared checkpoint folder."""
    base = _RUNS[-1] if _RUNS else checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """Everything that operators write for themselves inside the context goes to one folder, which is deleted at its end.

    Results that are read later must be written elsewhere (or collected) before the context ends.
    """
    path = scratch_path(spark, "run")
    _RUNS.append(path)
    try:
        yield path
    finally:
        _RUNS.remove(path)
        release(spark, path)


def release(spark: SparkSession, path: str) -> None:
    """Delete what a run wrote under :func:`scratch_path`."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``stackwise`` importable by the Python workers of this application.

    Code that runs inside tasks (the training step, Arrow layers) refers to functions of this
    package; executors get it as a zip through ``addPyFile``, once per SparkContext. A
    package that is already installed on the workers needs nothing, but shipping is harmless.
    """
    import os
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="stackwise-pyfiles-"), f"stackwise-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            if "__pycache__" in root:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(key)
