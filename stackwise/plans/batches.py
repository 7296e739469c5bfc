"""The rows of a training run, dealt once, and the batches of its epochs.

A run writes its rows once to the shared checkpoint folder. With more than one batch per
epoch they go into ``BUCKETS_PER_BATCH`` buckets per batch, one folder each, by a seeded draw on the row id.
An epoch orders the buckets by fresh draws and every consecutive group of them is a batch, so the
batches of an epoch partition the rows, a step reads its own buckets only (partition pruning), and no
epoch rewrites anything. The number of folders and of jobs depends on the number of batches, never on the
number of rows. The written rows also cut the lineage: a lost executor re-reads files.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackwise.functions.random import derive_seed, uniform_col, uniform_np
from stackwise.operators import sampling as S
from stackwise.session import release, scratch_path

BUCKETS_PER_BATCH = 8
TASK_BYTES = 256 << 20  # input that a task deals


def _input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that the rows come from, as the optimizer knows them; tables of unknown size (8 EiB to it) count nothing."""
    total, leaves = 0, df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    while leaves.hasNext():
        size = int(str(leaves.next().stats().sizeInBytes()))
        total += size if size < 1 << 60 else 0
    return total


def bucket_order(nb: int, seed: int, epoch: int) -> list[list[int]]:
    """The buckets of every batch of an epoch."""
    n = nb * BUCKETS_PER_BATCH
    draws = uniform_np(np.arange(n), 1, derive_seed(seed, S.BATCH, epoch))[:, 0]
    order = sorted(range(n), key=lambda k: (draws[k], k))
    return [order[b * BUCKETS_PER_BATCH:(b + 1) * BUCKETS_PER_BATCH] for b in range(nb)]


class TrainingRows:
    """``rows`` is the written table; ``batch(epoch, b)`` the rows of one batch. Use as a context: the files go at its end."""

    def __init__(self, df: DataFrame, nb: int, seed: int, row_id: str = "row_id"):
        self.nb, self.seed = max(1, int(nb)), seed
        self._spark = df.sparkSession
        self._path = scratch_path(self._spark, "training-rows")
        if self.nb == 1:
            df.write.parquet(self._path)
        else:
            n = self.nb * BUCKETS_PER_BATCH
            draw = uniform_col(F.col(row_id), 0, derive_seed(seed, S.BATCH))
            dealt = df.withColumn("_bucket", F.least(F.floor(draw * F.lit(float(n))), F.lit(n - 1)).cast("int"))
            # a bucket's rows spread over several tasks where the session or the size of the rows asks for more tasks than buckets
            tasks = max(int(self._spark.conf.get("spark.sql.shuffle.partitions")), -(-_input_bytes(df) // TASK_BYTES))
            salt = F.pmod(F.xxhash64(row_id), F.lit(max(1, -(-tasks // n))))
            dealt.repartition(max(n, tasks), "_bucket", salt).write.partitionBy("_bucket").parquet(self._path)
        schema = T.StructType([*df.schema.fields, *([T.StructField("_bucket", T.IntegerType())] if self.nb > 1 else [])])
        self.rows = self._spark.read.schema(schema).parquet(self._path)

    def batch(self, epoch: int, b: int) -> DataFrame:
        if self.nb == 1:
            return self.rows
        return self.rows.filter(F.col("_bucket").isin(*bucket_order(self.nb, self.seed, epoch)[b]))

    def __enter__(self) -> TrainingRows:
        return self

    def __exit__(self, *_exc) -> None:
        release(self._spark, self._path)
