"""Row numbers of tables without a key, and what draws on them."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwise.operators import nn as N
from stackwise.operators import rbm as R
from stackwise.operators import sampling as S
from stackwise.session import scratch_path, scratch_run
from stackwise.sources import numbered as B


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """A table of several files whose rows repeat; column names that clash with those inside."""
    path = str(tmp_path_factory.mktemp("unkeyed") / "t")
    df = spark.range(3000).select((F.col("id") % 7).cast("double").alias("_file"), F.floor(F.col("id") / 7).alias("_at"), F.lit("x").alias("n"), F.lit(1).alias("a.b"))
    df.union(df.limit(0)).repartition(6, F.col("_at") % 5).write.parquet(path)
    return path


def numbers(df):
    return {(r.row_id, r._file, r._at) for r in df.select("row_id", "_file", "_at").collect()}


def test_numbers_are_gapless_and_follow_the_files(spark, rows):
    got = B.numbered_files(spark.read.parquet(rows))
    assert got.columns == ["row_id", "_file", "_at", "n", "a.b"]
    want, at = set(), 0
    for name in sorted(f for f in os.listdir(rows) if f.endswith(".parquet")):
        for r in spark.read.parquet(f"{rows}/{name}").coalesce(1).collect():
            want.add((at, r._file, r._at))
            at += 1
    assert numbers(got) == want and at == 3000


def test_numbers_do_not_depend_on_the_reader(spark, rows, monkeypatch):
    first = numbers(B.numbered_files(spark.read.parquet(rows)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        small = B.numbered_files(spark.read.parquet(rows))
        assert numbers(small.repartition(13).sortWithinPartitions("n")) == first
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    monkeypatch.setattr(B, "BROADCAST_FILES", 0)
    assert numbers(B.numbered_files(spark.read.parquet(rows))) == first


def test_any_table_is_written_once(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 3).alias("v")).union(spark.range(50).select(F.lit(9).cast("long").alias("v")))
    got = B.number_rows(df, str(tmp_path / "t"))
    ids = sorted(r.row_id for r in got.collect())
    assert ids == list(range(150)) and sorted(r.v for r in got.collect()) == sorted(r.v for r in df.collect())
    assert B.number_rows(df.limit(0), str(tmp_path / "empty")).count() == 0
    with pytest.raises(ValueError, match="row_id"):
        B.number_rows(got, str(tmp_path / "again"))
    with pytest.raises(ValueError, match="row_id"):
        B.numbered_files(got)


def test_equal_rows_draw_apart(spark, tmp_path):
    df = spark.range(4000).select(F.array(F.lit(0.5), F.lit(0.5)).alias("features"))
    got = B.number_rows(df, str(tmp_path / "t"))
    share = got.agg(F.avg(S.validation_flag("row_id", 0.25, 3).cast("double")).alias("side"), F.avg(S.sample_states("features", 3)[0]).alias("state"),
                    F.count_distinct(S.batch_id("row_id", 8, 3, 0)).alias("batches")).first()
    assert abs(share.side - 0.25) < 0.03 and abs(share.state - 0.5) < 0.03 and share.batches == 8


def test_training_without_a_key_equals_training_on_the_numbers(spark, tmp_path):
    df = spark.range(600).select(F.array((F.col("id") % 5) / 5.0, (F.col("id") % 3) / 3.0).alias("features"), F.array((F.col("id") % 2).cast("double")).alias("label"))
    one = df.coalesce(1)  # one file, so both runs number alike
    cfg = N.NNConfig(sizes=(2, 3, 1), dropout=0.2, noise=0.1, learning_rate=0.5, seed=5)
    with scratch_run(spark) as folder:
        fit = N.nn_fit(one, cfg, epochs=2, n_batches=2, validation=0.2)
        keyed = N.nn_fit(B.number_rows(one, scratch_path(spark, "t")), cfg, epochs=2, n_batches=2, validation=0.2)
        for a, b in zip(fit.model.weights, keyed.model.weights):
            assert np.array_equal(a, b)
        init = R.init_params(2, 3, 1, gaussian=True)
        p = R.gaussian_rbm_fit(one, init=init, epochs=1, n_batches=2).params
        q = R.gaussian_rbm_fit(B.number_rows(one, scratch_path(spark, "t")), init=init, epochs=1, n_batches=2).params
        assert np.array_equal(p.W, q.W) and np.array_equal(p.sigma, q.sigma)
        path = folder.removeprefix("file:")
        assert len(os.listdir(path)) >= 2  # the numbered tables, not what the trainers wrote
    assert not os.path.exists(path)


def test_trainers_delete_what_they_write(spark, tmp_path):
    df = spark.range(50).select(F.array(F.lit(0.5)).alias("features"), F.array(F.lit(1.0)).alias("label"))
    with scratch_run(spark) as folder:
        N.nn_fit(df, N.NNConfig(sizes=(1, 2, 1), sparsity=0.1), epochs=1, n_batches=2, validation=0.2)
        R.rbm_fit(df, 2, epochs=1)
        local = folder.removeprefix("file:")
        assert [f for f in os.listdir(local) if not f.startswith(".")] == []
