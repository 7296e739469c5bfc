"""Layers whose weights are a table, against the Arrow form that broadcasts them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from stackwise.functions import sparse as SP
from stackwise.operators import blocked as B
from stackwise.operators.layers import dense_arrow
from stackwise.plans import inputs as I


def tables(spark, W, c, block, keep=lambda j, i: True):
    w = spark.createDataFrame([(j, i, float(W[j, i])) for j in range(W.shape[0]) for i in range(W.shape[1]) if keep(j, i)], "out int, `in` int, w double")
    b = None if c is None else B.bias_blocks(spark.createDataFrame([(j, float(v)) for j, v in enumerate(c)], "out int, w double"), block)
    return B.weight_blocks(w, block), b


def by_row(df, col):
    return {r.row_id: np.array(r[col]) for r in df.collect()}


@pytest.mark.parametrize("block,group,out,act,bias", [(16, 7, 40, "sigm", True), (64, 1000, 64, "tanh_opt", False), (256, 30, 3, "linear", True), (5, 11, 33, "sigm", True)])
def test_equals_the_arrow_form(spark, monkeypatch, block, group, out, act, bias):
    monkeypatch.setattr(B, "GROUP", group)
    df = I.embedding_samples(spark, SF_SMALL).repartition(3)
    rng = np.random.default_rng(out)
    W, c = rng.normal(size=(out, 64)) * 0.3, rng.normal(size=out) if bias else None
    want = by_row(dense_arrow(df, "features", W, c, act, "h"), "h")
    got = B.dense_blocked(df, "features", *tables(spark, W, c, block), act, "h", n_in=64, n_out=out, block=block)
    assert got.columns == [*df.columns, "h"]
    rows = by_row(got, "h")
    assert rows.keys() == want.keys() and len(rows) == got.count()
    for k in want:
        np.testing.assert_allclose(rows[k], want[k], rtol=1e-12, atol=1e-12)


def test_missing_blocks_sparse_rows_and_repeated_rows(spark):
    df = I.embedding_samples(spark, SF_SMALL).select("row_id", F.transform("features", lambda x: F.when(x > 0.2, x).otherwise(0.0)).alias("features"))
    W = np.random.default_rng(1).normal(size=(20, 64))
    W[8:16], W[:, 32:48] = 0, 0  # whole blocks of zeros are not in the table
    w, _ = tables(spark, W, None, 8, keep=lambda j, i: W[j, i] != 0)
    want = by_row(dense_arrow(df, "features", W, None, "sigm", "h"), "h")
    twice = df.select("row_id", SP.from_dense(F.col("features")).alias("features")).union(df.select("row_id", SP.from_dense(F.col("features"))))
    got = B.dense_blocked(twice, "features", w, None, "sigm", "h", n_in=64, n_out=20, block=8).collect()
    assert len(got) == 2 * len(want) and all(np.allclose(r.h, want[r.row_id], atol=1e-12) for r in got)
    assert B.dense_blocked(df.limit(0), "features", w, None, "sigm", "h", n_in=64, n_out=20, block=8).count() == 0


@pytest.mark.parametrize("features", [None, [0.1], [0.1, None, 0.2]])
def test_wrong_vectors_raise(spark, features):
    df = spark.createDataFrame([(1, features)], "row_id long, features array<double>")
    w, _ = tables(spark, np.ones((2, 3)), None, 4)
    with pytest.raises(Exception, match="vector column"):
        B.dense_blocked(df, "features", w, None, "sigm", "h", n_in=3, n_out=2, block=4).collect()
    with pytest.raises(ValueError, match="already"):
        B.dense_blocked(df, "features", w, None, "sigm", "row_id", n_in=3, n_out=2, block=4)
