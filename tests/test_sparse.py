"""Sparse vectors: columns, rows of a batch, and every step on them against the dense form."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from stackwise.functions import sparse as SP
from stackwise.operators import dbn as D
from stackwise.operators import nn as N
from stackwise.operators import prepare as P
from stackwise.operators import rbm as R
from stackwise.operators.layers import dense_layer
from stackwise.plans import wells

VALUES = ["a", "b", "c", "d"]


def test_codes_equal_the_dense_ones(spark):
    df = spark.createDataFrame([("a",), ("d",), ("z",), (None,), ("b",)], "c string")
    for fill in (None, 0.0, 0.5):
        for unknown in ("zero", "null"):
            kw = dict(missing_fill=fill, on_unknown=unknown)
            rows = df.select(P.one_hot("c", VALUES, **kw).alias("x"), SP.to_dense(P.one_hot("c", VALUES, sparse=True, **kw)).alias("y")).collect()
            assert [r.x for r in rows] == [r.y for r in rows]
    with pytest.raises(Exception, match="unknown category"):
        df.select(P.one_hot("c", VALUES, sparse=True, on_unknown="error")).collect()
    spec = dict(phrases={"a b": [3, 1], "none": []}, keywords={"b": [0], "d": [2, 2, 9]}, strip_pattern="!$")
    text = spark.createDataFrame([("a b",), ("a b!",), ("x d b",), ("none",), ("q",), (None,)], "c string")
    for fill in (None, 0.5):
        rows = text.select(P.multi_hot("c", 5, missing_fill=fill, **spec).alias("x"), SP.to_dense(P.multi_hot("c", 5, missing_fill=fill, sparse=True, **spec)).alias("y")).collect()
        assert [r.x for r in rows] == [r.y for r in rows]


def test_selected_features_equal_the_dense_ones(spark):
    df = spark.createDataFrame([(1, "a", 0.5, [0.0, 2.0]), (2, "z", 0.0, [1.0, 0.0]), (3, "d", -1.0, [0.0, 0.0])], "id long, c string, v double, w array<double>")
    dense = P.select_features(df.withColumn("c", P.one_hot("c", VALUES)), "v", ["v", "c", "w"], row_id="id").collect()
    sparse = P.select_features(df.withColumn("c", P.one_hot("c", VALUES, sparse=True)), "v", ["v", "c", "w"], row_id="id")
    assert [r.features for r in dense] == [r[0] for r in sparse.select(SP.to_dense(F.col("features"))).collect()]
    back = sparse.select(SP.from_dense(SP.to_dense(F.col("features"))).alias("x"), "features").collect()
    assert all(dict(zip(r.x.indices, r.x.values)) == {i: v for i, v in zip(r.features.indices, r.features.values) if v} for r in back)
    nulls = P.select_features(df.withColumn("c", P.one_hot("c", VALUES, sparse=True, on_unknown="null")), "v", ["c"], row_id="id").orderBy("row_id").collect()
    assert [r.features is None for r in nulls] == [False, True, False]


def random_rows(n, width, seed=1):
    r = random.Random(seed)
    lists = [sorted(r.sample(range(width), r.choice([0, 0, 1, 3, width]))) for _ in range(n)]
    return [{"size": width, "indices": k, "values": [r.uniform(-1, 1) for _ in k]} for k in lists]


def test_compressed_rows_multiply_like_dense_ones():
    rng = np.random.default_rng(2)
    for n, width in ((0, 5), (1, 1), (40, 7)):
        rows = random_rows(n, width)
        X = SP.sparse_rows(pa.array(rows, SP_TYPE), width)
        full = np.zeros((n, width))
        for i, r in enumerate(rows):
            full[i, r["indices"]] = r["values"]
        m, delta, ids, per = rng.random((width, 3)), rng.random((n, 2)), np.arange(n) * 7, rng.random(width) + 1
        assert X.shape == (n, width) and np.array_equal(X.dense(), full)
        np.testing.assert_allclose(X.times(m), full @ m, atol=1e-14)
        np.testing.assert_allclose(X.under(delta), delta.T @ full, atol=1e-14)
        np.testing.assert_allclose(X.scaled(per).dense(), full / per, atol=1e-14)
        from stackwise.functions.random import uniform_np

        assert np.array_equal(X.kept(ids, 0.4, 3).dense(), full * (uniform_np(ids, width, 3) >= 0.4))
    sliced = pa.array(random_rows(20, 6), SP_TYPE).slice(5, 9)
    assert np.array_equal(SP.sparse_rows(sliced, 6).dense(), SP.sparse_rows(pa.array(random_rows(20, 6), SP_TYPE), 6).dense(5, 14))


SP_TYPE = pa.struct([("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])


@pytest.mark.parametrize("row", [None, {"size": None, "indices": [0], "values": [1.0]}, {"size": 3, "indices": None, "values": [1.0]}, {"size": 3, "indices": [0], "values": [None]},
                                 {"size": 3, "indices": [1, 0], "values": [1.0, 1.0]}, {"size": 3, "indices": [1, 1], "values": [1.0, 1.0]}, {"size": 3, "indices": [3], "values": [1.0]},
                                 {"size": 3, "indices": [-1], "values": [1.0]}, {"size": 3, "indices": [0, 1], "values": [1.0]}, {"size": 2, "indices": [0], "values": [1.0]}])
def test_wrong_sparse_vectors_raise(row):
    good = {"size": 3, "indices": [0, 2], "values": [1.0, 2.0]}
    with pytest.raises(ValueError, match="vector column"):
        SP.sparse_rows(pa.array([good, row, good], SP_TYPE), 3)


@pytest.fixture(scope="module")
def samples(spark, tmp_path_factory):
    """All columns of the prepared well table, sparse and dense, written as Parquet."""
    base = tmp_path_factory.mktemp("wells")
    out = {}
    for kind in ("sparse", "dense"):
        wells.wide_samples(spark, SF_SMALL, sparse=kind == "sparse").write.parquet(f"{base}/{kind}")
        out[kind] = spark.read.parquet(f"{base}/{kind}")
    return out, str(base)


def test_samples_hold_the_same_numbers(samples):
    out, _ = samples
    dense = {r.row_id: r.features for r in out["dense"].collect()}
    back = out["sparse"].select("row_id", SP.to_dense(F.col("features")).alias("features")).collect()
    assert len(back) == len(dense) and all(dense[r.row_id] == r.features for r in back)


@pytest.mark.parametrize("kw", [{}, {"noise": 0.3}, {"dropout": 0.2, "sparsity": 0.1, "activation": "tanh_opt"}])
@pytest.mark.parametrize("hidden", [(4,), (5, 4)])
def test_gradients_equal_the_dense_ones(samples, kw, hidden):
    out, _ = samples
    width = len(out["dense"].first().features)
    cfg = N.NNConfig(sizes=(width, *hidden, 3), output="sigm", seed=3, **kw)
    W = N.init_weights(cfg.sizes, 2)
    a, b = (N.nn_gradient(out[k], W, cfg) for k in ("sparse", "dense"))
    assert a["n"] == b["n"] and abs(a["loss"] - b["loss"]) < 1e-12
    for x, y in zip(a["grads"], b["grads"]):
        np.testing.assert_allclose(x, y, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("slice_size", [SP.DENSE_SLICE, 1000])
def test_gaussian_steps_equal_the_dense_ones(samples, monkeypatch, slice_size):
    monkeypatch.setattr(SP, "DENSE_SLICE", slice_size)
    out, _ = samples
    p = R.init_params(len(out["dense"].first().features), 5, 1, gaussian=True)
    a, b = (R.cd_step_sums(out[k].select("row_id", "features"), p, R.RBMConfig(k=2, seed=4), 4, True) for k in ("sparse", "dense"))
    for name in a:
        np.testing.assert_allclose(a[name], b[name], rtol=1e-9, atol=1e-9)


def test_training_and_scoring_take_sparse_samples(samples):
    out, _ = samples
    width = len(out["dense"].first().features)
    models = {k: D.dbn_pretrain(out[k], (width, 4, 3), epochs=1, n_batches=2, alpha=0.01, seed=2) for k in out}
    fits = {k: D.dbn_finetune(out[k], models[k], epochs=1, n_batches=2, seed=2) for k in out}
    for x, y in zip(fits["sparse"].model.weights, fits["dense"].model.weights):
        np.testing.assert_allclose(x, y, rtol=1e-6, atol=1e-8)
    scored = {k: {r.row_id: r.predict_label for r in fits["dense"].model.predict(out[k]).collect()} for k in out}
    assert all(np.allclose(scored["sparse"][i], scored["dense"][i], atol=1e-9) for i in scored["dense"])
    W = models["dense"].layers[0]
    hidden = {k: {r.row_id: r.h for r in dense_layer(out[k], "features", W.W, W.c, "sigm", "h", scale=W.sigma).collect()} for k in out}
    assert all(np.allclose(hidden["sparse"][i], hidden["dense"][i], atol=1e-12) for i in hidden["dense"])


def test_sparse_samples_are_smaller_in_memory_and_on_disk(samples):
    out, base = samples
    size = {k: sum(os.path.getsize(f"{base}/{k}/{f}") for f in os.listdir(f"{base}/{k}") if f.endswith(".parquet")) for k in out}
    held = out["sparse"].agg(F.avg(F.size("features.indices"))).first()[0]
    assert held < 0.5 * len(out["dense"].first().features)
    print(f"bytes on disk: {size}, numbers held per row: {held:.1f}")
