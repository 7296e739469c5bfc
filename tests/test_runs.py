"""Runs that stop and go on: every trainer, committed epochs, refused settings, epochs that were cut off."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwise.operators import dbn as D
from stackwise.operators import nn as N
from stackwise.operators import rbm as R
from stackwise.plans import runs


class Stop(Exception):
    pass


def stop_after(n):
    def on_epoch(epoch, train, val):
        if epoch == n:
            raise Stop
    return on_epoch


@pytest.fixture(scope="module")
def samples(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("samples") / "t")
    spark.range(400).select(F.col("id").alias("row_id"), F.array((F.col("id") % 7) / 7.0, (F.col("id") % 5) / 5.0, (F.col("id") % 3) / 3.0).alias("features"),
                            F.array((F.col("id") % 2).cast("double"), F.lit(0.5)).alias("label")).write.parquet(path)
    return spark.read.parquet(path)


def same(a, b):
    assert all(np.allclose(x, y, rtol=0, atol=1e-12) for x, y in zip(a, b))


CFG = dict(sizes=(3, 4, 2), dropout=0.2, noise=0.1, sparsity=0.1, momentum=0.5, scaling_learning_rate=0.7, learning_rate=0.5, seed=3)


@pytest.mark.parametrize("after", [1, 2, 4])
def test_network_goes_on_where_it_stopped(spark, samples, tmp_path, after):
    args = dict(epochs=4, n_batches=2, validation=0.25)
    cfg, path = N.NNConfig(**CFG), str(tmp_path / "run")
    whole = N.nn_fit(samples, cfg, **args)
    with pytest.raises(Stop):
        N.nn_fit(samples, cfg, run_path=path, on_epoch=stop_after(after), **args)
    assert runs.committed_epochs(spark, path) == list(range(1, after + 1))
    seen = []
    fit = N.nn_fit(samples, cfg, run_path=path, on_epoch=lambda e, t, v: seen.append(e), **args)
    assert seen == list(range(after + 1, 5))
    same(fit.model.weights, whole.model.weights)
    same(fit.velocities, whole.velocities)
    assert np.allclose(fit.history, whole.history, rtol=0, atol=1e-12) and np.allclose(fit.step_losses, whole.step_losses, rtol=0, atol=1e-12)
    again = N.nn_fit(samples, cfg, run_path=path, on_epoch=stop_after(4), **args)  # ended: nothing runs
    same(again.model.weights, whole.model.weights)
    shown = runs.run_history(spark, path, "nn").orderBy("epoch").collect()
    assert [(r.stage, r.epoch) for r in shown] == [("nn", e) for e in range(1, 5)] and np.allclose([r.train_error for r in shown], [h[1] for h in whole.history], atol=1e-12)


def test_a_longer_run_continues_a_shorter_one(spark, samples, tmp_path):
    cfg, path = N.NNConfig(**CFG), str(tmp_path / "run")
    N.nn_fit(samples, cfg, epochs=2, run_path=path)
    longer = N.nn_fit(samples, cfg, epochs=3, run_path=path)
    same(longer.model.weights, N.nn_fit(samples, cfg, epochs=3).model.weights)
    shorter = N.nn_fit(samples, cfg, epochs=1, run_path=path)  # an earlier epoch of the same run
    assert len(shorter.history) == 1
    same(shorter.model.weights, N.nn_fit(samples, cfg, epochs=1).model.weights)


@pytest.mark.parametrize("trainer", ["gaussian", "binary", "full"])
def test_machines_go_on_where_they_stopped(spark, samples, tmp_path, trainer):
    path = str(tmp_path / "run")
    if trainer == "gaussian":
        run = lambda **kw: R.gaussian_rbm_fit(samples, 4, epochs=3, n_batches=2, momentum=0.3, alpha=0.01, seed=5, **kw)
    elif trainer == "binary":
        run = lambda **kw: R.rbm_fit(samples, 4, epochs=3, momentum=0.3, alpha=0.05, seed=5, **kw)
    else:
        run = lambda **kw: R.rbm_fit_full_batch(samples, n_hidden=4, epochs=3, seed=5, **kw)
    whole = run()
    with pytest.raises(Stop):
        run(run_path=path, on_epoch=stop_after(2))
    fit = run(run_path=path)
    for name in R._STATE:
        a, b = getattr(fit.params, name), getattr(whole.params, name)
        assert (a is None and b is None) or np.allclose(a, b, rtol=0, atol=1e-12)
    assert np.allclose(fit.history, whole.history, rtol=1e-12) and len(fit.history) == 3


def test_stack_goes_on_in_the_layer_where_it_stopped(spark, samples, tmp_path, monkeypatch):
    path = str(tmp_path / "run")
    args = dict(epochs=2, n_batches=2, alpha=0.01, momentum=0.2, seed=4)
    whole = D.dbn_pretrain(samples, (3, 5, 2), **args)
    steps, counted = [], R.step_sums

    def fails(*a, **k):
        steps.append(1)
        if len(steps) == 6:  # second layer, first epoch, second batch
            raise Stop
        return counted(*a, **k)

    monkeypatch.setattr(R, "step_sums", fails)
    with pytest.raises(Stop):
        D.dbn_pretrain(samples, (3, 5, 2), run_path=path, **args)
    assert runs.committed_epochs(spark, f"{path}/layer-1") == [1, 2] and runs.committed_epochs(spark, f"{path}/layer-2") == []
    steps.clear()
    monkeypatch.setattr(R, "step_sums", lambda *a, **k: (steps.append(1), counted(*a, **k))[1])
    model = D.dbn_pretrain(samples, (3, 5, 2), run_path=path, **args)
    assert len(steps) == 4  # only the second layer
    for a, b in zip(model.layers, whole.layers):
        same([a.W, a.b, a.c], [b.W, b.b, b.c])


def test_epoch_without_marker_does_not_count(spark, samples, tmp_path):
    cfg, path = N.NNConfig(**CFG), str(tmp_path / "run")
    N.nn_fit(samples, cfg, epochs=2, run_path=path)
    os.remove(f"{path}/epoch-000002.done")
    assert runs.committed_epochs(spark, path) == [1] and runs.run_history(spark, path).count() == 1
    same(N.nn_fit(samples, cfg, epochs=2, run_path=path).model.weights, N.nn_fit(samples, cfg, epochs=2).model.weights)
    assert runs.run_history(spark, str(tmp_path / "none")).count() == 0


def test_other_settings_are_refused(samples, tmp_path):
    path = str(tmp_path / "run")
    N.nn_fit(samples, N.NNConfig(**CFG), epochs=1, run_path=path)
    for change in (dict(cfg=N.NNConfig(**{**CFG, "seed": 9})), dict(n_batches=3), dict(validation=0.5), dict(init_weights_=N.init_weights((3, 4, 2), 8))):
        with pytest.raises(ValueError, match="other settings"):
            N.nn_fit(samples, **{"cfg": N.NNConfig(**CFG), "epochs": 1, **change}, run_path=path)
    with pytest.raises(ValueError, match="other settings"):
        R.rbm_fit(samples, 3, run_path=path)


def test_large_arrays_are_stored_in_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "CHUNK", 7)
    log = runs.RunLog(spark, str(tmp_path / "run"), {"a": 1})
    arrays = {"W": np.arange(60.0).reshape(5, 12), "one": np.array(3.5), "none": np.zeros(0)}
    log.commit(1, arrays, 0.5, float("nan"))
    epoch, back = log.last(5)
    assert epoch == 1 and all(np.array_equal(back[n], arrays[n]) for n in arrays) and np.isnan(log.errors(5)[0][2])
