"""Learning smoke tests: errors fall with training."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from stackwise.operators import dbn as D
from stackwise.operators import nn as N
from stackwise.operators import rbm as R
from stackwise.plans import inputs as I


def test_gaussian_rbm_error_falls_and_sigma_learns_spread(spark):
    # default Gaussian reconstruction noise: sigma moves from 1 towards the data spread (~0.13)
    em = I.embedding_samples(spark, SF_SMALL)
    fit = R.gaussian_rbm_fit(em, 6, epochs=4, batch_size=100, momentum=0.5, alpha=0.01, seed=1)
    errs = [e for _, e in fit.history]
    assert errs[-1] < errs[0]
    assert (fit.params.sigma < 0.5).all()


def test_network_loss_falls(spark):
    em = I.embedding_samples(spark, SF_SMALL)
    cfg = N.NNConfig(sizes=(64, 8, 10), activation="sigm", output="sigm", learning_rate=1.0, momentum=0.5, seed=1)
    fit = N.nn_fit(em, cfg, epochs=4, batch_size=50)
    tr = [h[1] for h in fit.history]
    assert tr[-1] < tr[0]


def test_dbn_unfold_equals_transform(spark):
    """An unfolded stack without an extra layer and sigm output scores like dbn_transform."""
    em = I.embedding_samples(spark, SF_SMALL)
    model = D.dbn_pretrain(em, (64, 6, 4), epochs=1, batch_size=100, seed=2)
    a = np.array([r["top"] for r in D.dbn_transform(em, model).orderBy("row_id").select("top").collect()])
    b = np.array([r["predict_label"] for r in D.score_unfolded(em.withColumn("label", F.array(*[F.lit(0.0)] * 4)), model)
                  .orderBy("row_id").select("predict_label").collect()])
    np.testing.assert_allclose(a, b, rtol=1e-12, atol=1e-12)


def test_sigma_rate_damps_the_sigma_step(spark):
    em = I.embedding_samples(spark, SF_SMALL)
    wild = R.gaussian_rbm_fit(em, 6, epochs=3, batch_size=100, alpha=0.2, seed=1)
    damped = R.gaussian_rbm_fit(em, 6, epochs=3, batch_size=100, alpha=0.2, seed=1, sigma_rate=0.01)
    assert damped.history[-1][1] < wild.history[-1][1]
    assert np.isfinite(damped.history[-1][1])
