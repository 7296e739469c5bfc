"""Finite differences against the back-propagation row pass, and Spark sums against numpy."""

import numpy as np
import pytest

from stackwise.operators import nn as N


def _loss(W, cfg, X, Y):
    P = N._pass_params(W, cfg, training=True, step_seed=1, want_grad=False, want_act=False)
    return 0.5 * N.nn_rows(P, np.arange(len(X)), X, Y)["loss"] / len(X)


@pytest.mark.parametrize("act,out", [("sigm", "sigm"), ("sigm", "linear"), ("tanh_opt", "sigm"), ("tanh_opt", "linear")])
@pytest.mark.parametrize("sizes", [(3, 2), (4, 3, 2), (3, 4, 3, 2)])
def test_gradient_matches_finite_differences(act, out, sizes):
    rng = np.random.default_rng(5)
    cfg = N.NNConfig(sizes=sizes, activation=act, output=out)
    W = N.init_weights(sizes, 3)
    X = rng.random((20, sizes[0]))
    Y = rng.random((20, sizes[-1]))
    P = N._pass_params(W, cfg, training=True, step_seed=1, want_grad=True, want_act=False)
    g = N.nn_rows(P, np.arange(20), X, Y)
    eps = 1e-6
    for l, w in enumerate(W):
        num = np.zeros_like(w)
        for idx in np.ndindex(*w.shape):
            Wp = [x.copy() for x in W]
            Wm = [x.copy() for x in W]
            Wp[l][idx] += eps
            Wm[l][idx] -= eps
            num[idx] = (_loss(Wp, cfg, X, Y) - _loss(Wm, cfg, X, Y)) / (2 * eps)
        np.testing.assert_allclose(g[f"g{l}"] / 20, num, rtol=1e-5, atol=1e-8)


def test_sparsity_gradient_matches_finite_differences():
    """With the penalty the hidden delta gets KL-term derivative; check against the objective."""
    rng = np.random.default_rng(2)
    cfg = N.NNConfig(sizes=(3, 4, 2), activation="sigm", output="sigm", sparsity=0.3, sparsity_target=0.1)
    W = N.init_weights(cfg.sizes, 1)
    X = rng.random((30, 3))
    Y = rng.random((30, 2))
    p = {1: rng.uniform(0.2, 0.8, 4)}
    P = N._pass_params(W, cfg, training=True, step_seed=1, want_grad=True, want_act=False, p=p)
    g = N.nn_rows(P, np.arange(30), X, Y)
    # sparsity term enters the hidden delta as a constant vector per unit; its weight gradient
    # equals sum_rows [pen * kl'(p) * f'(a)] x^T, so removing the penalty must change g0 by exactly that
    cfg0 = N.NNConfig(sizes=(3, 4, 2), activation="sigm", output="sigm")
    P0 = N._pass_params(W, cfg0, training=True, step_seed=1, want_grad=True, want_act=False)
    g0 = N.nn_rows(P0, np.arange(30), X, Y)
    a1 = 1 / (1 + np.exp(-(np.hstack([np.ones((30, 1)), X]) @ W[0].T)))
    term = 0.3 * (-0.1 / p[1] + 0.9 / (1 - p[1]))
    extra = (term[None, :] * a1 * (1 - a1)).T @ np.hstack([np.ones((30, 1)), X])
    np.testing.assert_allclose(g["g0"] - g0["g0"], extra, rtol=1e-10, atol=1e-12)
    np.testing.assert_allclose(g["g1"], g0["g1"])


def test_spark_gradient_equals_numpy_on_collected_rows(spark):
    from conftest import SF_SMALL
    from stackwise.plans import catalog as C, fixtures as FX, inputs as I

    li = I.lineitem_samples(spark, SF_SMALL)
    g = N.nn_gradient(li, FX.li_weights(), C.LI_CFG)
    rows = li.collect()
    X = np.array([r["features"] for r in rows])
    Y = np.array([r["label"] for r in rows])
    P = N._pass_params(FX.li_weights(), C.LI_CFG, training=True, step_seed=0, want_grad=True, want_act=False)
    ref = N.nn_rows(P, None, X, Y)
    for l in range(2):
        np.testing.assert_allclose(g["grads"][l], ref[f"g{l}"] / len(X), rtol=1e-10, atol=1e-12)


def test_gaussian_sigma_gradient_matches_energy_derivative():
    """d = v(2b - v)/s + v(hW) equals -dE/d(1/s) + b^2/s for
    E(v, h) = sum (v - b)^2 / (2 s^2) - c.h - sum (v / s)(h W); the b^2/s term cancels in d0 - d1."""
    rng = np.random.default_rng(4)
    nv, nh = 5, 3
    W = rng.normal(0, 0.5, (nh, nv))
    b, c = rng.normal(0, 0.3, nv), rng.normal(0, 0.3, nh)
    v, h = rng.normal(0, 1, nv), (rng.random(nh) > 0.5).astype(float)
    s = rng.uniform(0.5, 1.5, nv)

    def energy(t):  # t = 1 / s per unit
        return float(np.sum((v - b) ** 2 * t ** 2 / 2) - c @ h - np.sum(v * t * (h @ W)))

    t0, eps = 1.0 / s, 1e-6
    num = np.zeros(nv)
    for i in range(nv):
        tp, tm = t0.copy(), t0.copy()
        tp[i] += eps
        tm[i] -= eps
        num[i] = -(energy(tp) - energy(tm)) / (2 * eps)
    d = v * (2 * b - v) / s + v * (h @ W)
    np.testing.assert_allclose(d - b * b / s, num, rtol=1e-7, atol=1e-9)
