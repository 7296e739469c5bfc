"""Deep belief network: layer-wise pretraining, transform and unfolding.

Layer 1 is a Gaussian-visible RBM, the others binary RBMs, each trained on the previous
layer's hidden probabilities (cumulative, Q5). A layer's input is a projection of the samples
through the trained layers, which its trainer writes once and removes at its end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackwise.functions.random import derive_seed
from stackwise.operators import nn as N
from stackwise.operators import rbm as R
from stackwise.operators.layers import dense_layer
from stackwise.sources.numbered import keyed_rows


@dataclass
class DBNModel:
    sizes: tuple
    layers: list  # RBMParams per layer; layers[0] carries sigma
    history: list = None  # (layer, epoch, error)

    @property
    def sigma(self) -> np.ndarray:
        return self.layers[0].sigma


def dbn_pretrain(samples: DataFrame, sizes, *, epochs: int = 1, n_batches: int | None = None,
                 batch_size: int | None = None, k: int = 1, momentum: float = 0.0, alpha: float = 0.2, seed: int = 0,
                 noise: str = "normal", init: list | None = None, scale_by_sigma: bool = False, sigma_rate: float = 1.0,
                 run_path: str | None = None) -> DBNModel:
    """pretrain ``len(sizes) - 1`` RBMs; defaults size [10, 5, 1], momentum 0, alpha 0.2. Samples without a ``row_id`` are numbered once.

    With ``run_path`` every epoch of every layer is committed (``layer-1``, ...); a run that is called again goes on there.
    """
    with keyed_rows(samples.select(*(["row_id"] if "row_id" in samples.columns else []), "features")) as base:
        return _pretrain(base, tuple(int(s) for s in sizes), epochs, n_batches, batch_size, k, momentum, alpha, seed, noise, init, scale_by_sigma, sigma_rate, run_path)


def _pretrain(base: DataFrame, sizes: tuple, epochs, n_batches, batch_size, k, momentum, alpha, seed, noise, init, scale_by_sigma, sigma_rate, run_path) -> DBNModel:
    layers, history = [], []
    common = dict(epochs=epochs, n_batches=n_batches, batch_size=batch_size, momentum=momentum, alpha=alpha, k=k)
    folder = lambda i: None if run_path is None else f"{run_path.rstrip('/')}/layer-{i}"
    g = R.gaussian_rbm_fit(base, sizes[1], run_path=folder(1), seed=derive_seed(seed, 400, 0), noise=noise, sigma_rate=sigma_rate,
                           init=None if init is None else init[0], **common)
    layers.append(g.params)
    history += [(1, e, err) for e, err in g.history]
    cur = base
    for i in range(2, len(sizes)):
        scale = scale_by_sigma and i == 2
        cur = R.rbm_hidden(cur, layers[-1], "features", "h", scale_by_sigma=scale).select("row_id", F.col("h").alias("features"))
        fit = R.rbm_fit(cur, sizes[i], run_path=folder(i), seed=derive_seed(seed, 400, i - 1), init=None if init is None else init[i - 1], **common)
        layers.append(fit.params)
        history += [(i, e, err) for e, err in fit.history]
    return DBNModel(sizes, layers, history)


def dbn_transform(df: DataFrame, model: DBNModel, *, features: str = "features", out: str = "top",
                  scale_by_sigma: bool = False) -> DataFrame:
    """rows -> top-layer probabilities through the whole stack, one projection per layer."""
    cur = df.withColumn("_h0", F.col(features))
    for i, p in enumerate(model.layers):
        scale = p.sigma if (scale_by_sigma and i == 0 and p.sigma is not None) else None
        cur = dense_layer(cur, f"_h{i}", p.W, p.c, "sigm", f"_h{i + 1}", scale=scale)
    n = len(model.layers)
    cur = cur.withColumn(out, F.col(f"_h{n}"))
    return cur.drop(*[f"_h{i}" for i in range(n + 1)])


def dbn_unfold(model: DBNModel, output_size: int = 0, seed: int = 0) -> tuple[tuple, list]:
    """Network sizes and weights [c | W] per layer; optional extra output layer (network init)."""
    W = [np.concatenate([p.c[:, None], p.W], axis=1) for p in model.layers]
    sizes = tuple(model.sizes)
    if output_size > 0:
        sizes = sizes + (int(output_size),)
        W.append(N.init_weights(sizes[-2:], seed)[0])
    return sizes, W


def score_unfolded(df: DataFrame, model: DBNModel, *, output_size: int = 0, output: str = "sigm", seed: int = 0) -> DataFrame:
    """rows scored by the network unfolded from the stack (sigm hidden units)."""
    sizes, W = dbn_unfold(model, output_size, seed)
    cfg = N.NNConfig(sizes=sizes, activation="sigm", output=output)
    return N.nn_predict(df, W, cfg)


def dbn_finetune(samples: DataFrame, model: DBNModel, *, output_size: int = 0, epochs: int = 1,
                 n_batches: int | None = None, batch_size: int | None = None, validation: float = 0.0, seed: int = 0,
                 **nn_kw) -> N.NNFit:
    """Unfold the stack, then fine-tune the network by back-propagation (sigm / sigm)."""
    sizes, W = dbn_unfold(model, output_size, seed)
    cfg = N.NNConfig(sizes=sizes, activation="sigm", output="sigm", seed=seed, **nn_kw)
    return N.nn_fit(samples, cfg, epochs=epochs, n_batches=n_batches, batch_size=batch_size, validation=validation,
                    init_weights_=W)
