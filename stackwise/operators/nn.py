"""Feed-forward network.

Weights are a list of matrices ``W[l]`` of shape (size[l+1], size[l] + 1) with the bias in
column 0. Training steps are :func:`step_sums` passes (gradients, loss and n together; a second pass only
for the sparsity penalty of networks with several hidden layers);
scoring is a code-generated projection (each layer unrolled into arithmetic) for small
layers, so it also works on streaming DataFrames, and numpy per Arrow batch for wide ones.
"""

from __future__ import annotations

import zlib
from contextlib import nullcontext
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackwise.functions import activations as A
from stackwise.functions import vectors as V
from stackwise.functions.random import derive_seed, uniform_np
from stackwise.functions.sparse import SparseRows, is_sparse
from stackwise.operators import sampling as S
from stackwise.operators.layers import arrow_list, dense_layer
from stackwise.operators.step import features_matrix, list_matrix, step_sums, times
from stackwise.plans.runs import OnEpoch, RunLog
from stackwise.session import ship_package
from stackwise.sources.numbered import keyed_rows

_ACT = {"sigm": 0, "tanh_opt": 1, "linear": 2}
_ACT_NAME = {v: k for k, v in _ACT.items()}


@dataclass(frozen=True)
class NNConfig:
    sizes: tuple = (10, 5, 1)
    activation: str = "sigm"
    output: str = "linear"
    learning_rate: float = 2.0
    momentum: float = 0.5
    scaling_learning_rate: float = 1.0
    l2: float = 0.0
    l2_on: str = "weights"  # 'weights' (evident intent) or 'gradient' (as coded, Q15)
    sparsity: float = 0.0
    sparsity_target: float = 0.05
    decay: float = 0.99  # weight of the old running activation (Q13; 0.09 as coded)
    noise: float = 0.0  # input zero-mask fraction
    dropout: float = 0.0
    seed: int = 0

    def __post_init__(self):
        object.__setattr__(self, "sizes", tuple(int(s) for s in self.sizes))
        if len(self.sizes) < 2:
            raise ValueError("a network needs at least two layers")
        if self.activation not in ("sigm", "tanh_opt"):
            raise ValueError(f"unknown hidden activation {self.activation!r}")
        if self.output not in ("sigm", "linear"):
            raise ValueError(f"unknown output function {self.output!r}")
        if self.l2_on not in ("weights", "gradient"):
            raise ValueError("l2_on must be 'weights' or 'gradient'")

    @property
    def n_layers(self) -> int:
        return len(self.sizes)


@dataclass
class NNModel:
    config: NNConfig
    weights: list

    def predict(self, df: DataFrame, **kw) -> DataFrame:
        return nn_predict(df, self.weights, self.config, **kw)

    def evaluate(self, df: DataFrame, **kw) -> float:
        return nn_evaluate(df, self.weights, self.config, **kw)


@dataclass
class NNFit:
    model: NNModel
    history: list = field(default_factory=list)  # (epoch, train_error, val_error)
    step_losses: list = field(default_factory=list)
    velocities: list = field(default_factory=list)


def init_weights(sizes, seed: int = 0) -> list:
    """(u - 0.5) * 8 * sqrt(6 / (out + in)), shape (out, in + 1)."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(1, len(sizes)):
        u = rng.random((sizes[i], sizes[i - 1] + 1))
        out.append((u - 0.5) * 2 * 4 * np.sqrt(6.0 / (sizes[i] + sizes[i - 1])))
    return out


# --------------------------------------------------------------------------- row pass (numpy)

def _forward(P, ids, X, training: bool):
    """Activations without bias slots (input, hidden layers, output) and the dropout masks of the hidden layers."""
    L = int(P["L"])
    act, outf = _ACT_NAME[int(P["act"])], _ACT_NAME[int(P["out"])]
    dropout, noise, seed = float(P["dropout"]), float(P["noise"]), int(P["seed"])
    if training and noise > 0:
        s = derive_seed(seed, S.NOISE)
        X = X.kept(ids, noise, s) if isinstance(X, SparseRows) else X * (uniform_np(ids, X.shape[1], s) >= noise)
    a, masks = [X], {}
    for l in range(1, L):
        w = P[f"W{l - 1}"]
        h = A.np_act(act if l < L - 1 else outf, times(a[-1], w[:, 1:].T) + w[:, 0])
        if l < L - 1 and dropout > 0:
            if training:
                masks[l] = (uniform_np(ids, h.shape[1], derive_seed(seed, S.DROPOUT, l)) > dropout).astype(np.float64)
                h = h * masks[l]
            else:
                h = h * (1.0 - dropout)
        a.append(h)
    return a, masks


def _outer_sums(delta: np.ndarray, a: np.ndarray) -> np.ndarray:
    """sum over rows of delta^T [1 | a]: the bias column first."""
    return np.column_stack([delta.sum(axis=0), a.under(delta) if isinstance(a, SparseRows) else delta.T @ a])


def nn_rows(P, ids, X, Y):
    """Sums of one batch: gradients g{l}, hidden activations act{l}, loss, n.

    ``linear_penalty`` (one hidden layer): the sparsity term is the same for all rows and enters the hidden delta
    linearly, as ``term * slope``, so the sums of ``slope^T [1 | x]`` (slopes) are enough to add it afterwards.
    """
    L = int(P["L"])
    training, want_act = bool(int(P["training"])), bool(int(P["want_act"]))
    a, masks = _forward(P, ids, X, training)
    err = Y - a[-1]
    out = {"loss": np.array(np.sum(err * err)), "n": np.array(float(X.shape[0]))}
    if want_act:
        out.update({f"act{l}": a[l].sum(axis=0) for l in range(1, L - 1)})
    if not bool(int(P["want_grad"])):
        return out
    delta = -err * A.np_act_grad(_ACT_NAME[int(P["out"])], a[-1])
    for l in range(L - 1, 0, -1):
        out[f"g{l - 1}"] = _outer_sums(delta, a[l - 1])
        if l == 1:
            break
        slope = A.np_act_grad(_ACT_NAME[int(P["act"])], a[l - 1])
        if l - 1 in masks:
            slope = slope * masks[l - 1]
        back = delta @ P[f"W{l - 1}"][:, 1:]
        if f"p{l - 1}" in P:
            back = back + sparsity_term(P[f"p{l - 1}"], float(P["sparsity"]), float(P["target"]))
        if bool(int(P["linear_penalty"])):
            out["slopes"] = _outer_sums(slope, a[l - 2])
        delta = back * slope
    return out


def sparsity_term(p: np.ndarray, weight: float, target: float) -> np.ndarray:
    """Weight * (-t / p + (1 - t) / (1 - p)) per hidden unit of mean activity p."""
    return weight * (-target / p + (1.0 - target) / (1.0 - p))


def _pass_params(W, cfg: NNConfig, *, training: bool, step_seed: int, want_grad: bool, want_act: bool, p=None, linear_penalty: bool = False) -> dict:
    P = {f"W{l}": np.asarray(w, dtype=float) for l, w in enumerate(W)}
    P.update({
        "L": np.array(cfg.n_layers), "act": np.array(_ACT[cfg.activation]), "out": np.array(_ACT[cfg.output]),
        "dropout": np.array(cfg.dropout), "noise": np.array(cfg.noise if training else 0.0),
        "seed": np.array(step_seed), "training": np.array(int(training)),
        "want_grad": np.array(int(want_grad)), "want_act": np.array(int(want_act)),
        "sparsity": np.array(cfg.sparsity), "target": np.array(cfg.sparsity_target), "linear_penalty": np.array(int(linear_penalty)),
    })
    if p is not None:
        for l in range(1, cfg.n_layers - 1):
            P[f"p{l}"] = np.asarray(p[l], dtype=float)
    return P


def _shapes(W, cfg: NNConfig, want_grad: bool, want_act: bool, linear_penalty: bool) -> dict:
    sh = {"loss": (), "n": ()}
    if want_grad:
        sh.update({f"g{l}": np.asarray(w).shape for l, w in enumerate(W)})
    if want_act:
        sh.update({f"act{l}": (cfg.sizes[l],) for l in range(1, cfg.n_layers - 1)})
    if linear_penalty:
        sh["slopes"] = np.asarray(W[0]).shape
    return sh


def _run(df, W, cfg, **kw) -> dict:
    shapes = _shapes(W, cfg, kw["want_grad"], kw["want_act"], kw.get("linear_penalty", False))
    return step_sums(df, nn_rows, _pass_params(W, cfg, **kw), shapes, width=cfg.sizes[0], label_width=cfg.sizes[-1], sparse=True)


# --------------------------------------------------------------------------- operators

def mean_activation_update(p_old: dict, act_sums: dict, n: float, cfg: NNConfig) -> dict:
    """Running activity 0.01 * batch mean + decay * old (hidden layers, bias slot dropped)."""
    return {l: 0.01 * act_sums[f"act{l}"] / n + cfg.decay * p_old[l] for l in range(1, cfg.n_layers - 1)}


def nn_gradient(df: DataFrame, W, cfg: NNConfig, *, step_seed: int | None = None, p=None, training: bool = True) -> dict:
    """G2 (+G3): mean gradient per layer, with loss and n, in one pass over the rows.

    The sparsity penalty needs the mean activity of the same rows. With one hidden layer it is added afterwards
    from sums of the same pass; deeper networks, where it also enters the deltas of the layers below, take two passes.
    """
    common = dict(training=training, step_seed=cfg.seed if step_seed is None else step_seed)
    if cfg.sparsity <= 0:
        sums = _run(df, W, cfg, want_grad=True, want_act=False, **common)
        return _mean_gradient(sums, W) if sums["n"] > 0 else {"n": 0.0}
    old = p if p is not None else {l: np.zeros(cfg.sizes[l]) for l in range(1, cfg.n_layers - 1)}
    if cfg.n_layers <= 3:
        sums = _run(df, W, cfg, want_grad=True, want_act=True, linear_penalty=cfg.n_layers == 3, **common)
        if sums["n"] <= 0:
            return {"n": 0.0}
        new = mean_activation_update(old, sums, sums["n"], cfg)
        if cfg.n_layers == 3:
            sums["g0"] = sums["g0"] + sparsity_term(new[1], cfg.sparsity, cfg.sparsity_target)[:, None] * sums["slopes"]
    else:
        first = _run(df, W, cfg, want_grad=False, want_act=True, **common)
        if first["n"] <= 0:
            return {"n": 0.0}
        new = mean_activation_update(old, first, first["n"], cfg)
        sums = _run(df, W, cfg, want_grad=True, want_act=False, p=new, **common)
    return {**_mean_gradient(sums, W), "p": new}


def _mean_gradient(sums: dict, W) -> dict:
    n = sums["n"]
    return {"n": n, "loss": 0.5 * sums["loss"] / n, "grads": [sums[f"g{l}"] / n for l in range(len(W))]}


def apply_grads(W, vW, grads, cfg: NNConfig, lr: float):
    """W -= lr * (dW [+ l2 term]) + momentum * vW; returns (W, vW)."""
    W2, vW2 = [], []
    for w, v, g in zip(W, vW, grads):
        dw = g
        if cfg.l2 > 0:
            ref = (w if cfg.l2_on == "weights" else g).copy()
            ref[:, 0] = 0.0
            dw = dw + cfg.l2 * ref
        dw = lr * dw
        if cfg.momentum > 0:
            dw = dw + cfg.momentum * v
            v = dw
        W2.append(w - dw)
        vW2.append(v)
    return W2, vW2


def nn_evaluate(df: DataFrame, W, cfg: NNConfig) -> float:
    """Half mean squared error in test mode (dropout scaling, no noise)."""
    s = _run(df, W, cfg, training=False, step_seed=cfg.seed, want_grad=False, want_act=False)
    return 0.5 * s["loss"] / s["n"] if s["n"] > 0 else float("nan")


def nn_fit(samples: DataFrame, cfg: NNConfig, *, epochs: int = 1, n_batches: int | None = None, batch_size: int | None = None,
           validation: float = 0.0, init_weights_: list | None = None, eval_each_epoch: bool = True, run_path: str | None = None,
           on_epoch: OnEpoch | None = None) -> NNFit:
    """Epoch x batch loop with momentum, L2, sparsity, noise, dropout, lr schedule.

    ``n_batches`` per epoch, or ``batch_size`` rows each (small tables), or one batch of all rows. Training and
    validation rows are written once and read from there by every step and evaluation. Samples without a
    ``row_id`` are written and numbered first. With ``run_path`` every epoch is committed there, and a run that is
    called again goes on after the last one (:mod:`stackwise.plans.runs`); ``on_epoch`` is told each epoch's errors.
    """
    log = None
    if run_path is not None:
        init = zlib.crc32(b"".join(np.asarray(w, dtype=float).tobytes() for w in init_weights_)) if init_weights_ else None
        log = RunLog(samples.sparkSession, run_path, {"stage": "nn", **asdict(cfg), "init": init, "n_batches": n_batches, "batch_size": batch_size, "validation": validation})
    with keyed_rows(samples.select(*(["row_id"] if "row_id" in samples.columns else []), "features", "label")) as df:
        return _fit(df, cfg, epochs, n_batches, batch_size, validation, init_weights_, eval_each_epoch, log, on_epoch)


def _fit(df: DataFrame, cfg: NNConfig, epochs: int, n_batches: int | None, batch_size: int | None, validation: float,
         init_weights_: list | None, eval_each_epoch: bool, log: RunLog | None, on_epoch: OnEpoch | None) -> NNFit:
    from stackwise.plans.batches import TrainingRows

    train, val = S.train_validation_split(df, validation, cfg.seed) if validation > 0 else (df, None)
    W = [np.asarray(w, dtype=float).copy() for w in (init_weights_ or init_weights(cfg.sizes, cfg.seed))]
    for l, w in enumerate(W):
        if w.shape != (cfg.sizes[l + 1], cfg.sizes[l] + 1):
            raise ValueError(f"layer {l} weights have shape {w.shape}, expected {(cfg.sizes[l + 1], cfg.sizes[l] + 1)}")
    vW = [np.zeros_like(w) for w in W]
    p = {l: np.zeros(cfg.sizes[l]) for l in range(1, cfg.n_layers - 1)}
    lr = cfg.learning_rate
    fit = NNFit(NNModel(cfg, W))
    done, state = log.last(epochs) if log is not None else (0, {})
    if done:
        W, vW = ([state[f"{n}{l}"] for l in range(len(W))] for n in ("W", "vW"))
        p = {l: state[f"p{l}"] for l in p}
        lr, fit.step_losses = float(state["lr"]), state["step_losses"].tolist()
        fit.history = log.errors(done)
        if done == epochs:
            fit.model, fit.velocities = NNModel(cfg, W), vW
            return fit
    with TrainingRows(train, S.batches_per_epoch(train, n_batches, batch_size), cfg.seed) as rows, \
            (TrainingRows(val, 1, cfg.seed) if val is not None else nullcontext()) as held:
        for epoch in range(done, epochs):
            for bno in range(rows.nb):
                g = nn_gradient(rows.batch(epoch, bno), W, cfg, step_seed=derive_seed(cfg.seed, 300, epoch, bno), p=p)
                if g["n"] > 0:
                    if "p" in g:
                        p = g["p"]
                    W, vW = apply_grads(W, vW, g["grads"], cfg, lr)
                    fit.step_losses.append(g["loss"])
            if eval_each_epoch:
                tr = nn_evaluate(rows.rows, W, cfg)
                va = nn_evaluate(held.rows, W, cfg) if held is not None else 0.0
            else:
                tr, va = float("nan"), float("nan")
            fit.history.append((epoch + 1, tr, va))
            lr = lr * cfg.scaling_learning_rate
            if log is not None:
                log.commit(epoch + 1, {**{f"W{l}": w for l, w in enumerate(W)}, **{f"vW{l}": v for l, v in enumerate(vW)}, **{f"p{l}": v for l, v in p.items()},
                                       "lr": np.array(lr), "step_losses": np.array(fit.step_losses)}, tr, va)
            if on_epoch is not None:
                on_epoch(epoch + 1, tr, va)
    fit.model = NNModel(cfg, W)
    fit.velocities = vW
    return fit


# --------------------------------------------------------------------------- projections

def _layers_small(W) -> bool:
    return sum(np.asarray(w).size for w in W) <= V.EXPRESSION_MAX


def forward_columns(df: DataFrame, W, cfg: NNConfig, *, features: str = "features", keep_hidden: bool = False,
                    method: str = "auto") -> DataFrame:
    """G1: layer by layer as columns a0..a{L-1} (hidden ones with the bias slot), test mode.

    Each layer reads the previous layer's column, so no unit is computed twice; see
    :func:`stackwise.operators.layers.dense_layer` for ``method``.
    """
    L = cfg.n_layers
    cur = df.withColumn("a0", V.add_bias(F.col(features)))
    for l in range(1, L):
        w = np.asarray(W[l - 1], dtype=float)
        fname = cfg.activation if l < L - 1 else cfg.output
        cur = dense_layer(cur.withColumn("_in", V.drop_bias(f"a{l - 1}")), "_in", w[:, 1:], w[:, 0], fname, f"a{l}", method=method).drop("_in")
        if l < L - 1:
            z = F.col(f"a{l}")
            if cfg.dropout > 0:
                z = F.transform(z, lambda x: x * F.lit(1.0 - cfg.dropout))
            cur = cur.withColumn(f"a{l}", V.add_bias(z))
    if not keep_hidden:
        cur = cur.drop(*[f"a{l}" for l in range(0, L - 1)])
    return cur


def predict_arrow(df: DataFrame, W, cfg: NNConfig, *, features: str = "features", label: str = "label") -> DataFrame:
    """G7 for wide layers: numpy forward per Arrow batch, appends predict_label and error."""
    ship_package(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(_pass_params(W, cfg, training=False, step_seed=cfg.seed, want_grad=False, want_act=False))
    schema = T.StructType(df.schema.fields + [T.StructField("predict_label", T.ArrayType(T.DoubleType())),
                                              T.StructField("error", T.ArrayType(T.DoubleType()))])

    def run(batches):
        P = sent.value
        for rb in batches:
            if rb.num_rows == 0:
                continue
            X = features_matrix(rb.column(features), cfg.sizes[0])
            a, _ = _forward(P, None, X, False)
            out = a[-1]
            err = list_matrix(rb.column(label), cfg.sizes[-1]) - out
            cols = [rb.column(i) for i in range(rb.num_columns)] + [arrow_list(out), arrow_list(err)]
            yield pa.RecordBatch.from_arrays(cols, names=list(rb.schema.names) + ["predict_label", "error"])

    return df.mapInArrow(run, schema)


def nn_forward(df: DataFrame, W, cfg: NNConfig, *, features: str = "features", label: str = "label") -> DataFrame:
    """G1: rows with every activation, the output and error = label - output."""
    L = cfg.n_layers
    out = forward_columns(df, W, cfg, features=features, keep_hidden=True)
    return out.withColumn("error", V.vsub(V.checked(label, cfg.sizes[-1]), F.col(f"a{L - 1}"), cfg.sizes[-1]))


def nn_predict(df: DataFrame, W, cfg: NNConfig, *, features: str = "features", label: str = "label", keep=("row_id",),
               method: str = "auto") -> DataFrame:
    """(label, features, predict_label, error), lazily.

    ``method``: 'expr' (code-generated projection, also for streams), 'arrow' (numpy per
    Arrow batch, for wide layers) or 'auto' (expr while the layers have <= EXPRESSION_MAX weights together). In all of
    them a label or feature vector that is NULL, holds NULL or has another width raises an error.
    """
    L = cfg.n_layers
    extra = [c for c in keep if c in df.columns]
    if method == "arrow" or (method == "auto" and (is_sparse(df.schema[features].dataType) or not _layers_small(W))):
        base = df.select(*extra, F.col(label).alias("label"), F.col(features).alias("features"))
        return predict_arrow(base, W, cfg)
    out = forward_columns(df, W, cfg, features=features)
    return out.select(*extra, F.col(label).alias("label"), F.col(features).alias("features"),
                      F.col(f"a{L - 1}").alias("predict_label"),
                      V.vsub(V.checked(label, cfg.sizes[-1]), F.col(f"a{L - 1}"), cfg.sizes[-1]).alias("error"))


def nn_loss(pred: DataFrame, width: int | None = None) -> DataFrame:
    """One row, loss = 0.5 * mean ||error||^2."""
    return pred.agg((F.lit(0.5) * F.avg(V.squared_norm("error", width))).alias("loss"))
