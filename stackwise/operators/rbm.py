"""Restricted Boltzmann machines.

Conventions: ``W`` has shape (hidden, visible); a row is propagated by ``v . W^T + c``.
Every training step is one :func:`step_sums` pass that returns the gradient sums, the
reconstruction error and the row count together; the update is driver arithmetic on the
small parameter arrays. Draws are seeded per (row, unit, step), so a step is repeatable.
"""

from __future__ import annotations

import zlib
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackwise.functions.activations import np_act
from stackwise.functions.random import derive_seed, normal_np, uniform_np
from stackwise.functions.sparse import is_sparse
from stackwise.operators import sampling as S
from stackwise.operators.step import step_sums
from stackwise.plans.runs import OnEpoch, RunLog
from stackwise.sources.numbered import keyed_rows

SIGMA_FLOOR = 0.005


@dataclass
class RBMParams:
    W: np.ndarray  # (hidden, visible)
    b: np.ndarray  # (visible,)
    c: np.ndarray  # (hidden,)
    vW: np.ndarray = None
    vb: np.ndarray = None
    vc: np.ndarray = None
    sigma: np.ndarray | None = None  # Gaussian visible units only
    v_inv_sigma: np.ndarray | None = None

    def __post_init__(self):
        self.W = np.asarray(self.W, dtype=float)
        self.b = np.asarray(self.b, dtype=float).reshape(-1)
        self.c = np.asarray(self.c, dtype=float).reshape(-1)
        self.vW = np.zeros_like(self.W) if self.vW is None else np.asarray(self.vW, dtype=float)
        self.vb = np.zeros_like(self.b) if self.vb is None else np.asarray(self.vb, dtype=float)
        self.vc = np.zeros_like(self.c) if self.vc is None else np.asarray(self.vc, dtype=float)
        if self.sigma is not None:
            self.sigma = np.asarray(self.sigma, dtype=float).reshape(-1)
            self.v_inv_sigma = np.zeros_like(self.sigma) if self.v_inv_sigma is None else np.asarray(self.v_inv_sigma, dtype=float)

    @property
    def n_hidden(self) -> int:
        return self.W.shape[0]

    @property
    def n_visible(self) -> int:
        return self.W.shape[1]

    def copy(self) -> "RBMParams":
        return replace(self, W=self.W.copy(), b=self.b.copy(), c=self.c.copy(), vW=self.vW.copy(),
                       vb=self.vb.copy(), vc=self.vc.copy(),
                       sigma=None if self.sigma is None else self.sigma.copy(),
                       v_inv_sigma=None if self.v_inv_sigma is None else self.v_inv_sigma.copy())


@dataclass
class RBMConfig:
    momentum: float = 0.0
    alpha: float = 0.2
    k: int = 1
    noise: str = "normal"  # Gaussian reconstruction noise: normal | uniform | none (Q3)
    seed: int = 0
    sigma_rate: float = 1.0  # scale of the 1/sigma step; 1.0 = unscaled as in the reference


@dataclass
class FitResult:
    params: RBMParams
    history: list = field(default_factory=list)  # (epoch, error)


def init_params(n_visible: int, n_hidden: int, seed: int = 0, gaussian: bool = False) -> RBMParams:
    """Driver-side initialisation: W ~ N(0, 0.01) as coded, zero biases, sigma = 1."""
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, 0.01, size=(n_hidden, n_visible))
    p = RBMParams(W=W, b=np.zeros(n_visible), c=np.zeros(n_hidden))
    if gaussian:
        p.sigma = np.ones(n_visible)
        p.v_inv_sigma = np.zeros(n_visible)
    return p


def _sig(z):
    return np_act("sigm", z)


def _states(p, ids, seed):
    return (p > uniform_np(ids, p.shape[1], seed)).astype(np.float64)


# --------------------------------------------------------------------------- row passes

def binary_cd_rows(P, ids, V0, _Y):
    """CD-k with probabilities for the visible units; sums of one batch."""
    W, b, c, k, seed = P["W"], P["b"], P["c"], int(P["k"]), int(P["seed"])
    h0 = _sig(V0 @ W.T + c)
    hk = h0
    for g in range(k):
        hs = _states(hk, ids, derive_seed(seed, S.HIDDEN, g))
        v1 = _sig(hs @ W + b)
        hk = _sig(v1 @ W.T + c)
    h1 = hk
    d = V0 - v1
    return {
        "dW": h0.T @ V0 - h1.T @ v1,
        "db": d.sum(axis=0),
        "dc": (h0 - h1).sum(axis=0),
        "err": np.array(np.sum(d * d)),
        "n": np.array(float(V0.shape[0])),
    }


def gaussian_cd_rows(P, ids, V0, _Y):
    """Gaussian visible units with per-unit sigma (Q1, Q2 fixed)."""
    W, b, c, s, k, seed = P["W"], P["b"], P["c"], P["sigma"], int(P["k"]), int(P["seed"])
    noise = int(P["noise"])  # 0 none, 1 uniform, 2 normal
    h0 = _sig((V0 / s) @ W.T + c)
    hk = h0
    for g in range(k):
        hs = _states(hk, ids, derive_seed(seed, S.HIDDEN, g))
        mean = (hs @ W) * s + b
        if noise == 2:
            mean = mean + normal_np(ids, V0.shape[1], derive_seed(seed, S.RECON, g)) * s
        elif noise == 1:
            mean = mean + uniform_np(ids, V0.shape[1], derive_seed(seed, S.RECON, g)) * s
        v1 = mean
        hk = _sig((v1 / s) @ W.T + c)
    h1 = hk
    d0 = V0 * (2.0 * b - V0) / s + V0 * (h0 @ W)
    d1 = v1 * (2.0 * b - v1) / s + v1 * (h1 @ W)
    diff = V0 - v1
    return {
        "dW": h0.T @ (V0 / s) - h1.T @ (v1 / s),
        "db": (diff / (s * s)).sum(axis=0),
        "dc": (h0 - h1).sum(axis=0),
        "dsig": (d0 - d1).sum(axis=0),
        "err": np.array(np.sum(diff * diff)),
        "n": np.array(float(V0.shape[0])),
    }


def full_batch_binary_rows(P, ids, V1, _Y):
    """full-batch CD-1 with sampled hidden and visible states, scaled by alpha."""
    W, b, c, alpha, seed = P["W"], P["b"], P["c"], float(P["alpha"]), int(P["seed"])
    h1 = _states(_sig(V1 @ W.T + c), ids, derive_seed(seed, S.HIDDEN, 0))
    v2 = _states(_sig(h1 @ W + b), ids, derive_seed(seed, S.VISIBLE, 0))
    h2 = _states(_sig(v2 @ W.T + c), ids, derive_seed(seed, S.HIDDEN, 1))
    d = V1 - v2
    return {
        "dW": alpha * (h1.T @ V1 - h2.T @ v2),
        "db": alpha * d.sum(axis=0),
        "dc": alpha * (h1 - h2).sum(axis=0),
        "err": np.array(np.sum(d * d)),
        "n": np.array(float(V1.shape[0])),
    }


def _shapes(p: RBMParams, gaussian: bool) -> dict:
    sh = {"dW": p.W.shape, "db": p.b.shape, "dc": p.c.shape, "err": (), "n": ()}
    if gaussian:
        sh["dsig"] = p.b.shape
    return sh


def _step_params(p: RBMParams, cfg: RBMConfig, step_seed: int, gaussian: bool) -> dict:
    P = {"W": p.W, "b": p.b, "c": p.c, "k": np.array(cfg.k), "seed": np.array(step_seed)}
    if gaussian:
        P["sigma"] = p.sigma
        P["noise"] = np.array({"none": 0, "uniform": 1, "normal": 2}[cfg.noise])
    return P


# --------------------------------------------------------------------------- one step

def cd_step_sums(batch: DataFrame, p: RBMParams, cfg: RBMConfig, step_seed: int, gaussian: bool) -> dict:
    """One distributed pass; returns sums (not yet means)."""
    fn = gaussian_cd_rows if gaussian else binary_cd_rows
    return step_sums(batch, fn, _step_params(p, cfg, step_seed, gaussian), _shapes(p, gaussian), label=None, width=p.n_visible)


def apply_cd_update(p: RBMParams, sums: dict, cfg: RBMConfig, gaussian: bool) -> tuple[RBMParams, float | None]:
    """Momentum update from batch sums; an empty batch keeps the parameters (Q19)."""
    n = sums["n"]
    if n <= 0:
        return p, None
    q = p.copy()
    q.vW = cfg.momentum * p.vW + cfg.alpha * sums["dW"] / n
    q.vb = cfg.momentum * p.vb + cfg.alpha * sums["db"] / n
    q.vc = cfg.momentum * p.vc + cfg.alpha * sums["dc"] / n
    q.W = p.W + q.vW
    q.b = p.b + q.vb
    q.c = p.c + q.vc
    if gaussian:
        step = sums["dsig"] / n if cfg.sigma_rate == 1.0 else cfg.sigma_rate * sums["dsig"] / n
        q.v_inv_sigma = cfg.momentum * p.v_inv_sigma + step
        inv = 1.0 / p.sigma + q.v_inv_sigma
        with np.errstate(divide="ignore"):
            s = np.where(inv > 0, 1.0 / np.where(inv > 0, inv, 1.0), SIGMA_FLOOR)
        q.sigma = np.maximum(s, SIGMA_FLOOR)
    return q, sums["err"] / n


def _width(samples: DataFrame, features: str) -> int:
    """Slots of the first row's vector, dense or sparse."""
    first = samples.select(features).first()[0]
    return first["size"] if is_sparse(samples.schema[features].dataType) else len(first)


def _rows(samples: DataFrame, features: str):
    """(row_id, features) as a context; samples without a ``row_id`` are written and numbered."""
    key = ["row_id"] if "row_id" in samples.columns else []
    return keyed_rows(samples.select(*key, F.col(features).alias("features")))


_STATE = ("W", "b", "c", "vW", "vb", "vc", "sigma", "v_inv_sigma")


def _resumed(log: RunLog | None, p: RBMParams, epochs: int) -> tuple[int, RBMParams, list]:
    """Committed epochs of the run, its parameters and its history."""
    done, state = log.last(epochs) if log is not None else (0, {})
    if not done:
        return 0, p, []
    return done, replace(p, **{n: state[n] for n in _STATE if n in state}), [(e, err) for e, err, _ in log.errors(done)]


def _committed(log: RunLog | None, on_epoch: OnEpoch | None, p: RBMParams, epoch: int, err: float) -> None:
    if log is not None:
        log.commit(epoch, {n: getattr(p, n) for n in _STATE if getattr(p, n) is not None}, err, float("nan"))
    if on_epoch is not None:
        on_epoch(epoch, err, float("nan"))


def _log(samples: DataFrame, run_path: str | None, **settings) -> RunLog | None:
    return None if run_path is None else RunLog(samples.sparkSession, run_path, settings)


def _fit(samples: DataFrame, p: RBMParams, cfg: RBMConfig, epochs: int, n_batches: int | None, batch_size: int | None,
         gaussian: bool, features: str = "features", run_path: str | None = None, on_epoch: OnEpoch | None = None) -> FitResult:
    """Epoch x batch loop."""
    from stackwise.plans.batches import TrainingRows

    log = _log(samples, run_path, stage="gaussian_rbm" if gaussian else "rbm", shape=p.W.shape, init=zlib.crc32(p.W.tobytes()), n_batches=n_batches, batch_size=batch_size, **asdict(cfg))
    done, p, history = _resumed(log, p, epochs)
    if done == epochs:
        return FitResult(p, history)
    with _rows(samples, features) as df, TrainingRows(df, S.batches_per_epoch(df, n_batches, batch_size), cfg.seed) as rows:
        for epoch in range(done, epochs):
            errs = []
            for bno in range(rows.nb):
                sums = cd_step_sums(rows.batch(epoch, bno), p, cfg, derive_seed(cfg.seed, 100, epoch, bno), gaussian)
                p, err = apply_cd_update(p, sums, cfg, gaussian)
                if err is not None:
                    errs.append(err)
            history.append((epoch + 1, float(np.mean(errs)) if errs else float("nan")))
            _committed(log, on_epoch, p, *history[-1])
    return FitResult(p, history)


def rbm_fit(samples: DataFrame, n_hidden: int | None = None, *, epochs: int = 1, n_batches: int | None = None,
            batch_size: int | None = None, momentum: float = 0.0, alpha: float = 0.2, k: int = 1, seed: int = 0,
            init: RBMParams | None = None, features: str = "features", run_path: str | None = None, on_epoch: OnEpoch | None = None) -> FitResult:
    """binary RBM trained by mini-batch CD-k with momentum; ``n_batches`` per epoch, or ``batch_size`` rows each.

    ``run_path`` commits every epoch and resumes (:mod:`stackwise.plans.runs`); ``on_epoch`` is told each epoch's error.
    """
    if init is None:
        n_vis = _width(samples, features)
        init = init_params(n_vis, n_hidden, seed)
    cfg = RBMConfig(momentum=momentum, alpha=alpha, k=k, seed=seed)
    return _fit(samples, init.copy(), cfg, epochs, n_batches, batch_size, False, features, run_path, on_epoch)


def gaussian_rbm_fit(samples: DataFrame, n_hidden: int | None = None, *, epochs: int = 1, n_batches: int | None = None,
                     batch_size: int | None = None, momentum: float = 0.0, alpha: float = 0.2, k: int = 1, seed: int = 0,
                     noise: str = "normal", init: RBMParams | None = None, features: str = "features",
                     sigma_rate: float = 1.0, run_path: str | None = None, on_epoch: OnEpoch | None = None) -> FitResult:
    """Gaussian-visible RBM with learned per-unit sigma (F5 + F6 each step).

    The 1/sigma velocity takes the mean sigma gradient unscaled, as the reference does;
    ``sigma_rate`` < 1 damps it (large alpha with no damping can diverge).
    """
    if noise not in ("normal", "uniform", "none"):
        raise ValueError("noise must be normal, uniform or none")
    if init is None:
        n_vis = _width(samples, features)
        init = init_params(n_vis, n_hidden, seed, gaussian=True)
    if init.sigma is None:
        init = init.copy()
        init.sigma = np.ones(init.n_visible)
        init.v_inv_sigma = np.zeros(init.n_visible)
    cfg = RBMConfig(momentum=momentum, alpha=alpha, k=k, seed=seed, noise=noise, sigma_rate=sigma_rate)
    return _fit(samples, init.copy(), cfg, epochs, n_batches, batch_size, True, features, run_path, on_epoch)


def rbm_fit_full_batch(samples: DataFrame, init: RBMParams | None = None, *, n_hidden: int = 5, epochs: int = 200,
                       alpha: float = 0.02, momentum: float = 0.1, seed: int = 0, features: str = "features", run_path: str | None = None,
                       on_epoch: OnEpoch | None = None) -> FitResult:
    """full-batch binary RBM, sampled states; the epoch error is the SUM over rows.

    Defaults as in the reference run: 5 hidden units, alpha 0.02, momentum 0.1, W and b
    drawn from N(0, 0.01), c = 0.
    """
    from stackwise.plans.batches import TrainingRows

    if init is None:
        n_vis = _width(samples, features)
        rng = np.random.default_rng(seed)
        init = RBMParams(W=rng.normal(0.0, 0.01, (n_hidden, n_vis)), b=rng.normal(0.0, 0.01, n_vis), c=np.zeros(n_hidden))
    log = _log(samples, run_path, stage="rbm_full_batch", shape=init.W.shape, init=zlib.crc32(init.W.tobytes()), alpha=alpha, momentum=momentum, seed=seed)
    done, p, history = _resumed(log, init.copy(), epochs)
    if done == epochs:
        return FitResult(p, history)
    with _rows(samples, features) as df, TrainingRows(df, 1, seed) as rows:
        for epoch in range(done, epochs):
            P = {"W": p.W, "b": p.b, "c": p.c, "alpha": np.array(alpha), "seed": np.array(derive_seed(seed, 200, epoch))}
            sums = step_sums(rows.rows, full_batch_binary_rows, P, _shapes(p, False), label=None, width=p.n_visible)
            n = sums["n"]
            if n <= 0:
                break
            q = p.copy()
            q.vW = momentum * p.vW + sums["dW"] / n
            q.vb = momentum * p.vb + sums["db"] / n
            q.vc = momentum * p.vc + sums["dc"] / n
            q.W, q.b, q.c = p.W + q.vW, p.b + q.vb, p.c + q.vc
            p = q
            history.append((epoch + 1, float(sums["err"])))
            _committed(log, on_epoch, p, *history[-1])
    return FitResult(p, history)


# --------------------------------------------------------------------------- projections

def rbm_hidden(df: DataFrame, p: RBMParams, col: str = "features", out: str = "hidden", scale_by_sigma: bool = False,
               method: str = "auto") -> DataFrame:
    """hidden probabilities sigm(v W^T + c), the input of the next layer."""
    from stackwise.operators.layers import dense_layer

    scale = p.sigma if (scale_by_sigma and p.sigma is not None) else None
    return dense_layer(df, col, p.W, p.c, "sigm", out, scale=scale, method=method)


def rbm_reconstruct(df: DataFrame, p: RBMParams, col: str = "features", out: str = "reconstruction", method: str = "auto") -> DataFrame:
    """mean-field reconstruction; Gaussian units give (h W) * sigma + b, binary sigm(h W + b)."""
    from stackwise.operators.layers import dense_layer

    h = dense_layer(df, col, p.W, p.c, "sigm", "_h", scale=p.sigma, method=method)
    if p.sigma is None:
        return dense_layer(h, "_h", p.W.T, p.b, "sigm", out, method=method).drop("_h")
    return dense_layer(h, "_h", p.sigma[:, None] * p.W.T, p.b, "linear", out, method=method).drop("_h")
