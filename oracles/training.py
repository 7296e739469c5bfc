"""Unrolled training steps as SQL: RBM / Gaussian RBM / DBN / network (F and G groups)."""

from __future__ import annotations

import numpy as np

from oracles.build import ONE, ZERO, Chain, act_grad, normal, params_rows, r6, uniform
from oracles.formulas import first_weights, fl, sql_act
from oracles.formulas import stream as derive_seed
from oracles.sql import ORACLES, em_inputs, li_inputs, numbered_inputs, oracle, slots, vector_slots
from stackwise.operators import nn as N
from stackwise.operators import sampling as S
from stackwise.plans import catalog as C
from stackwise.plans import fixtures as FX

SEED = C.SEED


# ============================================================================ RBM pieces

class RBMTabs:
    def __init__(self, ch: Chain, W, b, c, sigma=None):
        self.W = ch.mat(W)
        self.b = ch.vec(b)
        self.c = ch.vec(c)
        self.s = None if sigma is None else ch.vec(sigma)
        z = lambda n: ch.vec(np.zeros(n))
        self.vW = ch.mat(np.zeros_like(np.asarray(W, dtype=float)))
        self.vb = z(len(b))
        self.vc = z(len(c))
        self.vinv = None if sigma is None else z(len(sigma))


def binary_cd(ch: Chain, x: str, p: RBMTabs, step_seed: int, k: int = 1) -> dict:
    Wt = ch.transpose(p.W)
    h0 = ch.dense(x, p.W, p.c, "sigm")
    hk = h0
    for g in range(k):
        hs = ch.bernoulli(hk, derive_seed(step_seed, S.HIDDEN, g))
        v1 = ch.dense(hs, Wt, p.b, "sigm")
        hk = ch.dense(v1, p.W, p.c, "sigm")
    n = ch.count(x)
    pos, neg = ch.outer(h0, x), ch.outer(hk, v1)
    N_ = f"(SELECT n FROM {n})"
    return {
        "n": n,
        "dW": ch.add(f"SELECT p.j, p.i, (p.s - q.s) AS s FROM {pos} p JOIN {neg} q ON p.j = q.j AND p.i = q.i"),
        "db": ch.colsum(x, v1, "a.v - b.v"),
        "dc": ch.colsum(h0, hk, "a.v - b.v"),
        "err": ch.add(f"SELECT SUM((a.v - b.v) * (a.v - b.v)) AS s FROM {x} a JOIN {v1} b ON a.r = b.r AND a.i = b.i"),
        "N": N_,
    }


def gaussian_cd(ch: Chain, x: str, p: RBMTabs, step_seed: int, k: int = 1, noise: str = "normal") -> dict:
    xs = ch.scale(x, p.s, "/")
    h0 = ch.dense(xs, p.W, p.c, "sigm")
    hk = h0
    for g in range(k):
        hs = ch.bernoulli(hk, derive_seed(step_seed, S.HIDDEN, g))
        lin = ch.back(hs, p.W)
        ns = derive_seed(step_seed, S.RECON, g)
        term = {"normal": f" + {normal('l.r', 'l.i', ns)} * s.w", "uniform": f" + {uniform('l.r', 'l.i', ns)} * s.w", "none": ""}[noise]
        v1 = ch.add(f"SELECT l.r, l.i, (l.z * s.w + b.w){term} AS v FROM {lin} l JOIN {p.s} s ON l.i = s.i JOIN {p.b} b ON l.i = b.i")
        v1s = ch.scale(v1, p.s, "/")
        hk = ch.dense(v1s, p.W, p.c, "sigm")
    hw0, hw1 = ch.back(h0, p.W), ch.back(hk, p.W)

    def dterm(v, hw):
        return ch.add(f"SELECT a.r, a.i, a.v * (2.0e0 * b.w - a.v) / s.w + a.v * h.z AS v FROM {v} a JOIN {p.b} b ON a.i = b.i "
                      f"JOIN {p.s} s ON a.i = s.i JOIN {hw} h ON a.r = h.r AND a.i = h.i")

    d0, d1 = dterm(x, hw0), dterm(v1, hw1)
    n = ch.count(x)
    pos, neg = ch.outer(h0, xs), ch.outer(hk, v1s)
    return {
        "n": n,
        "dW": ch.add(f"SELECT p.j, p.i, (p.s - q.s) AS s FROM {pos} p JOIN {neg} q ON p.j = q.j AND p.i = q.i"),
        "db": ch.add(f"SELECT a.i, SUM((a.v - b.v) / (s.w * s.w)) AS s FROM {x} a JOIN {v1} b ON a.r = b.r AND a.i = b.i "
                     f"JOIN {p.s} s ON a.i = s.i GROUP BY a.i"),
        "dc": ch.colsum(h0, hk, "a.v - b.v"),
        "dsig": ch.colsum(d0, d1, "a.v - b.v"),
        "err": ch.add(f"SELECT SUM((a.v - b.v) * (a.v - b.v)) AS s FROM {x} a JOIN {v1} b ON a.r = b.r AND a.i = b.i"),
        "N": f"(SELECT n FROM {n})",
    }


def full_batch_binary(ch: Chain, x: str, p: RBMTabs, seed: int, alpha: float) -> dict:
    Wt = ch.transpose(p.W)
    h1 = ch.bernoulli(ch.dense(x, p.W, p.c, "sigm"), derive_seed(seed, S.HIDDEN, 0))
    v2 = ch.bernoulli(ch.dense(h1, Wt, p.b, "sigm"), derive_seed(seed, S.VISIBLE, 0))
    h2 = ch.bernoulli(ch.dense(v2, p.W, p.c, "sigm"), derive_seed(seed, S.HIDDEN, 1))
    n = ch.count(x)
    pos, neg = ch.outer(h1, x), ch.outer(h2, v2)
    a = fl(alpha)
    return {
        "n": n,
        "dW": ch.add(f"SELECT p.j, p.i, {a} * (p.s - q.s) AS s FROM {pos} p JOIN {neg} q ON p.j = q.j AND p.i = q.i"),
        "db": ch.add(f"SELECT i, {a} * s AS s FROM {ch.colsum(x, v2, 'a.v - b.v')}"),
        "dc": ch.add(f"SELECT i, {a} * s AS s FROM {ch.colsum(h1, h2, 'a.v - b.v')}"),
        "err": ch.add(f"SELECT SUM((a.v - b.v) * (a.v - b.v)) AS s FROM {x} a JOIN {v2} b ON a.r = b.r AND a.i = b.i"),
        "N": f"(SELECT n FROM {n})",
    }


def sums_as_means(ch: Chain, st: dict, names) -> str:
    """(param, out, in, value) rows of sums / n for a single step, plus n."""
    items = []
    for name in names:
        src = st[name]
        if name == "dW":
            t = ch.add(f"SELECT j, i, s / {st['N']} AS w FROM {src}")
            items.append((name, t, "mat"))
        elif name == "err":
            t = ch.add(f"SELECT s / {st['N']} AS w FROM {src}")
            items.append((name, t, "scalar"))
        else:
            t = ch.add(f"SELECT i, s / {st['N']} AS w FROM {src}")
            items.append((name, t, "vec"))
    items.append(("n", ch.add(f"SELECT n AS w FROM {st['n']}"), "scalar"))
    return params_rows(items)


def cd_update(ch: Chain, p: RBMTabs, st: dict, momentum: float, alpha: float, gaussian: bool, prescaled: bool = False) -> RBMTabs:
    """Momentum update; returns the next parameter tables. ``prescaled``: sums already carry alpha."""
    m, a, Nn = fl(momentum), fl(alpha), st["N"]
    q = RBMTabs.__new__(RBMTabs)
    mult = "" if prescaled else f"{a} * "
    q.vW = ch.add(f"SELECT v.j, v.i, {m} * v.w + {mult}d.s / {Nn} AS w FROM {p.vW} v JOIN {st['dW']} d ON v.j = d.j AND v.i = d.i")
    q.vb = ch.add(f"SELECT v.i, {m} * v.w + {mult}d.s / {Nn} AS w FROM {p.vb} v JOIN {st['db']} d ON v.i = d.i")
    q.vc = ch.add(f"SELECT v.i, {m} * v.w + {mult}d.s / {Nn} AS w FROM {p.vc} v JOIN {st['dc']} d ON v.i = d.i")
    q.W = ch.add(f"SELECT w.j, w.i, w.w + v.w AS w FROM {p.W} w JOIN {q.vW} v ON w.j = v.j AND w.i = v.i")
    q.b = ch.add(f"SELECT w.i, w.w + v.w AS w FROM {p.b} w JOIN {q.vb} v ON w.i = v.i")
    q.c = ch.add(f"SELECT w.i, w.w + v.w AS w FROM {p.c} w JOIN {q.vc} v ON w.i = v.i")
    q.s, q.vinv = p.s, p.vinv
    if gaussian:
        q.vinv = ch.add(f"SELECT v.i, {m} * v.w + d.s / {Nn} AS w FROM {p.vinv} v JOIN {st['dsig']} d ON v.i = d.i")
        inv = ch.add(f"SELECT s.i, 1.0e0 / s.w + v.w AS inv FROM {p.s} s JOIN {q.vinv} v ON s.i = v.i")
        q.s = ch.add(f"SELECT i, CASE WHEN inv > 0 THEN GREATEST(1.0e0 / inv, 0.005e0) ELSE 0.005e0 END AS w FROM {inv}")
    return q


def err_mean(ch: Chain, st: dict) -> str:
    return ch.add(f"SELECT s / {st['N']} AS w FROM {st['err']}")


def batch_rows(ch: Chain, x: str, nb: int, seed: int, epoch: int, bno: int) -> str:
    """Rows of one batch: 8 nb buckets by a draw on the row, put in order by fresh draws, 8 buckets a batch."""
    n = 8 * nb
    order = ch.add(f"SELECT k, (row_number() OVER (ORDER BY {uniform('k', '0', derive_seed(seed, S.BATCH, epoch))}, k) - 1) // 8 AS b "
                   f"FROM (SELECT unnest(generate_series(0, {n - 1})) AS k)")
    bucket = f"CAST(LEAST(FLOOR({uniform('r', '0', derive_seed(seed, S.BATCH))} * {fl(n)}), {n - 1}) AS BIGINT)"
    return ch.add(f"SELECT * FROM {x} WHERE {bucket} IN (SELECT k FROM {order} WHERE b = {bno})")


# ============================================================================ RBM queries

@oracle("rbm_cd_binary")
def _():
    W, b, c = FX.em_rbm()
    ch = Chain()
    _, x, _ = em_inputs(ch, binary=True)
    st = full_batch_binary(ch, x, RBMTabs(ch, W, b, c), SEED, 0.02)
    return ch.render(sums_as_means(ch, st, ["dW", "db", "dc", "err"]))


@oracle("rbm_fit_full_batch")
def _():
    W, b, c = FX.em_rbm()
    ch = Chain()
    _, x, _ = em_inputs(ch, binary=True)
    p = RBMTabs(ch, W, b, c)
    errs = []
    for epoch in range(2):
        st = full_batch_binary(ch, x, p, derive_seed(SEED, 200, epoch), 0.02)
        errs.append(st["err"])
        p = cd_update(ch, p, st, 0.1, 1.0, False, prescaled=True)
    err = ch.add(" UNION ALL ".join(f"SELECT {e} AS i, s AS w FROM {t}" for e, t in enumerate(errs)))
    return ch.render(params_rows([("W", p.W, "mat"), ("b", p.b, "vec"), ("c", p.c, "vec"), ("err", err, "vec")]))


def _cd_step(gaussian: bool, k: int = 1, binary_input: bool = True):
    W, b, c = FX.em_rbm()
    ch = Chain()
    _, x, _ = em_inputs(ch, binary=binary_input)
    p = RBMTabs(ch, W, b, c, FX.em_sigma() if gaussian else None)
    st = gaussian_cd(ch, x, p, SEED, k) if gaussian else binary_cd(ch, x, p, SEED, k)
    names = ["dW", "db", "dc", "err"] + (["dsig"] if gaussian else [])
    return ch.render(sums_as_means(ch, st, names))


ORACLES["rbm_cd_step"] = _cd_step(False)
ORACLES["cd_k"] = _cd_step(False, k=2)
ORACLES["gaussian_rbm_cd_step"] = _cd_step(True, binary_input=False)


@oracle("gaussian_rbm_sigma_step")
def _():
    W, b, c = FX.em_rbm()
    ch = Chain()
    _, x, _ = em_inputs(ch)
    p = RBMTabs(ch, W, b, c, FX.em_sigma())
    st = gaussian_cd(ch, x, p, SEED)
    q = cd_update(ch, p, st, 0.1, 0.05, True)
    return ch.render(params_rows([("sigma", q.s, "vec"), ("v_inv_sigma", q.vinv, "vec")]))


@oracle("rbm_fit")
def _():
    W, b, c = FX.em_rbm()
    ch = Chain()
    _, x, _ = em_inputs(ch, binary=True)
    p = RBMTabs(ch, W, b, c)
    errs = []
    for bno in range(2):
        xb = batch_rows(ch, x, 2, SEED, 0, bno)
        st = binary_cd(ch, xb, p, derive_seed(SEED, 100, 0, bno))
        errs.append(err_mean(ch, st))
        p = cd_update(ch, p, st, 0.5, 0.1, False)
    err = ch.add(f"SELECT ((SELECT w FROM {errs[0]}) + (SELECT w FROM {errs[1]})) / 2 AS w")
    return ch.render(params_rows([("W", p.W, "mat"), ("b", p.b, "vec"), ("c", p.c, "vec"), ("err", err, "scalar")]))


def gaussian_fit_sql(ch: Chain, x: str, p: RBMTabs, *, epochs: int, momentum: float, alpha: float, seed: int):
    errs = []
    for epoch in range(epochs):
        st = gaussian_cd(ch, x, p, derive_seed(seed, 100, epoch, 0))
        errs.append(err_mean(ch, st))
        p = cd_update(ch, p, st, momentum, alpha, True)
    return p, errs


def binary_fit_sql(ch: Chain, x: str, p: RBMTabs, *, epochs: int, momentum: float, alpha: float, seed: int):
    errs = []
    for epoch in range(epochs):
        st = binary_cd(ch, x, p, derive_seed(seed, 100, epoch, 0))
        errs.append(err_mean(ch, st))
        p = cd_update(ch, p, st, momentum, alpha, False)
    return p, errs


@oracle("gaussian_rbm_fit")
def _():
    W, b, c = FX.em_rbm()
    ch = Chain()
    _, x, _ = em_inputs(ch)
    p, errs = gaussian_fit_sql(ch, x, RBMTabs(ch, W, b, c, FX.em_sigma()), epochs=2, momentum=0.1, alpha=0.05, seed=SEED)
    err = ch.add(" UNION ALL ".join(f"SELECT {e} AS i, w FROM {t}" for e, t in enumerate(errs)))
    return ch.render(params_rows([("W", p.W, "mat"), ("b", p.b, "vec"), ("c", p.c, "vec"), ("sigma", p.s, "vec"), ("err", err, "vec")]))


@oracle("rbm_fit_unkeyed")
def _():
    W, c, b = FX.li_layer()
    ch = Chain()
    x, _ = numbered_inputs(ch)
    p, errs = gaussian_fit_sql(ch, x, RBMTabs(ch, W, b, c, np.ones(4)), epochs=2, momentum=0.1, alpha=0.05, seed=SEED)
    err = ch.add(" UNION ALL ".join(f"SELECT {e} AS i, w FROM {t}" for e, t in enumerate(errs)))
    return ch.render(params_rows([("W", p.W, "mat"), ("b", p.b, "vec"), ("c", p.c, "vec"), ("sigma", p.s, "vec"), ("err", err, "vec")]))


@oracle("rbm_hidden")
def _():
    W, b, c = FX.em_rbm()
    ch = Chain()
    _, x, _ = em_inputs(ch)
    return ch.render(slots(ch.dense(x, ch.mat(W), ch.vec(c), "sigm"), "hidden", range(4)))


@oracle("rbm_reconstruct")
def _():
    W, b, c = FX.em_rbm()
    ch = Chain()
    _, x, _ = em_inputs(ch)
    p = RBMTabs(ch, W, b, c, FX.em_sigma())
    h = ch.dense(ch.scale(x, p.s, "/"), p.W, p.c, "sigm")
    lin = ch.back(h, p.W)
    rec = ch.add(f"SELECT l.r, l.i, l.z * s.w + b.w AS v FROM {lin} l JOIN {p.s} s ON l.i = s.i JOIN {p.b} b ON l.i = b.i")
    return ch.render(slots(rec, "r", (0, 31, 63), f"{r6('SUM(v)')} AS total, "))


def pretrain_sql(ch: Chain, x: str, inits, *, momentum: float, alpha: float, seed: int):
    (W1, b1, c1), (W2, b2, c2) = inits
    p1, _ = gaussian_fit_sql(ch, x, RBMTabs(ch, W1, b1, c1, np.ones(FX.EM_WIDTH)), epochs=1, momentum=momentum, alpha=alpha,
                             seed=derive_seed(seed, 400, 0))
    h = ch.dense(x, p1.W, p1.c, "sigm")
    p2, _ = binary_fit_sql(ch, h, RBMTabs(ch, W2, b2, c2), epochs=1, momentum=momentum, alpha=alpha, seed=derive_seed(seed, 400, 1))
    return p1, p2


@oracle("dbn_pretrain")
def _():
    ch = Chain()
    _, x, _ = em_inputs(ch)
    p1, p2 = pretrain_sql(ch, x, FX.em_dbn(), momentum=0.01, alpha=0.05, seed=SEED)
    return ch.render(params_rows([("W0", p1.W, "mat"), ("b0", p1.b, "vec"), ("c0", p1.c, "vec"),
                                  ("W1", p2.W, "mat"), ("b1", p2.b, "vec"), ("c1", p2.c, "vec"), ("sigma", p1.s, "vec")]))


@oracle("dbn_transform")
def _():
    (W1, b1, c1), (W2, b2, c2) = FX.em_dbn()
    ch = Chain()
    _, x, _ = em_inputs(ch)
    h1 = ch.dense(x, ch.mat(W1), ch.vec(c1), "sigm")
    h2 = ch.dense(h1, ch.mat(W2), ch.vec(c2), "sigm")
    return ch.render(slots(h2, "top", range(4)))


# ============================================================================ network pieces

def bias_mat(ch: Chain, Wb) -> str:
    return ch.mat(Wb)


def nn_forward_sql(ch: Chain, x: str, Ws: list, act: str, out: str, *, training: bool = False, dropout: float = 0.0,
                   noise: float = 0.0, step_seed: int = 0):
    """a[0] input with bias rows, a[l] hidden with bias rows, a[-1] output; masks per hidden layer."""
    L = len(Ws) + 1
    if training and noise > 0:
        u = uniform("r", "i", derive_seed(step_seed, S.NOISE))
        x = ch.add(f"SELECT r, i, CASE WHEN {u} >= {fl(noise)} THEN v ELSE {ZERO} END AS v FROM {x}")
    a = [ch.add_bias_rows(x)]
    masks = [None]
    for l in range(1, L - 1):
        z = ch.add(f"SELECT a.r, w.j, SUM(a.v * w.w) AS z FROM {a[-1]} a JOIN {Ws[l - 1]} w ON a.i = w.i GROUP BY a.r, w.j")
        h = ch.add(f"SELECT r, j AS i, {sql_act(act, 'z')} AS v FROM {z}")
        mask = None
        if dropout > 0:
            if training:
                u = uniform("r", "i", derive_seed(step_seed, S.DROPOUT, l))
                mask = ch.add(f"SELECT r, i, CASE WHEN {u} > {fl(dropout)} THEN {ONE} ELSE {ZERO} END AS v FROM {h}")
                h = ch.add(f"SELECT h.r, h.i, h.v * m.v AS v FROM {h} h JOIN {mask} m ON h.r = m.r AND h.i = m.i")
            else:
                h = ch.add(f"SELECT r, i, v * {fl(1.0 - dropout)} AS v FROM {h}")
        masks.append(mask)
        a.append(ch.add_bias_rows(h))
    z = ch.add(f"SELECT a.r, w.j, SUM(a.v * w.w) AS z FROM {a[-1]} a JOIN {Ws[-1]} w ON a.i = w.i GROUP BY a.r, w.j")
    a.append(ch.add(f"SELECT r, j AS i, {sql_act(out, 'z')} AS v FROM {z}"))
    return a, masks


def nn_error(ch: Chain, y: str, o: str) -> str:
    return ch.add(f"SELECT y.r, y.i, y.v - o.v AS v FROM {y} y JOIN {o} o ON y.r = o.r AND y.i = o.i")


def nn_loss_sql(ch: Chain, e: str, n: str) -> str:
    """0.5 * sum ||e||^2 / n as table (w)."""
    return ch.add(f"SELECT 0.5e0 * SUM(v * v) / (SELECT n FROM {n}) AS w FROM {e}")


def hidden_act_sums(ch: Chain, a: list, n: str, p_old: dict, decay: float) -> dict:
    """E7 running activity per hidden layer: 0.01 * sum / n + decay * old."""
    p = {}
    for l in range(1, len(a) - 1):
        p[l] = ch.add(f"SELECT x.i - 1 AS i, 0.01e0 * SUM(x.v) / (SELECT n FROM {n}) + {fl(decay)} * o.w AS w FROM {a[l]} x "
                      f"JOIN {p_old[l]} o ON x.i - 1 = o.i WHERE x.i > 0 GROUP BY x.i, o.w")
    return p


def nn_grads_sql(ch: Chain, a: list, masks: list, y: str, Ws: list, act: str, out: str, n: str, *, training: bool = True,
                 dropout: float = 0.0, sparsity: float = 0.0, target: float = 0.05, p: dict | None = None):
    L = len(a)
    o = a[-1]
    e = nn_error(ch, y, o)
    if out == "sigm":
        d_out = ch.add(f"SELECT e.r, e.i, -e.v * o.v * (1.0e0 - o.v) AS v FROM {e} e JOIN {o} o ON e.r = o.r AND e.i = o.i")
    else:
        d_out = ch.add(f"SELECT r, i, -v AS v FROM {e}")
    d = {L - 1: d_out}

    def strip_bias(l):
        # deltas of layer l + 1 without the bias slot (the output layer has none)
        if l + 1 == L - 1:
            return d[l + 1]
        return ch.add(f"SELECT r, i - 1 AS i, v FROM {d[l + 1]} WHERE i > 0")

    for l in range(L - 2, 0, -1):
        nx = strip_bias(l)
        back = ch.add(f"SELECT n.r, w.i, SUM(n.v * w.w) AS z FROM {nx} n JOIN {Ws[l]} w ON n.i = w.j GROUP BY n.r, w.i")
        if sparsity > 0:
            term = f"{fl(sparsity)} * ({fl(-target)} / q.w + {fl(1.0 - target)} / (1.0e0 - q.w))"
            back = ch.add(f"SELECT b.r, b.i, b.z + CASE WHEN b.i > 0 THEN {term} ELSE {ZERO} END AS z FROM {back} b "
                          f"LEFT JOIN {p[l]} q ON b.i - 1 = q.i")
        dl = ch.add(f"SELECT b.r, b.i, b.z * {act_grad(act, 'a.v')} AS v FROM {back} b JOIN {a[l]} a ON b.r = a.r AND b.i = a.i")
        if dropout > 0 and training:
            dl = ch.add(f"SELECT d.r, d.i, d.v * CASE WHEN d.i = 0 THEN {ONE} ELSE m.v END AS v FROM {dl} d "
                        f"LEFT JOIN {masks[l]} m ON d.r = m.r AND d.i - 1 = m.i")
        d[l] = dl
    grads = []
    for l in range(L - 1):
        nx = strip_bias(l)
        grads.append(ch.add(f"SELECT n.i AS j, a.i AS i, SUM(n.v * a.v) / (SELECT n FROM {n}) AS w FROM {nx} n "
                            f"JOIN {a[l]} a ON n.r = a.r GROUP BY n.i, a.i"))
    loss = nn_loss_sql(ch, e, n)
    return grads, loss


def apply_grads_sql(ch: Chain, Ws, vWs, grads, *, lr: float, momentum: float, l2: float = 0.0, l2_on: str = "weights"):
    W2, V2 = [], []
    for w, v, g in zip(Ws, vWs, grads):
        dw = "g.w"
        if l2 > 0:
            ref = "w.w" if l2_on == "weights" else "g.w"
            dw = f"(g.w + {fl(l2)} * CASE WHEN g.i > 0 THEN {ref} ELSE {ZERO} END)"
        dw = f"{fl(lr)} * {dw}"
        if momentum > 0:
            dw = f"{dw} + {fl(momentum)} * v.w"
        step = ch.add(f"SELECT g.j, g.i, {dw} AS d, w.w AS w0, v.w AS v0 FROM {g} g JOIN {w} w ON g.j = w.j AND g.i = w.i "
                      f"JOIN {v} v ON g.j = v.j AND g.i = v.i")
        W2.append(ch.add(f"SELECT j, i, w0 - d AS w FROM {step}"))
        V2.append(ch.add(f"SELECT j, i, d AS w FROM {step}") if momentum > 0 else v)
    return W2, V2


def nn_fit_sql(ch: Chain, x: str, y: str, W0: list, cfg: N.NNConfig, *, epochs: int, nb: int = 1, val: tuple | None = None):
    Ws = [ch.mat(w) for w in W0]
    vWs = [ch.mat(np.zeros_like(np.asarray(w))) for w in W0]
    p = {l: ch.vec(np.zeros(cfg.sizes[l])) for l in range(1, cfg.n_layers - 1)}
    lr = cfg.learning_rate
    hist = []
    for epoch in range(epochs):
        for bno in range(nb):
            xb, yb = x, y
            if nb > 1:
                xb = batch_rows(ch, x, nb, cfg.seed, epoch, bno)
                yb = batch_rows(ch, y, nb, cfg.seed, epoch, bno)
            step_seed = derive_seed(cfg.seed, 300, epoch, bno)
            n = ch.count(xb)
            a, masks = nn_forward_sql(ch, xb, Ws, cfg.activation, cfg.output, training=True, dropout=cfg.dropout,
                                      noise=cfg.noise, step_seed=step_seed)
            if cfg.sparsity > 0:
                p = hidden_act_sums(ch, a, n, p, cfg.decay)
            grads, _ = nn_grads_sql(ch, a, masks, yb, Ws, cfg.activation, cfg.output, n, training=True, dropout=cfg.dropout,
                                    sparsity=cfg.sparsity, target=cfg.sparsity_target, p=p)
            Ws, vWs = apply_grads_sql(ch, Ws, vWs, grads, lr=lr, momentum=cfg.momentum, l2=cfg.l2, l2_on=cfg.l2_on)
        tr = eval_sql(ch, x, y, Ws, cfg)
        va = eval_sql(ch, val[0], val[1], Ws, cfg) if val is not None else ch.add(f"SELECT {ZERO} AS w")
        hist.append((tr, va))
        lr = lr * cfg.scaling_learning_rate
    return Ws, hist


def eval_sql(ch: Chain, x: str, y: str, Ws: list, cfg: N.NNConfig) -> str:
    n = ch.count(x)
    a, _ = nn_forward_sql(ch, x, Ws, cfg.activation, cfg.output, training=False, dropout=cfg.dropout)
    return nn_loss_sql(ch, nn_error(ch, y, a[-1]), n)


def hist_rows(ch: Chain, hist) -> list:
    tr = ch.add(" UNION ALL ".join(f"SELECT {e} AS i, w FROM {t}" for e, (t, _) in enumerate(hist)))
    va = ch.add(" UNION ALL ".join(f"SELECT {e} AS i, w FROM {v}" for e, (_, v) in enumerate(hist)))
    return [("train_error", tr, "vec"), ("val_error", va, "vec")]


# ============================================================================ network queries

LI_CFG = C.LI_CFG


@oracle("nn_forward")
def _():
    ch = Chain()
    x, y = numbered_inputs(ch)
    a, _ = nn_forward_sql(ch, x, [ch.mat(w) for w in FX.li_weights()], "sigm", "sigm")
    return ch.render(vector_slots([(a[1], "a1", 4), (a[2], "a2", 3), (nn_error(ch, y, a[-1]), "error", 3)]))


def _grad_rows(ch, x, y, W0, act, out, tag, **kw):
    Ws = [ch.mat(w) for w in W0]
    n = ch.count(x)
    a, masks = nn_forward_sql(ch, x, Ws, act, out)
    grads, loss = nn_grads_sql(ch, a, masks, y, Ws, act, out, n, **kw)
    return [(f"{tag}g{l}", g, "mat") for l, g in enumerate(grads)] + [(f"{tag}loss", loss, "scalar")], a, n


@oracle("nn_gradient")
def _():
    ch = Chain()
    _, x, y = li_inputs(ch)
    items1, _, _ = _grad_rows(ch, x, y, FX.li_weights(), "sigm", "sigm", "sigm_")
    items2, _, _ = _grad_rows(ch, x, y, FX.li_weights(), "tanh_opt", "linear", "tanh_")
    return ch.render(params_rows(items1 + items2))


@oracle("nn_sparsity_penalty")
def _():
    ch = Chain()
    _, x, y = li_inputs(ch)
    Ws = [ch.mat(w) for w in FX.li_weights()]
    n = ch.count(x)
    a, masks = nn_forward_sql(ch, x, Ws, "sigm", "sigm")
    p = hidden_act_sums(ch, a, n, {1: ch.vec(np.zeros(3))}, 0.99)
    grads, loss = nn_grads_sql(ch, a, masks, y, Ws, "sigm", "sigm", n, sparsity=0.1, target=0.05, p=p)
    items = [(f"g{l}", g, "mat") for l, g in enumerate(grads)] + [("loss", loss, "scalar"), ("p1", p[1], "vec")]
    return ch.render(params_rows(items))


@oracle("nn_step")
def _():
    ch = Chain()
    _, x, y = li_inputs(ch)
    W0 = FX.li_weights()
    Ws = [ch.mat(w) for w in W0]
    vWs = [ch.mat(np.zeros_like(w)) for w in W0]
    n = ch.count(x)
    a, masks = nn_forward_sql(ch, x, Ws, "sigm", "sigm")
    grads, _ = nn_grads_sql(ch, a, masks, y, Ws, "sigm", "sigm", n)
    W2, V2 = apply_grads_sql(ch, Ws, vWs, grads, lr=LI_CFG.learning_rate, momentum=LI_CFG.momentum)
    return ch.render(params_rows([("W0", W2[0], "mat"), ("W1", W2[1], "mat"), ("vW0", V2[0], "mat"), ("vW1", V2[1], "mat")]))


def _held_out(ch: Chain, x: str, y: str, fraction: float, seed: int) -> tuple[str, str, tuple | None]:
    """Training rows, and those whose draw lies below the fraction."""
    if fraction <= 0:
        return x, y, None
    u, cut = uniform("r", "0", derive_seed(seed, S.SPLIT)), fl(fraction)
    held = tuple(ch.add(f"SELECT * FROM {t} WHERE {u} < {cut}") for t in (x, y))
    return (*(ch.add(f"SELECT * FROM {t} WHERE NOT ({u} < {cut})") for t in (x, y)), held)


def _fit_variant(name: str) -> str:
    spec = C.EM_FIT_VARIANTS[name]
    cfg = C.em_cfg(**spec["cfg"])
    ch = Chain()
    _, x, y = em_inputs(ch)
    x, y, val = _held_out(ch, x, y, spec["validation"], cfg.seed)
    Ws, hist = nn_fit_sql(ch, x, y, FX.em_weights(), cfg, epochs=spec["epochs"], nb=spec["n_batches"], val=val)
    return ch.render(params_rows([("W0", Ws[0], "mat"), ("W1", Ws[1], "mat")] + hist_rows(ch, hist)))


@oracle("training_run")
def _():
    cfg = C.em_cfg(dropout=0.2, scaling_learning_rate=0.5)
    ch = Chain()
    _, x, y = em_inputs(ch)
    x, y, val = _held_out(ch, x, y, 0.3, cfg.seed)
    Ws, hist = nn_fit_sql(ch, x, y, FX.em_weights(), cfg, epochs=3, nb=2, val=val)
    return ch.render(params_rows([("W0", Ws[0], "mat"), ("W1", Ws[1], "mat")] + hist_rows(ch, hist)))


@oracle("nn_fit_unkeyed")
def _():
    cfg = N.NNConfig(sizes=FX.LI_SIZES, activation="sigm", output="sigm", learning_rate=1.0, momentum=0.5, noise=0.2, dropout=0.3, seed=SEED)
    ch = Chain()
    x, y, val = _held_out(ch, *numbered_inputs(ch), 0.3, SEED)
    Ws, hist = nn_fit_sql(ch, x, y, FX.li_weights(), cfg, epochs=2, val=val)
    return ch.render(params_rows([("W0", Ws[0], "mat"), ("W1", Ws[1], "mat")] + hist_rows(ch, hist)))


for _name in C.EM_FIT_VARIANTS:
    ORACLES[_name] = _fit_variant(_name)


@oracle("nn_evaluate")
def _():
    ch = Chain()
    _, x, y = li_inputs(ch)
    cfg = N.NNConfig(sizes=FX.LI_SIZES, activation="sigm", output="sigm", dropout=0.2)
    loss = eval_sql(ch, x, y, [ch.mat(w) for w in FX.li_weights()], cfg)
    return ch.render(f"SELECT {r6('w')} AS loss FROM {loss}")


def _li_pred(ch):
    _, x, y = li_inputs(ch)
    a, _ = nn_forward_sql(ch, x, [ch.mat(w) for w in FX.li_weights()], "sigm", "sigm")
    return x, y, a[-1], nn_error(ch, y, a[-1])


@oracle("nn_predict")
def _():
    ch = Chain()
    _, _, o, e = _li_pred(ch)
    cols = ", ".join(f"{r6(f'MAX(CASE WHEN p.i = {i} THEN p.{c} END)')} AS {name}{i}" for name, c in (("predict_label", "o"), ("error", "e")) for i in range(3))
    both = ch.add(f"SELECT o.r, o.i, o.v AS o, e.v AS e FROM {o} o JOIN {e} e ON o.r = e.r AND o.i = e.i")
    rows = ch.add(f"SELECT p.r, {cols} FROM {both} p GROUP BY p.r")
    return ch.render(f"SELECT * EXCLUDE (r) FROM {rows}")


@oracle("nn_loss")
def _():
    ch = Chain()
    x, _, _, e = _li_pred(ch)
    loss = nn_loss_sql(ch, e, ch.count(x))
    return ch.render(f"SELECT {r6('w')} AS loss FROM {loss}")


@oracle("threshold_labels")
def _():
    ch = Chain()
    _, _, o, _ = _li_pred(ch)
    hit = lambda i: f"MAX(CASE WHEN i = {i} THEN CASE WHEN v > {fl(0.3333333)} THEN {ONE} ELSE {ZERO} END END) AS predicted{i}"
    rows = ch.add(f"SELECT r, {', '.join(hit(i) for i in range(3))} FROM {o} GROUP BY r")
    return ch.render(f"SELECT predicted0, predicted1, predicted2, CAST(COUNT(*) AS BIGINT) AS n FROM {rows} GROUP BY 1, 2, 3")


@oracle("label_hit_rate")
def _():
    ch = Chain()
    _, y, o, _ = _li_pred(ch)
    per_row = ch.add(f"SELECT y.r, SUM(y.v * CASE WHEN o.v > {fl(0.3333333)} THEN {ONE} ELSE {ZERO} END) AS h FROM {y} y "
                     f"JOIN {o} o ON y.r = o.r AND y.i = o.i GROUP BY y.r")
    return ch.render(f"SELECT {r6('AVG(h)')} AS hit_rate FROM {per_row}")


@oracle("score_written")
def _():
    ch = Chain()
    x, y, o, e = _li_pred(ch)
    loss = nn_loss_sql(ch, e, ch.count(x))
    per_row = ch.add(f"SELECT y.r, SUM(y.v * CASE WHEN o.v > {fl(0.3333333)} THEN {ONE} ELSE {ZERO} END) AS h FROM {y} y "
                     f"JOIN {o} o ON y.r = o.r AND y.i = o.i GROUP BY y.r")
    hit = lambda i: f"MAX(CASE WHEN i = {i} THEN CASE WHEN v > {fl(0.3333333)} THEN {ONE} ELSE {ZERO} END END) AS predicted{i}"
    rows = ch.add(f"SELECT r, {', '.join(hit(i) for i in range(3))} FROM {o} GROUP BY r")
    return ch.render(f"SELECT predicted0, predicted1, predicted2, CAST(COUNT(*) AS BIGINT) AS n, {r6(f'(SELECT w FROM {loss})')} AS loss, "
                     f"{r6(f'(SELECT AVG(h) FROM {per_row})')} AS hit_rate, (SELECT CAST(COUNT(*) AS BIGINT) FROM lineitem) AS rows FROM {rows} GROUP BY 1, 2, 3")


@oracle("nn_predict_wide")
def _():
    ch = Chain()
    _, x, _ = em_inputs(ch)
    a, _ = nn_forward_sql(ch, x, [ch.mat(w) for w in FX.em_wide_net()], "sigm", "sigm")
    cols = ", ".join(f"{r6(f'MAX(CASE WHEN i = {i} THEN v END)')} AS p{i}" for i in range(10))
    return ch.render(f"SELECT r AS row_id, {cols} FROM {a[-1]} GROUP BY r")


@oracle("score_unfolded")
def _():
    (W1, b1, c1), (W2, b2, c2) = FX.em_dbn()
    ch = Chain()
    _, x, _ = em_inputs(ch)
    Ws = [ch.mat(np.concatenate([c1[:, None], W1], axis=1)), ch.mat(np.concatenate([c2[:, None], W2], axis=1)), ch.mat(first_weights(4, 10, SEED))]
    a, _ = nn_forward_sql(ch, x, Ws, "sigm", "sigm")
    return ch.render(vector_slots([(a[-1], "predict_label", 10)]))


@oracle("dbn_finetune")
def _():
    (W1, b1, c1), _ = FX.em_dbn()
    W2, b2, c2 = FX.fixed((10, 6), 61, 0.5), FX.fixed((6,), 62, 0.1), FX.fixed((10,), 63, 0.1)
    ch = Chain()
    _, x, y = em_inputs(ch)
    p1, p2 = pretrain_sql(ch, x, [(W1, b1, c1), (W2, b2, c2)], momentum=0.01, alpha=0.05, seed=SEED)
    # unfold: [c | W] with the bias in column 0
    U = []
    for p in (p1, p2):
        U.append(ch.add(f"SELECT j, i + 1 AS i, w FROM {p.W} UNION ALL SELECT i AS j, 0 AS i, w FROM {p.c}"))
    cfg = N.NNConfig(sizes=(FX.EM_WIDTH, 6, 10), activation="sigm", output="sigm", seed=SEED, learning_rate=1.0, momentum=0.5)
    Ws = U
    vWs = [ch.mat(np.zeros((6, FX.EM_WIDTH + 1))), ch.mat(np.zeros((10, 7)))]
    n = ch.count(x)
    a, masks = nn_forward_sql(ch, x, Ws, "sigm", "sigm", training=True, step_seed=derive_seed(SEED, 300, 0, 0))
    grads, _ = nn_grads_sql(ch, a, masks, y, Ws, "sigm", "sigm", n)
    Ws, _ = apply_grads_sql(ch, Ws, vWs, grads, lr=1.0, momentum=0.5)
    tr = eval_sql(ch, x, y, Ws, cfg)
    hist = ch.add(f"SELECT 0 AS i, w FROM {tr}")
    return ch.render(params_rows([("W0", Ws[0], "mat"), ("W1", Ws[1], "mat"), ("train_error", hist, "vec")]))


@oracle("training_history")
def _():
    # A5: the per-epoch history of the full-batch binary RBM (3 epochs); sums of binary
    # squared errors are whole numbers, so no rounding is involved
    W, b, c = FX.em_rbm(5)
    ch = Chain()
    _, x, _ = em_inputs(ch, binary=True)
    p = RBMTabs(ch, W, b, c)
    errs = []
    for epoch in range(3):
        st = full_batch_binary(ch, x, p, derive_seed(SEED, 200, epoch), 0.02)
        errs.append(st["err"])
        p = cd_update(ch, p, st, 0.1, 1.0, False, prescaled=True)
    return ch.render(" UNION ALL ".join(
        f"SELECT 'rbm_full_batch' AS stage, CAST({e + 1} AS INTEGER) AS epoch, s AS train_error, "
        f"CAST(NULL AS DOUBLE) AS val_error FROM {t}" for e, t in enumerate(errs)))
