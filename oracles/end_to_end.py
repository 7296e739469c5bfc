"""SQL for the flagship (H3): prepare the well table -> pretrain -> unfold -> fine-tune -> score.

The steps are unrolled: epochs times ``N_BATCHES`` for every layer. A step whose batch is empty
keeps the parameters, as the Spark trainers do. Each update is fused with its guard and each dense
layer is one CTE, which keeps the chain within DuckDB's default expression depth.
"""

from __future__ import annotations

import numpy as np

from oracles.build import ONE, ZERO, Chain, params_rows, r6
from oracles.formulas import fl
from oracles.formulas import stream as derive_seed
from oracles.sql import ORACLES, ev_inputs
from oracles.training import RBMTabs, batch_rows, binary_cd, gaussian_cd, hidden_act_sums, nn_error, nn_forward_sql, nn_grads_sql, sums_as_means
from oracles.wells import well_features, well_samples
from stackwise import roles
from stackwise.operators import rbm as R
from stackwise.plans import catalog as C
from stackwise.plans import fixtures as FX

N_BATCHES = 3


def _rbm_update(ch: Chain, p: RBMTabs, st: dict, momentum: float, alpha: float, gaussian: bool) -> RBMTabs:
    """Momentum update and the empty-batch guard in one CTE per parameter (short CTE chains)."""
    m, a, N, n = fl(momentum), fl(alpha), st["N"], f"(SELECT n FROM {st['n']})"
    q = RBMTabs.__new__(RBMTabs)

    def upd(old, vel, sums, keys, scale):
        on = " AND ".join(f"o.{k} = d.{k}" for k in keys)
        vo = " AND ".join(f"o.{k} = v.{k}" for k in keys)
        cols = ", ".join(f"o.{k}" for k in keys)
        step = f"({m} * v.w + {scale}d.s / {N})"
        new_p = ch.add(f"SELECT {cols}, CASE WHEN {n} > 0 THEN o.w + {step} ELSE o.w END AS w FROM {old} o "
                       f"JOIN {vel} v ON {vo} LEFT JOIN {sums} d ON {on}")
        new_v = ch.add(f"SELECT {cols}, CASE WHEN {n} > 0 THEN {step} ELSE v.w END AS w FROM {vel} o "
                       f"JOIN {vel} v ON {vo} LEFT JOIN {sums} d ON {on}")
        return new_p, new_v

    q.W, q.vW = upd(p.W, p.vW, st["dW"], ("j", "i"), f"{a} * ")
    q.b, q.vb = upd(p.b, p.vb, st["db"], ("i",), f"{a} * ")
    q.c, q.vc = upd(p.c, p.vc, st["dc"], ("i",), f"{a} * ")
    q.s, q.vinv = p.s, p.vinv
    if gaussian:
        vel = f"({m} * v.w + d.s / {N})"
        inv = f"(1.0e0 / o.w + {vel})"
        q.s = ch.add(f"SELECT o.i, CASE WHEN {n} > 0 THEN (CASE WHEN {inv} > 0 THEN GREATEST(1.0e0 / {inv}, 0.005e0) "
                     f"ELSE 0.005e0 END) ELSE o.w END AS w FROM {p.s} o JOIN {p.vinv} v ON o.i = v.i "
                     f"LEFT JOIN {st['dsig']} d ON o.i = d.i")
        q.vinv = ch.add(f"SELECT v.i, CASE WHEN {n} > 0 THEN {vel} ELSE v.w END AS w FROM {p.vinv} v "
                        f"LEFT JOIN {st['dsig']} d ON v.i = d.i")
    return q


def _rbm_fit(ch: Chain, x: str, p: RBMTabs, *, gaussian: bool, epochs: int, momentum: float, alpha: float,
             seed: int) -> RBMTabs:
    for epoch in range(epochs):
        for bno in range(N_BATCHES):
            xb = batch_rows(ch, x, N_BATCHES, seed, epoch, bno)
            step_seed = derive_seed(seed, 100, epoch, bno)
            st = gaussian_cd(ch, xb, p, step_seed) if gaussian else binary_cd(ch, xb, p, step_seed)
            p = _rbm_update(ch, p, st, momentum, alpha, gaussian)
    return p


def _unrolled(ch: Chain, x: str, y: str, width: int, out: int, epochs_pretrain: int = 1, epochs_finetune: int = 2, hidden: int = 8) -> str:
    x, y = ch.add(f"SELECT * FROM {x}"), ch.add(f"SELECT * FROM {y}")
    # pretraining: Gaussian layer, then binary layer on its hidden probabilities (default init)
    s1, s2 = derive_seed(C.SEED, 400, 0), derive_seed(C.SEED, 400, 1)
    i1 = R.init_params(width, hidden, s1, gaussian=True)
    p1 = _rbm_fit(ch, x, RBMTabs(ch, i1.W, i1.b, i1.c, i1.sigma), gaussian=True, epochs=epochs_pretrain,
                  momentum=0.01, alpha=0.01, seed=s1)
    h = ch.dense(x, p1.W, p1.c, "sigm")
    i2 = R.init_params(hidden, out, s2)
    p2 = _rbm_fit(ch, h, RBMTabs(ch, i2.W, i2.b, i2.c), gaussian=False, epochs=epochs_pretrain,
                  momentum=0.01, alpha=0.01, seed=s2)
    # unfold [c | W] and fine-tune (sigm / sigm, lr 2.0, momentum 0.5)
    Ws = [ch.add(f"SELECT j, i + 1 AS i, w FROM {p.W} UNION ALL SELECT i AS j, 0 AS i, w FROM {p.c}") for p in (p1, p2)]
    vWs = [ch.mat(np.zeros((hidden, width + 1))), ch.mat(np.zeros((out, hidden + 1)))]
    for epoch in range(epochs_finetune):
        for bno in range(N_BATCHES):
            xb, yb = (batch_rows(ch, t, N_BATCHES, C.SEED, epoch, bno) for t in (x, y))
            n = ch.count(xb)
            a, masks = nn_forward_sql(ch, xb, Ws, "sigm", "sigm")
            grads, _ = nn_grads_sql(ch, a, masks, yb, Ws, "sigm", "sigm", n)
            newW, newV = [], []
            nn = f"(SELECT n FROM {n})"
            for w, v, g in zip(Ws, vWs, grads):
                d = f"({fl(2.0)} * g.w + {fl(0.5)} * v.w)"
                src = (f"FROM {w} w JOIN {v} v ON w.j = v.j AND w.i = v.i LEFT JOIN {g} g ON w.j = g.j AND w.i = g.i")
                newW.append(ch.add(f"SELECT w.j, w.i, CASE WHEN {nn} > 0 THEN w.w - {d} ELSE w.w END AS w {src}"))
                newV.append(ch.add(f"SELECT w.j, w.i, CASE WHEN {nn} > 0 THEN {d} ELSE v.w END AS w {src}"))
            Ws, vWs = newW, newV
    # score every row: loss and hit rate
    a, _ = nn_forward_sql(ch, x, Ws, "sigm", "sigm")
    o = a[-1]
    per_row = ch.add(f"SELECT y.r, SUM((y.v - o.v) * (y.v - o.v)) AS e, "
                     f"SUM(y.v * CASE WHEN o.v > {fl(0.3333333)} THEN {ONE} ELSE {ZERO} END) AS h "
                     f"FROM {y} y JOIN {o} o ON y.r = o.r AND y.i = o.i GROUP BY y.r")
    return ch.render(f"SELECT {r6('0.5e0 * AVG(e)')} AS loss, {r6('AVG(h)')} AS hit_rate, CAST(COUNT(*) AS BIGINT) AS n "
                     f"FROM {per_row}")


def dbn_end_to_end_sql(epochs_pretrain: int = 1, epochs_finetune: int = 2, hidden: int = 8) -> str:
    """The flagship over the well table."""
    ch = Chain()
    return _unrolled(ch, *well_samples(ch), len(roles.EXAMPLE_FEATURES), len(roles.ONE_HOT[roles.EXAMPLE_TARGET]), epochs_pretrain, epochs_finetune, hidden)


def _events() -> str:
    ch = Chain()
    base, x = ev_inputs(ch)
    kinds = ["click", "error", "purchase", "signup", "view"]
    y = ch.add(" UNION ALL ".join(f"SELECT r, {k} AS i, CASE WHEN event_type = '{t}' THEN {ONE} ELSE {ZERO} END AS v FROM {base}" for k, t in enumerate(kinds)))
    return _unrolled(ch, x, y, 3, len(kinds))


def _wide_gradient() -> str:
    """One gradient with masked input and sparsity over all columns of the well table."""
    ch = Chain()
    x, y, _ = well_features(ch)
    Ws, n = [ch.mat(w) for w in FX.well_weights()], ch.count(x)
    a, masks = nn_forward_sql(ch, x, Ws, "sigm", "sigm", training=True, noise=0.2, step_seed=C.SEED)
    p = hidden_act_sums(ch, a, n, {1: ch.vec(np.zeros(4))}, 0.99)
    grads, loss = nn_grads_sql(ch, a, masks, y, Ws, "sigm", "sigm", n, sparsity=0.1, target=0.1, p=p)
    return ch.render(params_rows([("g0", grads[0], "mat"), ("g1", grads[1], "mat"), ("loss", loss, "scalar"), ("p1", p[1], "vec")]))


def _wide_predictions() -> str:
    ch = Chain()
    x, y, _ = well_features(ch)
    a, _ = nn_forward_sql(ch, x, [ch.mat(w) for w in FX.well_weights()], "sigm", "sigm")
    o, e = a[-1], nn_error(ch, y, a[-1])
    cols = ", ".join(f"{r6(f'MAX(CASE WHEN o.i = {i} THEN {t}.v END)')} AS {name}{i}" for t, name in (("o", "predict_label"), ("e", "error")) for i in range(3))
    return ch.render(f"SELECT o.r AS row_id, {cols} FROM {o} o JOIN {e} e ON o.r = e.r AND o.i = e.i GROUP BY o.r")


def _wide_cd_step() -> str:
    W, b, c, s = FX.well_rbm()
    ch = Chain()
    x, _, _ = well_features(ch)
    st = gaussian_cd(ch, x, RBMTabs(ch, W, b, c, s), C.SEED, noise="none")
    return ch.render(sums_as_means(ch, st, ["dW", "db", "dc", "err", "dsig"]))


ORACLES["nn_gradient_sparse"] = _wide_gradient()
ORACLES["nn_predict_sparse"] = _wide_predictions()
ORACLES["gaussian_rbm_cd_step_sparse"] = _wide_cd_step()
ORACLES["dbn_end_to_end"] = dbn_end_to_end_sql()
ORACLES["events_dbn_end_to_end"] = _events()
