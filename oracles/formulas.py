"""SQL text of the draws and activations, written from their formulas for the checks alone.

Draws: M = 2**31 - 1, the row id split as hi * M + lo with 0 <= lo < M,
    a = (48271 lo + 40014 hi + 69621 unit + seed) mod M
    b = (40692 lo + 30323 hi + 16807 unit + seed) mod M        (hi taken mod M)
    u = (16807 ((a a + b) mod M) + b) mod M, divided by M.
Seeds of derived streams: s <- (1000003 s + part + 1) mod M for every part.
Activations: logistic 1 / (1 + e**-z); scaled tanh 1.7159 tanh(2 z / 3); identity.
"""

from __future__ import annotations

from functools import reduce

import numpy as np

M = 2**31 - 1
PI = "pi()"


def fl(x: float) -> str:
    """A DOUBLE literal."""
    text = repr(float(x))
    if text in ("inf", "-inf", "nan"):
        return f"CAST('{text}' AS DOUBLE)"
    return text if "e" in text else text + "e0"


def stream(seed: int, *parts: int) -> int:
    return reduce(lambda s, part: (1000003 * s + int(part) + 1) % M, parts, int(seed) % M)


def uniform_sql(row: str, unit: str, seed: int) -> str:
    row, unit = f"CAST({row} AS BIGINT)", f"CAST({unit} AS BIGINT)"
    low = f"((({row} % {M}) + {M}) % {M})"
    floor = f"(({row} - ({row} % {M})) // {M} - CASE WHEN {row} % {M} < 0 THEN 1 ELSE 0 END)"
    high = f"((({floor} % {M}) + {M}) % {M})"
    a = f"((48271 * {low} + 40014 * {high} + 69621 * {unit} + {int(seed) % M}) % {M})"
    b = f"((40692 * {low} + 30323 * {high} + 16807 * {unit} + {int(seed) % M}) % {M})"
    return f"(CAST((16807 * (({a} * {a} + {b}) % {M}) + {b}) % {M} AS DOUBLE) / {fl(M)})"


def normal_sql(row: str, unit: str, seed: int) -> str:
    """Box-Muller from the streams 1 and 2 of the seed."""
    first, second = (uniform_sql(row, unit, stream(seed, k)) for k in (1, 2))
    return f"(sqrt({fl(-2)} * ln({fl(1)} - {first})) * cos({fl(2)} * {PI} * {second}))"


def sql_act(name: str, z: str) -> str:
    return {"sigm": f"({fl(1)} / ({fl(1)} + exp(-({z}))))", "tanh_opt": f"({fl(1.7159)} * tanh({fl(2)} * ({z}) / {fl(3)}))", "linear": f"({z})"}[name]


def sql_act_grad(name: str, a: str) -> str:
    """Derivative by the activation's value a: a (1 - a); 1.7159 (2/3) (1 - (a / 1.7159)**2); 1."""
    scaled = f"(({a}) / {fl(1.7159)})"
    return {"sigm": f"(({a}) * ({fl(1)} - ({a})))", "tanh_opt": f"({fl(1.7159)} * {fl(2)} / {fl(3)} * ({fl(1)} - {scaled} * {scaled}))", "linear": fl(1)}[name]


def first_weights(n_in: int, n_out: int, seed: int) -> np.ndarray:
    """Weights of a new layer, bias first: uniform draws, centred, times 8 sqrt(6 / (in + out))."""
    draws = np.random.default_rng(seed).random((n_out, n_in + 1))
    return 8 * (draws - 0.5) * (6 / (n_in + n_out)) ** 0.5
