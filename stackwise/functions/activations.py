"""Activation functions (D1) and their derivatives.

Column forms work elementwise on ``array<double>`` columns through ``transform``; the numpy
forms are used inside Arrow batches by the training step.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed values of the scaled hyperbolic tangent: f(x) = 1.7159 * tanh(2x/3).
TANH_A = 1.7159
TANH_B = 2.0 / 3.0

ACTIVATIONS = ("sigm", "tanh_opt", "linear")


def check(name: str) -> str:
    if name not in ACTIVATIONS:
        raise ValueError(f"unknown activation {name!r}; expected one of {ACTIVATIONS}")
    return name


def scalar(name: str, z: Column) -> Column:
    check(name)
    if name == "sigm":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    if name == "tanh_opt":
        return F.lit(TANH_A) * F.tanh(F.lit(TANH_B) * z)
    return z


def scalar_grad(name: str, a: Column) -> Column:
    """Derivative expressed through the activation value a = f(z)."""
    check(name)
    if name == "sigm":
        return a * (F.lit(1.0) - a)
    if name == "tanh_opt":
        return F.lit(TANH_A * TANH_B) * (F.lit(1.0) - a * a * F.lit(1.0 / (TANH_A * TANH_A)))
    return F.lit(1.0) + a * 0.0


def activate(col, name: str, width: int | None = None) -> Column:
    """Elementwise activation of an array column (unrolled when the width is known)."""
    c = F.col(col) if isinstance(col, str) else col
    if width is not None:
        return F.array(*[scalar(name, c[i]) for i in range(width)])
    return F.transform(c, lambda z: scalar(name, z))


def activation_gradient(col, name: str, width: int | None = None) -> Column:
    """Elementwise derivative of an activated array column."""
    c = F.col(col) if isinstance(col, str) else col
    if width is not None:
        return F.array(*[scalar_grad(name, c[i]) for i in range(width)])
    return F.transform(c, lambda a: scalar_grad(name, a))


def np_act(name: str, z: np.ndarray) -> np.ndarray:
    check(name)
    if name == "sigm":
        return 1.0 / (1.0 + np.exp(-z))
    if name == "tanh_opt":
        return TANH_A * np.tanh(TANH_B * z)
    return z


def np_act_grad(name: str, a: np.ndarray) -> np.ndarray:
    check(name)
    if name == "sigm":
        return a * (1.0 - a)
    if name == "tanh_opt":
        return TANH_A * TANH_B * (1.0 - a * a * (1.0 / (TANH_A * TANH_A)))
    return np.ones_like(a)
