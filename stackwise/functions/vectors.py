"""Vector helpers on ``array<double>`` columns (D3, D4, H1 and the building blocks of E*).

All of them are built-in expressions, so they stay inside the JVM and can be used on batch and
streaming DataFrames alike. Weights become literals; for wide layers use the Arrow/numpy form of
:mod:`stackwise.operators.layers`, which gives the same results and the same errors.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from stackwise.functions import activations as A


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def array_lit(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def matrix_lit(m: np.ndarray) -> Column:
    return F.array(*[array_lit(row) for row in np.asarray(m, dtype=float)])


def dot(a, b, width: int | None = None) -> Column:
    """Inner product; unrolled (code-generated) when the width is known."""
    if width is not None:
        x, y = _c(a), _c(b)
        z = F.lit(0.0)
        for i in range(width):
            z = z + x[i] * y[i]
        return z
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def map_slots(col, fn, width: int | None = None) -> Column:
    """fn(x_i, i) for every slot; unrolled (code-generated) when the width is known, else ``transform``."""
    c = _c(col)
    if width is not None:
        return F.array(*[fn(c[i], F.lit(i)) for i in range(width)])
    return F.transform(c, lambda x, i: fn(x, i))


def add_bias(col) -> Column:
    """Prepend the constant 1 (bias slot)."""
    return F.concat(F.array(F.lit(1.0)), _c(col))


def drop_bias(col) -> Column:
    """Remove slot 0."""
    c = _c(col)
    return F.slice(c, 2, F.size(c) - 1)


def squared_norm(col, width: int | None = None) -> Column:
    if width is not None:
        x = _c(col)
        z = F.lit(0.0)
        for i in range(width):
            z = z + x[i] * x[i]
        return z
    return F.aggregate(_c(col), F.lit(0.0), lambda acc, v: acc + v * v)


def squared_distance(a, b, width: int | None = None) -> Column:
    if width is not None:
        x, y = _c(a), _c(b)
        z = F.lit(0.0)
        for i in range(width):
            z = z + (x[i] - y[i]) * (x[i] - y[i])
        return z
    return squared_norm(F.zip_with(_c(a), _c(b), lambda x, y: x - y))


def vsub(a, b, width: int | None = None) -> Column:
    if width is not None:
        x, y = _c(a), _c(b)
        return F.array(*[x[i] - y[i] for i in range(width)])
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def checked(col, width: int) -> Column:
    """The vector itself; one that is NULL, holds NULL or has another width raises an error."""
    x = _c(col)
    bad = x.isNull() | (F.size(x) != F.lit(width))
    for i in range(width):
        bad = bad | x[i].isNull()
    return F.when(bad, F.raise_error(F.lit(f"vector column must hold {width} numbers in every row")).cast("array<double>")).otherwise(x)


# Weights up to which DataFrame operators choose the expression form. It is part of one generated method with all that the
# stage computes beside it, and the JVM interprets methods of more than 8,000 bytes of code: 112 weights cost 74 us a row.
EXPRESSION_MAX = 32


def dense_units(xs: Sequence[Column], W: np.ndarray, c: np.ndarray | None, act: str) -> list[Column]:
    """One expression per output unit: act(c_j + sum_i x_i * W[j, i]), unrolled."""
    W = np.asarray(W, dtype=float)
    bias = np.zeros(W.shape[0]) if c is None else np.asarray(c, dtype=float).reshape(-1)
    units = []
    for j in range(W.shape[0]):
        z = F.lit(float(bias[j]))
        for i in range(W.shape[1]):
            z = z + xs[i] * F.lit(float(W[j, i]))
        units.append(A.scalar(act, z))
    return units


def dense(col, W: np.ndarray, c: np.ndarray | None = None, act: str = "sigm", scale: np.ndarray | None = None) -> Column:
    """D3: ``act(x . W^T + c)`` for every row; W has shape (out, in).

    Unrolled into arithmetic on the array elements, which whole-stage code generation compiles. A vector
    that is NULL, holds NULL or is not as wide as the layer raises an error, like the Arrow form for
    wide layers (:mod:`stackwise.operators.layers`). ``scale`` divides the input first (x / sigma).
    """
    W = np.asarray(W, dtype=float)
    x = _c(col)
    xs = [x[i] for i in range(W.shape[1])]
    if scale is not None:
        xs = [xi / F.lit(float(s)) for xi, s in zip(xs, np.asarray(scale, dtype=float))]
    bad = x.isNull() | (F.size(x) != F.lit(W.shape[1]))
    for xi in xs:  # a NULL slot
        bad = bad | xi.isNull()
    return F.when(bad, F.raise_error(F.lit(f"vector column must hold {W.shape[1]} numbers in every row"))).otherwise(F.array(*dense_units(xs, W, c, act)))


def threshold(col, t: float = 0.3333333, width: int | None = None) -> Column:
    """H1: 1 where the score exceeds t, else 0."""
    if width is not None:
        x = _c(col)
        return F.array(*[F.when(x[i] > F.lit(float(t)), F.lit(1.0)).otherwise(F.lit(0.0)) for i in range(width)])
    return F.transform(_c(col), lambda x: F.when(x > F.lit(float(t)), F.lit(1.0)).otherwise(F.lit(0.0)))


def one_hot_lit(col, values: Sequence) -> Column:
    c = _c(col)
    return F.array(*[F.when(c == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0)) for v in values])
