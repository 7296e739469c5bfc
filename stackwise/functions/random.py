"""Counter-based seeded draws.

Every random number is a pure function of ``(row_id, unit, seed)``; it does not depend on
partitioning, row order, retries or recomputation, so a lost executor re-computes exactly
the same draws. The same integer recipe is available as a Spark column and as a numpy function
(inside Arrow batches); both agree bit for bit for every 64-bit row id. The SQL checks
write the recipe once more on their own.

Recipe, with M = 2**31 - 1 and the id split into ``id = hi * M + lo``, 0 <= lo < M (floor division):
    a  = (lo * 48271 + (hi mod M) * 40014 + unit * 69621 + seed) mod M
    b  = (lo * 40692 + (hi mod M) * 30323 + unit * 16807 + seed) mod M
    h  = (a * a + b) mod M                 # breaks the linear lattice
    u  = ((h * 16807 + b) mod M) / M       # in [0, 1)
(lo, hi mod M) -> (a, b) is one to one, so two ids share their draws only if they differ by a
multiple of M * M (about 2**62). No product exceeds 63 bits.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

M = 2147483647


def derive_seed(seed: int, *parts: int) -> int:
    """Combine a user seed with stream coordinates (purpose, epoch, step, layer, ...)."""
    s = int(seed) % M
    for p in parts:
        s = (s * 1000003 + int(p) + 1) % M
    return s


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _long(x) -> Column:
    return F.lit(int(x)).cast("long")


def uniform_col(row_id, unit, seed: int) -> Column:
    """u(row_id, unit, seed) as a Spark column (row_id, unit: columns or ints)."""
    rid = _c(row_id).cast("long")
    rest = rid % _long(M)
    lo = F.pmod(rid, _long(M))
    hi = F.pmod(F.call_function("div", rid, _long(M)) - F.when(rest < 0, _long(1)).otherwise(_long(0)), _long(M))
    u, s = _c(unit).cast("long"), _long(int(seed) % M)
    a = (lo * 48271 + hi * 40014 + u * 69621 + s) % M
    b = (lo * 40692 + hi * 30323 + u * 16807 + s) % M
    h = (a * a + b) % M
    return ((h * 16807 + b) % M).cast("double") / float(M)


def normal_col(row_id, unit, seed: int) -> Column:
    """Standard normal draw by Box-Muller from two uniforms of derived seeds."""
    u1 = uniform_col(row_id, unit, derive_seed(seed, 1))
    u2 = uniform_col(row_id, unit, derive_seed(seed, 2))
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def uniform_np(row_ids: np.ndarray, n_units: int, seed: int) -> np.ndarray:
    """Matrix of draws, shape (len(row_ids), n_units)."""
    return uniform_at(np.asarray(row_ids, dtype=np.int64)[:, None], np.arange(n_units, dtype=np.int64)[None, :], seed)


def uniform_at(row_ids: np.ndarray, units: np.ndarray, seed: int) -> np.ndarray:
    """Draws of pairs of row and unit (arrays that broadcast together)."""
    rid, units = np.asarray(row_ids, dtype=np.int64), np.asarray(units, dtype=np.int64)
    lo, hi = np.mod(rid, M), np.mod(np.floor_divide(rid, M), M)
    s = np.int64(int(seed) % M)
    a = (lo * 48271 + hi * 40014 + units * 69621 + s) % M
    b = (lo * 40692 + hi * 30323 + units * 16807 + s) % M
    h = (a * a + b) % M
    return ((h * 16807 + b) % M).astype(np.float64) / float(M)


def normal_np(row_ids: np.ndarray, n_units: int, seed: int) -> np.ndarray:
    u1 = uniform_np(row_ids, n_units, derive_seed(seed, 1))
    u2 = uniform_np(row_ids, n_units, derive_seed(seed, 2))
    return np.sqrt(-2.0 * np.log(1.0 - u1)) * np.cos(2.0 * math.pi * u2)
