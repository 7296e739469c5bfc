"""Splits, batches, masks and stochastic units.

All draws are ``u(row_id, unit, seed)`` from :mod:`stackwise.functions.random`; they are
pure projections (no shuffle, no driver work) and give the same rows for the same seed on
any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackwise.functions import activations as A
from stackwise.functions import vectors as V
from stackwise.functions.random import derive_seed, normal_col, uniform_col

# stream identifiers inside derive_seed(seed, STREAM, ...)
SPLIT, BATCH, NOISE, DROPOUT, HIDDEN, VISIBLE, GIBBS, RECON, STATES = range(1, 10)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def validation_flag(row_id="row_id", fraction: float = 0.1, seed: int = 0) -> Column:
    """True for rows that go to the validation side (hash below the cut)."""
    return uniform_col(_c(row_id), 0, derive_seed(seed, SPLIT)) < F.lit(float(fraction))


def train_validation_split(df: DataFrame, fraction: float, seed: int = 0, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Stable (train, validation) split with weights (1 - fraction, fraction)."""
    flag = validation_flag(row_id, fraction, seed)
    return df.filter(~flag), df.filter(flag)


def num_batches(m: int, batch_size: int | None) -> int:
    """floor(m / batch_size), at least 1 (a small table still trains; Q18)."""
    if not batch_size:
        return 1
    return max(1, int(m) // int(batch_size))


def batches_per_epoch(df: DataFrame, n_batches: int | None = None, batch_size: int | None = None) -> int:
    """``n_batches``, which keeps the number of jobs apart from the number of rows; or as many
    batches of ``batch_size`` rows as the table holds, a choice for small tables; or one."""
    if n_batches is not None and batch_size is not None:
        raise ValueError("give n_batches or batch_size, not both")
    if n_batches is not None:
        if n_batches < 1:
            raise ValueError("n_batches must be at least 1")
        return int(n_batches)
    return num_batches(df.count(), batch_size) if batch_size else 1


def batch_id(row_id="row_id", n_batches: int = 1, seed: int = 0, epoch: int = 0) -> Column:
    """Batch of each row in an epoch; the batches of an epoch partition the rows (Q17)."""
    if n_batches <= 1:
        return F.lit(0).cast("long")
    u = uniform_col(_c(row_id), 0, derive_seed(seed, BATCH, epoch))
    return F.least(F.floor(u * F.lit(float(n_batches))), F.lit(n_batches - 1).cast("long"))


def mini_batches(df: DataFrame, n_batches: int, seed: int = 0, epoch: int = 0, row_id: str = "row_id") -> DataFrame:
    """The rows with their batch number for one epoch."""
    return df.withColumn("batch_id", batch_id(row_id, n_batches, seed, epoch))


def mask_noise(col, fraction: float, seed: int, row_id="row_id", stream: tuple = (), width: int | None = None) -> Column:
    """Zero each input slot with probability ``fraction`` (keep when u >= fraction)."""
    s = derive_seed(seed, NOISE, *stream)
    rid = _c(row_id)
    return V.map_slots(col, lambda x, i: F.when(uniform_col(rid, i, s) >= F.lit(float(fraction)), x).otherwise(F.lit(0.0)), width)


def dropout_mask(col, fraction: float, seed: int, row_id="row_id", stream: tuple = (), width: int | None = None) -> Column:
    """C4: the 0/1 keep mask (keep when u > fraction, strictly)."""
    s = derive_seed(seed, DROPOUT, *stream)
    rid = _c(row_id)
    return V.map_slots(col, lambda x, i: F.when(uniform_col(rid, i, s) > F.lit(float(fraction)), F.lit(1.0)).otherwise(F.lit(0.0)),
                       width)


def apply_dropout(col, fraction: float, seed: int, row_id="row_id", testing: bool = False, stream: tuple = (),
                  width: int | None = None) -> Column:
    """C4: masked activations while training, activations x (1 - fraction) at test time."""
    if testing:
        return V.map_slots(col, lambda x, i: x * F.lit(1.0 - float(fraction)), width)
    s = derive_seed(seed, DROPOUT, *stream)
    rid = _c(row_id)
    return V.map_slots(col, lambda x, i: x * F.when(uniform_col(rid, i, s) > F.lit(float(fraction)), F.lit(1.0))
                       .otherwise(F.lit(0.0)), width)


def sample_states(col, seed: int, row_id="row_id", stream: tuple = (), width: int | None = None) -> Column:
    """Bernoulli states, 1 where p > u."""
    s = derive_seed(seed, STATES, *stream)
    rid = _c(row_id)
    return V.map_slots(col, lambda p, i: F.when(p > uniform_col(rid, i, s), F.lit(1.0)).otherwise(F.lit(0.0)), width)


def sigmoid_sample(col, seed: int, row_id="row_id", stream: tuple = (), width: int | None = None) -> Column:
    """Logistic, then Bernoulli."""
    s = derive_seed(seed, STATES, *stream)
    rid = _c(row_id)
    return V.map_slots(col, lambda z, i: F.when(A.scalar("sigm", z) > uniform_col(rid, i, s), F.lit(1.0)).otherwise(F.lit(0.0)),
                       width)


def sigmoid_additive_noise(col, seed: int, row_id="row_id", noise: str = "uniform", stream: tuple = (),
                           width: int | None = None) -> Column:
    """Logistic plus noise; uniform [0,1) as the reference draws it, or standard normal."""
    s = derive_seed(seed, RECON, *stream)
    rid = _c(row_id)
    draw = uniform_col if noise == "uniform" else normal_col
    return V.map_slots(col, lambda z, i: A.scalar("sigm", z) + draw(rid, i, s), width)
