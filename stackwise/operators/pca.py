"""Principal-component projection.

``pca_project`` uses ``ml.feature.PCA``: the covariance comes from a distributed aggregation of the Gramian, a d x d
matrix on the driver. ``pca_project_wide`` never makes that matrix: a randomised range finder keeps a basis of some more
vectors than components, and every pass over the rows multiplies them by the basis, keeps the triangular factor of a
tall-skinny QR of the products inside the tasks and sums ``Y^T X``. Both project **uncentred** rows (pc^T x), like the
reference; the label stays in its row and nothing is collected.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackwise.functions.sparse import SparseRows
from stackwise.operators.layers import dense_layer
from stackwise.operators.step import step_sums


def pca_project(df: DataFrame, k: int = 7, col: str = "features", out: str = "features"):
    """Return (rows with ``out`` = top-k projection, explained variance list, model)."""
    vec = df.withColumn("_vec", array_to_vector(F.col(col)))
    model = PCA(k=int(k), inputCol="_vec", outputCol="_pca").fit(vec)
    projected = model.transform(vec).withColumn(out, vector_to_array("_pca")).drop("_vec", "_pca")
    return projected, [float(v) for v in model.explainedVariance.toArray()], model


def _moments(_P, _ids, X, _Y):
    """Sum of the rows and their number."""
    total = X.under(np.ones((X.shape[0], 1)))[0] if isinstance(X, SparseRows) else X.sum(axis=0)
    return {"sum": total, "n": np.array(float(X.shape[0]))}


def _centred_products(P, _ids, X, _Y):
    """Y = (X - mean) basis row by row, the sums of Y^T (X - mean) and of the squares of X - mean; sparse rows are not filled up."""
    mean, basis = P["mean"], P["basis"]
    if not isinstance(X, SparseRows):
        X = X - mean
        Y = X @ basis
        return {"y": Y, "yx": Y.T @ X, "square": np.array(np.sum(X * X))}
    Y = X.times(basis) - mean @ basis
    square = np.sum(X.values ** 2) - 2.0 * np.sum(X.values * mean[X.indices]) + X.shape[0] * (mean @ mean)
    return {"y": Y, "yx": X.under(Y) - np.outer(Y.sum(axis=0), mean), "square": np.array(square)}


def principal_components(df: DataFrame, k: int, col: str = "features", *, extra: int = 10, tolerance: float = 1e-9, passes: int = 60,
                         seed: int = 0) -> tuple[np.ndarray, list[float]]:
    """(components k x d, explained variance shares) of a vector column of any width, dense or sparse.

    One pass for the mean, then subspace iteration: a pass gives R of Y = QR and ``Y^T X``, hence ``Q^T X`` and its singular
    values and vectors, which are the next basis. It ends when the k shares change by less than ``tolerance``; a
    spectrum that is too flat for ``passes`` raises (give more ``extra`` vectors). At most one pass is needed where the basis is
    as wide as the rows. What travels has (k + extra) x d numbers. A component's largest entry is positive.
    """
    src = df.select(F.col(col).alias("features"))
    first = src.first()
    if first is None:
        raise ValueError("no rows")
    d = first[0]["size"] if isinstance(first[0], tuple) else len(first[0])
    if not 0 < k <= d:
        raise ValueError(f"k must be between 1 and the width {d}")
    common = dict(row_id=None, label=None, width=d, sparse=True)
    m = step_sums(src, _moments, {}, {"sum": (d,), "n": ()}, **common)
    mean, width = m["sum"] / m["n"], min(d, k + extra)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    before = None
    for _ in range(passes):
        s = step_sums(src, _centred_products, {"mean": mean, "basis": basis}, {"yx": (width, d), "square": ()}, factors={"y": width}, **common)
        # Q = Y R^-1 by the singular values of R, without directions that hold nothing
        u, sigma, vt = np.linalg.svd(s["y"])
        held = sigma > sigma[0] * 1e-13 if sigma[0] > 0 else np.zeros(len(sigma), bool)
        _, values, vectors = np.linalg.svd((vt[held] / sigma[held][:, None]) @ s["yx"], full_matrices=False)
        share = np.zeros(k)
        share[:min(k, len(values))] = (values ** 2)[:k] / s["square"] if s["square"] > 0 else 0.0
        if width == d or (before is not None and np.abs(share - before).max() < tolerance):
            break
        before = share
        basis = np.linalg.qr(np.column_stack([vectors.T, basis]))[0][:, :width]
    else:
        raise ValueError(f"the shares still change after {passes} passes; use more extra vectors")
    parts = np.linalg.qr(np.column_stack([vectors.T, basis]))[0][:, :k].T if len(vectors) < k else vectors[:k]
    return parts * np.where(parts[np.arange(k), np.abs(parts).argmax(axis=1)] < 0, -1.0, 1.0)[:, None], [float(x) for x in share]


def pca_project_wide(df: DataFrame, k: int = 7, col: str = "features", out: str = "features", **search):
    """Return (rows with ``out`` = top-k projection, explained variance list, components)."""
    parts, share = principal_components(df, k, col, **search)
    return dense_layer(df, col, parts, None, "linear", out, method="arrow"), share, parts
