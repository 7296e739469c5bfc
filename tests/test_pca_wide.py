"""Principal components without a d x d matrix, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from stackwise.functions import sparse as SP
from stackwise.operators import pca
from stackwise.operators.step import step_sums
from stackwise.plans import inputs as I


def shares(X):
    values = np.linalg.svd(X - X.mean(axis=0), compute_uv=False) ** 2
    return values / values.sum()


def matrix(df, col="features"):
    return np.array([r[0] for r in df.orderBy("row_id").select(col).collect()])


def test_all_slots_of_the_embeddings(spark):
    df = I.embedding_samples(spark, SF_MID)
    X = matrix(df)
    rows, got, parts = pca.pca_project_wide(df, 3, out="top")
    assert X.shape[1] == 64 and np.abs(np.array(got) - shares(X)[:3]).max() < 1e-6
    np.testing.assert_allclose(matrix(rows, "top"), X @ parts.T, atol=1e-9)  # uncentred rows, like the narrow form
    np.testing.assert_allclose(parts @ parts.T, np.eye(3), atol=1e-9)
    assert rows.columns == [*df.columns, "top"]


def test_equals_the_narrow_form(spark):
    df = I.lineitem_samples(spark, SF_SMALL)
    _, narrow, model = pca.pca_project(df, 3)
    _, wide, parts = pca.pca_project_wide(df, 3)
    assert np.abs(np.array(narrow) - wide).max() < 1e-9
    np.testing.assert_allclose(np.abs(parts @ model.pc.toArray()), np.eye(3), atol=1e-6)


def test_five_thousand_slots(spark):
    """Rows of rank 5 and noise, as vectors of 5,000 slots; a matrix of 5,000 x 5,000 is never made."""
    d, n = 5000, 300
    rng = np.random.default_rng(3)
    loads = rng.normal(size=(5, d)) * np.array([9, 7, 5, 3, 2])[:, None]
    X = rng.normal(size=(n, 5)) @ loads + rng.normal(size=(n, d)) * 0.5 + 3.0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "row_id long, features array<double>").repartition(5)
    parts, got = pca.principal_components(df, 5)
    assert np.abs(np.array(got) - shares(X)[:5]).max() < 1e-6
    top = np.linalg.svd(X - X.mean(axis=0), full_matrices=False)[2][:5]
    np.testing.assert_allclose(np.abs(parts @ top.T), np.eye(5), atol=1e-4)


def test_sparse_rows(spark):
    df = I.lineitem_samples(spark, SF_SMALL).select(F.concat("label", F.transform("features", lambda x: F.when(x > 0.5, x).otherwise(0.0))).alias("features"))
    parts, got = pca.principal_components(df, 4, extra=1, passes=200)
    again, same = pca.principal_components(df.select(SP.from_dense(F.col("features")).alias("features")), 4, extra=1, passes=200)
    assert np.abs(np.array(got) - same).max() < 1e-8 and np.allclose(np.abs(np.sum(parts * again, axis=1)), 1, atol=1e-4)


def test_degenerate_tables(spark):
    same = spark.createDataFrame([([1.0, 2.0, 3.0],)] * 4, "features array<double>")
    parts, got = pca.principal_components(same, 2)
    assert got == [0.0, 0.0] and np.allclose(parts @ parts.T, np.eye(2))
    line = spark.createDataFrame([([float(i), 2.0 * i, 0.0],) for i in range(5)], "features array<double>")
    parts, got = pca.principal_components(line, 2)
    assert abs(got[0] - 1) < 1e-12 and got[1] < 1e-12 and np.allclose(parts[0], np.array([1, 2, 0]) / 5 ** 0.5)
    for bad in (0, 4):
        with pytest.raises(ValueError, match="width"):
            pca.principal_components(line, bad)
    with pytest.raises(ValueError, match="no rows"):
        pca.principal_components(line.limit(0), 1)
    flat = spark.createDataFrame([(np.random.default_rng(i).normal(size=40).tolist(),) for i in range(200)], "features array<double>")
    with pytest.raises(ValueError, match="extra"):
        pca.principal_components(flat, 2, extra=1, passes=2)


@pytest.mark.parametrize("parts", [1, 7])
def test_factor_of_all_rows(spark, parts):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(500, 6))
    df = spark.createDataFrame([(x.tolist(),) for x in X], "features array<double>").repartition(parts)
    got = step_sums(df, lambda P, ids, X, Y: {"y": X, "n": np.array(float(len(X)))}, {}, {"n": ()}, row_id=None, label=None, factors={"y": 6})
    assert got["n"] == 500
    np.testing.assert_allclose(got["y"].T @ got["y"], X.T @ X, rtol=1e-10)
    np.testing.assert_allclose(np.abs(got["y"]), np.abs(np.linalg.qr(X, mode="r")), rtol=1e-8, atol=1e-10)
    empty = step_sums(df.limit(0), lambda P, ids, X, Y: {"y": X}, {}, {}, row_id=None, label=None, factors={"y": 6})
    assert empty["y"].shape == (0, 6)
