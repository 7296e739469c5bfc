"""Partition independence, determinism and option equivalences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from stackwise.functions.random import uniform_col, uniform_np
from stackwise.operators import nn as N
from stackwise.operators import rbm as R
from stackwise.operators import sampling as S
from stackwise.plans import catalog as C
from stackwise.plans import fixtures as FX
from stackwise.plans import inputs as I


@pytest.fixture(scope="module")
def em(spark):
    return I.embedding_samples(spark, SF_SMALL).cache()


def test_uniform_three_forms_agree(spark):
    ev = I.event_samples(spark, SF_SMALL).select("row_id")
    rows = ev.select("row_id", uniform_col(F.col("row_id"), 3, 12345).alias("u")).collect()
    ids = np.array([r["row_id"] for r in rows])
    got = np.array([r["u"] for r in rows])
    np.testing.assert_array_equal(got, uniform_np(ids, 4, 12345)[:, 3])
    assert 0.0 <= got.min() and got.max() < 1.0


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_rbm_step_independent_of_partitioning(em, parts):
    W, b, c = FX.em_rbm()
    p = R.RBMParams(W=W, b=b, c=c, sigma=FX.em_sigma())
    cfg = R.RBMConfig(seed=3)
    base = R.cd_step_sums(em.coalesce(1), p, cfg, 11, True)
    other = R.cd_step_sums(em.repartition(parts), p, cfg, 11, True)
    for k in base:
        np.testing.assert_allclose(other[k], base[k], rtol=1e-10, atol=1e-10)


@pytest.mark.parametrize("parts", [1, 4])
def test_nn_fit_independent_of_partitioning(em, parts):
    cfg = C.em_cfg(dropout=0.2, noise=0.1)
    a = N.nn_fit(em.coalesce(1), cfg, epochs=1, batch_size=100, init_weights_=FX.em_weights())
    b = N.nn_fit(em.repartition(parts), cfg, epochs=1, batch_size=100, init_weights_=FX.em_weights())
    for x, y in zip(a.model.weights, b.model.weights):
        np.testing.assert_allclose(x, y, rtol=1e-9, atol=1e-12)


def test_same_seed_same_result_other_seed_differs(em):
    W, b, c = FX.em_rbm()
    p = R.RBMParams(W=W, b=b, c=c)
    s1 = R.cd_step_sums(em, p, R.RBMConfig(), 5, False)
    s2 = R.cd_step_sums(em, p, R.RBMConfig(), 5, False)
    s3 = R.cd_step_sums(em, p, R.RBMConfig(), 6, False)
    np.testing.assert_array_equal(s1["dW"], s2["dW"])
    assert not np.allclose(s1["dW"], s3["dW"])


def test_cd_k1_is_cd1(em):
    W, b, c = FX.em_rbm()
    p = R.RBMParams(W=W, b=b, c=c)
    a = R.cd_step_sums(em, p, R.RBMConfig(k=1), 5, False)
    P = R._step_params(p, R.RBMConfig(k=1), 5, False)
    rows = em.collect()
    ref = R.binary_cd_rows(P, np.array([r["row_id"] for r in rows]), np.array([r["features"] for r in rows]), None)
    np.testing.assert_allclose(a["dW"], ref["dW"], rtol=1e-10, atol=1e-12)


def test_dropout_zero_and_noise_zero_equal_plain(em):
    W = FX.em_weights()
    plain = N.nn_gradient(em, W, C.em_cfg())
    zero = N.nn_gradient(em, W, C.em_cfg(dropout=0.0, noise=0.0))
    for x, y in zip(plain["grads"], zero["grads"]):
        np.testing.assert_array_equal(x, y)


def test_batches_partition_the_rows(spark):
    ev = I.event_samples(spark, SF_SMALL)
    b = S.mini_batches(ev, 7, seed=1, epoch=2)
    total = ev.count()
    counts = {r["batch_id"]: r["count"] for r in b.groupBy("batch_id").count().collect()}
    assert sum(counts.values()) == total
    assert set(counts) <= set(range(7))
    e3 = S.mini_batches(ev, 7, seed=1, epoch=3).select("row_id", F.col("batch_id").alias("b3"))
    moved = b.join(e3, "row_id").filter(F.col("batch_id") != F.col("b3")).count()
    assert moved > 0  # batches are redrawn per epoch


def test_sigma_floor_and_positive():
    p = R.RBMParams(W=np.zeros((2, 3)), b=np.zeros(3), c=np.zeros(2), sigma=np.array([1.0, 0.01, 0.5]))
    sums = {"n": 1.0, "dW": np.zeros((2, 3)), "db": np.zeros(3), "dc": np.zeros(2), "err": 0.0,
            "dsig": np.array([-5.0, 1000.0, 0.0])}
    q, _ = R.apply_cd_update(p, sums, R.RBMConfig(momentum=0.0, alpha=0.1), True)
    assert (q.sigma >= 0.005).all()
    assert q.sigma[0] == 0.005  # 1/s + vel <= 0 -> floor


def test_min_max_within_unit_interval(spark):
    from stackwise.operators import prepare as P

    li = I.table(spark, SF_SMALL, "lineitem").select("l_quantity", "l_tax", F.lit(3.0).alias("const"))
    out = P.min_max_scale(li, ["l_quantity", "l_tax", "const"])
    r = out.agg(F.min("l_quantity"), F.max("l_quantity"), F.min("l_tax"), F.max("l_tax"), F.min("const"), F.max("const")).first()
    assert r[0] == 0.0 and r[1] == 1.0 and r[2] == 0.0 and r[3] == 1.0
    assert r[4] == 0.5 and r[5] == 0.5


def test_batches_of_an_epoch_partition_the_rows_whatever_the_input_partitions(em):
    from stackwise.plans.batches import TrainingRows

    all_ids = sorted(r[0] for r in em.select("row_id").collect())
    seen = []
    for parts in (1, 5):
        with TrainingRows(em.repartition(parts), 3, 4) as rows:
            epochs = [[sorted(r[0] for r in rows.batch(e, b).select("row_id").collect()) for b in range(3)] for e in (0, 1)]
        for batches in epochs:
            assert sorted(sum(batches, [])) == all_ids
        assert epochs[0] != epochs[1]
        seen.append(epochs)
    assert seen[0] == seen[1]


def test_a_fit_removes_what_it_wrote(spark, em, tmp_path):
    import os

    from stackwise import session

    W, bb, c = FX.em_rbm()
    base = session.checkpoint_dir(spark)
    before = set(os.listdir(base.removeprefix("file:")))
    R.rbm_fit(em, init=R.RBMParams(W=W, b=bb, c=c), n_batches=2, seed=4)
    N.nn_fit(em, C.em_cfg(), epochs=1, n_batches=2, validation=0.3, init_weights_=FX.em_weights())
    assert set(os.listdir(base.removeprefix("file:"))) == before


def test_number_of_jobs_does_not_depend_on_the_rows(spark):
    jobs = []
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        ev = I.event_samples(spark, sf)
        spark.sparkContext.setJobGroup("fit", "fit")
        N.nn_fit(ev, N.NNConfig(sizes=(3, 4, 5), activation="sigm", output="sigm", seed=1), epochs=2, n_batches=2)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup("fit")) - sum(jobs))
        spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs[0] == jobs[1]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from stackwise import session

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    cluster = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(cluster)


IDS = [0, 1, 5, -1, -7, 2**31 - 1, 2**31, 2147483652, -(2**31), 2**47, 2**47 + 1, 2**62, 2**62 + 5, 2**63 - 1, -(2**63), -(2**63) + 1]


def test_draws_for_every_64_bit_id(spark):
    from oracles.formulas import uniform_sql
    import duckdb

    df = spark.createDataFrame([(i,) for i in IDS], "row_id long")
    for unit, seed in ((0, 7), (3, 12345)):
        col = {r["row_id"]: r["u"] for r in df.select("row_id", uniform_col(F.col("row_id"), unit, seed).alias("u")).collect()}
        want = dict(zip(IDS, uniform_np(np.array(IDS, dtype=np.int64), unit + 1, seed)[:, unit]))
        sql = dict(duckdb.sql(f"SELECT r, {uniform_sql('r', str(unit), seed)} FROM (SELECT unnest({IDS}::BIGINT[]) AS r)").fetchall())
        assert col == want == sql
        assert all(0 <= u < 1 for u in col.values()) and len(set(col.values())) == len(IDS)


def test_no_row_is_lost_for_any_id(spark):
    ids = spark.range(-30000, 30000).selectExpr("id * 307445734561825 as row_id")  # over the whole 64-bit range
    n = ids.count()
    got = S.mini_batches(ids, 10, 7).groupBy("batch_id").count().collect()
    assert sum(r["count"] for r in got) == n and {r["batch_id"] for r in got} == set(range(10))
    assert max(r["count"] for r in got) < 1.1 * n / 10
    train, val = S.train_validation_split(ids, 0.2, 3)
    assert train.count() + val.count() == n and abs(val.count() - 0.2 * n) < 0.02 * n


@pytest.mark.parametrize("bad", [[1.0], [1.0, 2.0, 3.0], None, [1.0, None]])
def test_wrong_vectors_raise_in_both_forms(spark, bad):
    from stackwise.operators.layers import dense_layer

    df = spark.createDataFrame([(1, [0.5, 0.25]), (2, bad)], "row_id long, features array<double>")
    W = np.ones((3, 2))
    for method in ("expr", "arrow"):
        with pytest.raises(Exception, match="vector column"):
            dense_layer(df, "features", W, np.zeros(3), "sigm", "h", method=method).collect()


def test_outer_product_reads_its_input_once(em):
    from stackwise.operators import aggregates as E

    sc = em.sparkSession.sparkContext
    acc = sc.accumulator(0)

    def seen(batches):
        for b in batches:
            acc.add(b.num_rows)
            yield b

    data = em.select("row_id", "label", "features").repartition(3).mapInArrow(seen, em.select("row_id", "label", "features").schema)
    E.outer_product_mean(data).collect()
    assert acc.value == em.count()


def test_wide_layer_arrow_path_equals_expression(spark):
    from stackwise.operators.layers import dense_layer

    em = I.embedding_samples(spark, SF_SMALL)
    W = FX.fixed((16, 64), 9, 0.3)
    c = FX.fixed((16,), 10, 0.3)
    a = dense_layer(em, "features", W, c, "sigm", "h", method="arrow").orderBy("row_id").select("h").collect()
    b = dense_layer(em, "features", W, c, "sigm", "h", method="expr").orderBy("row_id").select("h").collect()
    np.testing.assert_allclose(np.array([r[0] for r in a]), np.array([r[0] for r in b]), rtol=1e-12, atol=1e-12)
    net = N.NNConfig(sizes=(64, 12, 10), activation="sigm", output="sigm")
    Wn = [np.concatenate([c[:12, None], W[:12]], axis=1), FX.fixed((10, 13), 11, 0.3)]
    pa_ = N.nn_predict(em, Wn, net, method="arrow").orderBy("row_id").select("predict_label").collect()
    pe = N.nn_predict(em, Wn, net, method="expr").orderBy("row_id").select("predict_label").collect()
    np.testing.assert_allclose(np.array([r[0] for r in pa_]), np.array([r[0] for r in pe]), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("fan,chunk", [(1, 1 << 16), (2, 7), (64, 7)])
def test_sums_do_not_depend_on_fan_and_chunk(em, monkeypatch, fan, chunk):
    from stackwise.operators import step

    W, b, c = FX.em_rbm()
    p = R.RBMParams(W=W, b=b, c=c, sigma=FX.em_sigma())
    data = em.repartition(6)
    want = R.cd_step_sums(data, p, R.RBMConfig(seed=3), 11, True)
    monkeypatch.setattr(step, "FAN", fan)
    monkeypatch.setattr(step, "CHUNK", chunk)
    got = R.cd_step_sums(data, p, R.RBMConfig(seed=3), 11, True)
    for k in want:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-10, atol=1e-10)


def test_pca_matches_numpy_eigendecomposition(spark):
    from stackwise.operators.pca import pca_project

    li = I.lineitem_samples(spark, SF_SMALL)
    proj, ev, model = pca_project(li, 3)
    X = np.array([r["features"] for r in li.collect()])
    vals, vecs = np.linalg.eigh(np.cov(X, rowvar=False))
    order = np.argsort(vals)[::-1]
    np.testing.assert_allclose(ev, (vals[order] / vals.sum())[:3], rtol=1e-6, atol=1e-9)
    # projection is uncentred: pc^T x, with the components' sign free
    P = np.array([r["features"] for r in proj.collect()])
    ref = X @ vecs[:, order[:3]]
    for k in range(3):
        s = np.sign(np.dot(P[:, k], ref[:, k]))
        np.testing.assert_allclose(P[:, k], s * ref[:, k], rtol=1e-6, atol=1e-8)


def test_tasks_that_deal_rows_grow_with_the_input(spark, tmp_path, monkeypatch):
    from stackwise.plans import batches as B

    rows = spark.range(3000).select(F.col("id").alias("row_id"), F.array(F.rand(1)).alias("features"))
    rows.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).select("row_id", "features")
    assert 10_000 < B._input_bytes(df) < 1_000_000
    monkeypatch.setattr(B, "TASK_BYTES", 1000)
    with B.TrainingRows(df, 2, 3) as few:
        files = {p for p in few.rows.inputFiles()}
        assert few.rows.count() == 3000 and len(files) > 2 * B.BUCKETS_PER_BATCH
        assert sum(few.batch(0, b).count() for b in range(2)) == 3000


def test_layers_too_large_for_compiled_code_run_on_arrow(spark):
    """The flagship's layers (14 x 8, 8 x 3): as expressions their generated code is too long for the JVM's compiler."""
    from stackwise.operators.layers import dense_layer

    rng = np.random.default_rng(3)
    X = rng.random((50, 14))
    df = spark.createDataFrame([(i, [1.0, 0.0, 0.0], x.tolist()) for i, x in enumerate(X)], "row_id long, label array<double>, features array<double>")
    W = [rng.normal(size=(8, 15)), rng.normal(size=(3, 9))]
    net = N.NNConfig(sizes=(14, 8, 3), activation="sigm", output="sigm")
    hidden = dense_layer(df, "features", W[0][:, 1:], W[0][:, 0], "sigm", "h")
    scored = N.nn_predict(df, W, net)
    for made in (hidden, scored):
        assert "MapInArrow" in made._jdf.queryExecution().optimizedPlan().toString()
    a = np.array([r.h for r in hidden.orderBy("row_id").collect()])
    np.testing.assert_allclose(a, 1 / (1 + np.exp(-(X @ W[0][:, 1:].T + W[0][:, 0]))), rtol=1e-12)
    got = scored.orderBy("row_id").select("predict_label", "error").collect()
    want = N.nn_predict(df, W, net, method="expr").orderBy("row_id").select("predict_label", "error").collect()
    np.testing.assert_allclose(np.array(got, dtype=float), np.array(want, dtype=float), rtol=1e-12, atol=1e-15)
