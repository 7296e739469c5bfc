"""Scoring a file stream equals scoring the same rows in batch."""

import numpy as np

from conftest import SF_SMALL
from stackwise.operators import nn as N
from stackwise.plans import catalog as C
from stackwise.plans import fixtures as FX
from stackwise.plans import inputs as I
from stackwise.session import scratch_path
from stackwise.streaming import score_stream, write_scores


def test_stream_scores_equal_batch_scores(spark):
    em = I.embedding_samples(spark, SF_SMALL)
    src = scratch_path(spark, "stream-src")
    em.repartition(4).write.parquet(src)
    model = N.NNModel(C.em_cfg(), FX.em_weights())
    stream = spark.readStream.schema(em.schema).parquet(src)
    out, ckpt = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    q = write_scores(score_stream(stream, model), out, ckpt)
    q.awaitTermination(120)
    got = {r["row_id"]: r["predict_label"] for r in spark.read.parquet(out).collect()}
    want = {r["row_id"]: r["predict_label"] for r in model.predict(em).collect()}
    assert got.keys() == want.keys()
    np.testing.assert_allclose(np.array([got[k] for k in sorted(got)]), np.array([want[k] for k in sorted(want)]), rtol=1e-12)


def test_model_table_round_trip(spark):
    from stackwise.plans import model_table as MT

    W = FX.em_weights()
    path = scratch_path(spark, "model")
    MT.save(spark, W, path)
    back = MT.load(spark, path)
    assert [w.shape for w in back] == [w.shape for w in W]
    for a, b in zip(W, back):
        np.testing.assert_array_equal(a, b)
