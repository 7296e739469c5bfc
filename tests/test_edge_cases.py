"""Edge cases from the inventory: empty batch, tiny tables, unknown names and categories."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from stackwise.operators import nn as N
from stackwise.operators import prepare as P
from stackwise.operators import rbm as R
from stackwise.operators import sampling as S
from stackwise.plans import fixtures as FX
from stackwise.plans import inputs as I


def test_empty_batch_keeps_parameters(spark):
    em = I.embedding_samples(spark, SF_SMALL).filter(F.lit(False))
    W, b, c = FX.em_rbm()
    p = R.RBMParams(W=W, b=b, c=c)
    sums = R.cd_step_sums(em, p, R.RBMConfig(), 1, False)
    assert sums["n"] == 0
    q, err = R.apply_cd_update(p, sums, R.RBMConfig(), False)
    assert err is None and np.array_equal(q.W, p.W)


def test_fewer_rows_than_batch_size_still_trains(spark):
    em = I.embedding_samples(spark, SF_SMALL).limit(30)
    assert S.num_batches(30, 100) == 1
    fit = R.rbm_fit(em, 3, epochs=1, batch_size=100, seed=1)
    assert len(fit.history) == 1 and np.isfinite(fit.history[0][1])


def test_unknown_feature_name_fails_before_any_job(spark):
    li = I.table(spark, SF_SMALL, "lineitem")
    with pytest.raises(KeyError):
        P.select_features(li, "l_returnflag", ["l_quantity", "no_such_column"])


def test_unknown_category_modes(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    zero = [r[0] for r in df.select(P.one_hot("c", ["a", "b"], missing_fill=0.5)).collect()]
    assert zero == [[1.0, 0.0], [0.0, 0.0], [0.5, 0.5]]
    nul = [r[0] for r in df.select(P.one_hot("c", ["a", "b"], on_unknown="null")).collect()]
    assert nul == [[1.0, 0.0], None, None]
    with pytest.raises(Exception):
        df.select(P.one_hot("c", ["a", "b"], on_unknown="error")).collect()


def test_all_missing_numeric_column(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    out = P.impute_mean(df, ["a", "b"]).collect()
    assert [r["a"] for r in out] == [None, None]


def test_wrong_vector_width_raises(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [1.0]), (2, [1.0], [0.0])], "row_id long, features array<double>, label array<double>")
    W = [np.zeros((1, 3))]
    cfg = N.NNConfig(sizes=(2, 1))
    with pytest.raises(Exception):
        N.nn_gradient(df, W, cfg)


def test_label_width_check(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k long, c string")
    lab = F.when(F.col("c") == "x", F.array(F.lit(1.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    with pytest.raises(ValueError):
        P.assemble_samples(df, "k", lab, [F.col("k")], check_width=True)


def test_diagnosis_phrases_and_depth_rule(spark):
    from stackwise import roles

    df = spark.createDataFrame([("供液不足游动凡尔漏失",), ("抽油杆断脱,位置距井口m:1234.00",), ("不知",), (None,)], "d string")
    out = df.select(P.multi_hot("d", roles.DIAGNOSIS_WIDTH, phrases=roles.DIAGNOSIS_PHRASES,
                                strip_pattern=roles.DIAGNOSIS_DEPTH_SUFFIX, missing_fill=0.5).alias("v")).collect()
    v = [r["v"] for r in out]
    assert [i for i, x in enumerate(v[0]) if x == 1.0] == [1, 6]
    assert [i for i, x in enumerate(v[1]) if x == 1.0] == [10]
    assert sum(v[2]) == 0.0
    assert v[3] == [0.5] * 12


def test_one_hot_dictionaries_widths():
    from stackwise import roles

    widths = {k: len(v) for k, v in roles.ONE_HOT.items()}
    assert widths == {"渗透性类型": 4, "岩性": 2, "井型": 3, "抽油机机型": 35, "电机型号": 31, "对标结果": 3}
    assert len(roles.COLUMNS) == 41 and len(roles.NUMERIC_COLUMNS) == 33


def test_large_dictionary_one_hot_matches_small_path(spark):
    vals = [f"v{i}" for i in range(100)]
    df = spark.createDataFrame([("v3",), ("v99",), ("zz",), (None,)], "c string")
    out = [r[0] for r in df.select(P.one_hot("c", vals, missing_fill=0.0)).collect()]
    assert out[0].index(1.0) == 3 and sum(out[0]) == 1.0
    assert out[1].index(1.0) == 99 and sum(out[1]) == 1.0
    assert out[2] == [0.0] * 100 and out[3] == [0.0] * 100
