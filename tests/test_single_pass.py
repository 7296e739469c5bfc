"""What is read once: statistics observed while the typed table is written; the sparsity penalty in one pass."""

import glob
import json
import os
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwise.operators import nn as N
from stackwise.operators import prepare as P
from stackwise.sources import tables as T

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def text_table(spark):
    return spark.range(200).select(F.when(F.col("id") % 3 == 0, F.lit(" ")).otherwise(F.col("id").cast("string")).alias("x"), F.lit("4").alias("same"),
                                   F.lit("").alias("none"), F.when(F.col("id") % 4 == 0, F.lit("")).otherwise(F.lit("b")).alias("kind"))


@pytest.mark.parametrize("zero_fill", [False, True])
def test_observed_statistics_equal_the_aggregation(spark, tmp_path, zero_fill):
    df, numeric = text_table(spark), ["x", "same", "none"]
    seen = P.write_observed(df, str(tmp_path / "t"), numeric, zero_fill=zero_fill)
    want = P.column_stats_row(P.blank_to_null(df), numeric, zero_fill=zero_fill)
    assert {c: v[:3] for c, v in seen.items()} == want and {c: v[3] for c, v in seen.items()} == {"x": 67, "same": 0, "none": 200}
    back = spark.read.parquet(str(tmp_path / "t"))
    assert dict(back.dtypes) == {"x": "double", "same": "double", "none": "double", "kind": "string"} and back.filter("kind IS NULL").count() == 50


def test_written_preparation_equals_the_lazy_one(spark, tmp_path):
    df = text_table(spark)
    spec = dict(one_hot_cols={"kind": ["a", "b"]}, missing_fill={"kind": 0.5})
    for i, (fill, twice) in enumerate([(False, False), (True, False), (False, True)]):
        lazy, _ = P.prepare_table(df, ["x", "same"], zero_fill_stats=fill, double_scale=twice, **spec)
        kept, _ = P.prepare_table(df, ["x", "same"], zero_fill_stats=fill, double_scale=twice, written_to=str(tmp_path / str(i)), **spec)
        assert lazy.columns == kept.columns and sorted(map(str, lazy.collect())) == sorted(map(str, kept.collect()))


def test_empty_and_plain_tables(spark, tmp_path):
    df = text_table(spark)
    empty, stats = P.prepare_table(df.filter("x = 'no such'"), ["x"], written_to=str(tmp_path / "e"))
    assert empty.count() == 0 and stats["x"][:3] == (None, None, None)
    plain, stats = P.prepare_table(df.select("kind"), [], written_to=str(tmp_path / "p"))
    assert plain.count() == 200 and stats == {}


def test_text_input_is_read_once(tmp_path):
    """Records read per file format, from the event log of a session of its own."""
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        from stackwise.operators import prepare as P
        from stackwise.sources import tables as T
        spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true")
                 .config("spark.eventLog.compress", "false").config("spark.eventLog.dir", "file://{tmp_path}/log").getOrCreate())
        raw = T.read_raw_table(spark, "{tmp_path}/csv", columns=["x", "y", "z"])
        out, _ = P.prepare_table(raw, ["x", "y"], written_to="{tmp_path}/typed")
        out.select("x").write.format("noop").mode("overwrite").save()
        spark.stop()
    """))
    (tmp_path / "log").mkdir()
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text("x,y,z\n" + "".join(f'"{i}","{i % 5}","t{i}"\n' for i in range(5000)))
    subprocess.run([sys.executable, str(script)], check=True, timeout=300, capture_output=True)
    plans, read = [], {}
    for name in glob.glob(f"{tmp_path}/log/**/*", recursive=True):
        if os.path.isfile(name) and not os.path.basename(name).startswith("appstatus"):
            for line in open(name):
                e = json.loads(line)
                if e["Event"].endswith("SparkListenerSQLExecutionStart"):
                    plans.append(e["physicalPlanDescription"])
                if e["Event"] == "SparkListenerTaskEnd":
                    n = e["Task Metrics"]["Input Metrics"]["Records Read"]
                    read[e["Stage ID"]] = read.get(e["Stage ID"], 0) + n
    assert sum("Scan csv" in p for p in plans) == 1
    assert sorted(n for n in read.values() if n) == [5000, 5000]  # the text once, the typed rows once
    last = next(p for p in plans if "Scan parquet" in p)
    assert "ReadSchema: struct<x:double>" in last


def samples(spark, n=300):
    return spark.range(n).select(F.col("id").alias("row_id"), F.array((F.col("id") % 7) / 7.0, (F.col("id") % 5) / 5.0, (F.col("id") % 3) / 3.0).alias("features"),
                                 F.array((F.col("id") % 2).cast("double"), F.lit(0.5)).alias("label"))


def two_passes(df, W, cfg, seed):
    """The penalty by its definition: activity first, gradient with the term in the deltas second."""
    first = N._run(df, W, cfg, training=True, step_seed=seed, want_grad=False, want_act=True)
    p = N.mean_activation_update({l: np.full(cfg.sizes[l], 0.02) for l in range(1, cfg.n_layers - 1)}, first, first["n"], cfg)
    sums = N._run(df, W, cfg, training=True, step_seed=seed, want_grad=True, want_act=False, p=p)
    return [sums[f"g{l}"] / sums["n"] for l in range(len(W))], p


@pytest.mark.parametrize("kw", [{}, {"dropout": 0.3}, {"noise": 0.2, "activation": "tanh_opt", "output": "sigm"}])
def test_sparsity_in_one_pass_equals_two(spark, monkeypatch, kw):
    df, jobs = samples(spark), []
    counted = N.step_sums
    monkeypatch.setattr(N, "step_sums", lambda *a, **k: (jobs.append(1), counted(*a, **k))[1])
    for sizes, passes in (((3, 4, 2), 1), ((3, 4, 5, 2), 2), ((3, 2), 1)):
        cfg = N.NNConfig(sizes=sizes, sparsity=0.3, sparsity_target=0.1, seed=4, **kw)
        W = N.init_weights(sizes, 2)
        jobs.clear()
        got = N.nn_gradient(df, W, cfg, step_seed=9, p={l: np.full(cfg.sizes[l], 0.02) for l in range(1, cfg.n_layers - 1)})
        assert len(jobs) == passes
        grads, p = two_passes(df, W, cfg, 9)
        for a, b in zip(got["grads"], grads):
            assert np.abs(a - b).max() < 1e-12
        assert all(np.allclose(got["p"][l], p[l], atol=1e-15) for l in p)
    assert N.nn_gradient(df.limit(0), W, cfg) == {"n": 0.0}


SHORT, LONG, NULL, HOLE = [1.0], [1.0, 0.0, 1.0], None, [1.0, None]


@pytest.mark.parametrize("label", [SHORT, LONG, NULL, HOLE])
def test_wrong_labels_raise_in_every_form(spark, label):
    good = [(i, [0.1, 0.2, 0.3], [1.0, 0.0]) for i in range(5)]
    df = spark.createDataFrame([*good, (9, [0.1, 0.2, 0.3], label)], "row_id long, features array<double>, label array<double>")
    cfg = N.NNConfig(sizes=(3, 4, 2))
    W = N.init_weights(cfg.sizes, 1)
    for run in (lambda: N.nn_predict(df, W, cfg, method="expr").collect(), lambda: N.nn_predict(df, W, cfg, method="arrow").collect(), lambda: N.nn_forward(df, W, cfg).collect(),
                lambda: N.nn_gradient(df, W, cfg), lambda: N.nn_evaluate(df, W, cfg), lambda: N.nn_fit(df, cfg, epochs=1)):
        with pytest.raises(Exception, match="vector column"):
            run()


@pytest.mark.parametrize("features", [[0.1, 0.2], None, [0.1, None, 0.2], [0.1] * 4])
def test_wrong_features_raise_in_every_form(spark, features):
    df = spark.createDataFrame([(1, features, [1.0, 0.0])], "row_id long, features array<double>, label array<double>")
    cfg = N.NNConfig(sizes=(3, 4, 2))
    W = N.init_weights(cfg.sizes, 1)
    for run in (lambda: N.nn_predict(df, W, cfg, method="expr").collect(), lambda: N.nn_predict(df, W, cfg, method="arrow").collect(),
                lambda: N.nn_gradient(df, W, cfg), lambda: N.nn_evaluate(df, W, cfg)):
        with pytest.raises(Exception, match="vector column"):
            run()


def test_samples_without_labels_raise_before_a_job(spark):
    df = samples(spark).drop("label")
    cfg = N.NNConfig(sizes=(3, 4, 2))
    with pytest.raises(ValueError, match="label"):
        N.nn_gradient(df, N.init_weights(cfg.sizes, 1), cfg)


@pytest.mark.parametrize("size", [3, 100])
def test_repeated_dictionary_values_raise_at_every_size(size):
    with pytest.raises(ValueError, match="repeated"):
        P.one_hot("c", [*map(str, range(size)), "1"])


def test_existing_column_keeps_its_place_in_both_forms(spark):
    from stackwise.operators.layers import dense_layer

    df = samples(spark, 10)
    forms = [dense_layer(df, "features", np.ones((2, 3)), None, "sigm", "features", method=m) for m in ("expr", "arrow")]
    assert forms[0].columns == forms[1].columns == ["row_id", "features", "label"]
    assert sorted(map(str, forms[0].collect())) == sorted(map(str, forms[1].collect()))
