"""Registered queries: one per operator of the inventory, each over whole driver tables.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame. Outputs are long form and
rounded (6 decimals for means, 4 for sums over many rows) so an independent engine can
compare them; every computed column has an explicit alias.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwise import roles
from stackwise.functions import activations as A
from stackwise.functions import vectors as V
from stackwise.operators import aggregates as E
from stackwise.operators import dbn as D
from stackwise.operators import evaluate as H
from stackwise.operators import nn as N
from stackwise.operators import prepare as P
from stackwise.operators import rbm as R
from stackwise.operators import sampling as S
from stackwise.operators.blocked import bias_blocks, dense_blocked, weight_blocks
from stackwise.operators.layers import dense_layer
from stackwise.operators.pca import pca_project, pca_project_wide
from stackwise.plans import fixtures as FX
from stackwise.plans import inputs as I
from stackwise.plans import wells
from stackwise.plans.runs import run_history
from stackwise.session import scratch_path
from stackwise.sources.numbered import numbered_files
from stackwise.sources import tables as T

SEED = 7


# Rounding for cross-engine comparison: a 1e-9 nudge keeps exact decimal ties (means of
# 2-decimal data) off the rounding boundary in every engine.
NUDGE = 1e-9


def round6(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(NUDGE), 6) + F.lit(0.0)


def round4(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(NUDGE), 4) + F.lit(0.0)


def r6(c):
    return round6(c).alias("value")


def r4(c):
    return round4(c).alias("value")


def rnd(x: float, d: int = 6) -> float:
    return float(round(float(x) + NUDGE, d)) + 0.0


def _vectors(df: DataFrame, specs) -> DataFrame:
    """Keyed rows: the slots of several vector columns as columns of their own; specs: (col, width)."""
    return df.select(F.col("row_id").cast("long").alias("row_id"), *(round6(F.col(c)[i]).alias(f"{c}{i}") for c, width in specs for i in range(width)))


def _numbered_samples(spark, sf):
    """Samples of lineitem, which has no key, with the row numbers of its file as row_id."""
    li = numbered_files(I.table(spark, sf, "lineitem"))
    return li.select("row_id", V.one_hot_lit(F.col("l_returnflag"), I.RETURNFLAGS).alias("label"), F.array(*I.li_feature_cols()).alias("features"))


def params_df(spark: SparkSession, items) -> DataFrame:
    """Rows (param, out, in, value) from (name, array) pairs; vectors use in = 0."""
    rows = []
    for name, arr in items:
        a = np.asarray(arr, dtype=float)
        if a.ndim == 0:
            rows.append((name, 0, 0, rnd(a)))
        elif a.ndim == 1:
            rows += [(name, j, 0, rnd(v)) for j, v in enumerate(a)]
        else:
            rows += [(name, j, i, rnd(a[j, i])) for j in range(a.shape[0]) for i in range(a.shape[1])]
    return spark.createDataFrame(rows, "param string, out int, `in` int, value double")


def params_long(spark: SparkSession, a) -> DataFrame:
    """(out, in, w) of a matrix, (out, w) of a vector."""
    if a.ndim == 1:
        return spark.createDataFrame([(j, float(v)) for j, v in enumerate(a)], "out int, w double")
    return spark.createDataFrame([(j, i, float(a[j, i])) for j in range(a.shape[0]) for i in range(a.shape[1])], "out int, `in` int, w double")


# ============================================================================ A: sources

def q_read_raw_table(spark, sf):
    o = I.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    path = scratch_path(spark, "raw-orders")
    T.write_raw_table(o, path)
    raw = T.read_raw_table(spark, path, columns=o.columns)
    return raw.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"),
                      "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderpriority")


def q_read_quoted_table(spark, sf):
    """A1 with line breaks, commas and quote signs inside cells: files are split, records are put together again."""
    o = I.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    note = F.concat(F.lit('key "'), key.cast("string"), F.lit('",\n'), F.repeat(F.lit("line\n"), (key % 4).cast("int")), F.col("o_orderpriority"))
    path = scratch_path(spark, "quoted-orders")
    T.write_raw_table(o.select(key.cast("string").alias("o_orderkey"), note.alias("note"), "o_orderstatus"), path)
    return T.read_raw_table(spark, path, columns=["o_orderkey", "note", "o_orderstatus"], multi_line=True).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "note", "o_orderstatus")


def q_read_clean_table(spark, sf):
    """Keyed rows of what was written as text and read back."""
    path = scratch_path(spark, "clean-li")
    T.write_clean_table(_numbered_samples(spark, sf), path, vector_cols=["label", "features"])
    back = T.read_clean_table(spark, path, vector_cols=["label", "features"], numeric_cols=["row_id"])
    return _vectors(back, [("label", 3), ("features", 4)])


def q_parse_numeric_rows(spark, sf):
    o = I.table(spark, sf, "orders")
    line = F.concat_ws(",", F.col("o_totalprice").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))
    df = T.parse_numeric_rows(o.select("o_orderkey", line.alias("line")), "line", "v")
    return df.select("o_orderkey", F.col("v")[0].alias("p0"), F.col("v")[1].alias("p1"), F.col("v")[2].alias("p2"),
                     F.size("v").alias("width"))


def q_write_clean_table(spark, sf):
    ev = I.event_samples(spark, sf)
    holes = ev.select("row_id", F.transform("features", lambda x, i: F.when((F.col("row_id") + i) % 5 != 0, x)).alias("features"))
    path = scratch_path(spark, "clean-events-text")
    T.write_clean_table(holes, path, vector_cols=["features"])
    back = T.read_clean_table(spark, path, vector_cols=["features"], numeric_cols=["row_id"])
    return back.select(F.col("row_id").cast("long").alias("row_id"), F.size("features").alias("width"), *(F.col("features")[i].alias(f"x{i}") for i in range(3)))


def q_training_history(spark, sf):
    em = I.embedding_samples(spark, sf, binary=True)
    W, b, c = FX.em_rbm(5)
    fit = R.rbm_fit_full_batch(em, R.RBMParams(W=W, b=b, c=c), epochs=3, alpha=0.02, momentum=0.1, seed=SEED)
    return T.training_history(spark, fit.history, "rbm_full_batch")


def q_training_run(spark, sf):
    """A run of three epochs that ends after the first, is called again, and its committed errors."""
    path = scratch_path(spark, "training-run")
    spec = dict(n_batches=2, validation=0.3, init_weights_=FX.em_weights(), run_path=path)
    for epochs in (1, 3):
        fit = N.nn_fit(_em(spark, sf), em_cfg(dropout=0.2, scaling_learning_rate=0.5), epochs=epochs, **spec)
    W = fit.model.weights
    errors = run_history(spark, path)
    return params_df(spark, [("W0", W[0]), ("W1", W[1])]).union(
        errors.select(F.explode(F.array(F.struct(F.lit("train_error").alias("param"), F.col("train_error").alias("v")), F.struct(F.lit("val_error").alias("param"), F.col("val_error").alias("v")))).alias("e"), "epoch")
        .select("e.param", (F.col("epoch") - 1).alias("out"), F.lit(0).alias("in"), r6(F.col("e.v"))))


def q_preview_rows(spark, sf):
    o = I.table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        "o_totalprice", "o_orderpriority")
    return T.preview_rows(o, 11, "o_orderkey")


def q_concat_datasets(spark, sf):
    o = I.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    both = T.concat_datasets(o, o.filter(F.col("o_orderstatus") == "F"))
    return both.groupBy("o_orderstatus").agg(F.count(F.lit(1)).cast("long").alias("n"), F.sum("o_orderkey").cast("long").alias("key_sum"))


# ============================================================================ B: preparation

def _blank_orders(spark, sf):
    o = I.table(spark, sf, "orders")
    return o.select("o_orderkey",
                    F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
                    F.when(F.col("o_orderpriority") == "5-LOW", F.lit("  ")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))


def q_blank_to_null(spark, sf):
    return P.blank_to_null(_blank_orders(spark, sf))


def q_one_hot_encode(spark, sf):
    """Keyed rows; two of the five priorities are outside the dictionary."""
    o = I.table(spark, sf, "orders")
    df = o.select("o_orderkey", P.one_hot("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).alias("v"))
    return df.select("o_orderkey", *(F.col("v")[i].alias(f"v{i}") for i in range(3)))


# keyword rules and a small exact-phrase dictionary for part names (query fixture)
PART_ADJ = ["blue", "new", "cold", "small", "hot", "old", "red", "large"]
PART_NOUN = ["plate", "rod", "gear", "gizmo", "widget", "ring", "bolt", "anvil"]
PART_PHRASES = {"red widget": [0], "blue bolt": [1, 2], "unknown": []}


def part_keywords():
    kw = {w: [i] for i, w in enumerate(PART_ADJ)}
    kw.update({w: [8 + i] for i, w in enumerate(PART_NOUN)})
    return kw


def q_multi_hot_encode(spark, sf):
    part = I.table(spark, sf, "part")
    df = part.select(P.multi_hot("p_name", 16, phrases=PART_PHRASES, keywords=part_keywords()).alias("bits"))
    one = df.agg(*[F.sum(F.col("bits")[i]).alias(f"u{i}") for i in range(16)])
    st = ", ".join(f"{i}, u{i}" for i in range(16))
    return one.selectExpr(f"stack(16, {st}) AS (unit, v)").select(F.col("unit").cast("int").alias("unit"), r4(F.col("v")))


def q_encode_passthrough(spark, sf):
    o = I.table(spark, sf, "orders")
    return P.unmatched_values(o, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


def q_profile_columns(spark, sf):
    li = I.table(spark, sf, "lineitem").select(
        "l_quantity", F.expr("nullif(l_discount, 0)").alias("l_discount"),
        F.expr("nullif(l_returnflag, 'A')").alias("l_returnflag"), "l_linestatus")
    roles = {"l_quantity": "numeric", "l_discount": "numeric", "l_returnflag": "category", "l_linestatus": "category"}
    return P.profile_columns(li, roles)


def q_select_features(spark, sf):
    li = numbered_files(I.table(spark, sf, "lineitem")).withColumn("rf", P.one_hot("l_returnflag", I.RETURNFLAGS))
    df = P.select_features(li, "rf", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], row_id="row_id")
    return _vectors(df, [("label", 3), ("features", 4)])


def q_assemble_samples(spark, sf):
    o = I.table(spark, sf, "orders")
    df = P.assemble_samples(o, "o_orderkey", P.one_hot("o_orderstatus", I.ORDERSTATUS),
                            [F.col("o_totalprice") / 500000, (F.col("o_custkey") % 1000) / 1000])
    return df.select("row_id", F.size("label").alias("label_width"), F.col("label")[0].alias("l0"), F.col("label")[1].alias("l1"),
                     F.col("label")[2].alias("l2"), F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"))


def _li_numeric(spark, sf):
    return I.table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", F.expr("nullif(l_discount, 0)").alias("l_discount"), "l_tax")


LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def q_column_stats(spark, sf):
    st = P.column_stats(_li_numeric(spark, sf), LI_NUM)
    return st.select("column", round6("min").alias("min"), round6("max").alias("max"),
                     round6("mean").alias("mean"))


def _order_numbers(spark, sf):
    o = I.table(spark, sf, "orders")
    return o.select("o_orderkey", F.expr("CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END").alias("price"),
                    F.col("o_custkey").cast("double").alias("cust"))


def q_impute_mean(spark, sf):
    df = P.impute_mean(_order_numbers(spark, sf), ["price", "cust"])
    return df.select("o_orderkey", round4("price").alias("price"), round4("cust").alias("cust"))


def q_min_max_scale(spark, sf):
    df = P.min_max_scale(_order_numbers(spark, sf), ["price", "cust"])
    return df.select("o_orderkey", round6("price").alias("price"), round6("cust").alias("cust"))


def q_impute_category_default(spark, sf):
    o = I.table(spark, sf, "orders").select(F.expr("nullif(o_orderstatus, 'P')").alias("s"))
    df = o.select(P.impute_category_default(P.one_hot("s", ["F", "O"]), 2, 0.5).alias("v"))
    one = df.agg(F.sum(F.col("v")[0]).alias("u0"), F.sum(F.col("v")[1]).alias("u1"))
    return one.selectExpr("stack(2, 0, u0, 1, u1) AS (unit, v)").select(F.col("unit").cast("int").alias("unit"), r4(F.col("v")))


def q_prepare_table(spark, sf):
    """Keyed rows of the prepared table, codes and scaled numbers."""
    li = numbered_files(I.table(spark, sf, "lineitem")).select(
        "row_id", F.when(F.col("l_returnflag") == "A", F.lit("")).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus", "l_quantity", "l_extendedprice", F.expr("nullif(l_discount, 0)").alias("l_discount"), "l_tax")
    out, _ = P.prepare_table(li, LI_NUM, one_hot_cols={"l_returnflag": ["N", "R"], "l_linestatus": I.LINESTATUS},
                             missing_fill={"l_returnflag": 0.5})
    return out.select("row_id", *(F.col(c)[i].alias(f"{c}{i}") for c in ("l_returnflag", "l_linestatus") for i in range(2)), *(round6(c).alias(c) for c in LI_NUM))


def _text_orders(spark, sf):
    """Orders as a quoted text table: every seventh price and every fifth status is blank."""
    o = I.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    text = o.select(key.cast("string").alias("o_orderkey"), F.when(key % 5 == 0, F.lit(" ")).otherwise(F.col("o_orderstatus")).alias("status"),
                    F.when(key % 7 == 0, F.lit("")).otherwise(F.col("o_totalprice").cast("string")).alias("price"), F.col("o_custkey").cast("string").alias("cust"))
    path = scratch_path(spark, "text-orders")
    T.write_raw_table(text, path)
    return T.read_raw_table(spark, path, columns=text.columns)


def q_prepare_text_table(spark, sf):
    """B1, B2, B8-B12 of a text table that is read once: keyed rows of the prepared table."""
    out, _ = P.prepare_table(_text_orders(spark, sf), ["price", "cust"], one_hot_cols={"status": I.ORDERSTATUS}, missing_fill={"status": 0.5},
                             written_to=scratch_path(spark, "typed-orders"))
    return out.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), round6("price").alias("price"), round6("cust").alias("cust"),
                      *(F.col("status")[i].alias(f"s{i}") for i in range(3)))


def q_write_observed(spark, sf):
    """What is observed of a text table while its typed columns are written."""
    stats = P.write_observed(_text_orders(spark, sf), scratch_path(spark, "typed-orders"), ["price", "cust"])
    return P.observed_stats(spark, stats).select("column", round6("min").alias("min"), round6("max").alias("max"), round6("mean").alias("mean"), "n_missing")


# ============================================================================ C: sampling

def q_number_rows(spark, sf):
    """Row numbers beside the rows they stand for."""
    return numbered_files(I.table(spark, sf, "lineitem")).select("row_id", "l_orderkey", "l_linenumber", "l_extendedprice")


def q_split_unkeyed(spark, sf):
    """C1, C2 on a table without a key: side and batch of every row."""
    li = _numbered_samples(spark, sf)
    return li.select("row_id", F.when(S.validation_flag("row_id", 0.2, SEED), F.lit("validation")).otherwise(F.lit("train")).alias("side"),
                     S.batch_id("row_id", 10, SEED, 0).alias("batch_id"))


def q_draws_unkeyed(spark, sf):
    """C3-C7 on a table without a key; equal rows draw apart."""
    li = _numbered_samples(spark, sf)
    df = li.select("row_id", S.mask_noise("features", 0.3, SEED, width=4).alias("noise"), S.dropout_mask("features", 0.4, SEED, width=4).alias("mask"),
                   S.sample_states("features", SEED, width=4).alias("state"), S.sigmoid_sample("features", SEED, width=4).alias("sigm"))
    return _slots(df, ["noise", "mask", "state", "sigm"], 4)


def q_rbm_fit_unkeyed(spark, sf):
    """F7 on a table without a key: rows are written, numbered and trained on."""
    W, c, b = FX.li_layer()
    init = R.RBMParams(W=W, b=b, c=c, sigma=np.ones(4))
    fit = R.gaussian_rbm_fit(I.lineitem_samples(spark, sf), init=init, epochs=2, momentum=0.1, alpha=0.05, seed=SEED)
    p = fit.params
    return params_df(spark, [("W", p.W), ("b", p.b), ("c", p.c), ("sigma", p.sigma), ("err", np.array([e for _, e in fit.history]))])


def q_nn_fit_unkeyed(spark, sf):
    """G5 on a table without a key, with draws of every kind: noise, dropout, validation rows."""
    cfg = N.NNConfig(sizes=FX.LI_SIZES, activation="sigm", output="sigm", learning_rate=1.0, momentum=0.5, noise=0.2, dropout=0.3, seed=SEED)
    fit = N.nn_fit(I.lineitem_samples(spark, sf), cfg, epochs=2, n_batches=1, validation=0.3, init_weights_=FX.li_weights())
    W = fit.model.weights
    return params_df(spark, [("W0", W[0]), ("W1", W[1]), ("train_error", np.array([h[1] for h in fit.history])), ("val_error", np.array([h[2] for h in fit.history]))])


def q_train_validation_split(spark, sf):
    ev = I.event_samples(spark, sf)
    df = ev.withColumn("side", F.when(S.validation_flag("row_id", 0.2, SEED), F.lit("validation")).otherwise(F.lit("train")))
    return df.groupBy("side").agg(F.count(F.lit(1)).cast("long").alias("n"), F.sum("row_id").cast("long").alias("key_sum"))


def q_mini_batches(spark, sf):
    ev = S.mini_batches(I.event_samples(spark, sf), 10, SEED, 0)
    return ev.groupBy("batch_id").agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.sum("row_id").cast("long").alias("key_sum"))


def _slots(df, cols, width=3):
    """Keyed rows: the vectors' slots as columns of their own, exact for 0/1 vectors and rounded else."""
    return _vectors(df, [(c, width) for c in cols])


def q_mask_noise(spark, sf):
    ev = I.event_samples(spark, sf)
    return _slots(ev.select("row_id", S.mask_noise("features", 0.3, SEED, width=3).alias("x")), ["x"])


def q_dropout_mask(spark, sf):
    ev = I.event_samples(spark, sf)
    df = ev.select("row_id", S.dropout_mask("features", 0.4, SEED, width=3).alias("mask"),
                   S.apply_dropout("features", 0.4, SEED, width=3).alias("train"),
                   S.apply_dropout("features", 0.4, SEED, testing=True, width=3).alias("test"))
    return _slots(df, ["mask", "train", "test"])


def q_sample_states(spark, sf):
    ev = I.event_samples(spark, sf)
    return _slots(ev.select("row_id", S.sample_states("features", SEED, width=3).alias("x")), ["x"])


def q_sigmoid_sample(spark, sf):
    ev = I.event_samples(spark, sf)
    shifted = V.map_slots("features", lambda x, i: x * 4.0 - 2.0, 3)
    return _slots(ev.select("row_id", S.sigmoid_sample(shifted, SEED, width=3).alias("x")), ["x"])


def q_sigmoid_additive_noise(spark, sf):
    ev = I.event_samples(spark, sf)
    return _slots(ev.select("row_id", S.sigmoid_additive_noise("features", SEED, width=3).alias("x")), ["x"])


# ============================================================================ D, E: vectors and aggregates

def q_activate(spark, sf):
    li = _numbered_samples(spark, sf)
    df = li.select("row_id", *[A.activate("features", fn, 4).alias(fn) for fn in A.ACTIVATIONS])
    return _vectors(df, [(fn, 4) for fn in A.ACTIVATIONS])


def q_activation_gradient(spark, sf):
    li = _numbered_samples(spark, sf)
    acts = li.select("row_id", *[A.activate("features", fn, 4).alias(fn) for fn in A.ACTIVATIONS])
    df = acts.select("row_id", *[A.activation_gradient(fn, fn, 4).alias(fn) for fn in A.ACTIVATIONS])
    return _vectors(df, [(fn, 4) for fn in A.ACTIVATIONS])


def q_dense_layer(spark, sf):
    W, c = FX.order_layer()
    h = I.order_samples(spark, sf).select("row_id", V.dense("features", W, c, "sigm").alias("h"))
    return _slots(h, ["h"])


def q_add_bias(spark, sf):
    li = _numbered_samples(spark, sf)
    df = li.select("row_id", V.add_bias("features").alias("with_bias")).select("row_id", "with_bias", V.drop_bias("with_bias").alias("without_bias"))
    return _vectors(df, [("with_bias", 5), ("without_bias", 4)])


def _pca_rows(spark, projected, ev):
    pairs = [(a, b) for a in range(3) for b in range(a, 3)]
    x = F.col("features")
    one = projected.agg(*(F.abs(F.avg(x[a] * x[b])).alias(f"m{a}{b}") for a, b in pairs))
    moments = one.selectExpr(f"stack({len(pairs)}, " + ", ".join(f"{a}, {b}, m{a}{b}" for a, b in pairs) + ") AS (component, other, v)")
    variance = spark.createDataFrame([(i, -1, rnd(v)) for i, v in enumerate(ev)], "component int, other int, value double")
    return variance.union(moments.select(F.col("component").cast("int"), F.col("other").cast("int"), r6(F.col("v"))))


def q_pca_project(spark, sf):
    """Explained variance, and the second moments of the projected rows (the sign of a component is free)."""
    projected, ev, _ = pca_project(I.lineitem_samples(spark, sf), 3)
    return _pca_rows(spark, projected, ev)


def q_pca_project_wide(spark, sf):
    """The same by the range finder, which makes no matrix of the width."""
    projected, ev, _ = pca_project_wide(I.lineitem_samples(spark, sf), 3)
    return _pca_rows(spark, projected, ev)


def q_dense_layer_wide(spark, sf):
    """64 -> 80 units: the Arrow form, one checksum pair per row."""
    W, c = FX.em_wide()
    h = dense_layer(_em(spark, sf), "features", W, c, "sigm", "h")
    return h.select("row_id", round6(F.aggregate("h", F.lit(0.0), lambda acc, v: acc + v)).alias("total"), round6(F.col("h")[0]).alias("h0"), round6(F.col("h")[79]).alias("h79"))


def q_dense_layer_blocked(spark, sf):
    """The same layer with its weights as a table of blocks: no parameter array on the driver or in a task."""
    spark_W, spark_c = (params_long(spark, a) for a in FX.em_wide())
    h = dense_blocked(_em(spark, sf), "features", weight_blocks(spark_W, 32), bias_blocks(spark_c, 32), "sigm", "h", n_in=FX.EM_WIDTH, n_out=80, block=32)
    return h.select("row_id", round6(F.aggregate("h", F.lit(0.0), lambda acc, v: acc + v)).alias("total"), round6(F.col("h")[0]).alias("h0"), round6(F.col("h")[79]).alias("h79"))


def q_nn_predict_wide(spark, sf):
    cfg = N.NNConfig(sizes=(FX.EM_WIDTH, 80, 10), activation="sigm", output="sigm")
    pred = N.nn_predict(_em(spark, sf), FX.em_wide_net(), cfg)
    return pred.select("row_id", *(round6(F.col("predict_label")[i]).alias(f"p{i}") for i in range(10)))


def q_count_samples(spark, sf):
    return E.count_samples(I.lineitem_samples(spark, sf))


def q_vector_mean(spark, sf):
    return E.vector_mean(I.lineitem_samples(spark, sf), "features", 4).select(F.col("unit").cast("int").alias("unit"), r6(F.col("value")))


def q_outer_product_mean(spark, sf):
    df = E.outer_product_mean(I.lineitem_samples(spark, sf), "label", "features")
    return df.select("out", "in", r6(F.col("value")))


def q_reconstruction_error(spark, sf):
    W, c, b = FX.li_layer()
    li = I.lineitem_samples(spark, sf)
    h = li.select("features", V.dense("features", W, c, "sigm").alias("h"))
    rec = h.select("features", V.dense("h", W.T, b, "sigm").alias("rec"))
    return E.reconstruction_error(rec, "features", "rec").select(round6("error").alias("error"))


def q_half_mse(spark, sf):
    W, c, _ = FX.li_layer()
    li = I.lineitem_samples(spark, sf)
    out = li.select(V.vsub("label", V.dense("features", W, c, "sigm"), 3).alias("error"))
    return E.half_mse(out, "error").select(round6("loss").alias("loss"))


def q_tuple_sum(spark, sf):
    li = I.lineitem_samples(spark, sf)
    exprs = {"n": F.lit(1)}
    exprs.update({f"label{i}": F.col("label")[i] for i in range(3)})
    exprs.update({f"feature{i}": F.col("features")[i] for i in range(4)})
    one = E.tuple_sum(li, exprs)
    return one.select(F.col("n").cast("long").alias("n"), *[round4(k).alias(k) for k in exprs if k != "n"])


def q_mean_activation(spark, sf):
    W, c, _ = FX.li_layer()
    li = I.lineitem_samples(spark, sf)
    h = li.select(V.dense("features", W, c, "sigm").alias("h"))
    return E.mean_activation(h, "h", np.full(3, 0.05), 0.99, 3).select(F.col("unit").cast("int").alias("unit"), r6(F.col("value")))


# ============================================================================ F: RBM and DBN

def _emb(spark, sf):
    return I.embedding_samples(spark, sf, binary=True)


def _em(spark, sf):
    return I.embedding_samples(spark, sf)


def _step_means(spark, sums, names):
    n = sums["n"]
    items = [(k, sums[k] / n) for k in names]
    items.append(("n", np.array(n)))
    return params_df(spark, items)


def q_rbm_cd_binary(spark, sf):
    W, b, c = FX.em_rbm()
    P_ = {"W": W, "b": b, "c": c, "alpha": np.array(0.02), "seed": np.array(SEED)}
    p = R.RBMParams(W=W, b=b, c=c)
    df = _emb(spark, sf)
    sums = R.step_sums(df.select("row_id", "features"), R.full_batch_binary_rows, P_, R._shapes(p, False), label=None)
    return _step_means(spark, sums, ["dW", "db", "dc", "err"])


def q_rbm_fit_full_batch(spark, sf):
    W, b, c = FX.em_rbm()
    fit = R.rbm_fit_full_batch(_emb(spark, sf), R.RBMParams(W=W, b=b, c=c), epochs=2, alpha=0.02, momentum=0.1, seed=SEED)
    p = fit.params
    return params_df(spark, [("W", p.W), ("b", p.b), ("c", p.c), ("err", np.array([e for _, e in fit.history]))])


def _cd_step_query(spark, df, gaussian: bool, k: int = 1, noise: str = "normal"):
    W, b, c = FX.em_rbm()
    p = R.RBMParams(W=W, b=b, c=c, sigma=FX.em_sigma() if gaussian else None)
    cfg = R.RBMConfig(k=k, noise=noise, seed=SEED)
    sums = R.cd_step_sums(df.select("row_id", "features"), p, cfg, SEED, gaussian)
    names = ["dW", "db", "dc", "err"] + (["dsig"] if gaussian else [])
    return _step_means(spark, sums, names)


def q_rbm_cd_step(spark, sf):
    return _cd_step_query(spark, _emb(spark, sf), False)


def q_cd_k(spark, sf):
    return _cd_step_query(spark, _emb(spark, sf), False, k=2)


def q_gaussian_rbm_cd_step(spark, sf):
    return _cd_step_query(spark, _em(spark, sf), True)


def q_gaussian_rbm_sigma_step(spark, sf):
    W, b, c = FX.em_rbm()
    p = R.RBMParams(W=W, b=b, c=c, sigma=FX.em_sigma())
    cfg = R.RBMConfig(momentum=0.1, alpha=0.05, seed=SEED, noise="normal")
    sums = R.cd_step_sums(_em(spark, sf).select("row_id", "features"), p, cfg, SEED, True)
    q, _ = R.apply_cd_update(p, sums, cfg, True)
    return params_df(spark, [("sigma", q.sigma), ("v_inv_sigma", q.v_inv_sigma)])


def q_rbm_fit(spark, sf):
    W, b, c = FX.em_rbm()
    fit = R.rbm_fit(_emb(spark, sf), init=R.RBMParams(W=W, b=b, c=c), epochs=1, n_batches=2, momentum=0.5, alpha=0.1, seed=SEED)
    p = fit.params
    return params_df(spark, [("W", p.W), ("b", p.b), ("c", p.c), ("err", np.array([e for _, e in fit.history]))])


def q_gaussian_rbm_fit(spark, sf):
    W, b, c = FX.em_rbm()
    init = R.RBMParams(W=W, b=b, c=c, sigma=FX.em_sigma())
    fit = R.gaussian_rbm_fit(_em(spark, sf), init=init, epochs=2, momentum=0.1, alpha=0.05, seed=SEED)
    p = fit.params
    return params_df(spark, [("W", p.W), ("b", p.b), ("c", p.c), ("sigma", p.sigma),
                             ("err", np.array([e for _, e in fit.history]))])


def q_rbm_hidden(spark, sf):
    W, b, c = FX.em_rbm()
    return _slots(R.rbm_hidden(_em(spark, sf), R.RBMParams(W=W, b=b, c=c)), ["hidden"], 4)


def q_rbm_reconstruct(spark, sf):
    W, b, c = FX.em_rbm()
    df = R.rbm_reconstruct(_em(spark, sf), R.RBMParams(W=W, b=b, c=c, sigma=FX.em_sigma()))
    total = F.aggregate("reconstruction", F.lit(0.0), lambda acc, v: acc + v)
    return df.select("row_id", round6(total).alias("total"), *(round6(F.col("reconstruction")[i]).alias(f"r{i}") for i in (0, 31, 63)))


def _fixed_dbn():
    (W1, b1, c1), (W2, b2, c2) = FX.em_dbn()
    return D.DBNModel((FX.EM_WIDTH, 6, 4), [R.RBMParams(W=W1, b=b1, c=c1, sigma=FX.em_sigma()), R.RBMParams(W=W2, b=b2, c=c2)])


def q_dbn_pretrain(spark, sf):
    (W1, b1, c1), (W2, b2, c2) = FX.em_dbn()
    init = [R.RBMParams(W=W1, b=b1, c=c1, sigma=np.ones(FX.EM_WIDTH)), R.RBMParams(W=W2, b=b2, c=c2)]
    model = D.dbn_pretrain(_em(spark, sf), (FX.EM_WIDTH, 6, 4), epochs=1, momentum=0.01, alpha=0.05, seed=SEED, init=init)
    items = []
    for l, p in enumerate(model.layers):
        items += [(f"W{l}", p.W), (f"b{l}", p.b), (f"c{l}", p.c)]
    items.append(("sigma", model.sigma))
    return params_df(spark, items)


def q_score_unfolded(spark, sf):
    pred = D.score_unfolded(_em(spark, sf), _fixed_dbn(), output_size=10, output="sigm", seed=SEED)
    return _vectors(pred, [("predict_label", 10)])


def q_dbn_transform(spark, sf):
    return _slots(D.dbn_transform(_em(spark, sf), _fixed_dbn()), ["top"], 4)


# ============================================================================ G: network

def q_sparse_features(spark, sf):
    """B2, B3, B6 as sparse vectors: keyed rows of the well table's codes, as what they hold and where."""
    df = wells.wide_samples(spark, sf)
    held = F.zip_with(F.col("features.indices"), F.col("features.values"), lambda i, v: F.struct(i.alias("i"), v.alias("v")))
    code = F.filter(held, lambda s: s["v"].isin(0.5, 1.0) & (s["i"] < 4))  # the first column is a code of four slots
    return df.select("row_id", F.col("features.size").alias("width"), F.array_join(F.transform(code, lambda s: F.concat(s["i"].cast("string"), F.lit(":"), (s["v"] * 2).cast("int").cast("string"))), ",").alias("first_code"),
                     round4(F.aggregate(F.filter(held, lambda s: s["v"].isNotNull()), F.lit(0.0), lambda acc, s: acc + s["v"] * (s["i"] + 1))).alias("checksum"))


WELL_CFG = N.NNConfig(sizes=(FX.WELL_WIDTH, 4, 3), activation="sigm", output="sigm", noise=0.2, sparsity=0.1, sparsity_target=0.1, seed=SEED)


def q_nn_gradient_sparse(spark, sf):
    """G2, G3, C3 on sparse samples of all columns of the well table."""
    g = N.nn_gradient(wells.wide_samples(spark, sf), FX.well_weights(), WELL_CFG)
    return params_df(spark, [("g0", g["grads"][0]), ("g1", g["grads"][1]), ("loss", np.array(g["loss"])), ("p1", g["p"][1])])


def q_nn_predict_sparse(spark, sf):
    pred = N.nn_predict(wells.wide_samples(spark, sf), FX.well_weights(), WELL_CFG)
    return pred.select("row_id", *(round6(F.col(c)[i]).alias(f"{c}{i}") for c in ("predict_label", "error") for i in range(3)))


def q_gaussian_rbm_cd_step_sparse(spark, sf):
    """F5 on sparse samples of all columns of the well table."""
    W, b, c, s = FX.well_rbm()
    p = R.RBMParams(W=W, b=b, c=c, sigma=s)
    sums = R.cd_step_sums(wells.wide_samples(spark, sf).select("row_id", "features"), p, R.RBMConfig(noise="none", seed=SEED), SEED, True)
    return _step_means(spark, sums, ["dW", "db", "dc", "err", "dsig"])


LI_CFG = N.NNConfig(sizes=FX.LI_SIZES, activation="sigm", output="sigm", learning_rate=2.0, momentum=0.5)


def q_nn_forward(spark, sf):
    fw = N.nn_forward(_numbered_samples(spark, sf), FX.li_weights(), LI_CFG)
    return _vectors(fw, [("a1", 4), ("a2", 3), ("error", 3)])


def _grad_df(spark, g, tag):
    items = [(f"{tag}g{l}", w) for l, w in enumerate(g["grads"])] + [(f"{tag}loss", np.array(g["loss"]))]
    return params_df(spark, items)


def q_nn_gradient(spark, sf):
    li = I.lineitem_samples(spark, sf)
    g1 = N.nn_gradient(li, FX.li_weights(), LI_CFG)
    cfg2 = N.NNConfig(sizes=FX.LI_SIZES, activation="tanh_opt", output="linear")
    g2 = N.nn_gradient(li, FX.li_weights(), cfg2)
    return _grad_df(spark, g1, "sigm_").unionByName(_grad_df(spark, g2, "tanh_"))


def q_nn_sparsity_penalty(spark, sf):
    li = I.lineitem_samples(spark, sf)
    cfg = N.NNConfig(sizes=FX.LI_SIZES, activation="sigm", output="sigm", sparsity=0.1, sparsity_target=0.05)
    g = N.nn_gradient(li, FX.li_weights(), cfg)
    return _grad_df(spark, g, "").unionByName(params_df(spark, [("p1", g["p"][1])]))


def q_nn_step(spark, sf):
    li = I.lineitem_samples(spark, sf)
    W0 = FX.li_weights()
    g = N.nn_gradient(li, W0, LI_CFG)
    W, vW = N.apply_grads(W0, [np.zeros_like(w) for w in W0], g["grads"], LI_CFG, LI_CFG.learning_rate)
    return params_df(spark, [("W0", W[0]), ("W1", W[1]), ("vW0", vW[0]), ("vW1", vW[1])])


EM_FIT_VARIANTS = {
    "nn_fit": dict(cfg={}, epochs=1, n_batches=2, validation=0.0),
    "nn_fit_l2": dict(cfg={"l2": 0.05}, epochs=2, n_batches=1, validation=0.0),
    "nn_fit_momentum": dict(cfg={"momentum": 0.9}, epochs=2, n_batches=1, validation=0.0),
    "nn_fit_lr_schedule": dict(cfg={"scaling_learning_rate": 0.5}, epochs=2, n_batches=1, validation=0.0),
    "nn_fit_sparsity": dict(cfg={"sparsity": 0.2, "sparsity_target": 0.1}, epochs=2, n_batches=1, validation=0.0),
    "nn_fit_noise": dict(cfg={"noise": 0.2}, epochs=2, n_batches=1, validation=0.0),
    "nn_fit_dropout": dict(cfg={"dropout": 0.3}, epochs=2, n_batches=1, validation=0.0),
    "nn_fit_validation": dict(cfg={}, epochs=2, n_batches=1, validation=0.3),
    "nn_fit_validation_batches": dict(cfg={}, epochs=2, n_batches=2, validation=0.3),
}


def em_cfg(**kw) -> N.NNConfig:
    base = dict(sizes=FX.EM_SIZES, activation="sigm", output="sigm", learning_rate=1.0, momentum=0.5, seed=SEED)
    base.update(kw)
    return N.NNConfig(**base)


def _nn_fit_query(name):
    spec = EM_FIT_VARIANTS[name]

    def q(spark, sf):
        em = _em(spark, sf)
        cfg = em_cfg(**spec["cfg"])
        fit = N.nn_fit(em, cfg, epochs=spec["epochs"], n_batches=spec["n_batches"], validation=spec["validation"], init_weights_=FX.em_weights())
        W = fit.model.weights
        items = [("W0", W[0]), ("W1", W[1]), ("train_error", np.array([h[1] for h in fit.history])),
                 ("val_error", np.array([h[2] for h in fit.history]))]
        return params_df(spark, items)
    q.__name__ = f"q_{name}"
    return q


def q_nn_evaluate(spark, sf):
    li = I.lineitem_samples(spark, sf)
    cfg = N.NNConfig(sizes=FX.LI_SIZES, activation="sigm", output="sigm", dropout=0.2)
    loss = N.nn_evaluate(li, FX.li_weights(), cfg)
    return spark.createDataFrame([(rnd(loss),)], "loss double")


def _li_pred(spark, sf):
    return N.nn_predict(I.lineitem_samples(spark, sf), FX.li_weights(), LI_CFG)


def q_nn_predict(spark, sf):
    """All rows of lineitem, which has no key: the rows as they are."""
    pred = _li_pred(spark, sf)
    return pred.select(*(round6(F.col(c)[i]).alias(f"{c}{i}") for c in ("predict_label", "error") for i in range(3)))


def q_nn_loss(spark, sf):
    return N.nn_loss(_li_pred(spark, sf), 3).select(round6("loss").alias("loss"))


def q_dbn_finetune(spark, sf):
    em = _em(spark, sf)
    (W1, b1, c1), _ = FX.em_dbn()
    W2, b2, c2 = FX.fixed((10, 6), 61, 0.5), FX.fixed((6,), 62, 0.1), FX.fixed((10,), 63, 0.1)
    init = [R.RBMParams(W=W1, b=b1, c=c1, sigma=np.ones(FX.EM_WIDTH)), R.RBMParams(W=W2, b=b2, c=c2)]
    model = D.dbn_pretrain(em, (FX.EM_WIDTH, 6, 10), epochs=1, momentum=0.01, alpha=0.05, seed=SEED, init=init)
    fit = D.dbn_finetune(em, model, epochs=1, seed=SEED, learning_rate=1.0, momentum=0.5)
    W = fit.model.weights
    return params_df(spark, [("W0", W[0]), ("W1", W[1]), ("train_error", np.array([h[1] for h in fit.history]))])


# ============================================================================ H: evaluation

def q_threshold_labels(spark, sf):
    th = H.threshold_labels(_li_pred(spark, sf), width=3)
    return th.groupBy(*(F.col("predicted")[i].alias(f"predicted{i}") for i in range(3))).agg(F.count(F.lit(1)).cast("long").alias("n"))


def q_label_hit_rate(spark, sf):
    return H.label_hit_rate(_li_pred(spark, sf), width=3).select(round6("hit_rate").alias("hit_rate"))


def q_score_written(spark, sf):
    """G7, G8, H1, H2 in one pass: the written predictions by their labels, beside what was observed of all rows."""
    path = scratch_path(spark, "scores")
    got = H.write_judged(_li_pred(spark, sf), path, width=3)
    kept = spark.read.parquet(path).groupBy(*(F.col("predicted")[i].alias(f"predicted{i}") for i in range(3))).agg(F.count(F.lit(1)).alias("n"))
    return kept.select("*", *(F.lit(rnd(got[k])).alias(k) for k in ("loss", "hit_rate")), F.lit(got["n"]).cast("long").alias("rows"))


def q_prepare_wide_table(spark, sf):
    """Keyed rows of the whole prepared well table: vectors as digits (twice the slot value), numbers rounded."""
    df = wells.prepared_wells(spark, sf)
    cells = []
    for j, c in enumerate(roles.COLUMNS):
        if c in roles.TEXT_COLUMNS and c != "井号":
            cells.append(F.array_join(F.transform(c, lambda v: (v * 2).cast("int").cast("string")), "").alias(f"c{j}"))
        elif c != "井号":
            cells.append(round6(F.col(f"`{c}`")).alias(f"c{j}"))
    return df.select("row_id", *cells)


def dbn_end_to_end(spark, sf, *, epochs_pretrain: int = 1, epochs_finetune: int = 2, n_batches: int = 3, hidden: int = 8):
    """H3: prepare -> extract -> pretrain -> unfold -> fine-tune -> predict -> loss -> hit rate.

    Target and 14 features of the 41-column well table (text categories, phrases, blank and missing cells) go
    through ``prepare_table`` with their roles, which writes the typed cells once and observes their statistics
    (A4, B8), and are picked by name (B6); then the DBN [14, hidden, 3] is pretrained, unfolded, fine-tuned (sigm / sigm) and
    every row scored. The number of jobs depends on epochs and batches, not on the rows.
    """
    clean = wells.prepared_wells(spark, sf, [roles.EXAMPLE_TARGET, *roles.EXAMPLE_FEATURES])
    samples = P.select_features(clean, roles.EXAMPLE_TARGET, roles.EXAMPLE_FEATURES, row_id="row_id")
    return _trained_and_scored(samples, len(roles.EXAMPLE_FEATURES), len(roles.ONE_HOT[roles.EXAMPLE_TARGET]), epochs_pretrain, epochs_finetune, n_batches, hidden)


def _trained_and_scored(samples, width, w, epochs_pretrain, epochs_finetune, n_batches, hidden):
    model = D.dbn_pretrain(samples, (width, hidden, w), epochs=epochs_pretrain, n_batches=n_batches, momentum=0.01, alpha=0.01, seed=SEED)
    fit = D.dbn_finetune(samples, model, epochs=epochs_finetune, n_batches=n_batches, seed=SEED)
    # predictions are written once; loss (G8) and hit rate (H2) are observed meanwhile
    got = H.write_judged(fit.model.predict(samples), scratch_path(samples.sparkSession, "scores"), width=w)
    return samples.sparkSession.createDataFrame([(rnd(got["loss"]), rnd(got["hit_rate"]), got["n"])], "loss double, hit_rate double, n long")


def q_dbn_end_to_end(spark, sf):
    return dbn_end_to_end(spark, sf)


def q_events_dbn_end_to_end(spark, sf):
    """H3 on the event samples: pretrain [3, 8, 5], unfold, fine-tune, score every row."""
    return _trained_and_scored(I.event_samples(spark, sf), 3, len(I.EVENT_TYPES), 1, 2, 3, 8)


QUERIES = {
    "read_raw_table": q_read_raw_table,
    "read_quoted_table": q_read_quoted_table,
    "read_clean_table": q_read_clean_table,
    "parse_numeric_rows": q_parse_numeric_rows,
    "write_clean_table": q_write_clean_table,
    "training_history": q_training_history,
    "training_run": q_training_run,
    "preview_rows": q_preview_rows,
    "concat_datasets": q_concat_datasets,
    "blank_to_null": q_blank_to_null,
    "one_hot_encode": q_one_hot_encode,
    "multi_hot_encode": q_multi_hot_encode,
    "encode_passthrough": q_encode_passthrough,
    "profile_columns": q_profile_columns,
    "select_features": q_select_features,
    "assemble_samples": q_assemble_samples,
    "column_stats": q_column_stats,
    "impute_mean": q_impute_mean,
    "min_max_scale": q_min_max_scale,
    "impute_category_default": q_impute_category_default,
    "prepare_table": q_prepare_table,
    "prepare_text_table": q_prepare_text_table,
    "write_observed": q_write_observed,
    "number_rows": q_number_rows,
    "split_unkeyed": q_split_unkeyed,
    "draws_unkeyed": q_draws_unkeyed,
    "rbm_fit_unkeyed": q_rbm_fit_unkeyed,
    "nn_fit_unkeyed": q_nn_fit_unkeyed,
    "train_validation_split": q_train_validation_split,
    "mini_batches": q_mini_batches,
    "mask_noise": q_mask_noise,
    "dropout_mask": q_dropout_mask,
    "sample_states": q_sample_states,
    "sigmoid_sample": q_sigmoid_sample,
    "sigmoid_additive_noise": q_sigmoid_additive_noise,
    "activate": q_activate,
    "activation_gradient": q_activation_gradient,
    "dense_layer": q_dense_layer,
    "add_bias": q_add_bias,
    "pca_project": q_pca_project,
    "pca_project_wide": q_pca_project_wide,
    "dense_layer_wide": q_dense_layer_wide,
    "dense_layer_blocked": q_dense_layer_blocked,
    "nn_predict_wide": q_nn_predict_wide,
    "prepare_wide_table": q_prepare_wide_table,
    "count_samples": q_count_samples,
    "vector_mean": q_vector_mean,
    "outer_product_mean": q_outer_product_mean,
    "reconstruction_error": q_reconstruction_error,
    "half_mse": q_half_mse,
    "tuple_sum": q_tuple_sum,
    "mean_activation": q_mean_activation,
    "rbm_cd_binary": q_rbm_cd_binary,
    "rbm_fit_full_batch": q_rbm_fit_full_batch,
    "rbm_cd_step": q_rbm_cd_step,
    "rbm_fit": q_rbm_fit,
    "gaussian_rbm_cd_step": q_gaussian_rbm_cd_step,
    "gaussian_rbm_sigma_step": q_gaussian_rbm_sigma_step,
    "gaussian_rbm_fit": q_gaussian_rbm_fit,
    "cd_k": q_cd_k,
    "rbm_hidden": q_rbm_hidden,
    "rbm_reconstruct": q_rbm_reconstruct,
    "dbn_pretrain": q_dbn_pretrain,
    "score_unfolded": q_score_unfolded,
    "dbn_transform": q_dbn_transform,
    "nn_forward": q_nn_forward,
    "nn_gradient": q_nn_gradient,
    "nn_sparsity_penalty": q_nn_sparsity_penalty,
    "nn_step": q_nn_step,
    "sparse_features": q_sparse_features,
    "nn_gradient_sparse": q_nn_gradient_sparse,
    "nn_predict_sparse": q_nn_predict_sparse,
    "gaussian_rbm_cd_step_sparse": q_gaussian_rbm_cd_step_sparse,
    **{k: _nn_fit_query(k) for k in EM_FIT_VARIANTS},
    "nn_evaluate": q_nn_evaluate,
    "nn_predict": q_nn_predict,
    "nn_loss": q_nn_loss,
    "dbn_finetune": q_dbn_finetune,
    "threshold_labels": q_threshold_labels,
    "label_hit_rate": q_label_hit_rate,
    "score_written": q_score_written,
    "dbn_end_to_end": q_dbn_end_to_end,
    "events_dbn_end_to_end": q_events_dbn_end_to_end,
}
