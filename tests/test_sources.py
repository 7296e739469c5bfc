"""Readers and writers round trip through the shared scratch folder."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from stackwise.plans import inputs as I
from stackwise.session import scratch_path
from stackwise.sources import tables as T


def test_raw_csv_round_trip(spark):
    o = I.table(spark, SF_SMALL, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = scratch_path(spark, "t-raw")
    T.write_raw_table(o, path)
    back = T.read_raw_table(spark, path)
    assert dict(back.dtypes) == {"o_orderkey": "string", "o_orderstatus": "string", "o_totalprice": "string"}
    typed = back.select(F.col("o_orderkey").cast("long"), "o_orderstatus", F.col("o_totalprice").cast("double"))
    assert typed.exceptAll(o).count() == 0 and o.exceptAll(typed).count() == 0


def test_clean_table_round_trip_keeps_header_like_rows(spark):
    df = spark.createDataFrame([("a b", [1.0, 0.5]), ("x", [0.0, 2.0])], "name string, v array<double>")
    df = df.select(F.regexp_replace("name", " ", "_").alias("name"), "v")
    path = scratch_path(spark, "t-clean")
    T.write_clean_table(df, path, vector_cols=["v"])
    back = T.read_clean_table(spark, path, vector_cols=["v"])
    assert sorted((r["name"], tuple(r["v"])) for r in back.collect()) == [("a_b", (1.0, 0.5)), ("x", (0.0, 2.0))]


def test_parse_vector_tolerates_junk(spark):
    df = spark.createDataFrame([("1, 2.5,x",)], "s string")
    assert df.select(T.parse_vector("s")).first()[0] == [1.0, 2.5, None]


def test_preview_and_concat(spark):
    o = I.table(spark, SF_SMALL, "orders").select("o_orderkey", "o_orderstatus")
    head = T.preview_rows(o, 5, "o_orderkey").collect()
    assert [r["o_orderkey"] for r in head] == sorted(r["o_orderkey"] for r in o.collect())[:5]
    assert T.concat_datasets(o, o).count() == 2 * o.count()


def test_history_table_and_line(spark):
    h = T.training_history(spark, [(1, 0.5), (2, 0.25)], "rbm")
    assert T.history_line(h).first()["line"] == "0.5,0.25"


def test_package_is_shipped_to_workers(spark):
    """Python code run inside tasks must not depend on the driver's working directory."""
    from stackwise.session import _SHIPPED, ship_package

    ship_package(spark)
    assert spark.sparkContext.applicationId in _SHIPPED
    ship_package(spark)  # idempotent


def test_row_equal_to_header_is_kept(spark):
    """Q22: only the header line is dropped, not every line that looks like it."""
    df = spark.createDataFrame([("a", "b"), ("x", "y"), ("a", "b")], "a string, b string")
    path = scratch_path(spark, "t-header")
    T.write_clean_table(df, path, vector_cols=[])
    back = T.read_clean_table(spark, path)
    assert sorted(tuple(r) for r in back.collect()) == [("a", "b"), ("a", "b"), ("x", "y")]


def test_cells_with_line_breaks(spark):
    """Quoted line breaks come back whole with ``multi_line``, and never as broken rows without it."""
    df = spark.createDataFrame([('a\nb"', "x"), ("c", "y,z")], "name string, v string")
    path = scratch_path(spark, "t-lines")
    T.write_raw_table(df, path)
    back = T.read_raw_table(spark, path, columns=["name", "v"], multi_line=True)
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())
    with pytest.raises(Exception):
        T.read_raw_table(spark, path, columns=["name", "v"]).collect()


def test_null_slots_keep_their_place(spark):
    """A NULL slot is written as an empty one."""
    df = spark.createDataFrame([(1, [1.0, None, 3.0]), (2, [None, 2.5, None])], "k long, v array<double>")
    path = scratch_path(spark, "t-null-slots")
    T.write_clean_table(df, path, vector_cols=["v"])
    back = T.read_clean_table(spark, path, vector_cols=["v"], numeric_cols=["k"])
    assert sorted((r["k"], r["v"]) for r in back.collect()) == [(1.0, [1.0, None, 3.0]), (2.0, [None, 2.5, None])]
