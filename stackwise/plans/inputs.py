"""Sample tables built from the driver's parquet tables (whole tables, no row caps).

Every builder is a lazy projection over one parquet scan, so Catalyst prunes the columns
that are not used and the work grows with the table.

- LI  lineitem: features [l_quantity/50, l_discount*10, l_tax*10, l_extendedprice/105000],
      label one-hot of l_returnflag (A, N, R); lineitem has no unique key, so no row_id.
- EM  embeddings: row_id = vec_id, features = all slots as double,
      label one-hot of ``label`` (0..9); ``binary`` turns features into x > 0.
- EV  events: row_id = event_id, features [value/1000, k/100, (user_id % 100)/100] with
      k the number in ``props``, label one-hot of event_type.
- OR  orders: row_id = o_orderkey, features [o_totalprice/500000, (o_custkey % 1000)/1000],
      label one-hot of o_orderstatus (F, O, P).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwise.functions.vectors import one_hot_lit

RETURNFLAGS = ["A", "N", "R"]
LINESTATUS = ["F", "O"]
ORDERSTATUS = ["F", "O", "P"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
EMBED_LABELS = list(range(10))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def li_feature_cols():
    return [
        (F.col("l_quantity") / 50).alias("f0"),
        (F.col("l_discount") * 10).alias("f1"),
        (F.col("l_tax") * 10).alias("f2"),
        (F.col("l_extendedprice") / 105000).alias("f3"),
    ]


def lineitem_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    f = li_feature_cols()
    return li.select(one_hot_lit(F.col("l_returnflag"), RETURNFLAGS).alias("label"), F.array(*f).alias("features"))


def embedding_samples(spark: SparkSession, sf_dir: str, *, binary: bool = False) -> DataFrame:
    em = table(spark, sf_dir, "embeddings")
    feats = F.col("embedding").cast("array<double>")
    if binary:
        feats = F.transform(feats, lambda x: F.when(x > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return em.select(F.col("vec_id").cast("long").alias("row_id"),
                     one_hot_lit(F.col("label"), EMBED_LABELS).alias("label"),
                     feats.alias("features"))


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    k = F.regexp_extract(F.col("props"), r"([0-9]+)", 1).cast("double")
    feats = F.array((F.col("value") / 1000).alias("x0"), (k / 100).alias("x1"),
                    ((F.col("user_id") % 100) / 100).alias("x2"))
    return ev.select(F.col("event_id").cast("long").alias("row_id"),
                     one_hot_lit(F.col("event_type"), EVENT_TYPES).alias("label"), feats.alias("features"))


def order_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    feats = F.array((F.col("o_totalprice") / 500000), ((F.col("o_custkey") % 1000) / 1000))
    return o.select(F.col("o_orderkey").cast("long").alias("row_id"),
                    one_hot_lit(F.col("o_orderstatus"), ORDERSTATUS).alias("label"), feats.alias("features"))
