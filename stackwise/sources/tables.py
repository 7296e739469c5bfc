"""Readers and writers.

Files are read and written by Spark's own data sources (split, parallel); vectors live
in ``array<double>`` columns and take their comma-joined text form only at the text sink.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackwise.operators.prepare import blank_expr
from stackwise.sources.quoted import read_quoted


def read_raw_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, *, multi_line: bool = False) -> DataFrame:
    """A1: quoted CSV with a header -> table of strings (an explicit string schema if given).

    Every line is a row and files are split over tasks; a row with too few or too many cells raises an error.
    With ``multi_line=True`` quoted cells may hold line breaks; files are split all the same, see
    :mod:`stackwise.sources.quoted`.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST")
    if multi_line:
        return read_quoted(spark, path, columns if columns is not None else reader.option("multiLine", True).csv(path).columns)
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    else:
        reader = reader.option("inferSchema", False)
    return reader.csv(path)


def write_raw_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Quoted CSV with a header (the input form of A1); white space at the ends of cells is kept."""
    writer = df.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def parse_vector(col) -> Column:
    """A3: comma-joined numbers -> array<double> (non-numbers become NULL, not an error)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("double"))


def parse_numeric_rows(df: DataFrame, col: str = "value", out: str = "features") -> DataFrame:
    """A3: a comma line of numbers per row -> vector."""
    return df.withColumn(out, parse_vector(col))


def format_vector(col) -> Column:
    """array<double> -> comma-joined numbers; a NULL slot is an empty one, so later slots keep their place."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "")


def write_clean_table(df: DataFrame, path: str, *, vector_cols: Sequence[str] | None = None, mode: str = "overwrite",
                      fmt: str = "text") -> None:
    """A4: the cleaned table, header first, cells separated by one space; vectors comma-joined.

    ``fmt='parquet'`` keeps the vectors typed (the default sink for further Spark work).
    """
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
        return
    vector_cols = set(vector_cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)])
    out = df.select(*[format_vector(c).alias(c) if c in vector_cols else F.col(c).cast("string").alias(c) for c in df.columns])
    out.write.mode(mode).option("sep", " ").option("header", True).option("quote", "\u0000").csv(path)


def read_clean_table(spark: SparkSession, path: str, *, vector_cols: Sequence[str] = (), numeric_cols: Sequence[str] = ()) -> DataFrame:
    """A2: space-separated cleaned table; the reader removes the header line only (Q22)."""
    df = spark.read.option("sep", " ").option("header", True).option("quote", "\u0000").csv(path)
    sel = []
    for c in df.columns:
        if c in vector_cols:
            sel.append(parse_vector(c).alias(c))
        elif c in numeric_cols:
            sel.append(F.col(c).try_cast("double").alias(c))
        else:
            sel.append(F.col(c))
    return df.select(*sel)


def preview_rows(df: DataFrame, n: int = 11, order_by: Sequence[str] | str | None = None) -> DataFrame:
    """The head of the table in a fixed order, blank text shown as NULL."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    out = df.select(*[blank_expr(c).alias(c) if c in text else F.col(c) for c in df.columns])
    if order_by is not None:
        out = out.orderBy(*([order_by] if isinstance(order_by, str) else order_by))
    return out.limit(int(n))


def concat_datasets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Concatenation, duplicates kept (UNION ALL by name)."""
    return a.unionByName(b)


def training_history(spark: SparkSession, rows: Sequence[tuple], stage: str) -> DataFrame:
    """A5: per-epoch errors as a table (stage, epoch, train_error, val_error)."""
    data = []
    for r in rows:
        epoch, tr = int(r[0]), float(r[1])
        va = float(r[2]) if len(r) > 2 and r[2] is not None else None
        data.append((stage, epoch, tr, va))
    return spark.createDataFrame(data, "stage string, epoch int, train_error double, val_error double")


def history_line(history: DataFrame) -> DataFrame:
    """A5 text form: the errors of a stage comma-joined in epoch order (one row per stage)."""
    return history.groupBy("stage").agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("epoch", "train_error"))),
                                     lambda s: s["train_error"].cast("string"))).alias("line"))
