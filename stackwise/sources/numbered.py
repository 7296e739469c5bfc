"""Row numbers for tables without a key.

Files do not change once they are written, so a row's file and its position there name it for good. The number
of a row is the count of rows in the files before its own (by name) plus its position: 0 to n - 1 without a gap, the
same however a reader splits or a shuffle moves the rows, and different for rows that are equal.

The scan that counts reads no column. The table of files is as long as the list that the driver's file index holds; it
is broadcast up to ``BROADCAST_FILES`` and joined by a shuffle beyond. Other input is written once first.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackwise.session import release, scratch_path

BROADCAST_FILES = 100_000


def _unused(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def numbered_files(scan: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``scan`` (Parquet files as ``spark.read.parquet`` gives them) with the number of every row in front."""
    if row_id in scan.columns:
        raise ValueError(f"the table already has a column {row_id!r}")
    file, at, start = (_unused(scan, c) for c in ("_file", "_at", "_start"))
    placed = scan.select(F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at), *(F.col(f"`{c}`") for c in scan.columns))
    before = F.sum("n").over(Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1))
    files = placed.groupBy(file).agg(F.count(F.lit(1)).alias("n")).select(file, F.coalesce(before, F.lit(0)).cast("long").alias(start))
    if len(scan.inputFiles()) <= BROADCAST_FILES:
        files = F.broadcast(files)
    return placed.join(files, file).select((F.col(start) + F.col(at)).alias(row_id), *(F.col(f"`{c}`") for c in scan.columns))


def number_rows(df: DataFrame, path: str, row_id: str = "row_id") -> DataFrame:
    """Any table, written once to ``path`` and read back with row numbers."""
    if row_id in df.columns:
        raise ValueError(f"the table already has a column {row_id!r}")
    df.write.parquet(path)
    return numbered_files(df.sparkSession.read.schema(df.schema).parquet(path), row_id)


@contextmanager
def keyed_rows(df: DataFrame, row_id: str = "row_id") -> Iterator[DataFrame]:
    """``df`` itself if it has the key; else its rows, written and numbered until the end of the context."""
    if row_id in df.columns:
        yield df
        return
    path = scratch_path(df.sparkSession, "numbered-rows")
    try:
        yield number_rows(df, path, row_id)
    finally:
        release(df.sparkSession, path)
