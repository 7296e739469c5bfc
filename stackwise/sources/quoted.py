"""Quoted CSV whose cells hold line breaks, read in many tasks per file.

A line break ends a record only outside quotes, that is after an even number of quote signs. How many come before a line
depends on the whole file, so the reader takes three passes over byte ranges (the splits of Spark's text source):

1. quote signs per block, a grouped count; a prefix sum over the blocks of a file tells which blocks begin inside quotes;
2. lines of a block are joined to records by the running parity that starts there;
3. what a block leaves open at its ends (at most its first and its last lines) goes by file through a window, where
   an unfinished record takes the pieces of the blocks after it.

Blocks are named by file and offset. The table of blocks is as long as the list of splits that the driver plans, and
is sent to the tasks; a block that it does not know (the split size was changed in between) raises an error.
Quote signs stand only around cells and, doubled, inside them (RFC 4180); compressed files are one block.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackwise.session import ship_package

WHOLE, HEAD, TAIL, THROUGH = range(4)  # a record; the end, the beginning, or a middle piece of one
_PIECES = "file string, start long, kind int, header boolean, text string"


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def quoted_blocks(lines: DataFrame, quote: str = '"') -> dict[tuple[str, int], int]:
    """(file, start) -> 1 for the blocks that begin inside quotes, else 0."""
    signs = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    blocks = lines.groupBy("file", "start").agg((F.sum(signs) % 2).alias("odd"))
    before = F.sum("odd").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    return {(r["file"], r["start"]): r["inside"] for r in blocks.select("file", "start", (F.coalesce(before, F.lit(0)) % 2).cast("int").alias("inside")).collect()}


class _Cutter:
    """Records of one block after the other, from the lines in their order."""

    def __init__(self, inside: dict, quote: str):
        self.inside, self.quote = inside, quote
        self.block, self.state, self.first, self.open = None, 0, THROUGH, []
        self.out: list[tuple] = []

    def _emit(self, kind: int, text: str) -> None:
        header = self.block[1] == 0 and kind in (WHOLE, TAIL) and not self.begun
        self.begun = self.begun or kind in (WHOLE, TAIL)
        if not (header and kind == WHOLE):
            self.out.append((*self.block, kind, header, text))

    def enter(self, block: tuple) -> None:
        self.leave()
        if block not in self.inside:
            raise ValueError(f"block {block} was not counted: the split size of the files has changed since the table was opened")
        self.block, self.state, self.open, self.begun = block, self.inside[block], [], False
        self.head = bool(self.state)  # lines until the first even parity end a record of an earlier block

    def leave(self) -> None:
        if self.block is not None and self.open:
            self._emit(THROUGH if self.head else TAIL, "\n".join(self.open))
        self.block, self.open = None, []

    def feed(self, values: pa.Array) -> list[pa.Array]:
        """Whole single lines as arrays; everything else goes to ``out``."""
        after = (self.state + np.cumsum(pc.count_substring(values, self.quote).to_numpy(zero_copy_only=False))) & 1
        before = np.concatenate([[self.state], after[:-1]])
        plain = (before == 0) & (after == 0)
        if self.open or self.head:  # the record that is open ends with the first even parity
            ends = np.flatnonzero(after == 0)
            plain[:ends[0] + 1 if len(ends) else len(plain)] = False
        header = self.block[1] == 0 and not self.begun and not self.open and plain.size and plain[0]
        if header:
            plain[0] = False
            self.begun = True
        for i in np.flatnonzero(~plain)[1 if header else 0:].tolist():
            self.open.append(values[i].as_py())
            if after[i] == 0:
                text, self.open = "\n".join(self.open), []
                kind, self.head = (HEAD if self.head else WHOLE), False
                self._emit(kind, text)
        if len(after):
            self.state = int(after[-1])
        if plain.any():
            self.begun = True
            return [values.filter(pa.array(plain))]
        return []


def _cut(lines: DataFrame, inside: dict, quote: str) -> DataFrame:
    sent = lines.sparkSession.sparkContext.broadcast(inside)
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("header", pa.bool_()), ("text", pa.string())])

    def run(batches):
        cutter = _Cutter(sent.value, quote)

        def rest():
            out, cutter.out = cutter.out, []
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            files, starts = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
            turn = np.flatnonzero(np.diff(files.indices.to_numpy()) | (np.diff(starts) != 0)) + 1
            for lo, hi in zip([0, *turn], [*turn, batch.num_rows]):
                block = (batch.column(1)[int(lo)].as_py(), int(starts[lo]))
                if block != cutter.block:
                    cutter.enter(block)
                for texts in cutter.feed(batch.column(0).slice(lo, hi - lo)):
                    n = len(texts)
                    yield pa.RecordBatch.from_arrays([pa.array([block[0]] * n, pa.string()), pa.array(np.full(n, block[1])), pa.array(np.zeros(n, np.int32)),
                                                      pa.array(np.zeros(n, bool)), texts.cast(pa.string())], schema=schema)
            if cutter.out:
                yield rest()
        cutter.leave()
        if cutter.out:
            yield rest()

    return lines.mapInArrow(run, _PIECES)


def quoted_records(spark: SparkSession, path, quote: str = '"') -> DataFrame:
    """(record): the text of every record but the first of each file (its header), line breaks inside cells kept."""
    ship_package(spark)
    lines = _lines(spark, path)
    pieces = _cut(lines, quoted_blocks(lines, quote), quote)
    rank = F.when(F.col("kind") == TAIL, 1).otherwise(0)
    order = Window.partitionBy("file").orderBy("start", rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    torn = pieces.filter(F.col("kind") != WHOLE).withColumn("number", F.sum(rank).over(order))
    sewn = torn.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "text"))).alias("pieces"), F.max("header").alias("header"))
    record = pieces.filter(F.col("kind") == WHOLE).select(F.col("text").alias("record")).union(
        sewn.filter(~F.col("header")).select(F.array_join(F.col("pieces.text"), "\n").alias("record")))
    return record.select(F.rtrim(F.col("record"), F.lit("\r")).alias("record")).filter("record <> ''")


def read_quoted(spark: SparkSession, path, columns: Sequence[str]) -> DataFrame:
    """Table of strings with the given columns; a record with too few or too many cells raises an error."""
    ddl = ", ".join(f"`{c.replace('`', '``')}` STRING" for c in columns)
    parsed = F.from_csv("record", F.lit(ddl), {"quote": '"', "escape": '"', "mode": "FAILFAST", "lineSep": "\u0001"})
    return quoted_records(spark, path).select(parsed.alias("row")).select("row.*")
