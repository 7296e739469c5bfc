"""Operator 2: token counts by a separator scan over flat, unindexed token files.

A flat token file is a stream of ids in which an end id closes each document; nothing says where documents
begin. Files come as blocks of bytes cut anywhere (rows of file, block, ids). Every block is searched for
the end id in one vector operation and yields a summary: its tokens, its ends, and the gaps between them.
A prefix scan over the summaries (first over runs of blocks, then inside each run) carries the open tail
of earlier blocks into the next, which gives each document's start and count. Blocks are scanned
independently, no task holds a file, and a single huge file spreads over all tasks.

Defined cases: an end id right after another closes an empty document (0 tokens); tokens after the last end are
one document with ``terminated`` false; empty files and tables give no rows; null ids count as an empty block;
null texts become empty documents; repeated rows are documents of their own; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackwise.llm import textscan as TS
from stackwise.llm.shared import ship, written
from stackwise.llm.tokens import encoder

BLOCK_TOKENS = 1 << 16
RUN_BLOCKS = 1024  # blocks that one window partition scans


def token_blocks(docs: DataFrame, tokenizer_path: str, *, text_col: str = "text", end_id: int = 2, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, ids): the flat token stream of every partition of ``docs``, cut into equal blocks of little-endian ids."""
    ship(docs)
    kind = f"<u{width}"
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc, file, block, rest = encoder(tokenizer_path), TaskContext.get().partitionId(), 0, np.zeros(0, dtype=kind)
        schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("ids", pa.binary())])

        def out(ids):
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([ids.tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            for lo, hi, _, _ in TS.text_slices(batch.column(0)):
                raw = enc.encode(batch.column(0).slice(lo, hi - lo).fill_null(""))
                ids = np.frombuffer(b"".join(x + end for x in raw), dtype="<u4")
                if len(ids) and int(ids.max()) >= 1 << (8 * width):
                    raise ValueError(f"an id does not fit into {width} bytes")
                rest = np.concatenate([rest, ids.astype(kind)])
                whole = len(rest) - len(rest) % block_tokens
                for a in range(0, whole, block_tokens):
                    yield out(rest[a:a + block_tokens])
                    block += 1
                rest = rest[whole:]
        if len(rest):
            yield out(rest)

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "file long, block long, ids binary")


def file_blocks(spark: SparkSession, path: str, *, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, ids) of raw token files under ``path``; ``file`` is a hash of the file's path."""
    step = width * block_tokens
    raw = spark.read.format("binaryFile").load(path).filter("length > 0")
    n = F.ceil(F.col("length") / step)
    return raw.select(F.xxhash64("path").alias("file"), "content", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block")).select(
        "file", "block", F.substring("content", (F.col("block") * step + 1).cast("int"), F.lit(step)).alias("ids"))


def _summaries(blocks: DataFrame, end_id: int, width: int) -> DataFrame:
    """Per block: tokens, ends, the open tail, and for each end the start and number of the tokens before it, as far as the block goes back."""
    kind = f"<u{width}"

    def run(batches):
        for b in batches:
            rows = []
            for raw in b.column("ids").to_pylist():
                ids = np.frombuffer(raw or b"", dtype=kind)
                at = np.flatnonzero(ids == end_id)
                gaps = (np.diff(at, prepend=-1) - 1).astype(np.int64)
                rows.append((len(ids), len(at), len(ids) - (int(at[-1]) + 1 if len(at) else 0), (at - gaps).tolist(), gaps.tolist()))
            n, ends, tail, starts, gaps = zip(*rows) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), pa.array(n, pa.int64()), pa.array(ends, pa.int64()), pa.array(tail, pa.int64()),
                                              pa.array(starts, pa.list_(pa.int64())), pa.array(gaps, pa.list_(pa.int64()))], names=["file", "block", "n", "ends", "tail", "starts", "gaps"])

    return blocks.select("file", "block", "ids").mapInArrow(run, "file long, block long, n long, ends long, tail long, starts array<long>, gaps array<long>")


def _scanned(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Exclusive prefix scan over (n, ends, tail): tokens, ends and open tokens before each row of a key."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = rows.withColumn("tokens_before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("ends_before", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    closed = F.when(F.col("ends") > 0, F.col("tokens_before") + F.col("n") - F.col("tail"))  # where the last document ended
    return upto.withColumn("_closed", closed).withColumn("closed_before", F.max("_closed").over(before)).drop("_closed")


def count_tokens(blocks: DataFrame, *, end_id: int = 2, width: int = 2, run_blocks: int = RUN_BLOCKS) -> DataFrame:
    """One row per document: file, doc_index, start (ids before it, ends included), n_tokens (without the end id), terminated."""
    ship(blocks)
    found = written(_summaries(blocks, end_id, width).withColumn("run", F.floor(F.col("block") / run_blocks)), "token-summaries")
    inside = _scanned(found, ["file", "run"], "block")
    runs = found.groupBy("file", "run").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.max(F.struct("block")).alias("_last"),
                                            F.max(F.when(F.col("ends") > 0, F.struct("block", "tail"))).alias("_end"))
    after = found.join(runs.select("file", "run", F.col("_end.block").alias("_at")), ["file", "run"]).groupBy("file", "run").agg(
        F.sum(F.when(F.col("_at").isNull() | (F.col("block") > F.col("_at")), F.col("n")).otherwise(0)).alias("_open"))
    # a run's open tail: the tail of its last block with an end and all blocks behind
    totals = runs.join(after, ["file", "run"]).select("file", "run", "n", "ends", (F.col("_open") + F.coalesce(F.col("_end.tail"), F.lit(0))).alias("tail"))
    outer = _scanned(totals, ["file"], "run").select("file", "run", F.col("tokens_before").alias("run_tokens"), F.col("ends_before").alias("run_ends"), F.col("closed_before").alias("run_closed"))
    placed = inside.join(outer, ["file", "run"]).select(
        "file", F.arrays_zip("starts", "gaps").alias("docs"), (F.col("run_tokens") + F.col("tokens_before")).alias("base"), (F.col("run_ends") + F.col("ends_before")).alias("index"),
        F.coalesce(F.col("closed_before") + F.col("run_tokens"), "run_closed", F.lit(0)).alias("open_from"))
    docs = placed.select("file", "base", "index", "open_from", F.posexplode("docs").alias("i", "doc"))
    first = F.col("i") == 0  # it may reach back into earlier blocks
    closed = docs.select("file", (F.col("index") + F.col("i")).alias("doc_index"), F.when(first, F.col("open_from")).otherwise(F.col("base") + F.col("doc.starts")).alias("start"),
                         (F.col("doc.gaps") + F.when(first, F.col("base") - F.col("open_from")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("terminated"))
    ends = totals.groupBy("file").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    last = _scanned(totals, ["file"], "run").withColumn("_closed", F.when(F.col("ends") > 0, F.col("tokens_before") + F.col("n") - F.col("tail"))).groupBy("file").agg(
        F.coalesce(F.max("_closed"), F.lit(0)).alias("start"))
    left = ends.join(last, "file").filter("n > start").select("file", F.col("ends").alias("doc_index"), "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return closed.union(left)
