"""Operator 3: packing by minimum bin slack.

Documents are tokenised, end with an end id, and are cut into full windows and a remainder. The
remainders of a block of documents are a multiset of lengths. Each window takes the longest
remainder, then a bitset subset-sum program over the multiset finds which lengths fill the rest
closest to capacity, and back-tracking gives how many of each. Where no multiset fills the window
exactly, one more remainder is cut to close it. So every window is full; what is left at
the end of a block (less than a window) goes to the next block of the task, and at the end of
a task into windows whose sizes are powers of two, which need no padding.

Blocks are formed inside the partitions of the input: no shuffle, memory bounded by a block (plus one
document), and a lost task repeats alone. Sequence ids are ``partition << 33 | number``.

Defined cases: null and empty texts are one piece that holds the end id; repeated rows and ids are
packed each; texts of any length are cut; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackwise.llm import textscan as TS
from stackwise.llm.shared import ship
from stackwise.llm.tokens import encoder

WINDOW = 4096
BLOCK_TOKENS = 1 << 20
SLICE_BYTES = 1 << 20  # texts that are tokenised at once


def fill_window(lengths: dict[int, int], capacity: int) -> tuple[dict[int, int], int]:
    """Counts of lengths whose sum comes closest to ``capacity`` from below, and that sum.

    ``lengths`` maps a length to how many pieces have it. Bit s of ``reach`` tells that the sum s can be made.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted(lengths, reverse=True):
        left, take = min(lengths[length], capacity // length), 1
        while left > 0:  # 1, 2, 4, ... pieces at a time cover every count
            k = min(take, left)
            steps.append((reach, length, k))
            reach |= (reach << (length * k)) & mask
            left -= k
            take *= 2
        if reach >> capacity & 1:
            break
    best = at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for before, length, k in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= length * k
    return used, best


class _Packer:
    """Pieces waiting for a window: by length, stacks of (document, start)."""

    def __init__(self, window: int, base: int):
        self.window, self.next_id = window, base
        self.waiting: dict[int, list] = {}
        self.tokens = 0
        self.out: list[tuple] = []  # document, start, length, sequence, offset

    def add(self, doc, n: int) -> None:
        full = n - n % self.window
        for start in range(0, full, self.window):
            self.out.append((doc, start, self.window, self.next_id, 0))
            self.next_id += 1
        if n > full:
            self._wait(doc, full, n - full)

    def _wait(self, doc, start: int, n: int) -> None:
        self.waiting.setdefault(n, []).append((doc, start))
        self.tokens += n

    def _take(self, n: int) -> tuple:
        stack = self.waiting[n]
        piece = stack.pop()
        if not stack:
            del self.waiting[n]
        self.tokens -= n
        return piece

    def _window(self, size: int) -> None:
        """One sequence of exactly ``size`` tokens; at least as many must wait."""
        pieces = []
        longest = max(self.waiting)
        if longest >= size:
            doc, start = self._take(longest)
            pieces.append((doc, start, size))
            if longest > size:
                self._wait(doc, start + size, longest - size)
        else:
            pieces.append((*self._take(longest), longest))
            counts = {n: len(s) for n, s in self.waiting.items() if n <= size - longest}
            used, filled = fill_window(counts, size - longest)
            for n, k in used.items():
                pieces += [(*self._take(n), n) for _ in range(k)]
            slack = size - longest - filled
            if slack:  # every waiting piece is longer than the slack
                n = min(self.waiting)
                doc, start = self._take(n)
                pieces.append((doc, start, slack))
                self._wait(doc, start + slack, n - slack)
        at = 0
        for doc, start, n in pieces:
            self.out.append((doc, start, n, self.next_id, at))
            at += n
        self.next_id += 1

    def close_block(self) -> None:
        while self.tokens >= self.window:
            self._window(self.window)

    def close(self) -> None:
        self.close_block()
        while self.tokens:
            self._window(1 << (self.tokens.bit_length() - 1))


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, window: int = WINDOW,
         block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    ship(docs)
    id_type = docs.schema[id_col].dataType
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc = encoder(tokenizer_path)
        packer = _Packer(window, TaskContext.get().partitionId() << 33)
        schema = None
        pending = 0

        def rows():
            out, packer.out = packer.out, []
            cols = [pa.array([d[0] for d, *_ in out], type=schema.field(0).type), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()),
                    pa.array([d[1][4 * s:4 * (s + n)] for d, s, n, _, _ in out], pa.binary()), pa.array([len(d[1]) // 4 for d, *_ in out], pa.int64()),
                    pa.array([x[3] for x in out], pa.int64()), pa.array([x[4] for x in out], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema([("doc_id", batch.schema.field(0).type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
            for lo, hi, _, _ in TS.text_slices(batch.column(1), SLICE_BYTES):
                ids = batch.column(0).slice(lo, hi - lo).to_pylist()
                for doc_id, raw in zip(ids, enc.encode(batch.column(1).slice(lo, hi - lo).fill_null(""))):
                    doc = (doc_id, raw + end)
                    packer.add(doc, len(doc[1]) // 4)
                    pending += len(doc[1]) // 4
                if pending >= block_tokens:
                    packer.close_block()
                    pending = 0
                    yield rows()
        packer.close()
        if packer.out:
            yield rows()

    return src.mapInArrow(run, f"doc_id {id_type.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
