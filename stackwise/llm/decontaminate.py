"""Operator 5: benchmark decontamination by winnowing.

A fingerprint is the smallest hash of K consecutive words in each sliding run of ``span - K + 1`` of
them (the last one on ties). Two texts that share ``span`` words share every hash of the run inside
them, hence its fingerprint at the same place: no shared span is missed. Fingerprints of the documents
pass a fixed-size bit filter of the benchmark's, join the benchmark's by hash, and each hit is extended
word by word to both sides as far as a window that holds the fingerprint can reach. Items shorter
than the span are looked up whole, by the hash of all their words.

The benchmark may be of any size: only its bit filter is broadcast, the fingerprints meet in a join.
Words are equal when their 64-bit hashes are.

Defined cases: null and empty texts and items have no words; an item without words matches nothing; an
item with a null id can mark words but is not listed; repeated items and repeated rows count as they
come (one output row for each document row, item ids listed once); empty tables give empty results or no hits; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackwise.llm import textscan as TS
from stackwise.llm.shared import counter_rows, merged_counters, ship, written

SPAN = 10           # words of a window
K = 5               # words of a fingerprint
FILTER_BITS = 1 << 26

_HIT = pa.schema([("h", pa.int64()), ("pos", pa.int64()), ("len", pa.int32()), ("around", pa.binary())])


def _winnow(words: np.ndarray, first: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints of all texts of a slice."""
    grams = TS.gram_hashes(words, k)
    w = span - k + 1
    m = len(grams) - w + 1
    if m <= 0:
        return np.zeros(0, np.int64), grams[:0]
    last, at = grams[:m].copy(), np.zeros(m, dtype=np.int64)
    for j in range(1, w):  # smallest, the last on ties
        better = grams[j:j + m] <= last
        last[better] = grams[j:j + m][better]
        at[better] = j
    inside = np.ones(m, dtype=bool)
    for b in first[1:-1].tolist():
        inside[max(0, b - span + 1):b] = False
    pos = np.unique((np.arange(m) + at)[inside])
    return pos, grams[pos]


def _around(words: np.ndarray, first: np.ndarray, pos: np.ndarray, span: int, k: int, pad: int) -> np.ndarray:
    """Words that a window with the fingerprint can hold: span - k to the left, the fingerprint, span - k to the right."""
    text = np.searchsorted(first, pos, side="right") - 1
    at = pos[:, None] + np.arange(-(span - k), span)[None, :]
    ok = (at >= first[text][:, None]) & (at < first[text + 1][:, None])
    out = np.full(at.shape, pad, dtype=np.uint64)
    out[ok] = words[at[ok]]
    return out


def _bit(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(FILTER_BITS)).astype(np.int64)


def _benchmark(items: DataFrame, id_col: str, text_col: str, span: int, k: int) -> DataFrame:
    """(h, len, item_id, around) and, as chunk rows, the bit filter."""
    src = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        schema = pa.schema([("h", pa.int64()), ("len", pa.int32()), ("item_id", pa.string()), ("around", pa.binary()), ("chunk", pa.int32()), ("blob", pa.binary())])
        for batch in batches:
            for lo, hi, data, offsets in TS.text_slices(batch.column(1)):
                _, _, words, first = TS.scan_words(data, offsets, TS.NOT_ALNUM)
                ids = batch.column(0).slice(lo, hi - lo).to_pylist()
                pos, h = _winnow(words, first, span, k)
                text = np.searchsorted(first, pos, side="right") - 1
                around = _around(words, first, pos, span, k, 1)
                rows = [(int(a), span, ids[t], c.tobytes()) for a, t, c in zip(h.view(np.int64), text, around)]
                for t in range(hi - lo):
                    n = int(first[t + 1] - first[t])
                    if 0 < n < span:
                        whole = TS.gram_hashes(words[first[t]:first[t + 1]], n)
                        rows.append((int(whole.view(np.int64)[0]), n, ids[t], b""))
                at = _bit(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64))
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
                if rows:
                    cols = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], schema=schema)
        filled = counter_rows(bits)
        if filled:
            m = len(filled)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, f.type) for f in list(schema)[:4]] + [pa.array([c for c, _ in filled], pa.int32()), pa.array([b for _, b in filled], pa.binary())], schema=schema)

    return written(src.mapInArrow(run, "h long, len int, item_id string, around binary, chunk int, blob binary"), "benchmark")


def _scan(docs: DataFrame, id_col: str, text_col: str, span: int, k: int, short: list[int], bits) -> DataFrame:
    """A row per document (row, doc_id, n_words) and a row per hit of the filter (row, h, pos, len, around)."""
    id_type = docs.schema[id_col].dataType
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        filt = bits.value
        row = TaskContext.get().partitionId() << 40
        known = lambda h: (filt[(at := _bit(h)) >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field(0).type), ("row", pa.int64()), ("n_words", pa.int64()), *_HIT])
            for lo, hi, data, offsets in TS.text_slices(batch.column(1)):
                _, _, words, first = TS.scan_words(data, offsets, TS.NOT_ALNUM)
                m = hi - lo
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, m), pa.array(row + np.arange(m)), pa.array(np.diff(first).astype(np.int64)),
                                                  *(pa.nulls(m, f.type) for f in _HIT)], schema=schema)
                found = []
                pos, h = _winnow(words, first, span, k)
                hit = known(h) if len(h) else np.zeros(0, bool)
                pos, h = pos[hit], h[hit]
                found.append((pos, h, np.full(len(pos), span, np.int32), [c.tobytes() for c in _around(words, first, pos, span, k, 0)]))
                for n in short:
                    h = TS.gram_hashes(words, n)
                    if len(h):
                        pos = np.flatnonzero(known(h))
                        text = np.searchsorted(first, pos, side="right") - 1
                        pos = pos[pos + n <= first[text + 1]]
                        found.append((pos, h[pos], np.full(len(pos), n, np.int32), [b""] * len(pos)))
                for pos, h, n, around in found:
                    if len(pos):
                        text = np.searchsorted(first, pos, side="right") - 1
                        yield pa.RecordBatch.from_arrays([pa.nulls(len(pos), schema.field(0).type), pa.array(row + text), pa.nulls(len(pos), pa.int64()),
                                                          pa.array(h.view(np.int64)), pa.array(pos - first[text]), pa.array(n), pa.array(around, pa.binary())], schema=schema)
                row += m

    hits = ", ".join(f"{f.name} {'binary' if f.name == 'around' else 'int' if f.name == 'len' else 'long'}" for f in _HIT)
    return written(src.mapInArrow(run, f"doc_id {id_type.simpleString()}, row long, n_words long, {hits}"), "fingerprints")


def _extended(joined: DataFrame, span: int, k: int) -> DataFrame:
    """Spans of document words that lie in an occurrence of a window: (row, from, to, item_id)."""

    def run(batches):
        side = span - k
        for b in batches:
            n, pos, whole = np.asarray(b.column("len")), np.asarray(b.column("pos")), np.asarray(b.column("len")) < span
            start, stop = pos.copy(), pos + n
            at = np.flatnonzero(~whole)
            if len(at):
                x, y = (np.frombuffer(b"".join(b.column(c).take(pa.array(at)).to_pylist()), dtype=np.uint64).reshape(len(at), span + side) for c in ("around", "item_around"))
                same = x == y
                left = np.cumprod(same[:, :side][:, ::-1], axis=1).sum(axis=1)
                right = np.cumprod(same[:, span:], axis=1).sum(axis=1)
                start[at], stop[at] = pos[at] - left, pos[at] + k + right
                whole[at] = same[:, side:span].all(axis=1) & (left + right + k >= span)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(start), pa.array(stop), b.column("item_id")], names=["row", "from", "to", "item_id"]).filter(pa.array(whole))

    return joined.select("row", "pos", "len", "around", "item_around", "item_id").mapInArrow(run, "row long, from long, to long, item_id string")


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", span: int = SPAN, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (row, doc_id, n_words) numbers the documents, spans (row, from, to, item_id) are the extended hits."""
    if not 1 <= k <= span:
        raise ValueError("k must be between 1 and span")
    ship(docs)
    marks = _benchmark(benchmark, item_col, item_text_col, span, k)
    bits = docs.sparkSession.sparkContext.broadcast(merged_counters(marks.filter("chunk is not null"), FILTER_BITS // 8, np.uint8, "or"))
    items = marks.filter("chunk is null").select("h", F.col("len").alias("item_len"), "item_id", F.col("around").alias("item_around"))
    short = sorted(r[0] for r in items.filter(F.col("item_len") < span).select("item_len").distinct().collect())  # fewer than span values
    scan = _scan(docs, id_col, text_col, span, k, short, bits)
    bits.destroy()
    hits = scan.filter("h is not null").join(items, "h").filter("len = item_len")
    return scan.filter("h is null").select("row", "doc_id", "n_words"), _extended(hits, span, k)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words in an occurrence of a window), item_ids (sorted as strings), contaminated."""
    rows, spans = contaminated_spans(docs, benchmark, **options)
    cover = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
                        lambda acc, s: F.struct((acc["n"] + F.greatest(s["to"] - F.greatest(s["from"], acc["end"]), F.lit(0).cast("long"))).alias("n"),
                                                F.greatest(acc["end"], s["to"]).alias("end")))["n"]
    found = spans.groupBy("row").agg(F.collect_set(F.struct("from", "to")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("item_ids")).select(
        "row", cover.alias("n_hit"), "item_ids")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(found, "row", "left").select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
                                                  (n_hit > 0).alias("contaminated"))
