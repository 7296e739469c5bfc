"""Operator 11: grouping of spelling variants by reduced-alphabet generation.

1. *Words.* Runs of letters are counted per task and summed; words of at least seven letters that occur twice are
   the vocabulary.
2. *Reduction.* Every letter is hashed to one of eight symbols. A reduced word is a 64-bit polynomial of its symbols, so
   that deleting, replacing or inserting a symbol changes it by a formula.
3. *Generation.* Of each reduced word the full one-edit neighbourhood (and itself, as different letters may share
   a symbol) is generated, about 16 codes a letter instead of the more than 180 of the full alphabet. A fixed-size bit filter of
   the reduced vocabulary spares codes that no word has the shuffle (it decides speed only).
4. *Join and verification.* Codes meet the reduced vocabulary; a pair counts if the words themselves differ by one inserted,
   deleted or replaced code point. Both words of a pair find each other.
5. *Forms.* A word's form is its near word of largest count if that is ten times the word's own. Roots
   follow forms by pointer doubling; counts grow tenfold each step, so five rounds reach every end.

Work is per different word, so frequent words and copies of documents cost nothing after the first sum.

Defined cases: null texts have no words, a null id reads as the empty string; repeated rows count each; runs and
texts of any length are read whole, in pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackwise.llm import textscan as TS
from stackwise.llm.shared import COUNTER_SCHEMA, arrow_batch, counter_rows, merged_counters, ship, written

LEAST_LETTERS = 7
LEAST_COUNT = 2
TIMES = 10             # a form occurs so many times as often
DAMAGED = 31           # one in so many runs loses a letter
SYMBOLS = 8
FILTER_BITS = 1 << 27
HELD_WORDS = 200_000   # words that a task counts before it sends them on
PIECE = 1 << 20        # bytes of text, or codes, at a time

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STOP = re.compile(rb"[\x00-\x60\x7B-\x7F]")
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LETTERS)
_BASE = 0xD1342543DE82EF95
_STEP, _BACK = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
_SYMBOL = (TS.mix64(np.arange(1000, 1256, dtype=np.uint64)) % np.uint64(SYMBOLS)) + np.uint64(1)


def _pieces(data: bytes):
    """A lower-cased text in pieces that end between runs."""
    at = 0
    while at < len(data):
        stop = _STOP.search(data, at + PIECE)
        end = stop.start() if stop else len(data)
        yield data[at:end].decode("utf-8", "replace")
        at = end


def spelled(run: str, prefix: int) -> str:
    """The run as it is counted: one in 31 (by the checksum of id and run) lacks a letter."""
    h = zlib.crc32(run.encode(), prefix)
    return run if h % DAMAGED else run[:h % len(run)] + run[h % len(run) + 1:]


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: words of at least seven letters of all texts."""
    ship(docs)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def sent(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for piece in _pieces(text.as_buffer().to_pybytes().translate(_LOWER)):
                    for word, n in Counter(_RUN.findall(piece)).items():
                        counts[spelled(word, prefix)] += n
                    if len(counts) >= HELD_WORDS:
                        yield sent(counts)
                        counts.clear()
        if counts:
            yield sent(counts)

    src = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.char_length("word") >= LEAST_LETTERS)


def _by_length(words: list[str]):
    """(indices, symbols as a matrix) of words of one length, as many as fit a piece."""
    raw = [w.encode("latin-1") for w in words]
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(raw):
        groups.setdefault(len(w), []).append(i)
    for length, rows in groups.items():
        m = max(1, PIECE // (2 * SYMBOLS * length))
        for lo in range(0, len(rows), m):
            at = np.array(rows[lo:lo + m])
            yield at, _SYMBOL[np.frombuffer(b"".join(raw[i] for i in at), np.uint8)].reshape(len(at), length)


def _sums(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and the polynomials of all prefixes (one column more than symbols)."""
    n = symbols.shape[1]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _STEP)]), dtype=np.uint64)
        prefix = np.zeros((len(symbols), n + 1), np.uint64)
        np.cumsum(symbols * power[:n], axis=1, out=prefix[:, 1:])
    return power, prefix


def reduced_codes(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for at, symbols in _by_length(words):
        out[at] = TS.mix64(_sums(symbols)[1][:, -1])
    return out


def neighbourhoods(words: list[str]):
    """(indices of words, codes): each reduced word itself and every reduced word one edit away, once each."""
    for at, s in _by_length(words):
        power, prefix = _sums(s)
        n = s.shape[1]
        whole = prefix[:, -1:]
        yield at, TS.mix64(whole[:, 0])
        wide = max(1, PIECE // (2 * SYMBOLS * len(at)))
        for lo in range(0, n + 1, wide):
            with np.errstate(over="ignore"):
                hi = min(lo + wide, n)
                here, before, after = s[:, lo:hi], prefix[:, lo:hi], whole - prefix[:, lo + 1:hi + 1]
                first = np.ones(here.shape, bool)  # deleting any symbol of a run of equal ones gives the same
                first[:, 1 if lo == 0 else 0:] = s[:, max(lo, 1):hi] != s[:, max(lo, 1) - 1:hi - 1]
                yield at[np.nonzero(first)[0]], TS.mix64((before + after * _BACK)[first])
                rest = whole - before
                for symbol in np.arange(1, SYMBOLS + 1, dtype=np.uint64):
                    other = here != symbol
                    rows = at[np.nonzero(other)[0]]
                    yield rows, TS.mix64((whole + (symbol - here) * power[lo:hi])[other])
                    yield rows, TS.mix64((before + symbol * power[lo:hi] + rest * _STEP)[other])  # inserted before another symbol
                    if lo + wide > n:
                        yield at, TS.mix64(whole[:, 0] + symbol * power[n])


def _bits(codes: DataFrame) -> np.ndarray:
    schema = pa.schema([("chunk", pa.int32()), ("blob", pa.binary())])

    def run(batches):
        bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        for b in batches:
            at = np.asarray(b.column(0)).view(np.uint64) % np.uint64(FILTER_BITS)
            np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        filled = counter_rows(bits)
        if filled:
            yield arrow_batch({"chunk": [c for c, _ in filled], "blob": [x for _, x in filled]}, schema)

    return merged_counters(codes.mapInArrow(run, COUNTER_SCHEMA), FILTER_BITS // 8, np.uint8, "or")


def _gathered(batches, rows: int = 8192):
    """Batches of at least so many rows, so that a word's few hundred codes are made for many words at once."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def reduced_vocabulary(counts: DataFrame) -> DataFrame:
    """code, word, n: the words of ``counts`` (word, n) with the codes of their reduced forms, written."""
    schema = pa.schema([("code", pa.int64()), ("word", pa.string()), ("n", pa.int64())])

    def reduce(batches):
        for b in batches:
            code = pa.array(reduced_codes(b.column(0).to_pylist()).view(np.int64))
            yield pa.RecordBatch.from_arrays([code, b.column(0), b.column(1)], schema=schema)

    return written(counts.select("word", "n").mapInArrow(reduce, "code long, word string, n long"), "vocabulary")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, other, m: every pair of words of a reduced vocabulary one edit apart, from both sides; m is the other's count."""
    known = vocabulary.sparkSession.sparkContext.broadcast(_bits(vocabulary.select("code")))
    schema = pa.schema([("code", pa.int64()), ("word", pa.string())])

    def generate(batches):
        bits = known.value
        for b in _gathered(batches):
            words, codes = [], []
            for at, code in neighbourhoods(b.column(0).to_pylist()):
                slot = code % np.uint64(FILTER_BITS)
                hit = np.flatnonzero((bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
                words.append(at[hit])
                codes.append(code[hit].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes)), b.column(0).take(pa.array(np.concatenate(words)))], schema=schema)

    codes = vocabulary.select("word").mapInArrow(generate, "code long, word string")
    met = codes.join(vocabulary.select("code", F.col("word").alias("other"), F.col("n").alias("m")), "code")
    return met.filter((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1)).select("word", "other", "m")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms that follow one another. A round doubles the steps taken; it is run only while a root has a form."""
    at = forms.select("word", F.col("form").alias("root"))
    ends = forms.select(F.col("word").alias("root"))
    while not at.join(ends, "root", "left_semi").isEmpty():
        ahead = at.select(F.col("word").alias("via"), F.col("root").alias("next"))
        at = written(at.join(ahead, F.col("root") == F.col("via"), "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return at


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of at least seven letters and two occurrences."""
    vocabulary = reduced_vocabulary(word_counts(docs, id_col=id_col, text_col=text_col).filter(F.col("n") >= LEAST_COUNT))
    best = F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best")
    near = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best)
    clear = -F.col("best.less") >= TIMES * F.col("n")
    words = written(vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                                 F.when(clear, F.col("best.other")).alias("form"), F.when(clear, -F.col("best.less")).alias("form_n")), "spellings")
    roots = _roots(words.filter("form IS NOT NULL"))
    return words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
