"""Operator 1: quality classifier, a regularised quadratic discriminant.

1. Every text gives a vector of statistics (shares of letters, marks and repeats, word and line shapes),
   each transformed to be nearer to normal: logarithms of sizes, arcsine square roots of shares.
2. The labelled training rows are summed per class into counts, sums and outer products inside the
   tasks; the driver gets one small matrix per task and class.
3. A class covariance is shrunk towards the pooled one and towards its own diagonal, then
   factored once (Cholesky). A score compares the classes' log-densities (Mahalanobis distance by
   forward substitution, log-determinant from the factor's diagonal) and priors; the difference is
   divided by a temperature fitted on the training rows, since the statistics are not quite normal.

The statistics are written once, so texts are read once. Only the text is an input of a score.

Defined cases: null and empty texts are texts without words and get a score; repeated rows are scored
each and train as often as they are labelled; labels of unknown documents and null labels are ignored; with no
training row of one of the classes every score is the share of label 1 (0.5 without any row); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackwise.llm import textscan as TS
from stackwise.llm.shared import ship, written

FEATURES = ("log_words", "word_bytes", "word_bytes_sd", "upper", "digits", "symbols", "exclaims", "dots", "other_marks", "high_bytes", "same_as_last",
            "distinct", "top_word", "repeated_pairs", "repeated_lines", "log_line_words", "short_words", "capitalised")
BINS = 512  # score bins from which the temperature is fitted

_UP, _LOW, _DIG, _SYM, _EXC, _DOT, _MARK, _SPC, _HIGH = range(9)
_KIND = np.full(256, _MARK, dtype=np.uint8)
_KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x30:0x3A], _KIND[0x80:] = _UP, _LOW, _DIG, _HIGH
_KIND[[0x20, *range(9, 14)]] = _SPC
_KIND[np.frombuffer(b"#*$%&|<>", np.uint8)] = _SYM
_KIND[ord("!")] = _EXC
_KIND[np.frombuffer(b".,", np.uint8)] = _DOT


def _share(part, whole):
    return np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1)))


def _repeats(values: np.ndarray) -> int:
    """How many of the values are equal to another of them that is kept."""
    return len(values) - len(np.unique(values))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Transformed statistics of the texts of a slice, one row each."""
    m = len(offsets) - 1
    kind = _KIND[data]
    text = np.repeat(np.arange(m), np.diff(offsets))
    counts = np.bincount(text * 9 + kind, minlength=9 * m).reshape(m, 9).astype(float)
    size = np.diff(offsets).astype(float)
    letters = counts[:, _UP] + counts[:, _LOW] + counts[:, _HIGH]
    starts, ends, words, first = TS.scan_words(data, offsets, TS.SPACES)
    n = np.diff(first).astype(float)
    length = (ends - starts).astype(float)
    of = np.repeat(np.arange(m), np.diff(first))
    mean = np.bincount(of, length, minlength=m) / np.maximum(n, 1)
    var = np.bincount(of, length * length, minlength=m) / np.maximum(n, 1) - mean * mean
    short = np.bincount(of, length <= 3, minlength=m)
    capital = np.bincount(of, (kind[starts] == _UP) if len(starts) else None, minlength=m)
    same = np.zeros(len(words), dtype=bool)
    same[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    after = np.bincount(of, same, minlength=m)
    pairs = TS.gram_hashes(words, 2)
    lines = np.bincount(text, data == 10, minlength=m) + 1
    distinct, top, twice, again = (np.zeros(m) for _ in range(4))
    for i in range(m):
        a, b = int(first[i]), int(first[i + 1])
        if b > a:
            _, times = np.unique(words[a:b], return_counts=True)
            distinct[i], top[i] = len(times), times.max()
            twice[i] = _repeats(pairs[a:b - 1]) if b - a > 1 else 0
            if lines[i] > 1:
                rows = [r for r in data[offsets[i]:offsets[i + 1]].tobytes().split(b"\n") if r.strip()]
                again[i] = len(rows) - len(set(rows))
    return np.stack([np.log1p(n), np.log1p(mean), np.log1p(np.sqrt(np.maximum(var, 0))), _share(counts[:, _UP], letters), _share(counts[:, _DIG], size),
                     _share(counts[:, _SYM], size), _share(counts[:, _EXC], size), _share(counts[:, _DOT], size), _share(counts[:, _MARK], size),
                     _share(counts[:, _HIGH], letters), _share(after, n), np.log1p(distinct) / np.maximum(np.log1p(n), 1e-9), _share(top, n),
                     _share(twice, n - 1), _share(again, lines), np.log1p(n / lines), _share(short, n), _share(capital, n)], axis=1)


def document_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats): the vector of FEATURES of every row."""
    ship(docs)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field(0).type), ("stats", pa.list_(pa.float64()))])
            for lo, hi, data, offsets in TS.text_slices(batch.column(1)):
                x = statistics(data, offsets)
                at = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * len(FEATURES))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], schema=schema)

    return src.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, stats array<double>")


def _matrix(col) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(len(col), len(FEATURES))


class Discriminant:
    """Means and Cholesky factors of two classes; ``score`` gives the share of label 1."""

    def __init__(self, counts, sums, outers, shrink: float = 0.3, diagonal: float = 0.3, floor: float = 1e-4):
        self.counts = np.asarray(counts, dtype=float)
        self.temperature = 1.0
        if (self.counts < 1).any():
            return
        mean = sums / self.counts[:, None]
        cov = outers / self.counts[:, None, None] - mean[:, :, None] * mean[:, None, :]
        pooled = np.average(cov, axis=0, weights=self.counts)
        self.scale = np.sqrt(np.diag(pooled) + 1e-12)
        s = self.scale
        cov, pooled = (c / s[:, None] / s[None, :] for c in (cov, pooled))
        self.mean, self.factor = mean / s, []
        for c in cov:
            c = (1 - shrink) * c + shrink * pooled
            c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + floor * np.eye(len(c))
            low = np.linalg.cholesky(c)
            self.factor.append((np.linalg.inv(low), float(np.log(np.diag(low)).sum())))

    @property
    def prior(self) -> float:
        return float((self.counts[1] + 0.5) / (self.counts.sum() + 1))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, with priors."""
        if (self.counts < 1).any():
            return np.full(len(x), np.log(self.prior) - np.log(1 - self.prior))
        out = []
        for mean, (inverse, log_det), n in zip(self.mean, self.factor, self.counts):
            z = (x / self.scale - mean) @ inverse.T
            out.append(np.log(n) - log_det - 0.5 * (z * z).sum(axis=1))
        return out[1] - out[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x) / self.temperature, -30, 30)))


def _sums(training: DataFrame):
    """Counts, sums and outer products per class over (stats, label); each task sends one row per class."""

    def run(batches):
        d = len(FEATURES)
        acc = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x, y = _matrix(b.column(0)), np.asarray(b.column(1))
            for c in (0, 1):
                z = x[y == c]
                acc[c] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
        for c in (0, 1):
            if acc[c, 0]:
                yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([i for i in [acc[c].tolist()]])], names=["label", "sums"])

    d = len(FEATURES)
    part = training.select("stats", F.col("label").cast("int")).mapInArrow(run, "label long, sums array<double>")
    total = part.select("label", F.posexplode("sums").alias("i", "v")).groupBy("label", "i").agg(F.sum("v").alias("v")).collect()  # 2 * (1 + d + d * d) rows
    acc = np.zeros((2, 1 + d + d * d))
    for r in total:
        acc[r["label"], r["i"]] = r["v"]
    return acc[:, 0], acc[:, 1:1 + d], acc[:, 1 + d:].reshape(2, d, d)


def _temperature(training: DataFrame, model: Discriminant) -> float:
    """The divisor of the margin that makes the training labels likeliest, from a histogram of margins."""

    def run(batches):
        acc = np.zeros(2 * BINS, dtype=np.int64)
        for b in batches:
            at = np.clip((np.arcsinh(model.margin(_matrix(b.column(0)))) + 16) * (BINS / 32), 0, BINS - 1).astype(np.int64)
            acc += np.bincount(at + BINS * np.asarray(b.column(1)), minlength=2 * BINS)
        at = np.flatnonzero(acc)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(acc[at])], names=["bin", "n"])

    rows = training.select("stats", F.col("label").cast("int")).mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()  # 2 * BINS rows
    if not rows:
        return 1.0
    at, n = np.array([r["bin"] for r in rows]), np.array([r["n"] for r in rows], dtype=float)
    margin = np.sinh((at % BINS + 0.5) * (32 / BINS) - 16)
    sign = np.where(at >= BINS, 1.0, -1.0)
    grid = np.exp(np.linspace(np.log(0.25), np.log(64), 161))
    loss = [(n * np.logaddexp(0, -np.clip(sign * margin / t, -700, 700))).sum() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(training: DataFrame, **shrinkage) -> Discriminant:
    """A discriminant from rows (stats, label 0/1)."""
    model = Discriminant(*_sums(training), **shrinkage)
    model.temperature = _temperature(training, model)
    return model


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) for rows (doc_id, stats)."""
    ship(stats)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))))], names=["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(id_col, of: int, remainder: int):
    """True where crc32 of the id as text leaves ``remainder``; a null id is no training row."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of == remainder, F.lit(True))


def labelled(rows: DataFrame, labels: DataFrame, label_col: str, *, id_col: str = "doc_id") -> DataFrame:
    """``rows`` with a 0/1 ``label`` of their id; conflicting or repeated labels of an id count once, by majority (1 on a tie)."""
    one = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("label"))
    return rows.join(one, "doc_id")


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held: int = 2,
                   threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score (share of label 1) and predicted (score >= threshold); held-out labels are never read."""
    stats = written(document_statistics(docs, id_col=id_col, text_col=text_col), "statistics")
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).filter(~held_out("doc_id", folds, held))
    model = fit(labelled(stats, known, "label"))
    out = score(stats, model)
    return out.select("doc_id", held_out("doc_id", folds, held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
