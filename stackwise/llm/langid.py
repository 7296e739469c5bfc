"""Operator 7: language identification by Bayesian evidence fusion.

1. *Text.* The languages are those of the documents, by one grouped count. Byte trigrams of all documents of each
   language, hashed into a fixed number of classes, give a likelihood per language; a page's tag-free text is
   scored by it, tempered because neighbouring trigrams are not independent. How well the languages together usually
   explain a document is measured too, and a page that they explain far worse has an unknown language.
2. *Declared markup language.* How often a page of a language declares each language is counted over all
   pages (weighted by the text posteriors) and smoothed towards mostly true declarations.
3. *Address.* Languages per host are counted the same way and smoothed towards the host's address suffix, which is
   smoothed towards all pages (hierarchical Dirichlet means). A page's own weight is left out of its host's count.
4. *Fusion.* Logarithms of likelihood, declaration and prior add up; a softmax gives posteriors.

Counts are grouped sums over the pages with partial sums in the tasks, so a hot host is a few rows before
any shuffle. Pages are read once, documents twice (model, fit) and their languages once.

Defined cases: null html or text without letters has even likelihoods; a missing, null or unknown declared
language is no evidence; a null or malformed address uses the prior of all pages; documents without a language,
or of one that fewer than 1 in ``1 / LEAST_SHARE`` have, are not learnt; a page of at least ``LEAST_TRIGRAMS`` that fits no language is ``und``
with score 0 and counts for no host; without documents every page is ``und`` with score 0; repeated rows are scored each and counted each; empty tables
give no rows; other columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackwise.llm import textscan as TS
from stackwise.llm.shared import COUNTER_SCHEMA, arrow_batch, counter_rows, merged_counters, ship, written

LEAST_SHARE = 1e-3    # of the documents with a language: bounds the number of languages
UNKNOWN = "und"
LEAST_LEARNT = 1000   # trigrams of a language that count as knowing it, when texts are held against all languages
LEAST_TRIGRAMS = 50   # fewer say nothing about an unknown language
UNUSUAL = 10.0        # so many times less likely than in documents is a trigram of an unknown language
CLASSES = 1 << 16
SMOOTH = 0.5
TEMPER = 0.2          # weight of a trigram's log-likelihood
CERTAIN = 12.0        # the text alone never says more than this log-odds
HOST_WEIGHT = 5.0     # pages that a host's suffix counts for
SUFFIX_WEIGHT = 20.0  # pages that the prior of all pages counts for
DECLARED_TRUE = 0.9   # expected share of true declarations ...
DECLARED_WEIGHT = 20.0  # ... and the pages it counts for


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, class) of the byte trigrams of a slice; A-Z are lower-cased, all that is no letter is a blank, runs of blanks count once."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    low = np.where(((low >= 97) & (low <= 122)) | (low >= 128), low, 32).astype(np.uint32)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32) | (text[1:] != text[:-1])
    low, text = low[keep], text[keep]
    if len(low) < 3:
        return text[:0], low[:0].astype(np.int64)
    code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
    inside = text[:-2] == text[2:]
    return text[:-2][inside], (TS.mix64(code[inside].astype(np.uint64)) % np.uint64(CLASSES)).astype(np.int64)


def document_languages(docs: DataFrame, *, lang_col: str = "lang") -> tuple[str, ...]:
    """Languages that at least ``LEAST_SHARE`` of the documents have, in order; at most ``1 / LEAST_SHARE``."""
    lang = F.trim(F.col(lang_col).cast("string"))
    counts = docs.select(lang.alias("lang")).filter("lang <> ''").groupBy("lang").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return tuple(sorted(r["lang"] for r in counts.filter(F.col("n") >= LEAST_SHARE * total).collect()))


def _numbered(docs: DataFrame, text_col: str, lang_col: str, languages: tuple[str, ...]) -> DataFrame:
    number = F.array_position(F.array(*map(F.lit, languages)).cast("array<string>"), F.trim(F.col(lang_col).cast("string"))) - 1
    return docs.select(number.cast("long").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang >= 0")


def usual_fit(docs: DataFrame, highest: np.ndarray, *, text_col: str = "text", lang_col: str = "lang", languages: tuple[str, ...]) -> float:
    """The mean log-probability of a trigram, in the language that explains it best, below which a text has an unknown language.

    It is the mean over the documents of at least ``LEAST_TRIGRAMS`` less the logarithm of ``UNUSUAL``; one row of sums per task.
    Taking the best language trigram by trigram leaves pages that mix languages alone. Without such documents nothing is unusual.
    """
    if not np.isfinite(highest).all():
        return -np.inf
    sent = docs.sparkSession.sparkContext.broadcast(highest)

    def run(batches):
        sums = np.zeros(2)
        for b in batches:
            for lo, hi, data, offsets in TS.text_slices(b.column(1)):
                text, cls = _trigrams(data, offsets)
                n = np.bincount(text, minlength=hi - lo)
                mean = (np.bincount(text, sent.value[cls], minlength=hi - lo) / np.maximum(n, 1))[n >= LEAST_TRIGRAMS]
                sums += len(mean), mean.sum()
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums], names=["n", "s"])

    r = _numbered(docs, text_col, lang_col, languages).mapInArrow(run, "n double, s double").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    return r["s"] / r["n"] - float(np.log(UNUSUAL)) if r["n"] else -np.inf


def language_model(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", languages: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of every trigram class per language, over all documents of the languages, and in the language of at least
    ``LEAST_LEARNT`` trigrams that explains it best (minus infinity for all where there is none)."""
    ship(docs)

    def run(batches):
        counts = np.zeros(len(languages) * CLASSES, dtype=np.int64)
        for b in batches:
            lang = np.asarray(b.column(0))
            for lo, hi, data, offsets in TS.text_slices(b.column(1)):
                text, cls = _trigrams(data, offsets)
                counts += np.bincount(lang[lo:hi][text] * CLASSES + cls, minlength=len(counts))
        rows = counter_rows(counts)
        if rows:
            yield arrow_batch({"chunk": [c for c, _ in rows], "blob": [x for _, x in rows]}, pa.schema([("chunk", pa.int32()), ("blob", pa.binary())]))

    counts = merged_counters(_numbered(docs, text_col, lang_col, languages).mapInArrow(run, COUNTER_SCHEMA), len(languages) * CLASSES, np.int64).reshape(len(languages), CLASSES).astype(np.float64)
    model = np.log((counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * CLASSES)).astype(np.float32)
    return model, model[counts.sum(axis=1) >= LEAST_LEARNT].max(axis=0, initial=-np.inf)


def page_text(html: Column) -> Column:
    """The text of a page: without scripts, styles, comments, tags and entities."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"<[^>]*>|&[#\w]+;", " ")


def declared_language(html: Column, languages: tuple[str, ...]) -> Column:
    """The language of the html element, where it is one of ``languages``."""
    found = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))
    return F.when(found.isin(*languages), found)


def host_of(url: Column) -> Column:
    """Lower-case host of an address, null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def text_posteriors(pages: DataFrame, model: np.ndarray, highest: np.ndarray, least: float, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", languages: tuple[str, ...]) -> DataFrame:
    """(page_id, host, suffix, declared, logs, p, far): tempered log-likelihoods per language, highest 0, their posteriors (0 for
    unknown languages), and whether no language explains the text."""
    sent = pages.sparkSession.sparkContext.broadcast((model, highest))
    html = F.col(html_col).cast("string")
    host = host_of(F.col(url_col).cast("string"))
    src = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), F.regexp_extract(host, r"([^.]+)\.?$", 1).alias("suffix"),
                       declared_language(html, languages).alias("declared"), page_text(html).alias("text"))

    def run(batches):
        m, best = sent.value
        for b in batches:
            out, n, fit = np.zeros((b.num_rows, len(m))), np.zeros(b.num_rows), np.zeros(b.num_rows)
            for lo, hi, data, offsets in TS.text_slices(b.column(4)):
                text, cls = _trigrams(data, offsets)
                n[lo:hi], fit[lo:hi] = np.bincount(text, minlength=hi - lo), np.bincount(text, best[cls], minlength=hi - lo)
                for j, row in enumerate(m):
                    out[lo:hi, j] = np.bincount(text, row[cls], minlength=hi - lo)
            far = (n >= LEAST_TRIGRAMS) & (fit < least * n)
            out = np.maximum(TEMPER * (out - out.max(axis=1, keepdims=True)), -CERTAIN)
            at = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(m))
            p = np.where(far[:, None], 0.0, _softmax(out)) if b.num_rows else out
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.ListArray.from_arrays(at, pa.array(x.ravel())) for x in (out, p)), pa.array(far)],
                                             names=["page_id", "host", "suffix", "declared", "logs", "p", "far"])

    kind = pages.schema[id_col].dataType.simpleString()
    return src.mapInArrow(run, f"page_id {kind}, host string, suffix string, declared string, logs array<double>, p array<double>, far boolean")


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    """Lists of k numbers as rows; null lists are rows of nan."""
    out = np.full((len(column), k), np.nan)
    held = np.asarray(column.is_valid())
    out[held] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    return out


def _softmax(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _last_best(p: np.ndarray) -> np.ndarray:
    """Index of the highest value of each row; of equal ones the last."""
    return p.shape[1] - 1 - p[:, ::-1].argmax(axis=1)


def identify(pages: DataFrame, docs: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", languages: tuple[str, ...] | None = None) -> DataFrame:
    """Per page: page_id, lang, score (its posterior), text_lang, declared, host. Languages are those of the documents unless given."""
    ship(pages)
    languages = document_languages(docs) if languages is None else languages
    if not languages:
        host = host_of(F.col(url_col).cast("string"))
        return pages.select(F.col(id_col).alias("page_id"), F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(UNKNOWN).alias("text_lang"),
                            F.lit(None).cast("string").alias("declared"), host.alias("host"))
    model, highest = language_model(docs, languages=languages)
    least = usual_fit(docs, highest, languages=languages)
    rows = written(text_posteriors(pages, model, highest, least, id_col=id_col, url_col=url_col, html_col=html_col, languages=languages), "page-evidence")
    k = len(languages)
    sums = lambda of: F.array(*(F.sum(F.col(of)[j]) for j in range(k)))

    hosts = rows.groupBy("host", "suffix").agg(sums("p").alias("h"))
    suffixes = hosts.groupBy("suffix").agg(sums("h").alias("s"))
    every = np.array(suffixes.agg(sums("s").alias("a")).first()["a"], dtype=object)  # one row
    every = np.array([x or 0.0 for x in every], dtype=float)
    overall = (every + 1.0) / ((every.sum() or 1.0) + k)
    counts = {r["declared"]: np.array(r["d"]) for r in rows.filter("declared is not null").groupBy("declared").agg(sums("p").alias("d")).collect()}  # at most one row per language
    spoken = sum(counts.values(), np.zeros(k))
    true = DECLARED_TRUE * np.eye(k) + (1 - DECLARED_TRUE) / max(k - 1, 1) * (1 - np.eye(k))
    said = {d: np.log((counts.get(d, np.zeros(k)) + DECLARED_WEIGHT * true[i]) / (spoken + DECLARED_WEIGHT)) for i, d in enumerate(languages)}

    known = hosts.filter("host is not null").join(suffixes, "suffix").select(F.col("host").alias("_host"), "h", "s")
    near = rows.join(known, rows["host"] == known["_host"], "left").select("page_id", "host", "declared", "far", "logs", "p", "h", "s")
    names = np.array([*languages, UNKNOWN], dtype=object)

    def fuse(batches):
        for b in batches:
            if not b.num_rows:
                continue
            far, logs, p, h, s = np.asarray(b.column(3)), *(_matrix(b.column(c), k) for c in range(4, 8))
            alone = np.isnan(h[:, :1])
            suffix = np.where(alone, overall, (s + SUFFIX_WEIGHT * overall) / (s.sum(axis=1, keepdims=True) + SUFFIX_WEIGHT))
            own = np.where(alone, 0.0, np.maximum(h - p, 0.0))
            prior = (own + HOST_WEIGHT * suffix) / (own.sum(axis=1, keepdims=True) + HOST_WEIGHT)
            post = _softmax(logs + np.log(prior) + np.stack([said.get(d, np.zeros(k)) for d in b.column(2).to_pylist()]))
            best, text = _last_best(post), _last_best(logs)
            lang, text = (pa.array(names[np.where(far, k, x)], pa.string()) for x in (best, text))
            score = pa.array(np.where(far, 0.0, post[np.arange(len(post)), best]))
            yield pa.RecordBatch.from_arrays([b.column(0), lang, score, text, b.column(2), b.column(1)], names=["page_id", "lang", "score", "text_lang", "declared", "host"])

    kind = pages.schema[id_col].dataType.simpleString()
    return near.mapInArrow(fuse, f"page_id {kind}, lang string, score double, text_lang string, declared string, host string")
