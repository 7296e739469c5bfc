"""Operator 8: toxicity by noisy-channel restoration.

1. *Language model.* Character 4-grams (a-z, word boundary, other letter) are counted over all texts; the
   counts have a fixed size and are interpolated over orders 1 to 4.
2. *Restoration.* A word is suspicious if it mixes letters with look-alike signs (``tr4$h``), repeats a
   letter three times or more, holds marks between letters (``id-iot``), or is one of a run of single
   characters (``l o s e r``). It becomes a lattice: every sign stands for one of its letters or itself, a repeat
   for one or two letters, a mark or gap for nothing or a word boundary. Viterbi over the last three
   characters finds the likeliest reading under channel costs and the language model. All other
   words have one reading, themselves.
3. *Scoring.* Restored words and their stems (first 4 to 7 bytes, for inflected forms) fall into a fixed number of
   hash classes. From the labelled training documents, each class gets the lower confidence bound of its log-odds
   of occurring in a toxic document, whatever the class sizes; classes without clear evidence, or with next to no difference, get 0. A word speaks through its strongest class, a
   document's evidence is the sum over the distinct classes that spoke, mapped to a share by a
   logistic curve fitted on the training documents.

Texts are read three times (model, training documents, scores); nothing that grows with the input
reaches the driver.

Defined cases: null and empty texts have no words, evidence 0 and the score of that; repeated rows are
scored each; repeated labels of an id count once by majority, null labels and unknown ids not at
all; without training rows of either class the score is the share of label 1 (0.5 without any); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackwise.llm import textscan as TS
from stackwise.llm.quality import held_out, labelled
from stackwise.llm.shared import COUNTER_SCHEMA, arrow_batch, counter_rows, merged_counters, ship, written

CLASSES = 1 << 22      # hash classes of words
SLICE = 1 << 16        # classes that are weighed at a time
FILTER_BITS = 1 << 26  # filter of labelled ids
SYMBOLS = 28           # boundary, a-z, other
ORDER = 4
STEMS = (4, 5, 6, 7)
SMOOTH = 0.3
CLEAR = 30.0           # likelihood ratio (G) from which a class counts as evidence
BOUND = 2.0            # its weight is the log-odds less so many standard errors
LEAST = 1.5            # log-odds that a class surely has at least; many documents make the slightest difference certain, but not telling
MOST = 40.0            # evidence bins end here
BINS = 400

#: What a sign can stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t"}
#: Marks that can stand between letters.
MARKS = "*.-_~'/\\,:;#%&^="

_SIGN_COST, _SELF_COST, _DROP_COST, _BREAK_COST = log(0.6), log(0.02), log(0.5), log(0.1)
_ONCE, _TWICE, _PAIR_ONCE = log(0.5), log(0.5), log(0.01)

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[0x61:0x7B] = np.arange(1, 27)
_SYMBOL[0x41:0x5B] = np.arange(1, 27)
_SYMBOL[0x80:] = 27
_LETTER = _SYMBOL > 0
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(c) for c in LOOKS_LIKE]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in MARKS]] = True


def _count_grams(data: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> None:
    """Adds the character 4-grams of a slice; what lies before a word or text boundary is not part of a gram."""
    s = np.zeros(len(data) + 3, dtype=np.int64)
    s[3:] = _SYMBOL[data]
    prev = [s[3 - j:len(s) - j].copy() for j in range(1, ORDER)]
    starts = offsets[:-1][offsets[:-1] < len(data)]
    for j in range(ORDER - 1):
        for at in range(j + 1):
            i = starts + at
            prev[j][i[i < len(data)]] = 0
    for j in range(1, ORDER - 1):
        prev[j][prev[j - 1] == 0] = 0
    code = ((prev[2] * SYMBOLS + prev[1]) * SYMBOLS + prev[0]) * SYMBOLS + s[3:]
    keep = (s[3:] > 0) | (prev[0] > 0)
    counts += np.bincount(code[keep], minlength=SYMBOLS ** ORDER)


class CharacterModel:
    """Interpolated log-probability of a character after the three before it."""

    def __init__(self, counts: np.ndarray):
        c4 = counts.reshape((SYMBOLS,) * ORDER).astype(np.float64)
        p = np.full(SYMBOLS, 1 / SYMBOLS)
        for order in range(1, ORDER + 1):
            c = c4.sum(axis=tuple(range(ORDER - order)))
            total = c.sum(axis=-1, keepdims=True)
            kinds = np.maximum((c > 0).sum(axis=-1, keepdims=True), 1)  # Witten-Bell
            p = (c + kinds * p) / (total + kinds)
        self.log_p = np.log(np.maximum(p, 1e-12)).astype(np.float32)

    @staticmethod
    def symbol(c: str) -> int:
        return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0

    def restore(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The likeliest reading of a lattice: a list of slots, each a list of (characters, cost)."""
        log_p, symbol = self.log_p, self.symbol
        states = {(0, 0, 0): (0.0, "")}
        for slot in [*lattice, [(" ", 0.0)]]:
            new: dict[tuple, tuple[float, str]] = {}
            for (a, b, c), (score, text) in states.items():
                for chars, cost in slot:
                    s, t, h = score + cost, text, (a, b, c)
                    for ch in chars:
                        x = symbol(ch)
                        if x == 0 and ch != " ":  # a sign that stays itself
                            h = (0, 0, 0)
                        else:
                            s += float(log_p[h[0], h[1], h[2], x])
                            h = (h[1], h[2], x) if x else (0, 0, 0)
                        t += ch
                    if h not in new or new[h][0] < s:
                        new[h] = (s, t)
            states = new
        return max(states.values())[1].strip()


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Slots of a suspicious token; blanks and marks between single characters are gaps."""
    out = []
    for m in re.finditer(r"(.)\1*", token, re.S):
        c, n = m.group(1), len(m.group())
        if c in LOOKS_LIKE:
            letters = LOOKS_LIKE[c]
            out.append([(x, _SIGN_COST - log(len(letters))) for x in letters] + [(x * 2, _TWICE + _SIGN_COST) for x in letters if n > 1] + [(c * n, _SELF_COST * n)])
        elif c == " " or c in MARKS:
            out.append([("", _DROP_COST), (" ", _BREAK_COST)])
        elif n == 1:
            out.append([(c, 0.0)])
        elif n == 2:
            out.append([(c * 2, 0.0), (c, _PAIR_ONCE)])
        else:
            out.append([(c, _ONCE), (c * 2, _TWICE)])
    return out


def _cores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words without the marks, quotes and brackets around them; a word of nothing else stays as it is."""
    first, last = np.flatnonzero(use), np.flatnonzero(use & (data != ord("!")))
    if not len(last):
        return starts, ends
    head = first[np.minimum(np.searchsorted(first, starts), len(first) - 1)]
    tail = last[np.maximum(np.searchsorted(last, ends) - 1, 0)] + 1
    whole = (head >= starts) & (head < tail) & (tail <= ends)
    return np.where(whole, head, starts), np.where(whole, tail, ends)


def _suspects(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str]]:
    """(text, token) of every suspicious word or run of single characters of a slice."""
    starts, ends, _, first = TS.scan_words(data, offsets, TS.SPACES)
    if not len(starts):
        return []
    letter, sign, mark = _LETTER[data], _SIGN[data], _MARK[data]
    use = letter | sign
    low = data | np.where(letter & (data < 128), 32, 0).astype(np.uint8)
    total = lambda x: (t := np.concatenate([[0], np.cumsum(x, dtype=np.int64)]))[ends] - t[starts]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = letter[:-1], use[1:]
    between = (sign | mark) & before & after  # a letter right before and something to read after
    head, tail = _cores(data, starts, ends, use)
    lead = np.zeros(len(data), bool)
    lead[head] = sign[head]
    lead[:-1] &= letter[1:]
    triple = np.zeros(len(data), bool)
    if len(data) > 2:
        triple[2:] = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & letter[2:] & (data[2:] < 128)
    n_letters = total(letter)
    odd = (n_letters >= 2) & ((total(between) > 0) | (total(lead) > 0) | (total(triple) > 0))
    single = ((tail - head) == 1) & use[head]
    text = np.searchsorted(first, np.arange(len(starts)), side="right") - 1
    out = []
    for i in np.flatnonzero(odd).tolist():
        out.append((int(text[i]), data[starts[i]:ends[i]].tobytes().decode("utf-8", "replace")))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8), [0]])))
    for a, b in edge.reshape(-1, 2).tolist():
        while a < b:  # runs end with their text
            z = min(b, int(first[text[a] + 1]))
            if z - a >= 3:
                out.append((int(text[a]), " ".join(data[starts[i]:ends[i]].tobytes().decode("utf-8", "replace") for i in range(a, z))))
            a = z
    return out


_CORE = re.compile(r"^[^\w@$!|+]+|(?<=\w)([!$@|+])\1+$|[!.,;:?*#%&\-_~'\"()\[\]{}<>/\\^=]+$")


class Restorer:
    """Restored words of suspicious tokens as hash classes, cached per task."""

    KEEP = 200_000

    def __init__(self, model: CharacterModel):
        self.model, self.cache = model, {}

    def text(self, token: str) -> str:
        core = token.lower()
        while (cut := _CORE.sub("", core)) != core:
            core = cut
        return self.model.restore(lattice(core)) if core else ""

    def classes(self, tokens: list[str]) -> list[np.ndarray]:
        """Per token the classes of its restored words and their stems, a column per word."""
        if len(self.cache) > self.KEEP:
            self.cache = {}
        new = [t for t in dict.fromkeys(tokens) if t not in self.cache]
        if new:
            raw = [self.text(t).encode() for t in new]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
            cls, first = _classes(np.frombuffer(b"".join(raw), np.uint8), offsets)
            self.cache.update((t, cls[:, first[i]:first[i + 1]]) for i, t in enumerate(new))
        return [self.cache[t] for t in tokens]


def _classes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the words and their stems (a row each; class 0 where a word has no such stem), first word of each text."""
    _, _, words, first, stems = TS.scan_words(data, offsets, TS.NOT_ALNUM, STEMS)
    all_ = np.vstack([words[None, :], stems])
    return np.where(all_ > 0, 1 + all_ % np.uint64(CLASSES - 1), 0).astype(np.int32), first


def _word_classes(data: np.ndarray, offsets: np.ndarray, restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """(text, classes) of every word and every restored word of a slice."""
    cls, first = _classes(data, offsets)
    text, all_ = [np.repeat(np.arange(len(offsets) - 1), np.diff(first))], [cls]
    odd = _suspects(data, offsets)
    for (t, _), c in zip(odd, restorer.classes([w for _, w in odd])):
        text.append(np.full(c.shape[1], t))
        all_.append(c)
    return np.concatenate(text), np.concatenate(all_, axis=1)


def character_model(docs: DataFrame, text_col: str = "text") -> CharacterModel:
    """Counts over every text of ``docs``."""

    def run(batches):
        counts = np.zeros(SYMBOLS ** ORDER, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in TS.text_slices(batch.column(0)):
                _count_grams(data, offsets, counts)
        rows = counter_rows(counts)
        if rows:
            yield arrow_batch({"chunk": [c for c, _ in rows], "blob": [b for _, b in rows]}, pa.schema([("chunk", pa.int32()), ("blob", pa.binary())]))

    ship(docs)
    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, COUNTER_SCHEMA)
    return CharacterModel(merged_counters(rows, SYMBOLS ** ORDER, np.int64))


def restored_text(docs: DataFrame, model: CharacterModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, restored): lower-case texts in which suspicious tokens are replaced by their likeliest reading."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    ship(docs)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        restorer = Restorer(sent.value)
        for batch in batches:
            out = []
            for lo, hi, data, offsets in TS.text_slices(batch.column(1)):
                texts = [t.lower() if t is not None else None for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                for t, token in _suspects(data, offsets):
                    token = token.lower()
                    texts[t] = re.sub(r"(?<!\S)" + r"\s+".join(map(re.escape, token.split(" "))) + r"(?!\S)", lambda _, x=restorer.text(token): x, texts[t])
                out += texts
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "restored"])

    return src.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, restored string")


def _id_bits(ids: pa.Array) -> np.ndarray:
    text = ids.cast(pa.string()).to_pylist()
    return TS.mix64(np.array([zlib.crc32((t or "").encode()) | len(t or "") << 32 for t in text], dtype=np.uint64)) % np.uint64(FILTER_BITS)


def _id_filter(ids: DataFrame) -> np.ndarray:
    def run(batches):
        bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        for b in batches:
            at = _id_bits(b.column(0)).astype(np.int64)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        rows = counter_rows(bits)
        if rows:
            yield arrow_batch({"chunk": [c for c, _ in rows], "blob": [x for _, x in rows]}, pa.schema([("chunk", pa.int32()), ("blob", pa.binary())]))

    return merged_counters(ids.mapInArrow(run, COUNTER_SCHEMA), FILTER_BITS // 8, np.uint8, "or")


def word_evidence(docs: DataFrame, known: DataFrame, model, *, id_col: str, text_col: str) -> np.ndarray:
    """Log-odds per hash class from documents with a label in ``known`` (doc_id, label); 0 where the evidence is not clear."""
    sc = docs.sparkSession.sparkContext
    wanted = sc.broadcast(_id_filter(known.select("doc_id")))
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def words(batches):
        bits = wanted.value
        restorer = Restorer(model.value)
        for batch in batches:
            at = _id_bits(batch.column(0)).astype(np.int64)
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            schema = pa.schema([("doc_id", batch.schema.field(0).type), ("classes", pa.binary())])
            for lo, hi, data, offsets in TS.text_slices(batch.column(1)):
                text, cls = _word_classes(data, offsets, restorer)
                both = np.unique((text * CLASSES)[None, :] + cls)
                first = np.searchsorted(both, np.arange(hi - lo + 1) * CLASSES)
                raw = (both % CLASSES).astype(np.int32)
                blobs = [zlib.compress(np.diff(raw[a:b], prepend=np.int32(0)).tobytes(), 1) for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(blobs, pa.binary())], schema=schema)

    def counts(batches):
        acc = np.zeros(2 * CLASSES + (1 << 16), dtype=np.int32)  # clean, toxic, documents of each
        for b in batches:
            for blob, y in zip(b.column("classes").to_pylist(), b.column("label").to_pylist()):
                acc[np.cumsum(np.frombuffer(zlib.decompress(blob), dtype=np.int32)) + y * CLASSES] += 1
                acc[2 * CLASSES + y] += 1
        rows = counter_rows(acc)
        if rows:
            yield arrow_batch({"chunk": [c for c, _ in rows], "blob": [x for _, x in rows]}, pa.schema([("chunk", pa.int32()), ("blob", pa.binary())]))

    found = src.mapInArrow(words, f"doc_id {docs.schema[id_col].dataType.simpleString()}, classes binary")
    found = found.hint("merge")  # with few labels too: a broadcast would put both steps in one task, which then holds two Python workers
    acc = merged_counters(labelled(found, known, "label").select("classes", "label").mapInArrow(counts, COUNTER_SCHEMA), 2 * CLASSES + (1 << 16), np.int32)
    wanted.destroy()
    return class_weights(acc)


def class_weights(acc: np.ndarray) -> np.ndarray:
    """Weight per hash class from the counters: clean, toxic, documents of each.

    A slice of classes at a time, so that the driver holds the counters and the weights and no more whole arrays.
    """
    n0, n1 = acc[2 * CLASSES:2 * CLASSES + 2].astype(np.float64)
    weights = np.zeros(CLASSES, dtype=np.float32)
    if not n0 or not n1:
        return weights
    for i in range(0, CLASSES, SLICE):
        clean, toxic = (acc[at:at + SLICE].astype(np.float64) for at in (i, CLASSES + i))
        p0, p1, p = (clean + SMOOTH) / (n0 + 2 * SMOOTH), (toxic + SMOOTH) / (n1 + 2 * SMOOTH), (clean + toxic + SMOOTH) / (n0 + n1 + 2 * SMOOTH)
        gain = 2 * (toxic * np.log(p1 / p) + clean * np.log(p0 / p) + (n1 - toxic) * np.log((1 - p1) / (1 - p)) + (n0 - clean) * np.log((1 - p0) / (1 - p)))
        odds = np.log(p1 / (1 - p1)) - np.log(p0 / (1 - p0))
        error = np.sqrt(1 / (toxic + SMOOTH) + 1 / (n1 - toxic + SMOOTH) + 1 / (clean + SMOOTH) + 1 / (n0 - clean + SMOOTH))
        surely = odds - BOUND * error
        weights[i:i + SLICE] = np.where((gain >= CLEAR) & (surely >= LEAST), surely, 0)
    weights[0] = 0
    return weights


def document_evidence(docs: DataFrame, model, weights, *, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, evidence): summed log-odds of a document's distinct classes."""
    src = docs.select(F.col(id_col).alias("doc_id"), *carry, F.col(text_col).cast("string").alias("text"))

    def run(batches):
        w, restorer = weights.value, Restorer(model.value)
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for lo, hi, data, offsets in TS.text_slices(batch.column(batch.num_columns - 1)):
                text, cls = _word_classes(data, offsets, restorer)
                strongest = cls[np.argmax(w[cls], axis=0), np.arange(cls.shape[1])]
                hit = w[strongest] > 0
                both = np.unique(text[hit] * CLASSES + strongest[hit])
                total[lo:hi] = np.bincount(both // CLASSES, w[both % CLASSES], minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(total)], names=[*batch.schema.names[:-1], "evidence"])

    return src.mapInArrow(run, src.drop("text").schema.add("evidence", "double"))


def _curve(rows: DataFrame) -> tuple[float, float]:
    """Slope and intercept of the logistic curve over evidence, from a histogram of the training documents."""
    at = F.least(F.floor(F.col("evidence") * (BINS / MOST)), F.lit(BINS - 1))
    got = rows.groupBy(at.alias("bin"), "label").agg(F.count("*").alias("n")).collect()  # 2 * BINS rows
    x, y, n = (np.array(v, dtype=float) for v in zip(*((r["bin"] * MOST / BINS, r["label"], r["n"]) for r in got))) if got else ([np.zeros(0)] * 3)
    ones, zeros = float((n * y).sum()), float((n * (1 - y)).sum())
    if not ones or not zeros:
        return 0.0, log((ones + 0.5) / (zeros + 0.5))
    beta = np.array([0.0, log(ones / zeros)])
    z = np.stack([x, np.ones(len(x))], axis=1)
    ridge = np.diag([1e-2, 1e-6])
    for _ in range(60):  # damped Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (n * (y - p)) - ridge @ beta
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(2), grad)
        beta = beta + step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
    return float(max(beta[0], 0.0)), float(beta[1])


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1,
                    threshold: float = 0.7, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, held_out, score (share of label 1), predicted (score >= threshold), evidence and the carried columns; held-out labels are never read."""
    sc = docs.sparkSession.sparkContext
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).filter(~held_out("doc_id", folds, held) & F.col("label").isin(0, 1))
    model = sc.broadcast(character_model(docs, text_col))
    weights = sc.broadcast(word_evidence(docs, known, model, id_col=id_col, text_col=text_col))
    found = written(document_evidence(docs, model, weights, id_col=id_col, text_col=text_col, carry=carry), "evidence")
    model.destroy()
    weights.destroy()
    slope, intercept = _curve(labelled(found, known, "label"))
    score = 1 / (1 + F.exp(-(F.lit(slope) * F.least("evidence", F.lit(MOST)) + F.lit(intercept))))
    return found.select("doc_id", held_out("doc_id", folds, held).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), "evidence", *carry)
