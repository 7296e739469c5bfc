"""Token ids of texts by a public tokenizer file, with a bounded word cache per Python worker.

The tokenizer drops white space and splits at it, so a text's ids are the ids of its pieces between
blanks, tabs and line breaks. Arrow splits the texts, numbers their distinct pieces and takes the marks behind a word apart from
it; a text's ids are gathered from one array with the ids of every distinct word and mark. These are cached as bytes
(unsigned 32-bit little-endian). New ones are encoded together: alphabetic words many in one call, cut at
tokens that end a word, everything else as pieces of one batch.
"""

from __future__ import annotations

import string
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_WORDS = 1 << 18  # words in a generation of the cache; of two, the one before gives what is met again to the new one
JOINED = 200           # words that are encoded in one call
TOGETHER = 10_000      # other pieces that are encoded in one call
GATHERED = 1 << 18     # pieces whose ids are gathered at once
WORD_END = "</w>"
_MARKS = string.punctuation.replace("'", "")  # an apostrophe may begin a token of its own ('s)
_LOWERED_TO_MARK = "\u0130"  # the one letter whose lower case ends with a mark

_ENCODERS: dict[str, "WordEncoder"] = {}


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def encoder(path: str) -> "WordEncoder":
    """The worker's encoder for a tokenizer file; it lives as long as the Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class WordEncoder:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already use every core
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        vocab = self._tok.get_vocab()
        self._ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self._ends[[i for s, i in vocab.items() if s.endswith(WORD_END)]] = True
        self._cache: dict[str, bytes] = {"": b""}
        self._before: dict[str, bytes] = {}

    def _one(self, piece: str) -> bytes:
        return array("I", self._tok.encode(piece, add_special_tokens=False).ids).tobytes()

    def _words(self, words: list[str]) -> None:
        """Alphabetic words, JOINED at a time."""
        groups = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
        for group, enc in zip(groups, self._tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(enc.ids, dtype="<u4")
            cuts = ((np.flatnonzero(self._ends[ids]) + 1) * 4).tolist()
            if len(cuts) != len(group):  # lower-casing made a mark out of a letter
                self._cache.update((w, self._one(w)) for w in group)
                continue
            raw, at = ids.tobytes(), 0
            for w, cut in zip(group, cuts):
                self._cache[w] = raw[at:cut]
                at = cut

    def _unknown(self, pieces: Iterable[str]) -> list[str]:
        """Pieces that neither generation knows; those of the one before come over."""
        old = self._before
        missing = [p for p in pieces if p not in self._cache]
        self._cache.update((p, old[p]) for p in missing if p in old)
        return [p for p in missing if p not in old] if old else missing

    def _others(self, pieces: list[str]) -> None:
        """Pieces of any characters, TOGETHER at a time."""
        for at in range(0, len(pieces), TOGETHER):
            some = pieces[at:at + TOGETHER]
            self._cache.update((p, array("I", e.ids).tobytes()) for p, e in zip(some, self._tok.encode_batch_fast(some, add_special_tokens=False)))

    def _learn(self, pieces: list[str]) -> None:
        new = self._unknown(pieces)
        self._words([p for p in new if p.isalpha()])
        self._others([p for p in new if not p.isalpha()])

    def _parts(self, pieces: pa.Array) -> tuple[list[str], np.ndarray]:
        """Distinct words and marks of the pieces, and which two of them (the last one is empty) each piece is made of."""
        stem = pc.utf8_rtrim(pieces, _MARKS)
        stem = pc.if_else(pc.and_(pc.utf8_is_alpha(stem), pc.invert(pc.ends_with(stem, _LOWERED_TO_MARK))), stem, pieces)
        cut = np.flatnonzero(pc.not_equal(stem, pieces).to_numpy(zero_copy_only=False))  # marks behind a word are tokens of their own
        marks = [p[len(s):] for p, s in zip(_strings(pieces.take(pa.array(cut))), _strings(stem.take(pa.array(cut))))]
        coded = pc.if_else(pc.string_is_ascii(stem), pc.ascii_lower(stem), stem).dictionary_encode()
        parts = _strings(coded.dictionary)
        number = {m: len(parts) + i for i, m in enumerate(dict.fromkeys(marks))}
        parts += [*number, ""]
        pairs = np.full((len(pieces), 2), len(parts) - 1, dtype=np.int64)
        pairs[:, 0] = coded.indices.to_numpy()
        pairs[cut, 1] = np.fromiter(map(number.__getitem__, marks), dtype=np.int64, count=len(cut))
        return parts, pairs

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without special tokens."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\n", " "), "\t", " "), " ")
        ends = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        at = coded.indices.to_numpy()
        parts, pairs = self._parts(coded.dictionary)
        if len(self._cache) > CACHE_WORDS:
            self._before, self._cache = self._cache, {"": b""}
        raw = list(map(self._cache.get, parts))
        missing = [p for p, r in zip(parts, raw) if r is None]
        if missing:
            self._learn(missing)
            raw = list(map(self._cache.__getitem__, parts))
        known = np.frombuffer(b"".join(raw), dtype="<u4")
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // 4
        first = np.cumsum(sizes) - sizes
        after = np.concatenate([[0], np.cumsum(sizes[pairs].sum(axis=1)[at])])  # ids before each piece of the texts
        ids = np.empty(after[-1], dtype="<u4")
        for lo in range(0, len(at), GATHERED):
            hi = min(lo + GATHERED, len(at))
            some = pairs[at[lo:hi]].ravel()
            n = sizes[some]
            ids[after[lo]:after[hi]] = known[np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(after[hi] - after[lo])]
        cuts = after[ends]
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
