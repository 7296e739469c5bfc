"""Vectorised word scanning of UTF-8 text inside Arrow batches.

A batch's text column is one byte buffer; words are found with a 256-entry separator table
and hashed from prefix sums, for all documents of a slice at once. Separators are ASCII,
so they never fall inside a multi-byte character. Hashes are 64 bits wide: two different
words (or word sequences) are taken as equal with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19  # text bytes that are scanned at a time

U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64 arrays."""
    x = np.asarray(x, dtype=U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


with np.errstate(over="ignore"):
    _BYTE = mix64((np.arange(256, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15))
_BASE = 0x9E6C63D0876A9A47 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_GRAM = U(0xD6E8FEB86659FD93)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]

#: separator tables: True where a byte is not part of a word
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[0:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True  # after A-Z are lower-cased
NOT_ALNUM[0x41:0x5B] = False

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "fwd" not in _POWERS or len(_POWERS["fwd"]) < n:
        for key, base in (("fwd", _BASE), ("inv", _BASE_INV)):
            p = np.full(max(n, SLICE_BYTES + 4096), base, dtype=U)
            p[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[key] = np.cumprod(p, dtype=U)
    return _POWERS["fwd"], _POWERS["inv"]


def text_slices(col: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, bytes, offsets) for runs of rows of about ``max_bytes``; nulls are empty."""
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    _, off_buf, data_buf = col.buffers()
    off = np.frombuffer(off_buf, dtype=np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def scan_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, heads: tuple[int, ...] = ()) -> tuple:
    """Words of the texts ``data[offsets[i]:offsets[i+1]]``.

    Returns byte starts, byte ends, 64-bit hashes (A-Z read as a-z) and the index of each text's
    first word (one entry more than texts). With ``heads``, a fifth array holds the hashes of each word's
    first so many bytes, a row per head (0 for shorter words). A long text is scanned in pieces cut at separators.
    """
    n = len(data)
    sep = separators[data]
    start = ~sep
    end = start.copy()
    if n:
        inner = offsets[(offsets > 0) & (offsets < n)]
        start[1:] &= sep[:-1]
        start[inner] |= ~sep[inner]
        end[:-1] &= sep[1:]
        end[inner - 1] |= ~sep[inner - 1]
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(end) + 1
    hashes = np.empty(len(starts), dtype=U)
    head = np.zeros((len(heads), len(starts)), dtype=U)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            a = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, a + SLICE_BYTES, side="right")))
            b = ends[j - 1]
            fwd, inv = _powers(int(b - a) + 1)
            acc = np.zeros(b - a + 1, dtype=U)
            np.cumsum(_BYTE_LOWER[data[a:b]] * fwd[:b - a], out=acc[1:])
            s = starts[i:j] - a
            hashes[i:j] = (acc[ends[i:j] - a] - acc[s]) * inv[s]
            for row, n in zip(head, heads):
                long = ends[i:j] - starts[i:j] >= n
                row[i:j][long] = mix64((acc[s[long] + n] - acc[s[long]]) * inv[s[long]] + U(n))
            i = j
    out = starts, ends, mix64(hashes), np.searchsorted(starts, offsets)
    return (*out, head) if heads else out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (length n - k + 1; empty when n < k)."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, dtype=U)
    acc = np.full(m, k, dtype=U)
    with np.errstate(over="ignore"):
        for j in range(k):
            acc = acc * _GRAM + words[j:j + m]
    return mix64(acc)


def shingle_sets(hashes: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct k-word shingles; fewer words count as one shingle, none as the empty set."""
    grams = gram_hashes(hashes, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            yield np.unique(grams[a:b - k + 1])
        else:
            yield gram_hashes(hashes[a:b], b - a) if b > a else grams[:0]
