"""Words of whole texts as 64-bit hashes, by array operations over UTF-8 bytes."""

from __future__ import annotations

from functools import cache

import numpy as np

from opalgrid.llm.common import SLICE_BYTES, mix64

_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    low, word = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
    low[65:91] += 32
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        word[a:b] = True
    return low, word


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, _P, np.uint64), np.full(n, _INV, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def lower_bytes(raw: np.ndarray) -> np.ndarray:
    """Lower case of UTF-8 bytes for ASCII and Latin-1 letters; other scripts stay as they are."""
    out = _tables()[0][raw]
    if len(raw) > 1:
        two = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        out[1:][two] += 32
    return out


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (exclusive) and text number of each word: a run of ASCII letters or digits and of
    bytes beyond ASCII, within one text."""
    if not len(raw):
        return (np.empty(0, np.int64),) * 3
    mask = _tables()[1][raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    start = mask.copy()
    start[1:] &= ~mask[:-1] | first[1:]
    end = mask.copy()
    end[:-1] &= ~mask[1:] | first[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


def hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of lower-cased bytes; the same bytes give the same hash anywhere."""
    out = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        base = s[i]
        j = max(int(np.searchsorted(e, base + 2 * SLICE_BYTES, side="right")), i + 1)
        piece = raw[base : e[j - 1]]
        n = 1 << max(10, int(len(piece)).bit_length())
        up, down = _powers(n)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=sums[1:])
        a, b = s[i:j] - base, e[i:j] - base
        out[i:j] = (sums[b] - sums[a]) * down[a]
        i = j
    return mix64(out)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word, in order."""
    s, e, doc = spans(raw, offsets)
    return hashes(lower_bytes(raw), s, e), doc


def ngrams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every n-gram of words; a text with fewer than n words is one shorter n-gram."""
    if not len(h):
        return h, doc
    padded = np.concatenate([h, np.zeros(n - 1, np.uint64)])
    where = np.concatenate([doc, np.full(n - 1, -1, doc.dtype)])
    total = np.zeros(len(h), np.uint64)
    for k in range(n):
        same = where[k : k + len(h)] == doc
        total = mix64(total * np.uint64(_P) + np.where(same, padded[k : k + len(h)], np.uint64(0)) + np.uint64(k))
    full = where[n - 1 : n - 1 + len(h)] == doc
    first = np.ones(len(h), bool)
    first[1:] = doc[1:] != doc[:-1]
    keep = full | first  # a first word that has no full n-gram stands for a short text
    return total[keep], doc[keep]
