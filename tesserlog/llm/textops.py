"""Whole-text word hashing on Arrow buffers, in numpy.

A word is a maximal run of word bytes inside one text. All classes used here are
closed over UTF-8: bytes from 0x80 up are word bytes, so working on bytes equals
working on characters. Texts are cut into segments of at most ``SEGMENT`` bytes at
non-word bytes, which bounds memory for very long texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT, RUN = 1 << 18, 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Non-word bytes: space and 0x09-0x0D.
BLANK_SPLIT = np.ones(256, bool)
BLANK_SPLIT[[32, 9, 10, 11, 12, 13]] = False
#: Word bytes: 0-9, a-z (texts are lower-cased first) and everything from 0x80 up.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_pow = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        more = np.full(max(n, 256), _BASE, np.uint64)
        more[0] = 1
        _pow = np.cumprod(more, dtype=np.uint64)
    return _pow


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column; nulls become empty texts."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _segments(data: np.ndarray, off: np.ndarray, word: np.ndarray):
    """Byte ranges that begin and end at text ends or behind a non-word byte."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SEGMENT, "right")) - 1)
        lo, hi = int(off[i]), int(off[j])
        while hi - lo > 2 * SEGMENT:  # one very long text
            cut, step = lo + SEGMENT, SEGMENT
            while cut < hi:
                gap = np.flatnonzero(~word[_LOWER[data[cut : min(hi, cut + step)]]])
                if len(gap):
                    cut += int(gap[0]) + 1
                    break
                cut += step
            cut = min(cut, hi)
            yield lo, cut, i, j
            lo = cut
        if hi > lo:
            yield lo, hi, i, j
        i = j


def hash_words(data: np.ndarray, off: np.ndarray, word: np.ndarray, spans: bool = False) -> tuple:
    """64-bit hashes of all words in order, and the number of words of each text; with ``spans`` also each word's first byte and length."""
    hashes, counts, begins, sizes = [], np.zeros(len(off) - 1, np.int64), [], []
    for lo, hi, i, j in _segments(data, off, word):
        low = _LOWER[data[lo:hi]]
        is_word = word[low]
        edges = off[i : j + 1]
        edges = edges[(edges > lo) & (edges < hi)] - lo
        before = np.empty_like(is_word)
        before[0] = False
        before[1:] = is_word[:-1]
        before[edges] = False
        starts = np.flatnonzero(is_word & ~before)
        if not len(starts):
            continue
        at = np.flatnonzero(is_word)
        first = np.searchsorted(at, starts)  # where each word begins among the word bytes
        lens = np.diff(np.append(first, len(at)))
        powers = _powers(int(lens.max()))
        place = np.arange(len(at)) - np.repeat(first, lens)
        hashes.append(mix(np.add.reduceat((low[at].astype(np.uint64) + np.uint64(1)) * powers[place], first)))
        if spans:
            begins.append(starts + lo)
            sizes.append(lens)
        owner = np.searchsorted(off[i : j + 1], starts + lo, "right") - 1
        counts[i:j] += np.bincount(owner, minlength=j - i)[: j - i]
    out = (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts
    if spans:
        out += tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begins, sizes))
    return out


def runs(off: np.ndarray, size: int = RUN):
    """(first, last + 1) of consecutive texts of about ``size`` bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def slices(batch: pa.RecordBatch, text_at: int):
    """Parts of a batch with about ``RUN`` bytes of text, so that what is made of them stays small."""
    for i, j in runs(text_buffers(batch.column(text_at))[1]):
        yield batch.slice(i, j - i)
