"""Vectorised views of Arrow string columns: words, hashes and n-grams in numpy.

A string column arrives as one byte buffer with offsets.  Everything here works on that buffer, in
slices of a few megabytes, so no Python object is made per word.  A text is never cut: a slice ends
between documents, and a document larger than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE_KEYS = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of `[^\x20\x09-\x0D]+`.
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z is lower case.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:128] = True
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    NON_ALNUM[_lo:_hi] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, SLICE_BYTES + 1)
        _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE)]))
        _INVERSES = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE_INV)]))
    return _POWERS, _INVERSES


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES, most: int = 60_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents."""
    data, off = buffers(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + most, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


@dataclass
class Words:
    """Words of a slice, lower case: byte bounds, a 64-bit hash each, and the first word of each document."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(data: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACES, hashed: bool = True) -> Words:
    low = LOWER[data]
    inside = ~separators[low]
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    heads = off[:-1][off[:-1] < len(data)]
    begin[heads] |= inside[heads]
    tails = off[1:][off[1:] > 0] - 1
    finish[tails] |= inside[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    first = np.searchsorted(starts, off)
    if not hashed:
        return Words(low, starts, ends, np.zeros(0, np.uint64), first)
    power, inverse = _powers(len(low))
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_BYTE_KEYS[low] * power[: len(low)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return Words(low, starts, ends, mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), first)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, and each document's first one; a document of fewer words, but not none, has its whole sequence as the one run."""
    h, first = w.hashes, w.first
    counts = w.counts
    keys = _rng_keys(n)
    made = np.maximum(counts - (n - 1), 0)
    short = (counts > 0) & (counts < n)
    total = len(h)
    if total >= n:
        full = np.zeros(total - n + 1, np.uint64)
        for k in range(n):
            full += h[k : total - n + 1 + k] * keys[k]
        at = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(made)[:-1]]), made) + np.arange(made.sum())
        full = mix(full[at])
    else:
        full = np.zeros(0, np.uint64)
    if not short.any():
        return full, np.concatenate([[0], np.cumsum(made)])
    sums = np.zeros(total + 1, np.uint64)
    place = np.arange(total) - np.repeat(first[:-1], counts)
    np.cumsum(h * keys[np.minimum(place, n - 1)], out=sums[1:])
    whole = mix((sums[first[1:]] - sums[first[:-1]]) ^ (counts.astype(np.uint64) << np.uint64(56)))
    all_made = made + short
    out = np.empty(all_made.sum(), np.uint64)
    ends = np.concatenate([[0], np.cumsum(all_made)])
    is_short = np.repeat(short, all_made)
    out[~is_short] = full
    out[is_short] = whole[short]
    return out, ends


def _rng_keys(n: int) -> np.ndarray:
    return np.random.default_rng(977 + n).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def unique_per_doc(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, and the n + 1 bounds."""
    counts = np.diff(ends)
    docs = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(values)
    v, d = values[order], docs[order]
    order = np.argsort(d, kind="stable")
    v, d = v[order], d[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return v[keep], np.concatenate([[0], np.cumsum(np.bincount(d[keep], minlength=len(counts)))]).astype(np.int64)
