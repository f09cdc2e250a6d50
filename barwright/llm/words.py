"""Words, word hashes and n-gram hashes of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow batch.

Lower-casing covers A-Z only; words are runs of bytes other than space, tab, newline, vertical tab, form feed and
carriage return. The hash of a byte range comes from one running sum over the bytes: with powers of an odd base,
`(H[end] - H[start]) * base**-start` depends on the range's bytes alone (arithmetic modulo 2**64).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
SLICE_BYTES = 1 << 19
#: odd multipliers, one for each place in an n-gram
PLACE = np.array([(0xD6E8FEB86659FD93 * (2 * k + 1) ** 3 + 0x2545F4914F6CDD1C * k) & (2**64 - 1) | 1 for k in range(64)], U)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; kept for the next call."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(max(n, SLICE_BYTES + 1), base, U)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a hash over the whole word; one to one."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other and the offsets where each begins; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `limit` bytes, so that working arrays stay small.

    A single longer text makes a slice of its own.
    """
    data, at = text_bytes(texts)
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words:
    """The words of consecutive texts: `start`, `end` (byte positions), `doc` (row in the slice), `hash`."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        n = len(data)
        low = _LOWER[data]
        full = ~_SPACE[data]
        first, last = full.copy(), full.copy()
        first[1:] &= ~full[:-1]
        last[:-1] &= ~full[1:]
        filled = at[:-1] < at[1:]
        begin, stop = at[:-1][filled], at[1:][filled] - 1
        first[begin] = full[begin]
        last[stop] = full[stop]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.count = np.diff(np.searchsorted(self.start, at))
        self.doc = np.repeat(np.arange(len(at) - 1), self.count)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        up, down = powers(n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum((low.astype(U) + U(1)) * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, first word) of all runs of k words; a text with fewer words has one, of all its words."""
        n = len(self.hash)
        left = self.first[1:][self.doc] - np.arange(n)
        if n >= k:
            whole = np.flatnonzero(left[: n - k + 1] >= k)
            h = np.zeros(n - k + 1, U)
            for j in range(k):
                h += self.hash[j : n - k + 1 + j] * PLACE[j]
            h = h[whole]
        else:
            whole, h = np.zeros(0, np.int64), np.zeros(0, U)
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        if len(short):
            s = self.count[short].astype(U) * PLACE[63]
            for j in range(k - 1):
                has = self.count[short] > j
                s[has] += self.hash[self.first[short[has]] + j] * PLACE[j]
            h, doc = np.concatenate([h, s]), np.concatenate([self.doc[whole], short])
            place = np.concatenate([whole, self.first[short]])
            order = np.argsort(doc, kind="stable")
            return mix(h[order]), doc[order], place[order]
        return mix(h), self.doc[whole], whole


def gram_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word n-grams of each text as (hash, text), ordered by text and hash."""
    h, doc, _ = words.grams(k)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]
