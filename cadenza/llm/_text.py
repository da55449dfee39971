"""Vectorised word segmentation and hashing over Arrow string columns.

Every routine works on the UTF-8 bytes of a slice of a column at once, so the
cost per word is a few dozen nanoseconds and no Python object is made per word.
Slices are bounded in bytes (`slices`), which bounds the temporary arrays.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step works on (a longer text is a step of its own).
STEP_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of words: digits, lower-case letters and all of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of words: whatever is no blank, tab, line or page break.
NONSPACE = np.ones(256, bool)
NONSPACE[[32, *range(9, 14)]] = False

_STEP = np.uint64(0xD6E8FEB86659FD93)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Two primes below 2**31, a base for each, and the bases' inverses: a word's hash is its polynomial at both.
_FIELDS = tuple((p, b, pow(b, -1, p)) for p, b in ((2147483647, 1160901737), (2147483629, 1822705413)))
_powers: list[tuple[np.ndarray, np.ndarray]] = []
_short: list[np.ndarray] = []


def _geometric(base: int, prime: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo the prime."""
    out, have = np.ones(n, np.uint64), 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
        have += more
    return out


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each field the first n powers of the base and of its inverse."""
    if not _powers or len(_powers[0][0]) < n:
        n = max(n, STEP_BYTES + 1)
        _powers[:] = [(_geometric(b, p, n), _geometric(i, p, n)) for p, b, i in _FIELDS]
    return _powers


def short_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a factor and of its inverse modulo 2**64: enough for pieces of a few bytes."""
    if not _short or len(_short[0]) < n:
        up, down = np.full(max(n, STEP_BYTES + 1), _FACTOR), np.full(max(n, STEP_BYTES + 1), np.uint64(pow(int(_FACTOR), -1, 1 << 64)))
        up[0] = down[0] = 1
        _short[:] = np.cumprod(up), np.cumprod(down)
    return _short[0], _short[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text (one row at least)."""
    ends = offsets(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
        yield lo, min(hi, len(column))
        lo = hi


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one string array in which null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def offsets(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[1], np.int32)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and where each text begins (with a last end)."""
    at = offsets(column)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def release() -> None:
    """Gives freed memory back to the system: workers and the driver live on after a stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def tidy(run: Callable) -> Callable:
    """A function of batches that releases memory when a task is done."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


@dataclass
class Words:
    """Words of consecutive texts: byte ranges, 64-bit hashes, and texts as ranges of words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray  # text i has the words at[i] to at[i + 1]
    hash: np.ndarray

    def text_of(self) -> np.ndarray:
        """The text's number for each word."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def words(column: pa.Array, kind: np.ndarray = ALNUM) -> Words:
    """Words of ASCII-lowered texts: runs of bytes that `kind` marks, never across texts."""
    raw, at = text_bytes(column)
    data = _LOWER[raw]
    inside = kind[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(at), np.int64), np.zeros(0, np.uint64))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = at[:-1][at[:-1] < len(data)]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashed = (end - start).astype(np.uint64) * _STEP
    for (prime, _, _), (up, down), shift in zip(_FIELDS, powers(len(data) + 1), (0, 31), strict=True):
        p = np.uint64(prime)
        terms = (data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]
        if len(data) > STEP_BYTES:  # else the sums stay below 2**60
            terms %= p
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        hashed += (sums[end] - sums[start]) % p * down[start] % p << np.uint64(shift)
    hashed = mix(hashed)
    return Words(data, start, end, np.searchsorted(start, at).astype(np.int64), hashed)


def ngrams(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on; the last n - 1 entries are of shorter rests."""
    total = np.zeros(len(w), np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(min(n, len(w))):
            total[: len(w) - j] += w[j:] * factor
            factor = factor * _FACTOR
    return mix(total + np.uint64(n))


def shingle_sets(w: Words, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each text; a shorter text is one shingle."""
    grams = ngrams(w.hash, n)
    out = []
    for lo, hi in zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True):
        if hi - lo >= n:
            part = np.sort(grams[lo : hi - n + 1])
            keep = np.ones(len(part), bool)
            np.not_equal(part[1:], part[:-1], out=keep[1:])
            out.append(part[keep])
        elif hi > lo:
            out.append(ngrams(w.hash[lo:hi], hi - lo)[:1])
        else:
            out.append(np.zeros(0, np.uint64))
    return out
