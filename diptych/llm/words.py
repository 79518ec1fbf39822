"""Words and word windows of many texts at once, as arrays over the texts' UTF-8 bytes.

Two word classes are used by the operators of this subpackage:

* ``SPACED``: maximal runs of bytes other than space and U+0009..U+000D;
* ``ALNUM``: maximal runs of ASCII digits, lower-case ASCII letters and non-ASCII code points, after A-Z are lowered.

Both classes are decided by single bytes (every byte of a non-ASCII code point is 0x80 or above), so a text is
tokenised by table lookups.  A word's hash takes in eight bytes a round, each mixed with the key and what came before; a
window's is a polynomial over its words' hashes, from running sums modulo 2**64.  So a batch costs a few passes whatever its
words.  Operators that decide by hashes draw a key for each run (``new_key``): texts can't be written to collide under a key
that their writer does not know.  A null text has no words.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Bytes of text handled at once; the arrays of a slice take about a hundred times as much.
SLICE_BYTES = 1 << 19

_WORD_BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Of the last eight bytes, those that are still in the word.
_HEADS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Runs of more bytes are hashed one by one, as a round for each eight bytes would be of few runs.
_LONG = 512


def new_key() -> int:
    return secrets.randbits(64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, np.uint64(base & _MASK))
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next call, at a rounded size."""
    return _powers(base, max(1 << 19, 1 << (n - 1).bit_length() if n > 1 else 1))[:n]


def keyed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """A 64-bit hash under the key of each run of bytes data[starts[i]:ends[i]]."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), np.dtype("<u8"), buffer=padded, strides=(1,))
    length = ends - starts
    out = mix(np.uint64(key & _MASK) ^ length.astype(np.uint64) * _ODD)
    for k in np.flatnonzero(length > _LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, key=(key & _MASK).to_bytes(8, "little")).digest(), "little")
    at = np.flatnonzero((length > 0) & (length <= _LONG))
    place, left, value = starts[at], length[at], out[at]
    while len(at):
        value = mix((value ^ eight[place] & _HEADS[np.minimum(left, 8)]) * _ODD)
        on = left > 8
        if not on.all():
            out[at[~on]] = value[~on]
            at, place, left, value = at[on], place[on], left[on], value[on]
        place, left = place + 8, left - 8
    return out


@dataclass
class Words:
    """The words of some texts: byte spans, hashes, and the index of each text's first word (one more at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each word: the hash of the n words from there on, and whether they all are of its text."""
        k = len(self.hashes)
        if not k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        last = np.repeat(self.first[1:], self.counts())
        whole = np.arange(k) + n <= last
        sums = np.zeros(k + 1, np.uint64)
        np.cumsum(self.hashes * powers(_WORD_BASE, k), out=sums[1:])
        out = np.zeros(k, np.uint64)
        if k >= n:
            out[: k - n + 1] = mix((sums[n:] - sums[: k - n + 1]) * powers(pow(_WORD_BASE, -1, 1 << 64), k - n + 1))
        return out, whole

    def text(self, i: int, j: int) -> bytes:
        """The bytes from word i up to the end of word j - 1."""
        return self.data[self.starts[i] : self.ends[j - 1]].tobytes() if j > i else b""


def words_of(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = False, key: int = 0) -> Words:
    """The words of the texts data[offsets[i]:offsets[i + 1]], hashed under the key."""
    base = int(offsets[0])
    data = data[base : int(offsets[-1])]
    offsets = offsets - base
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = kind[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    with np.errstate(over="ignore"):
        hashes = keyed(data, starts, ends, key)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes and the offsets of its values; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets and len(column) else np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``most`` bytes together: first row, row after the last, bytes, offsets."""
    data, offsets = text_bytes(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n, i + 65536)
        yield i, j, data, offsets[i : j + 1]
        i = j
