"""Exact vocabularies of many texts: dictionary-encoded words, and minimal perfect hashes of sharded term lists.

A slice of texts becomes a list of its distinct words and a code for each word in its place, so what follows counts integers.
A minimal perfect hash numbers the terms of a shard from 0 without gaps: a key that is alone at its place in a bit array gets
that bit, those that meet go on to the next, smaller array, and a term's slot is the number of bits set before its own.  Any
other word finds some slot, too, or none; so a slot's own term is stored and compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import LOWER, keyed, mix

#: Runs of ASCII letters, lowered, and of all that is not ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of text that are encoded at once.
ENCODED_BYTES = 4 << 20

#: Places for each key in a bit array, and arrays before a shard's keys are hashed anew.
_ROOM, _MOST_LEVELS, _MOST_SEEDS = 2, 64, 16
_LEVEL = np.uint64(0x9E3779B97F4A7C15)
_SHARD_SEED = 0x5348


@dataclass
class Encoded:
    """The words of some texts: the distinct ones, the code of each in its place, and each text's first (one more at the end)."""

    terms: pa.Array
    codes: np.ndarray
    first: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def encoded(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Encoded:
    """The words, runs of bytes of the class ``kind`` after A-Z are lowered, of the texts data[offsets[i]:offsets[i + 1]]."""
    base = int(offsets[0])
    data, offsets = LOWER[data[base : int(offsets[-1])]], offsets - base
    inside = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(starts)
    # Between two starts all that is inside is one word; a text's end is a start of the next or followed by none.
    place = np.r_[0, np.cumsum(inside)]
    ends = np.r_[place[starts], place[-1]].astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data[inside]))
    found = words.dictionary_encode()
    return Encoded(found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(starts, offsets))


def bytes_of(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    terms = terms.cast(pa.large_string())
    _, ends, data = terms.buffers()
    at = np.frombuffer(ends, np.int64)[terms.offset : terms.offset + len(terms) + 1] if len(terms) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def hashes(terms: pa.Array, seed: int) -> np.ndarray:
    data, at = bytes_of(terms)
    with np.errstate(over="ignore"):
        return keyed(data[at[0] : at[-1]], at[:-1] - at[0], at[1:] - at[0], seed)


def shard_of(terms: pa.Array, shards: np.ndarray | int) -> np.ndarray:
    return ((hashes(terms, _SHARD_SEED) >> np.uint64(8)) % np.asarray(shards).astype(np.uint64)).astype(np.int64)


def _place(keys: np.ndarray, level: int, sizes: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys ^ (np.uint64(level + 1) * _LEVEL)) % np.asarray(sizes).astype(np.uint64)).astype(np.int64)


@dataclass
class Perfect:
    """A shard: the seed of its hashes, the sizes of its bit arrays, their bits, and its terms in the order of their slots."""

    seed: int
    sizes: list[int]
    bits: np.ndarray
    terms: pa.Array


def perfect(terms: pa.Array) -> Perfect:
    """The minimal perfect hash of distinct terms."""
    for seed in range(_MOST_SEEDS):
        keys, sizes, parts, order = hashes(terms, seed), [], [], []
        left = np.arange(len(keys))
        while len(left) and len(sizes) < _MOST_LEVELS:
            size = -(-_ROOM * len(left) // 64) * 64
            at = _place(keys[left], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            held = alone[at]
            order.append(left[held][np.argsort(at[held])])
            sizes.append(size)
            parts.append(alone)
            left = left[~held]
        if not len(left):
            bits = np.packbits(np.concatenate([*parts, np.zeros(0, bool)]), bitorder="little")
            return Perfect(seed, sizes, bits, terms.take(pa.array(np.concatenate([*order, np.zeros(0, np.int64)]))))
    raise ValueError("terms of a shard are not distinct")


class Slots:
    """The slots of many shards, one after another in the order given; ``first`` has each shard's first slot, and one more."""

    def __init__(self, shards: list[Perfect]):
        self.first = np.r_[0, np.cumsum([len(s.terms) for s in shards])].astype(np.int64)
        self.seeds = np.array([s.seed for s in shards], np.int64)
        levels = max((len(s.sizes) for s in shards), default=0)
        self.sizes = np.zeros((levels, len(shards)), np.int64)
        self.starts = np.zeros((levels, len(shards)), np.int64)
        at = 0
        for k, s in enumerate(shards):
            for level, size in enumerate(s.sizes):
                self.sizes[level, k], self.starts[level, k] = size, at
                at += size
        packed = np.concatenate([*(s.bits for s in shards), np.zeros(8, np.uint8)])
        self.blocks = packed[: len(packed) // 8 * 8].view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.blocks))].astype(np.int64)
        self.terms = pa.concat_arrays([s.terms for s in shards]) if shards else pa.array([], pa.large_string())

    def find(self, shard: np.ndarray, terms: pa.Array) -> np.ndarray:
        """The slot of each term in its shard's; -1 for a term that the shard does not have."""
        out = np.full(len(terms), -1, np.int64)
        if not len(terms) or not len(self.seeds):
            return out
        keys = hashes(terms, 0)
        for seed in np.unique(self.seeds[shard]).tolist():
            if seed:
                other = np.flatnonzero(self.seeds[shard] == seed)
                keys[other] = hashes(terms.take(pa.array(other)), seed)
        left = np.arange(len(keys))
        for level in range(len(self.sizes)):
            left = left[self.sizes[level, shard[left]] > 0]
            at = self.starts[level, shard[left]] + _place(keys[left], level, self.sizes[level, shard[left]])
            block, bit = at >> 6, (at & 63).astype(np.uint64)
            is_set = (self.blocks[block] >> bit) & np.uint64(1) == 1
            below = self.blocks[block] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[is_set]] = (self.before[block] + np.bitwise_count(below))[is_set]
            left = left[~is_set]
        found = np.flatnonzero(out >= 0)
        own = pc.equal(self.terms.take(pa.array(out[found])), terms.take(pa.array(found)).cast(pa.large_string())).to_numpy(zero_copy_only=False)
        out[found[~own]] = -1
        return out
