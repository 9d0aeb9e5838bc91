"""Minimal perfect hashing of distinct 64-bit keys.

Keys fall into segments by a hash; each segment is a cascade of bit arrays, built by itself in some task: a key that is
alone at its place of a level sets that bit, the others go on to the next level. A key's index is the number of bits set
before its own over all segments, so n keys get exactly 0 to n-1. Keys that were not built in may get any index
or none; a table of the keys by index tells them apart (``Table.find`` verifies).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Keys of a segment, about, and bits of a level for each key that reaches it.
SEGMENT = 1 << 15
GAMMA = 2

_SCHEMA = "segment int, words array<int>, bits binary, keys binary"


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit integers for each seed (splitmix64's finaliser)."""
    z = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (mix(keys, -1) % np.uint64(segments)).astype(np.int64)


def _places(keys: np.ndarray, level: int, words) -> np.ndarray:
    return (mix(keys, level) % (np.asarray(words, np.uint64) * np.uint64(64))).astype(np.int64)


def cascade(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Words of each level, the bits of all levels, and the keys in the order of their indexes."""
    words, bits, order, level = [], [], [], 0
    while len(keys):
        n = max(1, -(-GAMMA * len(keys) // 64))
        at = _places(keys, level, n)
        alone = np.bincount(at, minlength=n * 64)[at] == 1
        row = np.zeros(n * 64, np.uint8)
        row[at[alone]] = 1
        words.append(n)
        bits.append(np.packbits(row, bitorder="little").view(np.uint64))
        order.append(keys[alone][np.argsort(at[alone])])
        keys, level = keys[~alone], level + 1
    return words, np.concatenate(bits) if bits else np.zeros(0, np.uint64), np.concatenate(order) if order else keys


def _build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    words, bits, order = cascade(np.unique(table.column("key").to_numpy()))
    return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "words": pa.array([words], pa.list_(pa.int32())), "bits": pa.array([bits.tobytes()], pa.binary()), "keys": pa.array([order.tobytes()], pa.binary())})


def _segments(segments: int):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(segment_of(b.column(0).to_numpy(), segments).astype(np.int32)), b.column(0)], ["segment", "key"])

    return run


class Table:
    """The function of a bounded number of keys: what each segment's task made, put together."""

    def __init__(self, segments: int, rows: list):
        levels = max([len(r["words"]) for r in rows], default=0)
        self.segments, self.words = segments, np.zeros((segments, levels), np.int64)
        self.first = np.zeros((segments, levels), np.int64)
        at, bits, keys = 0, [], []
        for r in rows:
            n = np.array(r["words"], np.int64)
            self.words[r["segment"], : len(n)] = n
            self.first[r["segment"], : len(n)] = at + np.cumsum(n) - n
            at += int(n.sum())
            bits.append(np.frombuffer(r["bits"], np.uint64))
            keys.append(np.frombuffer(r["keys"], np.int64))
        self.bits = np.concatenate(bits) if bits else np.zeros(0, np.uint64)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        ones = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, -1 for those that the table was not built of."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        seg = segment_of(keys, self.segments)
        for level in range(self.words.shape[1]):
            left = left[self.words[seg[left], level] > 0]
            if not len(left):
                break
            at = _places(keys[left], level, self.words[seg[left], level])
            word, bit = self.first[seg[left], level] + (at >> 6), (at & 63).astype(np.uint64)
            row = self.bits[word]
            hit = (row >> bit & np.uint64(1)).astype(bool)
            below = row[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[word[hit]] + np.bitwise_count(below).astype(np.int64)
            left = left[~hit]
        known = out >= 0
        out[known] = np.where(self.keys[out[known]] == keys[known], out[known], -1)
        return out


def of(keys: DataFrame, n: int) -> Table:
    """The function of ``keys`` (one long column ``key`` without repeats, about ``n`` rows), about 9 bytes each on the driver."""
    segments = max(1, -(-n // SEGMENT))
    cut = keys.select("key").mapInArrow(_segments(segments), "segment int, key long")
    # ordered by segment, so that equal keys give equal indexes wherever the rows come from
    return Table(segments, cut.groupBy("segment").applyInArrow(_build, _SCHEMA).orderBy("segment").collect())
