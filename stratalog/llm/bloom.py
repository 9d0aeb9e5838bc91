"""Bloom filters of a string column, made by Spark and sent to the workers as bytes of a bounded number."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BITS = 1 << 29
BITS_PER_ROW = 16

_PART = 20  # log2 of the bits that are put together at once


def _places(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    import xxhash

    mask = np.uint64(bits - 1)
    h = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def _set(bits: int):
    def run(batches):
        for b in batches:
            at = np.unique(np.concatenate(_places(b.column(0).to_pylist(), bits))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> _PART), pa.array(at & ((1 << _PART) - 1))], ["part", "at"])

    return run


def of(words: DataFrame, n: int, max_bits: int = MAX_BITS) -> bytes:
    """The filter of ``words``, one string column of ``n`` rows without nulls; at most ``max_bits`` (a power of two) / 8 bytes.

    Beyond ``max_bits / BITS_PER_ROW`` rows only its rate of false hits grows.
    """
    bits = min(max_bits, 1 << max(_PART, (BITS_PER_ROW * max(1, n) - 1).bit_length()))
    out = np.zeros(bits // 8, np.uint8)
    at = words.mapInArrow(_set(bits), "part long, at long").select("part", (F.col("at") / 64).cast("int").alias("word"), (F.col("at") % 64).cast("int").alias("bit"))
    longs = at.groupBy("part", "word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("v"))
    for part in longs.groupBy("part").agg(F.collect_list(F.struct("word", "v")).alias("words")).toLocalIterator():
        own = np.frombuffer(out.data, np.int64)[part["part"] << _PART - 6 : (part["part"] + 1) << _PART - 6]
        for word, v in part["words"]:
            own[word] = v
    return out.tobytes()


def maybe(table: bytes, words: list[str]) -> np.ndarray:
    """Whether the filter may have each word; never false for one it was made of."""
    bits = np.frombuffer(table, np.uint8)
    p, q = _places(words, len(bits) * 8)
    return (bits[p >> 3] >> (p & 7) & bits[q >> 3] >> (q & 7) & 1).astype(bool)
