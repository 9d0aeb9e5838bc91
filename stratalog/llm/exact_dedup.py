"""Exact de-duplication by two-pass Bloom filtering.

Pass 1 puts every row's 64-bit text hash into a blocked Bloom filter whose cells count 0, 1 or 2-and-more.
Each task sends only the cells it has set, and a segment's cells meet in one task. A hash whose cells all
count two or more is *possibly repeated*. Pass 2 tests every row: rows that are certainly unique pass
straight through, the others shuffle by SHA-256 and are counted exactly, so a false positive costs a
little shuffle and never a wrong result.

A filter has at most ``max_filter_bits`` bits (2**30, 128 MB), however large the input. Beyond ``max_filter_bits /
bits_per_row`` rows the hashes are cut into as many ranges as it takes, each with a filter of its own that is made,
broadcast, used and dropped before the next; every row is in one range, so it is read twice whatever their number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import documents, id_type, scratch, ship, small_side, texts, written

SEGMENT_BITS = 22


def _digests(batches):
    for b in batches:
        sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass").lower()) for t in texts(b.column(1))]
        h = np.array([int.from_bytes(s.digest()[:8], "little", signed=True) for s in sha], np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h), pa.array([s.hexdigest() for s in sha], pa.string())], ["id", "h", "sha"])


def _cells(h: np.ndarray, bits: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment and the two cells in it, from disjoint bits of a hash. ``bits``: log2 of a segment's cells."""
    u = h.view(np.uint64)
    seg = ((u * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) % segments
    mask = np.uint64((1 << bits) - 1)
    return seg, (u & mask).astype(np.int64), ((u >> np.uint64(26)) & mask).astype(np.int64)


def _sketch(bits: int, segments: int):
    def run(batches):
        def flush(parts):
            u, n = np.unique(np.concatenate(parts), return_counts=True)
            seg, a, b = _cells(u, bits, segments)
            b = np.where(a == b, -1, b)  # one hash counts once in a cell
            pos = np.concatenate([(seg << bits) | a, (((seg << bits) | b))[b >= 0]])
            cnt = np.concatenate([n, n[b >= 0]])
            cells, inv = np.unique(pos, return_inverse=True)
            total = np.bincount(inv, weights=cnt)
            of = cells >> bits
            cut = np.flatnonzero(np.diff(of, prepend=-1))
            rows = {"seg": [], "once": [], "twice": []}
            for i, j in zip(cut, [*cut[1:], len(cells)]):
                c = (cells[i:j] & ((1 << bits) - 1)).astype(np.uint32)
                rows["seg"].append(int(of[i]))
                rows["once"].append(c.tobytes())
                rows["twice"].append(c[total[i:j] >= 2].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(rows["seg"], pa.int32()), pa.array(rows["once"], pa.binary()), pa.array(rows["twice"], pa.binary())], ["seg", "once", "twice"])

        parts, n = [], 0
        for b in batches:
            if b.num_rows:
                parts.append(b.column(0).to_numpy(zero_copy_only=False).copy())
                n += b.num_rows
            if n >= 1_000_000:
                yield flush(parts)
                parts, n = [], 0
        if parts:
            yield flush(parts)

    return run


def _merge(bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
        for o, t in zip(pdf["once"], pdf["twice"]):
            o, t = np.frombuffer(o, np.uint32), np.frombuffer(t, np.uint32)
            twice[o[once[o]]] = True
            once[o] = True
            twice[t] = True
        return pd.DataFrame({"seg": [int(pdf["seg"].iloc[0])], "bits": [np.packbits(twice, bitorder="little").tobytes()]})

    return run


def _tested(narrow: DataFrame, rows: int, bits_per_row: int, max_filter_bits: int):
    """``narrow`` with ``maybe`` by one filter, and the broadcast to drop after use."""
    m = min(max_filter_bits, max(1 << 18, 1 << (max(1, rows * bits_per_row) - 1).bit_length()))
    segments = min(1 << 16, max(8, m >> SEGMENT_BITS))
    bits = (m // segments).bit_length() - 1
    size = max(1, (1 << bits) // 8)
    sketch = narrow.select("h").mapInArrow(_sketch(bits, segments), "seg int, once binary, twice binary")
    merged = written(sketch.groupBy("seg").applyInPandas(_merge(bits), "seg int, bits binary"), "filter")
    whole = bytearray(size * segments)
    for r in merged.toLocalIterator():
        whole[r["seg"] * size : (r["seg"] + 1) * size] = r["bits"]
    shared = narrow.sparkSession.sparkContext.broadcast(whole)
    names = narrow.columns
    at = names.index("h")

    def test(batches):
        table = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            seg, a, c = _cells(b.column(at).to_numpy(zero_copy_only=False), bits, segments)
            hit = np.ones(b.num_rows, bool)
            for x in (a, c):
                hit &= (table[seg * size + (x >> 3)] >> (x & 7).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit)], [*names, "maybe"])

    return narrow.mapInArrow(test, T.StructType([*narrow.schema.fields, T.StructField("maybe", T.BooleanType())])), shared


def possibly_repeated(narrow: DataFrame, rows: int, bits_per_row: int = 16, max_filter_bits: int = 1 << 30) -> DataFrame:
    """``narrow`` (with a long column ``h``, of ``rows`` rows) plus a boolean ``maybe``: false only for hashes that occur once."""
    ranges = max(1, -(-rows * bits_per_row // max_filter_bits))
    if ranges == 1:
        return _tested(narrow, rows, bits_per_row, max_filter_bits)[0]
    spark = narrow.sparkSession
    # in order of the hash within each file, so that a range reads its pages only
    narrow = written(narrow.sortWithinPartitions("h"), "by_hash")
    path = scratch(spark, "tested")
    schema = None
    for k in range(ranges):
        lo, hi = ((x << 64) // ranges - (1 << 63) for x in (k, k + 1))
        own = narrow.filter((F.col("h") >= lo) & (F.col("h") <= hi - 1))
        got, shared = _tested(own, -(-rows // ranges), bits_per_row, max_filter_bits)
        got.write.mode("append").parquet(path)
        shared.destroy()
        schema = got.schema
    return spark.read.schema(schema).parquet(path)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_filter_bits: int = 1 << 30) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. The largest id of equal
    texts stays; a null id is never larger than another, and a group with null ids alone keeps null. Repeated rows
    (same id, same text) all count in group_size and share ``kept``. An empty table gives an empty result. Other
    columns of ``docs`` are not read and may have any name.
    """
    ship(docs.sparkSession)
    kind = id_type(docs, id_col)
    two = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    narrow = written(two.mapInArrow(_digests, f"id {kind}, h long, sha string"), "digests")
    tested = possibly_repeated(narrow, narrow.count(), bits_per_row, max_filter_bits)
    unique = tested.filter("not maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    maybe = tested.filter("maybe").select("id", "sha")
    groups = small_side(written(maybe.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups"))
    again = maybe.join(groups, "sha").select("id", "keep_id", "group_size", "sha")
    return unique.unionByName(again).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def query(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)
"""
