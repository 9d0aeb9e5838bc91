"""Benchmark decontamination by greedy string tiling.

The benchmark is the stated query set; every document is held against all of it, in blocks of items of a
bounded size that go to the workers whole. A document's words are numbered by the block's vocabulary and
its windows of ``min_match`` words hashed by a running Karp-Rabin hash; windows that an item has too are the
seeds. For each item with enough seeds the longest match is marked, then the longest of what is left, and so on
until no match of ``min_match`` words remains. Marked places never overlap, in the item or in the document, so the
share of the item's words that is marked also counts passages whose parts come in another order.

Words that repeat make many pairs of equal windows. Pairs are made in bounded numbers and kept as runs along a diagonal,
of which there are at most as many as words in item and document where one word repeats throughout.

No document text leaves the task that reads it, and no row shuffles.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import documents, id_type, ship, texts

#: UTF-8 bytes of benchmark text that go to the workers at once.
BLOCK_BYTES = 16 << 20

#: Pairs of equal windows, of an item and of a document, that are held at once.
PAIRS = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_SPLIT = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MARKS = re.compile(r"[\u00a0-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u00d7\u00f7\u2000-\u206f\u3000-\u303f]+")


def words(text: str) -> list[bytes]:
    """Lower-case words; ASCII signs, Latin-1 signs and general punctuation separate them."""
    t = text.lower()
    if not t.isascii():
        t = _MARKS.sub(" ", t)
    return t.encode("utf-8", "surrogatepass").translate(_SPLIT).split()


def _running(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``n`` ids, modulo 2**64."""
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(_BASE) + ids[k : k + len(h)]
    return h


def _mix(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _joined(item: np.ndarray, p: np.ndarray, t: np.ndarray, size: np.ndarray):
    """Runs of seeds (item, item place, document place, seeds in a row) with those that continue one another made one."""
    order = np.lexsort((p, t - p, item))
    item, p, t, size = item[order], p[order], t[order], size[order]
    if not len(p):
        return item, p, t, size
    new = (np.diff(item) != 0) | (np.diff(t - p) != 0) | (p[1:] != p[:-1] + size[:-1])
    at = np.concatenate([[0], np.flatnonzero(new) + 1])
    return item[at], p[at], t[at], np.add.reduceat(size, at)


def tiles(n_item: int, n_doc: int, runs, n: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from ``runs`` (item place, document place, words): (item start, doc start, words).

    Of equally long matches the one that starts first in the item, then in the document, is marked first.
    """
    heap = [(-size, p, t) for p, t, size in runs]
    heapq.heapify(heap)
    used_p, used_t = np.zeros(n_item, bool), np.zeros(n_doc, bool)
    free = list(range(n_item - n + 2))  # free[k]: windows of n unmarked words that start before k
    out = []
    while heap:
        length, a, b = heapq.heappop(heap)
        length = -length
        if free[a + length - n + 1] == free[a]:
            continue
        taken = used_p[a : a + length] | used_t[b : b + length]
        if not taken.any():
            used_p[a : a + length] = True
            used_t[b : b + length] = True
            out.append((a, b, length))
            marked = np.concatenate([[0], np.cumsum(used_p)])
            free = np.concatenate([[0], np.cumsum(marked[n:] == marked[:-n])]).tolist()
            if not free[-1]:
                break
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]])))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if j - i >= n:
                heapq.heappush(heap, (-(j - i), a + i, b + i))
    return out


class Index:
    """Seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple], min_match: int):
        self.vocab: dict[bytes, int] = {}
        self.items, words_of, seeds, at = [], [], {}, 0
        for key, text in items:
            w = words(text or "")
            if not w:
                continue
            ids = np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], np.int64)
            n = min(min_match, len(w))
            h = _running(_mix(ids), n)
            seeds.setdefault(n, []).append((h, np.full(len(h), len(self.items)), np.arange(len(h))))
            self.items.append((key, at, len(ids)))
            words_of.append(ids)
            at += len(ids)
        self.flat = np.concatenate(words_of) if words_of else np.zeros(0, np.int64)
        self.starts = np.array([x[1] for x in self.items], np.int64)
        self.seeds = {}
        for n, parts in seeds.items():
            h, i, p = map(np.concatenate, zip(*parts))
            order = np.argsort(h, kind="stable")
            self.seeds[n] = h[order], i[order], p[order]

    def _runs(self, doc: np.ndarray, t: np.ndarray, lo: np.ndarray, count: np.ndarray, n: int):
        """Runs of seeds. Pairs of places are made at most ``PAIRS`` at a time and kept as runs only."""
        _, of, at = self.seeds[n]
        ends, i, out = np.cumsum(count), 0, []
        while i < len(t):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - count[i] + PAIRS, "right")))
            c = count[i:j]
            k = np.repeat(lo[i:j] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            place, item, p = np.repeat(t[i:j], c), of[k], at[k]
            base, ok = self.starts[item] + p, np.ones(len(p), bool)
            for x in range(n):  # hashes may collide
                ok &= self.flat[base + x] == doc[place + x]
            out.append(_joined(item[ok], p[ok], place[ok], np.ones(ok.sum(), np.int64)))
            i = j
        return _joined(*map(np.concatenate, zip(*out)))

    def matches(self, text: str, threshold: float):
        get = self.vocab.get
        w = words(text)
        doc = np.array([get(x, 0) for x in w], np.int64) if w else np.zeros(0, np.int64)
        mixed = None
        for n, (seeds, _, _) in self.seeds.items():
            if len(doc) < n:
                continue
            known = np.cumsum(np.concatenate([[0], doc == 0]))
            t = np.flatnonzero(known[n:] == known[:-n])
            if not len(t):
                continue
            mixed = _mix(doc) if mixed is None else mixed
            h = _running(mixed, n)[t]
            lo, hi = np.searchsorted(seeds, h, "left"), np.searchsorted(seeds, h, "right")
            some = hi > lo
            if not some.any():
                continue
            item, p, place, size = self._runs(doc, t[some], lo[some], (hi - lo)[some], n)
            if not len(item):
                continue
            cut = np.flatnonzero(np.diff(item)) + 1
            for i, j in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(item)]]).tolist()):
                key, _, length = self.items[item[i]]
                reach = np.zeros(length + 1, np.int64)  # words of the item that any seed covers
                np.add.at(reach, p[i:j], 1)
                np.add.at(reach, p[i:j] + size[i:j] + n - 1, -1)
                if (np.cumsum(reach)[:-1] > 0).sum() < threshold * length:
                    continue
                marked = tiles(length, len(doc), zip(p[i:j].tolist(), place[i:j].tolist(), (size[i:j] + n - 1).tolist()), n)
                n_marked = sum(x[2] for x in marked)
                if n_marked >= threshold * length:
                    yield key, length, n_marked, sorted(marked)


def _search(shared, threshold: float, item_kind):
    def run(batches):
        index = shared.value
        for b in batches:
            out = [[] for _ in range(7)]
            for i, t in enumerate(texts(b.column(1))):
                for key, n, marked, found in index.matches(t, threshold):
                    for col, x in zip(out, (i, key, n, marked, marked / n, len(found), " ".join(f"{p}:{q}:{k}" for p, q, k in found))):
                        col.append(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], item_kind), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.float64()), pa.array(out[5], pa.int64()), pa.array(out[6], pa.string())],
                ["id", "item", "item_words", "matched_words", "coverage", "n_tiles", "tiles"],
            )

    return run


def _blocks(bench: DataFrame, limit: int):
    block, n = [], 0
    for key, text in bench.toLocalIterator():
        block.append((key, text))
        n += len((text or "").encode("utf-8", "surrogatepass"))
        if n >= limit:
            yield block
            block, n = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, bench: DataFrame, min_match: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and benchmark item of whose words at least ``threshold`` are tiled in the document.

    Columns: the two ids, item_words, matched_words, coverage, n_tiles, tiles (item start:document start:length in
    words). Items of fewer than ``min_match`` words match as a whole; null and wordless items or texts match nothing;
    repeated rows on either side give repeated results; empty tables give an empty result; other columns are not
    read. A benchmark above ``block_bytes`` takes one pass over the documents per block.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    ship(spark)
    kinds = id_type(docs, id_col), id_type(bench, item_col)
    item_kind = to_arrow_type(bench.schema[item_col].dataType)
    two = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kinds[0]}, item {kinds[1]}, item_words long, matched_words long, coverage double, n_tiles long, tiles string"
    out = spark.createDataFrame([], schema)
    for k, block in enumerate(_blocks(bench.select(item_col, F.col(item_text_col).cast("string")), block_bytes)):
        found = two.mapInArrow(_search(spark.sparkContext.broadcast(Index(block, min_match)), threshold, item_kind), schema)
        out = out.unionByName(found) if k else found
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def query(spark, sf_dir):
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
