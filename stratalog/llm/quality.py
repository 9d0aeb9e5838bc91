"""Text quality by Bradley-Terry pairwise ranking.

Each text has a feature vector x: shares of character classes, shape figures, and hashed relative frequencies of byte
n-grams, words and word pairs. From labelled texts preference pairs (label 1 over label 0) are drawn; the model
P(i over j) = sigmoid(w.(x_i - x_j)) is fitted by logistic loss on the feature differences, which leaves w.x as a
score on an arbitrary scale. The quantile of the labelled scores that separates the labels best is the threshold; the
score that is returned is the logistic of the distance to it, shifted so that the threshold is ``cut`` (0.3).

The labelled texts are read for the fit, which sees at most about ``max_labelled`` of them and ``pairs`` pairs; then
every text is read once and scored where it is read. Nothing but ids of labelled rows and their vectors moves.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import documents, id_type, ship, texts

MAX_LABELLED = 20_000
PAIRS = 60_000
CUT = 0.3
#: Cells of each of the three kinds of hashed features.
CELLS = 256

# white space, digits, capitals, small letters, other bytes of UTF-8, sentence marks, other signs, control codes
_KIND = np.full(256, 7, np.int64)
_KIND[33:127] = 6
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = 1
_KIND[65:91] = 2
_KIND[97:123] = 3
_KIND[128:] = 4
_KIND[[ord(c) for c in ".,;:?!'\"-()"]] = 5
_END = re.compile(rb"[.!?](?:\s|$)")
#: Hashed features are this much narrower than the others, so that the ridge holds their many weights lower.
HASHED_SPREAD = 10.0
SHAPES = 18
N = SHAPES + 3 * CELLS


def _cells(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64)


def hashed(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the text's byte n-grams (four bytes), words and word pairs, repeats included."""
    import xxhash

    data = text.lower().encode("utf-8", "surrogatepass")
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    grams = b[:-3] | b[1:-2] << np.uint64(8) | b[2:-1] << np.uint64(16) | b[3:] << np.uint64(24) if len(b) > 3 else b[:0]
    words = np.array([*map(xxhash.xxh64_intdigest, data.split())], np.uint64)
    return _cells(grams), _cells(words), _cells(words[:-1] * np.uint64(3) + words[1:])


def shapes(text: str) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=8) / n
    w = data.split()
    nw = max(1, len(w))
    distinct = len(set(w))
    lines = [x for x in data.split(b"\n") if x.strip()]
    lens = np.fromiter(map(len, w), np.float64, len(w)) if w else np.zeros(1)
    return [
        *kinds, np.log1p(n), lens.mean(), lens.std(), np.log(distinct / nw) if w else 0.0, np.log1p(distinct),
        len(set(lines)) / max(1, len(lines)), len(_END.findall(data)) / nw, min(2.0, len(zlib.compress(data, 1)) / n),
        np.log1p(n / max(1, len(lines))), sum(1 for a, b in zip(w, w[1:]) if a == b) / nw,
    ]


def features(text: str) -> np.ndarray:
    """Fixed-length description of a whole text; language, source and ids play no part."""
    parts = [np.bincount(c, minlength=CELLS) / max(1, len(c)) for c in hashed(text)]
    return np.concatenate([shapes(text), *parts]).astype(np.float32)


def _describe(batches):
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            rows = [features(t) for t in texts(part.column(2))]
            at = pa.array(np.arange(len(rows) + 1) * N, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(at, pa.array(np.concatenate(rows)))], ["id", "y", "x"])


class Ranker:
    """w.x with the threshold found on the labelled scores."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, cut: float = CUT, rounds: int = 300):
        self.w, self.base, self.threshold, self.cut = np.zeros(x.shape[1]), 0.0, 0.0, cut
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return
        mean, spread = x.mean(0), x.std(0) + 1e-6
        spread[SHAPES:] = HASHED_SPREAD * np.maximum(spread[SHAPES:], 1e-3)
        z = np.clip((x - mean) / spread, -8, 8).astype(np.float32)
        rng = np.random.default_rng(11)
        up, down = rng.choice(good, pairs), rng.choice(bad, pairs)
        v = np.zeros(x.shape[1], np.float32)
        # steps of 1 / (a bound of the curvature), with momentum
        largest = float(np.linalg.norm(z @ np.linalg.svd(z[rng.choice(len(z), min(len(z), 500))], full_matrices=False)[2][0])) ** 2 / len(z)
        step, ahead, last = 1 / (largest + ridge), v, v
        for k in range(rounds):
            s = z @ ahead
            p = 1 / (1 + np.exp(np.clip(s[up] - s[down], -30, 30)))  # of being ranked the wrong way
            pull = (np.bincount(up, p, len(z)) - np.bincount(down, p, len(z))) / pairs
            v, last = ahead + step * (pull.astype(np.float32) @ z - ridge * ahead), v
            ahead = v + k / (k + 3) * (v - last)
        self.w = (v / spread).astype(np.float64)
        self.mean, self.spread = mean, spread
        s = z @ v
        grid = np.unique(np.quantile(s, np.linspace(0, 1, 401)))
        mids = (grid[1:] + grid[:-1]) / 2 if len(grid) > 1 else grid
        high, low = np.sort(s[good]), np.sort(s[bad])
        gain = (len(high) - np.searchsorted(high, mids)) / len(high) + np.searchsorted(low, mids) / len(low)
        self.threshold = float(mids[int(np.argmax(gain))])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of feature vectors."""
        raw = np.clip((x - self.mean) / self.spread, -8, 8) @ (self.w * self.spread) if self.w.any() else np.zeros(len(x))
        raw = raw - self.threshold + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def rank_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = CUT, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """id, score (0 to 1), predicted (1 from ``cut`` on) for every row of ``docs``.

    ``labels`` (id, label 0 or 1) should hold the rows to learn from only; rows whose id or label is null, or whose id
    ``docs`` lacks, are not used. More than ``max_labelled`` are thinned by a hash of their id; a label counts once,
    for one of the texts of its id. Without labels of both kinds every score is ``cut``. A null text is scored as the
    empty text. Repeated rows give repeated results; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = id_type(docs, id_col)
    two = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").distinct()
    n = known.count()
    if n > max_labelled:
        hashed = F.shiftrightunsigned(F.xxhash64(F.col("id").cast("string")), 2)  # below 1 << 62
        known = known.filter(hashed < (1 << 62) * max_labelled // n)
    seen = two.join(F.broadcast(known), "id").select("id", "y", "text").mapInArrow(_describe, f"id {kind}, y int, x array<float>")
    got = seen.groupBy("id", "y").agg(F.min("x").alias("x")).toArrow().sort_by([("id", "ascending"), ("y", "ascending")])  # bounded by max_labelled
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, N)
    shared = spark.sparkContext.broadcast(Ranker(x, got.column("y").to_numpy(), cut=cut))

    def run(batches):
        model = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                s = model.score(np.array([features(t) for t in texts(part.column(1))], np.float64).reshape(-1, N))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["id", "score", "predicted"])

    return two.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def query(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    got = rank_quality(documents(spark, sf_dir), labels)
    return got.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
