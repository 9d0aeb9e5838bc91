"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter is a table of bitmasks: an n-gram of a language sets the language's bits in the slots that it
hashes to, and the AND of an n-gram's slots gives all languages that (may) contain it at once. Every n-gram that was
learnt is in the filter. A language has ``PLANES`` bits: the first is set by all of its n-grams, the others by those whose
rate in the language is at least 2^-15, 2^-13 and so on, so that the filter also tells about how frequent an n-gram is
in each language. A document's n-grams are looked up together; for each language and plane the bits are
counted, corrected for the rate at which an absent n-gram would still hit (the share of slots with the bit, to the
power of the number of hashes), and the largest sum over a language's planes decides: a log-likelihood in steps of four.

The filter's size follows from the number of n-grams: about ``SLOTS_PER_GRAM`` slots for each, 2^``MAX_SLOT_BITS`` at
most (beyond that only the rate of false hits grows, which is corrected), of as many 64-bit words as the languages need. Each language
is learnt by itself, however rare it is beside others, from at most about ``max_docs`` of its labelled documents, chosen by a
hash of their id. N-grams are runs of four UTF-8 bytes of the lower-case text, with everything but letters as one space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import documents, ship, texts, written

#: Per language.
MAX_TRAIN_DOCS = 20_000
SLOTS_PER_GRAM, MAX_SLOT_BITS = 8, 22
HASHES = 2
#: Least rates of the planes after the first.
RATES = tuple(2.0**-k for k in (15, 13, 11, 9, 7))
PLANES = 1 + len(RATES)

_TABLE = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def grams(text: str) -> np.ndarray:
    """The text's n-grams as unsigned 32-bit integers, repeats included."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_TABLE).split()) + b" "
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) < 4:
        return np.zeros(0, np.uint32)
    return b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)


def _slots(g: np.ndarray, slot_bits: int):
    x = g.astype(np.uint64)
    for mult in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[:HASHES]:
        yield ((x * np.uint64(mult)) >> np.uint64(64 - slot_bits)).astype(np.int64)


def slot_bits_for(grams: int) -> int:
    return min(MAX_SLOT_BITS, max(16, (SLOTS_PER_GRAM * max(1, grams) - 1).bit_length()))


def planes(rate: np.ndarray) -> np.ndarray:
    """How many planes an n-gram of a language is in."""
    return 1 + np.searchsorted(np.array(RATES), rate, side="right")


class Filter:
    """Bitmask filter over any number of languages; ``masks``: a row of words for each slot."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, masks
        self.slot_bits = max(1, len(masks)).bit_length() - 1
        n = PLANES * len(languages)
        ones = sum((self._bits(masks[i : i + 65536]).sum(axis=0, dtype=np.int64) for i in range(0, len(masks), 65536)), np.zeros(64 * masks.shape[1], np.int64))
        self.false_rate = (ones[:n] / len(masks)) ** HASHES

    @staticmethod
    def of(counts: dict[str, dict[int, int]], slot_bits: int | None = None) -> "Filter":
        """From n-grams of each language with their counts."""
        languages = sorted(counts)
        bits = slot_bits or slot_bits_for(len(set().union(*counts.values())))
        masks = np.zeros((1 << bits, max(1, -(-PLANES * len(languages) // 64))), np.uint64)
        for k, lang in enumerate(languages):
            g, n = np.array(list(counts[lang].keys()), np.uint32), np.array(list(counts[lang].values()), np.float64)
            have = planes(n / max(1.0, n.sum()))
            for p in range(PLANES):
                word, bit = divmod(k * PLANES + p, 64)
                for s in _slots(g[have > p], bits):
                    masks[s, word] |= np.uint64(1 << bit)
        return Filter(languages, masks)

    @staticmethod
    def _bits(words: np.ndarray) -> np.ndarray:
        return np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")

    def identify(self, text: str) -> tuple[str, float]:
        if not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        g = grams(text)
        raw, n = np.zeros(len(self.false_rate)), max(1, len(g))
        for i in range(0, len(g), 65536):
            hit = None
            for s in _slots(g[i : i + 65536], self.slot_bits):
                hit = self.masks[s] if hit is None else hit & self.masks[s]
            raw += self._bits(hit).sum(axis=0, dtype=np.int64)[: len(raw)]
        f = self.false_rate
        found = np.where(f < 1, np.maximum(0.0, raw - n * f) / np.where(f < 1, 1 - f, 1.0), 0.0).reshape(-1, PLANES)
        total = found.sum(axis=1)
        best = int(np.argmax(np.round(total, 6)))
        return self.languages[best], float(min(1.0, total[best] / (PLANES * n)))


def _count(batches):
    for b in batches:
        by: dict[str, list[np.ndarray]] = {}
        for lang, t in zip(b.column(0).to_pylist(), texts(b.column(1))):
            by.setdefault(lang, []).append(grams(t))
        for lang, parts in by.items():
            g, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def _places(languages: list[str], totals: dict[str, int], slot_bits: int):
    """Each n-gram's slots with the bits that it sets there, a row for each 64-bit word."""
    at = {lang: k for k, lang in enumerate(languages)}

    def run(batches):
        for b in batches:
            lang = b.column(0).to_pylist()
            g, n = b.column(1).to_numpy().astype(np.uint32), b.column(2).to_numpy()
            have = planes(n / np.array([max(1, totals[x]) for x in lang], np.float64))
            first = np.array([at[x] for x in lang], np.int64) * PLANES
            for p in range(PLANES):
                some = have > p
                bit = first[some] + p
                for s in _slots(g[some], slot_bits):
                    yield pa.RecordBatch.from_arrays([pa.array(s), pa.array((bit // 64).astype(np.int32)), pa.array(np.left_shift(np.uint64(1), (bit % 64).astype(np.uint64)).view(np.int64))], ["slot", "word", "mask"])

    return run


def learn(labelled: DataFrame, lang_col: str, text_col: str, id_col: str, max_docs: int = MAX_TRAIN_DOCS, slot_bits: int | None = None) -> Filter:
    """A filter from labelled rows, for any number of languages.

    Of each language at most about ``max_docs`` documents are used, chosen by a hash of their id, and all of their
    n-grams. ``slot_bits`` follows from the number of n-grams where it is not given. Rows without a language are not used; a
    language whose documents have no n-gram is learnt but never predicted; an empty table gives an empty filter.
    """
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("string").alias("id")).filter("lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    large = [(lang, int((1 << 62) / n * max_docs)) for lang, n in sizes.items() if n > max_docs]
    if large:
        limits = F.broadcast(spark.createDataFrame(large, "lang string, below long"))
        hashed = F.shiftrightunsigned(F.xxhash64("id"), 2)  # below 1 << 62
        rows = rows.join(limits, "lang", "left").filter(F.col("below").isNull() | (hashed < F.col("below")))
    counts = written(rows.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    bits = slot_bits or slot_bits_for(counts.select("gram").distinct().count())
    masks = np.zeros((1 << bits, max(1, -(-PLANES * len(languages) // 64))), np.uint64)
    set_ = counts.mapInArrow(_places(languages, totals, bits), "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    # a row for each word of the filter at most, by 65,536 slots
    for part in set_.groupBy(F.floor(F.col("slot") / 65536).alias("part")).agg(F.collect_list(F.struct("slot", "word", "mask")).alias("rows")).select("rows.slot", "rows.word", "rows.mask").toLocalIterator():
        masks[np.array(part["slot"]), np.array(part["word"])] = np.array(part["mask"], np.int64).view(np.uint64)
    return Filter(languages, masks)


def identify(docs: DataFrame, model: Filter, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) plus lang_pred and score.

    lang_pred is a learned language, or ``und`` where the text is null, empty or has no letter, or nothing was learnt.
    Score is the mean share of planes that the text's n-grams have in that language, corrected: near 1 for frequent n-grams only,
    0 where no n-gram speaks for any language, and then lang_pred is the one that sorts first. Of equal sums the
    language that sorts first wins.
    A kept column named lang_pred or score gives way to the new one. Rows come back one for one; an empty
    table gives an empty result.
    """
    from pyspark.sql import types as T

    spark = docs.sparkSession
    ship(spark)
    new = ["lang_pred", "score"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    shared = spark.sparkContext.broadcast(model)
    inner = [f"c{k}" for k in range(len(keep))]

    def run(batches):
        m = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                got = [m.identify(t) for t in texts(b.column(0))]
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], [*inner, *new])

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`").alias(i) for c, i in zip(keep, inner)])
    fields = [T.StructField(f.name, f.dataType) for f in rows.schema.fields[1:]]
    out = rows.mapInArrow(run, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    return out.select(*[F.col(i).alias(c) for i, c in zip(inner, keep)], *new)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame) -> Filter:
    return learn(docs.filter(~held_out()), "lang", "text", "doc_id")


def query(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return identify(rows, train(docs), keep=["doc_id", "held_out"])
