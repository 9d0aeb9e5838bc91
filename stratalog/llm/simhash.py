"""SimHash near-duplicates with pivot distance tables.

Fingerprints are made where the texts are read, then only distinct fingerprints go on. Their Hamming distances to
``PIVOTS`` reference fingerprints are computed once and written: the pivot table, seven distances to a long. By the
triangle inequality two fingerprints at distance d differ by at most d in every coordinate, so a pair whose largest
coordinate difference is over the limit is discarded from the table alone, and the survivors are verified by the exact
distance.

Which pairs are held against the table at all is decided by buckets: 64 bits are cut into ``blocks`` blocks, and two
fingerprints with at most ``bits`` differing bits agree in ``blocks - bits`` blocks at least, hence in one table of
each choice of blocks. Nothing is lost by that, and the number of blocks grows with the number of fingerprints
(``blocks_for``), so that a bucket's mean size stays bounded. Pairs within a bucket are not written out either:

1. every member of a bucket is held against the bucket's smallest member; this gives at most one link a member;
2. where a bucket still has several components after that, the members outside its largest component are joined
   to the bucket's others by the cell of their first pivot distance, and tested for links between components.

Any two linked fingerprints share a bucket and are in one component after step 1 or are compared in step 2,
so components are exact.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import documents, id_type, ship, small_side, texts, written
from .components import components

PIVOTS = 28
#: Fingerprints a bucket may have on average, over random ones.
BUCKET = 8

_LANES = 7
_ONES = sum(1 << 8 * i for i in range(_LANES))


def fingerprint(text: str, words: int = 4) -> bytes:
    """The 8 big-endian bytes of a text's SimHash over ``words``-word shingles."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return bytes(8)
    joined = b" ".join(w)
    if len(w) <= words:
        h = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        starts = [0, *(ends[: len(w) - words] + 1).tolist()]
        hash_of = xxhash.xxh64_intdigest
        h = [hash_of(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist())]
    count = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        bits = np.unpackbits(np.array(h[i : i + 65536], np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        count += np.add.reduce(bits, axis=0, dtype=np.int32)
    return np.packbits(count * 2 > len(h)).tobytes()


def _fingerprints(words: int):
    def run(batches):
        for b in batches:
            fp = [int.from_bytes(fingerprint(t, words), "big", signed=True) for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    return run


def _masks(blocks: int, agree: int) -> list[int]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) - (1 << 64) * (sum(c) >> 63) for c in itertools.combinations(block, agree)]


def blocks_for(n: int, bits: int) -> int:
    """The fewest blocks at which ``n`` random fingerprints have at most ``BUCKET`` to a bucket."""
    for blocks in range(bits + 3, 24):
        if n <= BUCKET << 64 * (blocks - bits) // blocks:
            return blocks
    return 24


def pivots(n: int = PIVOTS) -> list[int]:
    """The reference fingerprints, as signed longs."""
    rng = np.random.default_rng(20)
    return [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, n)]


def _columns(n: int = PIVOTS) -> list[str]:
    return [f"d{k}" for k in range(math.ceil(n / _LANES))]


def pivot_table(nodes: DataFrame, keys: list[str] = ()) -> DataFrame:
    """``keys`` and ``fp`` with its distances to the pivots: seven to a long, a byte each."""
    own = pivots()
    lane = lambda p, k: F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long"), 8 * k)
    packed = [sum((lane(p, k) for k, p in enumerate(own[i : i + _LANES])), F.lit(0).cast("long")).alias(c) for i, c in zip(range(0, PIVOTS, _LANES), _columns())]
    return nodes.select(*keys, "fp", *packed)


def _near(x: str, y: str, bits: int):
    """No coordinate of two table columns differs by more than ``bits``; all seven are compared at once.

    Coordinates are at most 64, so in (x with every high bit set) - y + bits no byte carries into the next one, and a
    byte keeps its high bit exactly where y - x <= bits.
    """
    high = F.lit(_ONES << 7)
    one = lambda a, b: (F.col(a).bitwiseOR(high) - F.col(b) + F.lit(bits * _ONES)).bitwiseAND(high) == high
    return one(x, y) & one(y, x)


def _links(a: str, b: str, da: list[str], db: list[str], bits: int):
    """Pair test: the largest coordinate difference from the pivot table discards, the exact distance verifies."""
    test = F.lit(True)
    for x, y in zip(da, db):
        test = test & _near(x, y, bits)
    return test & (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits)


def link_components(nodes: DataFrame, bits: int = 4, blocks: int | None = None) -> DataFrame:
    """``nodes`` (distinct long ``fp``, a written table) to (node, comp) for the fingerprints that link to another one."""
    blocks = blocks or blocks_for(nodes.count(), bits)
    ds = _columns()
    lead = [f"leader_{d}" for d in ds]
    table = written(pivot_table(nodes), "pivots")
    keys = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(_masks(blocks, blocks - bits))]
    keyed = table.select("fp", *ds, F.explode(F.array(*keys)).alias("b")).select("b.t", "b.k", "fp", *ds)
    buckets = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("leader")).filter("n > 1").drop("n")
    buckets = written(buckets, "buckets")
    leaders = small_side(written(buckets.select("leader").distinct().join(table, F.col("leader") == F.col("fp")).select("leader", *[F.col(d).alias(x) for d, x in zip(ds, lead)]), "leaders"))
    members = written(keyed.join(small_side(buckets), ["t", "k"]), "members")
    star = members.filter(F.col("fp") != F.col("leader")).join(leaders, "leader").filter(_links("fp", "leader", ds, lead, bits))
    first = written(components(star.select(F.col("fp").alias("a"), F.col("leader").alias("b"))), "first")
    named = members.drop("leader").join(small_side(first.withColumnRenamed("node", "fp")), "fp", "left")
    named = written(named.select("t", "k", "fp", *ds, F.coalesce("comp", "fp").alias("comp")), "named")
    sizes = named.groupBy("t", "k", "comp").agg(F.count(F.lit(1)).alias("n"))
    split = sizes.groupBy("t", "k").agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("major"))
    split = written(split.filter("comps > 1").drop("comps"), "split")
    open_ = written(named.join(small_side(split), ["t", "k"]).withColumn("minor", F.col("comp") != F.col("major")).drop("major"), "open")
    cell = F.floor(F.col(ds[0]).bitwiseAND(F.lit(127)) / (bits + 1)).cast("int")
    other = [f"y_{d}" for d in ds]
    left = open_.filter("minor").select("t", "k", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"), F.col("fp").alias("x"), F.col("comp").alias("a"), *ds)
    right = open_.select("t", "k", cell.alias("cell"), F.col("fp").alias("y"), F.col("comp").alias("b"), F.col("minor").alias("both"), *[F.col(d).alias(y) for d, y in zip(ds, other)])
    across = left.join(right, ["t", "k", "cell"]).filter((F.col("a") != F.col("b")) & (~F.col("both") | (F.col("x") < F.col("y"))) & _links("x", "y", ds, other, bits))
    second = written(components(across.select("a", "b").distinct()), "second").select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    # components without a link of their own are joined by the second round only
    every = first.unionByName(second.select(F.col("comp").alias("node"), "comp")).distinct()
    return every.join(small_side(second), "comp", "left").groupBy("node").agg(F.min(F.coalesce("root", "comp")).alias("comp"))


def near_dedup(docs: DataFrame, words: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (smallest id that links reach, itself included).

    ``bits`` (1 to 6) is the number of differing bits at which fingerprints still link. A null or empty text, or one
    of white space only, has fingerprint zero and links like any other. Repeated rows give repeated results; null
    ids are never the smallest, unless a component has no other; an empty table gives an empty result; other
    columns are not read.
    """
    ship(docs.sparkSession)
    two = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fps = written(two.mapInArrow(_fingerprints(words), f"id {id_type(docs, id_col)}, fp long"), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("id").alias("rep")), "nodes")
    linked = written(link_components(nodes.select("fp"), bits), "linked").withColumnRenamed("node", "fp")
    inside = written(nodes.join(small_side(linked), "fp").select("fp", "comp", "rep"), "inside")
    roots = small_side(written(inside.groupBy("comp").agg(F.min("rep").alias("component_id")), "roots"))
    mapped = small_side(written(inside.join(roots, "comp").select("fp", "component_id"), "mapped"))
    whole = small_side(written(nodes.join(mapped, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")), "whole"))
    return fps.join(whole, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def query(spark, sf_dir):
    return near_dedup(documents(spark, sf_dir))
