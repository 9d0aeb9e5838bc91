import random

import xxhash
from pyspark.sql import functions as F

from stratalog.llm import simhash
from stratalog.llm.components import components
from stratalog.llm.simhash import link_components, near_dedup


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, bits=4):
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def test_components_of_chain_star_and_cycle(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (7, 7), (300, 300)] + [(-5, -4)] * 3 + [(None, 1)]
    for local in (0, 20, 200_000):
        got = {r.node: r.comp for r in components(spark.createDataFrame(e, "a long, b long"), local).collect()}
        assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), **dict.fromkeys((200, 201, 202), 200), -5: -5, -4: -5}


def test_links_are_exact(spark):
    rng = random.Random(3)
    signed = lambda x: x - (1 << 64) * (x >> 63)
    values = set()
    for _ in range(25):  # walks of a few flipped bits, some steps too wide
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 25)):
            values.add(signed(x))
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 4, 5, 6])):
                x ^= 1 << b
    center = rng.getrandbits(64)  # a ball in which many do not link to the smallest
    for _ in range(60):
        x = center
        for b in rng.sample(range(64), 4):
            x ^= 1 << b
        values.add(signed(x))
    want = brute_components(values)
    alone = {v for v in want if sum(w == want[v] for w in want.values()) == 1}
    got = {r.node: r.comp for r in link_components(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    assert {k: v for k, v in got.items() if k not in alone} == {k: v for k, v in want.items() if k not in alone}
    assert all(got.get(v, v) == v for v in alone)


def reachable(rows):
    fps = [brute_fp(t) for _, t in rows]
    comp = brute_components(fps)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    return [(i, f"{f:016x}", least.get(comp[f])) for (i, _), f in zip(rows, fps)]


KEY = lambda r: tuple((x is None, x) for x in r)


def test_odd_texts(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "a b c"), (7, "É x y z q"), (8, " ".join(words)), (9, " ".join(["new", *words])), (10, " ".join(words[:-1])), (11, "w " * 30000), (None, "one"), (None, "lonely null"), (5, "ONE"), (12, "a b c\x0bd e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as comp", "3 as id")
    got = [tuple(r) for r in near_dedup(df).collect()]
    assert sorted(got, key=KEY) == sorted(reachable(rows), key=KEY)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, near_dedup(docs).collect())) == sorted(reachable(rows))


def test_empty_table(spark):
    assert near_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pivot_table_and_its_test(spark):
    rng = random.Random(5)
    signed = lambda x: x - (1 << 64) * (x >> 63)
    own = simhash.pivots()
    pairs = []
    for _ in range(400):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randrange(0, 40)):
            y ^= 1 << b
        pairs.append((signed(x), signed(y)))
    pairs.append((own[0], signed(~own[0] & (2**64 - 1))))  # distances 0 and 64
    two = spark.createDataFrame(pairs, "x long, y long")
    cols = simhash._columns()
    a = simhash.pivot_table(two.selectExpr("x as fp").distinct()).withColumnRenamed("fp", "x")
    b = simhash.pivot_table(two.selectExpr("y as fp").distinct()).toDF("y", *[f"y_{c}" for c in cols])
    near = F.lit(True)
    for c in cols:
        near = near & simhash._near(c, f"y_{c}", 4)
    got = {(r.x, r.y): r for r in two.join(a, "x").join(b, "y").withColumn("near", near).collect()}
    far = lambda x, p: ((x ^ p) & (2**64 - 1)).bit_count()
    assert len(own) == simhash.PIVOTS and len(got) == len(set(pairs))
    for (x, y), r in got.items():
        dx = [r[c] >> 8 * k & 255 for c in cols for k in range(7)]
        assert dx == [far(x, p) for p in own]
        assert r.near == (max(abs(far(x, p) - far(y, p)) for p in own) <= 4)


def test_buckets_stay_small_as_fingerprints_grow():
    cost = {}
    for n in (10**6, 10**8, 10**9, 10**10, 10**11):
        blocks = simhash.blocks_for(n, 4)
        tables = len(simhash._masks(blocks, blocks - 4))
        assert n / 2 ** (64 * (blocks - 4) // blocks) <= simhash.BUCKET
        cost[n] = tables
    assert cost[10**6] == 35 and cost[10**11] <= 126  # rows a fingerprint


def test_links_are_exact_with_any_number_of_blocks(spark):
    rng = random.Random(8)
    values = {rng.getrandbits(20) for _ in range(300)}  # dense: 44 bits in common, full buckets
    want = brute_components(values)
    alone = {v for v in want if sum(w == want[v] for w in want.values()) == 1}
    for blocks in (7, 8):
        got = {r.node: r.comp for r in link_components(spark.createDataFrame([(v,) for v in values], "fp long"), blocks=blocks).collect()}
        assert {k: v for k, v in got.items() if k not in alone} == {k: v for k, v in want.items() if k not in alone}
