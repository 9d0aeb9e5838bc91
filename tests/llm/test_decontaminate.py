import random
import tracemalloc

import numpy as np

from stratalog.llm import decontaminate
from stratalog.llm.decontaminate import Index, contaminated, tiles, words


def brute_tiles(item, doc, n):
    used_p, used_t, out = set(), set(), []
    while True:
        best = None
        for a in range(len(item)):
            for b in range(len(doc)):
                k = 0
                while a + k < len(item) and b + k < len(doc) and item[a + k] == doc[b + k] and a + k not in used_p and b + k not in used_t:
                    k += 1
                if k >= n and (best is None or k > best[2]):
                    best = (a, b, k)
        if not best:
            return out
        a, b, k = best
        used_p |= {*range(a, a + k)}
        used_t |= {*range(b, b + k)}
        out.append(best)


def seeds(item, doc, n):
    pairs = [(a, b) for a in range(len(item) - n + 1) for b in range(len(doc) - n + 1) if item[a : a + n] == doc[b : b + n]]
    return np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64)


def test_tiles_equal_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        item = [rng.randrange(3) for _ in range(rng.randrange(1, 14))]
        doc = [rng.randrange(3) for _ in range(rng.randrange(1, 22))]
        n = rng.randrange(1, 4)
        p, t = seeds(item, doc, n)
        _, p, t, size = decontaminate._joined(np.zeros(len(p), np.int64), p, t, np.ones(len(p), np.int64))
        runs = zip(p.tolist(), t.tolist(), (size + n - 1).tolist())
        assert tiles(len(item), len(doc), runs, n) == brute_tiles(item, doc, n)


def test_pairs_in_small_numbers_give_the_same(monkeypatch):
    rng = random.Random(6)
    items = [(k, " ".join(f"w{rng.randrange(3)}" for _ in range(rng.randrange(1, 14)))) for k in range(12)]
    docs = [" ".join(f"w{rng.randrange(4)}" for _ in range(rng.randrange(1, 40))) for _ in range(25)]
    for pairs in (1, 7, 1 << 20):
        monkeypatch.setattr(decontaminate, "PAIRS", pairs)
        index = Index(items, 3)
        for d in docs:
            want = [(k, brute_tiles(words(q), words(d), min(3, len(words(q))))) for k, q in items]
            want = [(k, len(words(items[k][1])), sum(x[2] for x in f), sorted(f)) for k, f in want if f and sum(x[2] for x in f) >= 0.5 * len(words(items[k][1]))]
            assert sorted(index.matches(d, 0.5)) == want


def test_one_word_all_along():
    index = Index([(1, "same " * 200), (2, "same " * 150 + " ".join(f"u{k}" for k in range(10)))], 5)
    tracemalloc.start()
    got = list(index.matches("same " * 200_000, 0.8))  # a megabyte
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(1, 200, 200, [(0, 0, 200)]), (2, 160, 150, [(0, 0, 150)])]
    assert top < 400e6


def brute(docs, bench, n=5, threshold=0.8):
    out = []
    for d, text in docs:
        for i, q in bench:
            item, doc = words(q or ""), words(text or "")
            if item and (found := brute_tiles(item, doc, min(n, len(item)))):
                k = sum(x[2] for x in found)
                if k >= threshold * len(item):
                    out.append((d, i, len(item), k, k / len(item), len(found), " ".join(f"{a}:{b}:{c}" for a, b, c in sorted(found))))
    return out


KEY = lambda r: tuple((x is None, x) for x in r)


def test_reordered_partial_and_odd(spark):
    w = [f"q{k}" for k in range(30)]
    item = " ".join(w)
    bench = [(0, item), (1, "Short, ONE here"), (2, None), (3, "..."), (4, item), (None, "the null item has seven words here")]
    docs = [
        (1, "x y " + item.upper().replace(" ", ", ") + " z"),
        (2, " ".join([*w[15:], "gap", *w[:15]])),
        (3, " ".join(w[:20])),
        (4, " ".join([*w[:10], "a", *w[11:20], "b", *w[21:]])),
        (5, "not short one there"),
        (6, "a short one here"),
        (7, None),
        (8, ""),
        (None, "the null item has seven words here"),
        (9, "q1 " * 2000),
        (1, item),
        (10, " ".join(w[k] for k in range(0, 30, 2))),
    ]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item", "2 as id"), spark.createDataFrame(bench, "item_id long, text string"), block_bytes=60)
    assert sorted(map(tuple, got.collect()), key=KEY) == sorted(brute(docs, bench), key=KEY)
    assert {r.doc_id for r in got.collect()} == {1, 2, 4, 6, None}


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contaminated(docs.limit(0), bench).collect() == []
    assert contaminated(docs, bench.limit(0)).collect() == []


def test_whole_table(spark, sf):
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    bench = [(r.item_id, r.text) for r in b.collect()]
    firsts = {tuple(words(t)[k : k + 5]) for _, t in bench for k in range(len(words(t)))}

    def near(t):
        w = words(t)
        return any(tuple(w[k : k + 5]) in firsts for k in range(len(w)))

    docs = [(r.doc_id, r.text) for r in d.collect()]
    want = []
    for i, t in docs:
        if near(t):
            have = {tuple(words(t)[k : k + 5]) for k in range(len(words(t)))}
            want += brute([(i, t)], [x for x in bench if have & {tuple(words(x[1])[k : k + 5]) for k in range(len(words(x[1])))}])
    assert sorted(map(tuple, contaminated(d, b).collect())) == sorted(want)
