from collections import defaultdict

import pytest

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

from stratalog.llm import langid, near_copies  # noqa: E402
from stratalog.llm.decontaminate import words  # noqa: E402

from .test_decontaminate import brute_tiles  # noqa: E402
from .test_packing import verify  # noqa: E402


FOREIGN = "ґедзь їжак щука цвях " * 10


def brute_stages(rows, bench, model):
    """What each of the first four stages keeps, by plain means. Rows: (doc_id, text)."""
    known = lambda t: model.identify(t)[1] + len(t.encode()) ** -0.5 >= 0.2
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "") and known(r[1])] if model.languages else rows
    yield kept
    last = defaultdict(lambda: -1)
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for i, t in kept:
        last[low(t)] = max(last[low(t)], i)
    kept = sorted({(i, t) for i, t in kept if last[low(t)] == i})
    yield kept
    fps, sets, group = {i: near_copies.fingerprints(t) for i, t in kept}, {i: set(near_copies.shingles(t).tolist()) for i, t in kept}, {i: i for i, _ in kept}
    for i in fps:
        for j in fps:
            near = i < j and any((x ^ y).bit_count() <= 2 for x, y in zip([f % 2**64 for f in fps[i]], [f % 2**64 for f in fps[j]]))
            if near and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    kept = [r for r in kept if group[r[0]] == r[0]]
    yield kept
    items = [words(t or "") for _, t in bench]

    def leaks(t):
        w = words(t or "")
        seeds = {tuple(w[k : k + 5]) for k in range(len(w))}
        for q in items:
            n = min(5, len(q))
            if q and any(tuple(q[k : k + n]) in {s[:n] for s in seeds} for k in range(len(q) - n + 1)) and sum(x[2] for x in brute_tiles(q, w, n)) >= 0.8 * len(q):
                return True
        return False

    yield [r for r in kept if not leaks(r[1])]


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, " 12 ", "en", "s", 4), (10**6 + 2, "Ω", "en", "s", 1), (10**6 + 3, FOREIGN, None, "s", 4)], docs.schema))
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_stages(rows, bench, langid.train(docs))
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name == "best_fit_packing":
            verify(out.collect(), rows, 4096)
            continue
        if name == "language_id":
            gone = {r.doc_id for r in docs.join(out, "doc_id", "left_anti").collect()}
            assert gone == {10**6, 10**6 + 1, 10**6 + 3}  # by their language's score: 10**6 + 3
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted(rows) == sorted(next(want)), name


def test_run_and_empty_table(spark, sf, tmp_path):
    assert {r.doc_id for r in pipeline.run(spark, sf).collect()}
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
