import zlib

import numpy as np
import xxhash

from stratalog.llm.quality import N, SHAPES, Ranker, features, query, rank_quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = query(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    test = [r for r in got if r.held_out and r.doc_id in truth]
    good = [r.predicted for r in test if truth[r.doc_id] == 1]
    bad = [r.predicted for r in test if truth[r.doc_id] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1
    score = np.array([r.score for r in test])
    y = np.array([truth[r.doc_id] for r in test])
    assert np.mean(score[y == 1][:, None] > score[y == 0]) > 0.999  # AUC


def brute_features(text):
    """Hashed shares by plain loops."""
    data = text.lower().encode()
    grams = [int.from_bytes(data[i : i + 4], "little") for i in range(len(data) - 3)]
    words = [xxhash.xxh64_intdigest(x) for x in data.split()]
    pairs = [(3 * a + b) % 2**64 for a, b in zip(words, words[1:])]
    out = []
    for h in (grams, words, pairs):
        cells = [0.0] * 256
        for x in h:
            cells[(x * 0x9E3779B97F4A7C15) % 2**64 >> 56] += 1 / len(h)
        out += cells
    return out


def test_hashed_features_and_scores_equal_brute_force(spark):
    texts = ["", "a", "abc", "One two, two THREE!", "Ünï cödé 日本", "w " * 500, "!!! ###"]
    for t in texts:
        assert np.allclose(features(t)[SHAPES:], brute_features(t), atol=1e-6)
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    labels = [(3, 1), (4, 1), (5, 0), (6, 0)]
    model = Ranker(np.array([features(texts[i]) for i, _ in labels]), np.array([y for _, y in labels]))
    got = {r.doc_id: r.score for r in rank_quality(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    for i, t in enumerate(texts):
        z = [min(8, max(-8, (x - m) / s)) * w * s for x, m, s, w in zip(features(t), model.mean, model.spread, model.w)]
        assert abs(got[i] - 1 / (1 + np.exp(-(sum(z) - model.threshold + np.log(0.3 / 0.7))))) < 1e-4


def test_labels_are_bounded_though_ids_repeat(spark):
    df = spark.range(0, 3000).selectExpr("id % 3 as doc_id", "concat('text ', id) as text")
    got = rank_quality(df, spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, quality int"), max_labelled=3).collect()
    assert len(got) == 3000


def test_odd_texts_and_labels(spark):
    docs = [(1, "A fine sentence. Another fine one."), (2, "!!! ### $$$"), (3, None), (4, ""), (5, "x" * 300_000), (None, "A fine sentence."), (1, "A fine sentence. Another fine one.")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as x", "2 as y", "3 as id")
    for labels in ([], [(1, 1)], [(1, 1), (2, 0), (None, 1), (3, None), (77, 1), (1, 1)]):
        got = rank_quality(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
        by = {r.doc_id: r.score for r in got}
        assert by[1] > by[2] if len(labels) > 2 else all(abs(r.score - 0.3) < 1e-9 for r in got)
    assert rank_quality(df.limit(0), spark.createDataFrame([], "doc_id long, quality int")).collect() == []


def test_pairwise_fit_orders_scores():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, N))
    y = (x[:, 3] - x[:, 5] > 0.2).astype(int)
    m = Ranker(x, y)
    assert ((m.score(x) >= 0.3) == (y == 1)).mean() > 0.97
    assert len(features("")) == N and np.isfinite(features("")).all()
