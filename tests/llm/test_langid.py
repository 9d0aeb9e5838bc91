import zlib
from collections import Counter, defaultdict

import numpy as np

from stratalog.llm import langid
from stratalog.llm.langid import Filter, _slots, grams, identify, learn, query, slot_bits_for


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = query(spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in test) / len(test) > 0.97


def test_odd_texts(spark):
    rows = [(1, "the cat sat on the mat with the hat", "en"), (2, "le chat est sur la table avec la dame", "fr"), (3, "the dog and the fog and the log", "en"), (4, None, "en"), (5, "", None)]
    df = spark.createDataFrame(rows * 4, "doc_id long, text string, lang string")
    model = learn(df, "lang", "text", "doc_id")
    assert model.languages == ["en", "fr"]
    texts = [(1, "the hat"), (2, "la table"), (3, None), (4, ""), (5, "12 !?"), (None, "THE MAT"), (7, "the " * 50000), (8, "é"), (8, "é")]
    q = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'x' as lang_pred", "array(1) as score", "2 as __text", "3 as `a.b`", "4 as c0")
    assert identify(q, model).columns == ["doc_id", "text", "__text", "a.b", "c0", "lang_pred", "score"]
    assert {(r["__text"], r["a.b"], r.c0) for r in identify(q, model).collect()} == {(2, 3, 4)}
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in identify(q, model).collect()}
    assert got[1, "the hat"][0] == "en" and got[2, "la table"][0] == "fr" and got[None, "THE MAT"][0] == "en"
    assert all(got[k] == ("und", 0.0) for k in ((3, None), (4, ""), (5, "12 !?")))
    assert identify(q.limit(0), model).collect() == []


def test_nothing_learnt(spark):
    none = learn(spark.createDataFrame([], "doc_id long, text string, lang string"), "lang", "text", "doc_id")
    assert none.identify("the text") == ("und", 0.0)


def brute_identify(model_counts, text):
    """Exact sets in place of the filter; without false positives there is nothing to correct."""
    if not any(map(str.isalpha, text)):
        return "und", 0.0
    have, sums = grams(text).tolist(), {}
    for lang, c in model_counts.items():
        total = sum(c.values())
        sums[lang] = sum(1 + sum(c[g] / total >= 2.0**-k for k in (15, 13, 11, 9, 7)) for g in have if g in c)
    best = min(sums, key=lambda x: (-sums[x], x))
    return best, sums[best] / (6 * max(1, len(have)))


def learnt(docs):
    counts = defaultdict(Counter)
    for r in docs.collect():
        if r.lang:
            counts[r.lang].update(grams(r.text or "").tolist())
    return counts


def test_filter_equals_exact_sets(spark, sf):
    """The corrected counts of the filter against brute force over all documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = learnt(docs)
    made = learn(docs, "lang", "text", "doc_id")
    assert (made.masks == Filter.of(counts).masks).all() and made.slot_bits == Filter.of(counts).slot_bits
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, made).collect()}
    far = same = 0
    for r in docs.collect():
        lang, score = brute_identify(counts, r.text or "")
        same += got[r.doc_id][0] == lang
        far = max(far, abs(got[r.doc_id][1] - score))
    assert same >= 0.995 * len(got) and far < 0.05


def bits_of(f, g):
    hit = None
    for s in _slots(np.array([g], np.uint32), f.slot_bits):
        hit = f.masks[s] if hit is None else hit & f.masks[s]
    return np.unpackbits(hit.view(np.uint8), bitorder="little")[: 6 * len(f.languages)].reshape(-1, 6)


def test_every_language_of_an_ngram_comes_back():
    f = Filter.of({"a": {1: 90, 2: 10, 7: 1}, "b": {1: 10, 3: 90, 7: 200_000}})
    assert bits_of(f, 1)[:, 0].tolist() == [1, 1] and bits_of(f, 2)[:, 0].tolist() == [1, 0] and bits_of(f, 7)[:, 0].tolist() == [1, 1]
    assert bits_of(f, 1).tolist() == [[1, 1, 1, 1, 1, 1], [1, 1, 0, 0, 0, 0]]  # about as frequent as it is in each


def test_filter_has_no_false_negative():
    f = Filter.of({"a": {k: 3 for k in range(5000)}, "b": {k: 3 for k in range(5000, 9000)}}, slot_bits=14)
    assert all(bits_of(f, k)[0, 0] for k in range(5000)) and all(bits_of(f, k)[1, 0] for k in range(5000, 9000)) and 0 < f.false_rate[0] < 1


def test_size_follows_the_ngrams():
    assert [slot_bits_for(n) for n in (0, 1000, 100_000, 10**9)] == [16, 16, 20, 22]


def test_more_than_64_languages():
    f = Filter.of({f"l{k:03}": {1000 * k + i: 3 for i in range(500)} for k in range(150)}, slot_bits=16)
    assert len(f.languages) == 150 and len(f.false_rate) == 900 and f.masks.shape == (1 << 16, 15)
    words = {"aa": "wolf", "zz": "bear"} | {f"l{k:03}": "x" for k in range(100)}
    f = Filter.of({lang: {int(g): 3 for g in grams(word)} for lang, word in words.items()}, slot_bits=16)
    assert f.identify("bear bear")[0] == "zz" and f.identify("wolf")[0] == "aa"


def test_dominant_language_leaves_room_for_rare_ones(spark):
    big = [(k, f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}k " * 5, "big") for k in range(1500)]
    rows = [*big, (5001, "zebra quagga", "one"), (5002, "okapi okapi", "two")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = learn(df, "lang", "text", "doc_id", max_docs=100)
    assert model.languages == ["big", "one", "two"]
    got = {r.doc_id: r.lang_pred for r in identify(df.filter("doc_id > 5000"), model).collect()}
    assert got == {5001: "one", 5002: "two"}


def test_sample_is_per_language(spark, monkeypatch):
    seen, plain = {}, langid._places
    monkeypatch.setattr(langid, "_places", lambda languages, totals, bits: seen.update(totals) or plain(languages, totals, bits))
    df = spark.createDataFrame([(k, "alpha beta", "en") for k in range(40_000)] + [(100_000 + k, "gamma delta", "fr") for k in range(30)], "doc_id long, text string, lang string")
    learn(df, "lang", "text", "doc_id", max_docs=1000)
    n = {"en": len(grams("alpha beta")), "fr": len(grams("gamma delta"))}
    assert seen["fr"] == 30 * n["fr"] and 800 < seen["en"] / n["en"] < 1200
