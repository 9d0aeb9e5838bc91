import pytest

P = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402

from stratalog.llm.token_count import cut_at, dictionary, token_counts  # noqa: E402

PATH = P.path("piece_bpe_32k.model")


def brute(rows, limit=4096):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    out = []
    for i, t in rows:
        n = len(sp.encode(t or ""))
        out.append((i, len((t or "").encode()), n, n > limit))
    return out


ODD = ["", None, " ", "   ", "a", " a", "a ", "  a  b   ", "x\n\ny", "\n", " \n ", "▁a▁▁b", "<s> </s> <unk>", "日本語 テキスト", "a b", "🙂🙂 x", "tab\there  two", "é" * 50, "word " * 6000, "k" * 5000, "\x00 a\x01b", "1234567 89"]


def test_odd_texts(spark):
    rows = [*enumerate(ODD), (3, ODD[3]), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as id")
    got = [tuple(r) for r in token_counts(df, PATH).collect()]
    key = lambda r: (r[0] is None, r[0], r[1:])
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_sizes_change_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    small = dict(broadcast_pretokens=300, held_pretokens=1000)
    for more in ({}, small, small | {"max_filter_bits": 1 << 20}, {"broadcast_pretokens": 0, "max_filter_bits": 1 << 10}):
        assert sorted(map(tuple, token_counts(docs, PATH, **more).collect())) == sorted(brute(rows)), more


def test_pretokens_are_counted_once_in_all(spark):
    rows = [(k, f"common word{k % 3} only{k} only{k}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.w: (r.docs, r.n) for r in dictionary(df, PATH, held=2).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert {w: d for w, (d, _) in got.items()} == {"common": 40, "word0": 14, "word1": 13, "word2": 13}
    assert all(n == len(sp.encode(w)) for w, (_, n) in got.items())


def test_the_broadcast_part_is_bounded_however_frequent(spark):
    """Words in more documents than any fixed number: the cut is exact."""
    docs = [*range(1, 40), *[1500] * 300, 70_000, 3_000_000_000]
    words = spark.createDataFrame([(str(k), n) for k, n in enumerate(docs)], "w string, docs long")
    for most in (0, 1, 2, 5, 301, 302, 310, 341, 10_000):
        least, held, n = cut_at(words, most)
        assert n == len(docs) and held == sum(d >= least for d in docs) <= most
        assert least <= 1 or held + sum(d == max(x for x in docs if x < least) for d in docs) > most
    assert cut_at(words.limit(0), 5)[1:] == (0, 0)
    rows = [(k, " ".join(f"w{j}" for j in range(30)) + f" own{k}") for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert cut_at(dictionary(df, PATH), 5)[1] == 0
    assert sorted(map(tuple, token_counts(df, PATH, broadcast_pretokens=5).collect())) == sorted(brute(rows))


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
