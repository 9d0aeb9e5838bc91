import zlib
from collections import defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from stratalog.llm.packing import BestFit, pack  # noqa: E402

PATH = P.path("word_bpe_49k.json")


def brute(rows, limit):
    tok = Tokenizer.from_file(PATH)
    out = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), limit):
            cut = np.array(ids[k : k + limit], "<u4")
            out.append((i, k // limit, k, len(cut), zlib.crc32(cut.tobytes())))
    return out


def verify(got, rows, limit):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(brute(rows, limit), key=key)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= limit
    return len(bins)


ODD = ["", None, "  ", "Hello, World's 'tis 42!", "<|endoftext|> in <|startoftext|>text", "ÀÉß ÿŒuvre", "é combining", "日本語 テキスト", "a b c\x1cd\x85e", "ΣΑΣ İstanbul", "🙂🙂x", "x" * 3000, "²½ ª º µ", "don't WE'LL i'd", "\x00\x7f", "word " * 3000]


def test_odd_texts(spark):
    rows = [*enumerate(ODD), (3, ODD[3]), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as id")
    verify(pack(df, PATH, limit=256).collect(), rows, 256)


def test_other_tokenizers_get_whole_texts(spark):
    other = P.path("byte_bpe_50k.json")
    rows = [*enumerate(ODD)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), other, limit=256).collect()
    tok = Tokenizer.from_file(other)
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    assert {(r.doc_id, r.start, r.ids_crc32) for r in got} == {(i, k, zlib.crc32(np.array(ids[k : k + 256], "<u4").tobytes())) for i, ids in want.items() for k in range(0, len(ids), 256)}


def test_repeated_rows_are_dealt_evenly(spark):
    rows = [(1, "the same text")] * 900
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pack(df, PATH, rows_per_task=300)
    per = defaultdict(int)
    for r in got.collect():
        per[r.sequence_id >> 40] += 1
    assert len(per) == 3 and max(per.values()) <= 330


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = pack(docs, PATH).collect()
    n = verify(got, rows, 4096)
    assert n <= 1.06 * -(-sum(r.length for r in got) // 4096)


def test_several_tasks_and_few_bins(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    verify(pack(docs, PATH, rows_per_task=50, open_bins=3, max_chunks=100).collect(), rows, 4096)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_fullest_closes_first():
    f = BestFit(10, 2)
    assert [f.place(n) for n in (7, 6, 5)] == [(0, 0), (1, 0), (2, 0)]  # the third open bin closes bin 0
    assert f.place(3) == (1, 6)  # bin 0 had exactly 3 left but is closed; the tightest open bin takes it


def test_letters_and_signs_are_encoded_as_by_the_tokenizer():
    from stratalog.llm.packing import ChunkEncoder

    enc, tok = ChunkEncoder(PATH, max_chunks=5), Tokenizer.from_file(PATH)
    for text in ("Word word, WORD;: x... a!?", "don't, 'll. I'd! .,;", "été. Ünï, z1. <|endoftext|>, a<|b", "...", "qzxv! " * 3, "一二. x一,"):
        assert enc.encode(text) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
