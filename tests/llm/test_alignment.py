import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from stratalog.llm import alignment as A  # noqa: E402
from stratalog.llm import phf  # noqa: E402

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["", None, " ", "   ", "a", " a", "a ", "a  ", "  a  b   ", "x\n\ny", "\n", " \n ", "a \n  b", "a\n b", "▁a▁▁b", "<s> </s> <unk> <|endoftext|>", "日本語 テキスト", "é ﬁ", "  x  y", "🙂🙂 x", "tab\there  two", "é" * 50, "k" * 3000, "\x00 a\x01b\x1c c", "don't  we'll 123456 89", "unhappiness antidisestablishmentarianism " * 30]


def brute(rows):
    """From the definition, over byte positions."""
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(k): k for k in visible} | {chr(256 + n): k for n, k in enumerate(k for k in range(256) if k not in visible)}
    docs = []
    for i, t in rows:
        want = (" " + t).encode() if t else b""
        ta = [(k, bytes(chars[c] for c in a.id_to_token(k))) for k in a.encode(" " + t, add_special_tokens=False).ids] if t else []
        tb = [(k, bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()) for k in b.encode(t)] if t else []
        if b"".join(x for _, x in ta) != want or b"".join(x for _, x in tb) != want:
            ta, tb = [], []
        at = {}
        for side, toks in enumerate((ta, tb)):
            n = 0
            for k, (_, x) in enumerate(toks):
                for p in range(n, n + len(x)):
                    at.setdefault(p, [None, None])[side] = k
                n += len(x)
        links = sorted({tuple(x) for x in at.values()})
        ends = [set(np.cumsum([len(x) for _, x in toks]).tolist()) for toks in (ta, tb)]
        both, groups, lo = sorted(ends[0] & ends[1]), [], 0
        for e in both:
            got = [sorted({at[p][s] for p in range(lo, e)}) for s in (0, 1)]
            groups.append("|".join(",".join(str((ta, tb)[s][k][0]) for k in got[s]) for s in (0, 1)))
            lo = e
        docs.append((i, ta, tb, [(ta[x][0], tb[y][0]) for x, y in links], groups))
    count = Counter(p for d in docs for p in set(d[3]))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [(i, len(ta), len(tb), len(g), len(ls), sum(count[p] == best[p[0]] for p in ls), sum(count[p] for p in ls), ";".join(g)) for i, ta, tb, ls, g in docs]


def key(r):
    return r[0] is None, r[0], r[1:]


def test_odd_texts(spark):
    rows = [*enumerate(ODD), (3, ODD[3]), (4, "a"), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as groups", "2 as id", "3 as key").repartition(3)
    assert sorted(map(tuple, A.align(df, *PATHS).collect()), key=key) == sorted(brute(rows), key=key)


def test_sizes_change_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    want = sorted(brute([(r.doc_id, r.text) for r in docs.collect()]), key=key)
    for more in ({}, {"max_pairs": 700, "max_chunks": 50, "held_pairs": 100}):
        assert sorted(map(tuple, A.align(docs, *PATHS, **more).collect()), key=key) == want, more


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[1] else "") for r in brute(rows)]
    assert sorted(map(tuple, A.query(spark, sf).collect())) == sorted(want)


def test_chunks_are_where_both_cut():
    rng = random.Random(5)
    al = A.Aligner(*PATHS)
    assert al.chunked
    for _ in range(3000):
        text = "".join(rng.choice(["a", "word", " ", "  ", "\n", "\t", "é", "▁", "'s", "1", " ", "!", "\x1c", "　"]) for _ in range(rng.randrange(1, 14)))
        parts = A.chunks(text)
        assert "".join(" " + p for p in parts) == " " + text
        got = al._encode(parts)
        al.chunked = False  # the tokenizer itself
        whole = al._encode([text])[0]
        al.chunked = True
        if None not in got:
            assert whole and ";".join(x[3] for x in got) == whole[3] and sum((x[4] for x in got), []) == whole[4], repr(text)


def test_empty_table(spark):
    assert A.align(spark.createDataFrame([], "doc_id string, text string"), *PATHS).collect() == []
    nothing = spark.createDataFrame([("a", None), ("a", "")], "doc_id string, text string")
    assert sorted(map(tuple, A.align(nothing, *PATHS).collect())) == [("a", 0, 0, 0, 0, 0, 0, "")] * 2


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 100_000])
def test_minimal_perfect_hash(spark, n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 47, n))
    table = phf.of(spark.createDataFrame([(int(k),) for k in keys], "key long").repartition(3), n)
    assert len(table) == len(keys) and sorted(table.find(keys)) == list(range(len(keys)))
    others = np.setdiff1d(np.random.default_rng(n + 1).integers(0, 1 << 47, 1000), keys)
    assert (table.find(others) == -1).all()


def test_tree_of_many_tasks(spark):
    rows = [(k % 3, k, np.full(A.BLOCK, k).tobytes()) for k in range(100)]
    got = A.tree_sum(spark.createDataFrame(rows, "block long, task long, v binary"), 2 * A.BLOCK + 10)
    assert len(got) == 2 * A.BLOCK + 10
    assert [got[0], got[A.BLOCK], got[-1]] == [sum(range(k, 100, 3)) for k in range(3)]


@pytest.mark.parametrize("more", [{}, {"max_pairs": 700}])
def test_the_table_is_read_once(spark, sf, more):
    """What comes after the first pass reads the written alignments, not the texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    files = A.align(docs, *PATHS, **more).inputFiles()
    assert files and not {*files} & {*docs.inputFiles()}


def test_chunks_that_recur_stay():
    al, asked = A.Aligner(*PATHS), []
    ids = al._ids
    al._ids = lambda parts: asked.extend(parts) or ids(parts)
    often = [f"word{k}" for k in range(20)]
    for n in range(30):
        texts = [" ".join([*often, *(f"once{n}x{k}" for k in range(10))]), "", "日本語 \x00"]
        block = al.block(texts, 40)
        al.chunked = False  # the tokenizer itself
        whole = [al._encode([t])[0] if t else None for t in texts]
        al.chunked = True
        assert [list(x) for x in zip(*block.rows())] == [[*w[:3], len(w[4]), w[3]] if w else [0, 0, 0, 0, ""] for w in whole]
        assert len(al.number) == len(al.groups) == len(al.met) == len(al.sizes) // 4 <= 40 + 33
    assert asked.count("word7") == 1


def test_links_of_a_groups_text():
    al = A.Aligner(*PATHS)
    for text in filter(None, ODD):
        if got := al._encode([text])[0]:
            assert sum(map(al.links_of, got[3].split(";")), []) == got[4]


@pytest.mark.parametrize("chosen, used", [("67108864b", str(A.BATCH_BYTES)), ("1m", "1m")])
def test_batches_are_bounded_in_bytes(spark, chosen, used):
    """Groups are longer than texts; a size that the session chose is kept."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, chosen)
        A.align(spark.createDataFrame([(1, "a")], "doc_id long, text string"), *PATHS)
        assert spark.conf.get(name).removesuffix("b") == used
    finally:
        spark.conf.set(name, before)
