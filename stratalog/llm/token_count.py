"""Token counts from distinct pre-tokens.

In the piece model no piece continues past a space, so a text's pieces are those of its pre-tokens (a run of
spaces and what follows it). Pieces are counted once per distinct pre-token, joined to the pre-token frequencies of
each document and summed; no id list of a document is ever made:

1. tasks count in how many documents each pre-token occurs, and the counts of all tasks meet by pre-token; those of
   two documents or more are encoded and written with their number of pieces: the dictionary;
2. the join. The dictionary's most frequent entries, ``broadcast_pretokens`` at most, go to all workers, together with
   a Bloom filter of the others. A document's pre-token that neither has occurs nowhere else and is encoded where
   it stands; one that only the filter has goes by shuffle, with its frequency, to the dictionary's other entries;
3. what came by shuffle is summed per document and added.

So what is broadcast is bounded, texts never shuffle, and of the pairs (document, pre-token) only those of pre-tokens
that are neither frequent nor unique do. The filter has at most ``max_filter_bits``: beyond some 100 million entries its false hits
grow, and with them the pairs of unique pre-tokens that shuffle too.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from ._util import documents, id_type, ship, texts, written

#: Distinct pre-tokens that a task holds before it hands its counts on.
HELD_PRETOKENS = 400_000
BROADCAST_PRETOKENS = 400_000

_RUNS = re.compile(r" *[^ ]+| +")
_state: dict = {}


def pretokens(text: str) -> list[str]:
    """Pre-tokens, each without its first space, which the model puts in front of what it encodes."""
    if not text:
        return []
    if "▁" in text:
        text = text.replace("▁", " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [x[1:] for x in _RUNS.findall(" " + text)]


def _pieces(path: str, words: list[str]) -> list[int]:
    """Numbers of pieces; the empty pre-token is a last space alone, which the model would drop by itself."""
    if _state.get("path") != path:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        _state.update(path=path, model=model, last=len(model.encode("a ")) - len(model.encode("a")))
    got: list[int] = []
    for i in range(0, len(words), 4096):
        got += map(len, _state["model"].encode(words[i : i + 4096], num_threads=1))
    return [n if w else _state["last"] for w, n in zip(words, got)]


def _spread(held: int):
    def rows(c):
        words, n = list(c), list(c.values())
        for i in range(0, len(words), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 65536], pa.string()), pa.array(n[i : i + 65536], pa.int64())], ["w", "docs"])

    def run(batches):
        c: Counter = Counter()
        for b in batches:
            for t in texts(b.column(0)):
                c.update(set(pretokens(t)))
                if len(c) >= held:
                    yield from rows(c)
                    c.clear()
        yield from rows(c)

    return run


def _encode(path: str):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_pieces(path, b.column(0).to_pylist()), pa.int64())], ["w", "docs", "n"])

    return run


def dictionary(rows: DataFrame, model_path: str, held: int = HELD_PRETOKENS) -> DataFrame:
    """Pre-tokens of two or more rows of ``rows`` (a column ``text``): w, docs, n (pieces), each encoded once."""
    seen = rows.select("text").mapInArrow(_spread(held), "w string, docs long").groupBy("w").agg(F.sum("docs").alias("docs"))
    return written(seen.filter("docs > 1").mapInArrow(_encode(model_path), "w string, docs long, n long"), "pretokens")


#: Slices in which ``cut_at`` counts at once.
SLICES = 1024


def cut_at(words: DataFrame, most: int) -> tuple[int, int, int]:
    """The least number of documents from which on ``words`` has at most ``most`` entries, how many these are, and all entries.

    Counts in ``SLICES`` slices of the numbers, then in slices of the one in which the limit falls, until slices are single numbers.
    """
    top, n = words.agg(F.coalesce(F.max("docs"), F.lit(0)), F.count(F.lit(1))).first()
    lo, hi, held = 0, top + 1, 0
    while lo < hi:
        step = -(-(hi - lo) // SLICES)
        slices = words.filter((F.col("docs") >= lo) & (F.col("docs") < hi)).groupBy(F.floor((F.col("docs") - lo) / step).alias("k")).count()
        full = None
        for r in sorted(slices.collect(), key=lambda r: -r["k"]):
            if held + r["count"] > most:
                full = r["k"]
                break
            held += r["count"]
        if full is None:
            return lo, held, n
        lo, hi = lo + full * step, min(hi, lo + (full + 1) * step)
        if step == 1:
            return hi, held, n
    return hi, held, n


def _join(path: str, shared, limit_rows: int = 512):
    name = uuid.uuid4().hex  # workers live on and keep the dictionary

    def run(batches):
        from pyspark import TaskContext

        if _state.get("shared") != name:
            words, counts, raw = shared.value
            _state.update(shared=name, known=dict(zip(words.to_pylist(), counts.tolist())), rare=raw)
        known, rare = _state["known"], _state["rare"]
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for lo in range(0, b.num_rows, limit_rows):
                part = b.slice(lo, limit_rows)
                block = texts(part.column(1))
                total, other = [], []  # (row of the block, pre-token, frequency)
                for i, t in enumerate(block):
                    n = 0
                    for w, f in Counter(pretokens(t)).items():
                        k = known.get(w)
                        if k is None:
                            other.append((i, w, f))
                        else:
                            n += k * f
                    total.append(n)
                left: list[list] = [[] for _ in block]
                if other:
                    maybe = bloom.maybe(rare, [w for _, w, _ in other]).tolist()
                    alone = [x for x, m in zip(other, maybe) if not m]
                    for (i, _, f), k in zip(alone, _pieces(path, [w for _, w, _ in alone])):
                        total[i] += k * f
                    for (i, w, f), m in zip(other, maybe):
                        if m:
                            left[i].append({"w": w, "f": f})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(row, row + len(block)), pa.int64()), part.column(0), pa.array([len(t.encode()) for t in block], pa.int64()), pa.array(total, pa.int64()), pa.array(left, _LEFT)],
                    ["row", "id", "n_bytes", "n", "other"],
                )
                row += len(block)

    return run


_LEFT = pa.list_(pa.struct([("w", pa.string()), ("f", pa.int64())]))


def _fill(path: str):
    """Pieces of a row's pre-token times its frequency; one the dictionary lacks (a false hit of the filter) is encoded here."""

    def run(batches):
        for b in batches:
            n = b.column(3).to_pylist()
            lack = [k for k, x in enumerate(n) if x is None]
            words = b.column(1).take(pa.array(lack, pa.int64())).to_pylist()
            for k, x in zip(lack, _pieces(path, words)):
                n[k] = x
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x * f for x, f in zip(n, b.column(2).to_pylist())], pa.int64())], ["row", "n"])

    return run


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", broadcast_pretokens: int = BROADCAST_PRETOKENS, max_filter_bits: int = bloom.MAX_BITS, held_pretokens: int = HELD_PRETOKENS) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for each row of ``docs``, over whole texts.

    ``model_path``: a sentencepiece BPE model with identity normalisation, found on every worker. A null or empty
    text has 0 bytes and 0 tokens. Repeated rows give repeated results; other columns are not read; an empty
    table gives an empty result. The three sizes bound memory and decide how much shuffles, never a count.
    """
    spark = docs.sparkSession
    ship(spark)
    two = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    words = dictionary(two, model_path, held_pretokens)
    least, held, n = cut_at(words, broadcast_pretokens)
    top = words.filter(F.col("docs") >= least).select("w", "n").toArrow()
    rare = words.filter(F.col("docs") < least)
    shared = spark.sparkContext.broadcast((top.column("w").combine_chunks(), top.column("n").to_numpy(), bloom.of(rare.select("w"), n - held, max_filter_bits)))
    kind = id_type(docs, id_col)
    part = written(two.mapInArrow(_join(model_path, shared), f"row long, id {kind}, n_bytes long, n long, other array<struct<w:string,f:long>>"), "counted")
    other = part.select("row", F.explode("other").alias("x")).select("row", "x.w", "x.f")
    more = other.join(rare.select("w", F.col("n").alias("k")), "w", "left").select("row", "w", "f", "k").mapInArrow(_fill(model_path), "row long, n long")
    more = more.groupBy("row").agg(F.sum("n").alias("more"))
    total = F.col("n") + F.coalesce("more", F.lit(0))
    return part.drop("other").join(more, "row", "left").select(F.col("id").alias(id_col), "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))


def query(spark, sf_dir):
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
