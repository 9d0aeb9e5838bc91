"""Alignment of two tokenizers' tokens over the same bytes, and how many documents link each pair of ids.

Tokens of both are laid over the text's bytes. Where both end, a group ends; two tokens are linked if their bytes overlap.

1. Tasks align the documents, write the alignments, and in how many of theirs each pair of ids is linked.
2. The distinct pairs get a minimal perfect hash (``phf``), built in segments. Tasks add the written numbers into dense
   vectors indexed by the hash, and these are summed in a tree, ``FAN`` at a time.
3. The written alignments are read: a group's text and the tokens' lengths give its links, and each looks its pair's number up,
   once for each group that a task meets; the pair stored at an index is compared, so a pair that the hash does not know
   cannot take another's number. No text is given to the tokenizers again.

A hash has at most ``max_pairs`` pairs. Where the corpus has more, the pairs are cut into ranges of A's ids (all pairs of
an id stay together, since its best one is asked for), and step 3 runs once for each range; the sums of the ranges
are joined by the digest of the alignment.

Both tokenizers cut at a space that follows a character other than white space, so a text's alignment is put together from
those of its chunks, and a worker keeps what it has computed for up to ``max_chunks`` of them; beyond that, those that more than one
block of texts had stay. A text of which a chunk does not give its bytes back is aligned as a whole.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from itertools import chain, compress, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import phf
from ._util import documents, id_type, ship, written
from .packing import _byte_chars

MAX_PAIRS = 1 << 22
MAX_CHUNKS = 250_000
#: Distinct pairs that a task holds before it writes their numbers; distinct groups of which a worker keeps the sums.
HELD_PAIRS = 400_000
#: Vectors that are added in one place, and counts of a vector's block.
FAN, BLOCK = 32, 4096
#: Bytes of text that a task aligns at once, if that is more than one text.
BLOCK_BYTES = 1 << 20
#: Bytes of an Arrow batch to a worker. Groups are some four times as long as their texts: with the default of 64 MB an executor
#: came to 3540 MB in a second run over 0.5 GB, with this to 2063.
BATCH_BYTES = 2 << 20

_SPACES = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)").fullmatch
_state: dict = {}


def chunks(text: str) -> list[str]:
    """The chunks of a space and ``text``, each without its first space."""
    if not _SPACES.search(" " + text):
        return text.split(" ")
    return [c[1:] for c in _CUT.split(" " + text)]


def groups_and_links(a: list[int], a_len: list[int], b: list[int], b_len: list[int]) -> tuple[int, str, list[int]]:
    """Number of groups, their text, and the links as a * 2**32 + b, of tokens (ids and lengths) that cover the same bytes."""
    groups, links, i, j, left, right, i0, j0 = [], [], 0, 0, a_len[0], b_len[0], 0, 0
    while True:
        links.append(a[i] << 32 | b[j])
        if left == right:
            i, j = i + 1, j + 1
            groups.append(f"{a[i0]}|{b[j0]}" if i - i0 == 1 == j - j0 else ",".join(map(str, a[i0:i])) + "|" + ",".join(map(str, b[j0:j])))
            if i == len(a):
                return len(groups), ";".join(groups), links
            i0, j0, left, right = i, j, a_len[i], b_len[j]
        elif left < right:
            right -= left
            i += 1
            left = a_len[i]
        else:
            left -= right
            j += 1
            right = b_len[j]


class Aligner:
    """Alignments of texts by two tokenizer files: A of `tokenizers` (byte-level BPE), B of sentencepiece.

    Chunks have numbers; arrays by number hold their sizes and where their links stand in one long list of pair numbers.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.model, chars = self.a.model, _byte_chars()
        self.shown, byte = str.maketrans({k: c for k, c in enumerate(chars)}), {c: k for k, c in enumerate(chars)}
        self.a_bytes = {k: bytes([byte[c] for c in t]) if all(c in byte for c in t) else b"" for t, k in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        with open(a_path, encoding="utf-8") as f:
            settings = json.load(f)
        plain = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        #: whether both cut before a space that follows another character
        self.chunked = settings["normalizer"] is None and settings["pre_tokenizer"] == plain and not any("▁" in p.lstrip("▁") for p in pieces)
        top = max(self.a_bytes) + 1
        self.a_len = np.array([len(self.a_bytes.get(k, b"")) for k in range(top)], np.int64)
        self.b_len = np.array([len(t) for t in self.b_bytes], np.int64)
        self.signs: dict[str, list[int]] = {}
        last = self.b.encode(["a ", "a"])
        self.last = last[0][len(last[1]) :]  # a space alone, which B would drop
        self.pairs: dict[int, int] = {}  # a * 2**32 + b to the pair's number
        self.forget()

    def forget(self) -> None:
        """Starts afresh."""
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes, self.links = array("q"), array("q")  # n_a, n_b, n_groups, n_links of each chunk; zeros: does not give its bytes back
        self.met = np.zeros(0, np.int64)  # how many blocks had each chunk
        self.pairs.clear()
        self.said: list[str] = []  # each pair as the text of a group

    def _thin(self, max_chunks: int) -> None:
        """Keeps the chunks that more than one block had, or none if they are too many; the pairs keep their numbers."""
        keep = self.met > 1
        if keep.sum() > max_chunks * 3 // 4:
            keep[:] = False
        sizes, held = np.array(self.sizes, np.int64).reshape(-1, 4), keep.tolist()
        self.links = array("q", np.array(self.links, np.int64)[np.repeat(keep, sizes[:, 3])].tobytes())
        self.sizes = array("q", sizes[keep].tobytes())
        self.groups = list(compress(self.groups, held))
        self.number = {c: k for k, c in enumerate(compress(self.number, held))}
        self.met = np.ones(len(self.groups), np.int64)

    def _align(self, text: str, a: list[int], b: list[int]):
        """(n_a, n_b, n_groups, groups, links), or None if the tokens' bytes are not the text's."""
        of_a, of_b = self.a_bytes, self.b_bytes
        x, y, want = [of_a[k] for k in a], [of_b[k] for k in b], (" " + text).encode("utf-8", "surrogatepass")
        if b"".join(x) != want or b"".join(y) != want:
            return None
        if len(a) == 1 == len(b):
            return 1, 1, 1, f"{a[0]}|{b[0]}", [a[0] << 32 | b[0]]
        n, groups, links = groups_and_links(a, list(map(len, x)), b, list(map(len, y)))
        return len(a), len(b), n, groups, links

    def links_of(self, group: str) -> list[int]:
        """The links of one group as they were when its text was made."""
        a, b = ([*map(int, x.split(","))] for x in group.split("|"))
        if len(a) == 1 == len(b):
            return [a[0] << 32 | b[0]]
        return groups_and_links(a, self.a_len[a].tolist(), b, self.b_len[b].tolist())[2]

    def _model(self, text: str) -> list[int]:
        return [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.shown))]

    def _ids(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Both tokenizers' ids of each part, a space before it."""
        a: list = [None] * len(parts)
        if self.chunked:
            # a space and Latin letters are one pre-token of A, signs after them another, so its model can take them at once;
            # letters of ASCII stand for themselves there
            tokenize, space = self.model.tokenize, " ".translate(self.shown)
            for k, p in enumerate(parts):
                if (ascii := p.isascii()) and p.isalpha():
                    a[k] = [t.id for t in tokenize(space + p)]
                elif m := _WORD(p):
                    a[k] = [t.id for t in tokenize(space + m[1])] if ascii else self._model(" " + m[1])
                    if sign := m[2]:
                        if sign not in self.signs:
                            self.signs[sign] = self._model(sign)
                        a[k] = a[k] + self.signs[sign]
        rest = [k for k, x in enumerate(a) if x is None]
        for k, e in zip(rest, self.a.encode_batch_fast([" " + parts[k] for k in rest], add_special_tokens=False)):
            a[k] = e.ids
        b = self.b.encode(parts, num_threads=1)
        return a, [y if p else self.last for p, y in zip(parts, b)]

    def _encode(self, parts: list[str]) -> list:
        return [self._align(p, x, y) for p, x, y in zip(parts, *self._ids(parts))]

    def learn(self, parts: list[str], max_chunks: int) -> None:
        """Aligns those of a block's chunks that are not known yet."""
        if len(self.number) > max_chunks:
            self._thin(max_chunks)
        new = list(set(parts).difference(self.number))
        for lo in range(0, len(new), 4096):
            self._learn(new[lo : lo + 4096])

    def _learn(self, parts: list[str]) -> None:
        """All chunks laid over one line of bytes; tokens of both sides that end in one place end a group."""
        a, b = self._ids(parts)
        length = np.array([1 + (len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass"))) for p in parts], np.int64)
        flat = [np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b)]
        n_a, n_b = (np.array([*map(len, x)], np.int64) for x in (a, b))
        line = (" " + " ".join(parts)).encode("utf-8", "surrogatepass")
        if b"".join(map(self.a_bytes.__getitem__, flat[0].tolist())) != line or b"".join(map(self.b_bytes.__getitem__, flat[1].tolist())) != line:
            good = np.array([b"".join(map(self.a_bytes.__getitem__, x)) == (" " + p).encode("utf-8", "surrogatepass") == b"".join(map(self.b_bytes.__getitem__, y)) for p, x, y in zip(parts, a, b)])
        else:
            good = np.ones(len(parts), bool)
            for ids, n, size in zip(flat, (n_a, n_b), (self.a_len, self.b_len)):
                ends = np.append(0, np.cumsum(size[ids]))[np.cumsum(n)]
                good &= (ends == np.cumsum(length)) & (n > 0)
        if not good.all():
            flat = [ids[np.repeat(good, n)] for ids, n in zip(flat, (n_a, n_b))]
            n_a, n_b, length = (np.where(good, x, 0) for x in (n_a, n_b, length))
        end_a, end_b = np.cumsum(self.a_len[flat[0]]), np.cumsum(self.b_len[flat[1]])
        at_a, at_b = np.zeros((2, length.sum() + 1), bool)  # where tokens end
        at_a[end_a], at_b[end_b] = True, True
        place = np.flatnonzero(at_a | at_b)
        ends_a, ends_b = at_a[place], at_b[place]
        of_a, of_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b  # the tokens that each link is of
        keys = flat[0][of_a] << 32 | flat[1][of_b]
        chunk = np.repeat(np.arange(len(parts)), length)[place - 1]
        last = np.flatnonzero(ends_a & ends_b)  # links that end a group
        n_groups = np.bincount(chunk[last], minlength=len(parts))
        n_links = np.bincount(chunk, minlength=len(parts))
        some, at = np.unique(keys, return_inverse=True)
        pairs, said = self.pairs, self.said
        numbers = np.array([pairs.setdefault(k, len(pairs)) for k in some.tolist()], np.int64)[at]
        said += [f"{k >> 32}|{k & 0xFFFFFFFF}" for k in islice(pairs, len(said), None)]
        self.links.frombytes(numbers.tobytes())
        self.sizes.frombytes(np.stack([n_a, n_b, n_groups, n_links], axis=1).tobytes())
        first = len(self.groups)
        self.number.update(zip(parts, range(first, first + len(parts))))
        # groups of one token each way, the most by far, have one link
        start = np.append(0, last[:-1] + 1) if len(last) else last
        told = list(map(said.__getitem__, numbers[start].tolist()))
        more = np.flatnonzero(last > start)
        for k, i, j, m, n in zip(more.tolist(), *((x[y[more]] + z).tolist() for x in (of_a, of_b) for y, z in ((start, 0), (last, 1)))):
            told[k] = ",".join(map(str, flat[0][i:j].tolist())) + "|" + ",".join(map(str, flat[1][m:n].tolist()))
        till = np.cumsum(n_groups).tolist()
        self.groups += [";".join(told[i:j]) for i, j in zip([0, *till], till)]

    def block(self, texts: list[str], max_chunks: int) -> "Block":
        cut = [(chunks(t) if self.chunked else [t]) if t else [] for t in texts]
        flat = list(chain.from_iterable(cut))
        self.learn(flat, max_chunks)
        ids = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        self.met = np.append(self.met, np.zeros(len(self.groups) - len(self.met), np.int64)) + (np.bincount(ids, minlength=len(self.groups)) > 0)
        return Block(self, texts, [len(c) for c in cut], ids)


def _distinct(x: np.ndarray) -> np.ndarray:
    """``np.unique`` by sorting, which is faster here."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class Block:
    """Some texts as chunk numbers. ``odd``: texts with a chunk that does not give its bytes back, aligned as wholes or not at all."""

    def __init__(self, al: Aligner, texts: list[str], n: list[int], ids: np.ndarray):
        self.al, self.n_texts = al, len(texts)
        doc = np.repeat(np.arange(len(texts)), n)
        self.sizes = np.array(al.sizes, np.int64).reshape(-1, 4)
        self.start = np.cumsum(self.sizes[:, 3]) - self.sizes[:, 3]
        self.odd, self.groups = {}, al.groups
        bad = np.unique(doc[self.sizes[ids, 0] == 0])
        for k in bad.tolist():
            got = al._encode([texts[k]])[0]
            self.odd[k] = got and (*got[:4], np.array([al.pairs.setdefault(x, len(al.pairs)) for x in got[4]], np.int64))
        keep = ~np.isin(doc, bad)
        self.doc, self.ids = doc[keep], ids[keep]

    def _pairs(self, doc: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.sizes[ids, 3]
        at = np.arange(n.sum()) + np.repeat(self.start[ids] - np.cumsum(n) + n, n)
        return np.repeat(doc, n), np.frombuffer(self.al.links, np.int64)[at]

    def held(self) -> np.ndarray:
        """For each pair number how many of the texts hold it."""
        width, k = len(self.al.pairs), len(self.sizes)
        once = _distinct(self.doc * k + self.ids)
        doc, pair = self._pairs(once // k, once % k)
        n = np.bincount(_distinct(doc * width + pair) % width if len(doc) else pair, minlength=width)
        for got in self.odd.values():
            if got:
                n[np.unique(got[4])] += 1
        return n

    def rows(self) -> list:
        """n_a, n_b, n_groups, n_links and groups of each text."""
        out = [np.bincount(self.doc, self.sizes[self.ids, k], self.n_texts).astype(np.int64) for k in range(4)]
        text, at = [self.groups[k] for k in self.ids.tolist()], np.searchsorted(self.doc, np.arange(self.n_texts + 1)).tolist()
        groups = [";".join(text[lo:hi]) for lo, hi in zip(at, at[1:])]
        for k, got in self.odd.items():
            if got:
                for c, v in zip(out, (*got[:3], len(got[4]))):
                    c[k] = v
                groups[k] = got[3]
        return [*out, groups]


#: Columns of the written alignments after the document's id.
ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "groups", "key", "n"]


def _blocks(batches, col: int):
    """(batch, from, texts) in blocks of bounded bytes."""
    for b in batches:
        block, first, size = [], 0, 0
        for i, t in enumerate(b.column(col)):
            t = t.as_py() or ""
            if block and size + len(t) > BLOCK_BYTES:
                yield b, first, block
                block, first, size = [], i, 0
            block.append(t)
            size += len(t)
        if block:
            yield b, first, block


def _aligner(paths: tuple[str, str]) -> Aligner:
    if _state.get("paths") != paths:
        _state.update(paths=paths, aligner=Aligner(*paths))
    return _state["aligner"]


def _alignments(paths: tuple[str, str], held: int, max_chunks: int):
    """``ALIGNED``: a row for each document, and rows (others have no ``n``) of pairs with their numbers of the task's documents."""

    def batch(cols: dict) -> pa.RecordBatch:
        size = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([cols.get(c, pa.nulls(size, t)) for c, t in kinds.items()], list(kinds))

    def rows(al: Aligner, total: np.ndarray):
        keys = np.fromiter(al.pairs.keys(), np.int64, len(al.pairs))
        some = np.flatnonzero(total)
        for i in range(0, len(some), 65536):
            at = some[i : i + 65536]
            yield batch({"key": pa.array(keys[at]), "n": pa.array(total[at])})

    kinds: dict = {}

    def run(batches):
        al, total = _aligner(paths), np.zeros(0, np.int64)
        for k in ("shared", "counts", "number", "sums"):
            _state.pop(k, None)
        for b, first, texts_ in _blocks(batches, 1):
            kinds.update({"id": b.column(0).type} | dict.fromkeys(ALIGNED, pa.int64()) | {"groups": pa.string()})
            block = al.block(texts_, max_chunks)
            *sizes, groups = block.rows()
            yield batch({"id": b.column(0).slice(first, len(texts_))} | dict(zip(ALIGNED, [*map(pa.array, sizes), pa.array(groups, pa.string())])))
            n = block.held()
            n[: len(total)] += total
            total = n
            if len(total) > held:
                yield from rows(al, total)
                al.forget()
                total = np.zeros(0, np.int64)
        yield from rows(al, total)

    return run


def _dense(shared):
    """This task's numbers as blocks of the vector that the hash indexes."""

    def run(batches):
        from pyspark import TaskContext

        table = shared.value
        v = np.zeros(-(-len(table) // BLOCK) * BLOCK, np.int64)
        for b in batches:
            at, n = table.find(b.column(0).to_numpy()), b.column(1).to_numpy()
            np.add.at(v, at[at >= 0], n[at >= 0])
        used = np.flatnonzero(v.reshape(-1, BLOCK).any(1))
        for k in used.tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([v[k * BLOCK : (k + 1) * BLOCK].tobytes()], pa.binary())], ["block", "task", "v"])

    return run


def _add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("v"))
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "task": pa.array([key[1].as_py()], pa.int64()), "v": pa.array([total.tobytes()], pa.binary())})


def tree_sum(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of vectors of ``size`` given as (block, task, v), ``FAN`` tasks' at a time; only the last sum comes to the driver."""
    rows = written(rows, "vectors")
    while True:
        tasks = rows.agg(F.max("task")).first()[0] or 0
        if not tasks:
            break
        rows = written(rows.select("block", F.floor(F.col("task") / FAN).cast("long").alias("task"), "v").groupBy("block", "task").applyInArrow(_add, "block long, task long, v binary"), "vectors")
    out = np.zeros(-(-size // BLOCK) * BLOCK, np.int64)
    for r in rows.collect():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["v"], np.int64)
    return out[:size]


class Counts:
    """A range of pairs with their numbers of documents, and whether each is a best one of its A id."""

    def __init__(self, table: phf.Table, n: np.ndarray):
        self.table, self.n = table, n
        a = table.keys >> 32
        best = np.zeros(int(a.max()) + 1 if len(a) else 0, np.int64)
        np.maximum.at(best, a, n)
        self.best = n == best[a]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pair is a best one (0 or 1), and its number; zeros for pairs outside the range."""
        at = self.table.find(keys)
        known = at >= 0
        return np.where(known, self.best[at] if len(self.best) else False, False).astype(np.int64), np.where(known, self.n[at] if len(self.n) else 0, 0)


def _look_up(paths: tuple[str, str], shared, held: int):
    name = uuid.uuid4().hex  # workers live on and keep what they know

    def run(batches):
        al = _aligner(paths)
        if _state.get("shared") != name:
            al.forget()
            _state.update(shared=name, counts=shared.value, number={}, sums=np.zeros((2, 0), np.int64))
        counts, number = _state["counts"], _state["number"]
        for b, first, texts_ in _blocks(batches, 5):
            cut = [t.split(";") if t else [] for t in texts_]
            flat = list(chain.from_iterable(cut))
            if len(number) > held:
                number.clear()
                _state["sums"] = np.zeros((2, 0), np.int64)
            if new := list(set(flat).difference(number)):
                links = [*map(al.links_of, new)]
                at = np.cumsum([0, *map(len, links[:-1])])
                sums = [np.add.reduceat(v, at) for v in counts.of(np.fromiter(chain.from_iterable(links), np.int64))]
                number.update(zip(new, range(len(number), len(number) + len(new))))
                _state["sums"] = np.concatenate([_state["sums"], sums], axis=1)
            ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
            till = np.cumsum([0, *map(len, cut)])
            total = [np.append(0, np.cumsum(v[ids]))[till] for v in _state["sums"]]
            own = [c.slice(first, len(texts_)) for c in b.columns]
            yield pa.RecordBatch.from_arrays([*own[:5], *(pa.array(np.diff(v)) for v in total), own[5]], ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    return run


def _ranges(pairs: DataFrame, max_pairs: int) -> list[tuple[int, int, int]]:
    """(first A id, end, pairs) of each range; the numbers for each id are bounded by A's vocabulary."""
    out, lo, n = [], 0, 0
    for r in pairs.groupBy((F.shiftright("key", 32)).alias("a")).count().orderBy("a").collect():
        if n and n + r["count"] > max_pairs:
            out.append((lo, r["a"], n))
            lo, n = r["a"], 0
        n += r["count"]
    return [*out, (lo, 1 << 31, n)]


def counted(partial: DataFrame, max_pairs: int = MAX_PAIRS):
    """The ``Counts`` of each range of pairs of ``partial`` (key, n), in turn."""
    pairs = written(partial.select("key").distinct(), "pairs")
    for lo, hi, n in _ranges(pairs, max_pairs):
        own = F.col("key").between(lo << 32, (hi << 32) - 1)
        table = phf.of(pairs.filter(own), n)
        shared = partial.sparkSession.sparkContext.broadcast(table)
        yield Counts(table, tree_sum(partial.filter(own).mapInArrow(_dense(shared), "block long, task long, v binary"), len(table)))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", max_pairs: int = MAX_PAIRS, max_chunks: int = MAX_CHUNKS, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (``a1,a2|b1;a3|b2``) for each row of ``docs``.

    ``a_path``: a byte-level BPE file of `tokenizers`, which gets a space and the text; ``b_path``: a sentencepiece model, which
    adds the space itself; both on every worker. Texts that are null or empty, or whose tokens of either side do not
    give the bytes of a space and the text, have no tokens: zeros and ''. Repeated rows are counted and returned
    each for itself, null ids too; other columns are not read; an empty table gives an empty result. The three sizes
    bound memory, never a number.
    """
    spark, paths = docs.sparkSession, (a_path, b_path)
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # the session chose no size
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    two = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sizes = f"id {id_type(docs, id_col)}, n_a long, n_b long, n_groups long, n_links long"
    aligned = written(two.mapInArrow(_alignments(paths, held_pairs, max_chunks), f"{sizes}, groups string, key long, n long"), "alignments", "zstd")
    partial = written(aligned.filter("n is not null").select("key", "n"), "links")
    own = aligned.filter("n is null").drop("key", "n")
    first, *more = [own.mapInArrow(_look_up(paths, spark.sparkContext.broadcast(c), held_pairs), f"{sizes}, n_best long, count_sum long, groups string") for c in counted(partial, max_pairs)]
    if more:  # equal alignments have equal sums, so one of each is enough
        sums = [x.filter("n_links > 0").groupBy(F.sha2("groups", 256).alias("digest")).agg(F.max("n_best").alias("b"), F.max("count_sum").alias("s")) for x in more]
        rest = sums[0]
        for x in sums[1:]:
            rest = rest.unionByName(x)
        rest = rest.groupBy("digest").agg(F.sum("b").alias("b"), F.sum("s").alias("s"))
        first = first.join(rest, F.sha2("groups", 256) == F.col("digest"), "left").withColumns({"n_best": F.col("n_best") + F.coalesce("b", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("s", F.lit(0))}).drop("digest", "b", "s")
    return first.withColumnRenamed("id", id_col)


def query(spark, sf_dir):
    import public_tokenizers

    got = align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return got.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
