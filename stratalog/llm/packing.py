"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents are tokenised where they are read and leave as one narrow row per piece; texts and ids never
shuffle. Piece rows are dealt in turn over packing tasks. Each runs an online best fit over a fixed number of
open bins, kept in stacks by free space with one bitset (a Python integer) that tells which stacks have
bins: the tightest bin that fits is the lowest set bit from the piece's length on. When one bin too many is
open, the fullest closes.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import documents, id_type, ship

#: Rows that a packing task gets, about. Each task leaves its open bins as they are at its end.
ROWS_PER_TASK = 400_000
OPEN_BINS = 2048
#: Entries of a worker's dictionary of chunks, some 150 bytes each; beyond them it starts afresh.
MAX_CHUNKS = 200_000

# The tokenizer settings whose pre-tokens the dictionary below knows.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]*")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_state: dict = {}


def _byte_chars() -> list[str]:
    """The printable character that byte-level BPE writes for each byte: itself if visible, else one from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def splits_at_spaces(settings: dict) -> bool:
    """Whether a tokenizer file's settings are those for which a text's ids are those of its chunks."""
    first, *rest = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    plain = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    cut = {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}
    marks = [t["content"] for t in settings.get("added_tokens", [])]
    whole = [settings.get(k) for k in ("truncation", "padding", "post_processor")]
    return settings.get("normalizer") == _NORMALIZER and first == cut and rest == [plain] and whole == [None] * 3 and all("<|" in m and not re.search(r"\s", m) for m in marks)


class _Known(dict):
    """A dictionary that makes what it misses."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        return self.make(key)


class ChunkEncoder:
    """Ids of texts, by a dictionary from white-space-free chunks to packed little-endian ids.

    No pre-token of the tokenizer spans white space, so a text's ids are those of its chunks. A chunk of plain
    Latin letters, digits and ASCII signs is split into pre-tokens, each given to the tokenizer's model once; any
    other chunk goes to the tokenizer whole. That holds for tokenizers with the settings above; with others every text
    goes to the tokenizer whole.
    """

    def __init__(self, path: str, max_chunks: int = MAX_CHUNKS):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model, self.max_chunks = self.tok.model, max_chunks
        with open(path, encoding="utf-8") as f:
            self.chunked = splits_at_spaces(json.load(f))
        self.chunks, self.pieces, self.chars = _Known(self._chunk), {}, _byte_chars()

    def _pack(self, ids) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, word: str) -> bytes:
        got = self.pieces.get(word)
        if got is None:
            chars = self.chars
            shown = word if word.isascii() else "".join([chars[b] for b in word.encode()])  # ASCII signs are visible
            got = self.pieces[word] = self._pack([t.id for t in self.model.tokenize(shown)])
        return got

    def _chunk(self, raw: bytes) -> bytes:
        s, word = raw.decode("utf-8", "replace"), raw.rstrip(b".,;:!?")
        if word.isalpha():  # ASCII letters are one pre-token, signs after them another
            n = len(word)
            got = self._piece(s[:n].lower()) + (self._piece(s[n:]) if s[n:] else b"")
        elif _SIMPLE.fullmatch(s) and "<|" not in s:
            got = b"".join([self._piece(w) for w in _WORDS.findall(s.lower())])
        else:
            got = self._pack(self.tok.encode(s, add_special_tokens=False).ids)
        self.chunks[raw] = got
        return got

    def encode(self, text: str) -> bytes:
        """Packed little-endian unsigned 32-bit ids of a text."""
        if not self.chunked:
            return self._pack(self.tok.encode(text, add_special_tokens=False).ids)
        if len(self.chunks) > self.max_chunks:
            self.chunks.clear()
        if len(self.pieces) > self.max_chunks:
            self.pieces.clear()
        return b"".join(map(self.chunks.__getitem__, text.encode("utf-8", "replace").split()))


def encoder(path: str, max_chunks: int) -> ChunkEncoder:
    if _state.get("path") != path:
        _state.update(path=path, enc=ChunkEncoder(path))
    _state["enc"].max_chunks = max_chunks
    return _state["enc"]


def _cut(path: str, limit: int, end_id: int, max_chunks: int):
    def run(batches):
        enc, end = encoder(path, max_chunks), np.array([end_id], "<u4").tobytes()
        width = limit * 4
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                at, piece, start, length, crc = [], [], [], [], []
                for i, t in enumerate(part.column(1)):
                    ids = enc.encode(t.as_py() or "") + end
                    for k in range(0, len(ids), width):
                        cut = ids[k : k + width]
                        at.append(i)
                        piece.append(k // width)
                        start.append(k // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )

    return run


class BestFit:
    """Online best fit over at most ``open_bins`` bins of ``limit``; ``place(n)`` gives (bin, offset)."""

    def __init__(self, limit: int, open_bins: int):
        self.limit, self.open_bins = limit, open_bins
        self.bits, self.stacks, self.n_open, self.made = 0, [[] for _ in range(limit + 1)], 0, 0

    def _take(self, free: int) -> int:
        stack = self.stacks[free]
        b = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return b

    def place(self, n: int) -> tuple[int, int]:
        fits = self.bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            free, b = self.limit, self.made
            self.made += 1
        left = free - n
        if left:
            self.stacks[left].append(b)
            self.bits |= 1 << left
            self.n_open += 1
            if self.n_open > self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        return b, self.limit - free


def _pack_task(limit: int, open_bins: int):
    def run(batches):
        from pyspark import TaskContext

        base, fit = TaskContext.get().partitionId() << 40, BestFit(limit, open_bins)
        for b in batches:
            got = [fit.place(n) for n in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([base + x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer_path: str, limit: int = 4096, end_id: int = 1, open_bins: int = OPEN_BINS, rows_per_task: int = ROWS_PER_TASK, max_chunks: int = MAX_CHUNKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; one longer than ``limit`` is cut into pieces of ``limit``, the last may be
    shorter. A null or empty text is ``end_id`` alone. Within a task pieces come in the order of a hash of their
    place, so a task that runs again packs the same. Repeated rows are packed each for itself; a null id is kept;
    an empty table gives an empty result; other columns are not read.
    """
    ship(docs.sparkSession)
    kind = id_type(docs, id_col)
    two = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = two.mapInArrow(_cut(tokenizer_path, limit, end_id, max_chunks), f"id {kind}, piece int, start long, length long, ids_crc32 long")
    tasks = max(1, -(-docs.count() // rows_per_task))
    # dealt in turn, so that repeated rows do not meet in one task
    dealt = rows.repartition(tasks).sortWithinPartitions(F.xxhash64("id", "piece", "ids_crc32"), "id", "piece")
    out = dealt.mapInArrow(_pack_task(limit, open_bins), f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def query(spark, sf_dir):
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
