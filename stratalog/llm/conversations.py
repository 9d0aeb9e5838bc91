"""Repair of conversation structure by cheapest edits.

A conversation's rows, by turn, become role initials of the form ``(s?(ua)+)?``. Keep costs 0, Rerole (to user or
assistant) 2, Delete 3 and is forced for blank and duplicate rows, Insert (an empty user or assistant turn, anywhere)
2; a truncated row that is not deleted adds 1. Of the cheapest edits those with the ASCII-least audit (the edits'
initials) are made.

A node is a row and what may follow: nothing yet, a system, user or assistant turn. A backward cost DP finds the arcs
(edits) that lie on cheapest ways; its cost vectors differ by small numbers only, so a step is one look-up by
vector and row code. The optimal arcs are then ranked by their audits' first letter, first two, four, eight and so on:
an arc's rank for twice the letters is that of its own rank and the rank of the arc that its pointer leads to, and
pointers double too. A node goes on by its least-ranked arc (its arcs bear different letters, so a rank by one letter
tells which), the start takes the arc least by the last ranks, and the arc of every step of the audit is reached
by the doubled pointers of the step's binary digits, for all conversations of a batch at once.

Rows are range-partitioned by (conversation, turn), so a conversation of any size spreads over as many tasks as it
needs. One that lies within a partition is repaired there. Others are cut into blocks: costs through a block are a 4 x 4
matrix, scanned backwards, its ways a map of states, scanned forwards, and every block is then repaired from the state
and the costs at its ends; repeats of earlier blocks' rows are found by their digests. The scans pass one narrow row for
each block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import id_type, ship, written

#: Rows and bytes of text of a block, at most one row more.
BLOCK_ROWS = 1 << 14
BLOCK_BYTES = 4 << 20
#: Rows that are repaired at once.
BATCH_TURNS = 8192

# Edits and roles by number, white space, ends of a sentence, costs.
EDITS = "DIKR"
SPACE = " \t\n\x0b\f\r"
ENDS = ".!?"
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1

OK, BLANK, DUPLICATE, CUT = range(4)
_CLASS = {"s": 0, "u": 1, "a": 2}  # any other initial: 3
_LEGAL = {(0, 1), (1, 2), (2, 1)}
# states: nothing yet, after s, after u, after a; the state that a kept row of a class leads to, and an added turn
_KEEP = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
_ADD = [2, 2, 3, 2]
_ROLE = ["user", "user", "assistant", "user"]
_INF = 1 << 40


class Automaton:
    """The cost DP's vectors and steps as far as they have been met."""

    def __init__(self):
        self.vectors, self.ids, self.steps = [], {}, []
        self.arcs = []  # for each step: [state][edit] -> 4 * (goes to the next row) + state, or -1
        self.none = self._arcs([[-1] * 4] * 4)
        self.end, _ = self.vector(self._closed([0, _INF, _INF, 0]))
        e = self.vectors[self.end]
        self.last = self._arcs([[-1, _ADD[s] if e[s] == INSERT + e[_ADD[s]] else -1, -1, -1] for s in range(4)])

    def _arcs(self, targets) -> int:
        self.arcs.append(np.array(targets, np.int8))
        return len(self.arcs) - 1

    @staticmethod
    def _closed(v: list[int]) -> list[int]:
        """With turns inserted before the next row."""
        for _ in range(3):
            v = [min(v[s], INSERT + v[_ADD[s]], _INF) for s in range(4)]
        return v

    def vector(self, v: list[int]) -> tuple[int, int]:
        """The number of a vector and what is to be added to it."""
        low = min(v)
        key = tuple(x - low if x < _INF else _INF for x in v)
        if key not in self.ids:
            self.ids[key] = len(self.vectors)
            self.vectors.append(key)
            self.steps.append([None] * 16)
        return self.ids[key], low

    def step(self, after: int, code: int) -> tuple[int, int, int]:
        """From the costs after a row to those before it: (vector, addend, arcs)."""
        got = self.steps[after][code]
        if got is None:
            v, (cls, fault) = self.vectors[after], divmod(code, 4)
            more = TRUNCATED if fault == CUT else 0
            ways = []
            for s in range(4):
                w = [(DELETE, 4 + s), (INSERT, _ADD[s]), (_INF, -1), (_INF, -1)]
                if fault in (OK, CUT):
                    if (s, cls) in _KEEP:
                        w[2] = (more, 4 + _KEEP[s, cls])
                    w[3] = (REROLE + more, 4 + _ADD[s])
                ways.append(w)
            b = self._closed([min(min(c + v[t - 4], _INF) for c, t in w if t >= 4) for w in ways])
            cost = [*b, *v]
            arcs = self._arcs([[t if t >= 0 and b[s] < _INF and c + cost[t] == b[s] else -1 for c, t in w] for s, w in enumerate(ways)])
            got = self.steps[after][code] = (*self.vector(b), arcs)
        return got

    def back(self, codes: bytes, v: int, total: int = 0, kept: list | None = None) -> tuple[int, int]:
        """The costs before all rows, from those after them."""
        steps = self.steps
        for c in reversed(codes):
            v, low, arcs = steps[v][c] or self.step(v, c)
            total += low
            if kept is not None:
                kept.append(arcs)
        return v, total

    def costs(self, codes: bytes, right: list[int]) -> list[int]:
        v, total = self.back(codes, *self.vector(right))
        return [min(x + total, _INF) for x in self.vectors[v]]


AUTOMATON = Automaton()


class Paths:
    """Optimal arcs of conversations one after the other, ranked; ``ends``: the rows that stand for what follows each."""

    def __init__(self, rows: list[int]):
        arcs = np.stack(AUTOMATON.arcs)[rows]
        row, state, self.edit = np.nonzero(arcs >= 0)
        to = arcs[row, state, self.edit].astype(np.int64)
        self.row, self.state, node = row, state, 4 * row + state
        self.head = 4 * (row + (to >> 2)) + (to & 3)
        stop = len(row)  # what follows the last arc of a way
        self.first = np.full(4 * len(rows), stop)
        self.first[node[::-1]] = np.arange(stop)[::-1]  # the arc of the least letter
        ptr = np.append(self.first[self.head], stop)
        rank, length = np.append(self.edit + 1, 0), np.append(np.ones(stop, np.int64), 0)
        self.pointers = [ptr]
        while (ptr < stop).any():
            rank = np.unique(rank * (len(rank) + 5) + rank[ptr], return_inverse=True)[1]
            length = length + length[ptr]
            ptr = ptr[ptr]
            self.pointers.append(ptr)
        self.rank, self.length, self.node = rank, length, node

    def start(self, node: int) -> int:
        """The node's arc of the least rank."""
        lo, hi = np.searchsorted(self.node, [node, node + 1])
        return int(lo + np.argmin(self.rank[lo:hi])) if hi > lo else len(self.row)

    def walk(self, starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """All arcs from each start on, and how many each has."""
        n = self.length[starts]
        at, step = np.repeat(starts, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        for k, p in enumerate(self.pointers):
            on = (step >> k & 1).astype(bool)
            at[on] = p[at[on]]
        return at, n


def _code(role: str, text: str, seen: set) -> int:
    kept = text.rstrip(SPACE)
    fault = BLANK if not kept else DUPLICATE if (role, text) in seen else OK if kept[-1] in ENDS else CUT
    seen.add((role, text))
    return 4 * _CLASS.get(role[:1], 3) + fault


def _tally(codes: bytes) -> tuple[int, int, int, int]:
    """blank, duplicate, truncated, illegal."""
    c = np.frombuffer(codes, np.uint8)
    n, cls = np.bincount(c & 3, minlength=4), (c >> 2).tolist()
    return int(n[BLANK]), int(n[DUPLICATE]), int(n[CUT]), sum(p not in _LEGAL for p in zip(cls, cls[1:]))


def _gaps(turns: list[int]) -> tuple[int, int | None, int | None]:
    """Turns missing between the first and the last, and those two; nulls do not count."""
    t = {x for x in turns if x is not None}
    return (max(t) - min(t) + 1 - len(t), min(t), max(t)) if t else (0, None, None)


def _mended(blocks: list[tuple[bytes, list, list, int, list[int] | None]]):
    """(cost, audit, roles, texts, exit state) of each (codes, roles, texts, entry state, costs after it or None at the end)."""
    rows, starts, cost, roles, texts, ends = [], [], [], [], [], []
    for codes, r, t, entry, right in blocks:
        at, kept = len(rows), []
        v, total = AUTOMATON.back(codes, *((AUTOMATON.end, 0) if right is None else AUTOMATON.vector(right)), kept)
        rows += kept[::-1]
        rows.append(AUTOMATON.last if right is None else AUTOMATON.none)
        roles += [*r, None]
        texts += [*t, None]
        starts.append(4 * at + entry)
        ends.append(len(rows) - 1)
        cost.append(total + AUTOMATON.vectors[v][entry])
    paths = Paths(rows)
    way, n = paths.walk([paths.start(s) for s in starts])
    edits, at, state = paths.edit[way].tolist(), paths.row[way].tolist(), paths.state[way].tolist()
    lo = 0
    for k, (m, (_, _, _, entry, right)) in enumerate(zip(n.tolist(), blocks)):
        hi, new_roles, new_texts = lo + m, [], []
        for e, i, s in zip(edits[lo:hi], at[lo:hi], state[lo:hi]):
            if e:
                new_roles.append(roles[i] if e == 2 else _ROLE[s])
                new_texts.append("" if e == 1 else texts[i])
        out = int(paths.head[way[hi - 1]]) - 4 * ends[k] if m else entry
        yield cost[k] - (right[out] if right is not None else 0), "".join([EDITS[e] for e in edits[lo:hi]]), new_roles, new_texts, out
        lo = hi


_TURNS = "array<struct<role:string,text:string>>"
_STATS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _turns(roles: list[list[str]], texts: list[list[str]]) -> pa.Array:
    flat = pa.StructArray.from_arrays([pa.array([x for r in roles for x in r], pa.string()), pa.array([x for t in texts for x in t], pa.string())], ["role", "text"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, roles)]), pa.int32()), flat)


def _cut(block_rows: int, block_bytes: int):
    """Sorted rows to conversations, repaired, and to blocks of those that may go on in another partition or are too long."""

    def run(batches):
        from pyspark import TaskContext

        part, seq, kind = TaskContext.get().partitionId(), 0, None
        whole: list = []  # (conv, codes, roles, texts, gaps)
        cut: list = []  # ..., and the first and last turn
        conv, begun, edge, size, held = None, False, True, 0, 0
        codes, roles, texts, turns, seen = bytearray(), [], [], [], set()

        def close(is_edge: bool):
            nonlocal codes, roles, texts, turns, size
            gaps, lo, hi = _gaps(turns)
            (cut if is_edge else whole).append((conv, bytes(codes), roles, texts, gaps, lo, hi))
            codes, roles, texts, turns, size = bytearray(), [], [], [], 0

        def batch(rows: list, is_edge: bool):
            nonlocal seq
            n = len(rows)
            tally = [_tally(r[1]) for r in rows]
            got = [(None, None, r[2], r[3], None) for r in rows] if is_edge else list(_mended([(r[1], r[2], r[3], 0, None) for r in rows]))
            stats = [[r[4] for r in rows], *[[t[k] for t in tally] for k in range(4)], [g[0] for g in got]]
            out = pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], kind), pa.array([part] * n, pa.int64()), pa.array(range(seq, seq + n), pa.int64()), pa.array([is_edge] * n), *[pa.array(s, pa.int64()) for s in stats]]
                + [pa.array([g[1] for g in got], pa.string()), _turns([g[2] for g in got], [g[3] for g in got]), pa.array([r[1] if is_edge else None for r in rows], pa.binary()), *[pa.array([r[k] for r in rows], pa.int64()) for k in (5, 6)]],
                ["conv", "part", "seq", "edge", *_STATS, "audit", "turns", "codes", "first_turn", "last_turn"],
            )
            seq += n
            rows.clear()
            return out

        for b in batches:
            kind = b.column(0).type
            for c, turn, role, text, present in zip(*[x.to_pylist() for x in b.columns]):
                if not begun or c != conv:
                    if begun:
                        close(edge)
                        edge = False
                        if cut:
                            yield batch(cut, True)
                        if held >= BATCH_TURNS:
                            yield batch(whole, False)
                            held = 0
                    conv, begun, seen = c, True, set()
                if not present:
                    continue
                if len(codes) >= block_rows or size >= block_bytes:
                    close(True)
                    edge, seen = True, set()
                    yield batch(cut, True)
                codes.append(_code(role, text, seen))
                roles.append(role)
                texts.append(text)
                turns.append(turn)
                size += len(text)
                held += 1
            if whole:
                yield batch(whole, False)
                held = 0
        if begun:
            close(True)
            yield batch(cut, True)

    return run


def _digests(batches):
    for b in batches:
        for conv, part, seq, turns in zip(b.column(0), b.column(1), b.column(2), b.column(3)):
            first: dict[bytes, int] = {}
            for k, t in enumerate(turns):
                role, text = t["role"].as_py().encode("utf-8", "surrogatepass"), t["text"].as_py().encode("utf-8", "surrogatepass")
                first.setdefault(hashlib.sha256(b"%d:" % len(role) + role + text).digest(), k)
            n = len(first)
            yield pa.RecordBatch.from_arrays([pa.array([conv.as_py()] * n, conv.type), pa.array([part.as_py()] * n, pa.int64()), pa.array([seq.as_py()] * n, pa.int64()), pa.array(list(first), pa.binary()), pa.array(list(first.values()), pa.int32())], ["conv", "part", "seq", "digest", "k"])


def _through(batches):
    """Codes with the repeats of earlier blocks, and the costs through each block from and to each state."""
    for b in batches:
        out: list[list] = [[], []]
        for codes, again in zip(b.column(3).to_pylist(), b.column(6).to_pylist()):
            codes = bytearray(codes)
            for k in again or []:
                if codes[k] & 3 != BLANK:
                    codes[k] = codes[k] & ~3 | DUPLICATE
            ways = [AUTOMATON.costs(bytes(codes), [0 if s == t else _INF for s in range(4)]) for t in range(4)]
            out[0].append(bytes(codes))
            out[1].append([ways[t][s] for s in range(4) for t in range(4)])
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out[0], pa.binary()), *b.columns[4:6], pa.array(out[1], pa.list_(pa.int64()))], ["conv", "part", "seq", "codes", "first_turn", "last_turn", "ways"])


def _scan(step):
    """Carries a value along the rows of each conversation; ``step(value or None, row)`` gives (value, outputs)."""

    def run(batches):
        conv, value = object(), None
        for b in batches:
            got = []
            for row in zip(*[x.to_pylist() for x in b.columns]):
                if row[0] != conv:
                    conv, value = row[0], None
                value, out = step(value, row)
                got.append(out)
            yield got, b

    return run


def _backward(batches):
    """The costs after each block, empty for the last one; rows are conv, part, seq, ways, by descending place."""

    def step(right, row):
        after = right if right is not None else AUTOMATON.vectors[AUTOMATON.end]
        w = row[3]
        return [min(min(w[4 * s + t] + after[t], _INF) for t in range(4)) for s in range(4)], right

    for got, b in _scan(step)(batches):
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(got, pa.list_(pa.int64()))], ["part", "seq", "right"])


def _exits(batches):
    """The state in which the least way leaves each block, for each state in which it may be entered."""
    for b in batches:
        out = []
        for codes, right in zip(b.column(3).to_pylist(), b.column(6).to_pylist()):
            n = len(codes)
            got = []
            costs = AUTOMATON.costs(codes, right if right is not None else AUTOMATON.vectors[AUTOMATON.end])
            for s in range(4):
                got.append(next(_mended([(codes, [""] * n, [""] * n, s, right)]))[4] if right is not None and costs[s] < _INF else 0)
            out.append(got)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int64()))], ["conv", "part", "seq", "codes", "first_turn", "last_turn", "right", "exits"])


def _forward(batches):
    """Each block's entry state, and what its border adds to gaps and illegal pairs; rows by place."""

    def step(before, row):
        _, _, _, codes, lo, hi, _, exits = row
        entry, turn, cls = before or (0, None, None)
        gap = max(0, lo - turn - 1) if lo is not None and turn is not None else 0
        bad = int(cls is not None and bool(codes) and (cls, codes[0] >> 2) not in _LEGAL)
        return (exits[entry] if codes else entry, hi if hi is not None else turn, codes[-1] >> 2 if codes else cls), (entry, gap, bad)

    for got, b in _scan(step)(batches):
        cols = [pa.array([g[k] for g in got], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), b.column(6), *cols], ["part", "seq", "codes", "right", "entry", "gap", "bad"])


def _mend_blocks(batches):
    names = ["conv", "part", "seq", *_STATS, "audit", "turns"]
    for b in batches:
        for i in range(b.num_rows):  # blocks are large
            conv, part, seq, turns, gaps, codes, right, entry, gap, bad = [c[i] for c in b.columns]
            codes, right = codes.as_py(), right.as_py()
            turns = turns.values
            cost, audit, roles, texts, _ = next(_mended([(codes, turns.field("role").to_pylist(), turns.field("text").to_pylist(), entry.as_py(), right)]))
            blank, duplicate, truncated, illegal = _tally(codes)
            stats = [gaps.as_py() + gap.as_py(), blank, duplicate, truncated, illegal + bad.as_py(), cost]
            yield pa.RecordBatch.from_arrays([pa.array([conv.as_py()], conv.type), pa.array([part.as_py()], pa.int64()), pa.array([seq.as_py()], pa.int64()), *[pa.array([s], pa.int64()) for s in stats], pa.array([audit], pa.string()), _turns([roles], [texts])], names)


def repair(rows: DataFrame, ties: list[Column] = (), present: Column | None = None, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of repaired conversations: conv_id, block, blocks, gaps, blank, duplicate, truncated, illegal, cost, audit, turns.

    ``rows``: conv_id, turn, role, text; null roles and texts count as empty, a null conv_id is a conversation, null turns
    come first. Rows of one turn are ordered by ``ties`` (with them the order must be total), or else by role and a hash
    of the text. Rows for which ``present`` is not true only name their conversation.

    A conversation is one block, number 0 of 1, unless it has more than ``block_rows`` rows or ``block_bytes`` bytes, or
    lies on the border of a partition; ``blocks`` is null then (use ``block`` for the order). Numbers add up and audits and
    ``turns`` (role, text, in order) join over the blocks. A row's first fault counts: blank (white space only), duplicate (role and text
    stood earlier in the conversation), truncated (no sentence end). gaps are turns missing between the least
    and the greatest, illegal are adjacent role initials other than su, ua, au. A conversation without present rows has
    zeros, an empty audit and no turns. Other columns are not read; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    ship(spark)
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    here = F.coalesce(present, F.lit(False)) if present is not None else F.lit(True)
    order = [f"tie{k}" for k in range(len(ties))] or ["role", "hash", "salt"]
    base = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), *plain, here.alias("present"), *[t.alias(f"tie{k}") for k, t in enumerate(ties)])
    if not ties:  # rows equal in all are told apart, so that many of them do not fall into one range
        base = written(base.withColumns({"hash": F.xxhash64("text"), "salt": F.monotonically_increasing_id()}), "turns")
    keys = [F.col(c).asc_nulls_first() for c in ("conv", "turn", *order)]
    kind = id_type(rows, "conv_id")
    placed = f"conv {kind}, part long, seq long"
    stats = ", ".join(f"{s} long" for s in _STATS)
    cut = base.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "turn", "role", "text", "present")
    cut = written(cut.mapInArrow(_cut(block_rows, block_bytes), f"{placed}, edge boolean, {stats}, audit string, turns {_TURNS}, codes binary, first_turn long, last_turn long"), "conversations")
    shown = ["conv", "block", "blocks", *_STATS, "audit", "turns"]
    whole = cut.filter("not edge").withColumns({"block": F.lit(0).cast("long"), "blocks": F.lit(1)})

    edges = cut.filter("edge")
    seen = edges.select("conv", "part", "seq", "turns").mapInArrow(_digests, f"{placed}, digest binary, k int")
    earliest = F.min(F.struct("part", "seq")).over(Window.partitionBy("conv", "digest"))
    again = seen.withColumn("earliest", earliest).filter(F.struct("part", "seq") > F.col("earliest")).groupBy("part", "seq").agg(F.collect_list("k").alias("again"))
    narrow = edges.select("conv", "part", "seq", "codes", "first_turn", "last_turn").join(again, ["part", "seq"], "left").select("conv", "part", "seq", "codes", "first_turn", "last_turn", "again")
    coded = written(narrow.mapInArrow(_through, f"{placed}, codes binary, first_turn long, last_turn long, ways array<long>"), "blocks")
    own = F.col("conv").asc_nulls_first()
    right = coded.select("conv", "part", "seq", "ways").repartition("conv").sortWithinPartitions(own, F.desc("part"), F.desc("seq")).mapInArrow(_backward, "part long, seq long, right array<long>")
    left = coded.drop("ways").join(right, ["part", "seq"]).select("conv", "part", "seq", "codes", "first_turn", "last_turn", "right")
    left = left.mapInArrow(_exits, f"{placed}, codes binary, first_turn long, last_turn long, right array<long>, exits array<long>")
    state = left.repartition("conv").sortWithinPartitions(own, "part", "seq").mapInArrow(_forward, "part long, seq long, codes binary, right array<long>, entry long, gap long, bad long")
    ready = edges.select("conv", "part", "seq", "turns", "gaps").join(written(state, "states"), ["part", "seq"]).select("conv", "part", "seq", "turns", "gaps", "codes", "right", "entry", "gap", "bad")
    mended = ready.mapInArrow(_mend_blocks, f"{placed}, {stats}, audit string, turns {_TURNS}")
    # the order of blocks: partitions are fewer than 2^31 and blocks of one fewer than 2^32
    mended = mended.withColumns({"block": F.col("part") * F.lit(1 << 32) + F.col("seq"), "blocks": F.lit(None).cast("int")})
    return whole.select(shown).unionByName(mended.select(shown)).withColumnRenamed("conv", "conv_id")


def _digest(batches):
    """Sums, audit and SHA-256 of the ``role:text`` lines of conversations whose blocks come in order, a block at a time."""
    names = ["conv_id", *_STATS, "audit", "repaired_sha256"]
    conv, kind, sums, audit, sha, lines = None, None, None, [], None, 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array([conv], kind), *[pa.array([s], pa.int64()) for s in sums], pa.array(["".join(audit)], pa.string()), pa.array([sha.hexdigest()], pa.string())], names)

    for b in batches:
        kind = b.column(0).type
        for i in range(b.num_rows):
            c = b.column(0)[i].as_py()
            if sums is None or c != conv:
                if sums is not None:
                    yield out()
                conv, sums, audit, sha, lines = c, [0] * len(_STATS), [], hashlib.sha256(), 0
            sums = [s + b.column(2 + k)[i].as_py() for k, s in enumerate(sums)]
            audit.append(b.column(8)[i].as_py())
            turns = b.column(9)[i].values
            for role, text in zip(turns.field("role").to_pylist(), turns.field("text").to_pylist()):
                sha.update(f"{chr(10) if lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                lines += 1
    if sums is not None:
        yield out()


def digests(blocks: DataFrame) -> DataFrame:
    """One row for each conversation of ``repair``'s blocks: its numbers, audit, and the SHA-256 of its ``role:text`` lines.

    Those of one block stay where they are. A SHA-256 can only be taken in order, so the blocks of a longer one pass through
    one task, one block in memory at a time.
    """
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    one = blocks.filter("blocks = 1").select("conv_id", *_STATS, "audit", F.sha2(F.array_join(line, "\n"), 256).alias("repaired_sha256"))
    more = blocks.filter("blocks is null").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "block")
    more = more.select("conv_id", "block", *_STATS, "audit", "turns")
    kind = id_type(blocks, "conv_id")
    return one.unionByName(more.mapInArrow(_digest, f"conv_id {kind}, {', '.join(f'{s} long' for s in _STATS)}, audit string, repaired_sha256 string"))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with the contract's damage; dropped rows stay, with ``present`` false."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    kind = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]).cast("binary")) % 20
    hurt = rows.withColumn("kind", kind).withColumns({
        "text": F.when(F.col("kind") == 0, "").when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text, ENDS, "")).otherwise(text),
        "role": F.when(F.col("kind") == 4, "user").otherwise(role),
        "present": F.col("kind") != 0,
    })
    return hurt.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))))


def query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    return digests(repair(damaged(rows), ties=[F.col("file"), F.col("at"), F.col("copy")], present=F.col("present")))
