import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from stratalog.llm import conversations as C


HASH: dict[str, int] = {}  # the order of texts where all else is equal


def least_repair(rows):
    """(cost, audit, [(role, text)]) from the definition; rows: (initial, role, text, deleted by force, truncated)."""
    n = len(rows)
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, inserts):
        got = [(0, "", ())] if i == n and state in ("", "a") else []
        if inserts < 3:
            for r in ("user", "assistant"):
                if (state, r[0]) in after and (x := best(i, after[state, r[0]], inserts + 1)):
                    got.append((2 + x[0], "I" + x[1], ((r, ""),) + x[2]))
        if i < n:
            initial, role, text, gone, cut = rows[i]
            if x := best(i + 1, state, 0):
                got.append((3 + x[0], "D" + x[1], x[2]))
            if not gone:
                if (state, initial) in after and (x := best(i + 1, after[state, initial], 0)):
                    got.append((cut + x[0], "K" + x[1], ((role, text),) + x[2]))
                for r in ("user", "assistant"):
                    if (state, r[0]) in after and (x := best(i + 1, after[state, r[0]], 0)):
                        got.append((2 + cut + x[0], "R" + x[1], ((r, text),) + x[2]))
        return min(got, default=None)

    for i in range(n, -1, -1):  # keeps the recursion flat
        for s in ("", "s", "u", "a"):
            best(i, s, 0)
    return best(0, "", 0)


def summary(rows):
    """rows (turn, role, text) in order, without nulls in role and text."""
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    turns = {t for t, _, _ in rows if t is not None}
    seen, marked, n = set(), [], [0, 0, 0]
    for _, role, text in rows:
        kept = text.strip(" \t\n\x0b\x0c\r")
        fault = 0 if not kept else 1 if (role, text) in seen else 2 if kept[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            n[fault] += 1
        marked.append((role[:1], role, text, fault in (0, 1), int(fault == 2)))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    cost, audit, turns_out = least_repair(marked)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns_out).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n, illegal, cost, audit, digest)


def brute(rows, tie=lambda r: (r[2] or "", HASH[r[3] or ""])):
    convs = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, *tie(r))):
        convs.setdefault(r[0], []).append((r[1], r[2] or "", r[3] or ""))
    return sorted([(c, *summary(rs)) for c, rs in convs.items()], key=lambda r: (r[0] is not None, r[0]))


def hurt(rows):
    """The contract's damage, row by row."""
    out, names = [], set()
    for conv, turn, role, text in rows:
        names.add(conv)
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else text.replace(".", "").replace("!", "").replace("?", "") if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out, names


def learn_hashes(spark, rows):
    texts = spark.createDataFrame([(r[3] or "",) for r in rows], "t string")
    HASH.update({r.t: r.h for r in texts.select("t", F.xxhash64("t").alias("h")).collect()})


def made(spark, rows, **more):
    learn_hashes(spark, rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "'x' as conv", "2 as seq").repartition(4)
    return sorted((tuple(r) for r in C.digests(C.repair(df, **more)).collect()), key=lambda r: (r[0] is not None, r[0]))


def anything(rng, conv, n):
    roles = ["user", "assistant", "system", "tool", "", None, "u", "steward"]
    texts = ["Yes.", "No!", "cut off", "", "  ", None, "Same again?", "\t\n", "é…", "Is it? ", "end. x"]
    return [(conv, rng.choice([None, rng.randrange(n + 3)]) if rng.random() < 0.2 else k, rng.choice(roles[: rng.choice([2, 3, 8])]), rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randrange(3 * n)}.") for k in range(n)]


def test_any_conversations(spark):
    rng = random.Random(3)
    rows = [r for c in range(300) for r in anything(rng, c, rng.randrange(1, 12))] + anything(rng, None, 9)
    assert made(spark, rows) == brute(rows)


@pytest.mark.parametrize("block_rows, block_bytes", [(1, 1 << 20), (3, 1 << 20), (7, 40), (64, 1 << 20)])
def test_conversations_over_many_blocks(spark, block_rows, block_bytes):
    rng = random.Random(block_rows)
    rows = anything(rng, 1, 150) + anything(rng, 2, 40) + anything(rng, 3, 1) + [r for c in range(4, 30) for r in anything(rng, c, 5)]
    assert made(spark, rows, block_rows=block_rows, block_bytes=block_bytes) == brute(rows)


def test_one_conversation_with_nearly_all_rows(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    rng = random.Random(8)
    rows = anything(rng, 7, 400) + [(7, 1, "user", "The same.")] * 60 + [r for c in range(20) for r in anything(rng, c + 10, 3)]
    learn_hashes(spark, rows)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        blocks = C.repair(df)
        assert blocks.filter("conv_id = 7").count() > 3  # no task has it all
        assert sorted(map(tuple, C.digests(blocks).collect())) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_repaired_turns_are_a_conversation(spark):
    rng = random.Random(4)
    rows = [r for c in range(60) for r in anything(rng, c, 8)]
    got = C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.conv_id, r.block)):
        by.setdefault(r.conv_id, []).extend(r.turns)
    assert set(by) == set(range(60))
    import re

    for turns in by.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in turns))


def test_least_audits():
    def audit(codes):
        return list(C._mended([(bytes(codes), [""] * len(codes), [""] * len(codes), 0, None)]))[0][:2]

    u, a = 4, 8
    assert audit([]) == (0, "")
    assert audit([u, a]) == (0, "KK")
    assert audit([u]) == (2, "KI")
    assert audit([a]) == (2, "IK")
    assert audit([u, u, a]) == (2, "KIKK")
    assert audit([u + C.BLANK, a + C.DUPLICATE]) == (6, "DD")
    assert audit([u + C.CUT, a]) == (1, "KK")
    ranks = C.Paths([C.AUTOMATON.last])
    assert ranks.walk([ranks.start(0)])[0].tolist() == []
    long = [u, a] * 5000
    assert audit(long) == (0, "K" * 10_000)


def test_ranks_order_audits():
    rng = random.Random(1)
    codes = bytes(rng.randrange(16) for _ in range(60))
    rows = []
    C.AUTOMATON.back(codes, C.AUTOMATON.end, 0, rows)
    p = C.Paths(rows[::-1] + [C.AUTOMATON.last])
    audits = ["".join(C.EDITS[p.edit[k]] for k in p.walk([i])[0]) for i in range(len(p.row))]
    assert [sorted(set(audits)).index(x) + 1 for x in audits] == p.rank[:-1].tolist()


def test_query(spark, sf, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    for extra in ([], [(None, None, None, None), (None, 2, "user", "Hm."), (5, None, "user", None), *[(10_000 + k, 0, "user", "a. b! c?") for k in range(60)], (3, 1, "user", "Tie.")]):
        path = str(tmp_path / f"t{len(extra)}")
        spark.createDataFrame(rows + extra, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
        left, names = hurt(rows + extra)
        want = {r[0]: r for r in brute(left, tie=lambda r: ())}
        want |= {c: (c, *summary([])) for c in names - set(want)}
        got = {r.conv_id: tuple(r) for r in C.query(spark, path).collect()}
        assert got == want


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert C.digests(C.repair(none)).collect() == []
    rows = spark.createDataFrame([("c", 1, "user", "x.")], none.schema)
    got = C.digests(C.repair(rows, present=F.lit(False))).collect()
    assert [tuple(r) for r in got] == [("c", *summary([]))]
