import hashlib

from pyspark.sql import functions as F

from stratalog.llm import sketch as S


def brute_sketch(text, fraction=S.FRACTION, words=S.WORDS):
    up = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    ws = [w for w in (text or "").translate(up).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not ws:
        return []
    hs = {hashlib.md5(" ".join(ws[i : i + words]).encode()).hexdigest()[:16] for i in range(max(1, len(ws) - words + 1))}
    return sorted(h for h in hs if int(h, 16) < fraction * 2**64) or [min(hs)]


def share(a, b):
    return len(set(a) & set(b)) / len(a) if a else float(not b)


TEXTS = ["", None, " \n", "one", "One  TWO three four", "a b c d e", "a b c d e f g h i j k l m n o p", "é ü Ä ß ñ ç ø", "no break space here a b c", "the same line again " * 400, "🙂 " * 7, "x" * 20_000]


def sketches(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select("k", S.sketch(F.col("text")).alias("s")).collect()
    return [r.s for r in sorted(rows)]


def test_sketches(spark, sf):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sketches(spark, texts) == [brute_sketch(t) for t in texts]


def test_other_fractions_and_widths(spark):
    text = "a b c d e f g h i j k l m n o p q r s t"
    for fraction, words in ((1.0, 2), (0.5, 1), (1e-9, 3)):
        got = spark.range(1).select(S.sketch(F.lit(text), words, fraction)).first()[0]
        assert got == brute_sketch(text, fraction, words)


def test_merged_is_the_sketch_of_all_shingles(spark):
    lines = [" ".join(f"w{k * 7 + j}" for j in range(30)) for k in range(6)] + ["lone", ""]
    got = sketches(spark, lines)
    pairs = spark.createDataFrame([(a, b) for a in got for b in got], "a array<string>, b array<string>")
    for r in pairs.select("a", "b", S.merged(F.col("a"), F.col("b")).alias("m"), S.containment(F.col("a"), F.col("b")).alias("c"), S.resemblance(F.col("a"), F.col("b")).alias("r")).collect():
        both = sorted({*r.a, *r.b})
        assert r.m == ([h for h in both if h < S.threshold(S.FRACTION)] or both[:1])
        assert r.c == share(r.a, r.b)
        assert r.r == (len({*r.a} & {*r.b}) / len(both) if both else 1.0)


def test_containment_between_very_unequal_documents(spark):
    large = " ".join(f"w{k}" for k in range(20_000))
    small = " ".join(f"w{k}" for k in range(5_000, 6_000))
    a, b = sketches(spark, [small, large])
    assert share(a, b) == 1.0 and 0.02 < share(b, a) < 0.09


def test_neighbours(spark):
    rows = [(k * 3 % 101, f"text {k % 7} of {k}") for k in range(101)] + [(None, "no id"), (500, None), (501, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "'x' as p", "2 as guest").repartition(5)
    got = sorted(((r.doc_id, r.text, r.next_text) for r in S.neighbours(df).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == [(i, t or "", want[(k + 1) % len(want)][1] or "") for k, (i, t) in enumerate(want)]


def test_repeated_rows_and_ids(spark):
    rows = [(1, "one")] * 3 + [(2, "two"), (2, "other"), (3, "three"), (3, "three")] + [(None, None)] * 2
    got = S.neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0, r.text) for r in got)) == sorted((i or 0, t or "") for i, t in rows)
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.text), set()).add(r.next_text)
    assert all(len(v) == 1 for v in by.values())
    assert by[None, ""] == {"one"} and by[3, "three"] == {""} and by[1, "one"] < {"two", "other"}
    last = next(t for t in ("two", "other") if by[2, t] == {"three"})
    assert by[2, "other" if last == "two" else "two"] == {last}


def test_only_repeated_keys_are_written(spark, monkeypatch):
    """A file written to a local folder costs several processes, each of which shares its executor's memory until it runs."""
    tables, write = {}, S.written

    def noted(df, name):
        tables[name] = write(df, name)
        return tables[name]

    monkeypatch.setattr(S, "written", noted)
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    got = {r.doc_id: r.next_text for r in S.neighbours(docs).collect()}
    assert got == {k: f"text {(k + 1) % 300}" for k in range(300)} and not tables
    got = sorted((r.doc_id, r.next_text) for r in S.neighbours(docs.unionByName(docs.filter("doc_id IN (7, 8, 299)"))).collect())
    assert got == sorted((k, f"text {(k + 1) % 300}") for k in (*range(300), 7, 8, 299))
    assert [*tables] == ["repeated"] and sorted(r.id for r in tables["repeated"].collect()) == [7, 8, 299]


def test_one_and_no_document(spark):
    one = S.neighbours(spark.createDataFrame([("k", "alone")], "doc_id string, text string")).collect()
    assert [tuple(r) for r in one] == [("k", "alone", "alone")]
    assert S.neighbours(spark.createDataFrame([], "doc_id string, text string")).collect() == []


def test_query_against_brute_force(spark, sf):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want = []
    for k, (i, t) in enumerate(docs):
        u = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        a, b = brute_sketch(t), brute_sketch(edited)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), ",".join(a), ",".join(b), share(a, b), share(a, brute_sketch(u))))
    assert sorted(map(tuple, S.query(spark, sf).collect())) == want


def test_no_python_in_the_plan(spark, sf):
    plan = S.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
