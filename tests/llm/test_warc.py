import gzip
import hashlib
import io
import json
from collections import defaultdict

from pyspark.sql.datasource import EqualTo, In

from stratalog.llm import warc
from stratalog.llm._util import scratch


def brute(rows):
    by = defaultdict(list)
    for i, _, h in rows:
        by[(h or "").encode()].append(i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        first = min((x for x in by[p] if x is not None), default=None)
        again = len(p) >= 100 and first is not None and i != first
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


KEY = lambda r: tuple((x is None, x) for x in r)


def round_trip(spark, rows, **how):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as key", "'y' as first", "'z' as id")
    warc.register(spark)
    files = warc.archive(df, scratch(spark, "w"), **how)
    return files, spark.read.format("warc").option("paths", json.dumps(files)).load()


BIG = "<p>héllo wörld</p>\r\n\r\nWARC/1.1\r\n" * 20
ROWS = [(3, "http://a/x", BIG), (1, "http://b/é y", BIG), (2, "http://c\r\nEvil: 1", BIG), (4, "u", "short"), (5, "u", "short"), (6, None, None), (7, "u", ""), (8, "u", "x" * 3_000_000), (None, "u", BIG), (None, "u", "lonely" * 50), (1, "http://b/again", BIG), (-9, "u", "y" * 100), (10, "u", "y" * 100), (11, "u", "y" * 99), (12, "u", "y" * 99)]


def test_round_trip(spark):
    for how in ({}, {"zipped": False, "file_bytes": 2000}, {"broadcast_rows": 0}):
        files, df = round_trip(spark, ROWS, **how)
        assert sorted(map(tuple, warc.pages_of(df).collect()), key=KEY) == sorted(brute(ROWS), key=KEY)
        got = {(r.record_id, r.record_type): bytes(r.payload).decode() for r in df.filter("record_type = 'response'").collect()}
        assert got["<urn:page:8>", "response"] == "x" * 3_000_000 and got["<urn:page:1>", "response"] == BIG
        assert df.filter("record_type = 'warcinfo'").count() == len(files)


def test_ids_of_any_type(spark):
    rows = [("a b", "u", BIG), ("a/ö>", "u", BIG), ("", "u", BIG), ("7", "u", "short"), (None, "u", "none\nhere"), ("x\r\ny", "u", "z" * 200)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    warc.register(spark)
    for more in ({}, {"broadcast_rows": 0}):
        files = warc.archive(df, scratch(spark, "w"), **more)
        got = warc.pages_of(spark.read.format("warc").option("paths", json.dumps(files)).load(), "string")
        assert sorted(map(tuple, got.collect()), key=KEY) == sorted(brute(rows), key=KEY)


def test_filters_are_pushed(spark):
    _, df = round_trip(spark, ROWS)
    some = df.filter("record_type = 'revisit' and refers_to in ('<urn:page:1>', '<urn:page:77>')")
    assert some.count() == 3
    r = warc.WarcReader({"paths": '["x"]'})
    ours = [EqualTo(("record_type",), "revisit"), In(("refers_to",), ("a", "b"))]
    other = EqualTo(("path",), "x")
    assert list(r.pushFilters([*ours, other])) == [other]
    assert r.wanted({"warc-type": "revisit", "warc-refers-to": "b"})
    assert not r.wanted({"warc-type": "response", "warc-refers-to": "b"}) and not r.wanted({"warc-type": "revisit"})


def test_rejected_payloads_are_not_decoded():
    raw = warc.record("<a>", "response", b"HTTP/1.1 200 OK\r\n\r\nbody", Content_Type="application/http") + warc.record("<b>", "request", b"q" * 5000) + b"\r\n" + warc.record("<c>", "response", b"plain")
    for f, seek in ((io.BytesIO(raw), True), (gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(raw))), False)):
        got = list(warc.records(f, lambda h: h["warc-type"] == "response", seekable=seek))
        assert [(n, s, p) for _, n, s, p in got] == [(23, 200, b"body"), (5, None, b"plain")]
    assert [x[3] for x in warc.records(io.BytesIO(raw), lambda h: True, payload=False, seekable=True)] == [None] * 3


def test_empty_table(spark):
    files, _ = [], None
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), scratch(spark, "w")) == files


def test_folder_and_partitions(spark):
    folder = scratch(spark, "many")
    df = spark.createDataFrame([(i, "u", "z" * 500 + str(i)) for i in range(200)], "page_id long, url string, html string").repartition(8)
    files = warc.archive(df, folder, file_bytes=4000, zipped=False)
    read = spark.read.format("warc").option("path", folder).option("partition_bytes", "8000").load()
    assert read.filter("record_type = 'response'").count() == 200 and read.rdd.getNumPartitions() >= len(files) / 3


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, warc.query(spark, sf).collect()), key=KEY) == sorted(brute(rows), key=KEY)
