"""WARC archives: a writer that records repeated payloads as revisits, and a Python data source that reads them.

Reading: the driver plans partitions of whole files, about ``partition_bytes`` each. A task parses a record's
headers first. Predicates on record type and on other header columns are pushed into the source and decided there;
a record they reject is skipped by its Content-Length: sought over in a plain file, inflated without being kept in a
gzip file. With ``payload=false`` no block is decoded at all.

Writing: each task writes files of its own name in the shared folder and returns their paths. The returned paths are
the commit: files of lost or repeated attempts are in no manifest and never read.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith

from . import bloom
from ._util import BROADCAST_ROWS, id_type, scratch, ship, written

FILE_BYTES = 64 << 20
MIN_REVISIT_BYTES = 100

#: Column of the source to WARC header field.
FIELDS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "warc_date": "warc-date",
    "refers_to": "warc-refers-to",
    "header_digest": "warc-payload-digest",
    "header_bytes": "x-payload-length",
    "content_type": "content-type",
}
SCHEMA = ", ".join(f"{c} string" for c in FIELDS) + ", block_bytes long, http_status int, payload binary, path string"
_ARROW = pa.schema([*[(c, pa.string()) for c in FIELDS], ("block_bytes", pa.int64()), ("http_status", pa.int32()), ("payload", pa.binary()), ("path", pa.string())])


def _open(uri: str):
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    return where, path


def read_headers(f) -> dict[str, str] | None:
    """Headers of the next record, names in lower case; None at the end."""
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    out, last = {}, None
    while (line := f.readline()).strip():
        if line[:1] in b" \t" and last:  # folded
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, _, value = line.partition(b":")
        last = name.strip().lower().decode("utf-8", "replace")
        out[last] = value.strip().decode("utf-8", "replace")
    return out


def _skip(f, n: int, seekable: bool) -> None:
    if seekable:
        f.seek(n, io.SEEK_CUR)
        return
    while n > 0:
        got = len(f.read(min(n, 1 << 20)))
        if not got:
            return
        n -= got


def split_http(block: bytes) -> tuple[int | None, bytes]:
    """Status and body of an HTTP message; a block that is none is all body."""
    if not block.startswith(b"HTTP/"):
        return None, block
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None, block
    status = head.split(b"\r\n", 1)[0].split()
    return (int(status[1]) if len(status) > 1 and status[1].isdigit() else None), body


def records(f, wanted, payload: bool = True, seekable: bool = False):
    """(headers, block length, HTTP status, payload) of the records that ``wanted(headers)`` takes."""
    while (h := read_headers(f)) is not None:
        n = int(h.get("content-length", 0))
        if not wanted(h):
            _skip(f, n, seekable)
        elif not payload:
            _skip(f, n, seekable)
            yield h, n, None, None
        else:
            block = f.read(n)
            http = h.get("content-type", "").lower().startswith("application/http")
            yield h, n, *(split_http(block) if http else (None, block))


class _Files(InputPartition):
    def __init__(self, paths):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options.get("paths", "[]")) or [options["path"]]
        self.payload = options.get("payload", "true").lower() != "false"
        self.partition_bytes = int(options.get("partition_bytes", FILE_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for x in filters:
            col = x.attribute[0] if len(getattr(x, "attribute", ())) == 1 else None
            if col in FIELDS and isinstance(x, EqualTo):
                self.tests.append((col, "in", (x.value,)))
            elif col in FIELDS and isinstance(x, In):
                self.tests.append((col, "in", tuple(x.value)))
            elif col in FIELDS and isinstance(x, IsNotNull):
                self.tests.append((col, "set", None))
            elif col in FIELDS and isinstance(x, StringStartsWith):
                self.tests.append((col, "starts", x.value))
            else:
                yield x

    def wanted(self, headers) -> bool:
        for col, kind, value in self.tests:
            got = headers.get(FIELDS[col])
            if got is None or kind == "in" and got not in value or kind == "starts" and not got.startswith(value):
                return False
        return True

    def partitions(self):
        from pyarrow import fs

        sized = []
        for uri in self.files:
            where, path = _open(uri)
            info = where.get_file_info(path)
            if info.type == fs.FileType.Directory:
                for x in where.get_file_info(fs.FileSelector(path, recursive=True)):
                    if x.is_file and x.base_name.endswith((".warc", ".warc.gz")):
                        sized.append((x.size, uri.split("://")[0] + "://" + x.path if "://" in uri else x.path))
            elif info.is_file:
                sized.append((info.size, uri))
            else:
                raise FileNotFoundError(uri)
        out, here, n = [], [], 0
        for size, uri in sorted(sized, key=lambda x: x[1]):
            if here and n + size > self.partition_bytes:
                out.append(_Files(here))
                here, n = [], 0
            here.append(uri)
            n += size
        return [*out, *([_Files(here)] if here else [])] or [_Files([])]

    def read(self, partition):
        rows, held = [], 0
        for uri in partition.paths:
            where, path = _open(uri)
            zipped = path.endswith(".gz")
            with where.open_input_file(path) as raw:
                f = gzip.GzipFile(fileobj=raw) if zipped else io.BufferedReader(raw, 1 << 20) if hasattr(raw, "readinto") else raw
                for h, n, status, body in records(f, self.wanted, self.payload, not zipped):
                    rows.append((*[h.get(x) for x in FIELDS.values()], n, status, body, uri))
                    held += len(body or b"")
                    if len(rows) >= 2000 or held >= 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


class WarcSource(DataSource):
    """``spark.read.format("warc")``: options path (a file or folder) or paths (a JSON list), payload, partition_bytes."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets Spark push filters into Python sources."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def record(record_id: str, kind: str, block: bytes, **fields: str | None) -> bytes:
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + record_id.encode()]
    for name, value in fields.items():
        if value is not None:
            clean = str(value).replace("\r", " ").replace("\n", " ").encode("utf-8", "surrogatepass")
            head.append(name.replace("_", "-").encode() + b": " + clean)
    return b"\r\n".join(head) + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def _writer(folder: str, date: str, file_bytes: int, zipped: bool):
    def run(batches):
        from pyspark import TaskContext

        where, top = _open(folder)
        where.create_dir(top, recursive=True)
        out, name, size, count, done = None, "", 0, 0, []

        def close():
            out.close()
            done.append((name, count, size))

        for b in batches:
            for rid, uri, kind, refers, digest, n, payload in zip(*[c.to_pylist() for c in b.columns]):
                if out is None:
                    name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc" + ".gz" * zipped
                    out, size, count = where.open_output_stream(f"{top}/{name}", compression=None), 0, 0
                    first = record(f"<urn:uuid:{uuid.uuid4()}>", "warcinfo", b"format: WARC File Format 1.1\r\n", WARC_Date=date, Content_Type="application/warc-fields")
                    out.write(gzip.compress(first, 1, mtime=0) if zipped else first)
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
                block = head + (payload or b"")
                raw = record(rid, kind, block, WARC_Date=date, WARC_Target_URI=uri, WARC_Refers_To=refers, WARC_Payload_Digest=f"sha256:{digest}", X_Payload_Length=n, Content_Type="application/http; msgtype=response")
                raw = gzip.compress(raw, 1, mtime=0) if zipped else raw
                out.write(raw)
                size += len(raw)
                count += 1
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], ["name", "records", "bytes"])

    return run


def write_warc(rows: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", file_bytes: int = FILE_BYTES, zipped: bool = True) -> list[str]:
    """Writes records (record_id, target_uri, record_type, refers_to, digest, n_bytes, payload) and returns the committed files.

    The list has a name per file, so it grows with the archive's size over ``file_bytes``, not with its records.
    """
    ship(rows.sparkSession)
    cols = ["record_id", "target_uri", "record_type", "refers_to", "digest", "n_bytes", "payload"]
    return [f"{folder}/{r['name']}" for r in rows.select(*cols).mapInArrow(_writer(folder, date, file_bytes, zipped), "name string, records long, bytes long").collect()]


def _urn(c):
    """The record id of a page id; a null id has one too."""
    return F.when(c.isNull(), F.lit("<urn:page>")).otherwise(F.concat(F.lit("<urn:page:"), F.url_encode(c.cast("string")), F.lit(">")))


def _flag(shared, columns: list[str]):
    at = columns.index("digest")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bloom.maybe(shared.value, b.column(at).to_pylist()))], [*columns, "maybe"])

    return run


def archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES, broadcast_rows: int = BROADCAST_ROWS, **how) -> list[str]:
    """Writes a record per page and returns the files.

    Of pages with equal payloads of at least ``min_bytes`` the one with the smallest id is a response, the others are
    revisits of it without a payload; shorter payloads are all responses. A null payload is empty. Rows that repeat
    the smallest id are responses too; a null id is a revisit unless its group has no other id. Ids may be of any type
    that casts to a string and back.

    Which payloads repeat is told from their digests alone. Up to ``broadcast_rows`` repeated ones go to all tasks; of
    more, a Bloom filter does, and only pages that it takes for repeated are shuffled with their payload.
    """
    page = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("target_uri"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    page = page.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    long_ = page.filter(F.col("n_bytes") >= min_bytes)
    repeated = written(long_.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").drop("n"), "repeated")
    n = repeated.count()
    if n <= broadcast_rows:
        rows = page.join(F.broadcast(repeated), "digest", "left")
    else:
        spark = pages.sparkSession
        ship(spark)
        shared = spark.sparkContext.broadcast(bloom.of(repeated.select("digest"), n))
        flagged = page.mapInArrow(_flag(shared, page.columns), T.StructType([*page.schema.fields, T.StructField("maybe", T.BooleanType())]))
        alone = flagged.filter("not maybe").withColumn("first", F.lit(None).cast(repeated.schema["first"].dataType))
        rows = alone.unionByName(flagged.filter("maybe").join(repeated, "digest", "left"))
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    rows = rows.select(
        _urn(F.col("id")).alias("record_id"), "target_uri", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, _urn(F.col("first"))).alias("refers_to"), "digest", "n_bytes", F.when(~again, F.col("payload")).alias("payload"),
    )
    return write_warc(rows, folder, **how)


def pages_of(warc: DataFrame, id_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the page records of an archive.

    ``id_type`` is the type of the ids that were written. Of responses, length and digest are taken from the payload
    that was read; a revisit has those of its header.
    """
    as_id = lambda c: F.when(F.col(c).startswith("<urn:page:"), F.url_decode(F.regexp_extract(c, "^<urn:page:(.*)>$", 1))).cast(id_type)
    got = warc.filter(F.col("record_type").isin("response", "revisit") & F.col("record_id").startswith("<urn:page"))
    response = F.col("record_type") == "response"
    return got.select(
        as_id("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("header_bytes").cast("long")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.regexp_replace("header_digest", "^sha256:", "")).alias("payload_digest"),
        "record_type",
        as_id("refers_to").alias("refers_to"),
    )


def query(spark, sf_dir):
    register(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = id_type(pages, "page_id")
    files = archive(pages, scratch(spark, "warc"))
    if not files:
        return spark.createDataFrame([], f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")
    return pages_of(spark.read.format("warc").option("paths", json.dumps(files)).load(), kind)


SQL = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM (SELECT page_id, payload_bytes, payload_digest, min(page_id) OVER (PARTITION BY payload_digest) AS first_id
      FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages))
"""
