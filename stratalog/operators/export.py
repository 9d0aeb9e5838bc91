"""Exact source fragments for chosen evidence, and the checks of stored tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workers import ship
from .relational import merge_intervals
from .validate import problems, repeated

CONTEXT_LINES = 10
FILE_SCOPE_BYTES = 64 << 10


def requested_ids(explicit: DataFrame, *others: DataFrame) -> DataFrame:
    """Trimmed distinct ids of several tables with a column evidence_id."""
    out = explicit.select(F.trim("evidence_id").alias("evidence_id"))
    for o in others:
        out = out.union(o.select(F.trim("evidence_id")))
    return out.filter("evidence_id <> ''").distinct()


def line_count(content: Column) -> Column:
    """Number of lines of bytes; CR, LF and CRLF end lines, and a last line needs no end."""
    ends = F.regexp_count(F.decode(content, "ISO-8859-1"), F.lit(r"\r\n|\r|\n"))
    last = F.substring(content, -1, 1)
    open_end = (F.octet_length(content) > 0) & ~last.isin(F.unhex(F.lit("0A")), F.unhex(F.lit("0D")))
    return ends + open_end.cast("int")


def resolve(requested: DataFrame, evidence: DataFrame, cas: DataFrame, files: DataFrame, context: int = CONTEXT_LINES, file_scope_bytes: int = FILE_SCOPE_BYTES) -> DataFrame:
    """Requested ids against evidence, blob index and content; each miss has a status of its own, a hit its lines."""
    ev = evidence.select("evidence_id", "repo_id", "path", "exemplar", F.lit(True).alias("has_evidence"))
    idx = cas.select("repo_id", "path", F.col("sha256").alias("cas_sha"))
    size = files.filter("readable").select("repo_id", "path", F.col("sha256").alias("file_sha"), F.sha2("content", 256).alias("now_sha"), F.octet_length("content").alias("bytes"), line_count(F.col("content")).alias("lines"))
    r = requested.join(ev, "evidence_id", "left").join(idx, ["repo_id", "path"], "left").join(size, ["repo_id", "path"], "left")
    a, b = F.col("exemplar.line_start"), F.col("exemplar.line_end")
    exact = a.isNotNull() & b.isNotNull()
    status = (
        F.when(F.col("has_evidence").isNull(), "family_file_evidence_not_found").when(F.col("cas_sha").isNull(), "captured_source_missing").when(F.col("now_sha").isNull(), "captured_blob_missing")
        .when(F.col("now_sha") != F.col("cas_sha"), "captured_blob_hash_mismatch").when(exact & ((a < 1) | (b < a) | (a > F.col("lines"))), "family_file_evidence_span_out_of_bounds")
        .when(~exact & (F.col("exemplar.kind") != "file"), "family_file_evidence_has_no_exportable_span").when(~exact & (F.col("bytes") > file_scope_bytes), "file_scope_evidence_exceeds_fragment_limit").otherwise("resolved")
    )
    ok = status == "resolved"
    first = F.when(ok & exact, F.greatest(F.lit(1), a - context)).when(ok, F.least(F.lit(1), F.col("lines")))
    last = F.when(ok & exact, F.least(F.col("lines"), F.least(b, F.col("lines")) + context)).when(ok, F.col("lines"))
    return r.select("evidence_id", "repo_id", "path", "cas_sha", status.alias("status"), F.when(ok, F.when(exact, "span").otherwise("file")).alias("scope"), first.alias("line_start"), last.alias("line_end"))


def fragments(resolved: DataFrame) -> DataFrame:
    """Merged line ranges per file: touching or adjacent ones join, and a whole-file request takes in all others."""
    ok = resolved.filter("status = 'resolved'")
    whole = ok.groupBy("repo_id", "path").agg(F.max(F.col("scope") == "file").alias("whole"), F.max(F.when(F.col("scope") == "file", F.col("line_end"))).alias("n"))
    r = ok.join(whole, ["repo_id", "path"])
    r = r.withColumns({"line_start": F.when(F.col("whole"), F.least(F.lit(1), F.col("n"))).otherwise(F.col("line_start")), "line_end": F.when(F.col("whole"), F.col("n")).otherwise(F.col("line_end"))})
    out = merge_intervals(r, ["repo_id", "path", "cas_sha", "whole"], "line_start", "line_end", members="evidence_id")
    return out.withColumn("fragment_scope", F.when(F.col("whole"), "file_scope").otherwise("localized_context_union")).drop("whole")


#: Lines of a block of the line index.
INDEX_LINES = 256


def _line_starts(content: bytes):
    """Where each line begins; a last line needs no end."""
    b = np.frombuffer(content, np.uint8)
    ends = np.flatnonzero((b == 10) | (b == 13) & np.append(b[1:] != 10, True))
    starts = np.append(0, ends + 1)
    return starts[starts < len(b)] if len(b) else np.zeros(1, np.int64)


def _index(batches):
    for b in batches:
        for repo, path, content in zip(*[b.column(i) for i in range(3)]):
            at = _line_starts(content.as_py())[::INDEX_LINES]
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array([repo.as_py()] * n, pa.string()), pa.array([path.as_py()] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(at, pa.int64())], ["repo_id", "path", "block", "byte_offset"])


def line_index(files: DataFrame) -> DataFrame:
    """repo_id, path, block, byte_offset: where every ``INDEX_LINES``th line of each readable file begins; block 0 of an empty file too."""
    ship(files.sparkSession)
    return files.filter("readable and content is not null").select("repo_id", "path", "content").mapInArrow(_index, "repo_id string, path string, block int, byte_offset long")


def _slice(batches):
    for b in batches:
        out = []
        for part, skip, n in zip(*[b.column(i).to_pylist() for i in range(b.num_columns - 3, b.num_columns)]):
            if n is not None:
                at = np.append(_line_starts(part), len(part))
                part = part[at[min(skip, len(at) - 1)] : at[min(skip + n, len(at) - 1)]]
            out.append(part)
        yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(out, pa.binary())], [*b.schema.names[:-3], "fragment"])


def fragment_bytes(frags: DataFrame, files: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The exact bytes of each fragment with their hash; line ends stay as they are.

    ``index``: the ``line_index`` of the files; without one it is made for the files that have fragments. It tells which bytes
    hold a fragment's lines, so that these and at most ``INDEX_LINES`` lines before and after them are all that is cut and looked at.
    """
    ship(frags.sparkSession)
    have = files.filter("readable").select("repo_id", "path", "content")
    if index is None:
        wanted = frags.select("repo_id", "path").distinct()
        index = line_index(files.join(wanted, ["repo_id", "path"], "left_semi"))
    first, last = F.col("line_start").cast("int"), F.col("line_end").cast("int")
    f = frags.select("repo_id", "path", "cas_sha", "fragment_scope", "evidence_ids", first.alias("line_start"), last.alias("line_end"))
    f = f.withColumns({"_a": F.floor((F.col("line_start") - 1) / INDEX_LINES).cast("int"), "_z": F.floor((F.col("line_end") - 1) / INDEX_LINES).cast("int") + 1})
    at = lambda block, name: index.select("repo_id", "path", F.col("block").alias(block), F.col("byte_offset").alias(name))
    f = f.join(at("_a", "_from"), ["repo_id", "path", "_a"], "left").join(at("_z", "_to"), ["repo_id", "path", "_z"], "left").join(have, ["repo_id", "path"])
    lo = F.coalesce("_from", F.lit(0))
    part = F.substring("content", (lo + 1).cast("int"), (F.coalesce("_to", F.octet_length("content")) - lo).cast("int"))
    f = f.select("repo_id", "path", "cas_sha", "fragment_scope", "evidence_ids", "line_start", "line_end", part.alias("part"), ((F.col("line_start") - 1) % INDEX_LINES).alias("skip"), (F.col("line_end") - F.col("line_start") + 1).alias("n"))
    out = f.mapInArrow(_slice, "repo_id string, path string, cas_sha string, fragment_scope string, evidence_ids array<string>, line_start int, line_end int, fragment binary")
    return out.withColumn("fragment_sha256", F.sha2("fragment", 256))


def export_counts(resolved: DataFrame, frags: DataFrame) -> DataFrame:
    n = resolved.agg(F.count(F.lit(1)).alias("requested"), F.count_if(F.col("status") == "resolved").alias("resolved"))
    f = frags.groupBy("cas_sha").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("fragments"), F.count(F.lit(1)).alias("distinct_blobs"))
    out = n.crossJoin(F.broadcast(f))  # one row each
    left = F.col("requested") - F.col("resolved")
    return out.withColumns({"unresolved": left, "status": F.when(left == 0, "complete").when(F.col("resolved") > 0, "partial").otherwise("failed")})


def checksums(manifest: DataFrame) -> DataFrame:
    """A line per fragment, sha256 and path, in the form that sha256sum checks."""
    path = F.concat(F.lit("fragments/"), F.substring("fragment_sha256", 1, 2), F.lit("/"), F.col("fragment_sha256"))
    return manifest.select("fragment_sha256").distinct().select(F.concat(F.col("fragment_sha256"), F.lit("  "), path).alias("value"))


def write_pack(bytes_: DataFrame, folder: str) -> DataFrame:
    """Writes the pack: distinct fragments as a table partitioned by the first hex digits of their hash, the manifest and
    its checksums. All are committed by Spark; nothing is written from tasks by hand."""
    blob = bytes_.select(F.substring("fragment_sha256", 1, 2).alias("prefix"), "fragment_sha256", "fragment").dropDuplicates(["fragment_sha256"])
    blob.write.mode("overwrite").partitionBy("prefix").parquet(f"{folder}/fragments")
    manifest = bytes_.drop("fragment")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    manifest = bytes_.sparkSession.read.parquet(f"{folder}/manifest")
    checksums(manifest).write.mode("overwrite").text(f"{folder}/SHA256SUMS")
    return manifest


def verify_pack(spark, folder: str, files: DataFrame | None = None) -> DataFrame:
    """Problems of a written pack: hashes that don't match, manifest rows without a fragment, fragments without a row,
    checksums that differ, and with ``files`` fragments that the source no longer gives when they are cut again."""
    blob, man, sums = spark.read.parquet(f"{folder}/fragments"), spark.read.parquet(f"{folder}/manifest"), spark.read.text(f"{folder}/SHA256SUMS")
    row = lambda df, code, ref="fragment_sha256": df.select(F.lit(code).alias("code"), F.col(ref).alias("ref"))
    out = row(blob.filter(F.sha2("fragment", 256) != F.col("fragment_sha256")), "fragment_hash_mismatch")
    out = out.unionByName(row(man.join(blob, "fragment_sha256", "left_anti"), "fragment_missing")).unionByName(row(blob.join(man, "fragment_sha256", "left_anti"), "fragment_not_in_manifest"))
    want = checksums(man)
    out = out.unionByName(row(want.join(sums, "value", "left_anti"), "checksum_missing", "value")).unionByName(row(sums.join(want, "value", "left_anti"), "checksum_unknown", "value"))
    if files is not None:
        again = fragment_bytes(man.drop("fragment_sha256"), files).select("repo_id", "path", "line_start", "line_end", F.col("fragment_sha256").alias("now"))
        cut = man.join(again, ["repo_id", "path", "line_start", "line_end"], "left").filter(~F.col("now").eqNullSafe(F.col("fragment_sha256")))
        out = out.unionByName(row(cut, "fragment_differs_from_source"))
    return out


def verify(families: DataFrame, evidence: DataFrame, members: DataFrame, files: DataFrame, by_repo: bool = False) -> DataFrame:
    """Problems of stored tables (code, ref): uniqueness, foreign keys, counts against the evidence, spans, hashes."""
    sums = evidence.groupBy("family_id").agg(F.sum("occurrence_count_in_file").alias("o"), F.count(F.lit(1)).alias("f"))
    off = families.join(sums, "family_id", "left").filter("o is null or o <> occurrence_count or f <> file_count")
    a, b = F.col("exemplar.line_start"), F.col("exemplar.line_end")
    return problems(
        *[(f"duplicate_{what}_id", repeated(df, f"{what}_id"), f"{what}_id") for what, df in (("family", families), ("evidence", evidence), ("member", members), ("file", files))],
        ("duplicate_family_file_evidence", repeated(evidence, "family_id", "file_id"), "family_id"), ("family_count_mismatch", off, "family_id"),
        ("evidence_without_family", evidence.join(families, "family_id", "left_anti"), "evidence_id"), ("evidence_without_file", evidence.join(files, "file_id", "left_anti"), "evidence_id"),
        ("member_without_family", members.join(families, "family_id", "left_anti"), "member_id"), ("span_not_sane", evidence.filter((a < 1) | (b < a)), "evidence_id"),
        ("content_hash_mismatch", files.filter("readable").filter(F.sha2("content", 256) != F.col("sha256")), "file_id"),
        by_repo=by_repo,
    )
