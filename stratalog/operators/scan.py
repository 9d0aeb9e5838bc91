"""From raw file rows to the file table, diagnostics, content-addressed blobs and extension families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def files(raw: DataFrame) -> DataFrame:
    """The file table with content: ids, names, hashes and language. ``raw`` is what the filetree source gives."""
    ext = S.extension_of(F.col("path"))
    lang = S.language_of(ext)
    status = F.when(F.col("is_symlink"), "symlink").when(F.col("error").isNotNull(), "unreadable").otherwise("captured")
    return raw.select(
        "repo_id", S.stable_id("file", F.col("repo_id"), F.col("path")).alias("file_id"), "path", S.file_name(F.col("path")).alias("file_name"), ext.alias("extension"),
        F.coalesce("byte_size", F.octet_length("content").cast("long")).alias("byte_size"), F.when(F.col("content").isNotNull(), F.sha2("content", 256)).alias("sha256"),
        F.col("content").isNotNull().alias("readable"), "is_symlink", status.alias("capture_status"),
        F.struct(F.when(lang.isNull(), "unclassified").otherwise("language").alias("classification"), lang.alias("language")).alias("classification"),
        S.source_tree_scope(F.col("path")).alias("scope"), "content", "error",
    )


def scan_diagnostics(table: DataFrame) -> DataFrame:
    """One row per file that was listed and not read."""
    code = F.when(F.col("is_symlink"), "file_symlink_not_followed").when(F.col("error") == "file_too_large", "file_exceeds_capture_limit").otherwise("file_unreadable")
    bad = table.filter(~F.col("readable"))
    return bad.select("repo_id", "file_id", "path", code.alias("code"), F.coalesce("error", F.lit("")).alias("message"), S.stable_id("diagnostic", F.col("repo_id"), F.col("path"), code).alias("diagnostic_id"))


def without_content(table: DataFrame) -> DataFrame:
    """The file table of a scan that keeps no contents; hashes and sizes stay."""
    return table.withColumns({"content": F.lit(None).cast("binary"), "capture_status": F.when(F.col("capture_status") == "captured", "not_captured").otherwise(F.col("capture_status"))})


def blobs(table: DataFrame, *within: str) -> DataFrame:
    """Distinct contents, of all files or within each repository (``within``): sha256, size, how many files have it and the first of them."""
    have = table.filter("readable")
    return have.groupBy(*within, "sha256").agg(F.max("byte_size").alias("byte_size"), F.count(F.lit(1)).alias("file_count"), F.min(F.struct("repo_id", "path")).alias("first"))


def cas_index(table: DataFrame) -> DataFrame:
    """Where each file's content is: path to sha256 and blob path."""
    return table.filter("readable").select("repo_id", "path", "sha256", "byte_size", F.concat(F.lit("blobs/"), F.substring("sha256", 1, 2), F.lit("/"), F.col("sha256")).alias("blob_path"))


def cas_counts(index: DataFrame) -> DataFrame:
    """Totals of a content index: files, distinct blobs and bytes."""
    per = index.groupBy("sha256").agg(F.count(F.lit(1)).alias("c"), F.sum("byte_size").alias("b"))
    return per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("file_count"), F.count(F.lit(1)).alias("distinct_blob_count"), F.coalesce(F.sum("b"), F.lit(0)).alias("total_bytes"))


#: Parts of a repository's files that are hashed by themselves.
SNAPSHOT_PARTS = 1024


def snapshot_fingerprint(table: DataFrame) -> DataFrame:
    """Per repository, a hash over its files' paths, hashes and flags: first the files of each of ``SNAPSHOT_PARTS`` parts in
    order of path, then the parts, so that no task holds a repository's files."""
    one = S.fingerprint(*[F.col(c) for c in ("path", "sha256", "byte_size", "readable", "is_symlink")])
    in_order = lambda key: F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(key, "h"))), lambda x: x["h"])), 256).alias("h")
    per = table.select("repo_id", F.pmod(F.xxhash64("path"), F.lit(SNAPSHOT_PARTS)).alias("part"), "path", one.alias("h"))
    parts = per.groupBy("repo_id", "part").agg(in_order("path"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy("repo_id").agg(in_order("part").alias("fingerprint"), F.sum("n").alias("file_count"))
