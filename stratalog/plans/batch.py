"""Batches of remote repositories with resume: what is unchanged is reused, the others are built in one plan."""

from __future__ import annotations

import hashlib
import json
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import EXCLUDED_DIRECTORIES
from ..operators.relational import match_selectors, reuse_decision
from ..sources.remote import Credentials, checkouts, remote_commit
from ..tables import written
from . import build as B

MANIFEST = "repository_id string, repository_url string, requested_ref string, resolved_commit string, scope_fingerprint string, config_fingerprint string, status string, action string, reason string, message string"
SAME = ["resolved_commit", "repository_url", "requested_ref", "scope_fingerprint", "config_fingerprint"]


def scope_fingerprint(excluded=None, **_) -> str:
    """Of what decides which files are looked at."""
    return config_fingerprint(excluded=sorted(EXCLUDED_DIRECTORIES if excluded is None else excluded))


def config_fingerprint(**config) -> str:
    """Of everything that decides the result."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def select(repositories: DataFrame, selectors: DataFrame | None, limit: int | None = None) -> DataFrame:
    """Chosen repositories: all by id, or those that selectors name in their order; then at most ``limit``."""
    if selectors is None:
        out, order = repositories, "repository_id"
    else:
        aliases = F.array("repository_id", "repository_name", "repository_url", F.regexp_replace("repository_url", r"\.git$", ""), F.concat_ws("/", "scope_key", "repository_name"), F.concat_ws("_", "scope_key", "repository_name"), F.concat("repository_name", F.lit(".git")))
        hit = match_selectors(selectors, repositories, aliases, "repository_id").filter("status = 'selected'")
        out, order = repositories.join(hit.select("repository_id", "position"), "repository_id"), "position"
    out = out.orderBy(order)
    return out.limit(limit) if limit is not None else out


def previous(spark: SparkSession, folder: str) -> DataFrame:
    """What an earlier batch completed and still stands: its manifest's rows whose stored repository is intact.

    No manifest is no earlier batch; a manifest or an artifact that can't be read is an error.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], MANIFEST + ", intact boolean")
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").filter("status = 'complete'")
    if rows.isEmpty():
        return rows.withColumn("intact", F.lit(False))
    return rows.join(intact(spark, folder), rows["repository_id"] == F.col("repo_id"), "left").drop("repo_id").withColumn("intact", F.col("intact").isNotNull())


def intact(spark: SparkSession, folder: str) -> DataFrame:
    """Repositories that a batch completed and whose stored rows are as they were written, made from one another as they are.

    Marks are compared; rows are read again only of repositories whose files on disk are not those that were written.
    """
    art, red, con = f"{folder}/artifact", f"{folder}/reduced", f"{folder}/concepts"
    every = B.tables.head(spark, con).repos("candidates") & B.tables.head(spark, red).repos("counts") & B.tables.head(spark, art).repos("files")
    broken = B.stale(spark, red, art, B.REDUCED_FROM).select(F.col("ref").alias("repo_id")).unionByName(B.stale(spark, con, red, B.CLASSIFIED_FROM).select(F.col("ref").alias("repo_id")))
    for f in (art, red, con):
        broken = broken.unionByName(B.altered(spark, f, by_repo=True).select("repo_id"))
    rows = spark.createDataFrame([(r,) for r in sorted(every)], "repo_id string")
    return rows.join(broken, "repo_id", "left_anti").withColumn("intact", F.lit(True))


def run(spark: SparkSession, repositories: DataFrame, folder: str, credentials: Credentials = Credentials(), **config) -> DataFrame:
    """Builds, reduces and classifies what changed, and that alone, and writes the manifest. ``config``: of ``build.Config``.

    A repository that fails, or whose tables do not verify, is recorded and does not stop the rest.

    The list of repositories is a control table; with the manifest it is what comes to the driver. Checkouts run in tasks, and
    a repository counts as complete only when its tables are written; a build that breaks off is recorded for all of
    its repositories before the error goes on.
    """
    how = B.Config(**config)
    scope, mark = scope_fingerprint(how.excluded), config_fingerprint(contract=B.CONTRACT, **how.plain())
    rows, done = [], []
    for r in repositories.collect():
        try:
            rows.append((r.repository_id, r.repository_url, r.requested_ref, remote_commit(r.repository_url, r.requested_ref, credentials), scope, mark, True))
        except (RuntimeError, ValueError, subprocess.SubprocessError) as e:
            done.append((r.repository_id, r.repository_url, r.requested_ref, None, scope, mark, "failed", "rebuild", "ref_not_resolved", credentials.mask(str(e))))
    now = spark.createDataFrame(rows, "repository_id string, repository_url string, requested_ref string, resolved_commit string, scope_fingerprint string, config_fingerprint string, intact boolean")
    # what is known before the new manifest replaces the old one
    decided = reuse_decision(now, previous(spark, folder), "repository_id", [*SAME, "intact"]).orderBy("repository_id").collect()
    base = lambda r: (r.repository_id, r.repository_url, r.requested_ref, r.resolved_commit, scope, mark)
    done += [(*base(r), "complete", "reuse", r.reason, None) for r in decided if r.action == "reuse"]
    wanted = [r for r in decided if r.action == "rebuild"]
    reason = lambda r: "stored_repository_not_intact" if r.reason == "intact_changed" else r.reason
    failed, broke = {}, None
    try:
        if wanted:
            failed = _build(spark, wanted, folder, credentials, how)
    except Exception as e:
        broke = e
    for r in wanted:
        why = failed.get(r.repository_id) or (broke and f"the build broke off: {type(broke).__name__}")
        done.append((*base(r), "failed" if why else "complete", "rebuild", reason(r), why or None))
    manifest = spark.createDataFrame(done, MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    if broke:
        raise broke
    return spark.read.parquet(f"{folder}/manifest")


def _build(spark: SparkSession, wanted: list, folder: str, credentials: Credentials, how: B.Config) -> dict[str, str]:
    """Checks out, stores, reduces and classifies these repositories; the messages of those that failed."""
    asked = spark.createDataFrame([(r.repository_id, r.repository_url, r.resolved_commit) for r in wanted], "repo_id string, url string, ref string")
    raw = written(checkouts(asked, credentials, how.excluded), "checkouts")
    failed = {r.repo_id: r.error for r in raw.filter("path is null").select("repo_id", "error").collect()}
    left = lambda: sorted({r.repository_id for r in wanted} - set(failed))
    if left():
        B.store(spark, raw.filter(F.col("repo_id").isin(left())), f"{folder}/artifact", left(), how)
        failed |= B.reduce_repos(spark, f"{folder}/artifact", f"{folder}/reduced", left())
    if left():
        failed |= B.classify_repos(spark, f"{folder}/reduced", f"{folder}/concepts", left())
    return failed


def summary(manifest: DataFrame) -> DataFrame:
    """Totals and overall status of a batch."""
    n = manifest.agg(F.count(F.lit(1)).alias("repositories"), F.count_if(F.col("action") == "reuse").alias("reused"), F.count_if((F.col("action") == "rebuild") & (F.col("status") == "complete")).alias("built"), F.count_if(F.col("status") == "failed").alias("failed"))
    state = F.sha2(F.to_json(F.struct("repository_id", "repository_url", "requested_ref", "resolved_commit", "config_fingerprint", "status")), 256)
    # a batch with the same repositories in the same state has the same fingerprint, whatever was reused
    each = manifest.select(F.substring(state, 1, 2).alias("part"), state.alias("h")).groupBy("part").agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("h"))), 256).alias("h"))
    n = n.join(F.broadcast(each.agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("h"))), 256).alias("fingerprint"))))  # one row each
    return n.withColumn("status", F.when(F.col("failed") == 0, "complete").when(F.col("failed") < F.col("repositories"), "partial").otherwise("failed"))
