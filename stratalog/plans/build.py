"""Job drivers: build, reduce, classify, index, look up, export. One plan covers all repositories by ``repo_id``.

An artifact, a reduction and the concepts are folders of tables that change in one step (``store``): a job stages all of its
tables and then puts them in force together, for the repositories it was asked for.
"""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boundaries, classify, config, export, facts, families, hashtree, reduce, scan, validate
from ..sources import filetree
from ..tables import written
from . import store as tables
from .store import CONTRACT, read, write  # noqa: F401

TABLES = ("files", "cas_index", "blobs", "facts", "families", "members", "key_families", "evidence", "diagnostics", "probe_status", "boundaries_http", "boundaries_kafka", "config_includes", "line_index", "snapshots")
REDUCED = ("exact_representations", "similarity_groups", "observed_identities", "identity_members", "variation_dimensions", "counts")
#: What a reduction is made from, and what candidates are made from.
REDUCED_FROM = ("families", "members", "evidence", "diagnostics")
CLASSIFIED_FROM = ("exact_representations", "observed_identities", "identity_members", "counts")


@dataclass(frozen=True)
class Config:
    """What decides a build's result: directories left out, whether contents are kept, and the largest file that each kind of parser takes."""

    excluded: tuple[str, ...] | None = None
    capture: bool = True
    limits: dict[str, int] = field(default_factory=lambda: dict(facts.LIMITS))

    def __post_init__(self):
        if unknown := set(self.limits) - set(facts.LIMITS):
            raise ValueError(f"no such parser: {sorted(unknown)}")
        if any(n <= 0 for n in self.limits.values()):
            raise ValueError("limits must be above 0")
        object.__setattr__(self, "limits", {**facts.LIMITS, **self.limits})
        if self.excluded is not None:
            object.__setattr__(self, "excluded", tuple(sorted({x.strip() for x in self.excluded} - {""})))

    def plain(self) -> dict:
        return asdict(self)


def guard(repositories: dict[str, str], folder: str) -> None:
    """The artifact must lie outside of every source tree."""
    out = os.path.realpath(folder)
    for root in repositories.values():
        top = os.path.realpath(root)
        if not os.path.isdir(top):
            raise FileNotFoundError(root)
        if out == top or out.startswith(top + os.sep):
            raise ValueError(f"the output folder is inside a source tree: {root}")


def build(spark: SparkSession, repositories: dict[str, str], folder: str, excluded: list[str] | None = None, how: Config | None = None) -> dict[str, DataFrame]:
    """Scans trees and writes the artifact's tables; every file is read and parsed once."""
    how = how or Config(excluded)
    guard(repositories, folder)
    filetree.register(spark)
    reader = spark.read.format("filetree").option("repositories", json.dumps(repositories)).option("subtrees", str(4 * spark.sparkContext.defaultParallelism))
    if how.excluded is not None:
        reader = reader.option("excluded", json.dumps(how.excluded))
    return store(spark, reader.load(), folder, sorted(repositories), how)


def store(spark: SparkSession, raw: DataFrame, folder: str, repos: list[str], how: Config | None = None) -> dict[str, DataFrame]:
    """Writes the artifact's tables of some repositories from raw file rows, in one change.

    The file table with its content is staged first: everything after it reads that table, which also is the
    content store. Without ``capture`` contents are parsed from a scratch table and not kept.
    """
    how, change = how or Config(), tables.Change(spark, folder, repos)
    found = scan.files(raw)
    if not how.capture:
        found = written(found, "contents")
    change.write(found if how.capture else scan.without_content(found), "files", spread=False)
    files = change.read("files")
    change.write(facts.extract_facts(files if how.capture else found, how.limits), "facts")
    change.write(scan.cas_index(files), "cas_index")
    change.write(scan.blobs(files, "repo_id"), "blobs")
    change.write(export.line_index(files), "line_index")
    change.write(scan.snapshot_fingerprint(files), "snapshots")
    finish(change)
    at = change.commit()
    return {t: read(spark, folder, t, at=at) for t in TABLES}


def refuse(what: str, wrong: DataFrame) -> None:
    some = [tuple(r) for r in wrong.limit(5).collect()]
    if some:
        raise ValueError(f"{what}: {some}")


def finish(change: tables.Change) -> None:
    """From staged files and facts to families, members, evidence, boundaries and diagnostics."""
    files, fact = change.read("files"), change.read("facts")
    consts = boundaries.string_constants(fact)
    change.write(boundaries.outbound_http(fact).unionByName(boundaries.inbound_http(fact, consts), allowMissingColumns=True), "boundaries_http")
    change.write(boundaries.kafka(fact, consts), "boundaries_kafka")
    change.write(config.includes(fact, files), "config_includes")
    obs = families.observations(fact, files, [boundaries.as_observations(change.read("boundaries_http"), "http"), boundaries.as_observations(change.read("boundaries_kafka"), "kafka")])
    change.write(families.evidence(obs), "evidence")
    change.write(families.probe_status(fact), "probe_status")
    change.write(families.families(change.read("evidence"), change.read("probe_status"), families.provenance(obs)), "families")
    change.write(families.members(obs), "members")
    change.write(families.key_families(fact), "key_families")
    change.write(families.diagnostics(fact, scan.scan_diagnostics(files)), "diagnostics")


def refused(wrong: DataFrame, repos: list[str]) -> dict[str, str]:
    """Of ``repos`` those that have problems (repo_id, code, ref), with one of them each; a problem without a repository is all repositories'."""
    each = wrong.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("code", "ref")).alias("first"))
    got = {r.repo_id: f"{r.n} problems, first {r.first.code}: {r.first.ref}" for r in each.collect()}
    return {r: got.get(r) or got[None] for r in repos if r in got or None in got}


def reduce_repos(spark: SparkSession, folder: str, out: str, repos: list[str]) -> dict[str, str]:
    """Reduces some repositories of an artifact in one change; the others' rows stay. Those whose tables do not verify
    are refused, each by itself, and returned with a problem; what an earlier reduction has of them stays."""
    at = tables.head(spark, folder)
    bad = refused(verify_artifact(spark, folder, repos, at, by_repo=True), repos)
    good = sorted(set(repos) - set(bad))
    if not good:
        return bad
    t = {n: read(spark, folder, n, good, at) for n in REDUCED_FROM}
    change = tables.Change(spark, out, good)
    change.write(reduce.bases(t["families"], t["members"]), "bases")
    based = change.read("bases")
    change.write(reduce.exact_representations(based, t["evidence"]), "exact_representations")
    exact = change.read("exact_representations")
    change.write(reduce.similarity_groups(exact, based, t["evidence"]), "similarity_groups")
    change.write(reduce.observed_identities(based, t["evidence"]), "observed_identities")
    change.write(reduce.identity_members(based), "identity_members")
    sim, ids = change.read("similarity_groups"), change.read("observed_identities")
    change.write(reduce.variations(exact).join(sim.select("repo_id", "similarity_id"), "similarity_id"), "variation_dimensions")
    change.write(reduce.counts(t["families"], t["members"], t["evidence"], exact, sim, ids, t["diagnostics"]), "counts")
    change.write(lineage(spark, folder, REDUCED_FROM, good, at), "lineage")
    change.commit()
    return bad


def reduce_tables(spark: SparkSession, folder: str, out: str) -> dict[str, DataFrame]:
    """Reduces an artifact whose tables verify; one with an altered table is refused."""
    repos = sorted(tables.head(spark, folder).repos("files"))
    refuse("the artifact does not verify", verify_artifact(spark, folder))
    reduce_repos(spark, folder, out, repos)
    at = tables.head(spark, out)
    return {n: read(spark, out, n, at=at) for n in REDUCED}


def lineage(spark: SparkSession, folder: str, names, repos=None, at: tables.Head | None = None) -> DataFrame:
    """Per repository the stored roots of the tables that something is made from, a column each; no table is read."""
    got = hashtree.roots(tables.parts(spark, folder, names, at))
    got = got if repos is None else got.filter(F.col("repo_id").isin(repos))
    return got.groupBy("repo_id").pivot("table_name", list(names)).agg(F.first("root"))


def verify_artifact(spark: SparkSession, folder: str, repos=None, at: tables.Head | None = None, by_repo: bool = False) -> DataFrame:
    """Problems of an artifact's tables: what does not hold together, and parts that are not as they were stored."""
    at = at or tables.head(spark, folder)
    fam, ev, mem, files = (read(spark, folder, n, repos, at) for n in ("families", "evidence", "members", "files"))
    return export.verify(fam, ev, mem, files, by_repo).unionByName(validate.artifact(fam, ev, mem, by_repo)).unionByName(altered(spark, folder, repos, at, by_repo))


def altered(spark: SparkSession, folder: str, repos=None, at: tables.Head | None = None, by_repo: bool = False) -> DataFrame:
    """Parts of tables that are not as they were stored; only repositories are read whose files were touched."""
    wrong = tables.damage(spark, folder, everything=False, at=at)
    wrong = wrong if repos is None else wrong.filter(F.col("repo_id").isin(repos))
    return validate.problems(("stored_part_altered", wrong.withColumn("ref", F.concat_ws("/", "table_name", "repo_id", "part")), "ref"), by_repo=by_repo)


def verify_reduced(spark: SparkSession, reduced: str, artifact: str | None = None, repos=None, by_repo: bool = False) -> DataFrame:
    """Problems of a reduction, and with ``artifact`` repositories that it was not made from in their present state."""
    at = tables.head(spark, reduced)
    out = validate.reduced(*[read(spark, reduced, n, repos, at) for n in REDUCED], by_repo=by_repo).unionByName(altered(spark, reduced, repos, at, by_repo))
    return out if artifact is None else out.unionByName(stale(spark, reduced, artifact, REDUCED_FROM, by_repo))


def verify_candidates(spark: SparkSession, concepts: str, reduced: str) -> DataFrame:
    """Problems of concept candidates, and repositories whose reduction has changed since."""
    rules = {c: classify.concept_signals(c) for c in classify.CONCEPTS}
    out = validate.candidates(read(spark, concepts, "candidates"), read(spark, reduced, "counts"), rules)
    return out.unionByName(stale(spark, concepts, reduced, CLASSIFIED_FROM))


def verify_index(spark: SparkSession, concepts: str) -> DataFrame:
    """Problems of a stored concept index against its candidates; the summary is counted again."""
    at = tables.head(spark, concepts)
    return validate.index(read(spark, concepts, "index", at=at), read(spark, concepts, "index_summary", at=at).drop("repo_id"), read(spark, concepts, "candidates", at=at))


def stale(spark: SparkSession, product: str, source: str, names: tuple[str, ...], by_repo: bool = False) -> DataFrame:
    """Repositories whose product's stored lineage is not that of the source tables as they are; only marks are read."""
    return validate.lineage_breaks(read(spark, product, "lineage"), lineage(spark, source, names), by_repo)


def classify_repos(spark: SparkSession, reduced: str, out: str, repos: list[str]) -> dict[str, str]:
    """Signals, candidates and index of some repositories of a reduction, in one change; those whose reduction does not verify
    are refused, each by itself, and returned with a problem."""
    bad = refused(verify_reduced(spark, reduced, repos=repos, by_repo=True), repos)
    at = tables.head(spark, reduced)
    good = sorted(set(repos) - set(bad))
    if not good:
        return bad
    change = tables.Change(spark, out, good)
    change.write(classify.signals(read(spark, reduced, "observed_identities", good, at)), "signals")
    change.write(classify.concept_candidates(read(spark, reduced, "counts", good, at).select("repo_id"), change.read("signals")), "candidates")
    change.write(classify.basis_rows(change.read("candidates"), change.read("signals")), "basis")
    change.write(lineage(spark, reduced, CLASSIFIED_FROM, good, at), "lineage")
    change.commit()
    build_index(spark, out, good)
    return bad


def classify_tables(spark: SparkSession, reduced: str, out: str) -> DataFrame:
    """Signals, concept candidates and index of all repositories of a reduction that verifies."""
    refuse("the reduction does not verify", verify_reduced(spark, reduced))
    classify_repos(spark, reduced, out, sorted(tables.head(spark, reduced).repos("counts")))
    return read(spark, out, "candidates")


#: The summary covers all repositories; it is stored as one more.
ALL = "*"


def build_index(spark: SparkSession, concepts: str, repos: list[str] | None = None) -> DataFrame:
    """Writes the index over candidates (of some repositories, or all) and the summary of all; returns the summary."""
    at = tables.head(spark, concepts)
    found = read(spark, concepts, "candidates", at=at)
    own = sorted(at.repos("candidates") if repos is None else repos)
    change = tables.Change(spark, concepts, [*own, ALL])
    change.write(classify.concept_index(found.filter(F.col("repo_id").isin(own))), "index")
    change.write(classify.index_summary(found).withColumn("repo_id", F.lit(ALL)).coalesce(1), "index_summary", spread=False)
    return read(spark, concepts, "index_summary", at=change.commit()).drop("repo_id")


def export_selected(spark: SparkSession, folder: str, evidence_ids: list[str], out: str, reduced: str | None = None, context: int = export.CONTEXT_LINES, file_scope_bytes: int = export.FILE_SCOPE_BYTES) -> DataFrame:
    """Writes the exact fragments of chosen evidence (and of the representatives of a reduction of
    this artifact); returns the totals."""
    ids = spark.createDataFrame([(i,) for i in evidence_ids], "evidence_id string")
    more = []
    if reduced:
        refuse("the reduction is not of this artifact", verify_reduced(spark, reduced, folder))
        for n in ("exact_representations", "observed_identities"):
            more.append(read(spark, reduced, n).select(F.col("representative_evidence_id").alias("evidence_id")))
    at = tables.head(spark, folder)
    files = read(spark, folder, "files", at=at)
    got = export.resolve(export.requested_ids(ids, *more), read(spark, folder, "evidence", at=at), read(spark, folder, "cas_index", at=at), files, context, file_scope_bytes)
    got.write.mode("overwrite").parquet(f"{out}/resolution")
    got = spark.read.parquet(f"{out}/resolution")
    export.write_pack(export.fragment_bytes(export.fragments(got), files, read(spark, folder, "line_index", at=at)), out)
    return export.export_counts(got, spark.read.parquet(f"{out}/manifest"))
