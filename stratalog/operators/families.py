"""Compaction of facts into families, family-by-file evidence and members.

Counts are exact and two-level: facts are summed per family and file first (the evidence), and families are sums over
evidence. So no distinct runs over raw facts, and a family that every file has meets its key with one row per file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .relational import sum_maps, worst_status
from .validate import provenance as _provenance

# Rank of a coverage status; others rank 1.
STATUS_RANK = {"complete": 0, "not_applicable": 0, "partial": 1, "failed": 2, "not_evaluated": 2}

#: Sections that are no observations.
SIDE_SECTIONS = ("diagnostics", "probe_status", "scalar_properties", "http_facts", "kafka_facts", "java_facts", "config_facts")

#: Which probe's coverage a section has.
PROBE_OF = {"structured_families": "structured", "source_formats": "structured", "xml_observations": "xml", "dependencies": "build_config", "config_keys": "build_config", "sql_statements": "sql", "import_namespaces": "java", "annotations": "java", "api_calls": "java"}


def primitives(files: DataFrame) -> DataFrame:
    """Source primitives in the shape of facts: one per file, by extension and language."""
    d = F.to_json(F.struct(F.col("classification.classification").alias("classification"), F.col("extension"), F.col("classification.language").alias("language")), {"ignoreNullFields": "false"})
    none = lambda t: F.lit(None).cast(t)
    return files.select(
        "repo_id", "file_id", "path", "scope", F.lit("source_primitives").alias("section"), F.lit("source_primitive").alias("family_kind"), F.col("extension").alias("family_label"), d.alias("descriptor_json"),
        none("string").alias("member_json"), F.lit(1).cast("long").alias("occurrence_count"), *[none("int").alias(c) for c in ("line_start", "line_end", "column_start", "column_end")], none("string").alias("extra_json"),
    )


def observations(facts: DataFrame, files: DataFrame, boundaries: list[DataFrame] = ()) -> DataFrame:
    """All observations in one envelope, with their family's id."""
    rows = facts.filter(~F.col("section").isin(*SIDE_SECTIONS)).unionByName(primitives(files))
    for b in boundaries:
        rows = rows.unionByName(b)
    names = F.create_map(*[F.lit(x) for kv in PROBE_OF.items() for x in kv])
    doubt = F.get_json_object("extra_json", "$.confidence").cast("double") < 1
    basis = F.when(F.col("section") == "boundaries", F.get_json_object("extra_json", "$.basis")).otherwise(F.col("family_kind"))
    rows = rows.withColumns({"probe": F.coalesce(F.try_element_at(names, F.col("section")), F.col("section")), "claim": F.when(F.coalesce(doubt, F.lit(False)), "ambiguity").otherwise("observed_fact"), "basis": basis})
    return rows.withColumn("family_id", S.stable_id("family", *[F.col(c) for c in ("repo_id", "section", "family_kind", "descriptor_json")]))


def probe_status(facts: DataFrame) -> DataFrame:
    """Per repository and probe: how many files it applied to and how it went."""
    s = facts.filter("section = 'probe_status'").groupBy("repo_id", F.col("family_kind").alias("probe"))
    n = s.agg(F.count(F.lit(1)).alias("applicable"), *[F.count_if(F.col("family_label") == k).alias(k) for k in ("complete", "partial", "failed")])
    status = F.when(F.col("failed") == F.col("applicable"), "failed").when(F.col("failed") + F.col("partial") > 0, "partial").otherwise("complete")
    return n.withColumn("status", status)


def evidence(obs: DataFrame) -> DataFrame:
    """One row per family and file: the count in the file, and the best exemplar as the least of a total order."""
    exact = F.col("line_start").isNotNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    order = F.struct(F.when(exact, 0).otherwise(1), zero("line_start"), zero("column_start"), zero("line_end"), zero("column_end"), F.coalesce("member_json", F.lit("")), F.coalesce("extra_json", F.lit("")))
    span = F.struct(F.when(exact, "exact_span").otherwise("file").alias("kind"), "line_start", "line_end", "column_start", "column_end")
    g = obs.groupBy("repo_id", "family_id", "section", "family_kind", "family_label", "descriptor_json", "file_id", "path", "scope")
    ev = g.agg(F.sum("occurrence_count").alias("occurrence_count_in_file"), F.min_by(span, order).alias("exemplar"))
    return ev.withColumn("evidence_id", S.stable_id("evidence", F.col("family_id"), F.col("file_id")))


def provenance(obs: DataFrame) -> DataFrame:
    """Per family which probes saw it, what is claimed and what the claim rests on."""
    return _provenance(obs, ["repo_id", "family_id"], F.col("probe"), F.col("claim"), F.col("basis"))


def families(ev: DataFrame, status: DataFrame, origin: DataFrame | None = None) -> DataFrame:
    """Families as sums over their evidence, with the variants of their provenance where it is given. Scopes are few per family
    (they are source trees, not files)."""
    per_scope = ev.groupBy("repo_id", "family_id", "section", "family_kind", "family_label", "descriptor_json", "scope").agg(F.sum("occurrence_count_in_file").alias("o"), F.count(F.lit(1)).alias("f"))
    fam = per_scope.groupBy("repo_id", "family_id", "section", "family_kind", "family_label", "descriptor_json").agg(F.sum("o").alias("occurrence_count"), F.sum("f").alias("file_count"), F.array_sort(F.collect_list("scope")).alias("scopes"))
    names = F.create_map(*[F.lit(x) for kv in PROBE_OF.items() for x in kv])
    worst = status.groupBy("repo_id", "probe").agg(worst_status(F.col("status"), STATUS_RANK).alias("coverage_status"))
    out = fam.withColumn("probe", F.coalesce(F.try_element_at(names, F.col("section")), F.lit(""))).join(worst, ["repo_id", "probe"], "left").drop("probe")
    out = out.withColumn("coverage_status", F.coalesce("coverage_status", F.lit("complete")))
    out = out.withColumn("salience", S.salience(F.col("occurrence_count"), F.col("coverage_status")))
    return out if origin is None else out.join(origin, ["repo_id", "family_id"], "left")


def members(obs: DataFrame) -> DataFrame:
    """Distinct members of families, with the number of files that have each."""
    per = obs.filter("member_json is not null").groupBy("repo_id", "family_id", "member_json", "file_id").agg(F.count(F.lit(1)).alias("n"))
    m = per.groupBy("repo_id", "family_id", "member_json").agg(F.count(F.lit(1)).alias("observed_file_count"))
    return m.select("repo_id", "family_id", S.stable_id("member", F.col("family_id"), F.col("member_json")).alias("member_id"), F.get_json_object("member_json", "$.syntax").alias("syntax"), F.lit("complete").alias("parse_status"), "member_json", "observed_file_count")


def diagnostics(facts: DataFrame, scan: DataFrame) -> DataFrame:
    """Parser and scan diagnostics in one table."""
    d = facts.filter("section = 'diagnostics'").select("repo_id", "file_id", "path", F.col("family_kind").alias("code"), F.col("family_label").alias("message"), "descriptor_json")
    d = d.withColumn("diagnostic_id", S.stable_id("diagnostic", *[F.col(c) for c in ("repo_id", "path", "code", "descriptor_json")]))
    return d.unionByName(scan.withColumn("descriptor_json", F.lit("{}")))


def key_families(facts: DataFrame) -> DataFrame:
    """Key families with summed kind counts and depths (per repository, syntax and key)."""
    k = facts.filter("family_kind = 'structured_key_family'").select("repo_id", "file_id", F.get_json_object("descriptor_json", "$.syntax_family").alias("syntax"), F.col("family_label").alias("key"), "occurrence_count", F.from_json(F.get_json_object("extra_json", "$.value_kind_counts"), "map<string,long>").alias("kinds"), F.get_json_object("member_json", "$.depth_min").cast("int").alias("lo"), F.get_json_object("member_json", "$.depth_max").cast("int").alias("hi"))
    keys = ["repo_id", "syntax", "key"]
    g = k.groupBy(*keys).agg(F.sum("occurrence_count").alias("occurrence_count"), F.count_distinct("file_id").alias("file_count"), F.min("lo").alias("depth_min"), F.max("hi").alias("depth_max"))
    return g.join(sum_maps(k, keys, "kinds", "value_kind_counts"), keys)
