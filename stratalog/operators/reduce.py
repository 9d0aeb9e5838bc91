"""Reduction of families to exact shapes, similarity groups and observed identities."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..workers import ship
from .relational import dedupe_diagnostics, variation_dimensions

_FACETS = pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())]))
_PAIRS = pa.list_(pa.struct([("path", pa.string()), ("value", pa.float64())]))


def _shapes(prefix: str):
    """descriptor JSON to (exact, similar, facets, metrics); null gives nulls and empty lists."""

    def run(batches):
        from ..functions import shapes as H

        for b in batches:
            known, out = {None: (None, None, [], [])}, []
            for text in b.column(b.num_columns - 1).to_pylist():
                if text not in known:
                    v = json.loads(text)
                    known[text] = (H.canonical(H.shape(v, False)), H.canonical(H.shape(v, True)), [{"path": p, "value": x} for p, x in H.facets(v, prefix)], [{"path": p, "value": x} for p, x in H.positive_metrics(v)])
                out.append(known[text])
            cols = list(zip(*out)) or [(), (), (), ()]
            made = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), _FACETS, _PAIRS))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*b.schema.names[:-1], "exact", "similar", "facets", "metrics"])

    return run


_MADE = "exact string, similar string, facets array<struct<path:string,value:string>>, metrics array<struct<path:string,value:double>>"


def shapes(rows: DataFrame, column: str, keys: list[str], prefix: str = "$") -> DataFrame:
    """``keys`` of the rows with the shapes, facets and positive metrics of their JSON ``column``."""
    ship(rows.sparkSession)
    schema = ", ".join(f"{rows.schema[k].name} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, column).mapInArrow(_shapes(prefix), f"{schema}, {_MADE}")


def bases(families: DataFrame, members: DataFrame) -> DataFrame:
    """Per family its shape bases and identity. Families with members rest on those, others on their descriptor; the
    two are never mixed."""
    own = shapes(families, "descriptor_json", ["repo_id", "family_id"])
    m = shapes(members, "member_json", ["family_id", "syntax", "parse_status"], "$.member_descriptor")
    flat = F.array_sort(F.array_distinct(F.flatten(F.collect_list("facets"))))
    per = m.groupBy("family_id").agg(
        F.array_sort(F.collect_set("exact")).alias("m_exact"), F.array_sort(F.collect_set("similar")).alias("m_similar"), F.array_sort(F.collect_set("syntax")).alias("syntaxes"),
        F.array_sort(F.collect_set("parse_status")).alias("statuses"), flat.alias("m_facets"), F.count(F.lit(1)).alias("structural_member_count"),
    )
    x = families.join(own, ["repo_id", "family_id"]).join(per, "family_id", "left")
    with_members = F.col("m_exact").isNotNull()
    section = F.when(~with_members, F.col("section"))
    basis = lambda d, mm: F.to_json(F.struct("family_kind", section.alias("observed_section"), F.when(~with_members, F.col(d)).alias("observed_metrics"), F.col(mm).alias("member_descriptors"), "syntaxes", "statuses"))
    every = F.array_sort(F.array_distinct(F.concat("facets", F.coalesce("m_facets", F.expr("cast(array() as array<struct<path:string,value:string>>)")))))
    named = F.filter(every, lambda f: (f["value"] != "") & (f["value"] != F.col("family_label")))
    x = x.withColumns({"exact_basis": basis("exact", "m_exact"), "similar_basis": basis("similar", "m_similar"), "identity_facets": named})
    has_name = (F.coalesce("family_label", F.lit("")) != "") | (F.size("identity_facets") > 0)
    return x.select(
        "repo_id", "family_id", "section", "family_kind", "family_label", "descriptor_json", "occurrence_count", "file_count", "salience", "metrics",
        F.coalesce("structural_member_count", F.lit(0)).alias("structural_member_count"), "exact_basis", "similar_basis", "identity_facets",
        S.stable_id("exact", F.col("repo_id"), F.col("exact_basis")).alias("exact_id"), S.stable_id("similar", F.col("repo_id"), F.col("similar_basis")).alias("similarity_id"),
        F.when(has_name, S.stable_id("identity", F.col("repo_id"), F.col("family_kind"), F.col("family_label"), F.to_json("identity_facets"))).alias("identity_id"),
    )


def _files(based: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Per group: distinct files, evidence rows and the least evidence id, by two aggregations."""
    per = based.select("repo_id", "family_id", key).join(evidence.select("family_id", "file_id", "evidence_id"), "family_id")
    per = per.groupBy("repo_id", key, "file_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("family_id", "evidence_id").alias("fam"), F.min("evidence_id").alias("e"))
    return per.groupBy("repo_id", key).agg(F.count(F.lit(1)).alias("file_count"), F.sum("n").alias("family_file_evidence_count"), F.min("e").alias("representative_evidence_id"), F.min_by("fam", "e").alias("representative_source_family_id"))


def exact_representations(based: DataFrame, evidence: DataFrame) -> DataFrame:
    g = based.groupBy("repo_id", "exact_id", "similarity_id").agg(
        F.min("exact_basis").alias("exact_basis"), F.count(F.lit(1)).alias("source_family_count"), F.sum("occurrence_count").alias("occurrence_count"), F.sum("structural_member_count").alias("structural_member_count"),
        F.min("salience").alias("salience_min"), F.max("salience").alias("salience_max"), F.round(F.sum(F.col("salience").cast("decimal(20,3)")), 6).cast("double").alias("salience_sum"), F.count_distinct("identity_id").alias("observed_identity_count"),
    )
    return g.join(_files(based, evidence, "exact_id"), ["repo_id", "exact_id"])


def similarity_groups(exact: DataFrame, based: DataFrame, evidence: DataFrame) -> DataFrame:
    g = exact.groupBy("repo_id", "similarity_id").agg(
        F.count(F.lit(1)).alias("exact_representation_count"), F.sum("source_family_count").alias("source_family_count"),
        F.sum("occurrence_count").alias("occurrence_count"), F.sum("structural_member_count").alias("structural_member_count"),
    )
    names = based.groupBy("repo_id", "similarity_id").agg(F.count_distinct("identity_id").alias("observed_identity_count"), F.min("similar_basis").alias("similar_basis"))
    files = _files(based, evidence, "similarity_id").drop("representative_evidence_id", "representative_source_family_id")
    return g.join(names, ["repo_id", "similarity_id"]).join(files, ["repo_id", "similarity_id"])


def observed_identities(based: DataFrame, evidence: DataFrame) -> DataFrame:
    g = based.filter("identity_id is not null").groupBy("repo_id", "identity_id", "family_kind", "family_label").agg(
        F.min("identity_facets").alias("facet_rows"), F.count_distinct("exact_id").alias("exact_representation_count"), F.count(F.lit(1)).alias("source_family_count"), F.sum("occurrence_count").alias("occurrence_count"),
    )
    g = g.withColumn("facets", F.transform("facet_rows", lambda f: f["value"]))
    return g.join(_files(based, evidence, "identity_id"), ["repo_id", "identity_id"])


def identity_members(based: DataFrame) -> DataFrame:
    """Which exact representations have an identity, a row each."""
    return based.filter("identity_id is not null").select("repo_id", "identity_id", "exact_id").distinct()


def _flat(batches):
    from ..functions import shapes as H

    for b in batches:
        rows = [(g, m, p, v) for g, m, t in zip(*[c.to_pylist() for c in b.columns]) for p, v in H.flatten(json.loads(t)).items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["grp", "member", "path", "value"])


def variations(exact: DataFrame) -> DataFrame:
    """Paths on which the exact shapes of a similarity group differ."""
    ship(exact.sparkSession)
    rows = exact.select("similarity_id", "exact_id", "exact_basis").mapInArrow(_flat, "grp string, member string, path string, value string")
    return variation_dimensions(rows, "grp", "member", "path", "value").withColumnRenamed("grp", "similarity_id")


def counts(families: DataFrame, members: DataFrame, evidence: DataFrame, exact: DataFrame, similar: DataFrame, identities: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Eleven totals of a reduction per repository."""
    one = lambda df, name: df.groupBy("repo_id").agg(F.count(F.lit(1)).alias(name))
    out = one(families, "source_structural_families")
    unique = dedupe_diagnostics(diagnostics, "diagnostic_id", F.struct("code", "path", "message"))
    rows = diagnostics.groupBy("repo_id").agg(F.count(F.lit(1)).alias("source_diagnostic_rows"))
    uniq = diagnostics.select("repo_id", "diagnostic_id").distinct().join(unique.select("diagnostic_id"), "diagnostic_id").groupBy("repo_id").agg(F.count(F.lit(1)).alias("unique_diagnostics"))
    for df in (one(members, "source_structural_members"), one(evidence, "source_family_file_evidence"), one(exact, "exact_representations"), one(similar, "structural_similarity_groups"), one(identities, "observed_identities"), rows, uniq):
        out = out.join(df, "repo_id", "left")
    out = out.na.fill(0)
    return out.withColumns({
        "collapsed_source_families": F.greatest(F.lit(0), F.col("source_structural_families") - F.col("exact_representations")),
        "variant_exact_representations": F.col("exact_representations") - F.col("structural_similarity_groups"),
        "representative_evidence": F.col("exact_representations"),
    })
