"""Checks of stored tables, each as rows (code, ref); a table that passes gives none.

A check is a plan: anti-joins for references, groupings for uniqueness, recounts against stored counts. Nothing but problems
ever leaves Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import hashtree
from .classify import CONCEPTS, STRENGTHS, index_summary

# Sections of superseded contracts that an artifact must not have.
FORBIDDEN_SECTIONS = ("occurrences", "raw_observations", "observations", "facts_raw")


def problems(*checks: tuple[str, DataFrame, str], by_repo: bool = False) -> DataFrame:
    """The rows of each check with its code; ``ref`` is the column that names a row. ``by_repo``: with their repository,
    null where a check's rows have none."""
    out = None
    for code, rows, ref in checks:
        repo = F.col("repo_id") if "repo_id" in rows.columns else F.lit(None).cast("string").alias("repo_id")
        one = rows.select(*[repo] * by_repo, F.lit(code).alias("code"), F.col(ref).cast("string").alias("ref"))
        out = one if out is None else out.unionByName(one)
    return out


def repeated(df: DataFrame, *key: str) -> DataFrame:
    """Keys of several rows, with a repository of theirs where rows have one."""
    more = [F.min("repo_id").alias("repo_id")] * ("repo_id" in df.columns and "repo_id" not in key)
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *more).filter("_n > 1")


def unlike(a: DataFrame, b: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Keys of either table whose ``columns`` differ, or that the other table lacks."""
    left = a.select(*key, F.struct(*columns).alias("_a"))
    right = b.select(*key, F.struct(*columns).alias("_b"))
    return left.join(right, key, "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(*key)


def lineage(tables: dict[str, DataFrame]) -> DataFrame:
    """Per repository the roots of the tables that something is made from, a column each."""
    return hashtree.roots(hashtree.tables(tables)).groupBy("repo_id").pivot("table_name", list(tables)).agg(F.first("root"))


def lineage_breaks(stored: DataFrame, now: DataFrame, by_repo: bool = False) -> DataFrame:
    """Repositories whose source tables are no longer those that a product was made from."""
    names = [c for c in stored.columns if c != "repo_id"]
    return problems(("lineage_mismatch", unlike(stored, now, ["repo_id"], names), "repo_id"), by_repo=by_repo)


def artifact(families: DataFrame, evidence: DataFrame, members: DataFrame, by_repo: bool = False) -> DataFrame:
    """What a reduction asks of its source beyond ``export.verify``: no superseded section, stored counts that hold."""
    scopes = evidence.groupBy("family_id").agg(F.array_sort(F.collect_set("scope")).alias("now"))
    wrong = families.join(scopes, "family_id").filter(F.col("now") != F.col("scopes"))
    kinds = families.filter(F.col("family_kind").isNull() | (F.col("family_kind") == "") | (F.col("salience") < 0) | (F.col("file_count") > F.col("occurrence_count")))
    spread = members.join(families.select("family_id", "file_count"), "family_id").filter(F.col("observed_file_count") > F.col("file_count"))
    return problems(
        ("forbidden_section", families.filter(F.col("section").isin(*FORBIDDEN_SECTIONS)), "family_id"), ("family_scopes_mismatch", wrong, "family_id"),
        ("family_not_sane", kinds, "family_id"), ("member_file_count_too_large", spread, "member_id"),
        by_repo=by_repo,
    )


def reduced(exact: DataFrame, similar: DataFrame, identities: DataFrame, identity_members: DataFrame, variations: DataFrame, counts: DataFrame, by_repo: bool = False) -> DataFrame:
    """A reduction's tables: ids that follow from their bases, unique rows, references, sums and totals."""
    made = lambda df, column, name, *basis: df.filter(F.col(column) != S.stable_id(name, F.col("repo_id"), *basis))
    sums = exact.groupBy("repo_id", "similarity_id").agg(*[F.sum(c).alias(c) for c in ("source_family_count", "occurrence_count", "structural_member_count")], F.count(F.lit(1)).alias("exact_representation_count"))
    held = ["exact_representation_count", "source_family_count", "occurrence_count", "structural_member_count"]
    each = lambda df, name: df.groupBy("repo_id").agg(F.count(F.lit(1)).alias(name))
    now = counts.select("repo_id")
    for df, name in ((exact, "exact_representations"), (similar, "structural_similarity_groups"), (identities, "observed_identities")):
        now = now.join(each(df, name), "repo_id", "left")
    now = now.na.fill(0)
    totals = ["exact_representations", "structural_similarity_groups", "observed_identities"]
    no_origin = lambda df: df.filter("coalesce(representative_evidence_id, '') = '' or coalesce(representative_source_family_id, '') = ''")
    return problems(
        ("duplicate_exact_representation", repeated(exact, "exact_id"), "exact_id"), ("duplicate_similarity_group", repeated(similar, "similarity_id"), "similarity_id"), ("duplicate_observed_identity", repeated(identities, "identity_id"), "identity_id"),
        ("exact_id_basis_mismatch", made(exact, "exact_id", "exact", F.col("exact_basis")), "exact_id"), ("similarity_id_basis_mismatch", made(similar, "similarity_id", "similar", F.col("similar_basis")), "similarity_id"),
        ("identity_id_basis_mismatch", made(identities, "identity_id", "identity", F.col("family_kind"), F.col("family_label"), F.to_json("facet_rows")), "identity_id"),
        ("exact_without_representative", no_origin(exact), "exact_id"), ("identity_without_representative", no_origin(identities), "identity_id"), ("representative_evidence_reused", repeated(exact, "representative_evidence_id"), "representative_evidence_id"),
        ("similarity_group_mismatch", unlike(similar, sums, ["repo_id", "similarity_id"], held), "similarity_id"), ("identity_without_exact_representation", identities.join(identity_members, "identity_id", "left_anti"), "identity_id"),
        ("identity_member_unknown", identity_members.join(exact, "exact_id", "left_anti"), "exact_id"), ("identity_of_member_unknown", identity_members.join(identities, "identity_id", "left_anti"), "identity_id"),
        ("variation_without_group", variations.join(similar, "similarity_id", "left_anti"), "similarity_id"), ("variation_with_one_state", variations.filter("distinct_state_count < 2"), "similarity_id"),
        ("totals_mismatch", unlike(counts, now, ["repo_id"], totals), "repo_id"), ("fewer_families_than_representations", counts.filter("source_structural_families < exact_representations"), "repo_id"),
        by_repo=by_repo,
    )


def candidates(rows: DataFrame, repositories: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """Concept candidates: six concepts for each repository, each once; known strengths that their status follows; own
    signals only; absence never claimed. ``rules``: the signals of each concept."""
    six = rows.groupBy("repo_id").agg(F.array_sort(F.collect_set("concept")).alias("have")).filter(F.col("have") != F.array(*[F.lit(c) for c in sorted(CONCEPTS)]))
    expected = F.when(F.col("strength") == "not_observed", "not_observed").otherwise("candidate")
    own = F.lit(None)
    for concept, signals in rules.items():
        own = F.when(F.col("concept") == concept, F.array(*[F.lit(x) for x in signals])).otherwise(own)
    ref = rows.withColumn("ref", F.concat_ws("/", "repo_id", "concept"))
    return problems(
        ("concept_set_mismatch", six, "repo_id"), ("repository_without_candidates", repositories.select("repo_id").distinct().join(rows, "repo_id", "left_anti"), "repo_id"),
        ("duplicate_concept_candidate", repeated(ref, "ref"), "ref"), ("unknown_strength", ref.filter(~F.coalesce(F.col("strength").isin(*STRENGTHS), F.lit(False))), "ref"),
        ("status_strength_mismatch", ref.filter(~F.col("status").eqNullSafe(expected)), "ref"), ("absence_claimed", ref.filter(F.coalesce("absence_proven", F.lit(True))), "ref"),
        ("foreign_signal", ref.filter(F.size(F.array_except("signals", own)) > 0), "ref"), ("strength_without_signal", ref.filter((F.col("strength") != "not_observed") & (F.size("signals") == 0)), "ref"),
    )


def index(rows: DataFrame, summary: DataFrame, source: DataFrame) -> DataFrame:
    """A concept index: one row per repository with the six concepts, equal to its candidates, and a summary that holds."""
    names = F.array(*[F.lit(c) for c in sorted(CONCEPTS)])
    flat = rows.select("repo_id", F.explode("concepts").alias("concept", "v")).select("repo_id", "concept", "v.strength", "v.signals", "v.mechanisms").withColumn("ref", F.concat_ws("/", "repo_id", "concept"))
    src = source.withColumn("ref", F.concat_ws("/", "repo_id", "concept"))
    return problems(
        ("duplicate_repository", repeated(rows, "repo_id"), "repo_id"), ("concept_set_mismatch", rows.filter(F.array_sort(F.map_keys("concepts")) != names), "repo_id"),
        ("unknown_strength", flat.filter(~F.coalesce(F.col("strength").isin(*STRENGTHS), F.lit(False))), "ref"), ("index_candidate_mismatch", unlike(flat, src, ["ref"], ["strength", "signals", "mechanisms"]), "ref"),
        ("summary_mismatch", unlike(summary, index_summary(source), ["concept"], list(STRENGTHS)), "concept"),
    )


def provenance(observations: DataFrame, keys: list[str], *variants: Column) -> DataFrame:
    """Per key the distinct non-empty values of each variant column in canonical order; ``variants`` are named columns.

    Rows are made distinct by a grouping first, before the shuffle too, so the sets are taken over few rows however many
    observations a key has.
    """
    each = observations.select(*keys, *variants)
    names = [c for c in each.columns if c not in keys]
    text = lambda c: F.when(F.col(c).isNotNull() & ~F.col(c).cast("string").isin("", "{}", "[]"), F.col(c).cast("string"))
    few = each.select(*keys, *[text(c).alias(c) for c in names]).groupBy(*keys, *names).agg(F.count(F.lit(1)))
    return few.groupBy(*keys).agg(*[F.array_sort(F.collect_set(c)).alias(c + "_variants") for c in names])
