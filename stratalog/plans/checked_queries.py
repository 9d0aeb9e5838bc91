"""Registered queries over checks of stored tables: damage is planted by a rule, and SQL tells how many problems of which code
must be found."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, export, hashtree, reduce, validate
from ..tables import scratch, written
from .registry import query, table


def _codes(found):
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("problems"))


@query("""
WITH c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer), e AS (SELECT k, n, CASE WHEN k % 97 = 0 THEN 2 ELSE 1 END AS copies FROM c),
f AS (SELECT n, sum(copies) AS total FROM e GROUP BY 1)
SELECT * FROM (
  SELECT 'family_count_mismatch' AS code, count(*) AS problems FROM f WHERE n % 5 = 0 AND n <> 3 UNION ALL SELECT 'duplicate_evidence_id', count(*) FROM e WHERE copies = 2 UNION ALL SELECT 'duplicate_family_file_evidence', count(*) FROM e WHERE copies = 2
  UNION ALL SELECT 'evidence_without_family', CAST(coalesce(sum(copies), 0) AS BIGINT) FROM e WHERE n = 3 UNION ALL SELECT 'evidence_without_file', CAST(coalesce(sum(copies), 0) AS BIGINT) FROM e WHERE k % 101 = 0
  UNION ALL SELECT 'content_hash_mismatch', count(*) FROM c WHERE k % 50 = 0 AND k % 101 <> 0 UNION ALL SELECT 'span_not_sane', CAST(coalesce(sum(copies), 0) AS BIGINT) FROM e WHERE k % 53 = 0
  UNION ALL SELECT 'member_without_family', count(*) FROM c WHERE n = 3 UNION ALL SELECT 'duplicate_member_id', count(*) FROM c WHERE k % 89 = 0) WHERE problems > 0
""")
def verify_documents(spark, sf):
    """Uniqueness, foreign keys, recounts, spans and hashes of an artifact with planted damage."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_name")
    fid, fam = F.concat(F.lit("f"), k.cast("string")), F.concat(F.lit("n"), n.cast("string"))
    files = c.filter(k % 101 != 0).select(fid.alias("file_id"), F.col("c_name").cast("binary").alias("content"), F.lit(True).alias("readable"), F.when(k % 50 == 0, "0").otherwise(F.sha2("c_name", 256)).alias("sha256"))
    twice = F.explode(F.when(k % 97 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    line = F.when(k % 53 == 0, 0).otherwise(1)
    ev = c.select("*", twice.alias("copy")).select(fam.alias("family_id"), fid.alias("file_id"), F.concat(F.lit("e"), k.cast("string")).alias("evidence_id"), F.lit(1).cast("long").alias("occurrence_count_in_file"), F.struct(line.alias("line_start"), F.lit(1).alias("line_end")).alias("exemplar"))
    total = F.sum(F.when(k % 97 == 0, 2).otherwise(1)).cast("long")
    f = c.groupBy("c_nationkey").agg(total.alias("t")).filter(n != 3).select(fam.alias("family_id"), (F.col("t") + F.when(n % 5 == 0, 1).otherwise(0)).alias("occurrence_count"), F.col("t").alias("file_count"))
    m = c.select(fam.alias("family_id"), F.concat(F.lit("m"), k.cast("string")).alias("member_id"), k.alias("k"))
    m = m.unionByName(m.filter("k % 89 = 0")).drop("k")
    # a doubled member of the missing family counts in both checks
    return _codes(export.verify(f, ev, m.dropDuplicates(["family_id", "member_id"]), files).unionByName(validate.problems(("duplicate_member_id", validate.repeated(m, "member_id"), "member_id"))))


def _reduction(spark, sf):
    from .catalog import _reduced

    _, _, ev, based, exact = _reduced(spark, sf)
    sim, ids = reduce.similarity_groups(exact, based, ev), reduce.observed_identities(based, ev)
    var = reduce.variations(exact).join(sim.select("repo_id", "similarity_id"), "similarity_id")
    each = lambda df, name: df.groupBy("repo_id").agg(F.count(F.lit(1)).alias(name))
    counts = each(based, "source_structural_families")
    for df, name in ((exact, "exact_representations"), (sim, "structural_similarity_groups"), (ids, "observed_identities")):
        counts = counts.join(each(df, name), "repo_id")
    return {k: written(v, k) for k, v in dict(exact=exact, similar=sim, identities=ids, identity_members=reduce.identity_members(based), variations=var, counts=counts).items()}


_BUCKET = "CASE WHEN p_size <= 0 THEN 'zero' WHEN p_size <= 1 THEN 'one' WHEN p_size <= 4 THEN '2_4' WHEN p_size <= 16 THEN '5_16' WHEN p_size <= 64 THEN '17_64' ELSE 'more' END"


@query(f"""
WITH x AS (SELECT DISTINCT p_brand, p_type, p_size FROM part), s AS (SELECT p_brand, p_type, {_BUCKET} AS b, count(*) AS n FROM x GROUP BY ALL)
SELECT * FROM (
  SELECT 'similarity_group_mismatch' AS code, count(*) AS problems FROM s WHERE p_brand = 'Brand#1' UNION ALL SELECT 'totals_mismatch', count(DISTINCT p_brand) FROM part WHERE p_brand = 'Brand#2'
  UNION ALL SELECT 'exact_without_representative', count(*) FROM x WHERE p_brand = 'Brand#3' UNION ALL SELECT 'variation_with_one_state', count(*) FROM s WHERE n > 1 AND p_brand = 'Brand#4'
  UNION ALL SELECT 'exact_id_basis_mismatch', count(*) FROM x WHERE p_brand = 'Brand#5' UNION ALL SELECT 'identity_without_exact_representation', count(DISTINCT p_name || '/' || p_partkey % 3) FROM part WHERE p_brand = 'Brand#6'
  UNION ALL SELECT 'duplicate_observed_identity', count(DISTINCT p_name || '/' || p_partkey % 3) FROM part WHERE p_brand = 'Brand#7' UNION ALL SELECT 'totals_mismatch', count(DISTINCT p_brand) FROM part WHERE p_brand = 'Brand#7'
  UNION ALL SELECT 'fewer_families_than_representations', count(DISTINCT p_brand) FROM part WHERE p_brand = 'Brand#8') WHERE problems > 0
""".replace("SELECT * FROM (", "SELECT code, CAST(sum(problems) AS BIGINT) AS problems FROM (").replace(") WHERE problems > 0", ") WHERE problems > 0 GROUP BY 1"))
def reduction_problems(spark, sf):
    """Validation of a reduction with planted damage."""
    t = _reduction(spark, sf)
    of = lambda k: F.col("repo_id") == f"Brand#{k}"
    t["similar"] = t["similar"].withColumn("occurrence_count", F.col("occurrence_count") + of(1).cast("int"))
    t["counts"] = t["counts"].withColumn("observed_identities", F.col("observed_identities") + of(2).cast("int")).withColumn("source_structural_families", F.when(of(8), 0).otherwise(F.col("source_structural_families")))
    no = lambda c: F.when(of(3), None).otherwise(F.col(c))
    t["exact"] = t["exact"].withColumn("representative_source_family_id", no("representative_source_family_id")).withColumn("exact_basis", F.concat("exact_basis", F.when(of(5), " ").otherwise("")))
    t["variations"] = t["variations"].withColumn("distinct_state_count", F.when(of(4), 1).otherwise(F.col("distinct_state_count")))
    t["identity_members"] = t["identity_members"].filter(~of(6))
    t["identities"] = t["identities"].unionByName(t["identities"].filter(of(7)))
    return _codes(validate.reduced(**t))


def _candidates(spark, sf):
    from .catalog import _candidates as found

    return found(spark, sf).withColumn("k", F.regexp_extract("repo_id", r"(\d+)$", 1).cast("long") % 10)


_WITH = "WITH c AS (SELECT c_custkey % 10 AS k FROM customer)"


@query(f"""{_WITH}
SELECT * FROM (
  SELECT 'concept_set_mismatch' AS code, count(*) AS problems FROM c WHERE k = 0 UNION ALL SELECT 'unknown_strength', count(*) FROM c WHERE k = 1 UNION ALL SELECT 'absence_claimed', 6 * count(*) FROM c WHERE k = 2
  UNION ALL SELECT 'repository_without_candidates', count(*) FROM c WHERE k = 3 UNION ALL SELECT 'foreign_signal', count(*) FROM c WHERE k = 4 UNION ALL SELECT 'duplicate_concept_candidate', count(*) FROM c WHERE k = 5 UNION ALL SELECT 'status_strength_mismatch', count(*) FROM c WHERE k = 6)
WHERE problems > 0
""")
def candidate_problems(spark, sf):
    """Validation of concept candidates with planted damage."""
    c = _candidates(spark, sf)
    at = lambda k, concept: (F.col("k") == k) & (F.col("concept") == concept)
    c = c.filter(~at(0, "workflow") & (F.col("k") != 3)).unionByName(c.filter(at(5, "workflow")))
    c = c.withColumn("signals", F.when(at(1, "workflow"), F.array(F.lit("workflow_orchestration_annotation"))).when(at(4, "persistence"), F.array(F.lit("kafka_consumer"))).otherwise(F.col("signals")))
    c = c.withColumn("status", F.when(at(1, "workflow"), "candidate").when(at(6, "workflow"), "perhaps").otherwise(F.col("status")))
    c = c.withColumn("strength", F.when(at(1, "workflow"), "huge").otherwise(F.col("strength"))).withColumn("absence_proven", F.col("k") == 2)
    c = c.withColumn("strength", F.when(at(4, "persistence"), "weak").otherwise(F.col("strength"))).withColumn("status", F.when(at(4, "persistence"), "candidate").otherwise(F.col("status")))
    repos = table(spark, sf, "customer").select(F.concat(F.lit("repo"), F.col("c_custkey").cast("string")).alias("repo_id"))
    return _codes(validate.candidates(c, repos, {x: classify.concept_signals(x) for x in classify.CONCEPTS}))


@query(f"""{_WITH}
SELECT * FROM (
  SELECT 'duplicate_repository' AS code, count(*) AS problems FROM c WHERE k = 0 UNION ALL SELECT 'concept_set_mismatch', count(*) FROM c WHERE k = 1 UNION ALL SELECT 'index_candidate_mismatch', count(*) FROM c WHERE k = 1
  UNION ALL SELECT 'index_candidate_mismatch', 6 * count(*) FROM c WHERE k = 2 UNION ALL SELECT 'summary_mismatch', 1)
WHERE problems > 0
""".replace("SELECT * FROM (", "SELECT code, CAST(sum(problems) AS BIGINT) AS problems FROM (").replace("WHERE problems > 0", "WHERE problems > 0 GROUP BY 1"))
def index_problems(spark, sf):
    """Writing and validation of a concept index with planted damage."""
    c = _candidates(spark, sf)
    source = written(c, "candidates")
    k = F.regexp_extract("repo_id", r"(\d+)$", 1).cast("long") % 10
    x = classify.concept_index(source).filter(k != 2)
    x = x.unionByName(x.filter(k == 0)).withColumn("concepts", F.when(k == 1, F.map_filter("concepts", lambda n, _: n != "workflow")).otherwise(F.col("concepts")))
    total = classify.index_summary(source)
    total = total.withColumn("strong", F.col("strong") + (F.col("concept") == "workflow").cast("int"))
    return _codes(validate.index(x, total, source))


@query("SELECT 'n' || n_nationkey AS repo_id, CASE WHEN n_nationkey % 4 = 1 THEN 'lineage_mismatch' ELSE 'same' END AS state FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def lineage_states(spark, sf):
    """Products whose source tables changed since."""
    c = table(spark, sf, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("repo_id"), "c_custkey", "c_name")
    o = table(spark, sf, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("repo_id"), "c_acctbal")
    then = validate.lineage({"families": c, "evidence": o})
    changed = c.withColumn("c_name", F.when(F.regexp_extract("repo_id", r"(\d+)", 1).cast("int") % 4 == 1, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")))
    broken = validate.lineage_breaks(then, validate.lineage({"families": changed.orderBy("c_custkey"), "evidence": o}))
    return then.join(broken.select(F.col("ref").alias("repo_id"), "code"), "repo_id", "left").select("repo_id", F.coalesce("code", F.lit("same")).alias("state"))


@query("SELECT c_mktsegment AS repo_id, count(*) AS files, max(CASE WHEN c_mktsegment = 'BUILDING' THEN 'again' ELSE 'first' END) AS version FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1")
def artifact_replace(spark, sf):
    """Stored tables: a repository written again replaces its partition only, one without rows goes."""
    from . import build

    at = scratch(spark, "artifact")
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("repo_id"), "c_custkey")
    build.write(c.withColumn("version", F.lit("first")), at, "files", [r[0] for r in c.select("repo_id").distinct().collect()])
    build.write(c.filter("repo_id = 'BUILDING'").withColumn("version", F.lit("again")), at, "files", ["BUILDING", "MACHINERY"])
    return build.read(spark, at, "files").groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"), F.max("version").alias("version"))


@query("""
WITH n AS (SELECT count(DISTINCT c_nationkey) AS n FROM customer WHERE c_nationkey > 0)
SELECT unnest(['blobs', 'cas_index', 'evidence', 'facts', 'families', 'files', 'key_families', 'line_index', 'members', 'probe_status', 'snapshots']) AS table_name, 1 AS written, CAST(n AS INTEGER) AS kept, 'n0' AS changed FROM n
""")
def incremental_partitions(spark, sf):
    """An artifact of which one repository changed: one partition of each table is written, the others stay where they are."""
    from . import build
    from .parsed_queries import text

    at, c = scratch(spark, "artifact"), table(spark, sf, "customer")
    k = F.col("c_custkey")

    def raw(rows, version):
        body = text('{"name": "', F.col("c_name"), '", "v": ', version, "}").cast("binary")
        return rows.select(text("n", F.col("c_nationkey")).alias("repo_id"), text("c/", k, ".json").alias("path"), F.lit(False).alias("is_symlink"), F.octet_length(body).cast("long").alias("byte_size"), body.alias("content"), F.lit(None).cast("string").alias("error"))

    repos = [f"n{r[0]}" for r in c.select("c_nationkey").distinct().collect()]
    build.store(spark, raw(c, "1"), at, repos)
    first = build.tables.head(spark, at)
    build.store(spark, raw(c.filter("c_nationkey = 0"), "2"), at, ["n0"])
    now = build.tables.head(spark, at)
    rows = spark.read.parquet(*[f"{at}/data/{build.tables.INVENTORY}/_v={v}" for v in {v for t in now.tables.values() for v in t[1]} - {v for t in first.tables.values() for v in t[1]}])
    written_ = rows.groupBy("table_name").agg(F.count_distinct("repo_id").cast("int").alias("written"), F.max("repo_id").alias("changed"))
    kept = spark.createDataFrame([(t, sum(now.version_of(t)[r] == v for r, v in first.version_of(t).items())) for t in now.tables], "table_name string, kept int")
    return written_.join(kept, "table_name")


@query("""
WITH c AS (SELECT 'n' || c_nationkey AS repo_id, c_custkey % 97 = 0 AND c_custkey % 89 > 0 AS altered, c_custkey % 89 = 0 AS lost FROM customer),
r AS (SELECT repo_id, count(*) FILTER (altered) AS altered, count(*) FILTER (lost) AS lost, count(*) AS n FROM c GROUP BY 1)
SELECT repo_id, altered + lost > 0 AS damaged, CAST(n AS BIGINT) AS stored, CAST(n - lost AS BIGINT) AS found, CASE WHEN altered + lost > 0 THEN lost ELSE 0 END AS fewer_in_parts FROM r
""")
def damaged_parts(spark, sf):
    """Hash trees of a table before and after damage: which repositories' roots differ, and by how many rows their differing parts do."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("repo_id"), "c_custkey", "c_name")
    then = written(hashtree.tables({"t": c}), "parts")
    now = written(hashtree.tables({"t": c.filter(k % 89 != 0).withColumn("c_name", F.when(k % 97 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name"))).repartition(7)}), "parts")
    wrong = hashtree.differences(then, now).groupBy("repo_id").agg((F.sum(F.coalesce("stored", F.lit(0))) - F.sum(F.coalesce("found", F.lit(0)))).alias("fewer"))
    both = hashtree.roots(then).select("repo_id", F.col("root").alias("a")).join(hashtree.roots(now).select("repo_id", F.col("root").alias("b")), "repo_id", "left")
    rows = lambda t, name: t.groupBy("repo_id").agg(F.sum("rows").alias(name))
    out = both.join(rows(then, "stored"), "repo_id").join(rows(now, "found"), "repo_id", "left").join(wrong, "repo_id", "left")
    return out.select("repo_id", (~F.col("a").eqNullSafe(F.col("b"))).alias("damaged"), "stored", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("fewer", F.lit(0)).alias("fewer_in_parts"))


@query("""
WITH c AS (SELECT c_custkey AS k, c_custkey % 50 = 0 AS gone, c_custkey % 53 = 0 AND c_custkey % 50 > 0 AS other, c_custkey % 59 = 0 AND c_custkey % 50 > 0 AND c_custkey % 53 > 0 AS edited FROM customer)
SELECT * FROM (
  SELECT 'fragment_not_in_manifest' AS code, count(*) FILTER (gone OR other) AS problems FROM c UNION ALL SELECT 'fragment_missing', count(*) FILTER (other) FROM c
  UNION ALL SELECT 'checksum_missing', count(*) FILTER (other) FROM c UNION ALL SELECT 'checksum_unknown', count(*) FILTER (gone OR other) FROM c
  UNION ALL SELECT 'fragment_differs_from_source', count(*) FILTER (other OR edited) FROM c) WHERE problems > 0
""")
def pack_problems(spark, sf):
    """A written pack of fragments with planted damage, against its checksums and its source."""
    at, k = scratch(spark, "pack"), F.col("c_custkey")
    body = lambda end: F.concat(F.lit("head\r\n"), F.repeat(F.lit("x\n"), (k % 600).cast("int")), F.col("c_name"), F.lit(end)).cast("binary")
    c = table(spark, sf, "customer")
    path, line = F.concat(F.lit("c/"), k.cast("string")), (k % 600 + 2).cast("int")
    files = lambda content: c.select(F.lit("r").alias("repo_id"), path.alias("path"), F.lit(True).alias("readable"), content.alias("content"))
    frags = c.select(F.lit("r").alias("repo_id"), path.alias("path"), F.lit("s").alias("cas_sha"), F.lit("x").alias("fragment_scope"), F.array(path).alias("evidence_ids"), line.alias("line_start"), line.alias("line_end"))
    made = written(export.fragment_bytes(frags, files(body("\rtail"))), "fragments")
    export.write_pack(made, at)
    n = F.regexp_extract("path", r"(\d+)$", 1).cast("long")
    kept = made.drop("fragment").filter(n % 50 != 0)
    kept.withColumn("fragment_sha256", F.when(n % 53 == 0, F.sha2(F.concat("fragment_sha256", F.lit("?")), 256)).otherwise(F.col("fragment_sha256"))).write.mode("overwrite").parquet(f"{at}/manifest")
    now = files(F.when(k % 59 == 0, F.lit(b"gone\n")).otherwise(body("\rtail")))
    return _codes(export.verify_pack(spark, at, now))


@query("""
WITH o AS (SELECT o_orderpriority AS repo_id, o_orderstatus AS kind, o_orderkey % 3 AS p, o_orderkey % 4 AS b FROM orders)
SELECT repo_id, kind, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT 'probe' || p AS v FROM o x WHERE x.repo_id = o.repo_id AND x.kind = o.kind AND p > 0)) AS probes, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT '{"b":' || b || '}' AS v FROM o x WHERE x.repo_id = o.repo_id AND x.kind = o.kind AND b > 0)) AS bases FROM o GROUP BY ALL
""")
def provenance_variants(spark, sf):
    """Distinct non-empty provenance values in canonical order (A10)."""
    o = table(spark, sf, "orders")
    p, b = F.col("o_orderkey") % 3, F.col("o_orderkey") % 4
    rows = o.select(F.col("o_orderpriority").alias("repo_id"), F.col("o_orderstatus").alias("kind"), F.when(p > 0, F.concat(F.lit("probe"), p.cast("string"))).otherwise("").alias("probe"), F.when(b > 0, F.to_json(F.struct(b.alias("b")))).otherwise("{}").alias("basis"))
    v = validate.provenance(rows, ["repo_id", "kind"], F.col("probe"), F.col("basis"))
    return v.select("repo_id", "kind", F.array_join("probe_variants", ",").alias("probes"), F.array_join("basis_variants", ",").alias("bases"))
