"""Registered queries: each runs the library's operators over the driver's tables; SQL gives the same rows.

The tables stand in for repositories: pages and documents for files, a URL's path for a file's path, a document's
source or an event's user for a repository, HTML tags for structural elements, lines for spans.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import classify as C
from ..operators import export, facts, families, reduce, scan
from ..operators import relational as R
from ..tables import written
from . import checked_queries  # noqa: F401  registers its queries
from . import parsed_queries as P
from .registry import QUERIES, SQL, query, table

__all__ = ["QUERIES", "SQL"]

def _salience_sql(n: str) -> str:
    return f"round(least(100.0, least(35.0, 8.0 * log2(greatest({n}, 1) + 1)) + 20.0 + 10.0), 3)"


_LANGS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.EXTENSION_LANGUAGES.items())
_PATH = "regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?([^?#]*)', 1)"
_HOST = "lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1))"
_EXT = "lower(regexp_extract(regexp_replace(string_split(path, '/')[-1], '^\\.+', ''), '^.+(\\.[^.]+)$', 1))"
_TAGS = "regexp_extract_all(coalesce(html, ''), '<([a-zA-Z][a-zA-Z0-9]*)', 1)"


def _page_files(spark, sf):
    p = table(spark, sf, "pages")
    return P.files_of(p, F.lit("web"), P.text(F.col("page_id"), "/", S.url_path(F.col("url"))), F.col("html"))


def _document_files(spark, sf):
    d = table(spark, sf, "documents")
    return P.files_of(d, F.col("source"), P.text(F.col("doc_id"), ".txt"), F.col("text"))


def _span(kind, line):
    end = F.lit(None).cast("int")
    return F.struct(kind.alias("kind"), line.cast("int").alias("line_start"), line.cast("int").alias("line_end"), end.alias("column_start"), end.alias("column_end"))


def _facts(rows, repo, file, section, kind, label, descriptor, line=None):
    """Rows in the shape of facts, one observation each."""
    none = lambda t: F.lit(None).cast(t)
    at = none("int") if line is None else line.cast("int")
    return rows.select(
        repo.cast("string").alias("repo_id"), file.cast("string").alias("file_id"), file.cast("string").alias("path"), F.lit(".").alias("scope"), F.lit(section).alias("section"), F.lit(kind).alias("family_kind"), label.alias("family_label"), descriptor.alias("descriptor_json"),
        none("string").alias("member_json"), F.lit(1).cast("long").alias("occurrence_count"), at.alias("line_start"), at.alias("line_end"), none("int").alias("column_start"), none("int").alias("column_end"), none("string").alias("extra_json"),
    )


def _evidence(spark, fact):
    """Evidence of facts alone, without files."""
    no_files = scan.files(spark.createDataFrame([], "repo_id string, path string, is_symlink boolean, byte_size long, content binary, error string"))
    return families.evidence(families.observations(fact, no_files))


def _tag_evidence(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.explode(_tags()).alias("tag"))
    return _evidence(spark, _facts(p, F.lit("web"), F.col("page_id"), "xml_observations", "xml_observation", F.col("tag"), F.to_json(F.struct("tag"))))


def _tags(html="html"):
    return F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), 1), F.lower)


@query(f"""
WITH p AS (SELECT page_id, {_PATH} AS path FROM pages),
e AS (SELECT page_id, CASE WHEN {_EXT} = '' THEN '<none>' ELSE {_EXT} END AS extension FROM p)
SELECT extension, CASE WHEN l IS NULL THEN 'unclassified' ELSE 'language' END AS classification, l AS language, n AS occurrence_count,
       {_salience_sql("n")} AS salience
FROM (SELECT extension, CASE extension {_LANGS} END AS l, count(*) AS n FROM e GROUP BY ALL)
""")
def ext_families(spark, sf):
    """Extension families with salience."""
    fam = P.family_rows(_page_files(spark, sf), spark.createDataFrame([], facts.SCHEMA)).filter("family_kind = 'source_primitive'")
    return fam.select(F.col("family_label").alias("extension"), P.told("classification").alias("classification"), P.told("language").alias("language"), "occurrence_count", "salience")


@query("""
SELECT sha256(text) AS sha256, count(*) AS file_count, min(source || '/' || doc_id || '.txt') AS first_place, CAST(max(strlen(text)) AS BIGINT) AS byte_size FROM documents WHERE text IS NOT NULL GROUP BY 1
""")
def cas_blobs(spark, sf):
    """Content-addressed blobs."""
    first = F.concat_ws("/", "first.repo_id", "first.path")
    return scan.blobs(_document_files(spark, sf)).select("sha256", "file_count", first.alias("first_place"), "byte_size")


@query("""SELECT count(*) AS file_count, count(DISTINCT text) AS distinct_blob_count, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes FROM documents WHERE text IS NOT NULL""")
def cas_index_counts(spark, sf):
    """Index totals."""
    return scan.cas_counts(scan.cas_index(_document_files(spark, sf)))


@query(f"""
WITH p AS (SELECT page_id, {_HOST} AS host, string_split({_PATH}, '/') AS parts FROM pages),
s AS (SELECT host, CASE WHEN list_position(parts, 'src') > 0 THEN coalesce(nullif(array_to_string(parts[1:list_position(parts, 'src') - 1], '/'), ''), '.') WHEN len(parts) > 1 THEN parts[1] ELSE '.' END AS scope FROM p)
SELECT scope, count(*) AS occurrence_count, count(DISTINCT host) AS file_count FROM s GROUP BY 1
""")
def scope_dispersion(spark, sf):
    """Source-tree scopes and how far they spread (F02, A01). Two aggregations, no distinct over raw rows."""
    s = table(spark, sf, "pages").select(S.host_of(F.col("url")).alias("host"), S.source_tree_scope(S.url_path(F.col("url"))).alias("scope"))
    per = s.groupBy("scope", "host").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("scope").agg(F.sum("n").alias("occurrence_count"), F.count(F.lit(1)).alias("file_count"))


@query(f"""
SELECT source, n AS occurrence_count, {_salience_sql("n")} AS salience FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)
ORDER BY n DESC, source LIMIT 10
""")
def salience_by_source(spark, sf):
    """Top sources by count with salience."""
    g = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("occurrence_count"))
    return g.withColumn("salience", S.salience(F.col("occurrence_count"), F.lit("complete"))).orderBy(F.desc("occurrence_count"), "source").limit(10)


@query(f"""
WITH t AS (SELECT page_id, lower(unnest({_TAGS})) AS tag FROM pages)
SELECT tag, count(*) AS occurrence_count, count(DISTINCT page_id) AS file_count FROM t GROUP BY 1
""")
def tag_families(spark, sf):
    """Element families (P09, A04, A07): file counts come from the per-file evidence, not from a distinct."""
    fam = families.families(_tag_evidence(spark, sf), families.probe_status(spark.createDataFrame([], facts.SCHEMA)))
    return fam.select(F.col("family_label").alias("tag"), "occurrence_count", "file_count")


@query(f"SELECT page_id, lower(tag) AS tag, count(*) AS occurrence_count_in_file FROM (SELECT page_id, unnest({_TAGS}) AS tag FROM pages) GROUP BY ALL")
def family_file_counts(spark, sf):
    """Family by file evidence."""
    return _tag_evidence(spark, sf).select(F.col("file_id").cast("long").alias("page_id"), F.col("family_label").alias("tag"), "occurrence_count_in_file")


@query(f"""
WITH s AS (SELECT page_id, array_to_string(list_sort(list_distinct(list_transform({_TAGS}, lambda x: lower(x)))), '|') AS shape FROM pages)
SELECT sha256(shape) AS shape_fingerprint, count(*) AS document_count FROM s GROUP BY shape
""")
def page_shapes(spark, sf):
    """Document-shape families."""
    sign = F.to_json(F.struct(F.sha2(F.array_join(F.array_sort(F.array_distinct(_tags())), "|"), 256).alias("structural_signature")))
    ev = _evidence(spark, _facts(table(spark, sf, "pages"), F.lit("web"), F.col("page_id"), "structured_families", "structured_document_shape", F.lit("html"), sign))
    fam = families.families(ev, families.probe_status(spark.createDataFrame([], facts.SCHEMA)))
    return fam.select(P.told("structural_signature").alias("shape_fingerprint"), F.col("file_count").alias("document_count"))


@query("""
WITH k AS (SELECT event_id, user_id, unnest(json_keys(props)) AS key FROM events)
SELECT 'json' AS syntax, key, count(*) AS occurrence_count, count(DISTINCT user_id) AS file_count FROM k GROUP BY key
""")
def props_key_families(spark, sf):
    """Key families of JSON documents."""
    k = R.json_keys_exploded(table(spark, sf, "events").select("user_id", "props"), "props")
    per = k.groupBy("key", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("key").agg(F.sum("n").alias("occurrence_count"), F.count(F.lit(1)).alias("file_count")).withColumn("syntax", F.lit("json"))


@query("""
SELECT key, CASE WHEN t IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN 'number' WHEN t = 'VARCHAR' THEN 'string' WHEN t = 'BOOLEAN' THEN 'boolean' WHEN t = 'ARRAY' THEN 'sequence' WHEN t = 'OBJECT' THEN 'mapping' ELSE 'null' END AS value_kind, count(*) AS n
FROM (SELECT key, json_type(props, '$.' || key) AS t FROM (SELECT props, unnest(json_keys(props)) AS key FROM events)) GROUP BY ALL
""")
def props_value_kinds(spark, sf):
    """Kinds of values by key."""
    e = table(spark, sf, "events").select(F.parse_json("props").alias("v"))
    rows = e.selectExpr("explode(cast(v as map<string, variant>)) as (key, value)")
    t = F.schema_of_variant("value")
    kind = F.when(t.isin("BIGINT", "DOUBLE") | t.startswith("DECIMAL"), "number").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t.startswith("ARRAY"), "sequence").when(t.startswith("OBJECT"), "mapping").otherwise("null")
    return rows.select("key", kind.alias("value_kind")).groupBy("key", "value_kind").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH l AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
h AS (SELECT source, doc_id, i AS line_no FROM (SELECT *, unnest(generate_series(1, len(lines))) AS i FROM l) WHERE contains(lower(lines[i]), 'license'))
SELECT source, doc_id, count(*) AS hits, CAST(min(line_no) AS INTEGER) AS line_no FROM h GROUP BY ALL
""")
def evidence_first_line(spark, sf):
    """Best exemplar per family and file (A08, W02): least of a total order, with partial aggregation."""
    d = table(spark, sf, "documents").filter(F.contains(F.lower("text"), F.lit("license")))
    h = d.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).filter(F.contains(F.lower("line"), F.lit("license")))
    ev = _evidence(spark, _facts(h, F.lit("docs"), F.col("doc_id"), "lines", "line_observation", F.col("source"), F.to_json(F.struct("source")), F.col("p") + 1))
    return ev.select(F.col("family_label").alias("source"), F.col("file_id").cast("long").alias("doc_id"), F.col("occurrence_count_in_file").alias("hits"), F.col("exemplar.line_start").alias("line_no"))


_BUCKET = "CASE WHEN p_size <= 0 THEN 'zero' WHEN p_size <= 1 THEN 'one' WHEN p_size <= 4 THEN '2_4' WHEN p_size <= 16 THEN '5_16' WHEN p_size <= 64 THEN '17_64' ELSE 'more' END"


def _part_families(spark, sf):
    """(families with their bases, evidence) of parts: a brand is a repository, type and size are the structure."""
    p = table(spark, sf, "part")
    d = F.to_json(F.struct(F.col("p_type").alias("type_kind"), F.col("p_size").alias("size"), F.concat(F.lit("n"), (F.col("p_partkey") % 3).cast("string")).alias("note")))
    key = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    fam = p.select(F.col("p_brand").alias("repo_id"), F.concat(F.lit("f"), key).alias("family_id"), F.lit("parts").alias("section"), F.lit("part").alias("family_kind"), F.col("p_name").alias("family_label"), d.alias("descriptor_json"), F.col("p_size").cast("long").alias("occurrence_count"), F.lit(1).cast("long").alias("file_count"), F.lit(50.0).alias("salience"))
    none = spark.createDataFrame([], "repo_id string, family_id string, member_id string, syntax string, parse_status string, member_json string, observed_file_count long")
    ev = p.select(F.col("p_brand").alias("repo_id"), F.concat(F.lit("f"), key).alias("family_id"), (F.col("p_partkey") % 10).cast("string").alias("file_id"), F.concat(F.lit("e"), key).alias("evidence_id"))
    return fam, none, ev


def _reduced(spark, sf):
    fam, none, ev = _part_families(spark, sf)
    based = written(reduce.bases(fam, none), "bases")
    exact = written(reduce.exact_representations(based, ev), "exact")
    return fam, none, ev, based, exact


@query("""
SELECT p_brand AS repo_id, p_type, p_size AS size, count(*) AS source_family_count, CAST(sum(p_size) AS BIGINT) AS occurrence_count, count(DISTINCT p_partkey % 10) AS file_count, count(*) AS family_file_evidence_count,
       'e' || lpad(CAST(min(p_partkey) AS VARCHAR), 9, '0') AS representative_evidence_id, count(DISTINCT p_name || '/' || p_partkey % 3) AS observed_identity_count, CAST(50.0 * count(*) AS DOUBLE) AS salience_sum
FROM part GROUP BY ALL
""")
def exact_shapes(spark, sf):
    """Exact-shape rollup: names are no part of it."""
    exact = _reduced(spark, sf)[4]
    seen = F.get_json_object("exact_basis", "$.observed_metrics")
    return exact.select(
        "repo_id", F.get_json_object(seen, "$.type_kind").alias("p_type"), F.get_json_object(seen, "$.size").cast("int").alias("size"), "source_family_count", "occurrence_count", "file_count",
        "family_file_evidence_count", "representative_evidence_id", "observed_identity_count", "salience_sum",
    )


@query(f"""
SELECT p_brand AS repo_id, p_type, {_BUCKET} AS size_bucket, count(DISTINCT p_size) AS exact_representation_count, count(*) AS source_family_count, CAST(sum(p_size) AS BIGINT) AS occurrence_count, count(DISTINCT p_partkey % 10) AS file_count FROM part GROUP BY ALL
""")
def similarity_buckets(spark, sf):
    """Similarity rollup over exact rows."""
    _, _, ev, based, exact = _reduced(spark, sf)
    g = reduce.similarity_groups(exact, based, ev)
    seen = F.get_json_object("similar_basis", "$.observed_metrics")
    return g.select("repo_id", F.get_json_object(seen, "$.type_kind").alias("p_type"), F.get_json_object(seen, "$.size.numeric_bucket").alias("size_bucket"), "exact_representation_count", "source_family_count", "occurrence_count", "file_count")


@query(f"""
WITH g AS (SELECT p_brand, p_type, {_BUCKET} AS b, count(DISTINCT p_size) AS n FROM part GROUP BY ALL)
SELECT p_brand AS repo_id, '$.observed_metrics' AS path, n AS distinct_state_count, count(*) AS groups FROM g WHERE n > 1 GROUP BY ALL
""")
def shape_variations(spark, sf):
    """What varies within similarity groups."""
    exact = _reduced(spark, sf)[4]
    v = reduce.variations(exact).join(exact.select("repo_id", "similarity_id").distinct(), "similarity_id")
    return v.groupBy("repo_id", "path", "distinct_state_count").agg(F.count(F.lit(1)).alias("groups"))


@query(f"""
SELECT p_brand AS repo_id, count(*) AS source_structural_families, count(*) AS source_family_file_evidence, count(DISTINCT p_type || '/' || p_size) AS exact_representations, count(DISTINCT p_type || {_BUCKET}) AS structural_similarity_groups,
       count(DISTINCT p_name || '/' || p_partkey % 3) AS observed_identities, count(*) - count(DISTINCT p_type || '/' || p_size) AS collapsed_source_families, 3 AS source_diagnostic_rows, 2 AS unique_diagnostics FROM part GROUP BY 1
""")
def reduction_counts(spark, sf):
    """Totals of a reduction."""
    fam, none, ev, based, exact = _reduced(spark, sf)
    d = fam.select("repo_id").distinct().select("repo_id", F.explode(F.array(*[F.lit(x) for x in "aab"])).alias("k")).select("repo_id", F.concat("repo_id", "k").alias("diagnostic_id"), F.lit("c").alias("code"), F.lit("p").alias("path"), F.lit("m").alias("message"))
    n = reduce.counts(fam, none, ev, exact, reduce.similarity_groups(exact, based, ev), reduce.observed_identities(based, ev), d)
    return n.select("repo_id", "source_structural_families", "source_family_file_evidence", "exact_representations", "structural_similarity_groups", "observed_identities", "collapsed_source_families", F.col("source_diagnostic_rows").cast("int").alias("source_diagnostic_rows"), F.col("unique_diagnostics").cast("int").alias("unique_diagnostics"))


@query(f"""
WITH e AS (SELECT page_id, {_HOST} AS host, lower(tag) AS tag, count(*) AS n FROM (SELECT page_id, url, unnest({_TAGS}) AS tag FROM pages) GROUP BY ALL),
m AS (SELECT DISTINCT host, page_id FROM e), t AS (SELECT DISTINCT host, tag FROM e)
SELECT host, tag, count(DISTINCT coalesce(CAST(n AS VARCHAR), '<missing>')) AS distinct_state_count
FROM t JOIN m USING (host) LEFT JOIN e USING (host, page_id, tag) GROUP BY ALL HAVING count(DISTINCT coalesce(CAST(n AS VARCHAR), '<missing>')) > 1
""")
def variation_dims(spark, sf):
    """Paths that vary within a group (A15), without pairing paths with members."""
    rows = table(spark, sf, "pages").select("page_id", S.host_of(F.col("url")).alias("host"), F.explode(_tags()).alias("tag")).groupBy("host", "page_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    return R.variation_dimensions(rows, "host", "page_id", "tag", "n")


@query("""
SELECT p_brand AS repo_id, p_name AS family_label, 'n' || p_partkey % 3 AS facets, count(DISTINCT p_type || '/' || p_size) AS exact_representation_count, count(*) AS source_family_count, CAST(sum(p_size) AS BIGINT) AS occurrence_count,
       count(DISTINCT p_partkey % 10) AS file_count, 'e' || lpad(CAST(min(p_partkey) AS VARCHAR), 9, '0') AS representative_evidence_id FROM part GROUP BY ALL
""")
def identity_rollup(spark, sf):
    """Observed identities: names that shapes set aside."""
    _, _, ev, based, _ = _reduced(spark, sf)
    g = reduce.observed_identities(based, ev)
    return g.select("repo_id", "family_label", F.array_join("facets", ",").alias("facets"), "exact_representation_count", "source_family_count", "occurrence_count", "file_count", "representative_evidence_id")


@query("""SELECT sha256(text) AS diagnostic_id, count(*) AS source_row_count, count(DISTINCT source) AS distinct_variant_count, count(DISTINCT source) > 1 AS identity_conflict FROM documents WHERE text IS NOT NULL GROUP BY text""")
def diag_dedupe(spark, sf):
    """Diagnostics by identity with conflicts."""
    d = table(spark, sf, "documents").filter("text is not null").select(F.sha2("text", 256).alias("diagnostic_id"), "source")
    return R.dedupe_diagnostics(d, "diagnostic_id", F.col("source"))


# Rules over the test documents; patterns are plain, so that both engines read them alike.
_DOC_RULES = [("mentions_license", ["en", "de", "fr", "es"], "license"), ("shouts", ["en"], "!! [a-z]+!!"), ("table_rows", ["en", "fr"], "[a-z]+ \\| [a-z]+ \\|"), ("ends_that", ["en"], "that\\.$"), ("never", ["xx"], ".+")]
_RULE_VALUES = ", ".join("('{}', [{}], '{}')".format(s, ", ".join(f"'{k}'" for k in ks), p) for s, ks, p in _DOC_RULES)


def _doc_rule_hits(spark, sf):
    rules = spark.createDataFrame([(s, k, "(?i)" + p, None) for s, k, p in _DOC_RULES], "signal_id string, kinds array<string>, label_pattern string, facet_pattern string")
    return R.rule_matches(table(spark, sf, "documents").select("doc_id", "source", "lang", "text"), rules, kind="lang", label="text", facets=None)


_HITS = f"h AS (SELECT r.signal_id, d.doc_id, d.source, d.lang FROM documents d JOIN (VALUES {_RULE_VALUES}) AS r(signal_id, kinds, pattern) ON list_contains(r.kinds, d.lang) AND regexp_matches(d.text, r.pattern, 'i'))"


@query(f"WITH {_HITS} SELECT signal_id, doc_id FROM h")
def rule_matches(spark, sf):
    """Rule table against identities."""
    return _doc_rule_hits(spark, sf).select("signal_id", "doc_id")


@query(f"""WITH {_HITS} SELECT source, signal_id, count(DISTINCT doc_id) AS identities, CAST(sum(n_chars) AS BIGINT) AS occurrence_count, array_to_string(list_sort(list(DISTINCT doc_id::VARCHAR))[1:12], ',') AS samples, count(DISTINCT doc_id) > 12 AS truncated FROM h JOIN documents USING (doc_id, source) GROUP BY ALL""")
def signal_rollup(spark, sf):
    """Signals with bounded samples."""
    rules = spark.createDataFrame([(s, ["c"], k, "(?i)" + p, None, None, "b") for s, k, p in _DOC_RULES], "signal_id string, concepts array<string>, kinds array<string>, label_pattern string, facet_pattern string, mechanism string, basis string")
    one = F.lit(1).cast("long")
    ids = table(spark, sf, "documents").select(F.col("source").alias("repo_id"), F.col("doc_id").cast("string").alias("identity_id"), F.col("lang").alias("family_kind"), F.col("text").alias("family_label"), F.lit(None).cast("array<string>").alias("facets"), one.alias("source_family_count"), F.col("n_chars").alias("occurrence_count"), one.alias("file_count"), F.col("doc_id").cast("string").alias("representative_evidence_id"))
    g = C.signals(ids, rules)
    return g.select(F.col("repo_id").alias("source"), "signal_id", F.col("observed_identity_count").alias("identities"), "occurrence_count", F.array_join("observed_identity_ids", ",").alias("samples"), F.col("identity_sample_truncated").alias("truncated"))


_SIGNALS = [r[0] for r in C.SIGNAL_RULES]
_MECHS = {r[0]: r[5] for r in C.SIGNAL_RULES}


def _found_signals(spark, sf):
    """(repo, signal) pairs: a customer is a repository, each of its orders a signal."""
    k = F.col("o_orderkey") % len(_SIGNALS) + 1
    pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), k.cast("int"))
    return table(spark, sf, "orders").select(F.concat(F.lit("repo"), F.col("o_custkey").cast("string")).alias("repo_id"), pick(_SIGNALS).alias("signal_id"), pick([_MECHS[s] for s in _SIGNALS]).alias("mechanism")).distinct()


def _candidates(spark, sf):
    repos = table(spark, sf, "customer").select(F.concat(F.lit("repo"), F.col("c_custkey").cast("string")).alias("repo_id"))
    return C.concept_candidates(repos, _found_signals(spark, sf))


def _concept_case(concept: str) -> str:
    parts = []
    for name, *conditions in C.STRENGTH_RULES[concept]:
        test = " AND ".join("len(list_filter(sigs, lambda x: list_contains([{}], x))) >= {}".format(", ".join(f"'{i}'" for i in ids), n) for n, ids in conditions)
        parts.append(f"WHEN {test} THEN '{name}'")
    return "CASE " + " ".join(parts) + " ELSE 'not_observed' END"


_S = ", ".join(f"'{s}'" for s in _SIGNALS)
_M = ", ".join("NULL" if _MECHS[s] is None else f"'{_MECHS[s]}'" for s in _SIGNALS)
_CANDS = (
    f"f AS (SELECT DISTINCT 'repo' || o_custkey AS repo_id, [{_S}][o_orderkey % {len(_SIGNALS)} + 1] AS s, [{_M}][o_orderkey % {len(_SIGNALS)} + 1] AS m FROM orders), "
    "r AS (SELECT DISTINCT 'repo' || c_custkey AS repo_id FROM customer), "
    "g AS (SELECT r.repo_id, coalesce(list(s) FILTER (s IS NOT NULL), []) AS sigs FROM r LEFT JOIN f USING (repo_id) GROUP BY 1), "
    "c AS ("
    + " UNION ALL ".join(f"SELECT repo_id, '{c}' AS concept, {_concept_case(c)} AS strength, list_sort(list_filter(sigs, lambda x: list_contains([{', '.join(repr(i) for i in C.concept_signals(c))}], x))) AS signals FROM g" for c in C.CONCEPTS)
    + ")"
)


@query(f"WITH {_CANDS} SELECT repo_id, concept, strength, CASE WHEN strength = 'not_observed' THEN 'not_observed' ELSE 'candidate' END AS status, array_to_string(signals, ',') AS signals FROM c")
def concept_strength(spark, sf):
    """Six rows per repository."""
    return _candidates(spark, sf).select("repo_id", "concept", "strength", "status", F.array_join("signals", ",").alias("signals"))


@query(f"""WITH {_CANDS}, o AS (SELECT 'repo' || o_custkey AS repo_id, [{_S}][o_orderkey % {len(_SIGNALS)} + 1] AS signal_id, count(*) AS n FROM orders GROUP BY ALL)
SELECT repo_id, concept, signal_id, n AS occurrence_count FROM (SELECT repo_id, concept, unnest(signals) AS signal_id FROM c) JOIN o USING (repo_id, signal_id)""")
def candidate_basis(spark, sf):
    """The signals that each candidate rests on."""
    named = _found_signals(spark, sf)
    k = F.col("o_orderkey") % len(_SIGNALS) + 1
    n = table(spark, sf, "orders").groupBy(F.concat(F.lit("repo"), F.col("o_custkey").cast("string")).alias("repo_id"), F.element_at(F.array(*[F.lit(v) for v in _SIGNALS]), k.cast("int")).alias("signal_id")).agg(F.count(F.lit(1)).alias("occurrence_count"))
    return C.basis_rows(_candidates(spark, sf), named.drop("mechanism").join(n, ["repo_id", "signal_id"]).withColumn("concepts", F.lit(None))).select("repo_id", "concept", "signal_id", "occurrence_count")


@query(f"WITH {_CANDS} SELECT concept, " + ", ".join(f"count(*) FILTER (strength = '{s}') AS {s}" for s in C.STRENGTHS) + " FROM c GROUP BY 1")
def strength_pivot(spark, sf):
    """Index summary with zeros."""
    return C.index_summary(_candidates(spark, sf))


@query(f"WITH {_CANDS} SELECT repo_id, strength, array_to_string(signals, ',') AS signals FROM c WHERE concept = 'system_interaction' AND strength IN ('moderate', 'strong') AND len(list_filter(signals, lambda x: x IN ('kafka_consumer', 'kafka_producer'))) > 0")
def index_lookup(spark, sf):
    """Lookup by concept, least strength and mechanism."""
    return C.lookup(_candidates(spark, sf), "system_interaction", "moderate", "kafka").select("repo_id", "strength", F.array_join("signals", ",").alias("signals"))


_LINE_HITS = """l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, len(lines) AS n, i FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS i FROM l) WHERE contains(lower(lines[i]), 'license') OR contains(lines[i], '@')),
w AS (SELECT doc_id, greatest(1, i - 1) AS a, least(n, i + 1) AS b FROM h),
f AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS x FROM w),
s AS (SELECT *, sum(x) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM f)"""


def _fragments(spark, sf, context=1):
    d = table(spark, sf, "documents").filter("text is not null").filter(F.contains(F.lower("text"), F.lit("license")) | F.contains("text", F.lit("@")))
    lines = d.select("doc_id", F.split("text", "\n").alias("ls"))
    hits = lines.select("doc_id", F.size("ls").alias("n"), F.posexplode("ls").alias("p", "line")).filter(F.contains(F.lower("line"), F.lit("license")) | F.contains("line", F.lit("@")))
    spans = hits.select("doc_id", "n", (F.col("p") + 1).cast("long").alias("line_start"), (F.col("p") + 1).cast("long").alias("line_end"))
    return R.merge_intervals(R.widen_spans(spans, "line_start", "line_end", "n", context).filter("in_bounds"), ["doc_id"], "line_start", "line_end")


@query(f"WITH {_LINE_HITS} SELECT doc_id, min(a) AS line_start, max(b) AS line_end, count(*) AS intervals FROM s GROUP BY doc_id, island")
def fragment_islands(spark, sf):
    """Spans widened, clamped and merged."""
    return _fragments(spark, sf)


@query(f"""WITH {_LINE_HITS}, i AS (SELECT doc_id, min(a) AS line_start, max(b) AS line_end FROM s GROUP BY doc_id, island)
SELECT i.doc_id, line_start, line_end, sha256(array_to_string(lines[line_start:line_end], chr(10))) AS content_sha256 FROM i JOIN l USING (doc_id)""")
def fragment_slices(spark, sf):
    """Exact source fragments (F14, J16): text is sliced beside its islands, then only hashes go on."""
    d = table(spark, sf, "documents").filter("text is not null").filter(F.contains(F.lower("text"), F.lit("license")) | F.contains("text", F.lit("@"))).select("doc_id", "text")
    f = _fragments(spark, sf).join(d, "doc_id")
    cut = F.array_join(F.slice(F.split("text", "\n"), F.col("line_start").cast("int"), (F.col("line_end") - F.col("line_start") + 1).cast("int")), "\n")
    return f.select("doc_id", "line_start", "line_end", F.sha2(cut, 256).alias("content_sha256"))


def _resolution(spark, sf, ids, limit=5000):
    files = _document_files(spark, sf)
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("evidence_id"), F.col("source").alias("repo_id"), P.text(F.col("doc_id"), ".txt").alias("path"), _span(F.lit("file"), F.lit(None)).alias("exemplar"))
    wanted = export.requested_ids(ids.select(F.concat(F.lit(" "), ids[ids.columns[0]].cast("string")).alias("evidence_id")))
    return export.resolve(wanted, d, scan.cas_index(files), files, file_scope_bytes=limit)


@query("""
WITH q AS (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id * 3 FROM labels UNION ALL SELECT conv_id FROM conversations))
SELECT q.doc_id, CASE WHEN d.doc_id IS NULL THEN 'family_file_evidence_not_found' WHEN d.text IS NULL THEN 'captured_source_missing' WHEN strlen(d.text) > 5000 THEN 'file_scope_evidence_exceeds_fragment_limit' ELSE 'resolved' END AS status
FROM q LEFT JOIN documents d USING (doc_id)
""")
def requested_resolution(spark, sf):
    """Requested ids against evidence and content, each miss a status of its own."""
    lab, conv = table(spark, sf, "labels"), table(spark, sf, "conversations")
    q = lab.select("doc_id").union(lab.select(F.col("doc_id") * 3)).union(conv.select("conv_id"))
    return _resolution(spark, sf, q).select(F.col("evidence_id").cast("long").alias("doc_id"), "status")


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unresolved_antijoin(spark, sf):
    """Requested minus resolved."""
    return R.missing_ids(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query(f"""
WITH h AS (SELECT page_id, {_HOST} AS host FROM pages), s AS (SELECT DISTINCT array_to_string(string_split(host, '.')[-2:], '.') AS suffix FROM h)
SELECT suffix, count(*) AS pages, min(page_id) AS first_page FROM s JOIN h ON h.host = s.suffix OR ends_with(h.host, '.' || s.suffix) GROUP BY 1
""")
def suffix_join(spark, sf):
    """Dotted-suffix theta join as an equi-join."""
    h = table(spark, sf, "pages").select("page_id", S.host_of(F.col("url")).alias("host"))
    parts = F.split("host", r"\.")
    n = F.least(F.lit(2), F.size(parts))
    s = h.select(F.array_join(F.slice(parts, -n, n), ".").alias("suffix")).distinct()
    return R.suffix_match(s, "suffix", h, "host", S.dotted_suffixes).groupBy("suffix").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))


@query("""
WITH u AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1)
SELECT c_custkey, o_orderkey FROM customer JOIN u ON c_custkey = o_custkey JOIN orders USING (o_custkey)
""")
def unique_match_join(spark, sf):
    """Join only where the other side is unambiguous."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return R.unique_match(table(spark, sf, "customer").select("c_custkey"), o, ["c_custkey"])


@query("""
SELECT c_custkey, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, coalesce(cands, '') AS candidates
FROM customer LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS cands FROM orders GROUP BY 1) ON c_custkey = o_custkey
""")
def ambiguity_status(spark, sf):
    """None, one or several candidates."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return R.resolution(table(spark, sf, "customer").select("c_custkey"), o, ["c_custkey"], "o_orderpriority").select("c_custkey", "status", F.array_join("candidates", ",").alias("candidates"))


@query("""
WITH e AS (SELECT user_id, event_id % 2 AS cut, max(event_id) AS last, count(*) AS n, min(event_type) AS kind FROM events GROUP BY ALL),
c AS (SELECT user_id, n % 5 AS resolved_commit, kind AS repository_url FROM e WHERE cut = 0), p AS (SELECT user_id, n % 5 AS resolved_commit, kind AS repository_url FROM e WHERE cut = 1 AND user_id % 7 <> 3)
SELECT c.user_id, CASE WHEN p.user_id IS NULL THEN 'no_previous_result' WHEN c.resolved_commit <> p.resolved_commit THEN 'resolved_commit_changed' WHEN c.repository_url <> p.repository_url THEN 'repository_url_changed' ELSE 'unchanged' END AS reason,
       CASE WHEN p.user_id IS NOT NULL AND c.resolved_commit = p.resolved_commit AND c.repository_url = p.repository_url THEN 'reuse' ELSE 'rebuild' END AS action
FROM c LEFT JOIN p USING (user_id)
""")
def resume_reuse(spark, sf):
    """Reuse of earlier results."""
    e = table(spark, sf, "events").groupBy("user_id", (F.col("event_id") % 2).alias("cut")).agg(F.count(F.lit(1)).alias("n"), F.min("event_type").alias("repository_url")).withColumn("resolved_commit", F.col("n") % 5)
    now, before = e.filter("cut = 0").drop("cut", "n"), e.filter("cut = 1 and user_id % 7 <> 3").drop("cut", "n")
    return R.reuse_decision(now, before, "user_id", ["resolved_commit", "repository_url"]).select("user_id", "reason", "action")


@query("""
WITH a AS (SELECT DISTINCT s_suppkey, unnest([lower(s_name), 'nation' || s_nationkey, 'S' || s_suppkey]) AS k FROM supplier), b AS (SELECT DISTINCT s_suppkey, lower(trim(k)) AS k FROM a),
q AS (SELECT n_nationkey AS position, ' Nation' || n_nationkey AS selector FROM nation UNION ALL SELECT 100 + n_nationkey, 's' || n_nationkey FROM nation UNION ALL SELECT 200 + n_nationkey, 'SUPPLIER#' || lpad(CAST(n_nationkey AS VARCHAR), 9, '0') FROM nation),
m AS (SELECT position, selector, count(DISTINCT s_suppkey) AS matches, min(s_suppkey) AS r FROM q LEFT JOIN b ON lower(trim(selector)) = k GROUP BY ALL),
f AS (SELECT r, min(position) AS first FROM m WHERE matches = 1 GROUP BY 1)
SELECT position, selector, CASE WHEN matches = 1 THEN m.r END AS s_suppkey, matches, CASE WHEN matches = 0 THEN 'missing' WHEN matches > 1 THEN 'ambiguous' WHEN position > first THEN 'duplicate' ELSE 'selected' END AS status FROM m LEFT JOIN f ON m.r = f.r
""")
def selector_match(spark, sf):
    """Selectors against aliases."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    text = F.col("k").cast("string")
    q = n.select(F.col("k").alias("position"), F.concat(F.lit(" Nation"), text).alias("selector")).union(n.select(F.col("k") + 100, F.concat(F.lit("s"), text))).union(n.select(F.col("k") + 200, F.concat(F.lit("SUPPLIER#"), F.lpad(text, 9, "0"))))
    aliases = F.array("s_name", F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")))
    return R.match_selectors(q, table(spark, sf, "supplier"), aliases, "s_suppkey")


@query("""
WITH g AS (SELECT p_brand, p_type, CASE WHEN count(DISTINCT p_name) FILTER (p_size < 8) = 1 THEN max(p_name) FILTER (p_size < 8) END AS pref, CASE WHEN count(DISTINCT p_name) = 1 THEN max(p_name) END AS sole FROM part GROUP BY ALL)
SELECT p_partkey, p_name, coalesce(pref, sole, p_name) AS aligned_p_name FROM part JOIN g USING (p_brand, p_type)
""")
def payload_align(spark, sf):
    """One preferred descriptor wins within a key."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_name", "p_size")
    return R.align_payloads(p, ["p_brand", "p_type"], "p_name", F.col("p_size") < 8).select("p_partkey", "p_name", "aligned_p_name")


@query("""
WITH q AS (SELECT DISTINCT doc_id * 3 AS doc_id FROM labels), r AS (SELECT q.doc_id, d.text, d.text IS NOT NULL AND strlen(d.text) <= 5000 AS ok FROM q LEFT JOIN documents d USING (doc_id))
SELECT count(*) AS requested, count(*) FILTER (ok) AS resolved, count(*) FILTER (NOT ok) AS unresolved, count(*) FILTER (ok) AS fragments, count(DISTINCT text) FILTER (ok) AS distinct_blobs, CASE WHEN count(*) FILTER (NOT ok) = 0 THEN 'complete' WHEN count(*) FILTER (ok) > 0 THEN 'partial' ELSE 'failed' END AS status FROM r
""")
def export_counts(spark, sf):
    """Export totals and status."""
    got = written(_resolution(spark, sf, table(spark, sf, "labels").select(F.col("doc_id") * 3)), "resolution")
    return export.export_counts(got, export.fragments(got))


@query(f"""WITH {_LINE_HITS}, i AS (SELECT doc_id, min(a) AS line_start, max(b) AS line_end, count(*) AS hits FROM s GROUP BY doc_id, island)
SELECT i.doc_id, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, CAST(hits AS INTEGER) AS requests, sha256(array_to_string(lines[line_start:line_end], chr(10)) || CASE WHEN line_end < len(lines) THEN chr(10) ELSE '' END) AS fragment_sha256 FROM i JOIN l USING (doc_id)""")
def exact_fragments(spark, sf):
    """Evidence lines to merged fragments and their exact bytes."""
    files = _document_files(spark, sf)
    d = table(spark, sf, "documents").filter(F.contains(F.lower("text"), F.lit("license")) | F.contains("text", F.lit("@")))
    hits = d.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("p", "line")).filter(F.contains(F.lower("line"), F.lit("license")) | F.contains("line", F.lit("@")))
    ev = hits.select(P.text(F.col("doc_id"), ":", F.col("p")).alias("evidence_id"), F.col("source").alias("repo_id"), P.text(F.col("doc_id"), ".txt").alias("path"), _span(F.lit("exact_span"), F.col("p") + 1).alias("exemplar"))
    got = export.resolve(export.requested_ids(ev), ev, scan.cas_index(files), files, context=1)
    out = export.fragment_bytes(export.fragments(got), files)
    return out.select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), "line_start", "line_end", F.size("evidence_ids").alias("requests"), "fragment_sha256")


@query("""SELECT c_custkey, lower(trim(regexp_replace(regexp_replace(regexp_replace(c_name || ' fooBar-' || c_mktsegment || '..Z', '([a-z])([A-Z])', '\\1_\\2', 'g'), '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '_')) AS repository_id FROM customer""")
def normalize_ids(spark, sf):
    """Repository ids."""
    c = table(spark, sf, "customer")
    return c.select("c_custkey", S.normalize_repository_id(F.concat("c_name", F.lit(" fooBar-"), "c_mktsegment", F.lit("..Z"))).alias("repository_id"))


@query("""SELECT page_id, replace(url, '://', '://user:pw@') AS raw_url, lower(regexp_extract(url, '^(https?)://', 1)) || '://' || lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) || regexp_extract(url, '^https?://[^/?#]+(.*)$', 1) AS clean_url FROM pages""")
def sanitize_urls(spark, sf):
    """User info out of addresses."""
    raw = F.replace(F.col("url"), F.lit("://"), F.lit("://user:pw@"))
    return table(spark, sf, "pages").select("page_id", raw.alias("raw_url"), S.sanitize_url(raw).alias("clean_url"))


@query("""
WITH j AS (SELECT n_nationkey, prefix, route FROM nation, (VALUES (''), ('/'), ('/api'), ('/api/')) AS p(prefix), (VALUES (''), ('/'), ('x'), ('/x/'), ('//y')) AS r(route))
SELECT n_nationkey, prefix, route, CASE WHEN prefix = '' THEN CASE WHEN route = '' THEN '/' ELSE route END WHEN route = '' THEN prefix WHEN prefix = '/' THEN '/' || ltrim(route, '/') WHEN ltrim(route, '/') = '' THEN rtrim(prefix, '/') || '/' ELSE rtrim(prefix, '/') || '/' || ltrim(route, '/') END AS path FROM j
""")
def join_paths(spark, sf):
    """Service prefix and route."""
    n = table(spark, sf, "nation").select("n_nationkey", F.explode(F.array(*[F.lit(x) for x in ("", "/", "/api", "/api/")])).alias("prefix"))
    n = n.select("*", F.explode(F.array(*[F.lit(x) for x in ("", "/", "x", "/x/", "//y")])).alias("route"))
    return n.select("*", S.join_http_path(F.col("prefix"), F.col("route")).alias("path"))


@query("""
SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') > 0 AND count(*) FILTER (event_type <> 'error') = 0 THEN 'failed' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'partial' ELSE 'complete' END AS status, count(*) AS files FROM events GROUP BY 1
""")
def probe_status(spark, sf):
    """Probe status from counters."""
    e = table(spark, sf, "events")
    how = F.when(F.col("event_type") == "error", "failed").otherwise("complete")
    s = families.probe_status(_facts(e, F.col("user_id"), F.col("event_id"), "probe_status", "structured", how, F.lit("{}")))
    return s.select(F.col("repo_id").cast("long").alias("user_id"), "status", F.col("applicable").alias("files"))


@query("""
SELECT user_id, max_by(event_type, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 0 WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 ELSE 1 END * 1000 + CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END) AS coverage FROM events GROUP BY 1
""")
def worst_coverage(spark, sf):
    """Worst status by rank."""
    return table(spark, sf, "events").groupBy("user_id").agg(R.worst_status(F.col("event_type"), {"click": 0, "view": 0, "purchase": 1, "error": 2}).alias("coverage"))


@query("""
WITH k AS (SELECT user_id, json_extract_string(props, '$.k') AS key, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, string_agg(key || '=' || n, '|' ORDER BY key) AS counts FROM k GROUP BY 1
""")
def merged_kind_maps(spark, sf):
    """Maps of counts summed entry by entry."""
    e = table(spark, sf, "events").select("user_id", F.map_from_arrays(F.array(F.get_json_object("props", "$.k")), F.array(F.lit(1).cast("long"))).alias("m"))
    merged = R.sum_maps(e, ["user_id"], "m", "m")
    return merged.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), "|").alias("counts"))


_KEYS = ["occurrence_count", "Frontier_x", "family_occurrence_count", "name", "error_count", "FILE_COUNT"]
_NAMES = ["{urn:a}local", "plain", "{}odd"]
_VERBS = ["HttpMethod.POST", " GET ", "x.Fetch", "a.b.PATCH"]
_LOGS = ["Connection reset by peer", "timeout: repository not found", "all good", "HTTP 503 from proxy"]


def _pick(values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("o_orderkey") % len(values) + 1).cast("int"))


@query(f"""
WITH o AS (SELECT o_orderkey AS k, ({_KEYS})[o_orderkey % 6 + 1] AS key, ({_NAMES})[o_orderkey % 3 + 1] AS qname, ({_VERBS})[o_orderkey % 4 + 1] AS verb, ({_LOGS})[o_orderkey % 4 + 1] AS log FROM orders)
SELECT k, key IN ('Frontier_x', 'error_count') AS operational, key IN ('occurrence_count', 'family_occurrence_count', 'FILE_COUNT') AS frequency, CASE WHEN qname = '{{urn:a}}local' THEN 'urn:a' END AS namespace, CASE qname WHEN 'plain' THEN 'plain' WHEN '{{}}odd' THEN 'odd' ELSE 'local' END AS local_name,
       CASE verb WHEN 'HttpMethod.POST' THEN 'POST' WHEN ' GET ' THEN 'GET' WHEN 'a.b.PATCH' THEN 'PATCH' END AS method, log IN ('Connection reset by peer', 'HTTP 503 from proxy') AS transient FROM o
""")
def scalar_predicates(spark, sf):
    """Keys, qualified names, methods and failures."""
    o = table(spark, sf, "orders").select("o_orderkey", _pick(_KEYS).alias("key"), S.qname(_pick(_NAMES)).alias("q"), _pick(_VERBS).alias("verb"), _pick(_LOGS).alias("log"))
    return o.select(
        F.col("o_orderkey").alias("k"), S.is_operational_key(F.col("key")).alias("operational"), S.is_frequency_key(F.col("key")).alias("frequency"), "q.namespace", "q.local_name",
        S.http_method(F.col("verb")).alias("method"), S.is_transient_failure(F.col("log")).alias("transient"),
    )
