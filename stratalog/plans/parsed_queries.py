"""Registered queries over files: small texts of every kind are written from the driver's tables, scanned and parsed like a
source tree, and go through the operators that the job drivers call. SQL tells the same rows from the tables alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import boundaries, config, facts, families, scan
from ..tables import written
from .registry import query, table


def text(*parts) -> Column:
    """Columns and strings in a row."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def files_of(rows: DataFrame, repo: Column, path: Column, content: Column) -> DataFrame:
    """Rows as the file table of a scan."""
    body = content.cast("binary")
    return scan.files(rows.select(repo.cast("string").alias("repo_id"), path.alias("path"), F.lit(False).alias("is_symlink"), F.octet_length(body).cast("long").alias("byte_size"), body.alias("content"), F.lit(None).cast("string").alias("error")))


def parsed(files: DataFrame) -> DataFrame:
    return written(facts.extract_facts(files), "facts")


def family_rows(files: DataFrame, fact: DataFrame | None = None) -> DataFrame:
    """Families of files by the plan of a build."""
    fact = parsed(files) if fact is None else fact
    ev = families.evidence(families.observations(fact, files))
    return families.families(ev, families.probe_status(fact))


def told(descriptor: str) -> Column:
    return F.get_json_object("descriptor_json", f"$.{descriptor}")


@query("""
WITH k AS (
  SELECT c_mktsegment AS repo_id, unnest(['id', 'address', 'nation', 'lines', 'old']) AS key, unnest([0, 0, 1, 1, 0]) AS depth, unnest(['number', 'mapping', 'number', 'sequence', 'null']) AS kind, 1 AS n FROM customer
  UNION ALL SELECT c_mktsegment, 'k', 3, 'string', c_custkey % 4 FROM customer WHERE c_custkey % 4 > 0)
SELECT repo_id, 'json' AS syntax, key, CAST(sum(n) AS BIGINT) AS occurrence_count, count(*) AS file_count, min(depth) AS depth_min, max(depth) AS depth_max, any_value(kind) || '=' || CAST(sum(n) AS BIGINT) AS kinds FROM k GROUP BY repo_id, key
""")
def json_key_families(spark, sf):
    """Keys of JSON files with kinds and depths."""
    c = table(spark, sf, "customer")
    lines = F.array_join(F.array_repeat(F.lit('{"k": "v"}'), (F.col("c_custkey") % 4).cast("int")), ", ")
    body = text('{"id": ', F.col("c_custkey"), ', "address": {"nation": ', F.col("c_nationkey"), ', "lines": [', lines, ']}, "old": null}')
    k = families.key_families(parsed(files_of(c, F.col("c_mktsegment"), text("c/", F.col("c_custkey"), ".json"), body)))
    kinds = F.array_join(F.transform(F.map_entries("value_kind_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return k.select("repo_id", "syntax", "key", "occurrence_count", "file_count", "depth_min", "depth_max", kinds.alias("kinds"))


@query("""
WITH s AS (SELECT 'n' || s_nationkey AS repo_id, s_suppkey AS s FROM supplier)
SELECT DISTINCT repo_id, unnest(['app.name', 'app.port', 'app.live', 'app.sub.key.default', 'sub.key', 'list.a']) AS key, unnest(['S' || s, s::VARCHAR, 'true', '/p' || s, '/p' || s, 'x']) AS value FROM s
""")
def yaml_scalars(spark, sf):
    """Configuration scalars of YAML files."""
    s = table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    body = text("app:\n  name: S", key, "\n  port: ", key, "\n  live: true\n  sub.key:\n    default: /p", key, "\n  none: null\nlist:\n  - a: x\n  - [1, y]\n")
    return boundaries.config_scalars(parsed(files_of(s, text("n", F.col("s_nationkey")), text("conf/", key, ".yml"), body)))


_ITEM = '[{"name":"id","declared_type":"integer","collection":"scalar","required":true},{"name":"tags","declared_type":"array<string>","collection":"array","required":false}]'


@query(f"""
SELECT 'n' || s_nationkey AS repo_id, 'GET' AS method, '/s/' || s_suppkey AS path, 'resolved' AS path_status, 'Item' AS payload, '{_ITEM}' AS payload_fields FROM supplier
UNION ALL SELECT 'n' || s_nationkey, 'POST', '/s/' || s_suppkey, 'resolved', 'Gone', '[]' FROM supplier
UNION ALL SELECT 'n' || s_nationkey, 'DELETE', '/s/' || s_suppkey, 'resolved', NULL, NULL FROM supplier
""")
def inbound_openapi(spark, sf):
    """Inbound operations of OpenAPI files with payloads."""
    s = table(spark, sf, "supplier")
    get = '{"responses": {"404": {}, "200": {"content": {"text/csv": {"schema": {"title": "No"}}, "application/json": {"schema": {"$ref": "#/components/schemas/Item"}}}}}}'
    item = '{"required": ["id"], "properties": {"tags": {"type": "array", "items": {"type": "string"}}, "id": {"type": "integer"}}}'
    post = '{"requestBody": {"content": {"application/xml": {"schema": {"$ref": "#/components/schemas/Gone"}}}}}'
    body = text('{"openapi": "3.0.1", "paths": {"/s/', F.col("s_suppkey"), '": {"get": ', get, ', "post": ', post, ', "delete": {}, "summary": "x"}}, "components": {"schemas": {"Item": ', item, "}}}")
    f = parsed(files_of(s, text("n", F.col("s_nationkey")), text("api/", F.col("s_suppkey"), ".json"), body))
    return boundaries.inbound_http(f).select("repo_id", "method", "path", "path_status", "payload", "payload_fields")


# file name, text, what it is told to be: a format, or a diagnostic's code
_FORMATS = [
    ("a.json", '{"$schema": "https://json-schema.org/draft/2020-12/schema"}', "json_schema"), ("b.avsc", '{"type": ["object", "null"], "properties": {}}', "json_schema"),
    ("c.json", '{"type": "object"}', "json_schema_markers_ambiguous"), ("d.proto", 'syntax = "proto3"; // x\nmessage A { int32 a = 1; }', "protobuf"),
    ("e.proto", "message A { }", "proto_format_not_confirmed"), ("f.xsd", '<s:schema xmlns:s="http://www.w3.org/2001/XMLSchema"/>', "xsd"),
    ("g.xsd", "<schema/>", "xsd_format_not_confirmed"), ("h.yaml", "swagger: 2\npaths: {}\n", "openapi"),
    ("i.json", "{", "structured_json_parse_failed"), ("j.yml", "a: 1\n---\nb: 2\n", "structured_yaml_scan_partial"),
    ("k.xml", "<a><b></a>", "structured_xml_parse_failed"), ("l.gradle", "dependencies { }", "gradle_dependency_detail_not_evaluated"),
    ("m.java", 'class M { String s = "open; }', "java_parse_failed"), ("n.toml", "[a", "config_parser_failed"),
]


@query(f"SELECT 'n' || s_nationkey AS repo_id, (['{"', '".join(w for _, _, w in _FORMATS)}'])[s_suppkey % {len(_FORMATS)} + 1] AS outcome, count(*) AS files FROM supplier GROUP BY ALL")
def formats_and_gaps(spark, sf):
    """Source formats that are confirmed, and gaps."""
    s = table(spark, sf, "supplier").withColumn("f", F.element_at(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(t).alias("t")) for n, t, _ in _FORMATS]), (F.col("s_suppkey") % len(_FORMATS) + 1).cast("int")))
    files = files_of(s, text("n", F.col("s_nationkey")), text(F.col("s_suppkey"), "/", F.col("f.n")), F.col("f.t"))
    f = parsed(files)
    seen = family_rows(files, f).filter("family_kind = 'source_format_observation'").select("repo_id", F.col("family_label").alias("outcome"), F.col("file_count").alias("n"))
    gaps = families.diagnostics(f, scan.scan_diagnostics(files)).select("repo_id", F.col("code").alias("outcome"), F.lit(1).cast("long").alias("n"))
    return seen.unionByName(gaps).groupBy("repo_id", "outcome").agg(F.sum("n").alias("files"))


@query("""
WITH RECURSIVE f AS (SELECT s_suppkey % 3 AS r, s_suppkey AS k FROM supplier),
e AS (SELECT r, k, CASE WHEN k % 12 >= 3 THEN k - 3 WHEN k % 12 = 1 THEN k + 9 END AS t, 'p' || k % 2 AS p FROM f),
d AS (SELECT e.*, EXISTS (FROM f WHERE f.k = e.t) AS have FROM e),
c AS (SELECT r, k, t AS i, p AS prefix, 1 AS depth, [k, t] AS way, 'resolved' AS status FROM d WHERE have
  UNION ALL SELECT c.r, c.k, d.t, c.prefix || '.' || d.p, c.depth + 1, list_append(c.way, d.t), CASE WHEN list_contains(c.way, d.t) THEN 'cycle' ELSE 'resolved' END FROM c JOIN d ON d.k = c.i AND d.have WHERE c.status = 'resolved'),
u AS (SELECT r, k, 'own' AS key, k AS i, 0 AS depth FROM f UNION ALL SELECT r, k, prefix || '.own', i, depth FROM c WHERE status = 'resolved'
  UNION ALL SELECT r, k, 'missing' AS key, NULL, 1 FROM d WHERE NOT have UNION ALL SELECT r, k, 'cycle ' || prefix, i, depth FROM c WHERE status = 'cycle')
SELECT 'r' || r AS repo_id, 'conf/' || k || '.conf' AS path, key, 'conf/' || i || '.conf' AS declared_in, depth FROM u
""")
def config_includes(spark, sf):
    """Keys of HOCON files with those of the files that they include, over chains and cycles; missing targets."""
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    target = F.when(k % 12 >= 3, k - 3).when(k % 12 == 1, k + 9).otherwise(F.lit(-1)).cast("string")
    body = text("own = 1\np", k % 2, ' { include file("', F.when(k % 4 == 0, "./").otherwise("../conf/"), target, F.when(k % 5 == 0, "").otherwise(".conf"), '") }\n')
    files = files_of(s, text("r", k % 3), text("conf/", k, ".conf"), body)
    fact = parsed(files)
    direct = written(config.includes(fact, files), "includes")
    closure = written(config.include_closure(direct), "closure")
    keys = config.effective_keys(fact, closure)
    lost = direct.filter("status = 'missing'").select("repo_id", "path", F.lit("missing").alias("key"), F.col("included").alias("declared_in"), F.lit(1).alias("depth"))
    back = closure.filter("status = 'cycle'").select("repo_id", "path", F.concat(F.lit("cycle "), "prefix").alias("key"), F.col("included").alias("declared_in"), "depth")
    return keys.unionByName(lost).unionByName(back)


@query("""
WITH o AS (SELECT lower(o_orderpriority[1:1]) AS repo_id, o_orderkey % 5 AS n FROM orders)
SELECT repo_id, kind AS observation_kind, label AS family_label, CAST(sum(c) AS BIGINT) AS occurrence_count, count(*) AS file_count FROM (
  SELECT repo_id, unnest(['document_root', 'namespace', 'element', 'element', 'attribute']) AS kind, unnest(['order', 'xml_observation', 'order', 'line', 'id']) AS label, unnest([1, 1, 1, n, 1]) AS c FROM o) WHERE c > 0 GROUP BY ALL
""")
def xml_families(spark, sf):
    """Elements, attributes and namespaces of XML files as families."""
    o = table(spark, sf, "orders")
    lines = F.repeat(F.lit("<line/>"), (F.col("o_orderkey") % 5).cast("int"))
    files = files_of(o, F.lower(F.substring("o_orderpriority", 1, 1)), text("o/", F.col("o_orderkey"), ".xml"), text('<order xmlns="urn:o" id="1">', lines, "</order>"))
    return family_rows(files).filter("family_kind = 'xml_observation'").select("repo_id", told("observation_kind").alias("observation_kind"), "family_label", "occurrence_count", "file_count")


@query("""
WITH s AS (SELECT 'n' || s_nationkey AS repo_id, s_suppkey AS s FROM supplier),
d AS (SELECT repo_id, unnest(['bom', 'core', 'kit']) AS artifact, unnest(['dependency_management', 'dependency', 'plugin_dependency']) AS context, unnest(['1.' || s % 3, NULL, '9']) AS version FROM s)
SELECT repo_id, artifact, context, version, count(*) AS file_count FROM d GROUP BY ALL
UNION ALL SELECT repo_id, 'maven_dependency_missing_coordinate_part', NULL, NULL, count(*) FROM s GROUP BY 1
""")
def maven_dependencies(spark, sf):
    """Maven dependencies with where they are declared, and incomplete ones as gaps."""
    s = table(spark, sf, "supplier")
    one = lambda a, v="": f"<dependency><groupId>g</groupId><artifactId>{a}</artifactId>{v}</dependency>"
    managed = text("<dependency><groupId>g</groupId><artifactId>bom</artifactId><version>1.", F.col("s_suppkey") % 3, "</version></dependency>")
    body = text('<project xmlns="http://maven.apache.org/POM/4.0.0"><dependencyManagement><dependencies>', managed, "</dependencies></dependencyManagement><dependencies>", one("core"), "<dependency><groupId>g</groupId></dependency></dependencies><build><plugins><plugin><dependencies>", one("kit", "<version>9</version>"), "</dependencies></plugin></plugins></build></project>")
    files = files_of(s, text("n", F.col("s_nationkey")), text(F.col("s_suppkey"), "/pom.xml"), body)
    f = parsed(files)
    deps = family_rows(files, f).filter("family_kind = 'dependency_observation'").select("repo_id", F.col("family_label").alias("artifact"), told("declaration_context").alias("context"), told("version_expression").alias("version"), "file_count")
    gaps = families.diagnostics(f, scan.scan_diagnostics(files)).groupBy("repo_id", F.col("code").alias("artifact")).agg(F.count(F.lit(1)).alias("file_count"))
    return deps.unionByName(gaps, allowMissingColumns=True)


@query("""
WITH s AS (SELECT 'n' || s_nationkey AS repo_id, s_suppkey AS s FROM supplier),
k AS (SELECT repo_id, unnest(['toml', 'toml', 'properties', 'properties', 'conf', 'conf', 'conf']) AS format, unnest(['db.name', 'db.ports', 'db.user', 'db.pass', 'a.b', 'a.list', 'a.from']) AS full_key, unnest([true, true, true, false, true, true, true]) AS value_present, unnest([s, 0, s, 0, s % 2, 0, 0]) AS v FROM s)
SELECT repo_id, format, full_key, value_present, count(*) AS occurrence_count, count(DISTINCT v) AS distinct_values, 0 AS values_shown FROM k GROUP BY ALL
""")
def config_keys(spark, sf):
    """Keys of TOML, Properties and HOCON files; values are never shown, only told apart."""
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    kinds = F.array(
        F.struct(F.lit("c.toml").alias("n"), text('[db]\nname = "hidden', k, '"\nports = [1, 2]\n').alias("t")), F.struct(F.lit("c.properties").alias("n"), text("# no\ndb.user : hid\\\n   den", k, "\ndb.pass=\n").alias("t")),
        F.struct(F.lit("c.conf").alias("n"), text("a { b = hidden", k % 2, ", list = [{ q = 1 }], from = ${x.y} }\n").alias("t")),
    )
    rows = s.select(text("n", F.col("s_nationkey")).alias("r"), k, F.explode(kinds).alias("f"))
    got = family_rows(files_of(rows, F.col("r"), text(k, "/", F.col("f.n")), F.col("f.t"))).filter("family_kind = 'config_key_observation'")
    g = got.groupBy("repo_id", told("format").alias("format"), told("full_key").alias("full_key"), (told("value_present") == "true").alias("value_present"))
    return g.agg(F.sum("occurrence_count").alias("occurrence_count"), F.count(F.lit(1)).alias("distinct_values"), F.count_if(F.contains("descriptor_json", F.lit("hid"))).cast("int").alias("values_shown"))


@query("""
WITH RECURSIVE f AS (SELECT s_suppkey % 3 AS r, s_suppkey AS k FROM supplier),
e AS (SELECT r, k, CASE WHEN k % 12 >= 3 THEN k - 3 WHEN k % 12 = 1 THEN k + 9 END AS t, 'p' || k % 2 AS p FROM f),
d AS (SELECT e.*, EXISTS (FROM f WHERE f.k = e.t) AS have FROM e),
c AS (SELECT r, k, t AS i, p AS prefix, 1 AS depth, [k, t] AS way, 'resolved' AS status FROM d WHERE have
  UNION ALL SELECT c.r, c.k, d.t, c.prefix || '.' || d.p, c.depth + 1, list_append(c.way, d.t), CASE WHEN list_contains(c.way, d.t) THEN 'cycle' ELSE 'resolved' END FROM c JOIN d ON d.k = c.i AND d.have WHERE c.status = 'resolved'),
u AS (SELECT r, k, 'own' AS key, k AS i, 0 AS depth FROM f UNION ALL SELECT r, k, prefix || '.own', i, depth FROM c WHERE status = 'resolved'
  UNION ALL SELECT r, k, 'missing' AS key, NULL, 1 FROM d WHERE NOT have UNION ALL SELECT r, k, 'cycle ' || prefix, i, depth FROM c WHERE status = 'cycle')
SELECT 'r' || r AS repo_id, 'conf/' || k || '.conf' AS path, key, 'conf/' || i || '.conf' AS declared_in, depth FROM u
""")
def config_includes(spark, sf):
    """Keys of HOCON files with those of the files that they include, over chains and cycles; missing targets."""
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    target = F.when(k % 12 >= 3, k - 3).when(k % 12 == 1, k + 9).otherwise(F.lit(-1)).cast("string")
    body = text("own = 1\np", k % 2, ' { include file("', F.when(k % 4 == 0, "./").otherwise("../conf/"), target, F.when(k % 5 == 0, "").otherwise(".conf"), '") }\n')
    files = files_of(s, text("r", k % 3), text("conf/", k, ".conf"), body)
    fact = parsed(files)
    direct = written(config.includes(fact, files), "includes")
    closure = written(config.include_closure(direct), "closure")
    keys = config.effective_keys(fact, closure)
    lost = direct.filter("status = 'missing'").select("repo_id", "path", F.lit("missing").alias("key"), F.col("included").alias("declared_in"), F.lit(1).alias("depth"))
    back = closure.filter("status = 'cycle'").select("repo_id", "path", F.concat(F.lit("cycle "), "prefix").alias("key"), F.col("included").alias("declared_in"), "depth")
    return keys.unionByName(lost).unionByName(back)


@query("""
WITH o AS (SELECT lower(o_orderpriority[1:1]) AS repo_id, o_orderkey % 3 AS n, o_orderkey % 7 = 0 AS odd, o_orderkey % 11 = 0 AS cut, o_orderkey % 5 = 0 AS nest, o_orderkey % 13 = 0 AS lost FROM orders),
k AS (SELECT repo_id, unnest(['select', 'insert', 'union', 'subquery', 'merge', 'command']) AS statement_type, unnest([n + 1 + lost::INT * 2, 1, nest::INT, nest::INT, nest::INT, odd::INT + cut::INT]) AS c, CASE WHEN odd OR cut OR lost THEN 1 ELSE 0 END AS bad FROM o)
SELECT repo_id, statement_type, CAST(sum(c) AS BIGINT) AS occurrence_count, count(*) AS file_count, CASE WHEN (SELECT max(bad) FROM k x WHERE x.repo_id = k.repo_id) = 1 THEN 'partial' ELSE 'complete' END AS coverage_status FROM k WHERE c > 0 GROUP BY ALL
""")
def sql_footprints(spark, sf):
    """Statements of SQL scripts, with the coverage of their repository's scripts."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    body = text(F.repeat(F.lit("SELECT ';' -- ;\n;"), (k % 3).cast("int")), "with a as (select 1) select * from a;\n/* ; */ INSERT INTO t SELECT (1);\n", F.when(k % 7 == 0, "frob all;").otherwise(""),
        F.when(k % 5 == 0, "(select 1) union all select (select 2 from t where x in (select 3));(select * except (y) from z);with a as (select 1) merge into b using a on 1=1;").otherwise(""),
        F.when(k % 13 == 0, "select f(1; select ${x}.y from z;").otherwise(""), F.when(k % 11 == 0, "-- x\n/* open").otherwise(""))
    got = family_rows(files_of(o, F.lower(F.substring("o_orderpriority", 1, 1)), text("o/", k, ".sql"), body))
    return got.filter("family_kind = 'sql_statement_family'").select("repo_id", F.col("family_label").alias("statement_type"), "occurrence_count", "file_count", "coverage_status")


_JAVA = [("import_namespace_observation", "java.util.List", 1), ("import_namespace_observation", "a.B.*", 1), ("annotation_observation", "Entity", 1), ("annotation_observation", "Size", 1), ("api_call_observation", "find", 2), ("api_call_observation", "Box", 1), ("api_call_observation", "b", 1), ("api_call_observation", "go", 1)]


@query(f"""
WITH k AS (SELECT c_mktsegment AS repo_id, unnest(['{"', '".join(k for k, _, _ in _JAVA)}']) AS family_kind, unnest(['{"', '".join(x for _, x, _ in _JAVA)}']) AS family_label, unnest([{", ".join(str(n) for _, _, n in _JAVA)}]) AS n FROM customer
  UNION ALL SELECT c_mktsegment, 'import_namespace_observation', 'p' || c_nationkey, 1 FROM customer)
SELECT repo_id, family_kind, family_label, CAST(sum(n) AS BIGINT) AS occurrence_count FROM k GROUP BY ALL
""")
def java_observations(spark, sf):
    """Namespaces, annotations and calls of Java files; nothing from comments and strings."""
    c = table(spark, sf, "customer")
    body = text("package p", F.col("c_nationkey"), ";\nimport java.util.List;\nimport static a.B.*;\n/* import no.X; @Gone */\n@Entity class C", F.col("c_custkey"), ' { @x.Size(max = 3) String s = "Ghost.call()"; void m() { Db.find(1); Db.find(2, x); own(); a.b().go(); new Box<Long>(s); } }')
    got = family_rows(files_of(c, F.col("c_mktsegment"), text("src/main/java/C", F.col("c_custkey"), ".java"), body)).filter(F.col("family_kind").isin("import_namespace_observation", "annotation_observation", "api_call_observation"))
    return got.groupBy("repo_id", "family_kind", "family_label").agg(F.sum("occurrence_count").alias("occurrence_count"))


def _tree(rows: DataFrame, repo: Column, named: dict[str, Column]) -> DataFrame:
    """Several files a row; a null text is no file."""
    each = F.array(*[F.struct(F.lit(n).alias("n"), t.alias("t")) for n, t in named.items()])
    flat = rows.select(repo.alias("r"), F.explode(each).alias("f")).filter("f.t is not null")
    return parsed(files_of(flat, F.col("r"), F.col("f.n"), F.col("f.t")))


@query("""
WITH s AS (SELECT 's' || s_suppkey AS repo_id, s_suppkey AS s, s_suppkey % 3 AS k FROM supplier)
SELECT repo_id, 'POST' AS method, CASE WHEN k = 0 THEN '/p' || s END AS path, CASE k WHEN 0 THEN 'resolved' WHEN 1 THEN 'ambiguous_declared_config' ELSE 'unresolved_property' END AS path_status, CASE k WHEN 0 THEN '/p' || s WHEN 1 THEN '/p' || s || ',/q' ELSE '' END AS candidates, 'svc.path' AS property_keys, 'Ev' AS payload, 'available_local_declaration' AS payload_fields_status, CASE WHEN k = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM s
UNION ALL SELECT repo_id, 'GET', '/lit/' || s, 'resolved', '/lit/' || s, '', 'String', 'unavailable_external_declaration', 1.0 FROM s
UNION ALL SELECT repo_id, 'PUT', NULL, 'unresolved_expression', '', '', NULL, 'unresolved_payload', 1.0 FROM s
UNION ALL SELECT repo_id, 'DELETE', '/w/' || s, 'resolved', '/w/' || s, '', 'Ev', 'available_local_declaration', 1.0 FROM s
UNION ALL SELECT repo_id, 'PATCH', '/jdk', 'resolved', '/jdk', '', 'Ev', 'available_local_declaration', 1.0 FROM s
""")
def java_outbound(spark, sf):
    """Outbound calls: literals, bound properties, wrappers, JDK requests."""
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    java = text(
        'class C { @Value("${svc.path}") String p; RestTemplate restTemplate; void a() { restTemplate.exchange(p, HttpMethod.POST, null, Ev.class); restTemplate.exchange("/lit/', k, '", HttpMethod.GET, null, String.class); restTemplate.exchange(make(), HttpMethod.PUT, null); }',
        ' static void relay(Object b, RestTemplate restTemplate, String where) { restTemplate.exchange(where, HttpMethod.DELETE, b, Ev.class); } void w() { relay(null, restTemplate, "/w/', k, '"); }',
        ' void j() { var q = HttpRequest.newBuilder(URI.create(base + "/jdk")).method("PATCH", x); m.readValue(client.send(q.build(), h), Ev.class); var never = HttpRequest.newBuilder(URI.create("/never")); never.build(); } } class Ev { String id; }',
    )
    one = text("my:\n  svc:\n    path: ", F.when(k % 3 == 2, "relative").otherwise(text("/p", k)), "\n")
    f = _tree(s, text("s", k), {"src/main/java/C.java": java, "src/test/java/T.java": F.lit('class T { void a() { restTemplate.exchange("/test", GET, null, A.class); } }'), "conf/a.yml": one, "conf/b.yml": F.when(k % 3 == 1, "svc.path: /q\n")})
    out = boundaries.outbound_http(f)
    joined = lambda c: F.array_join(c, ",").alias
    return out.select("repo_id", "method", "path", "path_status", joined("path_candidates")("candidates"), joined("property_keys")("property_keys"), "payload", "payload_fields_status", "confidence")


@query("""
WITH s AS (SELECT 's' || s_suppkey AS repo_id, s_suppkey AS s, s_suppkey % 2 AS two FROM supplier)
SELECT repo_id, 'POST' AS method, CASE WHEN two = 0 THEN '/svc' || s || '/v1/items' END AS path, CASE WHEN two = 0 THEN 'resolved' ELSE 'ambiguous_service_prefix' END AS path_status, '/svc' || s || '/v1/items' || CASE WHEN two = 1 THEN ',/zzz/v1/items' ELSE '' END AS candidates FROM s
UNION ALL SELECT repo_id, 'GET', NULL, 'unresolved_expression', '' FROM s
UNION ALL SELECT repo_id, 'PUT', '/alone', 'resolved', '/alone' FROM s
""")
def java_inbound(spark, sf):
    """Routes below registered prefixes; constants of any depth, cycles stay open."""
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    chain = "".join(f" static final String C{i} = C{i + 1};" for i in range(12))
    java = text(
        'interface Desk { } class Front implements Desk { static final String TOP = "/v1"; @Post(TOP + "/items") Object add() { return null; } @Get("/x" + Roots.SPIN) Object no() { return null; } }',
        ' class Alone { @PutMapping("/alone") void put() { } } class Wire { void go(Desk desk) { server.annotatedService(Roots.C0, desk);', F.when(k % 2 == 1, ' server.annotatedService("/zzz", desk);').otherwise(""), ' } }',
        " class Roots {" + chain + ' static final String C12 = "/svc" + Roots.ID; static final String ID = "', k, '"; static final String SPIN = SPIN2; static final String SPIN2 = SPIN; }',
    )
    out = boundaries.inbound_http(_tree(s, text("s", k), {"src/main/java/A.java": java}))
    return out.select("repo_id", "method", "path", "path_status", F.array_join("path_candidates", ",").alias("candidates"))


@query("""
WITH s AS (SELECT 'n' || s_nationkey AS repo_id, s_suppkey AS s FROM supplier)
SELECT repo_id, 'POST' AS method, '/s/' || s AS path, 'Item' AS request, 'Made' AS response, 2 AS file_count, 'java,openapi' AS basis FROM s
UNION ALL SELECT repo_id, 'GET', '/s/' || s, NULL, 'Item', 3, 'java,openapi' FROM s WHERE s % 2 = 1
UNION ALL SELECT repo_id, 'GET', '/s/' || s, NULL, unnest(['Item', 'Made', NULL]), 1, unnest(['openapi', 'openapi', 'java']) FROM s WHERE s % 2 = 0
UNION ALL SELECT repo_id, 'DELETE', NULL, NULL, NULL, count(*), 'java' FROM s GROUP BY 1
""")
def inbound_mixed(spark, sf):
    """OpenAPI operations and Java routes of one path: one family with all files, request and response apart; conflicts stay."""
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    side = lambda n: '{"content": {"application/json": {"schema": {"title": "%s"}}}}' % n
    get = lambda n: ', "get": {"responses": {"200": ' + side(n) + "}}"
    one = text('{"openapi": "3.0.1", "paths": {"/s/', k, '": {"post": {"requestBody": ' + side("Item") + ', "responses": {"201": ' + side("Made") + "}}" + get("Item") + "}}}")
    two = text('{"openapi": "3.0.1", "paths": {"/s/', k, '": {"summary": "x"', F.when(k % 2 == 0, get("Made")).otherwise(get("Item")), "}}}")
    java = text("class C", k, ' { @Post("/s/', k, '") void add() { } @Get("/s/', k, '") Object get() { return null; } @Delete(Gone.X) void no() { } }')
    each = F.array(*[F.struct(text(n, k, e).alias("n"), t.alias("t")) for n, e, t in (("api/a", ".json", one), ("api/b", ".json", two), ("src/main/java/C", ".java", java))])
    rows = s.select(text("n", F.col("s_nationkey")).alias("r"), F.explode(each).alias("f"))
    files = files_of(rows, F.col("r"), F.col("f.n"), F.col("f.t"))
    fact = parsed(files)
    obs = families.observations(fact, files, [boundaries.as_observations(written(boundaries.inbound_http(fact), "inbound"), "http")]).filter("section = 'boundaries'")
    fam = families.families(families.evidence(obs), families.probe_status(fact), families.provenance(obs))
    return fam.select("repo_id", told("method").alias("method"), told("path").alias("path"), told("request_payload").alias("request"), told("response_payload").alias("response"), "file_count", F.array_join("basis_variants", ",").alias("basis"))


# what breaks the chain of a listener: (enum, arguments of super, accessor) and the status
_CHAINS = [
    ("@RequiredArgsConstructor enum E { A(K.Z); private final K k; String at(C c) { return c.v(k); } }", "super(E.A);", "at", "resolved"),
    ("@RequiredArgsConstructor enum E { A(K.Z), B(K.Z); private final K k; String at(C c) { return c.v(k); } }", "super(E.A, E.B);", "at", "unresolved_constructor_binding"),
    ("class E { }", "super(E.A);", "at", "unresolved_enum_binding"),
    ("enum E { A(K.Z); private final K k; String at(C c) { return c.v(k); } }", "super(E.A);", "at", "unresolved_enum_constructor_semantics"),
    ("@RequiredArgsConstructor enum E { A(K.Z); private final K k; String at(C c) { return c.v(k); } }", "super(E.A);", "to", "unresolved_listener_topic_accessor"),
    ("@RequiredArgsConstructor enum E { A(K.Z); private K k; String at(C c) { return c.v(k); } }", "super(E.A);", "at", "unresolved_enum_field_position"),
    ("@RequiredArgsConstructor enum E { A(); private final K k; String at(C c) { return c.v(k); } }", "super(E.A);", "at", "unresolved_enum_argument_position"),
    ("@RequiredArgsConstructor enum E { A(Gone.Z); private final K k; String at(C c) { return c.v(k); } }", "super(E.A);", "at", "unresolved_config_key_reference"),
]


@query(f"""
WITH s AS (SELECT 's' || s_suppkey AS repo_id, s_suppkey AS s, (['{"', '".join(c[3] for c in _CHAINS)}'])[s_suppkey % {len(_CHAINS)} + 1] AS status FROM supplier)
SELECT repo_id, 'consume' AS direction, CASE WHEN status = 'resolved' THEN 'key.' || s END AS topic, CASE WHEN status = 'resolved' THEN 'config_key' END AS topic_kind, status AS topic_status, 'Ev' AS payload, 'available_local_declaration' AS payload_fields_status FROM s
UNION ALL SELECT repo_id, 'consume', 'plain', 'literal', 'resolved', NULL, 'unresolved_payload' FROM s
UNION ALL SELECT repo_id, 'publish', 'out.' || s, 'literal', 'resolved', 'Ev', 'available_local_declaration' FROM s
UNION ALL SELECT repo_id, 'publish', 'bound.key', 'config_key', 'resolved', 'Other', 'unavailable_external_declaration' FROM s
UNION ALL SELECT repo_id, 'publish', NULL, NULL, 'unresolved_expression', NULL, 'unresolved_payload' FROM s
""")
def kafka_boundaries(spark, sf):
    """Listeners and publishes of Java files with the status of every chain."""
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    way = F.element_at(F.array(*[F.struct(F.lit(a).alias("enum"), F.lit(b).alias("call"), F.lit(c).alias("accessor")) for a, b, c, _ in _CHAINS]), (k % len(_CHAINS) + 1).cast("int"))
    java = text(
        'enum K { Z("key.', k, '"); final String s; } ', way["enum"], " class P { } class L extends P { L() { ", way["call"], ' } @KafkaListener(topics = "#{__listener.e.', way["accessor"], '(c)}") void on(Object o) { deserialize(o, Ev.class); } @KafkaListener(topics = "plain") void p(Object o) { } }',
        ' class S { static final String T = "out.', k, '"; @Value("${bound.key}") String b; KafkaTemplate<String, Ev> out; void a(Ev ev, Other x) { out.send(T, ev); kafkaTemplate.executeInTransaction(t -> t.send(b, x)); kafkaTemplate.send(find()); } } class Ev { String id; }',
    )
    out = boundaries.kafka(_tree(s, text("s", k), {"src/main/java/A.java": java}))
    return out.select("repo_id", "direction", "topic", "topic_kind", "topic_status", "payload", "payload_fields_status")
