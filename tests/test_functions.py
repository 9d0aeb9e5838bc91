"""Scalar functions, parsers and relational operators against plain Python."""

import math
from pathlib import PurePosixPath

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalog.functions import scalars as S
from stratalog.functions import shapes as H
from stratalog.operators import relational as R
from stratalog.parsers import ParseGap, buildconf, javasrc, sqlscript, structured


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_paths(spark):
    paths = ["a/b/c.JSON", ".gitignore", "x/.env", "noext", "a.tar.gz", "src/main/A.java", "mod/src/x", "mod/sub/src/src/y", "top/file", "..a.b", "dot.", "a/..hidden.txt"]
    got = values(spark, [(p,) for p in paths], "p string", "p", S.extension_of(F.col("p")), S.source_tree_scope(F.col("p")))
    for p, ext, scope in got:
        parts = p.split("/")
        want = "/".join(parts[: parts.index("src")]) or "." if "src" in parts else parts[0] if len(parts) > 1 else "."
        assert scope == want, p
        if not p.endswith("."):
            assert ext == (PurePosixPath(p).suffix.lower() or "<none>"), p


def test_salience(spark):
    rows = [(n, c) for n in range(0, 60) for c in ("complete", "partial", "failed")]
    for n, c, s in values(spark, rows, "n long, c string", "n", "c", S.salience(F.col("n"), F.col("c"))):
        want = min(100.0, min(35.0, 8 * math.log2(max(1, n) + 1)) + {"complete": 20, "partial": 10}.get(c, 5) + 10)
        assert abs(s - round(want, 3)) < 1e-9


def test_urls_ids_and_paths(spark):
    urls = ["https://u:p@Host.com:8443/x?q=1#f", "ssh://git@h/y", "git@h:x.git", "http://h", " https://h/a@b "]
    got = [r[0] for r in values(spark, [(u,) for u in urls], "u string", S.sanitize_url(F.col("u")))]
    assert got == ["https://host.com:8443/x?q=1#f", "ssh://h/y", "git@h:x.git", "http://h", "https://h/a@b"]
    ids = [r[0] for r in values(spark, [("FooBar-baz qux",), ("__a--B__",), ("é",), (None,)], "u string", S.normalize_repository_id(F.col("u")))]
    assert ids == ["foo_bar_baz_qux", "a_b", "", ""]
    pairs = [("", "", "/"), ("", "x", "x"), ("/p", "", "/p"), ("/", "//x", "/x"), ("/p/", "/x", "/p/x"), ("/p/", "//", "/p/"), ("/p", "x/", "/p/x/")]
    assert all(a == b for a, b in values(spark, pairs, "p string, r string, w string", S.join_http_path(F.col("p"), F.col("r")), "w"))


def test_expressions(spark):
    rows = [('"abc"', "abc", None), ('"a\\n"', None, None), (" this.x ", None, "x"), ("a.b", None, None), ("1a", None, None), ('""', "", None)]
    for lit, sym, a, b in values(spark, rows, "e string, l string, s string", S.literal_string(F.col("e")), S.symbol(F.col("e")), "l", "s"):
        assert (lit, sym) == (a, b)
    assert values(spark, [("ResponseEntity<java.util.List<A>>",), ("",)], "t string", S.payload_type(F.col("t"))) == [("List<A>",), (None,)]
    assert values(spark, [("a.b.c",)], "t string", S.dotted_suffixes(F.col("t"))) == [(["a.b.c", "b.c", "c"],)]


@settings(max_examples=25, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-5, 5000) | st.text(max_size=3), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["name", "type", "a_kind", "total", "x", "error_count", "file_count"]), c, max_size=4), max_leaves=12))
def test_shape_properties(v):
    exact, similar = H.shape(v, False), H.shape(v, True)
    assert H.canonical(H.shape(v, False)) == H.canonical(exact)
    renamed = H.shape({"x": v}, False)
    assert H.canonical(renamed) == H.canonical({"x": H.shape(v, False, "x")})
    assert all(isinstance(p, str) and x > 0 for p, x in H.positive_metrics(v))
    assert set(H.flatten(v)) >= {p for p, _ in H.facets(v)} and similar is not Ellipsis


def test_exact_is_finer_than_similar():
    a, b = {"n": 5, "s": "x"}, {"n": 9, "s": "y"}
    assert H.shape(a, False) != H.shape(b, False) and H.shape(a, True) == H.shape(b, True)
    assert H.facets({"name": "v", "type": "t", "failed_x": "q"}) == [("$.name", "v")]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(1, 30), st.integers(0, 6)), max_size=12))
def test_merge_intervals(spark_for_given, rows):
    rows = [(k, a, a + n) for k, a, n in rows]
    got = {(r.k, r.a, r.b, r.intervals) for r in R.merge_intervals(spark_for_given.createDataFrame(rows, "k int, a int, b int"), ["k"], "a", "b").collect()}
    want = set()
    for k in {r[0] for r in rows}:
        island = None
        for _, a, b in sorted(r for r in rows if r[0] == k):
            if island and a <= island[1] + 1:
                island = [island[0], max(island[1], b), island[2] + 1]
            else:
                if island:
                    want.add((k, *island))
                island = [a, b, 1]
        want.add((k, *island))
    assert got == want


@pytest.fixture(scope="module")
def spark_for_given(spark):
    return spark


def test_joins_and_aggregates(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (2, "b")], "k int, v string")
    assert [tuple(r) for r in R.unique_match(left, right, ["k"]).collect()] == [(1, "a")]
    assert {r.k: (r.status, r.candidates) for r in R.resolution(left, right, ["k"], "v").collect()} == {1: ("resolved", ["a"]), 2: ("ambiguous", ["b", "c"]), 3: ("unresolved", [])}
    m = spark.createDataFrame([("g", "m1", "p", "1"), ("g", "m2", "p", "1"), ("g", "m1", "q", "x"), ("h", "m3", "p", "2")], "g string, m string, p string, v string")
    assert [tuple(r) for r in R.variation_dimensions(m, "g", "m", "p", "v").collect()] == [("g", "q", 2)]
    s = spark.createDataFrame([(0, "x"), (1, "X "), (2, "none"), (3, "both")], "position int, selector string")
    repos = spark.createDataFrame([("r1", ["x", "both"]), ("r2", ["both"])], "repo string, al array<string>")
    assert {r.position: r.status for r in R.match_selectors(s, repos, F.col("al"), "repo").collect()} == {0: "selected", 1: "duplicate", 2: "missing", 3: "ambiguous"}
    d = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x")], "i string, v string")
    assert {r.i: (r.source_row_count, r.distinct_variant_count, r.identity_conflict) for r in R.dedupe_diagnostics(d, "i", F.col("v")).collect()} == {"a": (2, 2, True), "b": (2, 1, False)}


def test_sql_trees():
    kinds = lambda t: sqlscript.footprint(t)["statement_type_counts"]
    assert kinds("select 1 union select 2 intersect select 3") == {"union": 1}
    assert kinds("(select 1) except (select 2); (select 1)") == {"except": 1, "subquery": 1}
    assert kinds("with a as (select 1 union select 2) insert into t select * from a") == {"insert": 1}
    assert kinds("with a as (select 1), b as (values (1)) select * except (x) from a") == {"select": 1}
    assert kinds("insert into t select 1 union select 2; create table u as select 1 union select 2") == {"insert": 1, "create": 1}
    assert kinds("from t select x; values (1), (2); explain select 1") == {"select": 1, "values": 1, "describe": 1}
    f = sqlscript.footprint("select a, (select max(b) from u) from (select * from (values (1)) v where a in (select c from d)) w group by a order by a")
    assert f["status"] == "complete" and f["nested_query_counts"] == {"select": 3, "values": 1}
    assert f["clause_counts"] == {"from": 4, "where": 1, "group": 1, "order": 1}
    assert sqlscript.footprint("select a is distinct from b from t")["status"] == "complete"


def test_a_bad_statement_costs_only_itself():
    f = sqlscript.footprint("select f(1, (2;\nselect 3;\nselect 4) from t;\nselect a where b from c;\nupdate t set x = {{ y }};\ndrop table z")
    assert f["statement_type_counts"] == {"select": 4, "update": 1, "drop": 1} and f["status"] == "partial"
    assert [(e["line"], e["kind"]) for e in f["errors"]] == [(1, "unbalanced_parenthesis"), (3, "unbalanced_parenthesis"), (4, "clause_out_of_order"), (5, "template_expression")]
    assert [s[1:] for s in f["spans"]] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6)]
    deep = sqlscript.footprint("select " + "(" * 3000 + "1" + ")" * 3000)
    assert deep["statement_type_counts"] == {"select": 1} and deep["status"] == "complete"


def test_sql_footprints():
    f = sqlscript.footprint("SELECT 1; INSERT INTO a SELECT 2")
    assert f["statement_type_counts"] == {"insert": 1, "select": 1} and f["status"] == "complete"
    assert sqlscript.footprint("frob it")["statement_type_counts"] == {"command": 1} and sqlscript.footprint("frob it")["status"] == "partial"
    t = sqlscript.footprint("SELECT {{ secret }} FROM x")
    assert t["status"] == "partial" and t["error_count"] > 0 and "secret" not in str(t["errors"])
    many = sqlscript.footprint("SELECT ${a};" * 15)
    assert len(many["errors"]) == 10 and many["errors_truncated"]
    assert sqlscript.footprint("select ';--' /* ; */ from $$ ; $$ ")["statement_count"] == 1


def test_config_parsers():
    assert buildconf.properties_items("a=1\nb : two \\\n  three\n#c\n!d\ne\\=f g\nk=\\u0041") == [("a", "1"), ("b", "two three"), ("e=f", "g"), ("k", "A")]
    assert dict(buildconf.toml_items("x = 1\n[a.b]\nc = [1, {d = 2}]")) == {"x": 1, "a.b.c": [1, {"d": 2}]}
    h = dict(buildconf.hocon_items('a { b = 1, l = [{q = 1}], u = "http://x" }\nf.g : true'))
    assert set(h) == {"a.b", "a.l", "a.u", "f.g"} and h["a.u"] == "http://x"
    for bad in ("a {", "a", 'include "x', "a = "):
        with pytest.raises(ParseGap):
            buildconf.hocon_items(bad)


def test_structured_parsers():
    assert structured.openapi_version({"openapi": "3", "swagger": "2"}) is None
    assert structured.json_schema({"type": "object", "properties": {}}) == ("strongly_supported_inference", None)
    assert structured.proto_syntax("// c\nsyntax = 'proto2';\nenum E { A = 0; }\noption x = 1;")[0] == "proto2"
    with pytest.raises(ParseGap):
        structured.proto_syntax("message A {")
    with pytest.raises(ParseGap):
        structured.load(".yaml", b"a: 1\n---\nb: 2")
    deep = structured.key_members({"a": {"a": {"a": 1}}})
    assert deep[0]["occurrence_count"] == 3 and (deep[0]["depth_min"], deep[0]["depth_max"]) == (0, 2)


def test_java_negatives():
    src = 'package p; /* @A */ class X { String s = "@B f.g()"; // h.i()\n void m() { if (a < b) { c(); } } }'
    labels = {f[2] for f in javasrc.facts(src) if f[0] in ("annotations", "api_calls")}
    assert not labels
    with pytest.raises(ParseGap):
        javasrc.facts("class X { void m( }")
