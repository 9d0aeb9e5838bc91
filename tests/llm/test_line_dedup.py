from collections import Counter

import duckdb

from stratalog.llm.line_dedup import SQL, line_dedup, query


def test_boilerplate_of_a_host(spark):
    page = lambda k: f"<html><nav>Menu</nav><p>only {k}</p><p>  twice   said </p><p>twice said</p><footer>Foot&copy;</footer></html>"
    rows = [(k, f"https://A.example:80/{k}", page(k)) for k in range(6)] + [(10, "http://b.example/", page(10)), (11, None, page(11)), (12, "not a url", page(12)), (13, "http://a.example/x", None), (14, "http://a.example/y", ""), (None, "http://user@a.example/z", "<p>lone line</p><script>Menu</script>"), (0, "https://A.example:80/0", page(0))]
    rows += [(20 + k, "http://long.example/", "<p>" + "word " * 50000 + f"{k}</p><p>same</p>") for k in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as lines", "3 as id", "4 as n")
    got = line_dedup(df, ratio=0.5, min_pages=4).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[3].clean_text == "only 3" and (by[3].n_lines, by[3].n_dropped, by[3].host) == (5, 4, "a.example")
    assert by[10].n_dropped == by[11].n_dropped == by[12].n_dropped == 0 and by[11].host == by[12].host == ""
    assert (by[13].n_lines, by[13].clean_text) == (0, "") and by[None].clean_text == "lone line"
    assert by[20].n_dropped == 1 and len(by[20].clean_text) > 200_000


def test_ratio_is_exact(spark):
    rows = [(k, "http://h.example/", f"<p>half</p><p>u{k}</p>" if k < 5 else f"<p>u{k}</p>") for k in range(10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sum(r.n_dropped for r in line_dedup(df, ratio=0.5).collect()) == 0
    assert sum(r.n_dropped for r in line_dedup(df, ratio=0.49).collect()) == 5


def test_empty_table(spark):
    assert line_dedup(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_plan_is_native(spark, sf):
    plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    df = query(spark, sf).select("page_id", "host", "n_lines", "n_dropped", "clean_text")
    got = Counter(tuple(r) for r in df.collect())
    want = Counter(con.execute(f"select page_id, host, n_lines, n_dropped, clean_text from ({SQL})").fetchall())
    assert got == want
    assert sum(r[3] > 0 for r in got) > 0
