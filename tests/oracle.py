"""Compares registered queries with their SQL, as the driver does: rows by value, columns by name."""

import os
import sys
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


def compare(spark, con, name, f, sql, sf):
    df = f(spark, sf)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols, (name, sorted(rel.columns), cols)
    want = Counter(tuple(plain(x) for x in r) for r in con.sql("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({sql})").fetchall())
    assert got == want, (name, sum(got.values()), sum(want.values()), list((got - want).items())[:3], list((want - got).items())[:3])
    return sum(got.values())


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf = os.environ.get("ORACLE_SF", "/root/testdata/sf0.01")
    con, sqls, qs = connect(sf), e.oracle_sql(), e.queries()
    for n in sys.argv[1:] or list(sqls):
        try:
            print(n, compare(spark, con, n, qs[n], sqls[n], sf), flush=True)
        except Exception as x:
            print("BAD", n, str(x)[:700], flush=True)
