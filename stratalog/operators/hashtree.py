"""Hash trees of tables: rows, 2^20 leaves, 1,024 parts and a root for each repository, all SHA-256.

A row's place follows from its own hash, so a tree does not depend on the order of rows, and a change shows in the parts
that it touches. No group is larger than a leaf's rows or the 1,024 hashes below a part or a root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "table_name string, repo_id string, part int, rows long, hash string"
PARTS = 1024


def _joined(column: str):
    return F.sha2(F.concat_ws("", F.array_sort(F.collect_list(column))), 256)


def parts(df: DataFrame) -> DataFrame:
    """repo_id, part, rows, hash. Bytes in a column ``content`` count by the column ``sha256`` that goes with them."""
    names = sorted(c for c in df.columns if c != "content" or "sha256" not in df.columns)
    h = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    rows = df.select("repo_id", h.alias("h"))
    place = rows.select("repo_id", (F.conv(F.substring("h", 1, 3), 16, 10).cast("int") / (4096 // PARTS)).cast("int").alias("part"), F.substring("h", 1, 5).alias("leaf"), "h")
    # both groupings hold on the one exchange
    leaves = place.repartition("repo_id", "part").groupBy("repo_id", "part", "leaf").agg(F.count(F.lit(1)).alias("n"), _joined("h").alias("h"))
    return leaves.groupBy("repo_id", "part").agg(F.sum("n").alias("rows"), _joined("h").alias("hash"))


def tables(some: dict[str, DataFrame]) -> DataFrame:
    """The parts of several tables, with their names."""
    out = None
    for name, df in some.items():
        one = parts(df).select(F.lit(name).alias("table_name"), "repo_id", "part", "rows", "hash")
        out = one if out is None else out.unionByName(one)
    return out


def roots(some: DataFrame) -> DataFrame:
    """table_name, repo_id, root of parts."""
    each = F.concat(F.lpad(F.col("part").cast("string"), 4, "0"), F.lit(":"), F.col("hash")).alias("each")
    return some.select("table_name", "repo_id", each).groupBy("table_name", "repo_id").agg(_joined("each").alias("root"))


def differences(then: DataFrame, now: DataFrame) -> DataFrame:
    """Parts that differ: table_name, repo_id, part, rows stored and found (null where there were none)."""
    key = ["table_name", "repo_id", "part"]
    a = then.select(*key, F.col("rows").alias("stored"), F.col("hash").alias("_a"))
    b = now.select(*key, F.col("rows").alias("found"), F.col("hash").alias("_b"))
    return a.join(b, key, "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(*key, "stored", "found")
