"""Includes of configuration files, joined within each repository's file table.

A target is looked up beside the file that includes it and below that file's resource root, with its own extension or the three
that an include without one may mean. Nothing outside the repository is read: such a target is a row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import written

# Extensions that an include without one stands for.
EXTENSIONS = (".conf", ".json", ".properties")
_ROOT = r"^(.*/)?resources/"


def plain_path(path: Column) -> Column:
    """A path without ``.`` and ``..``; null if it leads out of the top."""
    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.array_append(done, part))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def includes(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Includes (repo_id, file_id, path, target, prefix, how, required) with ``included`` and a status, a row for each file found.

    ``resolved``, ``missing`` or, for a URL, ``external``.
    """
    v = F.from_json("extra_json", "prefix string, how string, required boolean").alias("v")
    inc = facts.filter("section = 'config_facts' and family_kind = 'include'").select("repo_id", "file_id", "path", F.col("family_label").alias("target"), v).select("repo_id", "file_id", "path", "target", "v.*").distinct()
    beside = F.concat(F.regexp_extract("path", r"^(.*/)?", 0), "target")
    root = F.when(F.col("how").isin("classpath", "heuristic") & F.rlike("path", F.lit(_ROOT)), F.concat(F.regexp_extract("path", _ROOT, 0), "target"))
    bare = ~F.rlike("target", F.lit(r"\.\w+$"))
    named = F.transform(F.array_compact(F.array(F.when(F.col("how") != "classpath", beside), root)), plain_path)
    each = F.flatten(F.transform(named, lambda p: F.when(bare, F.array(*[F.concat(p, F.lit(e)) for e in EXTENSIONS])).otherwise(F.array(p))))
    external = (F.col("how") == "url") | F.rlike("target", F.lit(r"^\w+://"))
    asked = inc.withColumn("candidate", F.explode(F.when(external, F.array().cast("array<string>")).otherwise(F.array_distinct(each))))
    found = asked.join(files.select("repo_id", F.col("path").alias("candidate")), ["repo_id", "candidate"]).select(*inc.columns, F.col("candidate").alias("included"))
    out = inc.join(found.select("repo_id", "path", "target", "prefix", "how", "included").distinct(), ["repo_id", "path", "target", "prefix", "how"], "left")
    status = F.when(F.col("included").isNotNull(), "resolved").when(external, "external").otherwise("missing")
    return out.select("repo_id", "file_id", "path", "target", "prefix", "how", "required", "included", status.alias("status"))


def include_closure(direct: DataFrame) -> DataFrame:
    """Which file takes in which, at which prefix and depth: (repo_id, path, included, prefix, depth, status).

    Rounds over the resolved includes of ``includes`` until none adds a way; a way that comes back to a file it has
    been through ends there, with status ``cycle``. The number of rounds is the depth of the deepest include.
    """
    edges = written(direct.filter("status = 'resolved'").select("repo_id", "path", "included", "prefix").distinct(), "includes")
    step = edges.select("repo_id", F.col("path").alias("_at"), F.col("included").alias("_to"), F.col("prefix").alias("_below"))
    loops = lambda col, to: F.when(F.array_contains(col, to), "cycle").otherwise("resolved")
    new = edges.select("*", F.lit(1).alias("depth"), F.array("path", "included").alias("way"), loops(F.array("path"), F.col("included")).alias("status"))
    out = new
    while True:
        on = (new["repo_id"] == step["repo_id"]) & (new["included"] == step["_at"])
        far = new.filter("status = 'resolved'").join(step, on).select(new["repo_id"], "path", F.col("_to").alias("included"), F.concat_ws(".", F.nullif("prefix", F.lit("")), F.nullif("_below", F.lit(""))).alias("prefix"), (F.col("depth") + 1).alias("depth"), F.array_append("way", F.col("_to")).alias("way"), loops(F.col("way"), F.col("_to")).alias("status"))
        new = written(far.distinct(), "includes")
        if new.isEmpty():
            return out.drop("way").distinct()
        out = out.unionByName(new)


def effective_keys(facts: DataFrame, closure: DataFrame) -> DataFrame:
    """Keys of each configuration file, its own (depth 0) and those it takes in, under their prefixes, with where they stand."""
    own = facts.filter("family_kind = 'config_key_observation'").select("repo_id", "path", F.col("family_label").alias("key")).distinct()
    taken = closure.filter("status = 'resolved'").select("repo_id", F.col("path").alias("_by"), F.col("included").alias("path"), "prefix", "depth")
    there = own.join(taken, ["repo_id", "path"]).select("repo_id", F.col("_by").alias("path"), F.concat_ws(".", F.nullif("prefix", F.lit("")), F.col("key")).alias("key"), F.col("path").alias("declared_in"), "depth")
    return own.select("repo_id", "path", "key", F.col("path").alias("declared_in"), F.lit(0).alias("depth")).unionByName(there.distinct())
