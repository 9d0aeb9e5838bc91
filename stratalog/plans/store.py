"""Folders of tables that change in one step.

A folder holds ``data/<table>/_v=<version>/repo_id=<repository>/`` and heads. A change writes all of its tables below a version of
its own and then one new head, which names for each table the version that holds each repository's rows. Readers take
the head of the largest number, so they see all of a change or nothing of it, and a change that breaks off leaves the
tables as they were; its version is never named and ``vacuum`` removes it. Nothing that was written is changed later.

With its rows each change stores their hash trees (``hashtree``) and an inventory of its files, so that a check reads
again only what has changed on disk.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import hashtree

#: Of stored tables; a table of another contract is refused.
CONTRACT = "stratalog/3"
PARTS, INVENTORY = "_parts", "_inventory"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Head:
    """What a folder's tables are: {table: (schema, {version: repositories whose rows it holds})}."""

    def __init__(self, number: int, tables: dict, contract: str = CONTRACT):
        self.number, self.tables, self.contract = number, tables, contract

    def version_of(self, name: str) -> dict[str, str]:
        return {r: v for v, (live, _) in self.tables.get(name, (None, {}))[1].items() for r in live}

    def repos(self, name: str) -> set[str]:
        return set(self.version_of(name))


def head(spark: SparkSession, folder: str) -> Head:
    """The newest head; number 0 where the folder has none."""
    p, fs = _fs(spark, f"{folder}/heads")
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    numbers = [int(n[:-5]) for n in names if n.endswith(".json")]
    return _load(spark, folder, max(numbers)) if numbers else Head(0, {})


def _load(spark: SparkSession, folder: str, number: int) -> Head:
    got = json.loads("".join(r[0] for r in spark.read.text(f"{folder}/heads/{number:012d}.json").collect()))
    sets = got["sets"]
    return Head(number, {n: (t["schema"], {v: (set(sets[a]), lost) for v, (a, lost) in t["versions"].items()}) for n, t in got["tables"].items()}, got["contract"])


def _swap(spark: SparkSession, folder: str, old: Head, tables: dict) -> Head:
    """Writes the head after ``old``. Whoever comes second to a number loses: heads are never replaced."""
    sets: list[list[str]] = []
    place: dict[frozenset, int] = {}
    out = {}
    for n, (schema, versions) in tables.items():
        named = {}
        for v, (live, lost) in versions.items():
            key = frozenset(live)
            if key not in place:
                place[key] = len(sets)
                sets.append(sorted(live))
            named[v] = (place[key], lost)
        out[n] = {"schema": schema, "versions": named}
    text = json.dumps({"contract": CONTRACT, "sets": sets, "tables": out})
    new, fs = _fs(spark, f"{folder}/heads/{old.number + 1:012d}.json")
    tmp, _ = _fs(spark, f"{folder}/heads/.{uuid.uuid4().hex}")
    stream = fs.create(tmp, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(new) or not fs.rename(tmp, new):
        fs.delete(tmp, False)
        raise RuntimeError(f"{folder} was changed by another job meanwhile")
    return Head(old.number + 1, tables)


def _frame(spark: SparkSession, folder: str, name: str, schema: dict, versions: dict, repos=None) -> DataFrame:
    """Rows of the repositories that each version holds; only these versions' folders are listed."""
    kind = T.StructType.fromJson(schema)
    wanted = None if repos is None else set(repos)
    want, paths = F.lit(False), []
    for v, (live, lost) in versions.items():
        some = live if wanted is None else live & wanted
        if not some:
            continue
        paths.append(f"{folder}/data/{name}/_v={v}")
        # a version whose repositories are all wanted needs no list
        want = want | (F.col("_v") == v) if not lost and len(some) == len(live) else want | (F.col("_v") == v) & F.col("repo_id").isin(sorted(some))
    if not paths:
        return spark.createDataFrame([], kind)
    full = T.StructType([*[f for f in kind.fields if f.name != "repo_id"], T.StructField("_v", T.StringType()), T.StructField("repo_id", T.StringType())])
    df = spark.read.schema(full).option("basePath", f"{folder}/data/{name}").parquet(*paths)
    return df.filter(want).select(kind.names)


def read(spark: SparkSession, folder: str, name: str, repos=None, at: Head | None = None) -> DataFrame:
    """A table, or some repositories' rows of it, as of a head (the newest one if none is given)."""
    at = at or head(spark, folder)
    if at.contract != CONTRACT:
        raise ValueError(f"{folder} has the contract {at.contract}, not {CONTRACT}")
    if name not in at.tables:
        raise FileNotFoundError(f"{folder} has no table {name}")
    return _frame(spark, folder, name, *at.tables[name], repos)


class Change:
    """Some repositories' new rows of several tables: staged by ``write``, read back by ``read``, in force after ``commit``."""

    def __init__(self, spark: SparkSession, folder: str, repos=None):
        self.spark, self.folder, self.repos = spark, folder, None if repos is None else sorted(repos)
        self.version, self.old, self.staged = f"{int(time.time() * 1000):x}-{uuid.uuid4().hex[:12]}", head(spark, folder), {}

    def write(self, df: DataFrame, name: str, spread: bool = True) -> None:
        """Stages a table. With ``spread`` rows are first brought together by repository, large repositories in several
        parts and small ones together, so that there are few files for each."""
        out = df.hint("rebalance", "repo_id") if spread else df
        out.write.partitionBy("repo_id").parquet(f"{self.folder}/data/{name}/_v={self.version}")
        self.staged[name] = df.schema.jsonValue()

    def read(self, name: str) -> DataFrame:
        kind = T.StructType.fromJson(self.staged[name])
        full = T.StructType([*[f for f in kind.fields if f.name != "repo_id"], T.StructField("repo_id", T.StringType())])
        return self.spark.read.schema(full).parquet(f"{self.folder}/data/{name}/_v={self.version}").select(kind.names)

    def commit(self) -> Head:
        """Marks of what was staged, then the new head. Without ``repos`` the staged tables are replaced as wholes."""
        at = f"{self.folder}/data"
        hashtree.tables({n: self.read(n) for n in self.staged}).write.parquet(f"{at}/{PARTS}/_v={self.version}")
        _files(self.spark, [f"{at}/{n}/_v={self.version}" for n in self.staged]).write.parquet(f"{at}/{INVENTORY}/_v={self.version}")
        have: dict[str, set] = {n: set() for n in self.staged}
        if self.repos is None:
            for r in self.spark.read.parquet(f"{at}/{PARTS}/_v={self.version}").select("table_name", "repo_id").distinct().collect():
                have[r.table_name].add(r.repo_id)
        tables = dict(self.old.tables)
        for n, schema in self.staged.items():
            new, versions = have[n], {}
            if self.repos is not None:
                new = set(self.repos)
                versions = {v: (live - new, lost or bool(live & new)) for v, (live, lost) in tables.get(n, (None, {}))[1].items() if live - new}
            tables[n] = (schema, versions | {self.version: (new, False)})
        return _swap(self.spark, self.folder, self.old, tables)


def write(df: DataFrame, folder: str, name: str, repos=None) -> Head:
    """A change of one table: replaces it, or with ``repos`` these repositories' rows, also where they now have none."""
    change = Change(df.sparkSession, folder, repos)
    change.write(df, name)
    return change.commit()


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Data files of some versions with length and time of change; Spark lists them and does not read their content."""
    there = [p for p in paths if (lambda at, fs: fs.exists(at))(*_fs(spark, p))]
    if not there:
        return spark.createDataFrame([], "table_name string, repo_id string, file string, length long, changed timestamp")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(there).select("path", "length", "modificationTime")
    part = lambda k: F.regexp_extract("path", r"/data/([^/]+)/(_v=[^/]+/repo_id=([^/]*)/[^/]+)$", k)
    # the file system's names of partitions are escaped, and the listing escapes paths once more where it gives URIs
    repo = F.url_decode(F.replace(part(3), F.lit("+"), F.lit("%2B")))
    return f.select(part(1).alias("table_name"), F.when(F.contains(repo, F.lit("%")), F.url_decode(F.replace(repo, F.lit("+"), F.lit("%2B")))).otherwise(repo).alias("repo_id"), part(2).alias("file"), "length", F.col("modificationTime").alias("changed"))


def _marks(spark: SparkSession, folder: str, kind: str, names, at: Head) -> DataFrame | None:
    """Stored marks of the rows that are in force."""
    want, versions = F.lit(False), set()
    for n in names:
        for v, (live, lost) in at.tables[n][1].items():
            versions.add(v)
            own = (F.col("table_name") == n) & (F.col("_v") == v)
            want = want | (own & F.col("repo_id").isin(sorted(live)) if lost else own)
    if not versions:
        return None
    df = spark.read.option("basePath", f"{folder}/data/{kind}").parquet(*[f"{folder}/data/{kind}/_v={v}" for v in sorted(versions)])
    return df.withColumn("_v", F.col("_v").cast("string")).filter(want)


def parts(spark: SparkSession, folder: str, names=None, at: Head | None = None) -> DataFrame:
    """Stored hash trees: table_name, repo_id, part, rows, hash."""
    at = at or head(spark, folder)
    got = _marks(spark, folder, PARTS, names or sorted(at.tables), at)
    return spark.createDataFrame([], hashtree.SCHEMA) if got is None else got.drop("_v")


def touched(spark: SparkSession, folder: str, names=None, at: Head | None = None) -> DataFrame:
    """Tables' repositories (table_name, repo_id) whose files are not those that were written; nothing else needs to be read again."""
    at = at or head(spark, folder)
    names = names or sorted(at.tables)
    then = _marks(spark, folder, INVENTORY, names, at)
    if then is None:
        return spark.createDataFrame([], "table_name string, repo_id string")
    now = _files(spark, [f"{folder}/data/{n}/_v={v}" for n in names for v in at.tables[n][1]])
    key = ["table_name", "repo_id", "file", "length", "changed"]
    old = then.select(key)
    # rows of repositories that another version holds now do not count
    alive = spark.createDataFrame([(n, v, r) for n in names for v, (live, lost) in at.tables[n][1].items() if lost for r in live] or [("", "", "")], "table_name string, v string, repo_id string")
    partial = F.struct(F.lit("")).isNull()
    for n in names:
        for v, (_, lost) in at.tables[n][1].items():
            if lost:
                partial = partial | (F.col("table_name") == n) & F.col("file").startswith(f"_v={v}/")
    here = now.filter(~partial).unionByName(now.filter(partial).withColumn("v", F.regexp_extract("file", "^_v=([^/]+)/", 1)).join(F.broadcast(alive), ["table_name", "v", "repo_id"], "left_semi").drop("v"))
    return old.exceptAll(here.select(key)).unionByName(here.select(key).exceptAll(old)).select("table_name", "repo_id").distinct()


def damage(spark: SparkSession, folder: str, names=None, everything: bool = True, at: Head | None = None) -> DataFrame:
    """Parts whose rows are not those that were stored: table_name, repo_id, part, stored and found (null: none).

    Without ``everything`` only repositories are read whose files were touched.
    """
    at = at or head(spark, folder)
    names = names or sorted(at.tables)
    now = hashtree.tables({n: read(spark, folder, n, at=at) for n in names})
    then = parts(spark, folder, names, at)
    if not everything:
        some = touched(spark, folder, names, at).collect()  # of touched partitions only
        now = None
        for n in sorted({r.table_name for r in some}):
            one = hashtree.tables({n: read(spark, folder, n, [r.repo_id for r in some if r.table_name == n], at)})
            now = one if now is None else now.unionByName(one)
        if now is None:
            now = spark.createDataFrame([], hashtree.SCHEMA)
        keys = spark.createDataFrame([(r.table_name, r.repo_id) for r in some], "table_name string, repo_id string")
        then = then.join(keys, ["table_name", "repo_id"], "left_semi")
    return hashtree.differences(then, now)


def compact(spark: SparkSession, folder: str) -> Head:
    """All tables in one version each, so that many small changes do not leave many folders to list."""
    at = head(spark, folder)
    whole = Change(spark, folder)
    for n in at.tables:
        whole.write(read(spark, folder, n, at=at), n)
    return whole.commit()


def vacuum(spark: SparkSession, folder: str, heads: int = 1, older_than: float = 86_400) -> list[str]:
    """Removes versions that none of the newest ``heads`` names and that began over ``older_than`` seconds ago."""
    p, fs = _fs(spark, f"{folder}/heads")
    numbers = sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(p) if f.getPath().getName().endswith(".json"))
    kept = set()
    for n in numbers[-heads:]:
        kept |= {v for _, versions in _load(spark, folder, n).tables.values() for v in versions}
    gone = []
    top, _ = _fs(spark, f"{folder}/data")
    for t in fs.listStatus(top):
        for f in fs.listStatus(t.getPath()):
            v = f.getPath().getName().removeprefix("_v=")
            if v not in kept and int(v.split("-")[0], 16) / 1000 < time.time() - older_than:
                fs.delete(f.getPath(), True)
                gone.append(f"{t.getPath().getName()}/{v}")
    for n in numbers[:-heads]:
        fs.delete(_fs(spark, f"{folder}/heads/{n:012d}.json")[0], False)
    return sorted(gone)
