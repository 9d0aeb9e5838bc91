"""``spark.read.format("filetree")``: the files of one or several source trees, one row each.

Spark's binary file source drops hidden files and follows links, so trees have a source of their own. The driver lists
each tree's upper levels only, until it has ``subtrees`` directories to hand out; tasks walk those and read their contents.
Excluded directories are pruned by name in the walk; links are listed and never followed; ``.DS_Store`` and ``._*`` are
left out. A filter on ``repo_id`` is pushed down, so that other trees are not walked. A file that can't be read is a
row with an error and no content.

Options: ``path`` with ``repo_id`` (the folder's name by default), or ``repositories`` (a JSON object from repo_id to
path); ``excluded`` (a JSON list that replaces the default names); ``max_bytes`` (larger files come without content);
``subtrees`` (about how many partitions a tree gets at most).
"""

from __future__ import annotations

import json
import os

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..functions.scalars import EXCLUDED_DIRECTORIES

SCHEMA = "repo_id string, path string, is_symlink boolean, byte_size long, content binary, error string"


class _Subtree(InputPartition):
    """Directories of a tree: with ``deep`` all that is below them, else their own files."""

    def __init__(self, repo, root, directories, deep):
        self.repo, self.root, self.directories, self.deep = repo, root, directories, deep


class FileTreeReader(DataSourceReader):
    def __init__(self, options):
        trees = json.loads(options.get("repositories", "{}"))
        if not trees:
            path = os.path.abspath(options["path"])
            trees = {options.get("repo_id", os.path.basename(path)): path}
        self.trees = trees
        self.excluded = set(json.loads(options["excluded"])) if "excluded" in options else set(EXCLUDED_DIRECTORIES)
        self.max_bytes = int(options.get("max_bytes", 1 << 62))
        self.subtrees = max(2, int(options.get("subtrees", 128)))

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("repo_id",) and isinstance(f, EqualTo | In):
                values = f.value if isinstance(f, In) else (f.value,)
                self.trees = {k: v for k, v in self.trees.items() if k in values}
            else:
                yield f

    def partitions(self):
        out = []
        for repo, root in sorted(self.trees.items()):
            above, open_ = [], [""]
            while open_ and len(open_) < self.subtrees // 2:  # a level at a time
                below = [d for x in open_ for d in subdirectories(root, x, self.excluded)]
                above += open_
                open_ = below
            out.append(_Subtree(repo, root, above, False))
            n = min(self.subtrees, len(open_))
            out += [_Subtree(repo, root, open_[k::n], True) for k in range(n)]
        return out or [_Subtree("", "", [], False)]

    def read(self, partition):
        rows, held = [], 0
        for top in partition.directories:
            for path, _ in walk(partition.root, self.excluded, top, partition.deep):
                rows.append((partition.repo, path, *read_file(partition.root, path, self.max_bytes)))
                held += len(rows[-1][4] or b"")
                if len(rows) >= 1000 or held >= 8 << 20:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)


_ARROW = [("repo_id", pa.string()), ("path", pa.string()), ("is_symlink", pa.bool_()), ("byte_size", pa.int64()), ("content", pa.binary()), ("error", pa.string())]


def batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of the source's schema as an Arrow batch."""
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), _ARROW)], [n for n, _ in _ARROW])


def read_file(root: str, path: str, max_bytes: int) -> tuple:
    """(is a link, size, content, error) of one file."""
    full = os.path.join(root, path)
    if os.path.islink(full):
        return True, None, None, "symlink_not_followed"
    try:
        size = os.path.getsize(full)
        if size > max_bytes:
            return False, size, None, "file_too_large"
        with open(full, "rb") as f:
            content = f.read()
        return False, len(content), content, None
    except OSError as e:
        return False, None, None, type(e).__name__


def subdirectories(root: str, below: str, excluded: set[str]) -> list[str]:
    """Directories in one directory of a tree, as paths from its root; links and excluded ones are none."""
    with os.scandir(os.path.join(root, below)) as found:
        return sorted(os.path.join(below, d.name) for d in found if d.name not in excluded and d.is_dir(follow_symlinks=False))


def walk(root: str, excluded: set[str], below: str = "", deep: bool = True):
    """(relative path with slashes, size) of a tree's files, sorted by path; of one directory of it, or with what is under it."""
    found = []
    for top, dirs, names in os.walk(os.path.join(root, below), followlinks=False):
        linked = [d for d in dirs if os.path.islink(os.path.join(top, d)) and d not in excluded]
        dirs[:] = [d for d in dirs if d not in excluded and d not in linked] if deep else []
        for name in [*names, *linked]:
            if name == ".DS_Store" or name.startswith("._"):
                continue
            full = os.path.join(top, name)
            found.append((os.path.relpath(full, root).replace(os.sep, "/"), os.lstat(full).st_size))
    return sorted(found)


class FileTreeSource(DataSource):
    @classmethod
    def name(cls):
        return "filetree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FileTreeReader(self.options)


def register(spark: SparkSession) -> None:
    from ..workers import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileTreeSource)
