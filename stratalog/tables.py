"""Written tables in the folder that driver and executors share; they cut a plan's lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where it is unset and driver and executors are one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: the executors need a folder that they share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="stratalog-"))
    return "file://" + _own_dir[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/stratalog-{uuid.uuid4().hex}/{name}"
    sc = spark.sparkContext
    top = sc._jvm.org.apache.hadoop.fs.Path(path).getParent()
    top.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(top)
    return path


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` as a written table: it cuts the lineage, survives lost executors and is computed once. ``codec``: the session's by default."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
