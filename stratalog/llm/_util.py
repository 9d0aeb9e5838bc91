"""What the operators of this subpackage share: written tables, size checks, code for the workers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import workers
from ..tables import scratch, shared_dir, written

#: Rows of fixed width (at most about 100 bytes) that a broadcast side may have.
BROADCAST_ROWS = 100_000

#: Rows of an Arrow batch to a worker. Texts are long: at the default of 10,000 a batch and its Python strings take some
#: 150 MB in each worker.
BATCH_ROWS = 2_000

__all__ = ["BATCH_ROWS", "BROADCAST_ROWS", "documents", "id_type", "scratch", "shared_dir", "ship", "small_side", "texts", "written"]


def ship(spark: SparkSession) -> None:
    """Code for the workers, and smaller batches unless the session chose a size."""
    workers.ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table of narrow rows) with a broadcast hint if it has few enough rows.

    Beyond that it is left to a sort-merge join, whose skewed partitions AQE splits.
    """
    return F.broadcast(df) if df.count() <= rows else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def texts(column) -> list[str]:
    """An Arrow string column as a list, null as the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]
