"""Makes this package importable in the Python workers, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if getattr(sc, "_stratalog_code", None):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="stratalog-"), "stratalog_code.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(root):
            for n in (n for n in names if n.endswith(".py")):
                z.write(os.path.join(d, n), os.path.join(os.path.basename(root), os.path.relpath(os.path.join(d, n), root)))
    sc.addPyFile(out)
    sc._stratalog_code = out
