"""Facts of files as they arrive: a stream over file rows that keeps family counts up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import facts, families, scan


def family_counts(arrivals: DataFrame) -> DataFrame:
    """Family occurrences over all files so far, for ``update`` or ``complete`` output.

    ``arrivals`` has the filetree columns. The batch's table functions run on each micro-batch; the state is one row
    per family, which is what a family table holds anyway.
    """
    files = scan.files(arrivals)
    rows = families.observations(facts.extract_facts(files), files)
    return rows.groupBy("repo_id", "section", "family_kind", "family_label").agg(F.sum("occurrence_count").alias("occurrence_count"))
