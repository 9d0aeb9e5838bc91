"""Boilerplate lines by their frequency within a site, in DataFrame functions only.

A page's lines are its visible text, cut at block tags. Per host, the number of pages that have a line is divided by
the host's number of pages; lines over ``ratio`` are dropped from all pages of that host.

Lines are counted by their MD5, once a page, so a frequent line is pre-aggregated in the task that reads it and
no text shuffles. A host keeps at most (its lines per page / ratio) boilerplate lines, which is what its pages
are joined with; that side is broadcast only if few, and else joined by host, where AQE splits a large host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import BROADCAST_ROWS, small_side, written

RATIO = 0.3
MIN_PAGES = 4

_HIDDEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
_BLOCK = r"(?i)</?(?:p|br|div|li|ul|ol|h[1-6]|tr|td|th|table|article|nav|footer|header|section|title|body|head|html|main|aside|blockquote|pre)(?:\s[^>]*)?/?>"
_TAG = r"<[^>]+>"
_SPACE = r"[ \t\r\f\x0B]+"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def page_lines(html):
    """Non-empty lines of a page, single-spaced, in order."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, "")
    text = F.regexp_replace(F.regexp_replace(text, _BLOCK, "\n"), _TAG, "")
    return F.filter(F.transform(F.split(F.regexp_replace(text, _SPACE, " "), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def line_dedup(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, host, n_lines, n_dropped, clean_text (the kept lines).

    A line that occurs on more than ``ratio`` of its host's pages is dropped there. Hosts of fewer than ``min_pages``
    pages (at least 2 / ratio makes sense) and pages without a host (null or odd url: host is empty) keep all lines.
    A null or empty html has no line and an empty text. Repeated rows count as pages of their own; an empty table
    gives an empty result; other columns are not read.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), _HOST, 1))
    rows = written(pages.select(F.col(id_col).alias("id"), host.alias("host"), page_lines(F.col(html_col)).alias("lines")), "lines")
    totals = small_side(written(rows.filter("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages), "totals"))
    each = rows.filter("host <> ''").select("host", F.explode(F.array_distinct("lines")).alias("line")).select("host", F.md5("line").alias("h"))
    counts = written(each.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1" if ratio * min_pages >= 1 else "n > 0"), "counts")
    common = written(counts.join(totals, "host").filter(F.col("n") / F.col("pages") > ratio).select("host", "h"), "common")
    few = common.count() <= BROADCAST_ROWS
    common = written(common.groupBy("host").agg(F.collect_list("h").alias("drop")), "drop")
    joined = rows.join(F.broadcast(common) if few else common, "host", "left")
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("drop"), F.md5(x))))
    out = joined.select("id", "host", "lines", kept.alias("kept"))
    return out.select(
        F.col("id").alias(id_col), "host", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("clean_text"),
    )


def query(spark, sf_dir):
    return line_dedup(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    q = lambda p: "'" + p.replace("'", "''") + "'"
    return f"""
WITH l AS (
  SELECT row_number() OVER () AS r, page_id, lower(regexp_extract(coalesce(url, ''), {q(_HOST)}, 1)) AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), {q(_HIDDEN)}, '', 'g'), {q(_BLOCK)}, chr(10), 'g'), {q(_TAG)}, '', 'g'), {q(_SPACE)}, ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
  FROM pages),
t AS (SELECT host, count(*) AS pages FROM l WHERE host <> '' GROUP BY host HAVING count(*) >= {MIN_PAGES}),
c AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM l WHERE host <> '') GROUP BY ALL),
d AS (SELECT host, list(line) AS dropped FROM c JOIN t USING (host) WHERE n / pages > {RATIO} GROUP BY host),
k AS (SELECT page_id, l.host, lines, CASE WHEN dropped IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(dropped, x)) END AS kept FROM l LEFT JOIN d ON l.host = d.host)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS clean_text FROM k
"""


SQL = _sql()
