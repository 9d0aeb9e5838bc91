"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every distinct shingle hash below a fixed share of the hash range, so its size grows with the document and
two sketches are samples of one kind, however unequal the documents: the share of one's hashes that the other holds
estimates containment without bias. Sketches merge by union (``merged``). A hash is the first 16 hex digits of a
shingle's MD5; words are runs without ASCII white space, A-Z lower-cased; a text of fewer words than a shingle is
one shingle. A text none of whose hashes is below the threshold keeps its least one, so that only a text without words
has an empty sketch; merging drops such a hash as soon as there are others.

All of it is DataFrame functions. ``neighbours`` gives each document its successor's text without a global sort of the
texts: only (id, text hash) pairs are range-partitioned, and their cut points tell each row its range; the first row of
each range also goes, as a guest, to the range before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import documents, id_type, written

WORDS = 5
#: The share of shingle hashes that a sketch keeps.
FRACTION = 1 / 8
#: Ranges for each shuffle partition, so that partitions get about equal numbers.
RANGES = 4

_SPACE = r"[ \t\n\x0B\f\r]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def threshold(fraction: float) -> str:
    """Hashes below this are kept."""
    return f"{min(int(fraction * 2**64), 2**64 - 1):016x}"


def hashes(text: Column, words: int = WORDS) -> Column:
    """The hash of each shingle, repeats included; null like the empty text."""
    folded = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    split = F.filter(F.split(folded, _SPACE), lambda w: w != "")

    def windows(ws: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(ws) - (words - 1), F.lit(1)))
        all_ = F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(ws, i, words), " ")), 1, 16))
        return F.when(F.size(ws) == 0, F.array().cast("array<string>")).otherwise(all_)

    return _let(split, windows)


def sketch(text: Column, words: int = WORDS, fraction: float = FRACTION) -> Column:
    """The sorted distinct hashes kept of a text."""
    cut = F.lit(threshold(fraction))

    def keep(hs: Column) -> Column:
        return _let(F.filter(hs, lambda h: h < cut), lambda ks: F.when((F.size(ks) > 0) | (F.size(hs) == 0), F.array_sort(F.array_distinct(ks))).otherwise(F.array(F.array_min(hs))))

    return _let(hashes(text, words), keep)


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of two documents together."""
    cut = F.lit(threshold(fraction))
    both = F.array_sort(F.array_union(a, b))
    return _let(both, lambda hs: _let(F.filter(hs, lambda h: h < cut), lambda ks: F.when(F.size(ks) > 0, ks).otherwise(F.slice(hs, 1, 1))))


def containment(a: Column, b: Column) -> Column:
    """The share of ``a``'s hashes that ``b`` holds: 1 for two empty sketches, 0 if only ``a`` is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise((F.size(b) == 0).cast("double"))


def resemblance(a: Column, b: Column) -> Column:
    """Shared hashes by all hashes of both; 1 for two empty sketches."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(1.0))


def _range_of(key: Column, bounds: list, kind: str) -> Column:
    """Which of the ranges that begin at ``bounds`` has ``key``, by binary search."""
    if len(bounds) < 2:
        return F.lit(0)
    at = F.array(*[F.struct(F.lit(b["id"]).cast(kind).alias("id"), F.lit(b["h"]).cast("long").alias("h")) for b in bounds])

    def halve(s: Column, _) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        right = F.coalesce(F.get(at, mid) <= key, F.lit(False))
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~right, mid).otherwise(s["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), halve)["lo"] - 1


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["h"] == b["h"])


def _with_next(rows: DataFrame, more: dict[str, Column]) -> DataFrame:
    """``rows`` (id, text, h) with the columns ``more`` of text, and for each column c but id and h its successor's as next_c."""
    spark, kind = rows.sparkSession, id_type(rows, "id")
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n"))
    ranged = keys.repartitionByRange(ranges, F.col("id").asc_nulls_first(), "h").withColumn("p", F.spark_partition_id())
    # one row for each range; only these stay, so that no table of the keys has to be written
    firsts = sorted(ranged.groupBy("p").agg(F.min(F.struct("id", "h")).alias("first"), F.max("n").alias("n")).collect(), key=lambda r: r["p"])
    bounds = [r["first"] for r in firsts]
    again = None
    if any(r["n"] > 1 for r in firsts):  # repeated rows: one of them stands for all
        repeated = written(keys.filter("n > 1").select("id", "h"), "repeated")
        again = rows.select("id", "h").join(repeated, _same(rows, repeated), "left_semi").select(F.col("id").alias("id_again"), F.col("h").alias("h_again"))
        once = rows.join(repeated, _same(rows, repeated), "left_semi").dropDuplicates(["id", "h"])
        rows = rows.join(repeated, _same(rows, repeated), "left_anti").unionByName(once)
    guests = spark.createDataFrame([(b["id"], b["h"], (k - 1) % len(bounds)) for k, b in enumerate(bounds)], f"id {kind}, h long, before int")
    placed = rows.withColumn("own", _range_of(F.struct("id", "h"), bounds, kind)).join(F.broadcast(guests), _same(rows, guests), "left").select(rows["id"], rows["h"], "text", F.array_compact(F.array("own", "before")).alias("to"))
    placed = placed.select("id", "h", "text", F.posexplode("to").alias("guest", "p")).repartition("p").select("*", *[c.alias(n) for n, c in more.items()])
    order = Window.partitionBy("p").orderBy("guest", F.col("id").asc_nulls_first(), "h")
    out = placed.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in ("text", *more)]).filter("guest = 0").drop("guest", "p")
    if again is None:
        return out.drop("h")
    names = [c for c in out.columns if c != "h"]
    alone = out.join(repeated, _same(out, repeated), "left_anti").select(names)
    those = out.join(repeated, _same(out, repeated), "left_semi")
    return alone.unionByName(again.join(those, F.col("id_again").eqNullSafe(F.col("id")) & (F.col("h_again") == F.col("h"))).select(names))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: dict[str, Column] | None = None) -> DataFrame:
    """Each row's id, text and ``more`` (columns computed from ``text``), with its successor's as next_text and next_...

    Documents are ordered by id, nulls first, those of one id by a hash of the text; the last one's successor is the
    first. Rows that repeat a document (same id and text) count as one document and give as many equal rows. A
    null text is empty; other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return _with_next(rows.withColumn("h", F.xxhash64("text")), more or {}).withColumnRenamed("id", id_col)


def query(spark, sf_dir):
    n, half = F.length("text").cast("long"), F.floor(F.length("text") / 2).cast("int")
    near = neighbours(documents(spark, sf_dir), more={"own": sketch(F.col("text"))})
    near = near.select("doc_id", n.alias("n_chars"), "own", "next_own", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    near = near.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "next_own", sketch(F.col("edited")).alias("new"))
    return near.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("own", ",").alias("fingerprint"), F.array_join("new", ",").alias("edited_fingerprint"),
        containment(F.col("own"), F.col("new")).alias("near_edited"), containment(F.col("own"), F.col("next_own")).alias("near_next"),
    )


_SKETCH = f"""list_transform([list_filter(string_split_regex(translate({{0}}, '{_UPPER}', '{_UPPER.lower()}'), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')],
    lambda ws: CASE WHEN len(ws) = 0 THEN [] ELSE list_transform(range(1, greatest(len(ws) - {WORDS - 2}, 2)), lambda i: substr(md5(array_to_string(ws[i:i + {WORDS - 1}], ' ')), 1, 16)) END)[1]"""
_KEPT = f"""CASE WHEN len(list_filter({{0}}, lambda h: h < '{threshold(FRACTION)}')) > 0 OR len({{0}}) = 0
    THEN list_sort(list_distinct(list_filter({{0}}, lambda h: h < '{threshold(FRACTION)}'))) ELSE [list_min({{0}})] END"""
_SHARE = "CASE WHEN len(own) > 0 THEN len(list_intersect(own, {0})) / len(own) ELSE CAST(len({0}) = 0 AS DOUBLE) END"

SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n_chars, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS follow FROM d),
e AS (SELECT *, left(t, n_chars - n_chars // 2) || left(follow, n_chars // 2) AS edited FROM n),
h AS (SELECT doc_id, n_chars, edited, {_SKETCH.format("t")} AS a, {_SKETCH.format("edited")} AS b FROM e),
k AS (SELECT doc_id, n_chars, edited, {_KEPT.format("a")} AS own, {_KEPT.format("b")} AS new FROM h),
f AS (SELECT *, coalesce(lead(own) OVER (ORDER BY doc_id), first_value(own) OVER (ORDER BY doc_id)) AS next_own FROM k)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(own, ',') AS fingerprint,
    array_to_string(new, ',') AS edited_fingerprint, {_SHARE.format("new")} AS near_edited, {_SHARE.format("next_own")} AS near_next
FROM f
"""
