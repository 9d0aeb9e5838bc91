"""Relational operators that the analytics are built from, each a plan of built-in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

#: Rule tables and other configuration of fixed size are broadcast up to so many rows.
CONFIG_ROWS = 10_000


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 1, members: str | None = None) -> DataFrame:
    """Islands of the intervals of each key; intervals at most ``gap`` apart join. Inverted and null ones are ignored.

    Gives keys, start, end, intervals (how many) and, with ``members``, the sorted distinct members of each island.
    A key's intervals are sorted within one task by the window; what leaves it is one row per island.
    """
    rows = df.filter(F.col(start) <= F.col(end))
    order = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("_new", (reach.isNull() | (F.col(start) > reach + gap)).cast("int"))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    aggs = [F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("intervals")]
    if members:
        aggs.append(F.array_sort(F.collect_set(members)).alias(members + "s"))
    return numbered.groupBy(*keys, "_island").agg(*aggs).drop("_island")


def widen_spans(df: DataFrame, start: str, end: str, last_line: str, context: int) -> DataFrame:
    """Spans with ``context`` lines on both sides, clamped to the file; ``in_bounds`` is false where the start is past the end."""
    ok = (F.col(start) >= 1) & (F.col(end) >= F.col(start)) & (F.col(start) <= F.col(last_line))
    return df.withColumns({
        "in_bounds": F.coalesce(ok, F.lit(False)),
        start: F.greatest(F.lit(1), F.col(start) - context),
        end: F.least(F.col(last_line), F.least(F.col(end), F.col(last_line)) + context),
    })


def unique_match(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join with only those keys of ``right`` that occur once."""
    once = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in right.columns if c not in on]).filter("_n = 1").drop("_n")
    return left.join(once, on)


def resolution(left: DataFrame, right: DataFrame, on: list[str], value: str, zero: str = "unresolved", one: str = "resolved", many: str = "ambiguous") -> DataFrame:
    """``left`` with sorted distinct ``candidates`` of its key and their status: none, one or several."""
    found = right.groupBy(*on).agg(F.array_sort(F.collect_set(value)).alias("candidates"))
    n = F.coalesce(F.size("candidates"), F.lit(0))
    out = left.join(found, on, "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    return out.withColumn("status", F.when(n <= 0, zero).when(n == 1, one).otherwise(many))


def suffix_match(left: DataFrame, suffix: str, right: DataFrame, key: str, suffixes) -> DataFrame:
    """Join of ``left.suffix`` with every ``right.key`` that equals it or ends with a dot and it, as an equi-join.

    ``suffixes(column)`` gives a key's dotted suffixes; each key is exploded once, so no pair is compared.
    """
    each = right.withColumn("_suffix", F.explode(suffixes(F.col(key))))
    return left.join(each, F.col(suffix) == F.col("_suffix")).drop("_suffix")


def rule_matches(rows: DataFrame, rules: DataFrame, kind: str = "family_kind", label: str = "family_label", facets: str | None = "facets") -> DataFrame:
    """Rows and rules (kinds, label_pattern, facet_pattern) that match: the rule takes the kind, and its label pattern
    is found in the label or its facet pattern in a facet.

    A rule table is configuration of at most ``CONFIG_ROWS`` rows and is broadcast.
    """
    if rules.limit(CONFIG_ROWS + 1).count() > CONFIG_ROWS:
        raise ValueError(f"a rule table has at most {CONFIG_ROWS} rows")
    r = F.broadcast(rules.select(*[F.col(c).alias("_" + c) if c in ("kinds", "label_pattern", "facet_pattern") else F.col(c) for c in rules.columns]))
    by_label = F.coalesce((F.col(label) != "") & F.rlike(F.col(label), F.col("_label_pattern")), F.lit(False))
    hit = by_label
    if facets:
        hit = hit | F.coalesce(F.exists(F.col(facets), lambda f: F.rlike(f, F.col("_facet_pattern"))), F.lit(False))
    return rows.join(r, F.array_contains(F.col("_kinds"), F.col(kind)) & hit).drop("_kinds", "_label_pattern", "_facet_pattern")


def bounded_sample(df: DataFrame, keys: list[str], value: Column, limit: int, name: str) -> DataFrame:
    """Per key the first ``limit`` of its sorted distinct values as ``name``, and their number as ``name_count``; nulls don't count.

    Values are made distinct by a grouping and cut by rank, which Spark also does before the shuffle, so no task holds more
    than the sample of a key.
    """
    each = df.select(*keys, value.alias(name)).filter(F.col(name).isNotNull()).distinct()
    first = each.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(name))).filter(F.col("_rank") <= limit)
    some = first.groupBy(*keys).agg(F.array_sort(F.collect_list(name)).alias(name))
    return some.join(each.groupBy(*keys).agg(F.count(F.lit(1)).alias(name + "_count")), keys)


def sum_maps(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Per key, the sum of map<string,long> columns entry by entry."""
    flat = df.select(*keys, F.explode(column).alias("_k", "_v")).groupBy(*keys, "_k").agg(F.sum("_v").alias("_v"))
    return flat.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(name))


def worst_status(status: Column, rank: dict[str, int], unknown: int = 1, empty: str = "complete") -> Column:
    """Aggregate: the status of the highest rank, the later name of equal ranks; ``empty`` if there is none."""
    at = F.lit(unknown)
    for name, r in rank.items():
        at = F.when(status == name, r).otherwise(at)
    known = F.when(status != "", status)
    return F.coalesce(F.max_by(known, F.when(known.isNotNull(), F.struct(at, known))), F.lit(empty))


def dedupe_diagnostics(df: DataFrame, identity: str, variant: Column) -> DataFrame:
    """Per identity: source rows, distinct variants, and whether they conflict."""
    return df.groupBy(identity).agg(F.count(F.lit(1)).alias("source_row_count"), F.count_distinct(variant).alias("distinct_variant_count")).withColumn("identity_conflict", F.col("distinct_variant_count") > 1)


def variation_dimensions(df: DataFrame, group: str, member: str, path: str, value: str) -> DataFrame:
    """Per group, the paths whose value differs between members; a member without the path counts as a state.

    ``df`` has a row per member and path. A path misses from some member if fewer members have it than the group has.
    """
    size = df.groupBy(group).agg(F.count_distinct(member).alias("_members"))
    per = df.groupBy(group, path).agg(F.count_distinct(value).alias("_values"), F.count_distinct(member).alias("_have"))
    states = F.col("_values") + (F.col("_have") < F.col("_members")).cast("long")
    return per.join(size, group).select(group, path, states.alias("distinct_state_count")).filter("distinct_state_count > 1")


def missing_ids(requested: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    return requested.select(key).distinct().join(resolved.select(key), key, "left_anti")


def align_payloads(df: DataFrame, keys: list[str], descriptor: str, preferred: Column) -> DataFrame:
    """Within a key all rows take the one preferred descriptor, else the one descriptor there is, else keep their own.

    Joins each row with its key's aggregate, so a hot key is pre-aggregated and no window holds its rows.
    """
    one = lambda c: F.when(F.count_distinct(c) == 1, F.max(c))
    agg = df.groupBy(*keys).agg(one(F.when(preferred, F.col(descriptor))).alias("_pref"), one(F.col(descriptor)).alias("_any"))
    return df.join(agg, keys, "left").withColumn("aligned_" + descriptor, F.coalesce("_pref", "_any", descriptor)).drop("_pref", "_any")


def reuse_decision(current: DataFrame, previous: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Action per current row: reuse if every column of ``same`` equals the previous row's (nulls equal), else rebuild.

    The reason is the first difference in the order of ``same``, or that there is no previous row.
    """
    prev = previous.select(F.col(key), F.lit(True).alias("_seen"), *[F.col(c).alias("_prev_" + c) for c in same])
    reason = F.when(F.col("_seen").isNull(), "no_previous_result")
    for c in same:
        reason = reason.when(~F.col(c).eqNullSafe(F.col("_prev_" + c)), c + "_changed")
    out = current.join(prev, key, "left").withColumn("reason", reason.otherwise("unchanged"))
    return out.withColumn("action", F.when(F.col("reason") == "unchanged", "reuse").otherwise("rebuild")).drop("_seen", *["_prev_" + c for c in same])


def match_selectors(selectors: DataFrame, repositories: DataFrame, aliases: Column, repo: str) -> DataFrame:
    """Each selector (position, selector) with the repository that it names and a status.

    ``selected``, ``missing``, ``ambiguous`` (several repositories), or ``duplicate`` (an earlier selector took it).
    """
    from ..functions.scalars import selector_key

    alias = repositories.select(F.col(repo).alias("_repo"), F.explode(F.array_distinct(F.transform(aliases, selector_key))).alias("_key")).filter("_key <> ''")
    keyed = selectors.withColumn("_key", selector_key(F.col("selector")))
    found = keyed.join(alias, "_key", "left").groupBy("position", "selector").agg(F.count_distinct("_repo").alias("matches"), F.min("_repo").alias("_repo"))
    first = found.filter("matches = 1").groupBy("_repo").agg(F.min("position").alias("_first"))
    out = found.join(first, "_repo", "left")
    status = F.when(F.col("matches") == 0, "missing").when(F.col("matches") > 1, "ambiguous").when(F.col("position") > F.col("_first"), "duplicate").otherwise("selected")
    return out.select("position", "selector", F.when(F.col("matches") == 1, F.col("_repo")).alias(repo), "matches", status.alias("status"))


def json_keys_exploded(df: DataFrame, column: str) -> DataFrame:
    """A row per top-level key of a JSON object column, with the raw value and its kind."""
    as_map = F.from_json(F.col(column), T.MapType(T.StringType(), T.StringType()))
    return df.select("*", F.explode(as_map).alias("key", "value"))
