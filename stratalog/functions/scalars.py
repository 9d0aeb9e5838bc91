"""Scalar functions over paths, counts, keys and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file suffix.
EXTENSION_LANGUAGES = {
    ".java": "java", ".py": "python", ".sql": "sql", ".xml": "xml", ".xsd": "xml", ".json": "json", ".yaml": "yaml",
    ".yml": "yaml", ".toml": "toml", ".properties": "properties", ".proto": "proto", ".gradle": "gradle", ".kt": "kotlin",
    ".kts": "kotlin", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".md": "markdown", ".csv": "csv", ".tsv": "tsv", ".conf": "config_text", ".avsc": "json",
}

# Directories outside the scope of a scan unless the caller gives others.
EXCLUDED_DIRECTORIES = (".git", ".hg", ".svn", ".idea", ".gradle", ".venv", "__pycache__", "node_modules", "target", "build", "__MACOSX")

# What marks keys as operational or as mere frequencies.
OPERATIONAL_TOKENS = ("frontier", "unreadable", "diagnostic", "failed", "error_count")
FREQUENCY_KEYS = ("occurrence_count", "record_count", "records_count", "file_count", "analyzer_eligible_file_count", "outside_analyzer_frontier_file_count", "family_member_count", "structure_family_occurrence_count")
COUNT_TOKENS = ("count", "total", "files", "records", "rows", "columns", "fields", "edges", "nodes")

# Upper bounds of numeric buckets and their names.
BUCKETS = ((0, "zero"), (1, "one"), (4, "2_4"), (16, "5_16"), (64, "17_64"), (256, "65_256"), (1024, "257_1024"))
LAST_BUCKET = "gt_1024"

# Git messages that mean a failure for good, and those worth another attempt.
PERMANENT_FAILURES = ("authentication failed", "access denied", "repository not found", "not found", "couldn't find remote ref", "remote branch", "does not appear to be a git repository")
TRANSIENT_FAILURES = ("timed out", "timeout", "connection reset", "connection refused", "temporary failure", "remote end hung up", "http 500", "http 502", "http 503", "http 504", "the requested url returned error: 5")

HTTP_METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "TRACE")


def fingerprint(*cols: Column) -> Column:
    """SHA-256 of the columns as JSON with fixed field order; nulls count."""
    return F.sha2(F.to_json(F.struct(*[c.alias(f"f{k:02d}") for k, c in enumerate(cols)]), {"ignoreNullFields": "false"}), 256)


def stable_id(namespace: str, *cols: Column) -> Column:
    """``namespace_`` and 24 hex digits of the fingerprint."""
    return F.concat(F.lit(namespace + "_"), F.substring(fingerprint(F.lit(namespace), *cols), 1, 24))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension_of(path: Column) -> Column:
    """Lower-case last suffix of the file name, ``<none>`` without one; a leading dot alone starts no suffix."""
    got = F.lower(F.regexp_extract(F.regexp_replace(file_name(path), r"^\.+", ""), r"^.+(\.[^.]+)$", 1))
    return F.when(got == "", F.lit("<none>")).otherwise(got)


def language_of(extension: Column) -> Column:
    """Language of a suffix, null if it has none."""
    pairs = [F.lit(x) for kv in EXTENSION_LANGUAGES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), extension)


def source_tree_scope(path: Column) -> Column:
    """What stands before the first segment ``src``; else the first of several segments; else ``.``"""
    parts = F.split(path, "/")
    at = F.array_position(parts, "src")
    before = F.array_join(F.slice(parts, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")), "/")
    first = F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise(F.lit("."))
    return F.when(at > 0, F.when(before == "", F.lit(".")).otherwise(before)).otherwise(first)


def salience(count: Column, coverage: Column) -> Column:
    """Score from repetition (at most 35) and coverage (20, 10 or 5), plus 10, to three decimals."""
    repeated = F.least(F.lit(35.0), F.lit(8.0) * F.log2(F.greatest(count, F.lit(1)).cast("double") + 1))
    covered = F.when(coverage == "complete", 20.0).when(coverage == "partial", 10.0).otherwise(5.0)
    return F.round(F.least(F.lit(100.0), repeated + covered + 10.0), 3)


def numeric_bucket(value: Column) -> Column:
    v = F.abs(value)
    out = F.when(v <= BUCKETS[0][0], F.lit(BUCKETS[0][1]))
    for bound, name in BUCKETS[1:]:
        out = out.when(v <= bound, F.lit(name))
    return out.otherwise(F.lit(LAST_BUCKET))


def contains_any(text: Column, tokens) -> Column:
    return F.exists(F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(text, t))


def is_operational_key(key: Column) -> Column:
    return contains_any(F.lower(key), OPERATIONAL_TOKENS)


def is_frequency_key(key: Column) -> Column:
    return F.lower(key).isin(*FREQUENCY_KEYS) | F.endswith(F.lower(key), F.lit("_occurrence_count"))


def qname(name: Column) -> Column:
    """{namespace}local or prefix:local as a struct (namespace, local_name)."""
    ns = F.regexp_extract(name, r"^\{([^}]*)\}", 1)
    return F.struct(F.when(ns != "", ns).alias("namespace"), F.regexp_replace(name, r"^\{[^}]*\}", "").alias("local_name"))


def normalize_repository_id(value: Column) -> Column:
    """camelCase split, everything but ASCII letters and digits to one underscore, trimmed, lower case."""
    x = F.regexp_replace(F.coalesce(value, F.lit("")), "([a-z])([A-Z])", "$1_$2")
    x = F.regexp_replace(F.regexp_replace(x, "[^a-zA-Z0-9_]", "_"), "_+", "_")
    return F.lower(F.regexp_replace(x, "^_+|_+$", ""))


def sanitize_url(value: Column) -> Column:
    """http, https and ssh addresses without user info and with a lower-case host; others as they are."""
    x = F.trim(value)
    pattern = r"^(?i)(https?|ssh)://(?:[^/?#@]*@)?([^/?#@:]+)(:[0-9]+)?([/?#].*)?$"
    part = lambda k: F.regexp_extract(x, pattern, k)
    clean = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), part(3), part(4))
    return F.when(x.rlike(pattern), clean).otherwise(x)


def join_http_path(prefix: Column, route: Column) -> Column:
    """One slash between the two; a route of slashes alone leaves the prefix with a final slash."""
    tail, head = F.regexp_replace(route, "^/+", ""), F.regexp_replace(prefix, "/+$", "")
    slash = F.lit("/")
    return (
        F.when(prefix == "", F.when(route == "", slash).otherwise(route))
        .when(route == "", prefix)
        .when(prefix == "/", F.concat(slash, tail))
        .when(tail == "", F.concat(head, slash))
        .otherwise(F.concat(head, slash, tail))
    )


def literal_string(expression: Column) -> Column:
    """Content of a double-quoted literal without a backslash, else null."""
    x = F.trim(expression)
    return F.when(x.rlike(r'^"[^\\]*"$') & (F.length(x) >= 2), F.substring(x, F.lit(2), F.length(x) - 2))


def symbol(expression: Column) -> Column:
    """A plain identifier, with or without ``this.``, else null."""
    x = F.regexp_replace(F.trim(expression), r"^this\.", "")
    return F.when(x.rlike(r"^[\p{L}_$][\p{L}\p{N}_$]*$"), x)


def http_method(expression: Column) -> Column:
    """Last dotted part if it names an HTTP method, else null."""
    x = F.element_at(F.split(F.trim(expression), r"\."), -1)
    return F.when(x.isin(*HTTP_METHODS), x)


def payload_type(text: Column) -> Column:
    """A type's name without java.lang, java.util and one HTTP wrapper; null if nothing is left."""
    x = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"java\.(?:lang|util)\.", "")
    inner = F.regexp_extract(x, r"^(?:HttpEntity|RequestEntity|ResponseEntity|ParameterizedTypeReference)<(.*)>$", 1)
    wrapped = x.rlike(r"^(?:HttpEntity|RequestEntity|ResponseEntity|ParameterizedTypeReference)<.*>$")
    out = F.when(wrapped, F.trim(inner)).otherwise(x)
    return F.when(out != "", out)


def is_transient_failure(log: Column) -> Column:
    """Whether another attempt may help; a sign of failure for good wins."""
    x = F.lower(log)
    return ~contains_any(x, PERMANENT_FAILURES) & contains_any(x, TRANSIENT_FAILURES)


def selector_key(value: Column) -> Column:
    """Trimmed lower case. Full case folding differs for a few letters, such as the sharp s."""
    return F.lower(F.trim(value))


def dotted_suffixes(key: Column) -> Column:
    """a.b.c to [a.b.c, b.c, c]: turns a suffix condition into an equality."""
    parts = F.split(key, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def url_path(url: Column) -> Column:
    """Path of an address without its first slash, query and fragment."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?([^?#]*)", 1)
