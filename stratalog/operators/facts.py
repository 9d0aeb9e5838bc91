"""Facts of files: one table function over the file table runs every parser that a file's name asks for.

Bytes go in and leave the plan there; what comes out are narrow rows of one schema for all sections, so that everything
after this is built-in DataFrame work. Each file is parsed once, whoever uses its facts.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import ship

#: Bytes above which a file is not parsed but reported, for each kind of parser.
LIMITS = {"structured": 8 << 20, "java": 8 << 20, "build_config": 8 << 20, "sql": 8 << 20}
#: Whose limit the other parsers have.
_LIMIT_OF = {"xml": "structured", "source_formats": "structured"}

SCHEMA = (
    "repo_id string, file_id string, path string, scope string, section string, family_kind string, family_label string, descriptor_json string, "
    "member_json string, occurrence_count long, line_start int, line_end int, column_start int, column_end int, extra_json string"
)
_ARROW = [("repo_id", pa.string()), ("file_id", pa.string()), ("path", pa.string()), ("scope", pa.string()), ("section", pa.string()), ("family_kind", pa.string()), ("family_label", pa.string()), ("descriptor_json", pa.string()), ("member_json", pa.string()), ("occurrence_count", pa.int64()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("column_start", pa.int32()), ("column_end", pa.int32()), ("extra_json", pa.string())]


canonical = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str).encode

#: Texts of flat descriptors, which files repeat; as many as a worker keeps.
_known: dict[tuple, str] = {}
MAX_KNOWN = 100_000


def _text(value: dict) -> str:
    """``canonical``, once for equal descriptors whose values are no containers."""
    key = tuple(value.items())
    try:
        got = _known.get(key)
    except TypeError:
        return canonical(value)
    # equal keys may stand for values of other kinds (1, 1.0, True): only texts and nulls are kept
    if got is None:
        got = canonical(value)
        if all(v is None or type(v) is str for v in value.values()):
            if len(_known) >= MAX_KNOWN:
                _known.clear()
            _known[key] = got
    return got


def _sha(value) -> str:
    return hashlib.sha256(canonical(value).encode("utf-8", "surrogatepass")).hexdigest()


class _Out:
    """Collects one file's facts."""

    def __init__(self):
        self.rows: list[tuple] = []

    def fact(self, section, kind, label, descriptor, count=1, member=None, span=None, extra=None):
        lines = span or (None, None, None, None)
        self.rows.append((section, kind, label, _text(descriptor), None if member is None else canonical(member), count, *lines, None if extra is None else canonical(extra)))

    def gap(self, code, message, **basis):
        self.rows.append(("diagnostics", code, message, canonical(basis), None, 1, None, None, None, None, None))

    def status(self, probe, status):
        self.rows.append(("probe_status", probe, status, "{}", None, 1, None, None, None, None, None))


def _structured(out: _Out, ext: str, data: bytes) -> None:
    from ..parsers import structured as P

    syntax, doc = P.load(ext, data)
    members = P.key_members(doc)
    shape = [(m["key"], m["paths"], sorted(m["value_kind_counts"])) for m in members]
    out.fact("structured_families", "structured_document_shape", syntax, {"syntax_family": syntax, "root_kind": P.value_kind(doc), "structural_signature": _sha([syntax, P.value_kind(doc), shape])}, extra={"key_family_member_count": len(members)})
    for m in members:
        member = {"path_count": len(m["paths"]), "path_fingerprint": _sha(m["paths"]), "single_path": m["single_path"], "value_kinds": sorted(m["value_kind_counts"]), "depth_min": m["depth_min"], "depth_max": m["depth_max"]}
        out.fact("structured_families", "structured_key_family", m["key"], {"syntax_family": syntax, "key": m["key"]}, m["occurrence_count"], member={"syntax": syntax, **member}, extra={"value_kind_counts": m["value_kind_counts"]})
    for key, value, basis in P.scalar_properties(doc):
        out.rows.append(("scalar_properties", syntax, key, canonical({"basis": basis}), None, 1, None, None, None, None, canonical({"value": value})))
    if version := P.openapi_version(doc):
        out.fact("source_formats", "source_format_observation", "openapi", {"source_format": "openapi", "format_version": version[0]})
        for op in P.openapi_operations(doc):
            out.fact("http_facts", "openapi_operation", op["path"], {}, extra=op)
    if found := P.json_schema(doc):
        if found[0] == "ambiguity":
            out.gap("json_schema_markers_ambiguous", "JSON Schema markers do not suffice")
        else:
            out.fact("source_formats", "source_format_observation", "json_schema", {"source_format": "json_schema", "format_version": found[1]}, extra={"classification": found[0]})


def _xml(out: _Out, ext: str, data: bytes) -> None:
    from ..parsers import structured as P

    root, rows = P.xml_shape(data)
    for r in rows:
        d = {k: r[k] for k in ("observation_kind", "namespace_uri", "local_name", "prefix")}
        out.fact("xml_observations", "xml_observation", r["local_name"] or "xml_observation", d, r["occurrence_count"])
    if ext == ".xsd":
        if root == (P.XML_SCHEMA, "schema"):
            out.fact("source_formats", "source_format_observation", "xsd", {"source_format": "xsd", "format_version": None})
        else:
            out.gap("xsd_format_not_confirmed", "root is no XML Schema")


def _proto(out: _Out, text: str) -> None:
    from ..parsers.structured import proto_syntax

    syntax, declared = proto_syntax(text)
    if syntax in ("proto2", "proto3") and declared:
        out.fact("source_formats", "source_format_observation", "protobuf", {"source_format": "protobuf", "format_version": syntax})
    else:
        out.gap("proto_format_not_confirmed", "syntax or declarations are missing", syntax=syntax, declarations=declared)


def _build(out: _Out, name: str, ext: str, text: str) -> None:
    from ..parsers import buildconf as P

    if name == "pom.xml":
        for d in P.maven_dependencies(text):
            if not d["group_id"] or not d["artifact_id"]:
                out.gap("maven_dependency_missing_coordinate_part", "groupId or artifactId is missing", declaration_context=d["declaration_context"])
            else:
                out.fact("dependencies", "dependency_observation", d["artifact_id"], {"build_system": "maven", **d})
    if name.endswith((".gradle", ".gradle.kts")):
        out.gap("gradle_dependency_detail_not_evaluated", "Gradle files are not parsed")
    if ext in (".properties", ".conf", ".toml"):
        for key, value in P.config_items(ext, text):
            section, _, last = key.rpartition(".")
            if isinstance(value, dict) and value["kind"] == "include":
                out.fact("config_facts", "include", value["target"], {}, extra={"prefix": key, **value})
                continue
            there = value is not None and value != ""
            # the value itself is never kept
            d = {"format": ext[1:], "section": section or None, "key": last or key, "full_key": key, "value_present": there, "value_fingerprint": _sha(value) if there else None}
            out.fact("config_keys", "config_key_observation", key, d)


def _sql(out: _Out, text: str) -> None:
    from ..parsers.sqlscript import footprint

    got = footprint(text)
    spans = got.pop("spans")
    for kind, n in got["statement_type_counts"].items():
        first = next(s for s in spans if s[0] == kind)
        out.fact("sql_statements", "sql_statement_family", kind, {"statement_type": kind}, n, span=(first[1], first[2], None, None), extra=got)
    if got["error_count"] or got["unsupported_count"]:
        out.gap("sql_parse_partial", "some statements were not recognised", errors=got["errors"], truncated=got["errors_truncated"], unsupported=got["unsupported_count"])
    out.status("sql", got["status"])


def _java(out: _Out, text: str) -> None:
    from ..parsers import javasrc

    for row in javasrc.facts(text):
        out.fact(*row[:4], **row[4])


def parse_file(name: str, ext: str, data: bytes | None, size: int | None = None, limits: dict[str, int] = LIMITS) -> list[tuple]:
    """All facts of one file. A parser that fails gives a diagnostic and withholds its own rows only. ``data`` is not asked for where ``size`` is above a limit."""
    size = len(data) if size is None else size
    from ..parsers import ParseGap
    from ..parsers import structured as P

    jobs = []
    if ext in P.JSON_EXTENSIONS | P.YAML_EXTENSIONS:
        jobs.append(("structured", lambda o: _structured(o, ext, data)))
    if ext in P.XML_EXTENSIONS:
        jobs.append(("xml", lambda o: _xml(o, ext, data)))
    text = lambda: data.decode("utf-8-sig")
    if ext == ".proto":
        jobs.append(("source_formats", lambda o: _proto(o, text())))
    if name == "pom.xml" or name.endswith((".gradle", ".gradle.kts")) or ext in (".properties", ".conf", ".toml"):
        jobs.append(("build_config", lambda o: _build(o, name, ext, text())))
    if ext == ".sql":
        jobs.append(("sql", lambda o: _sql(o, text())))
    if ext == ".java":
        jobs.append(("java", lambda o: _java(o, text())))
    rows = []
    for probe, job in jobs:
        out = _Out()
        try:
            limit = limits[_LIMIT_OF.get(probe, probe)]
            if size > limit:
                raise ParseGap("inventory_probe_file_size_limit", "file is too large to parse", byte_size=size, max_probe_file_bytes=limit)
            job(out)
        except ParseGap as e:
            out = _Out()
            out.gap(e.code, e.message, **e.basis)
            out.status(probe, "partial" if e.code == "inventory_probe_file_size_limit" else "failed")
        except (UnicodeDecodeError, RecursionError, ValueError) as e:
            out = _Out()
            out.gap(f"{probe}_parse_failed", "file was not parsed", error_type=type(e).__name__)
            out.status(probe, "failed")
        else:
            if not any(r[0] == "probe_status" for r in out.rows):
                out.status(probe, "partial" if any(r[0] == "diagnostics" for r in out.rows) else "complete")
        rows += out.rows
    return rows


def _run(limits: dict[str, int]):
    def run(batches):
        names, kinds = [n for n, _ in _ARROW], [t for _, t in _ARROW[4:]]
        for b in batches:
            rows, counts = [], []
            for name, ext, size, content in zip(*[c.to_pylist() for c in b.columns[4:]]):
                got = parse_file(name, ext, content, size, limits)
                rows += got
                counts.append(len(got))
            # a file's own columns are repeated by Arrow; the facts' are built column by column
            at = pa.array(np.repeat(np.arange(b.num_rows), counts))
            cols = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns[:4]], *[pa.array(c, t) for c, t in zip(cols, kinds)]], names)

    return run


def extract_facts(files: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """Facts of all files that have content. Files no parser asks for are filtered before any byte reaches Python, and so are the
    bytes of those above all limits."""
    ship(files.sparkSession)
    wanted = F.col("extension").isin(".json", ".avsc", ".yaml", ".yml", ".xml", ".xsd", ".proto", ".gradle", ".kts", ".properties", ".conf", ".toml", ".sql", ".java")
    size = F.octet_length("content").cast("long")
    rows = files.filter(wanted & F.col("content").isNotNull())
    return rows.select("repo_id", "file_id", "path", "scope", "file_name", "extension", size.alias("size"), F.when(size <= max(limits.values()), F.col("content")).alias("content")).mapInArrow(_run(limits), SCHEMA)
