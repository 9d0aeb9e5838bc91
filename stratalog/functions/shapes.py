"""Structural shapes of open JSON descriptors: what stays of a descriptor when names and amounts are set aside.

Descriptors have no fixed schema, so these run on parsed JSON in Arrow batches; a batch's distinct descriptors are
worked out once.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from .scalars import BUCKETS, COUNT_TOKENS, FREQUENCY_KEYS, LAST_BUCKET, OPERATIONAL_TOKENS

# Keys whose strings are structure and stay, and keys whose strings are always names.
STRUCTURAL_KEYS = {
    "coverage_status", "payload_section", "fact_type", "section", "format", "status", "artifact_kind", "schema_version", "observed_section",
    "syntax", "parse_status", "root_type", "value_type", "direction", "protocol", "method", "family_kind", "receiver_basis", "syntax_family",
    "language", "build_system", "declaration_context", "scope", "classification", "type",
}
NAME_KEYS = {
    "artifact_name", "path", "relative_path", "repository_relative_path", "repository_id", "repo_id", "system_id", "artifact_id", "member_id",
    "source_member_id", "file_name", "repository_url", "content_fingerprint", "content_sha256", "sha256",
}
MASK = "<observed_string>"


def canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def is_structural(key: str) -> bool:
    """Whether strings under a key belong to the structure."""
    k = key.lower()
    return k not in NAME_KEYS and (k in STRUCTURAL_KEYS or k.endswith(("_status", "_kind", "_kinds")))


def is_skipped(key: str, frequency: bool = True) -> bool:
    k = key.lower()
    return any(t in k for t in OPERATIONAL_TOKENS) or frequency and (k in FREQUENCY_KEYS or k.endswith("_occurrence_count"))


def bucket(value: float) -> str:
    return next((name for bound, name in BUCKETS if abs(value) <= bound), LAST_BUCKET)


def shape(value, similar: bool, key: str = ""):
    """Names masked, operational and frequency keys dropped, lists as sorted sets. With ``similar`` numbers become a
    bucket, or one mark for all under a key of counts."""
    if isinstance(value, dict):
        return {str(k): shape(v, similar, str(k)) for k, v in value.items() if not is_skipped(str(k))}
    if isinstance(value, list):
        return [json.loads(x) for x in sorted({canonical(shape(v, similar, key)) for v in value})]
    if isinstance(value, str):
        return value if is_structural(key) else MASK
    if similar and isinstance(value, int | float) and not isinstance(value, bool):
        return "<count_metric>" if any(t in key.lower() for t in COUNT_TOKENS) else {"numeric_bucket": bucket(float(value))}
    return value


def leaves(value, path: str = "$", key: str = "", skip: bool = False) -> Iterator[tuple[str, str, object]]:
    """(path, key, leaf) of nested JSON; empty containers are leaves. ``skip`` leaves operational keys out."""
    if isinstance(value, dict) and value:
        for k in sorted(value, key=str):
            if not (skip and is_skipped(str(k), False)):
                yield from leaves(value[k], f"{path}.{k}", str(k), skip)
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}[{i}]", key, skip)
    else:
        yield path, key, value


def facets(value, path: str = "$") -> list[tuple[str, str]]:
    """The strings that a shape masks, with their paths."""
    return [(p, v) for p, k, v in leaves(value, path, skip=True) if isinstance(v, str) and not is_structural(k)]


def flatten(value) -> dict[str, str]:
    return {p: canonical(v) for p, _, v in leaves(value)}


def positive_metrics(value) -> list[tuple[str, float]]:
    return [(p, float(v)) for p, _, v in leaves(value) if isinstance(v, int | float) and not isinstance(v, bool) and v > 0 and math.isfinite(v)]
