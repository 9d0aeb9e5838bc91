"""License detection by ordered signature rules.

A text is lower-cased (A-Z), cut into words and written with single spaces. Rules are gated: keywords are looked up first,
then the gates that have one that occurs, and only rules whose gate occurs run their pattern. Overlaps are resolved in rule order: a detection is
suppressed when the words it spans lie inside those of a detection of higher priority, or of the same priority and
either longer or of an earlier rule. Base phrases are detections like the others but never suppressed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import documents, id_type, ship, texts
from .license_rules import rules

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def keyword(gate: bytes) -> bytes:
    """A piece of a gate by which most texts are told not to have it."""
    return b"licen" if b"licen" in gate else max(gate.split(), key=len)


class Scanner:
    """Rules behind their gates, and gates behind a keyword each."""

    def __init__(self):
        self.by_gate: dict[bytes, list[tuple[int, object]]] = {}
        for k, r in enumerate(rules()):
            self.by_gate.setdefault(r.gate, []).append((k, r))
        self.by_keyword: dict[bytes, list[bytes]] = {}
        for gate in self.by_gate:
            self.by_keyword.setdefault(keyword(gate), []).append(gate)

    def scan(self, text: str) -> tuple[int, list[dict]]:
        """Number of words, and detections in order of place."""
        words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split()
        if not words:
            return 0, []
        norm = b" " + b" ".join(words) + b" "
        found, place = [], None
        for word, gates in self.by_keyword.items():
            if word not in norm:
                continue
            for gate in gates:
                if gate not in norm:
                    continue
                for k, r in self.by_gate[gate]:
                    for m in r.pattern.finditer(norm):
                        if place is None:  # words before each byte
                            place = np.cumsum(np.frombuffer(norm, np.uint8) == 32, dtype=np.int32)
                        first = int(place[m.start() - 1]) - 1 if m.start() else -1
                        found.append((first, first + m[0].count(b" ") + 1, k, r))
        return len(words), resolve(found)


def resolve(found: list[tuple]) -> list[dict]:
    """Marks suppressed detections. ``found``: (first word, word after the last, rule number, rule)."""
    found.sort(key=lambda d: (d[0], -d[1], d[2]))
    out = []
    open_: list[tuple] = []  # earlier starts that may reach over the current one
    for first, end, k, r in found:
        open_ = [d for d in open_ if d[1] > first]
        inside = [d for d in open_ if d[1] >= end]
        over = any(d[3].priority > r.priority or d[3].priority == r.priority and (d[1] - d[0] > end - first or d[2] < k) for d in inside)
        out.append({"rule": r.name, "label": r.label, "first_word": first, "n_words": end - first, "priority": r.priority, "weight": r.weight, "base": r.base, "suppressed": over and not r.base})
        open_.append((first, end, k, r))
    return out


_state: dict = {}
_DETECTION = pa.struct([("rule", pa.string()), ("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("priority", pa.int32()), ("weight", pa.float64()), ("base", pa.bool_()), ("suppressed", pa.bool_())])
_SCHEMA = "n_words long, detections array<struct<rule:string,label:string,first_word:long,n_words:long,priority:int,weight:double,base:boolean,suppressed:boolean>>"


def _run(batches):
    scanner = _state.get("scanner") or _state.setdefault("scanner", Scanner())
    for b in batches:
        got = [scanner.scan(t) for t in texts(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([d for _, d in got], pa.list_(_DETECTION))], ["id", "n_words", "detections"])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words and detections (suppressed ones too, marked) of each whole text.

    A null or empty text has no words and no detections. Repeated rows give repeated results; an empty table gives
    an empty result; other columns are not read.
    """
    ship(docs.sparkSession)
    two = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(_run, f"id {id_type(docs, id_col)}, {_SCHEMA}").withColumnRenamed("id", id_col)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, places, labels and score from detections. Score: the largest weight of what is kept, else 0."""
    base = F.filter("detections", lambda d: d["base"])
    kept = F.filter("detections", lambda d: ~d["suppressed"])
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda d: d["label"]))), ",")
    places = F.transform(base, lambda d: d["first_word"])
    return scanned.select(
        id_col, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        names(base).alias("base_labels"), names(kept).alias("labels"), F.coalesce(F.array_max(F.transform(kept, lambda d: d["weight"])), F.lit(0.0)).alias("score"),
    )


def query(spark, sf_dir):
    return digest(license_scan(documents(spark, sf_dir)))
