"""Parsers of single files. Each gives plain rows; nothing here knows Spark.

A parser raises ``ParseGap`` where a file can't be read whole; the caller turns that into a diagnostic row, so a gap
is data and never a missing row.
"""

from __future__ import annotations


class ParseGap(Exception):
    def __init__(self, code: str, message: str, **basis):
        super().__init__(message)
        self.code, self.message, self.basis = code, message, basis
