"""Footprint of a SQL script: which statements it has, and which queries and clauses stand in them.

Tokens become a tree of statements and parentheses. A statement is named by its leading keyword, one that begins with
WITH by the verb after its tables, set operations by their operator, a query in parentheses as a subquery. No dialect is
guessed, and expressions are not parsed. Whatever is wrong costs its own statement only."""

from __future__ import annotations

import re
from collections import Counter

_TOKEN = re.compile(
    r"(?P<line>--[^\n]*)|(?P<block>/\*(?:[^*]|\*(?!/))*\*/)|(?P<open>/\*)|(?P<string>'(?:''|[^'])*'|\"(?:\"\"|[^\"])*\"|`[^`]*`|\[[^\]\n]*\])"
    r"|(?P<dollar>\$(?P<tag>[A-Za-z_]*)\$.*?\$(?P=tag)\$)|(?P<badstring>['\"`])|(?P<semi>;)|(?P<template>\{\{.*?\}\}|\{%.*?%\}|\$\{[^}]*\})|(?P<word>[^\W\d][\w$]*)|(?P<space>\s+)|(?P<other>.)",
    re.S,
)

#: Leading keyword to statement type; what is not here is a ``command``.
_TYPES = {
    "SELECT": "select", "FROM": "select", "WITH": "select", "VALUES": "values", "INSERT": "insert", "UPDATE": "update", "DELETE": "delete", "MERGE": "merge",
    "CREATE": "create", "ALTER": "alter", "DROP": "drop", "TRUNCATE": "truncatetable", "COMMENT": "comment", "GRANT": "grant", "REVOKE": "revoke",
    "SET": "set", "USE": "use", "BEGIN": "transaction", "START": "transaction", "COMMIT": "commit", "ROLLBACK": "rollback", "EXPLAIN": "describe",
    "DESCRIBE": "describe", "ANALYZE": "analyze", "COPY": "copy", "PRAGMA": "pragma", "CACHE": "cache", "REFRESH": "refresh", "KILL": "kill", "LOAD": "load_data",
}
_SETS = {"UNION": "union", "INTERSECT": "intersect", "EXCEPT": "except", "MINUS": "except"}
SUPPORTED = (frozenset(_TYPES.values()) | frozenset(_SETS.values()) | {"subquery"}) - {"kill"}
#: Clauses of a query in the order in which they may stand.
_CLAUSES = {"FROM": 1, "WHERE": 2, "GROUP": 3, "HAVING": 4, "ORDER": 6, "LIMIT": 7}
_NESTED = frozenset({"SELECT", "WITH", "VALUES", "FROM"})
MAX_ERRORS = 10


class _Node:
    """A statement, or what stands in one pair of parentheses."""

    __slots__ = ("lead", "verb", "sets", "wait", "clauses", "rank", "inner", "holds", "last")

    def __init__(self):
        self.lead = self.verb = self.wait = None
        self.sets, self.clauses, self.inner, self.holds, self.rank, self.last = [], [], [], False, 0, ""

    @property
    def query(self) -> bool:
        return self.lead in _NESTED or self.lead is None and self.holds

    def kind(self) -> str:
        if self.query and self.sets:
            return self.sets[0]
        if self.lead is None:
            return "subquery" if self.query else "unparsed"
        return _TYPES.get(self.verb or self.lead, "command")

    def word(self, up: str, line: int) -> dict | None:
        """Takes a word; an error if a clause stands where none of its kind may."""
        wrong = None
        if self.lead is None and not self.inner:
            self.lead = up
        elif self.lead == "WITH" and self.verb is None and up in ("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "VALUES"):
            self.verb = up
        if self.wait and up not in ("ALL", "DISTINCT"):
            if up in ("SELECT", "VALUES", "WITH", "FROM", "TABLE"):
                self.sets.append(self.wait)
                self.rank = 0
            self.wait = None
        if up in _SETS and self.query:
            self.wait = _SETS[up]
        rank = _CLAUSES.get(up)
        if rank and self.last != "DISTINCT" and (self.verb or self.lead) in ("SELECT", "FROM"):
            if rank < self.rank or rank == self.rank and up != "FROM":
                wrong = {"line": line, "kind": "clause_out_of_order"}
            self.rank = rank
            self.clauses.append(up.lower())
        self.last = up
        return wrong

    def close(self, inner: "_Node") -> None:
        """Takes what stood in parentheses: a nested query as such, else the queries in it."""
        self.inner += [inner] if inner.query else inner.inner
        self.holds = self.holds or inner.query
        if self.wait and inner.query:
            self.sets.append(self.wait)
            self.rank = 0
        self.wait, self.last = None, ")"

    def below(self):
        todo = list(self.inner)
        while todo:
            n = todo.pop()
            yield n
            todo += n.inner


def statements(text: str) -> tuple[list[tuple[_Node, int, int]], list[dict]]:
    """The statements' trees with first and last line, and what is wrong with them.

    A semicolon ends a statement at any depth, so that a parenthesis that is never closed costs its own statement only.
    """
    found, errors, stack, line, begun = [], [], [_Node()], 1, None

    def end():
        nonlocal stack, begun
        if len(stack) > 1:
            errors.append({"line": begun, "kind": "unbalanced_parenthesis"})
        while len(stack) > 1:
            inner = stack.pop()
            stack[-1].close(inner)
        if begun is not None:
            found.append((stack[0], begun, line))
        stack, begun = [_Node()], None

    for m in _TOKEN.finditer(text):
        kind, t = m.lastgroup if m.lastgroup != "tag" else "dollar", m[0]
        if kind == "semi":
            end()
        elif kind not in ("space", "line", "block"):
            begun, top = begun or line, stack[-1]
            if kind in ("open", "badstring"):
                errors.append({"line": line, "kind": "unterminated_" + ("comment" if kind == "open" else "string")})
            elif kind == "template":
                errors.append({"line": line, "kind": "template_expression"})
                top.last = ""
            elif kind == "word":
                if wrong := top.word(t.upper(), line):
                    errors.append(wrong)
            elif t == "(":
                stack.append(_Node())
            elif t == ")" and len(stack) > 1:
                stack.pop()
                stack[-1].close(top)
            elif t == ")":
                errors.append({"line": line, "kind": "unbalanced_parenthesis"})
            else:
                top.last = ""
        line += t.count("\n")
    end()
    return found, errors


def footprint(text: str) -> dict:
    """statement_type_counts, nested_query_counts, clause_counts, statement_count, unsupported_count, errors (first ten,
    without source text), status and spans (type, first line, last line) of the statements."""
    found, errors = statements(text)
    counts, nested, clauses, spans = Counter(), Counter(), Counter(), []
    for node, a, z in found:
        kind = node.kind()
        counts[kind] += 1
        spans.append((kind, a, z))
        nested.update(n.kind() for n in node.below())
        for n in (node, *node.below()):
            clauses.update(n.clauses)
    unsupported = sum(n for k, n in counts.items() if k not in SUPPORTED)
    total = sum(counts.values())
    status = "complete" if not errors and not unsupported else "partial"
    return {
        "statement_type_counts": dict(sorted(counts.items())), "nested_query_counts": dict(sorted(nested.items())), "clause_counts": dict(sorted(clauses.items())),
        "statement_count": total, "unsupported_count": unsupported, "error_count": len(errors),
        "errors": errors[:MAX_ERRORS], "errors_truncated": len(errors) > MAX_ERRORS, "status": status if total or not errors else "failed", "spans": spans,
    }
