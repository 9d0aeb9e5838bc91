"""Build files and configuration: Maven dependencies, TOML, Java Properties and a bounded HOCON."""

from __future__ import annotations

import re
import tomllib
from xml.etree import ElementTree

from . import ParseGap
from .structured import split_qname


def maven_dependencies(text: str) -> list[dict]:
    """Dependencies with where they are declared; profiles and plugins have contexts of their own."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise ParseGap("maven_pom_parse_failed", "POM was not parsed") from e
    out = []

    def text_of(node, name):
        for child in node:
            if split_qname(child.tag)[1] == name:
                return (child.text or "").strip() or None
        return None

    def visit(node, trail):
        name = split_qname(node.tag)[1]
        here = (*trail, name)
        if name == "dependency":
            managed, plugin, profile = "dependencyManagement" in trail, "plugin" in trail, "profile" in trail
            context = "plugin_dependency" if plugin else "dependency_management" if managed else "dependency"
            out.append({"declaration_context": ("profile_" if profile else "") + context, "group_id": text_of(node, "groupId"), "artifact_id": text_of(node, "artifactId"), "version_expression": text_of(node, "version"), "scope": text_of(node, "scope"), "type": text_of(node, "type"), "classifier": text_of(node, "classifier")})
            return
        for child in node:
            if isinstance(child.tag, str):
                visit(child, here)

    if split_qname(root.tag)[1] != "project":
        raise ParseGap("maven_pom_parse_failed", "root is not a project")
    visit(root, ())
    return out


def toml_items(text: str) -> list[tuple[str, object]]:
    """Dotted keys and values; lists stay whole values."""
    out = []

    def visit(node, path):
        for k, v in node.items():
            if isinstance(v, dict):
                visit(v, (*path, k))
            else:
                out.append((".".join((*path, k)), v))

    visit(tomllib.loads(text), ())
    return out


_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)
_NAMED = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}


def _unescape(s: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _NAMED.get(m[1], m[1]), s)


def properties_items(text: str) -> list[tuple[str, str]]:
    """Java Properties: continued lines, comments, = : or space as separator, escapes."""
    lines, held = [], None
    for raw in re.split(r"\r\n|\n|\r", text):
        line = raw.lstrip(" \t\f")
        if held is None and (not line or line[0] in "#!"):
            continue
        line = (held or "") + line
        held = None
        if (len(line) - len(line.rstrip("\\"))) % 2:
            held = line[:-1]
        else:
            lines.append(line)
    if held is not None:
        lines.append(held)
    out = []
    for line in lines:
        m = re.match(r"((?:\\.|[^=: \t\f\\])*)[ \t\f]*(?:[=:][ \t\f]*)?(.*)", line, re.S)
        out.append((_unescape(m[1]), _unescape(m[2])))
    return out


_HOCON = re.compile(r'\s*(?:(?P<comment>#[^\n]*|//[^\n]*)|(?P<triple>"""(?:.|\n)*?"""+)|(?P<string>"(?:\\.|[^"\\\n])*")|(?P<subst>\$\{\??[^}]*\})|(?P<sign>\+=|[{}\[\],:=])|(?P<plain>(?:(?!//)[^\s"#{}\[\],:=$+]|\+(?!=)|\$(?!\{))+))|(?P<bad>\s*\S)')
_PLACE = re.compile(r"[ \t]*(\n)?")


def hocon_items(text: str) -> list[tuple[str, object]]:
    """Dotted keys and a description of each value: a scalar, array, substitution or concatenation.

    Objects are entered, lists are one value. An include is an item whose key is where its keys belong and whose value names
    the file; it is not read here.
    """
    tokens, at = [], 0
    while at < len(text):
        m = _HOCON.match(text, at)
        if m is None:
            if text[at:].strip():
                raise ParseGap("config_parser_failed", "unreadable character")
            break
        kind = m.lastgroup
        if kind == "bad":
            raise ParseGap("config_parser_failed", "unreadable character")
        newline = "\n" in text[at : m.start(kind)]
        if kind != "comment":
            tokens.append((kind, m[kind], newline))
        at = m.end()
    tokens.append(("end", "", True))
    out, i = [], 0

    def peek():
        return tokens[i]

    def fail(why):
        raise ParseGap("config_parser_failed", why)

    def key():
        nonlocal i
        parts = []
        while peek()[0] in ("plain", "string") and (not parts or not peek()[2]):
            kind, value, _ = peek()
            parts += [value[1:-1]] if kind == "string" else [p for p in value.split(".") if p]
            i += 1
        return parts or fail("a key is missing")

    def included():
        """``include "x"``, ``include file("x")`` and such, also in ``required(...)``; None where include is a key."""
        nonlocal i
        at, how, required = i + 1, "heuristic", False
        while tokens[at][0] == "plain" and (m := re.fullmatch(r"(required\()?(?:(file|url|classpath)\()?", tokens[at][1])) and m[0]:
            how, required, at = m[2] or how, required or bool(m[1]), at + 1
        if tokens[at][0] != "string":
            return None
        target, at = tokens[at][1][1:-1], at + 1
        while tokens[at][0] == "plain" and set(tokens[at][1]) == {")"} and not tokens[at][2]:
            at += 1
        i = at
        return {"kind": "include", "target": target, "how": how, "required": required}

    def array():
        nonlocal i
        i += 1
        n = 0
        while peek()[1] != "]" or peek()[0] != "sign":
            if peek()[0] == "end":
                fail("unclosed list")
            if peek()[1] == "," and peek()[0] == "sign":
                i += 1
                continue
            value(None)
            n += 1
        i += 1
        return n

    def value(path):
        """Reads one value. Emits below ``path``; without a path (inside a list) nothing is emitted."""
        nonlocal i
        parts, first = [], True
        while True:
            kind, text_, newline = peek()
            if kind == "end" or newline and not first or kind == "sign" and text_ in ",}]":
                break
            first = False
            if kind == "sign" and text_ == "{":
                i += 1
                body(path)
                parts.append("object")
            elif kind == "sign" and text_ == "[":
                parts.append(f"array:{array()}")
            elif kind == "sign":
                fail("a value is missing")
            else:
                parts.append(("subst", text_) if kind == "subst" else ("text", text_.strip('"') if kind != "plain" else text_))
                i += 1
        if not parts:
            fail("a value is missing")
        if path and parts != ["object"]:
            plain = all(isinstance(p, tuple) and p[0] == "text" for p in parts)
            what = " ".join(p[1] for p in parts) if plain else {"kind": "substitution" if len(parts) == 1 and isinstance(parts[0], tuple) else "concatenation" if len(parts) > 1 else "array", "parts": [p if isinstance(p, str) else p[1] for p in parts]}
            out.append((".".join(path), what))

    def body(path, closing="}"):
        nonlocal i
        while True:
            kind, text_, _ = peek()
            if kind == "end":
                return None if closing is None else fail("unclosed object")
            if kind == "sign" and text_ == closing:
                i += 1
                return None
            if kind == "sign" and text_ == ",":
                i += 1
                continue
            if kind == "plain" and text_ == "include" and (target := included()):
                if path is not None:
                    out.append((".".join(path), target))
                continue
            parts = key()
            below = (*path, *parts) if path is not None else None
            kind, text_, _ = peek()
            if kind == "sign" and text_ in (":", "=", "+="):
                i += 1
                value(below)
            elif kind == "sign" and text_ == "{":
                value(below)
            else:
                fail("a separator is missing")

    if peek()[1] == "{" and peek()[0] == "sign":
        i += 1
        body(())
        if peek()[0] != "end":
            fail("text after the object")
    else:
        body((), None)
    return out


def config_items(extension: str, text: str) -> list[tuple[str, object]]:
    try:
        return {".properties": properties_items, ".toml": toml_items, ".conf": hocon_items}[extension](text)
    except ParseGap:
        raise
    except Exception as e:
        raise ParseGap("config_parser_failed", "configuration was not parsed", error_type=type(e).__name__) from e
