"""Java source: a tokenizer, a reader of declarations, and the facts that analyses take from them.

Declarations (types, fields, methods, enum constants) are read by structure; expressions are kept as token ranges, in
which calls, constructors and arguments are found. Comments and strings are tokens, so nothing inside them is seen.
Unbalanced brackets or unterminated literals are a gap, and the file gives no facts.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from . import ParseGap

_TOKEN = re.compile(
    r'(?P<space>\s+)|(?P<comment>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)|(?P<text>"""(?:\\.|[^\\])*?""")|(?P<string>"(?:\\.|[^"\\\n])*")|(?P<char>\'(?:\\.|[^\'\\\n])+\')'
    r"|(?P<number>\.?\d(?:[\w.]|(?<=[eEpP])[+-])*)|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<bad>[\"']|/\*)|(?P<sign>->|::|\.\.\.|[{}()\[\];,.@=<>?:&|+\-*/%!~^])",
    re.S,
)
_MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed", "non"}
_TYPE_WORDS = {"class", "interface", "enum", "record"}
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "synchronized", "return", "try", "throw", "assert", "do", "else", "case", "yield"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
# Route annotations and their methods; runtime sources exclude test trees.
ROUTES = {"Get": "GET", "Post": "POST", "Put": "PUT", "Delete": "DELETE", "Patch": "PATCH"}
HTTP_METHODS = {"GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "TRACE"}


@dataclass
class Tok:
    kind: str
    text: str
    line: int
    col: int


@dataclass
class Annotation:
    name: str
    args: list
    first: Tok
    last: Tok


@dataclass
class Member:
    kind: str  # field, method, constant
    name: str
    type: str
    modifiers: set
    annotations: list
    params: list = field(default_factory=list)  # (type, name, annotations)
    value: tuple | None = None  # token range
    body: tuple | None = None


@dataclass
class Type:
    kind: str
    name: str
    interfaces: list
    superclass: str | None
    annotations: list
    members: list = field(default_factory=list)
    types: list = field(default_factory=list)


def tokens(text: str) -> list[Tok]:
    out, stack, at, line, start = [], [], 0, 1, 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None or m.lastgroup == "bad":
            raise ParseGap("java_parse_failed", "unreadable token", line=line)
        kind, t = m.lastgroup, m[0]
        if kind not in ("space", "comment"):
            out.append(Tok("string" if kind == "text" else kind, t, line, at - start + 1))
            if kind == "sign" and t in _OPEN:
                stack.append(_OPEN[t])
            elif kind == "sign" and t in _CLOSE and (not stack or stack.pop() != t):
                raise ParseGap("java_parse_failed", "unbalanced bracket", line=line)
        if "\n" in t:
            line += t.count("\n")
            start = at + t.rindex("\n") + 1
        at = m.end()
    if stack:
        raise ParseGap("java_parse_failed", "unbalanced bracket", line=line)
    return out


class Reader:
    """Declarations over a token list."""

    def __init__(self, toks: list[Tok]):
        self.t, self.i = toks, 0
        self.match: dict[int, int] = {}
        stack = []
        for k, x in enumerate(toks):
            if x.kind == "sign" and x.text in _OPEN:
                stack.append(k)
            elif x.kind == "sign" and x.text in _CLOSE:
                self.match[stack.pop()] = k
        self.package, self.imports, self.types, self.annotations = None, [], [], []

    def at(self, k=None) -> str:
        k = self.i if k is None else k
        return self.t[k].text if 0 <= k < len(self.t) and self.t[k].kind in ("sign", "word") else ""

    def source(self, a: int, b: int) -> str:
        """Tokens a to b as text: a space only between two words."""
        out = []
        for k in range(a, b):
            if out and self.t[k].kind in ("word", "number") and self.t[k - 1].kind in ("word", "number"):
                out.append(" ")
            out.append(self.t[k].text)
        return "".join(out)

    def qualified(self) -> str:
        parts = [self.t[self.i].text]
        self.i += 1
        while self.at() == "." and self.i + 1 < len(self.t) and (self.t[self.i + 1].kind == "word" or self.at(self.i + 1) == "*"):
            parts.append(self.t[self.i + 1].text)
            self.i += 2
        return ".".join(parts)

    def split_args(self, a: int, b: int) -> list[tuple[int, int]]:
        """Ranges of the comma-separated parts between tokens a and b; type arguments don't split."""
        out, start, k = [], a, a
        while k < b:
            x = self.at(k)
            if x in _OPEN:
                k = self.match[k]
            elif x == "<" and (end := self.generic_end(k, b)):
                k = end
            elif x == ",":
                out.append((start, k))
                start = k + 1
            k += 1
        return [*out, (start, b)] if b > a else []

    def generic_end(self, k: int, b: int) -> int | None:
        """The closing > of type arguments that open at k, if that is what it is."""
        depth = 0
        while k < b:
            x = self.t[k]
            if x.text == "<":
                depth += 1
            elif x.text == ">":
                depth -= 1
                if depth == 0:
                    return k
            elif not (x.kind == "word" or x.text in (",", ".", "?", "&", "[", "]", "@")):
                return None
            k += 1
        return None

    def annotation(self) -> Annotation:
        first = self.t[self.i]
        self.i += 1
        name, args, last = self.qualified(), [], self.t[self.i - 1]
        if self.at() == "(":
            end = self.match[self.i]
            for pos, (a, b) in enumerate(self.split_args(self.i + 1, end), 1):
                named = self.t[a].kind == "word" and self.at(a + 1) == "=" and self.at(a + 2) != "="
                args.append((pos, self.t[a].text if named else None, a + 2 if named else a, b))
            last, self.i = self.t[end], end + 1
        found = Annotation(name, args, first, last)
        self.annotations.append(found)
        return found

    def modifiers(self) -> tuple[set, list]:
        words, notes = set(), []
        while True:
            if self.at() == "@" and self.at(self.i + 1) != "interface":
                notes.append(self.annotation())
            elif self.at() in _MODIFIERS and not (self.at() == "default" and self.at(self.i + 1) in (":", "->")):
                words.add(self.at())
                self.i += 1
                if self.at(self.i - 1) == "non" and self.at() == "-":
                    self.i += 2
            else:
                return words, notes

    def read(self) -> None:
        while self.i < len(self.t):
            words, notes = self.modifiers()
            if self.i >= len(self.t):
                break
            if self.at() == "package":
                self.i += 1
                tok = self.t[self.i]
                self.package = (self.qualified(), tok)
            elif self.at() == "import":
                self.i += 1
                static = self.at() == "static"
                self.i += static
                tok = self.t[self.i]
                self.imports.append((self.qualified(), static, tok))
            elif (kind := self.type_kind()) is not None:
                self.types.append(self.type(kind, notes))
            else:
                self.i = self.match.get(self.i, self.i) + 1

    def type_kind(self) -> str | None:
        if self.at() == "@" and self.at(self.i + 1) == "interface":
            return "annotation"
        if self.at() in _TYPE_WORDS and self.i + 1 < len(self.t) and self.t[self.i + 1].kind == "word" and (self.at() != "record" or self.at(self.i + 2) in ("(", "<")):
            return self.at()
        return None

    def type(self, kind: str, notes: list) -> Type:
        self.i += 2 if kind == "annotation" else 1
        out = Type(kind, self.t[self.i].text, [], None, notes)
        self.i += 1
        mode = None
        while self.i < len(self.t) and self.at() != "{":
            x = self.at()
            if x == "<":
                self.i = (self.generic_end(self.i, len(self.t)) or self.i) + 1
            elif x == "(":
                out.members += [Member("field", n, t, set(), a) for t, n, a in self.params(self.i)]
                self.i = self.match[self.i] + 1
            elif x in ("extends", "implements", "permits"):
                mode = x
                self.i += 1
            elif self.t[self.i].kind == "word" and mode:
                name = self.qualified()
                if mode == "extends" and kind == "class":
                    out.superclass = name
                elif mode != "permits":
                    out.interfaces.append(name)
            else:
                self.i += 1
        if self.i >= len(self.t):
            raise ParseGap("java_parse_failed", "a type has no body")
        end = self.match[self.i]
        self.i += 1
        if kind == "enum":
            self.constants(out, end)
        while self.i < end:
            self.member(out, end)
        self.i = end + 1
        return out

    def constants(self, out: Type, end: int) -> None:
        while self.i < end and self.at() != ";":
            _, notes = self.modifiers()
            if self.i >= end or self.t[self.i].kind != "word":
                self.i += 1
                continue
            c = Member("constant", self.t[self.i].text, out.name, set(), notes)
            self.i += 1
            if self.at() == "(":
                c.value = (self.i + 1, self.match[self.i])
                self.i = self.match[self.i] + 1
            if self.at() == "{":
                self.i = self.match[self.i] + 1
            out.members.append(c)
        self.i += self.at() == ";"

    def params(self, k: int) -> list:
        out, saved = [], self.i
        for a, b in self.split_args(k + 1, self.match[k]):
            self.i = a
            _, notes = self.modifiers()
            if b - self.i >= 2:
                out.append((self.source(self.i, b - 1), self.t[b - 1].text, notes))
        self.i = saved
        return out

    def member(self, out: Type, end: int) -> None:
        words, notes = self.modifiers()
        if self.i >= end:
            return
        if (kind := self.type_kind()) is not None:
            out.types.append(self.type(kind, notes))
            return
        if self.at() in (";", "{"):  # stray or initialiser
            self.i = self.match.get(self.i, self.i) + 1
            return
        if self.at() == "<":
            self.i = (self.generic_end(self.i, end) or self.i) + 1
        start = self.i
        while self.i < end and self.at() not in ("(", "=", ";", ",", "{"):
            self.i = ((self.generic_end(self.i, end) or self.i) if self.at() == "<" else self.match.get(self.i, self.i)) + 1
        if self.at() == "(":
            m = Member("method", self.t[self.i - 1].text, self.source(start, self.i - 1), words, notes, self.params(self.i))
            self.i = self.match[self.i] + 1
            while self.i < end and self.at() not in ("{", ";"):
                self.i += 1
            if self.at() == "{":
                m.body = (self.i + 1, self.match[self.i])
            self.i = self.match.get(self.i, self.i) + 1
            out.members.append(m)
            return
        kind_text = self.source(start, self.i - 1)
        name = self.t[self.i - 1].text if self.i > start else ""
        while self.i <= end:
            m = Member("field", name, kind_text, words, notes)
            if self.at() == "=":
                a = self.i = self.i + 1
                while self.i < end and self.at() not in (",", ";"):
                    self.i = ((self.generic_end(self.i, end) or self.i) if self.at() == "<" else self.match.get(self.i, self.i)) + 1
                m.value = (a, self.i)
            if name:
                out.members.append(m)
            if self.at() != ",":
                break
            self.i += 1
            name = self.t[self.i].text
            self.i += 1
        self.i += 1


def _fingerprint(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def literal(text: str) -> str | None:
    return text[1:-1] if len(text) >= 2 and text[0] == text[-1] == '"' and "\\" not in text else None


def _annotation_arg(r: Reader, pos, name, a, b) -> dict:
    out, text = {"position": pos, "name": name}, r.source(a, b)
    one = r.t[a] if b - a == 1 else None
    if one and one.kind in ("string", "char", "number"):
        return out | {"value_kind": "literal", "observed_value": {"literal_kind": one.kind, "lexeme": text}}
    if one and text in ("true", "false", "null"):
        return out | {"value_kind": "literal", "observed_value": {"literal_kind": "null" if text == "null" else "boolean", "lexeme": text}}
    if text.endswith(".class"):
        return out | {"value_kind": "class_literal", "observed_symbol": text[:-6]}
    kind = "array_initializer_expression" if text[:1] == "{" else "nested_annotation_expression" if text[:1] == "@" else "expression"
    return out | {"value_kind": kind, "expression_fingerprint": _fingerprint(text)}


def calls(r: Reader, a: int, b: int):
    """(kind, name, receiver, basis, argument ranges, token index) of the calls and constructors in a range."""
    for k in range(a, b):
        x = r.t[k]
        if x.kind != "word":
            continue
        if x.text == "new" and k + 1 < b and r.t[k + 1].kind == "word":
            r.i = k + 1
            name = r.qualified()
            j = r.i
            if r.at(j) == "<":
                j = (r.generic_end(j, b) or j) + 1
            if r.at(j) == "(":
                yield "constructor_invocation", name.rsplit(".", 1)[-1], None, "constructor_type", r.split_args(j + 1, r.match[j]), k
            continue
        if r.at(k + 1) != "(" or x.text in _NOT_CALLS or r.at(k - 1) in ("@", "new"):
            continue
        prev = k - 1
        if r.at(prev) == ">":  # explicit type arguments: a.<T>b()
            depth = 0
            while prev > a:
                depth += (r.at(prev) == ">") - (r.at(prev) == "<")
                prev -= 1
                if depth == 0:
                    break
        args = r.split_args(k + 2, r.match[k + 1])
        if r.at(prev) != ".":
            before = r.t[k - 1] if k > 0 else None
            if before is None or before.kind != "word" or before.text in ("return", "else", "throw", "case", "do", "yield"):
                inside = k >= 2 and r.at(k - 2) == "." and before and before.kind == "word" and before.text == "new"
                if not inside:
                    yield "invocation", x.text, None, "unqualified", args, k
            continue
        j, parts = prev - 1, []
        while j >= a and r.t[j].kind == "word":
            parts.append(r.t[j].text)
            if r.at(j - 1) != ".":
                break
            j -= 2
        lexical = j >= a and r.t[j].kind == "word" and bool(parts) and r.at(j - 1) != "new"
        yield "qualified_method_invocation", x.text, ".".join(reversed(parts)) if lexical else None, "lexical_receiver" if lexical else "expression", args, k


def expression(r: Reader, a: int, b: int, owner: str) -> list | None:
    """A string expression as parts: ["lit", text] or ["ref", class, name]; None for anything else."""
    parts, start, k = [], a, a
    while k <= b:
        if k == b or r.at(k) == "+":
            text = r.source(start, k)
            if literal(text) is not None:
                parts.append(["lit", literal(text)])
            elif re.fullmatch(r"[\w$]+(\.[\w$]+)*", text) and not text[0].isdigit():
                head, _, name = text.rpartition(".")
                parts.append(["ref", head.rpartition(".")[2] or owner, name])
            else:
                return None
            start = k + 1
        k = (r.match.get(k, k) if k < b else k) + 1
    return parts or None


def jdk_requests(r: Reader, m: Member):
    """Requests of the JDK client that a method builds in a variable and sends: method, path literal or getter chain.

    ``builder`` must be declared in the method from ``HttpRequest.newBuilder``, and ``send(builder.build(), ...)`` must stand in
    it; a builder that is never sent gives nothing.
    """
    found: dict[str, dict] = {}
    a, b = m.body
    for k in range(a, b):
        if r.t[k].kind == "word" and r.at(k + 1) == "=" and r.at(k + 2) == "HttpRequest" and r.at(k + 4) == "newBuilder":
            end = k
            while end < b and r.at(end) != ";":
                end = r.match.get(end, end) + 1
            found[r.t[k].text] = {"token": k, "method": None, "path": None, "suffix": None, "sent": False}
            _request_parts(r, found[r.t[k].text], k + 4, end)
    for kind, name, receiver, _, args, k in list(calls(r, a, b)):
        if receiver in found and name != "build":
            end = k
            while end < b and r.at(end) != ";":
                end = r.match.get(end, end) + 1
            _request_parts(r, found[receiver], k, end)
        elif name in ("send", "sendAsync") and args and (x := re.fullmatch(r"([\w$]+)\.build\(\)", r.source(*args[0]))) and x[1] in found:
            found[x[1]]["sent"] = True
    sent = [call for call in found.values() if call.pop("sent")]
    for call in sent:
        yield call | (_json_types(r, m) if len(sent) == 1 else {"request": None, "response": None})


def _json_types(r: Reader, m: Member) -> dict:
    """What a method writes and reads as JSON, each if it is one type: readValue(x, T.class), and the declared type of the
    variable in writeValueAsString(x)."""
    declared = {name: kind for kind, name, _ in m.params}
    a, b = m.body
    for k in range(a + 1, b - 1):
        if r.t[k - 1].kind == r.t[k].kind == "word" and r.at(k + 1) in ("=", ";") and r.at(k - 1)[:1].isupper():
            declared[r.t[k].text] = r.at(k - 1)
    made, read = set(), set()
    for _, name, _, _, args, _ in calls(r, a, b):
        texts = [r.source(*x) for x in args]
        if name in ("writeValueAsString", "writeValueAsBytes") and texts and texts[0] in declared:
            made.add(declared[texts[0]])
        if name == "readValue" and len(texts) > 1 and texts[1].endswith(".class"):
            read.add(texts[1][:-6])
    return {"request": made.pop() if len(made) == 1 else None, "response": read.pop() if len(read) == 1 else None}


def _request_parts(r: Reader, call: dict, a: int, b: int) -> None:
    """Method and address from a builder's chained calls in a token range."""
    k = a
    while k < b:
        name, opens = r.t[k].text if r.t[k].kind == "word" else "", r.at(k + 1) == "("
        if opens and name in HTTP_METHODS:
            call["method"] = name
        elif opens and name == "method":
            call["method"] = next((v for x in r.split_args(k + 2, r.match[k + 1])[:1] if (v := literal(r.source(*x))) in HTTP_METHODS), call["method"])
        elif opens and name in ("uri", "newBuilder") and r.match[k + 1] > k + 2:
            inner = r.source(k + 2, r.match[k + 1])
            text = re.fullmatch(r'URI\.create\((?:[\w$.]+(?:\(\))?\+)*("[^"\\]*")\)', inner)
            chain = re.findall(r"\.get([A-Z]\w*)\(\)", inner)
            if text:
                call["path"] = text[1]
            elif chain:
                call["suffix"] = ".".join(x[0].lower() + x[1:] for x in chain)
        k = r.match[k + 1] + 1 if opens else k + 1
    call["method"] = call["method"] or "GET"


def facts(text: str):
    """(section, kind, label, descriptor, {count, span, extra}) of a source."""
    r = Reader(tokens(text))
    r.read()
    span = lambda x, y=None: (x.line, (y or x).line, x.col, (y or x).col + len((y or x).text))
    out = []

    def put(section, kind, label, descriptor, tok=None, last=None, extra=None):
        out.append((section, kind, label, descriptor, {"span": span(tok, last) if tok else None, "extra": extra}))

    names = [("package_declaration", *r.package[:1], False, r.package[1])] if r.package else []
    for kind, ns, static, tok in [*names, *(("import_declaration", *x) for x in r.imports)]:
        put("import_namespaces", "import_namespace_observation", ns, {"language": "java", "observation_kind": kind, "namespace": ns, "is_static": static, "is_wildcard": ns.endswith(".*")}, tok)

    def fact(kind, tok=None, **values):
        put("java_facts", kind, values.get("name") or kind, {}, tok, extra=values)

    def types(items, outer=()):
        for t in items:
            yield t
            yield from types(t.types)

    every = list(types(r.types))
    bodies = []
    for t in every:
        fields = []
        for m in t.members:
            if m.kind == "field" and "static" not in m.modifiers:
                plain = m.type.rsplit(".", 1)[-1] if "<" not in m.type else m.type.split("<")[0].rsplit(".", 1)[-1]
                fields.append({"name": m.name, "type": m.type, "final": "final" in m.modifiers, "collection": "array" if m.type.endswith("[]") or plain in ("List", "Set", "Collection", "Iterable", "ArrayList", "LinkedList", "HashSet") else "scalar"})
            if m.kind == "field" and {"static", "final"} <= m.modifiers and m.type in ("String", "java.lang.String") and m.value:
                if (e := expression(r, *m.value, t.name)) is not None:
                    fact("string_constant", name=m.name, owner=t.name, expression=e)
            if m.kind == "constant":
                args = [r.source(*x) for x in r.split_args(*m.value)] if m.value else []
                fact("enum_constant", name=m.name, owner=t.name, arguments=args)
            for note in m.annotations:
                simple = note.name.rsplit(".", 1)[-1]
                if simple == "Value" and note.args and m.kind == "field" and (key := _property_key(r.source(*note.args[0][2:]))):
                    fact("value_binding", note.first, name=m.name, property_key=key)
                if simple.removesuffix("Mapping") in ROUTES and note.args and m.kind == "method" and (e := expression(r, *note.args[0][2:], t.name)) is not None:
                    fact("route", note.first, name=m.name, owner=t.name, interfaces=[x.rsplit(".", 1)[-1] for x in t.interfaces], method=ROUTES[simple.removesuffix("Mapping")], expression=e)
                if simple == "KafkaListener" and m.kind == "method":
                    topics = next((r.source(a, b) for _, n, a, b in note.args if n == "topics"), None)
                    payloads = [r.source(*args[1])[:-6] for _, n, _, _, args, _ in calls(r, *(m.body or (0, 0))) if n == "deserialize" and len(args) >= 2 and r.source(*args[1]).endswith(".class")]
                    fact("kafka_listener", note.first, name=m.name, owner=t.name, topics=literal(topics.strip("{}")) if topics else None, payloads=payloads)
            for kind, name, notes in m.params:
                for note in notes:
                    if note.name.rsplit(".", 1)[-1] == "Value" and note.args and (key := _property_key(r.source(*note.args[0][2:]))):
                        fact("value_binding", note.first, name=name, property_key=key)
            if m.body:
                bodies.append((t, m))
        if t.kind == "enum":
            for m in (m for m in t.members if m.kind == "method" and m.body):
                used = {r.t[k].text for k in range(*m.body)} & {f["name"] for f in fields}
                if len(used) == 1:
                    fact("enum_accessor", name=m.name, owner=t.name, field=used.pop())
        if t.kind in ("class", "record", "enum"):
            fact("class_fields", name=t.name, fields=fields, type_kind=t.kind, superclass=t.superclass, annotations=[x.name.rsplit(".", 1)[-1] for x in t.annotations])
    for note in r.annotations:
        args = [_annotation_arg(r, *x) for x in note.args]
        put("annotations", "annotation_observation", note.name.rsplit(".", 1)[-1], {"language": "java", "annotation_name": note.name, "simple_name": note.name.rsplit(".", 1)[-1], "argument_count": len(args), "arguments": args}, note.first, note.last)
    for _, m in bodies:
        for call in jdk_requests(r, m):
            fact("jdk_http", r.t[call.pop("token")], name=m.name, **call)
    in_body = {}
    for n, (_, m) in enumerate(bodies):
        for k in range(*m.body):
            in_body[k] = n
    inits = [m.value for t in every for m in t.members if m.kind == "field" and m.value]
    templates = {(t.name, m.name) for t in every for m in t.members if m.kind == "field" and m.type.split("<")[0].rsplit(".", 1)[-1] == "KafkaTemplate"}
    transactions = []  # (lambda's variable, its tokens): sends on it are sends of the template
    for a, b in [*(m.body for _, m in bodies), *inits]:
        for kind, name, receiver, basis, args, k in calls(r, a, b):
            tok = r.t[k]
            if kind != "invocation":
                put("api_calls", "api_call_observation", name, {"language": "java", "call_kind": kind, "callable_name": name, "receiver_identity": receiver, "receiver_basis": basis, "argument_count": len(args)}, tok)
            if kind == "constructor_invocation" or k not in in_body:
                continue
            t, m = bodies[in_body[k]]
            texts = [r.source(*x) for x in args]
            declared = {n: ty for ty, n, _ in m.params}
            if name == "super" and t.superclass:
                for x in texts:
                    if ref := re.fullmatch(r"(?:[\w$]+\.)*([\w$]+)\.([A-Z][\w$]*)", x):
                        fact("super_enum_ref", tok, name=ref[2], owner=t.name, enum=ref[1])
            elif name == "exchange" and len(args) >= 2 and basis == "lexical_receiver" and "template" in (receiver or "").lower():
                verb = next((x.rsplit(".", 1)[-1] for x in texts[1:2] if x.rsplit(".", 1)[-1] in HTTP_METHODS), None)
                response = next((x[:-6] for x in texts if x.endswith(".class")), None)
                fact("exchange", tok, name=m.name, method=verb, path=texts[0], response=response, body_type=declared.get(texts[2]) if len(texts) > 2 else None, parameter=[n for _, n, _ in m.params].index(texts[0]) if texts[0] in declared else None, parameters=len(m.params))
            elif name == "executeInTransaction" and args and (x := re.match(r"\(?([\w$]+)\)?->", texts[0])):
                transactions.append((x[1], *args[0]))
            elif name == "send" and basis == "lexical_receiver" and args and ("kafka" in receiver.lower() or (t.name, receiver) in templates or any(v == receiver and i <= k < j for v, i, j in transactions)):
                inner = next((c for c in calls(r, *args[0]) if c[1] == "ProducerRecord"), None)
                use = [r.source(*x) for x in inner[4]] if inner else texts
                topic = expression(r, *(inner[4] if inner else args)[0], t.name) if use else None
                last = use[-1] if len(use) > 1 else None
                fact("kafka_publish", tok, name=m.name, owner=t.name, topic=use[0] if use else None, topic_expression=topic, payload=declared.get(last, last) if last else None)
            elif name == "annotatedService" and len(args) >= 2 and (e := expression(r, *args[0], t.name)) is not None and texts[1] in declared:
                fact("registration", tok, name=texts[1], service_type=declared[texts[1]].rsplit(".", 1)[-1], expression=e)
            else:
                fact("invocation", tok, name=name, arguments=texts)
    return out


def _property_key(text: str) -> str | None:
    value = literal(text)
    m = re.fullmatch(r"\$\{([^:${}]+)\}", value or "")
    return m[1].strip() or None if m else None
