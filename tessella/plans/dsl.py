"""Pipeline language: text to statements to a lazy DataFrame.

A program is a sequence of statements, one keyword each: FROM, LOAD, MATCH,
WHERE, FILTER, TRAVERSE, SUMMARIZE, INFER, CORRELATE WITH, SIMILAR TO, CLASSIFY
AS, TIMELINE, SORT BY, LIMIT, STORE AS, EXPORT. Keywords may be in upper, lower
or title case, ``#`` begins a comment, the words WITH, TO, AS and BY may be left
out, and a bare name opens a source. Statements apply in their order to the
current pipeline; every FROM or LOAD starts a new one, and a program's result is
the last. Optimising is Catalyst's part: statements only declare.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

KEYWORDS = ["FROM", "LOAD", "MATCH", "WHERE", "FILTER", "TRAVERSE", "DEPTH", "SUMMARIZE", "INFER", "CORRELATE", "WITH", "SIMILAR", "TO", "CLASSIFY", "AS", "TIMELINE", "SORT", "BY", "ASC", "DESC", "LIMIT", "STORE", "EXPORT", "AND", "OR", "NOT", "TRUE", "FALSE", "NULL"]
_FORMS = {form: k for k in KEYWORDS for form in (k, k.lower(), k.title())}
_TOKEN = re.compile(r"""(?P<space>[ \t\r]+|\#[^\n]*)|(?P<newline>\n)|(?P<number>\d+(?:\.\d+)?)|(?P<text>"(?:[^"\\\n]|\\.)*"|'[^'\n]*')|(?P<op>==|!=|>=|<=|>|<|\(|\))|(?P<name>[A-Za-z_][A-Za-z0-9_.]*)""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}


class SyntaxProblem(ValueError):
    """A program that cannot be read, with its line and column."""


@dataclass(frozen=True)
class Token:
    kind: str
    value: object
    line: int
    column: int


@dataclass(frozen=True)
class Name:
    """A name of a field or source, as against a literal text."""

    text: str


@dataclass(frozen=True)
class Compare:
    left: object
    op: str
    right: object


@dataclass(frozen=True)
class Junction:
    """AND or OR of conditions."""

    op: str
    parts: tuple


@dataclass(frozen=True)
class Negation:
    part: object


@dataclass(frozen=True)
class Statement:
    verb: str
    args: dict = field(default_factory=dict, hash=False)


def tokenize(program: str) -> list[Token]:
    tokens, at, line, start = [], 0, 1, 0
    while at < len(program):
        m = _TOKEN.match(program, at)
        if not m:
            raise SyntaxProblem(f"line {line}, column {at - start + 1}: unexpected {program[at]!r}")
        kind, raw = m.lastgroup, m[0]
        here = Token(kind, raw, line, at - start + 1)
        at = m.end()
        if kind == "newline":
            line, start = line + 1, at
            tokens.append(here)
        elif kind == "number":
            tokens.append(Token(kind, float(raw) if "." in raw else int(raw), here.line, here.column))
        elif kind == "text":
            value = raw[1:-1] if raw[0] == "'" else re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), raw[1:-1])
            tokens.append(Token(kind, value, here.line, here.column))
        elif kind == "name" and raw in _FORMS:
            tokens.append(Token("keyword", _FORMS[raw], here.line, here.column))
        elif kind != "space":
            tokens.append(here)
    return tokens


class Parser:
    """Recursive descent over the tokens of a program."""

    def __init__(self, program: str):
        self.tokens = tokenize(program)
        self.at = 0

    def parse(self) -> list[Statement]:
        out = []
        while self._skip_lines():
            out.append(self._statement())
        return out

    def _skip_lines(self) -> bool:
        while self.at < len(self.tokens) and self.tokens[self.at].kind == "newline":
            self.at += 1
        return self.at < len(self.tokens)

    def _peek(self) -> Token | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def _fail(self, wanted: str) -> SyntaxProblem:
        t = self._peek()
        return SyntaxProblem(f"line {t.line}, column {t.column}: expected {wanted}, found {t.value!r}" if t else f"expected {wanted} at the end")

    def _take(self, *keywords: str) -> bool:
        t = self._peek()
        if t and t.kind == "keyword" and t.value in keywords:
            self.at += 1
            return True
        return False

    def _value(self, wanted: str = "a value") -> object:
        t = self._peek()
        if t and t.kind in ("text", "number", "name"):
            self.at += 1
            return Name(t.value) if t.kind == "name" else t.value
        if t and t.kind == "keyword" and t.value in ("TRUE", "FALSE", "NULL"):
            self.at += 1
            return {"TRUE": True, "FALSE": False, "NULL": None}[t.value]
        raise self._fail(wanted)

    def _string(self, wanted: str) -> str:
        value = self._value(wanted)
        return value.text if isinstance(value, Name) else str(value)

    def _ends(self) -> bool:
        t = self._peek()
        return t is None or t.kind == "newline"

    def _statement(self) -> Statement:
        t = self._peek()
        if t.kind == "name":
            return Statement("from", {"source": self._string("a source")})
        if t.kind != "keyword":
            raise self._fail("a statement")
        self.at += 1
        verb = t.value
        if verb in ("FROM", "LOAD"):
            return Statement("from", {"source": self._string("a source")})
        if verb in ("MATCH", "WHERE", "FILTER"):
            return Statement("where", {"condition": self._or()})
        if verb == "TRAVERSE":
            relation = self._string("a relation")
            depth = 1
            if self._take("DEPTH"):
                depth = self._value("a depth")
                if not isinstance(depth, int):
                    raise self._fail("a whole depth")
            return Statement("traverse", {"relation": relation, "depth": depth})
        if verb == "SUMMARIZE":
            return Statement("summarize")
        if verb == "INFER":
            return Statement("infer", {"rule": self._string("a rule")})
        if verb in ("CORRELATE", "SIMILAR", "CLASSIFY", "STORE"):
            self._take("WITH", "TO", "AS")
            return Statement(verb.lower(), {"target": self._string("a name or text")})
        if verb == "TIMELINE":
            args = {}
            for word, key in (("FROM", "start"), ("TO", "end")):
                if self._take(word):
                    args[key] = self._string("a time")
            return Statement("timeline", args)
        if verb == "SORT":
            self._take("BY")
            by = self._string("a field")
            descending = self._take("DESC")
            if not descending:
                self._take("ASC")
            return Statement("sort", {"by": by, "descending": descending})
        if verb == "LIMIT":
            n = self._value("a number of rows")
            if not isinstance(n, int) or isinstance(n, bool):
                raise SyntaxProblem(f"line {t.line}: LIMIT takes a whole number")
            return Statement("limit", {"n": n})
        if verb == "EXPORT":
            self._take("AS", "TO")
            return Statement("export", {"format": self._string("a format")})
        self.at -= 1
        raise self._fail("a statement")

    def _or(self) -> object:
        parts = [self._and()]
        while self._take("OR"):
            parts.append(self._and())
        return parts[0] if len(parts) == 1 else Junction("OR", tuple(parts))

    def _and(self) -> object:
        parts = [self._not()]
        while self._take("AND"):
            parts.append(self._not())
        return parts[0] if len(parts) == 1 else Junction("AND", tuple(parts))

    def _not(self) -> object:
        if self._take("NOT"):
            return Negation(self._not())
        t = self._peek()
        if t and t.kind == "op" and t.value == "(":
            self.at += 1
            inner = self._or()
            t = self._peek()
            if not t or t.value != ")":
                raise self._fail("a closing parenthesis")
            self.at += 1
            return inner
        left = self._value()
        t = self._peek()
        if t and t.kind == "op" and t.value not in "()":
            self.at += 1
            return Compare(left, t.value, self._value())
        return None  # a value alone lets all rows pass


def parse(program: str) -> list[Statement]:
    """The statements of a program."""
    return Parser(program).parse()
