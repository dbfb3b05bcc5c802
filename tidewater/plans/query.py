"""The query language: terms, field:term, AND (also by adjacency), OR, parentheses."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tidewater.errors import InvalidArgument
from tidewater.functions.analysis import analyze
from tidewater.plans.schema import Schema


@dataclass(frozen=True)
class Term:
    field: str
    text: str

    def __str__(self) -> str:
        return f"{self.field}:{self.text}"


@dataclass(frozen=True)
class And:
    children: tuple

    def __str__(self) -> str:
        return "(" + " AND ".join(map(str, self.children)) + ")"


@dataclass(frozen=True)
class Or:
    children: tuple

    def __str__(self) -> str:
        return "(" + " OR ".join(map(str, self.children)) + ")"


@dataclass(frozen=True)
class MatchAll:
    def __str__(self) -> str:
        return "*"


Query = Term | And | Or | MatchAll
_BLANK = re.compile(r"[ \t\n\r]*")
_WORD = re.compile(r'"([^"]*)"?|([A-Za-z0-9_.\-]+)')
_KEYWORD = {k: re.compile(k + r"(?![A-Za-z0-9_.\-])") for k in ("AND", "OR")}


class _Reader:
    """A cursor over the string. Rules return nodes; the cursor only moves back where AND turns out to join nothing."""

    def __init__(self, text: str, field: str):
        self.text, self.field, self.at = text, field, 0

    def fail(self, what: str):
        at = len(self.text[: self.at].encode())
        raise InvalidArgument(f"query parse error at offset {at}: {what}")

    def peek(self) -> str:
        self.at = _BLANK.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def keyword(self, name: str) -> bool:
        self.peek()
        m = _KEYWORD[name].match(self.text, self.at)
        if m:
            self.at = m.end()
        return m is not None

    def word(self) -> str:
        self.peek()
        m = _WORD.match(self.text, self.at)
        if m is None:
            return ""
        self.at = m.end()
        return m[1] if m[2] is None else m[2]

    def either(self) -> Query:
        found = [self.both()]
        while self.keyword("OR"):
            found.append(self.both())
        return found[0] if len(found) == 1 else Or(tuple(found))

    def both(self) -> Query:
        found = [self.atom()]
        while True:
            start = self.at
            self.keyword("AND")
            stop = self.peek() in ("", ")")
            if not stop:
                here = self.at
                stop = self.keyword("OR")
                self.at = here
            if stop:
                self.at = start
                return found[0] if len(found) == 1 else And(tuple(found))
            found.append(self.atom())

    def atom(self) -> Query:
        if self.peek() == "(":
            self.at += 1
            inner = self.either()
            if self.peek() != ")":
                self.fail("expected ')'")
            self.at += 1
            return inner
        first = self.word()
        if not first:
            self.fail("expected term")
        if self.peek() != ":":
            return Term(self.field, first)
        self.at += 1
        value = self.word()
        if not value:
            self.fail("expected term after ':'")
        return Term(first, value)


def parse(text: str, default_field: str) -> Query:
    """The syntax tree. An empty string matches all documents; what can't be read raises InvalidArgument with the byte offset."""
    r = _Reader(text, default_field)
    if not r.peek():
        return MatchAll()
    out = r.either()
    if r.peek():
        r.fail("trailing characters")
    return out


def term_tokens(term: Term, schema: Schema) -> list[str]:
    """A term's text by the analyzer of its field; an unknown field's is the standard one."""
    mapping = schema.get(term.field)
    return analyze(term.text, mapping.analyzed_by if mapping else "standard")


def leaves(query: Query, schema: Schema) -> list[tuple[str, str]]:
    """(field, token) of all terms from left to right, repeated ones repeated."""
    if isinstance(query, Term):
        return [(query.field, t) for t in term_tokens(query, schema)]
    return [leaf for c in getattr(query, "children", ()) for leaf in leaves(c, schema)]


def dnf(query: Query, schema: Schema, bit: dict[tuple[str, str], int], limit: int = 4096) -> list[int] | None:
    """Masks of leaves of which one must match whole: no NOT, so each query is an OR of ANDs. None beyond limit masks."""
    if isinstance(query, Term):
        own = [bit[query.field, t] for t in term_tokens(query, schema)]
        return [sum(1 << b for b in set(own))] if own and schema.has(query.field) else []
    parts = [dnf(c, schema, bit, limit) for c in query.children]
    if any(p is None for p in parts):
        return None
    if isinstance(query, Or):
        masks = {m for p in parts for m in p}
    else:
        masks = {0}
        for p in parts:
            masks = {a | b for a in masks for b in p}
            if len(masks) > limit:
                return None
    return sorted(m for m in masks if not any(o != m and o & m == o for o in masks)) if len(masks) < 200 else sorted(masks)
