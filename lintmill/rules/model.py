"""A parsed script as the checks see it."""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from lintmill.syntax import lexer as L
from lintmill.syntax.parser import Node, ParseError, Parser, batches


TOO_DEEP = "nested too deeply"


@dataclass
class Finding:
    rule: str
    start: int
    end: int
    message: str
    edits: list[tuple[int, int, str]] | None = None
    severity: int | None = None


class Batch:
    """One batch: significant lexemes, kinds, their offsets, the tree (None if it doesn't parse)."""

    def __init__(self, script: "Script", toks: list[str], kinds: list[str], at: list[int]):
        self.script, self.t, self.k, self.at = script, toks, kinds, at
        self.root: Node | None = None
        self.error: tuple[int, str] | None = None
        self.nodes: list[Node] = []
        try:
            self.root = Parser(toks, list(kinds)).script()
        except ParseError as e:
            i = min(e.at, len(toks) - 1)
            self.error = (i, e.message)
        except RecursionError:
            self.error = (0, TOO_DEEP)
        if self.root is not None:
            order = []
            stack = [self.root]
            while stack:
                n = stack.pop()
                order.append(n)
                for kid in n.kids():
                    kid.up = n
                stack.extend(reversed(list(n.kids())))
            self.nodes = order

    # text of things
    def start(self, i: int) -> int:
        return self.at[i]

    def end(self, i: int) -> int:
        return self.at[i] + len(self.t[i])

    def text(self, n: Node) -> str:
        return self.script.text[self.at[n.a] : self.end(n.b)]

    def name(self, n: Node | None) -> str:
        """Name of an identifier node without quotes."""
        return unquote(self.t[n.a]) if n is not None else ""

    def parts(self, n: Node | None) -> list[str]:
        return [self.name(p) if p is not None else "" for p in (n.parts or [])] if n is not None else []

    def of(self, type_: str) -> Iterator[Node]:
        return (n for n in self.nodes if n.type == type_)

    def signature(self, n: Node) -> str:
        return " ".join(x if k in ("STR",) else x.lower() for x, k in zip(self.t[n.a : n.b + 1], self.k[n.a : n.b + 1]))

    def is_word(self, i: int, *words: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].upper() in words


class Script:
    def __init__(self, path: str | None, text: str, compat: int = 150):
        self.path, self.text, self.compat = path or "", text, compat
        self.lexemes, self.open = L.split(text)
        self.offsets: list[int] = []
        at = 0
        for x in self.lexemes:
            self.offsets.append(at)
            at += len(x)
        self.batches: list[Batch] = []
        if len(text) and sys.getrecursionlimit() < 6000:
            sys.setrecursionlimit(6000)
        for first, _, toks, kinds in batches(self.lexemes):
            where, i = [], first
            for t in toks:
                while self.lexemes[i] is not t:
                    i += 1
                where.append(self.offsets[i])
                i += 1
            self.batches.append(Batch(self, toks, kinds, where))
        self.lines = L.line_starts(text)

    @property
    def parsed(self) -> bool:
        return not self.open and all(b.error is None for b in self.batches)

    def statements(self) -> Iterator[tuple[Batch, Node]]:
        """Batch-level statements in order."""
        for b in self.batches:
            if b.root is not None:
                for s in b.root.body:
                    yield b, s

    def position(self, offset: int) -> tuple[int, int]:
        """Zero-based line and UTF-16 column."""
        line = bisect_right(self.lines, offset) - 1
        return line, L.utf16_len(self.text[self.lines[line] : offset])


def unquote(tok: str) -> str:
    c = tok[:1]
    if c == "[":
        return tok[1:-1].replace("]]", "]")
    if c == '"':
        return tok[1:-1].replace('""', '"')
    return tok


def string_value(tok: str) -> str:
    """Content of a string literal."""
    start = 2 if tok[:1] in "nN" else 1
    return tok[start:-1].replace("''", "'")


# -- context ----------------------------------------------------------------


def ancestors(n: Node) -> Iterator[tuple[Node, Node]]:
    """(ancestor, the child that leads down to n) from the inside out."""
    while n.up is not None:
        yield n.up, n
        n = n.up


def in_predicate(n: Node) -> bool:
    """Whether n lies below a WHERE, HAVING or ON condition."""
    return any(p.type in ("where", "having") or (p.type == "join" and p.d.get("on") is c) for p, c in ancestors(n))


def flatten(refs: list[Node] | None) -> Iterator[Node]:
    """Leaf table references of a FROM list."""
    for r in refs or []:
        if r.type == "join":
            yield from flatten([r.left, r.right])
        elif r.type == "join_paren":
            yield from flatten([r.source])
        elif r.type == "pivot" and r.alias is None:
            yield from flatten([r.d["source"]])
        else:
            yield r


def joins(refs: list[Node] | None) -> Iterator[Node]:
    for r in refs or []:
        if r.type == "join":
            yield from joins([r.left])
            yield from joins([r.right])
            yield r
        elif r.type == "join_paren":
            yield from joins([r.source])


def ref_name(b: Batch, r: Node) -> str | None:
    """Alias, else the table's own name."""
    if r.alias is not None:
        return b.name(r.alias)
    if r.type in ("table", "function_table"):
        return b.parts(r.d["name"])[-1]
    if r.type == "variable_table":
        return b.t[r.a]
    return None


def own_nodes(n: Node, stop: tuple = ("select", "subquery", "derived_table")) -> Iterator[Node]:
    """Descendants without those inside nested queries."""
    stack = list(n.kids())
    while stack:
        x = stack.pop(0)
        if x.type in stop:
            continue
        yield x
        stack[:0] = list(x.kids())


def output_name(b: Batch, item: Node) -> str | None:
    """Name of a select item: alias, else the last part of a column."""
    if item.type != "select_item":
        return None
    if item.alias is not None:
        t = b.t[item.alias.a]
        return string_value(t) if t[-1:] == "'" else unquote(t)
    if item.expr.type == "column":
        return b.parts(item.expr)[-1]
    return None
