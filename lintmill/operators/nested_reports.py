"""Deeply nested JSON reports as flat linked tables (problem 5).

Method.  Each payload is traversed once depth first.  Every object node gets an interval label, its
pre-order and post-order number in the document: a node lies inside another iff its interval lies
inside the other's.  Nodes go to one table per type (results, files, diagnostics, ranges, data,
related places, tags), each row with its interval, its ordinal in its parent's list and its members
as columns.  Parent links follow from interval containment: in pre-order, the intervals that are
still open at a node form a stack, and the innermost of them is its parent.  A document is at hand
as a whole in the row that brings it, so links are found in the batch that labels it; only rows of
the type asked for leave it and nothing is shuffled.

Member names are compared without letter case and punctuation.  A report may be wrapped in objects
or lists of one, or in strings that hold JSON, at any depth; an object stands for a list of one; null
elements keep their position and give no row.  Nesting has no bound: what is too deep for the
standard parser is read and written by one with an explicit stack.

Defined results: a null, blank or broken-off payload is incomplete: it gives one result row
with ``complete = false`` and no other; equal rows are traversed alike and each stays, told apart by
``copy``; members of an unexpected type are kept as JSON text; members without a column are kept
as JSON in ``more``; without rows all tables are empty; further columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from json.decoder import scanstring

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill.arrow import map_lists

#: Type of the nodes found below a member, by parent type and member name.
_CHILD = {
    ("result", "files"): "file",
    ("file", "diagnostics"): "diagnostic",
    ("diagnostic", "range"): "range",
    ("diagnostic", "data"): "data",
    ("diagnostic", "tags"): "tag",
    ("data", "related"): "related",
    ("diagnostic", "related"): "related",
    ("related", "range"): "range",
    ("related", "data"): "data",
    ("related", "related"): "related",
}
#: Members with a column of their own, by type; all others are in ``more``.
_COLUMNS = {
    "result": ("tool", "version", "command"),
    "file": ("filepath",),
    "diagnostic": ("code", "message", "severity", "source"),
    "range": (),
    "data": ("ruleid", "category", "fixable", "codedescriptionhref"),
    "related": ("filepath", "message"),
    "tag": (),
}
_SNAKE = {"filepath": "file_path", "ruleid": "rule_id", "codedescriptionhref": "code_description_href"}
_PLACES = ("start_line", "start_character", "end_line", "end_character")
_SIGNS = re.compile(r"[^a-z0-9]")
_SPACE = " \t\r\n﻿"


@lru_cache(maxsize=10_000)
def _plain(name: str) -> str:
    return _SIGNS.sub("", name.lower())


# -- JSON of any depth --------------------------------------------------------------

_SKIP = re.compile(r"[ \t\r\n]*")
_ATOM = re.compile(r"true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")


def _no_constant(name: str):
    raise ValueError(name)


def _loads_deep(s: str):
    """As ``json.loads``, with an explicit stack."""
    root: list = []
    stack: list = [root]
    key: str | None = None
    at = _SKIP.match(s).end()
    value = True  # whether a value may come next
    while True:
        c = s[at : at + 1]
        box = stack[-1]
        if value and c and c in '{["' or value and _ATOM.match(s, at):
            if box.__class__ is dict and key is None:
                if c != '"':
                    raise ValueError(f"name expected at {at}")
                key, at = scanstring(s, at + 1)
                at = _SKIP.match(s, at).end()
                if s[at : at + 1] != ":":
                    raise ValueError(f"':' expected at {at}")
                at = _SKIP.match(s, at + 1).end()
                continue
            if c in "{[":
                x, at = ({} if c == "{" else []), at + 1
            elif c == '"':
                x, at = scanstring(s, at + 1)
            else:
                m = _ATOM.match(s, at)
                x, at = json.loads(m.group()), m.end()
            if box.__class__ is dict:
                box[key], key = x, None
            else:
                box.append(x)
            if c and c in "{[":
                stack.append(x)
            else:
                value = False
        elif c and c in "}]" and len(stack) > 1 and (c == "}") == (box.__class__ is dict) and key is None and (not value or not box):
            stack.pop()
            at += 1
            value = False
        elif c == "," and not value and len(stack) > 1:
            at += 1
            value = True
            if s[_SKIP.match(s, at).end() :][:1] in ("}", "]"):
                raise ValueError(f"value expected at {at}")
        else:
            raise ValueError(f"unexpected text at {at}")
        at = _SKIP.match(s, at).end()
        if len(stack) == 1 and root:
            if at < len(s):
                raise ValueError(f"extra text at {at}")
            return root[0]


def loads(s: str):
    """The value of a JSON text of any depth; ValueError if it is none."""
    try:
        return json.loads(s, parse_constant=_no_constant)
    except RecursionError:
        return _loads_deep(s)


def dumps(v) -> str:
    """JSON text of a value of any depth."""
    try:
        return json.dumps(v, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    stack: list = [v]
    while stack:
        x = stack.pop()
        if x.__class__ is tuple:  # text that is ready
            out.append(x[0])
        elif isinstance(x, (dict, list)):
            items = [((dumps(k) + ": ",), y) for k, y in x.items()] if isinstance(x, dict) else [((" ",), y) for y in x]
            ends = "{}" if isinstance(x, dict) else "[]"
            out.append(ends[0])
            stack.append((ends[1],))
            for k, (name, y) in reversed(list(enumerate(items))):
                stack.append(y)
                if isinstance(x, dict):
                    stack.append(name)
                if k:
                    stack.append((", ",))
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def _text(v) -> str | None:
    return v if v is None or v.__class__ is str else dumps(v)


def _decoded(v):
    """A value without the strings of JSON around it; ValueError if one is no JSON."""
    while isinstance(v, str):
        v = loads(v.strip(_SPACE))
    return v


def _members(o: dict) -> dict:
    out = {}
    for k, v in o.items():
        n = _plain(k)
        if out.get(n) is None:
            out[n] = v
    return out


def find_report(payload: str | None) -> dict | None:
    """The members of the report of a payload: the first object with files in it, else the outermost; None if incomplete."""
    if payload is None:
        return None
    try:
        v = _decoded(payload)
    except ValueError:
        return None
    first = None
    stack = [v]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            if x.lstrip(_SPACE)[:1] not in ("{", "[", '"'):
                continue
            try:
                x = _decoded(x)
            except ValueError:
                continue
        if isinstance(x, list):
            stack += x if len(x) == 1 else []
        elif isinstance(x, dict):
            low = _members(x)
            if "files" in low:
                return low
            first = low if first is None else first
            stack += reversed(low.values())
    return first


# -- labels ----------------------------------------------------------------------------


class Node:
    """A labelled node: ``pre`` and ``post``, its place in its parent's list, its members; ``parent`` is found by containment."""

    __slots__ = ("type", "pre", "post", "ord", "members", "parent", "below")

    def __init__(self, type_: str, pre: int, ord_: int, members):
        self.type, self.pre, self.ord, self.members = type_, pre, ord_, members
        self.post, self.parent, self.below = 0, None, ()


def label(report: dict) -> list[Node]:
    """The nodes of a report in pre-order with their intervals."""
    nodes: list[Node] = []
    clock = 0
    stack: list = [("result", 0, report)]  # nodes to enter, or to leave; explicit, as nesting has no bound
    while stack:
        top = stack.pop()
        if top.__class__ is Node:
            top.post = clock
            clock += 1
            continue
        type_, ord_, members = top
        node = Node(type_, clock, ord_, members)
        clock += 1
        nodes.append(node)
        stack.append(node)
        if type_ == "tag":
            continue
        below: list[tuple] = []
        gave: list[str] = []
        for name, x in members.items():
            child = _CHILD.get((type_, name))
            if child is None or x is None:
                continue
            if x.__class__ is str and x.lstrip(_SPACE)[:1] in ("{", "["):
                try:
                    x = _decoded(x)
                except ValueError:
                    continue
            before = len(below)
            if child == "tag":
                below += [(child, k, y) for k, y in enumerate(x if x.__class__ is list else [x]) if y is not None]
            elif x.__class__ is dict:
                below.append((child, 0, _members(x)))
            elif x.__class__ is list:
                below += [(child, k, _members(y)) for k, y in enumerate(x) if y.__class__ is dict]
            if len(below) > before or not x:
                gave.append(name)
        node.below = tuple(gave)
        below.reverse()
        stack += below
    return nodes


def link(nodes: list[Node]) -> None:
    """Give each node its parent: the innermost interval around its own."""
    open_: list[Node] = []
    for n in nodes:
        while open_ and open_[-1].post < n.pre:
            open_.pop()
        n.parent = open_[-1] if open_ else None
        open_.append(n)


def _above(n: Node, type_: str) -> Node | None:
    while n is not None and n.type != type_:
        n = n.parent
    return n


def _more(n: Node) -> str | None:
    """Members that have no column and gave no nodes."""
    own = ("start", "end") if n.type == "range" else _COLUMNS[n.type]
    rest = {k: v for k, v in n.members.items() if k not in own and k not in n.below and v is not None}
    return dumps(rest) if rest else None


def _place(n: Node) -> list[str | None]:
    out = []
    for end in ("start", "end"):
        at = n.members.get(end)
        low = _members(at) if isinstance(at, dict) else {}
        out += [_text(low.get(k)) for k in ("line", "character")]
    return out


def _row(n: Node) -> tuple:
    """The columns of a node behind its interval."""
    if n.type == "range":
        return (*_place(n), _more(n))
    if n.type == "tag":
        return (_text(n.members),)
    return (*[_text(n.members.get(k)) for k in _COLUMNS[n.type]], _more(n))


def _rows(type_: str, columns: Callable[[Node], tuple]):
    def run(ids, copies, payloads):
        for i, c, p in zip(ids, copies, payloads):
            report = find_report(p)
            if report is None:
                continue
            nodes = label(report)
            link(nodes)
            for n in nodes:
                if n.type == type_:
                    yield (i, c, *columns(n))

    return run


def _nodes(reports: DataFrame, rows, schema: str) -> DataFrame:
    source = reports.select("result_id", F.monotonically_increasing_id().alias("copy"), "payload")
    return map_lists(source, ["result_id", "copy", "payload"], rows, f"result_id long, copy long, {schema}")


def _own(type_: str) -> str:
    return ", ".join(f"{_SNAKE.get(c, c)} string" for c in _COLUMNS[type_])


def _file_ord(n: Node):
    f = _above(n, "file")
    return f.ord if f else None


def _inside(n: Node) -> tuple:
    """(file and diagnostic ordinals, type and label of the parent, own label and ordinal)."""
    d = _above(n, "diagnostic")
    return _file_ord(n), d.ord if d else None, n.parent.type, n.parent.pre, n.pre, n.post, n.ord


_INSIDE = "file_ord long, diag_ord long, parent_type string, parent_pre long, pre long, post long, ord long"


# -- tables -----------------------------------------------------------------------------


def results_table(reports: DataFrame) -> DataFrame:
    """One row per payload: ``complete``, and of a complete one its label and members."""

    def rows(ids, copies, payloads):
        for i, c, p in zip(ids, copies, payloads):
            report = find_report(p)
            if report is None:
                yield i, c, 0, 1, False, None, None, None, None
            else:
                n = label(report)[0]
                yield (i, c, n.pre, n.post, True, *_row(n))

    return _nodes(reports, rows, f"pre long, post long, complete boolean, {_own('result')}, more string")


def files_table(reports: DataFrame) -> DataFrame:
    return _nodes(
        reports, _rows("file", lambda n: (n.parent.pre, n.pre, n.post, n.ord, *_row(n))), f"parent_pre long, pre long, post long, file_ord long, {_own('file')}, more string"
    )


def diagnostics_table(reports: DataFrame) -> DataFrame:
    """Diagnostics with the label of the file whose interval encloses them."""
    return _nodes(
        reports,
        _rows("diagnostic", lambda n: (_file_ord(n), n.parent.pre, n.pre, n.post, n.ord, *_row(n))),
        f"file_ord long, parent_pre long, pre long, post long, diag_ord long, {_own('diagnostic')}, more string",
    )


def ranges_table(reports: DataFrame) -> DataFrame:
    """Ranges of diagnostics and of related places, told apart by ``parent_type`` and linked by ``parent_pre``."""
    return _nodes(reports, _rows("range", lambda n: (*_inside(n), *_row(n))), f"{_INSIDE}, {', '.join(f'{c} string' for c in _PLACES)}, more string")


def data_table(reports: DataFrame) -> DataFrame:
    return _nodes(reports, _rows("data", lambda n: (*_inside(n), *_row(n))), f"{_INSIDE}, {_own('data')}, more string")


def related_table(reports: DataFrame) -> DataFrame:
    """Related places, linked to the data (or other node) that encloses them."""
    return _nodes(reports, _rows("related", lambda n: (*_inside(n), *_row(n))), f"{_INSIDE}, {_own('related')}, more string")


def tags_table(reports: DataFrame) -> DataFrame:
    return _nodes(reports, _rows("tag", lambda n: (*_inside(n), *_row(n))), f"{_INSIDE}, tag string")


def found(reports: DataFrame) -> DataFrame:
    """``result_id, file_ord, diag_ord, file_path, code`` of every diagnostic under a file of a complete payload."""

    def columns(n: Node) -> tuple:
        f = _above(n, "file")
        return f.ord, n.ord, _text(f.members.get("filepath")) or "", _text(n.members.get("code")) or ""

    return _nodes(reports, _rows("diagnostic", columns), "file_ord long, diag_ord long, file_path string, code string").drop("copy")
