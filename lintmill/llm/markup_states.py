"""Lexer-state maps and bracket summaries of chunks of JSON and XML (problem 2).

A summary is (end state, closers left over, openers left over, whether all that met fit).  Closers
and openers are brackets (JSON) or element names (XML, where ``/`` closes whatever is open).
"""

from __future__ import annotations

import re

Summary = tuple[str, tuple[str, ...], tuple[str, ...], bool]

_JSON_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*(["\\]?)|[\[\]{}]', re.DOTALL)
_JSON_REST = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*(["\\]?)', re.DOTALL)
_JSON_PAIR = {"]": "[", "}": "{"}
JSON_STATES = ("value", "string", "escape")

#: State of XML -> what ends it or matters in it, and the state after each.
_XML = {
    "text": (r"<!--|<!\[CDATA\[|<\?|<!|</|<", {"<!--": "note", "<![CDATA[": "cdata", "<?": "instruction", "<!": "declaration", "</": "closing", "<": "tag"}),
    "note": ("-->", {"-->": "text"}),
    "cdata": ("]]>", {"]]>": "text"}),
    "instruction": (r"\?>", {"?>": "text"}),
    "closing": (">", {">": "text"}),
    "tag": ("\"|'|/>|>", {'"': "double", "'": "single", "/>": "text", ">": "text"}),
    "double": ('"', {'"': "tag"}),
    "single": ("'", {"'": "tag"}),
    "declaration": ("\"|'|\\[|>", {'"': "declared double", "'": "declared single", "[": "subset", ">": "text"}),
    "declared double": ('"', {'"': "declaration"}),
    "declared single": ("'", {"'": "declaration"}),
    "subset": ("\"|'|<!--|<\\?|\\]", {'"': "subset double", "'": "subset single", "<!--": "subset note", "<?": "subset instruction", "]": "declaration"}),
    "subset double": ('"', {'"': "subset"}),
    "subset single": ("'", {"'": "subset"}),
    "subset note": ("-->", {"-->": "subset"}),
    "subset instruction": (r"\?>", {"?>": "subset"}),
}
XML_STATES = tuple(_XML)
_XML_NEXT = {s: (re.compile(p), after) for s, (p, after) in _XML.items()}
_XML_NAME = re.compile(r"[^\s/<>\"'=]*")
_LINE = re.compile(r"[\r\n]|(?=<)")


def json_from(text: str, state: str) -> Summary:
    at = 0
    if state != "value":
        m = _JSON_REST.match(text, 1 if state == "escape" else 0)
        if m is None or m.group(1) != '"':
            return ("escape" if m is not None and m.group(1) else state if not text else "string"), (), (), True
        at = m.end()
    closers: list[str] = []
    openers: list[str] = []
    fit = True
    for m in _JSON_TOKEN.finditer(text, at):
        c = m.group()[0]
        if c == '"':
            if m.group(1) != '"':
                return ("escape" if m.group(1) else "string"), tuple(closers), tuple(openers), fit
        elif c in "[{":
            openers.append(c)
        elif openers:
            fit &= openers.pop() == _JSON_PAIR[c]
        else:
            closers.append(_JSON_PAIR[c])
    return "value", tuple(closers), tuple(openers), fit


def xml_from(text: str, state: str) -> Summary:
    closers: list[str] = []
    openers: list[str] = []
    fit = True
    at = 0
    while True:
        pattern, after = _XML_NEXT[state]
        m = pattern.search(text, at)
        if m is None:
            return state, tuple(closers), tuple(openers), fit
        at = m.end()
        what = m.group()
        if state == "text" and after[what] == "tag":
            openers.append(_XML_NAME.match(text, at).group())
        elif what == "/>" or (state == "text" and what == "</"):
            name = "/" if what == "/>" else _XML_NAME.match(text, at).group()
            if not openers:
                closers.append(name)
            else:
                fit &= openers.pop() == name or name == "/"
        state = after[what]


def join(a: Summary, b: Summary) -> Summary:
    """Summary of two neighbouring runs, the second taken for the end state of the first; associative."""
    (_, c1, o1, fit1), (end, c2, o2, fit2) = a, b
    k = min(len(o1), len(c2))
    fit = fit1 and fit2 and all(name in (opener, "/") for opener, name in zip(o1[::-1], c2[:k]))
    return end, c1 + c2[k:], o1[: len(o1) - k] + o2, fit


def join_maps(a: dict[str, Summary], b: dict[str, Summary]) -> dict[str, Summary]:
    return {s: join(one, b[one[0]]) for s, one in a.items()}


def cut_points(text: str, size: int, language: str) -> list[int]:
    """Offsets at which chunks start: anywhere in JSON, behind a line break or before a ``<`` in XML."""
    points, n = [0], len(text)
    while n - points[-1] > size:
        at = points[-1] + size
        if language == "xml":
            m = _LINE.search(text, at)
            at = max(m.end(), at) if m else n
        if at >= n:
            break
        points.append(at)
    return points


def maps(text: str, size: int, language: str) -> list[dict[str, Summary]]:
    """The maps of a text's chunks; the first one starts outside of everything."""
    read, states = (json_from, JSON_STATES) if language == "json" else (xml_from, XML_STATES)
    cuts = [*cut_points(text, size, language), len(text)]
    return [{s: read(text[a:b], s) for s in (states if a else states[:1])} for a, b in zip(cuts, cuts[1:])]


def verdict(s: Summary) -> str | None:
    """Why a file of this summary is not valid; None if its brackets balance."""
    end, closers, openers, fit = s
    if end not in ("value", "text"):
        return f"ends inside {end}"
    if closers or openers or not fit:
        return "brackets don't balance" if end == "value" else "elements don't balance"
    return None

