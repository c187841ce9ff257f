"""T-SQL lexer.

One compiled pattern splits a text into lexemes that cover it without gaps, so
``"".join(lexemes) == text`` always holds.  The pattern has no groups, which lets
``findall`` run at C speed; classification is by the first characters of a lexeme.

Block comments nest, which a plain pattern cannot express: the pattern matches a
block comment only if nothing nests in it, otherwise it yields a lone ``/*`` and
``split`` finds the matching end.  A string, bracketed name, quoted name or comment
that never closes becomes one lexeme that runs to the end of the text.
"""

from __future__ import annotations

import re

# Lexical states at a cut between two pieces of a text.
CODE, LINE_COMMENT, STRING, BRACKET, QUOTED = 0, 1, 2, 3, 4
BLOCK = 5  # BLOCK + n: n + 1 block comments are open

_SPACE = r"[ \t\r\n\f\v\x00-\x08\x0e-\x1f\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]+"
PATTERN = re.compile(
    r"[nN]'[^']*(?:''[^']*)*'"
    r"|[^\W\d][\w@#$]*"
    r"|" + _SPACE + r"|(?<![\w\])\"])\.[0-9]+(?:[eE][+-]?[0-9]*)?"
    r"|[,.();]"
    r"|\[[^\]]*(?:\]\][^\]]*)*\]"
    r"|'[^']*(?:''[^']*)*'"
    r"|0[xX][0-9A-Fa-f]*"
    r"|[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]*)?"
    r"|[@#][\w@#$]*"
    r'|"[^"]*(?:""[^"]*)*"'
    r"|--[^\r\n]*"
    r"|/\*[^*/]*(?:(?:\*(?!/)|/(?!\*))[^*/]*)*\*/"
    r"|/\*"
    r"|<>|!=|<=|>=|!<|!>|\+=|-=|\*=|/=|%=|&=|\^=|\|=|\|\||::"
    r"|\$[0-9]+(?:\.[0-9]*)?|\$[\w@#$]+"
    r"|.",
    re.DOTALL,
)
_EDGE = re.compile(r"/\*|\*/")
_OPEN = {"/*": "comment", "'": "string", "[": "bracket", '"': "quoted"}

TRIVIA_FIRST = frozenset(" \t\r\n\f\v\xa0　﻿​  \x00")


def comment_end(text: str, start: int, depth: int = 0) -> tuple[int, int]:
    """(offset after the block comment that is open at ``start``, 0) or (len(text), open depth)."""
    for m in _EDGE.finditer(text, start):
        depth += 1 if m.group() == "/*" else -1
        if depth == 0:
            return m.end(), 0
    return len(text), depth


def split(text: str) -> tuple[list[str], str | None]:
    """Lexemes that cover ``text``, and what stays open at its end (None: nothing).

    ``open`` is "comment", "string", "bracket" or "quoted"; the last lexeme is then
    the one that never closes.  A line comment at the end is not open.
    """
    out = PATTERN.findall(text)
    if _OPEN.keys().isdisjoint(out):
        return out, None
    done: list[str] = []
    pos = 0
    while True:
        again = False
        for tok in out:
            what = _OPEN.get(tok)
            if what is None:
                done.append(tok)
                pos += len(tok)
                continue
            if what != "comment":
                done.append(text[pos:])
                return done, what
            end, depth = comment_end(text, pos)
            done.append(text[pos:end])
            if depth:
                return done, "comment"
            pos = end
            again = True
            break
        if not again:
            return done, None
        out = PATTERN.findall(text, pos)


def is_trivia(tok: str) -> bool:
    """White space or a comment."""
    return tok[0] in TRIVIA_FIRST or tok[0].isspace() or tok[:2] in ("--", "/*") or tok[0] < " "


def line_starts(text: str) -> list[int]:
    """Offsets at which lines start; CRLF, lone CR and LF end a line."""
    return [0] + [m.end() for m in re.finditer(r"\r\n|\r|\n", text)]


def utf16_len(s: str) -> int:
    """Length in UTF-16 code units, which columns are counted in."""
    return len(s) + sum(c > "￿" for c in s) if not s.isascii() else len(s)


def token_class(tok: str) -> str:
    """Coarse class of a lexeme."""
    c = tok[0]
    if tok[:2] == "--":
        return "line_comment"
    if tok[:2] == "/*":
        return "block_comment"
    if is_trivia(tok):
        return "whitespace"
    if c == "'" or (c in "nN" and tok[1:2] == "'"):
        return "string"
    if c == "[" or c == '"':
        return "quoted_identifier"
    if c == "@":
        return "variable"
    if c.isdigit() or (c == "." and len(tok) > 1) or (c == "$" and tok[1:2].isdigit()):
        return "number"
    if c == "_" or c == "#" or c == "$" or c.isalpha():
        return "word"
    return "operator"
