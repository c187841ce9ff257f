"""Formatting of T-SQL texts.

The passes run in a fixed order over the lexeme list of a text; white space, comments,
literals and quoted names are lexemes of their own, so no pass can touch what is protected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from lintmill.formatting.words import FUNCTIONS, PAIRS, PAREN_FREE, SYSTEM_SCHEMAS, TYPES
from lintmill.syntax import lexer as L
from lintmill.syntax.words import RESERVED


@dataclass(frozen=True)
class FormatOptions:
    """Settings; casings are none, upper, lower or pascal."""

    compat_level: int = 150
    indent_style: str = "spaces"
    indent_size: int = 4
    keyword_casing: str = "upper"
    function_casing: str = "upper"
    type_casing: str = "lower"
    schema_casing: str = "none"
    table_casing: str = "none"
    column_casing: str = "none"
    variable_casing: str = "lower"
    system_table_casing: str = "lower"
    procedure_casing: str = "none"
    user_function_casing: str = "none"
    comma_style: str = "trailing"
    max_line_length: int = 0
    insert_final_newline: bool = True
    trim_trailing_whitespace: bool = True
    normalize_inline_spacing: bool = True
    normalize_keyword_spacing: bool = True
    normalize_operator_spacing: bool = True
    normalize_function_spacing: bool = True
    line_ending: str = "auto"
    max_blank_lines: int = 0
    trim_leading_blank_lines: bool = True


_BREAK = re.compile(r"\r\n|\r|\n")
_INLINE = re.compile(r"[ \t]+\Z")
KINDS = ("space", "comment", "string", "quoted", "word", "variable", "number", "other")


@lru_cache(maxsize=100_000)
def kind(tok: str) -> str:
    c = L.token_class(tok)
    return {
        "whitespace": "space", "line_comment": "comment", "block_comment": "comment", "string": "string", "quoted_identifier": "quoted",
        "variable": "variable", "number": "number", "word": "word",
    }.get(c, "other")


def line_ending(text: str, setting: str) -> str:
    if setting in ("crlf", "lf"):
        return "\r\n" if setting == "crlf" else "\n"
    m = re.search(r"\r\n|\n", text)
    return m.group() if m else "\r\n"


def strip_lone_cr(text: str, eol: str = "\n") -> str:
    """Lone CRs go, unless nothing else parts what stands on both sides: then they become line ends."""
    if "\r" not in text:
        return text
    return re.sub(r"(?<=\S)\r(?=\S)", eol, re.sub(r"\r(?!\n)(?=\s)|(?<=\s)(?<!\r)\r(?!\n)|\r(?!\n)\Z", "", text))


def _neighbours(toks: list[str]) -> list[int]:
    """Indices of the lexemes that are neither white space nor comments."""
    return [i for i, t in enumerate(toks) if kind(t) not in ("space", "comment")]


def keyword_spacing(toks: list[str]) -> list[str]:
    """One blank inside keyword pairs whose gap is blanks and tabs."""
    out = list(toks)
    for i in range(1, len(toks) - 1):
        if toks[i][0] in " \t" and _INLINE.match(toks[i]) and (toks[i - 1].upper(), toks[i + 1].upper()) in PAIRS:
            out[i] = " "
    return out


def _case(tok: str, how: str) -> str:
    if how == "upper":
        return tok.upper()
    if how == "lower":
        return tok.lower()
    if how == "pascal":
        return "".join(p[:1].upper() + p[1:].lower() for p in re.split(r"(_)", tok))
    return tok


_TABLE_BEFORE = frozenset("FROM JOIN INTO UPDATE TABLE APPLY MERGE USING TRUNCATE REFERENCES VIEW".split())
_AFTER_FROM = frozenset("WHERE GROUP ORDER HAVING ON SET SELECT VALUES UNION EXCEPT INTERSECT OPTION".split())


def categories(toks: list[str]) -> dict[int, str]:
    """Category of every lexeme whose letter case may change."""
    at = _neighbours(toks)
    out: dict[int, str] = {}
    in_tables, exec_name = False, False
    for p, i in enumerate(at):
        t = toks[i]
        u = t.upper()
        k = kind(t)
        nxt = toks[at[p + 1]] if p + 1 < len(at) else ""
        prev = toks[at[p - 1]] if p else ""
        if k == "variable":
            out[i] = "variable"
            continue
        if k not in ("word", "quoted"):
            if t == ";":
                in_tables = exec_name = False
            continue
        quoted = k == "quoted"
        after_dot = prev == "."
        if not quoted and not after_dot:
            if u in PAREN_FREE or (u in FUNCTIONS and nxt == "("):
                out[i] = "function"
                continue
            if u in TYPES and nxt != ".":
                out[i] = "type"
                continue
            if u in RESERVED or u in ("GO", "THROW", "TRY", "CATCH", "OUTPUT", "APPLY", "PARTITION", "ROWS", "RANGE", "PRECEDING", "FOLLOWING", "UNBOUNDED", "NOCOUNT", "XACT_ABORT", "MATCHED", "NOLOCK", "RETURNS", "OFFSET", "NEXT", "ONLY", "ROW"):
                out[i] = "keyword"
                if u in _TABLE_BEFORE:
                    in_tables = True
                elif u in _AFTER_FROM:
                    in_tables = False
                exec_name = u in ("EXEC", "EXECUTE", "PROC", "PROCEDURE")
                continue
        if nxt == "." and not after_dot and (in_tables or exec_name):
            out[i] = "schema"
            continue
        owner = toks[at[p - 2]] if after_dot and p >= 2 else ""
        if exec_name:
            out[i] = "schema" if nxt == "." else "procedure"
            exec_name = nxt == "."
            continue
        if nxt == "(" and not in_tables:
            out[i] = "user_function"
        elif in_tables:
            if nxt == ".":
                out[i] = "schema"
            elif owner and L.is_trivia(owner) is False and owner.strip('[]"').lower() in SYSTEM_SCHEMAS:
                out[i] = "system_table"
            else:
                out[i] = "table" if prev == "." or prev.upper() in _TABLE_BEFORE or prev == "," else "alias"
        else:
            out[i] = "table" if nxt == "." else "column"
    return out


def element_casing(toks: list[str], o: FormatOptions) -> list[str]:
    how = {
        "keyword": o.keyword_casing, "function": o.function_casing, "type": o.type_casing, "schema": o.schema_casing, "table": o.table_casing,
        "alias": o.table_casing, "column": o.column_casing, "variable": o.variable_casing, "system_table": o.system_table_casing,
        "procedure": o.procedure_casing, "user_function": o.user_function_casing,
    }
    out = list(toks)
    for i, c in categories(toks).items():
        out[i] = _case(toks[i], how[c])
    return out


def inline_spacing(toks: list[str]) -> list[str]:
    """No blank before a comma on its line, one after it; runs of blanks between lexemes of a line shrink to one."""
    out: list[str] = []
    n = len(toks)
    for i, t in enumerate(toks):
        if t[0] in " \t" and _INLINE.match(t):
            line_start = not out or out[-1].endswith(("\n", "\r"))
            nxt = toks[i + 1] if i + 1 < n else ""
            if not line_start and nxt == ",":
                continue  # also between two commas
            if not line_start and nxt[:2] not in ("--", "/*") and nxt and not nxt[0] in "\r\n":
                out.append(" ")
                continue
        out.append(t)
        if t == "," and i + 1 < n and toks[i + 1] != "," and kind(toks[i + 1]) != "space":
            out.append(" ")
    return out


def function_spacing(toks: list[str]) -> list[str]:
    """No blank between a function's name and its parenthesis."""
    out: list[str] = []
    n = len(toks)
    for i, t in enumerate(toks):
        if t[0] in " \t" and _INLINE.match(t) and 0 < i < n - 1 and toks[i + 1] == "(":
            p = toks[i - 1]
            u = p.upper()
            known = u in FUNCTIONS and u not in ("LEFT", "RIGHT", "CASE") or u in TYPES and u not in ("CURSOR", "TIMESTAMP")
            named = kind(p) == "word" and u not in RESERVED and i >= 2 and toks[i - 2] == "."
            if (known or named) and not _table_name(toks, i - 1):
                continue
        out.append(t)
    return out


def _table_name(toks: list[str], i: int) -> bool:
    """Whether the name ending at i follows INTO, TABLE, ON or the like, so that a column list comes next."""
    j = i
    while j >= 0 and (toks[j] == "." or kind(toks[j]) in ("word", "quoted")):
        if kind(toks[j]) == "word" and toks[j].upper() in ("INTO", "TABLE", "ON", "REFERENCES", "INDEX", "VIEW", "FUNCTION", "INSERT", "MERGE"):
            return True
        if toks[j] != "." and j and toks[j - 1] != ".":
            j -= 1
            while j >= 0 and kind(toks[j]) == "space":
                j -= 1
            return j >= 0 and toks[j].upper() in ("INTO", "TABLE", "ON", "REFERENCES", "INDEX", "VIEW", "FUNCTION", "INSERT", "MERGE")
        j -= 1
    return False


_BINARY = frozenset("= <> != < > <= >= !< !> += -= *= /= %= &= ^= |= + - * / % & | ^ ||".split())
_UNARY_BEFORE = frozenset("( , = <> != < > <= >= + - * / % & | ^ += -= *= /= %=".split())
_UNARY_WORDS = frozenset(
    "SELECT WHERE AND OR ON WHEN THEN ELSE IN BETWEEN LIKE RETURN SET VALUES CASE BY TOP NOT IS HAVING DISTINCT EXEC EXECUTE PRINT".split()
)


def operator_spacing(toks: list[str]) -> list[str]:
    """Blanks around binary operators; signs, COUNT(*), t.* and select * stay as they are."""
    out: list[str] = []
    n = len(toks)
    for i, t in enumerate(toks):
        if t not in _BINARY:
            out.append(t)
            continue
        j = i - 1
        while j >= 0 and kind(toks[j]) in ("space", "comment"):
            j -= 1
        prev = toks[j] if j >= 0 else ""
        k = i + 1
        while k < n and kind(toks[k]) in ("space", "comment"):
            k += 1
        nxt = toks[k] if k < n else ""
        unary = t in "+-" and (prev == "" or prev in _UNARY_BEFORE or prev.upper() in _UNARY_WORDS)
        star = t == "*" and (prev in ("", ".", "(", ",") or nxt in ("", ")", ",", ";") or prev.upper() in ("SELECT", "DISTINCT", "ALL", "PERCENT", "OUTPUT") or nxt.upper() in ("FROM", "INTO"))
        joined = t in "<>!=" and ((i + 1 < n and toks[i + 1] in ("=", ">", "<", "*")) or (i and toks[i - 1] in ("=", "<", ">", "!")))
        if unary or star or joined:
            out.append(t)
            continue
        if out and kind(out[-1]) != "space":
            out.append(" ")
        out.append(t)
        if i + 1 < n and kind(toks[i + 1]) != "space":
            out.append(" ")
    return out


def _lines(text: str) -> list[tuple[str, bool]]:
    """(line, whether its start lies inside a lexeme that spans lines)."""
    out: list[tuple[str, bool]] = []
    buffer: list[str] = []
    inside = False
    for tok in L.split(text)[0]:
        if "\n" not in tok and "\r" not in tok:
            buffer.append(tok)
            continue
        parts = _BREAK.split(tok)
        protected = kind(tok) != "space"
        buffer.append(parts[0])
        out.append(("".join(buffer), inside))
        out.extend((p, protected) for p in parts[1:-1])
        buffer, inside = [parts[-1]], protected
    out.append(("".join(buffer), inside))
    return out


def _open_ends(rows: list[tuple[str, bool]]) -> list[bool]:
    """For each line, whether its end lies inside a lexeme that spans lines."""
    return [r[1] for r in rows[1:]] + [False]


def whitespace(text: str, o: FormatOptions, eol: str) -> str:
    """Indentation, trailing blanks, line ends; lines that start inside a literal or comment keep their start."""
    rows = _lines(text)
    ends = _open_ends(rows)
    out = []
    for (line, inside), open_end in zip(rows, ends):
        if not inside:
            body = line.lstrip(" \t")
            lead = line[: len(line) - len(body)]
            width = 0
            for c in lead:
                width += o.indent_size if c == "\t" else 1
            lead = " " * width if o.indent_style == "spaces" else "\t" * (width // o.indent_size) + " " * (width % o.indent_size)
            line = lead + body
        if o.trim_trailing_whitespace and not open_end:
            line = line.rstrip(" \t")
        out.append(line)
    return eol.join(out)


def blank_lines(text: str, o: FormatOptions, eol: str) -> str:
    rows = _lines(text)
    out: list[str] = []
    run = 0
    started = not o.trim_leading_blank_lines
    for line, inside in rows:
        if not inside and not line.strip():
            run += 1
            if not started or (o.max_blank_lines and run > o.max_blank_lines):
                continue
        else:
            run = 0
            started = True
        out.append(line)
    return eol.join(out)


def comma_style(text: str, style: str, eol: str) -> str:
    """Move commas at line ends to the next line's start, or back."""
    parts = _lines(text)
    rows = [r[0] for r in parts]
    inside = [r[1] for r in parts]

    def code_end(line: str) -> int:
        """Offset after the last code character of a line."""
        at = end = 0
        for tok in L.split(line)[0]:
            if kind(tok) not in ("space", "comment"):
                end = at + len(tok)
            at += len(tok)
        return end

    def is_code(i: int) -> bool:
        return bool(rows[i].strip()) and not inside[i] and rows[i].lstrip()[:2] not in ("--", "/*")

    n = len(rows)
    if style == "leading":
        for i in range(n):
            if inside[i]:
                continue
            end = code_end(rows[i])
            if not end or rows[i][end - 1] != "," or (i + 1 < n and inside[i + 1]):
                continue
            j = next((j for j in range(i + 1, n) if is_code(j)), None)
            if j is None or rows[j].lstrip()[:1] == ",":
                continue
            rows[i] = (rows[i][: end - 1] + rows[i][end:]).rstrip()
            body = rows[j].lstrip()
            rows[j] = rows[j][: len(rows[j]) - len(body)] + ", " + body
    else:
        for i in range(n):
            body = rows[i].lstrip()
            if inside[i] or body[:1] != ",":
                continue
            j = next((j for j in range(i - 1, -1, -1) if is_code(j)), None)
            if j is None or any(inside[j + 1 : i + 1]):
                continue
            end = code_end(rows[j])
            if not end or rows[j][end - 1] == ",":
                continue
            rows[j] = rows[j][:end] + "," + rows[j][end:]
            rows[i] = rows[i][: len(rows[i]) - len(body)] + body[1:].lstrip()
    return eol.join(rows)


def format_sql(text: str, o: FormatOptions = FormatOptions()) -> str:
    """The text in the given style; formatting twice changes nothing more."""
    if text == "":
        return line_ending("", o.line_ending) if o.insert_final_newline else ""
    eol = line_ending(text, o.line_ending)
    text = strip_lone_cr(text, eol)
    toks, open_ = L.split(text)
    if o.normalize_keyword_spacing:
        toks = keyword_spacing(toks)
    toks = element_casing(toks, o)
    text = whitespace("".join(toks), o, eol)
    text = blank_lines(text, o, eol)
    toks, _ = L.split(text)
    if o.normalize_inline_spacing:
        toks = inline_spacing(toks)
    if o.normalize_function_spacing:
        toks = function_spacing(toks)
    if o.normalize_operator_spacing:
        toks = operator_spacing(toks)
    text = "".join(toks)
    if o.comma_style in ("leading", "trailing") and o.comma_style != "keep":
        if o.comma_style == "leading":
            text = comma_style(text, "leading", eol)
        elif re.search(r"^[ \t]*,", text, re.MULTILINE) and o.comma_style == "trailing":
            text = comma_style(text, "trailing", eol)
    if o.trim_trailing_whitespace:
        text = whitespace(text, o, eol)
    if open_:
        return text
    stripped = text.rstrip("\r\n")
    if o.insert_final_newline:
        return stripped + eol if stripped else eol
    return stripped
