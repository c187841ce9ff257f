"""Source files that do not parse (problem 2).

Method.  Every text, of any length and language, is cut into chunks at places where no lexeme
of two characters is split.  A chunk is summarised without knowing what precedes it: a map from
the lexical state at its start to the state at its end and a bracket summary.  Of T-SQL the
states are code, line comment, string, bracketed name, quoted name and block comment of any
depth, and the summary holds the number of batch separators and the closers and openers left
over in the first and the last batch.  Of JSON they are value, string and escape, with the
brackets left over; of XML text, tag, quoted values of either kind, comment, CDATA, processing
instruction and declaration, with the tags left over.  Maps compose associatively (``join_maps``)
and are reduced pairwise; all chunks of a text lie in the row that brings it, so the reduction
ends on the map side, in the task that reads it, and nothing is shuffled.  The map of the file tells whether it ends inside a literal and whether its brackets balance; only what is balanced is
parsed, statement by statement with the local grammar (T-SQL) or by the strict parser of the
standard library (JSON, XML).  The lexemes of the states that turn out true are those parsed.

Defined results: null text is not flagged; an empty or blank T-SQL text is valid, an empty
JSON or XML text isn't; a leading byte-order mark is ignored; a statement nested deeper than
the parser's stack allows is flagged, as SQL Server rejects it too; equal rows are judged
alike and each stays; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
from xml.parsers import expat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill.arrow import map_lists
from lintmill.llm import markup_states as M
from lintmill.llm.script_text import language_of
from lintmill.syntax import lexer as L
from lintmill.syntax.parser import KINDS, ParseError, Parser, StatementMemo, batches, separators

CHUNK_CHARS = 8192
_OPEN_STATE = {"string": L.STRING, "bracket": L.BRACKET, "quoted": L.QUOTED}
_CLOSER = {L.STRING: "'", L.BRACKET: "]", L.QUOTED: '"'}
_LINE_END = re.compile(r"[\r\n]")
_EDGE = re.compile(r"/\*|\*/")


_SEPARATOR_LINE = re.compile(r"\s*(?:GO[\s\d;]*)?", re.IGNORECASE)


def cut_points(text: str, size: int) -> list[int]:
    """Offsets at which chunks start: after a line break, or between plain characters of a line that can't hold a separator."""
    points, n = [0], len(text)
    while n - points[-1] > size:
        at = points[-1] + size
        while at < n:
            before, after = text[at - 1], text[at]
            if before == "\n" or (before == "\r" and after != "\n"):
                break
            if before == " " and after.isalpha() and after not in "nN":
                start = max(text.rfind("\n", 0, at), text.rfind("\r", 0, at)) + 1
                if not _SEPARATOR_LINE.fullmatch(text, start, at):
                    break
            at += 1
        if at >= n:
            break
        points.append(at)
    return points


def _brackets(kinds: list[str]) -> tuple[int, int]:
    c = o = 0
    if "(" not in kinds and ")" not in kinds:
        return c, o
    for k in kinds:
        if k == "(":
            o += 1
        elif k == ")":
            if o:
                o -= 1
            else:
                c += 1
    return c, o


def _from_code(text: str, line_start: bool) -> tuple[tuple, list[str]]:
    """((end state, separators, first batch's brackets, last batch's brackets, all batches between balance), lexemes)."""
    lexemes, open_ = L.split(text)
    if open_ == "comment":
        end = L.BLOCK + L.comment_end(lexemes[-1], 0)[1] - 1
    elif open_:
        end = _OPEN_STATE[open_]
    else:
        end = L.LINE_COMMENT if lexemes and lexemes[-1][:2] == "--" else L.CODE
    kinds = [KINDS[x] for x in (lexemes[:-1] if open_ else lexemes)]
    at = 0
    # what precedes is on the same line where none starts here, so a GO here separates nothing
    ends = [e - (not line_start) for _, e in (separators(lexemes, kinds) if line_start else separators(["x", *lexemes], [KINDS["x"], *kinds]))]
    sums = []
    for e in [*ends, len(kinds)]:
        sums.append(_brackets(kinds[at:e]))
        at = e
    return (end, len(ends), sums[0], sums[-1], all(s == (0, 0) for s in sums[1:-1])), lexemes


class SqlChunk:
    """A chunk of T-SQL: its summary, opening part and lexemes for a state at its start, read once."""

    def __init__(self, text: str, line_start: bool):
        self.text, self.line_start = text, line_start
        self.read: dict[int, tuple] = {}

    def at(self, state: int) -> tuple[tuple, str, list[str]]:
        """(summary, what ends the lexeme that is open at the start, lexemes of the rest)."""
        if state not in self.read:
            text, n = self.text, len(self.text)
            line_start = self.line_start
            if state == L.CODE:
                at = 0
            elif state == L.LINE_COMMENT:
                m = _LINE_END.search(text)
                at, line_start = (m.start(), True) if m else (n + 1, False)
            elif state >= L.BLOCK:
                at, depth = L.comment_end(text, 0, state - L.BLOCK + 1)
                if depth:
                    at = n + 1
                line_start = bool(_LINE_END.search(text, 0, at))
            else:
                closer, at = _CLOSER[state], 0
                while True:
                    at = text.find(closer, at)
                    if at < 0 or text[at + 1 : at + 2] != closer:
                        break
                    at += 2
                at, line_start = (at + 1 if at >= 0 else n + 1), False
            if at > n:
                end = state if state < L.BLOCK else L.BLOCK + depth - 1
                self.read[state] = (end, 0, (0, 0), (0, 0), True), text, []
            else:
                summary, lexemes = _from_code(text[at:], line_start)
                self.read[state] = summary, text[:at], lexemes
        return self.read[state]

    def map(self, first: bool) -> dict:
        """Lexer-state map: state at the start -> summary.  The first chunk of a file starts in code."""
        if first:
            return {L.CODE: self.at(L.CODE)[0]}
        depth = low = 0
        for m in _EDGE.finditer(self.text):
            depth += 1 if m.group() == "/*" else -1
            low = min(low, depth)  # a block comment that was -low deep at the start ends in the chunk
        out = {s: self.at(s)[0] for s in (L.CODE, L.LINE_COMMENT, *_CLOSER, *range(L.BLOCK, L.BLOCK - low))}
        out["block"] = (-low, depth)  # deeper comments stay open, deeper by so much
        return out


def apply_map(summaries: dict, state: int) -> tuple:
    """The summary of a chunk or run of chunks for one start state."""
    if state in summaries:
        return summaries[state]
    return state + summaries["block"][1], 0, (0, 0), (0, 0), True


def join_maps(a: dict, b: dict) -> dict:
    """Map of two neighbouring runs of chunks; associative."""
    out = {s: compose(one, apply_map(b, one[0])) for s, one in a.items() if s != "block"}
    if "block" in a:
        (low_a, by_a), (low_b, by_b) = a["block"], b["block"]
        low = max(low_a, low_b - by_a)
        for s in range(L.BLOCK + low_a, L.BLOCK + low):
            one = apply_map(a, s)
            out[s] = compose(one, apply_map(b, one[0]))
        out["block"] = (low, by_a + by_b)
    return out


def reduce_pairs(parts: list, join):
    """Neighbours joined in pairs until one is left."""
    while len(parts) > 1:
        parts = [join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def join_brackets(a: tuple, b: tuple) -> tuple:
    """Bracket summary of two neighbouring pieces; associative."""
    (c1, o1), (c2, o2) = a, b
    m = min(o1, c2)
    return c1 + c2 - m, o1 + o2 - m


def compose(a: tuple, b: tuple) -> tuple:
    """Summary of two neighbouring pieces, the second taken for the end state of the first; associative."""
    (_, n1, f1, l1, ok1), (end, n2, f2, l2, ok2) = a, b
    joined = join_brackets(l1, f2)
    ok = ok1 and ok2
    if n1 == 0 and n2 == 0:
        return end, 0, joined, joined, ok
    if n1 == 0:
        return end, n2, joined, l2, ok
    if n2 == 0:
        return end, n1, f1, joined, ok
    return end, n1 + n2, f1, l2, ok and joined == (0, 0)


def verdict_of_summary(s: tuple) -> str | None:
    end, _, first, last, ok = s
    if end >= L.BLOCK:
        return "comment is not closed"
    if end not in (L.CODE, L.LINE_COMMENT):
        return "literal or quoted name is not closed"
    if not ok or first != (0, 0) or last != (0, 0):
        return "parentheses don't balance"
    return None


def parse_lexemes(lexemes: list[str], memo: StatementMemo | None = None) -> str | None:
    """Why the batches of a balanced text are not valid by the grammar; None if they are."""
    for _, _, toks, kinds in batches(lexemes):
        try:
            Parser(toks, kinds, memo).script()
        except ParseError as e:
            return e.message[:200]
        except RecursionError:
            return "nested too deeply"
    return None


def sql_chunks(text: str, size: int) -> list[SqlChunk]:
    cuts = [*cut_points(text, size), len(text)]
    return [SqlChunk(text[a:b], a == 0 or text[a - 1] in "\r\n") for a, b in zip(cuts, cuts[1:])]


def sql_error(text: str, size: int = CHUNK_CHARS, memo: StatementMemo | None = None) -> str | None:
    """Why a T-SQL text is not valid: by the map of its chunks, then by the grammar."""
    chunks = sql_chunks(text, size)
    whole = reduce_pairs([c.map(k == 0) for k, c in enumerate(chunks)], join_maps)
    why = verdict_of_summary(apply_map(whole, L.CODE))
    if why:
        return why
    state = L.CODE
    lexemes: list[str] = []
    for c in chunks:
        summary, head, own = c.at(state)
        if head:
            lexemes[-1] += head
            if lexemes[-1][0] == "'" and lexemes[-2:-1] in (["N"], ["n"]):  # apart while the literal was open
                lexemes[-2:] = ["".join(lexemes[-2:])]
        lexemes += own
        state = summary[0]
    return parse_lexemes(lexemes, memo)


def _no_constant(name: str):
    raise ValueError(name)


def json_error(text: str, size: int = CHUNK_CHARS) -> str | None:
    why = M.verdict(reduce_pairs(M.maps(text, size, "json"), M.join_maps)["value"])
    if why:
        return why
    try:
        json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        return "nested too deeply"
    except ValueError as e:
        return str(e)[:200]
    return None


def xml_error(text: str, size: int = CHUNK_CHARS) -> str | None:
    why = M.verdict(reduce_pairs(M.maps(text, size, "xml"), M.join_maps)["text"])
    if why:
        return why
    p = expat.ParserCreate("utf-8")
    try:
        p.Parse(text.encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError as e:
        return str(e)[:200]
    return None


def _task_state() -> StatementMemo:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 6000))
    return StatementMemo(200_000)


_VERDICT = "script_id long, repo string, language string, error string"


def _check_rows(chunk_chars: int):
    def run(memo, ids, repos, paths, texts):
        for i, repo, path, text in zip(ids, repos, paths, texts):
            lang = language_of(path)
            if text is None:
                yield i, repo, lang, None
                continue
            if lang == "tsql":
                why = sql_error(text, chunk_chars, memo)
            else:
                why = (json_error if lang == "json" else xml_error)(text[1:] if text[:1] == "\ufeff" else text, chunk_chars)
            yield i, repo, lang, why

    return run


def check_syntax(scripts: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per script: ``script_id, repo, language, error`` (null: valid); one scan, no shuffle."""
    return map_lists(scripts, ["script_id", "repo", "file_path", "text"], _check_rows(chunk_chars), _VERDICT, once=_task_state)


def invalid_scripts(scripts: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``script_id`` of each script that is not valid for the language of its path."""
    return check_syntax(scripts, chunk_chars).where("error is not null").select("script_id")


def invalid_rates(scripts: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Scripts, invalid scripts and their share per repository and language; counts combine before the shuffle."""
    return (
        check_syntax(scripts, chunk_chars)
        .groupBy("repo", "language")
        .agg(F.count(F.lit(1)).alias("scripts"), F.count("error").alias("invalid"))
        .withColumn("rate", F.col("invalid") / F.col("scripts"))
    )
