"""Keyword-stuffed and link-list pages (problem 9).

Method.  A page is cut into pieces: sentences, table cells, list entries, code.  A piece has
clause structure if it is long enough, ends like a sentence, says something new in most of its
words and isn't a run of separated phrases, in whatever script it is written; code and data
have theirs by their operators and names.  Over the units of the whole page (words, runs of
digits alike, single ideographs and kana) the suffix automaton is built.  For every unit it
gives the longest substring ending there that occurs elsewhere in the page; those of at least
``LEAST`` characters are repeated maximal substrings, and the units that they span are
covered.  A page is stuffed if more than half of its characters lie in pieces without
structure and are covered there, or are bare links or hashtags.

Every page goes through the automaton, its coverage is a column of ``page_measures``.  Units
that occur once can't lie in a repeated substring; they part the page into stretches, which
the automaton takes in one after another.

Defined results: null, empty and blank texts are not stuffed; whole texts are judged; equal
rows are judged alike and each stays; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import accumulate, compress

from pyspark.sql import DataFrame

from lintmill.arrow import map_lists

SHARE = 0.5
LEAST = 8
CJK_WEIGHT = 2.5

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.DOTALL)
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-f]+|[a-z]+);", re.IGNORECASE)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_BLOCK_TAG = re.compile(r"<(?:li|p|br|div|tr|td|h\d)\b[^<>]*>", re.IGNORECASE)
_HREF = re.compile(r"\bhref\s*=\s*", re.IGNORECASE)
_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+", re.IGNORECASE)
_LINK_MARKUP = re.compile(r"\[([^\[\]\n]*)\]\(([^()\n]*)\)")
_ANCHOR = re.compile(r"<a\b([^<>]*)>|</a\s*>", re.IGNORECASE)
_HASHTAG = re.compile(r"#[^\W\d_]\w*")
_UNIT = re.compile(r"[぀-ヿ㐀-鿿]|[^\W\d_぀-ヿ㐀-鿿]+|\d+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_LINE = re.compile(r"\r\n|\r|\n")
_CUT = re.compile(r"[.!?][)\"'»”]?[^\S\r\n]+|[。！？]|\||\t|[•·]\s")
_LETTERS_AND_DIGITS = bytes(ord(chr(i).lower()) if chr(i).isalnum() and i < 128 else 32 for i in range(256))
_ASCII_UNIT = re.compile(r"[a-z]+|\d+")
_ENDS = frozenset(".!?。！？:…")
_BEHIND = " \t\u3000|•·)\"'»”*_"  # what may follow the end of a sentence
_SEPARATORS = (",", ";", "|", "/", "•", "·", "#", "、", " - ", " – ")
#: A number alone in brackets: how often a tag was used, no call.
_TALLY = re.compile(r"\(\s*\d+\s*\)|\[\s*\d+\s*\]")
_CODE = re.compile(r"[=(){}\[\];@<>\\]|\w_\w|[^\W\d]\.[^\W\d]|^\s*(?:--|/\*|\*/|\*\s)|^[-+]{3}")
_SQL = re.compile(
    r"^\s*(?:SELECT|FROM|WHERE|AND|OR|INSERT|UPDATE|DELETE|SET|VALUES|CREATE|ALTER|DROP|EXEC(?:UTE)?|BEGIN|END|GO|IF|ELSE|WHILE|DECLARE|MERGE|USING|WHEN|GROUP BY|"
    r"ORDER BY|HAVING|(?:INNER|LEFT|RIGHT|FULL|CROSS)?\s*(?:OUTER\s+)?JOIN|ON|COMMIT|ROLLBACK|THROW|PRINT|AS|RAISERROR|UNION|RETURN)\b(?=[\s;]|$)(?=.*[\[\].,;=()\"@*']|\s*$|\s+\w+\s*$)",
    re.IGNORECASE,
)


def units_of(s: str) -> list[str]:
    """Words, runs of digits, single ideographs and kana, in lower case."""
    if not s.isascii():
        return _UNIT.findall(s.lower())
    words = s.encode("ascii").translate(_LETTERS_AND_DIGITS).decode("ascii").split()
    if "".join(words).isalpha():
        return words
    out: list[str] = []
    for w in words:
        if w.isalpha() or w.isdigit():
            out.append(w)
        else:
            out += _ASCII_UNIT.findall(w)
    return out


def mark_cuts(body: str) -> str:
    """A null character behind each sentence, table cell and list entry."""
    if not body.isascii():
        return _CUT.sub("\\g<0>\0", body)
    for end in (". ", "! ", "? ", "|", "\t", '." ', '!" ', '?" ', ".) ", "!) ", "?) ", ".' ", "!' ", "?' "):
        if end in body:
            body = body.replace(end, end + "\0")
    return body


def is_clause(piece: str, units: list[str] | None = None) -> bool:
    """Long enough, ends like a sentence, mostly different words, no run of separated phrases."""
    units = units_of(piece) if units is None else units
    n = len(units)
    if n < 4 or piece.rstrip(_BEHIND)[-1:] not in _ENDS:
        return False
    cjk = 0 if piece.isascii() else len(_CJK.findall(piece))
    if cjk >= 8:  # some two characters a word; single ones come back in any sentence, pairs seldom
        if len(set(zip(units, units[1:]))) < 0.6 * (n - 1):
            return False
        n = n - cjk + cjk // 2
    elif len(set(units)) < 0.6 * n:
        return False
    return sum(map(piece.count, _SEPARATORS)) * 4 <= n


def is_code(piece: str, n: int) -> bool:
    """A line of SQL, or an operator, bracket or compound name to every eight of its ``n`` units."""
    if _SQL.match(piece):
        return True
    marks = len(_CODE.findall(piece))
    if marks and ("(" in piece or "[" in piece):
        marks = len(_CODE.findall(_TALLY.sub(" ", piece)))
    return marks > 0 and marks * 8 >= n


def repeated(words: list[str], least: int = 1) -> list[bool]:
    """For every word, whether a substring of ``least`` characters or more that occurs twice or more spans it."""
    ids: dict[str, int] = {}
    names = words
    words = [ids.setdefault(w, len(ids)) for w in words]
    n, kinds = len(words), len(ids)
    pairs = [a * kinds + b for a, b in zip(words, words[1:])]
    often = Counter(pairs)
    joined = [often[p] > 1 for p in pairs]  # whether the pair of a word and the next one repeats
    joined.append(False)
    chars = list(accumulate(map(len, names), initial=0))
    times = Counter(words)
    out = [len(w) >= least and times[i] > 1 for w, i in zip(names, words)]
    # states by number: transitions, suffix link, length of the longest substring, whether it occurs twice
    nxt: list[dict] = [{}] * (2 * n + 2)
    nxt[0] = {}
    link = [0] * (2 * n + 2)
    link[0] = -1
    length = [0] * (2 * n + 2)
    twice = bytearray(2 * n + 2)
    ends = [0] * n
    states = 1
    last = 0
    linked = False
    for i, w in enumerate(words):
        before, linked = linked, joined[i]
        if not before:
            last = 0
            if not linked:  # no longer substring spans it
                continue
        at = nxt[last]
        q = at.get(w)
        if q is None:
            cur = states
            states += 1
            nxt[cur] = {}
            length[cur] = length[last] + 1
            at[w] = cur
            p = link[last]
            last = cur
            while p >= 0:
                at = nxt[p]
                q = at.get(w)
                if q is not None:
                    break
                at[w] = cur
                p = link[p]
            else:
                ends[i] = cur
                continue
        else:  # a stretch before this one had it
            p, cur = last, 0
            last = q
        if length[q] != length[p] + 1:  # split p's longest substring and w off from q
            clone = states
            states += 1
            nxt[clone] = nxt[q].copy()
            length[clone] = length[p] + 1
            link[clone] = link[q]
            link[q] = clone
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = clone
                p = link[p]
            q = clone
        twice[q] = 1
        if cur:
            link[cur] = q
        else:
            last = q
        ends[i] = last
    reach = n  # first word of what is covered already
    for i in range(n - 1, -1, -1):
        v = ends[i]
        if not v:
            continue
        while not twice[v] and v:
            v = link[v]
        if v:
            start = i - length[v] + 1
            if start < reach and chars[i + 1] - chars[start] >= least:
                stop = min(i + 1, reach)
                out[start:stop] = [True] * (stop - start)
                reach = start
    return out


def measure(text: str) -> tuple[float, float, float]:
    """Shares of a page's characters: in pieces without structure, covered by repeats, stuffed."""
    units: list[str] = []  # of the page
    loose: list[tuple[int, int, bool]] = []  # first and last unit of pieces without structure, whether they are links or tags
    body = text
    if "```" in body:
        at, plain = 0, []
        for m in _FENCE.finditer(text):
            plain.append(text[at : m.start()])
            units += units_of(m.group())
            at = m.end()
        body = "\n".join([*plain, text[at:]])
    if "<" in body:
        body = _ANCHOR.sub(lambda m: f" {m.group(1) or ''} | ", body)
        body = _HREF.sub(" ", body)
        body = _BLOCK_TAG.sub("\n", body)
        body = _TAG.sub(" ", body)
    if "&" in body:
        body = _ENTITY.sub(" ", body)
    for line in _LINE.split(mark_cuts(body)):
        line = line.strip()
        if not line:
            continue
        if "](" in line:
            line = _LINK_MARKUP.sub(r"\1 \2 ", line)
        linked = "://" in line or "www." in line
        said = []
        for piece in line.split("\0"):
            links: list[str] = []
            if linked:
                for m in _URL.finditer(piece):
                    links += units_of(m.group())
                if links:
                    piece = _URL.sub(" ", piece)
            own = units_of(piece)
            if own or links:
                said.append((piece, own, links, is_clause(piece, own)))
        beside = linked and any(s[3] for s in said)  # a reference beside a sentence
        for piece, own, links, clause in said:
            if links:
                if not beside:
                    loose.append((len(units), len(units) + len(links), True))
                units += links
            if not own:
                continue
            if not clause:
                tagged = piece.count("#") > 1 and 2 * sum(map(len, _HASHTAG.findall(piece))) > len(piece)
                if tagged or links or not is_code(piece, len(own)):
                    loose.append((len(units), len(units) + len(own), tagged))
            units += own
    if not units:
        return 0.0, 0.0, 0.0
    weights = list(map(len, units)) if text.isascii() else [CJK_WEIGHT if len(u) == 1 and _CJK.match(u) else len(u) for u in units]
    covered = repeated([u if u > ":" else "0" for u in units], LEAST)
    total = sum(weights)
    free = stuffed = 0
    for a, b, bare in loose:
        n = sum(weights[a:b])
        free += n
        stuffed += n if bare else sum(compress(weights[a:b], covered[a:b]))
    return free / total, sum(compress(weights, covered)) / total, stuffed / total


def is_stuffed(text: str | None, share: float = SHARE) -> bool:
    return bool(text and text.strip()) and measure(text)[2] > share


def _judge(ids, texts):
    for i, t in zip(ids, texts):
        if t and t.strip():
            free, repeats, stuffed = measure(t)
            yield i, free, repeats, stuffed, stuffed > SHARE


def page_measures(documents: DataFrame) -> DataFrame:
    """``doc_id, unstructured, repeated, stuffing, stuffed``: shares of each page and the verdict; one pass, no shuffle."""
    return map_lists(documents, ["doc_id", "text"], _judge, "doc_id long, unstructured double, repeated double, stuffing double, stuffed boolean")


def stuffed_pages(documents: DataFrame) -> DataFrame:
    """``doc_id`` of each page most of whose text is repeated keywords, links or tags."""
    return page_measures(documents).where("stuffed").select("doc_id").distinct()
