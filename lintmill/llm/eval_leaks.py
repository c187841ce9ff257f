"""Evaluation texts leaking into training text (problem 8).

Method.  A leak repeats a passage of ``PASSAGE`` or more consecutive words of a test item with at
most one word in ten changed: ``n`` words with at most ``n // 10`` edits.  Each item is split into
pieces of ``PIECE`` words such that any such passage holds more whole pieces than it may have
edits: by the pigeonhole principle one of them occurs unchanged.  Exact piece hits come from one
pass of an automaton over the words of each document.  From each hit Myers' bit-parallel edit
distance on words runs once to either side and gives how far the passage reaches with each number
of edits; passages of all lengths are judged by it.  Words at the ends of a passage may be changed
like any others.

Words are compared without letter case, punctuation, markup and layout.  The items are a
fixed, small set: they are sent to all executors in blocks of about ``BLOCK_CHARS`` characters, one
after another, one pass over the documents a block, so what is sent has a bound and no pairs of rows are
formed.

Defined results: null texts, items of fewer than ``PASSAGE`` words and empty tables give no
row; equal documents each give a row, equal rows one; whole texts are searched; further columns
are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill.arrow import map_lists
from lintmill.session import cut

PASSAGE = 25
BUDGET = PASSAGE // 10
PIECE = 6  # (PASSAGE + 1) // (BUDGET + 2): n words hold n // 10 + 1 whole pieces wherever they start, for all n from PASSAGE on
BLOCK_CHARS = 16_000_000  # of the items that are on the executors at a time

_TAG = re.compile(r"<[A-Za-z/!][^<>]*>")
_BREAKS = "—–―/|\\…"
_TABLE: dict[int, str | None] = {c: None for c in range(0x21, 0x30)} | {c: None for c in (*range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F))}
_TABLE |= {ord(c): None for c in "​‌‍﻿­‘’“”„«»‹›¿¡·•"} | {ord(c): " " for c in _BREAKS}


def words_of(text: str) -> list[str]:
    """Words without case, punctuation and markup."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return text.lower().translate(_TABLE).split()


def pieces_of(words: list[str], size: int = PIECE) -> list[tuple[int, str]]:
    """(first word, piece) of the consecutive pieces of an item."""
    return [(p, " ".join(words[p : p + size])) for p in range(0, len(words) - size + 1, size)]


def _verify(item: list[str], doc: list[str], p: int, q: int) -> bool:
    """Whether a passage of the item that holds the piece at p is repeated around word q.

    Words at the ends of a passage may be changed like others: each adds a word and an edit.
    """
    most = len(item) // 10
    after, behind = p + PIECE, q + PIECE
    left = _reach(item[:p][::-1], doc[max(0, q - p - most) : q][::-1], most)
    right = _reach(item[after:], doc[behind : behind + len(item) - after + most], most)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            n = a + PIECE + b
            # edits of its own, and changed words at its ends as far as item and document go on there
            spare = min(p - a, q - a - i) + min(len(item) - after - b, len(doc) - behind - b - j)
            ends = max(0, PASSAGE - n)
            if i + j + ends <= (n + ends) // 10 and ends <= max(0, spare):
                return True
    return False


def _reach(pattern: list[str], text: list[str], most: int) -> list[int]:
    """For 0 to ``most`` edits, the longest beginning of the pattern that is so near a beginning of the text and ends with a matching word."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | (1 << i)
    full = (1 << m) - 1
    pv, mv = full, 0
    out = [0] * (most + 1)
    last = 0  # word of the text that matched last
    for n, w in enumerate(text, 1):
        if n - last > most + 1:
            break  # more than ``most`` words of the text in a row without a match
        same = eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        ph = ((ph << 1) | 1) & full  # global at the left end: skipping a word of the text costs one
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        while same:
            bit = same & -same
            same ^= bit
            to = (bit << 1) - 1
            d = n + (pv & to).bit_count() - (mv & to).bit_count()
            if d <= most:
                last = n
                out[d] = max(out[d], bit.bit_length())
    for d in range(most):
        out[d + 1] = max(out[d + 1], out[d])
    return out


def _automaton(items: list[tuple[int, list[str]]]):
    a = ahocorasick.Automaton()
    by: dict[str, list[tuple[int, int]]] = {}
    for k, (_, words) in enumerate(items):
        if len(words) >= PASSAGE:
            for p, piece in pieces_of(words):
                by.setdefault(f" {piece} ", []).append((k, p))
    for piece, where in by.items():
        a.add_word(piece, (len(piece), where))
    if by:
        a.make_automaton()
    return a, items, bool(by)


def _search(state, ids, texts):
    automaton, items, any_ = state
    if not any_:
        return
    for i, text in zip(ids, texts):
        if not text:
            continue
        words = words_of(text)
        if len(words) < PASSAGE - BUDGET:
            continue
        flat = f" {' '.join(words)} "
        found: set[int] = set()
        starts = None
        for end, (size, where) in automaton.iter(flat):
            if all(k in found for k, _ in where):
                continue
            if starts is None:
                starts, at = [], 1
                for w in words:
                    starts.append(at)
                    at += len(w) + 1
            q = bisect_right(starts, end - size + 2) - 1
            for k, p in where:
                if k not in found and _verify(items[k][1], words, p, q):
                    found.add(k)
        for k in found:
            yield i, items[k][0]


def leaks(documents: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id``: each document and test item of which it repeats a passage."""
    spark = documents.sparkSession
    schema = "doc_id long, item_id long"
    numbered = items.where("text is not null and item_id is not null").select("item_id", "text")
    blocks = max(1, -(-(numbered.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    out = None
    for b in range(blocks):
        part = numbered if blocks == 1 else numbered.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        held = [(r["item_id"], words_of(r["text"])) for r in part.collect()]
        if not held:
            continue
        shared = spark.sparkContext.broadcast(held)
        found = map_lists(documents, ["doc_id", "text"], _search, schema, once=lambda s=shared: _automaton(s.value))
        if blocks > 1:  # one block at a time is on the executors
            found = cut(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out.distinct() if out is not None else spark.createDataFrame([], schema)


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per test item the number of documents that repeat a passage of it (zero too)."""
    counts = leaks(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return (
        items.select("item_id", "suite").distinct().join(counts, "item_id", "left")
        .select("item_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents"))
    )
