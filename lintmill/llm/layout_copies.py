"""Duplicates hidden by formatting differences (problem 3).

Method.  Every script is brought to canonical bytes: lexemes without white space, byte-order
mark, terminators, separators and identifier quotes, in one letter case; the fields whose
order doesn't count (select lists, table definitions, JSON members, XML attributes) sorted.
Each input partition first counts its own scripts in a trie with terminal counters, which
leaves one row per distinct script and partition (and per ``LIST_IDS`` ids) however many
copies there are.  Buckets are then split by the canonical bytes, recursively: all rows are one
bucket; of a bucket of more than ``BUCKET_ROWS`` rows (or one in ``MOST_BUCKETS`` of all) that
holds different scripts, and only of such, the rows are parted by twice as many leading bytes, until
each fits.  What is sent to the executors are the prefixes of oversized buckets, at most
``MOST_BUCKETS`` a level.  Each bucket is counted in a trie whose terminals hold the ids.  Texts
stay where they are: a row travels as its bucket, the 32-byte digest of its canonical bytes and
its ids, so the tries branch on the bytes of the digest.

A set of copies of more than ``HOT_ROWS`` rows that holds more than one in ``MOST_HOT`` of all doesn't
travel at all: its smallest id, a minimum of minima, is sent to where its rows are.  There are fewer than
``MOST_HOT`` such sets; all others are too small to hold up a task.

Defined results: null text equals nothing and forms no set; empty texts are copies of each
other within a language; equal ids are one member; a text that doesn't parse is compared
lexeme by lexeme; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill.arrow import spread
from lintmill.llm.script_text import language_of
from lintmill.session import cut
from lintmill.syntax import lexer as L
from lintmill.syntax.parser import KINDS

BUCKET_ROWS = 2_000
MOST_BUCKETS = 10_000
MOST_HOT = 10_000
HOT_ROWS = 1_000
LIST_IDS = 1_000
HOLD_CHARS = 32_000_000  # canonical characters that a task holds before it hands its counts on
_WORD = re.compile(r"\w+")
_SPACE = re.compile(r"\s+")
_SEP, _FIELD = "\x1f", "\x1e"
_LIST_END = frozenset("FROM INTO WHERE GROUP HAVING ORDER UNION EXCEPT INTERSECT FOR OPTION WITH GO".split())
_STATEMENT = frozenset("SELECT INSERT UPDATE DELETE MERGE CREATE ALTER DROP EXEC EXECUTE DECLARE SET IF WHILE BEGIN END PRINT RAISERROR THROW RETURN COMMIT ROLLBACK ELSE".split())


def _literal(tok: str) -> str:
    return _SPACE.sub(" ", tok)


def _plain(tok: str, kind: str) -> str:
    if kind == "QID":
        q = tok[-1]
        return tok[1:-1].replace(q + q, q)
    return _literal(tok) if kind == "STR" else tok


def canonical_tsql(text: str) -> str:
    """Lexemes in order, fields of select lists and table definitions sorted."""
    lexemes, _ = L.split(text)
    items: list[tuple[str, str]] = []
    for tok, kind in zip(lexemes, map(KINDS.__getitem__, lexemes)):
        if kind == "--":
            words = _WORD.findall(tok)
            if words:
                items.append(("--", _SEP.join(words)))
        elif kind and kind != "\n" and kind != ";":
            items.append((kind, _plain(tok, kind)))
    out: list[str] = []
    try:
        _emit(items, 0, len(items), out)
    except RecursionError:  # nested too deeply for SQL Server, too: compared lexeme by lexeme
        out = [x for k, x in items if k != ","]
    return _SEP.join(out).casefold()


def _close(items, i: int, end: int) -> int:
    """Index of the parenthesis that closes the one at i, or end."""
    depth = 0
    for j in range(i, end):
        k = items[j][0]
        if k == "(":
            depth += 1
        elif k == ")":
            depth -= 1
            if depth == 0:
                return j
    return end


def _emit(items, i: int, end: int, out: list[str]) -> None:
    while i < end:
        kind, text = items[i]
        if kind == "SELECT":
            out.append(text)
            i += 1
            while i < end and items[i][0] in ("DISTINCT", "ALL"):
                out.append(items[i][1])
                i += 1
            if i < end and items[i][0] == "TOP":
                stop = _close(items, i + 1, end) + 1 if i + 1 < end and items[i + 1][0] == "(" else min(end, i + 2)
                out.extend(x for _, x in items[i:stop])
                i = stop
            j = _list_end(items, i, end)
            _sorted_fields(items, i, j, out)
            i = j
        elif kind == "TABLE":
            j = i + 1
            while j < end and items[j][0] in ("ID", "QID", ".", "VAR", "--") or (j < end and j == i + 1 and items[j][0] not in ("(", ")", "SELECT") and items[j][0].isalpha()):
                j += 1
            out.extend(x for _, x in items[i:j])
            i = j
            if i < end and items[i][0] == "(":
                j = _close(items, i, end)
                out.append("(")
                _sorted_fields(items, i + 1, j, out)
                i = j
        else:
            if kind != ",":
                out.append(text)
            i += 1


def _list_end(items, i: int, end: int) -> int:
    depth = case = 0
    for j in range(i, end):
        k = items[j][0]
        if k == "(":
            depth += 1
        elif k == ")":
            if depth == 0:
                return j
            depth -= 1
        elif depth == 0:
            if k == "CASE":
                case += 1
            elif k == "END" and case:
                case -= 1
            elif not case and (k in _LIST_END or (k in _STATEMENT and j > i)):
                return j
    return end


def _sorted_fields(items, i: int, end: int, out: list[str]) -> None:
    fields: list[str] = []
    notes: list[str] = []
    depth = 0
    j = i
    part: list = []
    while j <= end:
        k = items[j][0] if j < end else ","
        if k == "(":
            depth += 1
        elif k == ")":
            depth -= 1
        if (k == "," and depth == 0) or j == end:
            inner: list[str] = []
            _emit(part, 0, len(part), inner)
            fields.append(_SEP.join(inner).casefold())
            part = []
        elif k == "--":
            notes.append(items[j][1].casefold())
        else:
            part.append(items[j])
        j += 1
    fields.sort()
    out.append(_FIELD.join(fields))
    out.extend(sorted(notes))


def _canonical_value(v) -> str:
    if isinstance(v, _Object):
        return "{" + _FIELD.join(sorted((json.dumps(k, ensure_ascii=False) + ":" + _canonical_value(x)).casefold() for k, x in v.pairs)) + "}"
    if isinstance(v, list):
        return "[" + _FIELD.join(map(_canonical_value, v)) + "]"
    if isinstance(v, str):
        return json.dumps(_SPACE.sub(" ", v), ensure_ascii=False)
    return json.dumps(v)


class _Object:
    def __init__(self, pairs):
        self.pairs = pairs


def canonical_json(text: str) -> str | None:
    """Members sorted, numbers as written; None if the text doesn't parse."""
    try:
        v = json.loads(text.lstrip("﻿"), object_pairs_hook=_Object, parse_float=lambda s: ["\x01" + s], parse_int=lambda s: ["\x01" + s])
        return _canonical_value(v).casefold()
    except (ValueError, RecursionError):
        return None


_TAG = re.compile(r"<!--(?P<note>.*?)-->|<(?P<name>[/?!]?[\w.:-]+)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+|<)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([\w.:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'/>]+))|([^\s=/]+)")


def canonical_xml(text: str) -> str:
    """Tags, texts and notes in order, attributes sorted."""
    out = []
    for m in _TAG.finditer(text.lstrip("﻿")):
        if m.group("note") is not None:
            out.extend(_WORD.findall(m.group("note")))
        elif m.group("name") is not None:
            attrs = sorted(
                ((a.group(1) or a.group(5) or "") + "=" + _SPACE.sub(" ", next((x for x in a.group(2, 3, 4) if x is not None), ""))).casefold()
                for a in _ATTRIBUTE.finditer(m.group("attrs"))
            )
            name = m.group("name")
            out.append("<" + name + _FIELD + _FIELD.join(attrs))
            if name[0] not in "/?!" and m.group("attrs").rstrip().endswith("/"):
                out.append("</" + name + _FIELD)
        else:
            out.extend(re.findall(r"\w+|[<>&]", m.group("text")))
    return _SEP.join(out).casefold()


def canonical(text: str, language: str) -> str:
    """Canonical text of a script in its language."""
    if language == "json":
        c = canonical_json(text)
        if c is None:
            c = _SEP.join(re.findall(r"\w+|[^\w\s,;\"'\[\]﻿]", text)).casefold()
    elif language == "xml":
        c = canonical_xml(text)
    else:
        c = canonical_tsql(text)
    return language + _SEP + c


def canonical_bytes(text: str, language: str) -> bytes:
    return canonical(text, language).encode("utf-8", "surrogatepass")


def radix_key(text: str, language: str) -> bytes:
    return hashlib.blake2b(canonical_bytes(text, language), digest_size=32).digest()


class Trie:
    """Byte trie with terminal counters: a terminal is [key, ids, what came with the key first]; a branch appears only where keys part."""

    def __init__(self):
        self.root: dict = {}

    def add(self, key: bytes, ids: list[int], note=None) -> bool:
        """Whether the key is new."""
        at, d = self.root, 0
        while True:
            b = key[d]
            x = at.get(b)
            if x is None:
                at[b] = [key, ids, note]
                return True
            if x.__class__ is list:
                if x[0] == key:
                    x[1] += ids
                    return False
                at[b] = {x[0][d + 1]: x}
                x = at[b]
            at, d = x, d + 1

    def terminals(self) -> Iterator[list]:
        stack = [self.root]
        while stack:
            for x in stack.pop().values():
                if x.__class__ is list:
                    yield x
                else:
                    stack.append(x)


_COUNTED = "canon binary, key binary, ids array<long>"
_COUNTED_ARROW = pa.schema([("canon", pa.binary()), ("key", pa.binary()), ("ids", pa.list_(pa.int64()))])
_MEMBER_ARROW = pa.schema([("first_id", pa.int64()), ("copy_id", pa.int64())])
_GROUP_ARROW = pa.schema([("first_id", pa.int64()), ("copies", pa.int64())])


def _flat(rows: Iterator[tuple], schema: pa.Schema, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _counted(t: Trie) -> Iterator[tuple]:
    for key, ids, canon in t.terminals():
        for k in range(0, len(ids), LIST_IDS):
            yield canon, key, ids[k : k + LIST_IDS]


def _count_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct scripts of a partition with their ids; handed on whenever HOLD_CHARS are held."""
    t, held = Trie(), 0
    for b in batches:
        for i, path, text in zip(*(b.column(k).to_pylist() for k in range(3))):
            if text is None or i is None:
                continue
            canon = canonical_bytes(text, language_of(path))
            if t.add(hashlib.blake2b(canon, digest_size=32).digest(), [i], canon):
                held += len(canon)
            if held > HOLD_CHARS:
                yield from _flat(_counted(t), _COUNTED_ARROW, 1_000)
                t, held = Trie(), 0
    yield from _flat(_counted(t), _COUNTED_ARROW, 1_000)


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Terminals of the tries of a partition's buckets."""
    tries: dict[int, Trie] = {}
    for b in batches:
        for bucket, key, ids in zip(*(b.column(k).to_pylist() for k in range(3))):
            tries.setdefault(bucket, Trie()).add(key, ids)
    for t in tries.values():
        yield from t.terminals()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for _, ids, _ in _tries(batches):
            first = min(ids)
            yield from ((first, i) for i in set(ids) if i != first)

    yield from _flat(rows(), _MEMBER_ARROW)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _flat(((min(ids), len(ids)) for _, ids, _ in _tries(batches)), _GROUP_ARROW)


def local_counts(scripts: DataFrame) -> DataFrame:
    """``canon, key, ids``: each input partition's distinct scripts, written to the shared folder."""
    return cut(spread(scripts.select("script_id", "file_path", "text")).mapInArrow(_count_local, _COUNTED))


def split_buckets(counted: DataFrame, rows: int, bucket_rows: int, most_buckets: int = MOST_BUCKETS) -> tuple[DataFrame, list[int]]:
    """The rows with ``bucket``, and how many buckets were split at each level."""
    fits = max(bucket_rows, rows // most_buckets)
    out = counted.select("key", "ids", "canon", F.lit(b"").alias("bucket"), F.lit(rows > fits).alias("over"))
    if rows <= fits:
        return out.drop("canon", "over"), []
    split, depth = [1], 8
    open_ = counted.select("key", "canon")
    while True:
        head = F.substring("canon", 1, depth)
        full = (
            open_.groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("b"))
            .where((F.col("n") > fits) & (F.col("a") != F.col("b"))).select("head").collect()
        )
        over = counted.sparkSession.createDataFrame([(r["head"],) for r in full], "head binary")  # rows / fits of them at most
        out = out.withColumn("head", head).join(F.broadcast(over.withColumn("more", F.lit(True))), "head", "left")
        # a row of an oversized bucket goes to one of longer prefix; it stays open if that is oversized too
        out = out.select("key", "ids", "canon", F.when(F.col("over"), F.col("head")).otherwise(F.col("bucket")).alias("bucket"), (F.col("over") & F.col("more").isNotNull()).alias("over"))
        if not full:
            return out.drop("canon", "over"), split
        open_ = open_.withColumn("head", head).join(F.broadcast(over), "head", "left_semi").drop("head")
        split.append(len(full))
        depth *= 2


def copy_sets(scripts: DataFrame, bucket_rows: int = BUCKET_ROWS, most_hot: int = MOST_HOT, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows ``key, first_id, copies`` of the hot sets, their rows ``key, ids``, rows ``bucket, key, ids`` of all others)."""
    counted = local_counts(scripts)
    total, rows = counted.agg(F.sum(F.size("ids")), F.count(F.lit(1))).first()
    sums = counted.groupBy("key").agg(F.min(F.array_min("ids")).alias("first_id"), F.sum(F.size("ids")).cast("long").alias("copies"))
    hot = [tuple(r) for r in sums.where(F.col("copies") > max(hot_rows, (total or 0) / most_hot)).collect()]  # fewer than most_hot
    sets = scripts.sparkSession.createDataFrame(hot, "key binary, first_id long, copies long")
    bucketed, _ = split_buckets(counted.join(F.broadcast(sets), "key", "left_anti") if hot else counted, rows, bucket_rows)
    dealt = bucketed.select(F.xxhash64("bucket").alias("bucket"), "key", "ids").repartition("bucket")
    return sets, counted.select("key", "ids").join(F.broadcast(sets), "key"), dealt


def layout_copies(scripts: DataFrame, bucket_rows: int = BUCKET_ROWS, most_hot: int = MOST_HOT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``first_id, copy_id``: one row per member of a set of copies but the one with the smallest id."""
    _, hot, dealt = copy_sets(scripts, bucket_rows, most_hot, hot_rows)
    of_hot = hot.select("first_id", F.explode("ids").alias("copy_id")).where("first_id <> copy_id").distinct()  # equal ids; dealt by both columns
    return dealt.mapInArrow(_members, "first_id long, copy_id long").unionByName(of_hot)


def distinct_scripts(scripts: DataFrame, bucket_rows: int = BUCKET_ROWS, most_hot: int = MOST_HOT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``first_id, copies``: one row per distinct script with the number of its copies (itself included)."""
    sets, _, dealt = copy_sets(scripts, bucket_rows, most_hot, hot_rows)
    return dealt.mapInArrow(_groups, "first_id long, copies long").unionByName(sets.select("first_id", "copies"))
