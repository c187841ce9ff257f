"""Natural language hidden inside code (problem 6).

Method.  Comments and string literals are cut into sentences.  A sentence's language comes
from prediction by partial matching: for each language a context tree holds the characters
seen after contexts of zero to ``ORDER`` characters; the cost of a character is read at the
longest context that the tree knows, with escapes to shorter ones (method C).  The language
of least cross-entropy wins.  A span stays undetermined if a tree trained on code says it in
fewer bits (disabled code, connection strings), or if it costs more than sentences of the
nearest other language usually do (keys, tokens, names): both limits come from the training
rows.  The trees are trained on ``TRAIN_DOCS`` labelled documents a language, of large ones their
share of ``TRAIN_TOTAL``, chosen by a hash of the id, and at most ``TRAIN_CHARS`` characters a language; since declared languages are sometimes
wrong and documents mix languages, training sentences first go to the language under which
their three-character strings are relatively most frequent.

A sentence has six words or more, in Japanese and Chinese twelve characters or more.

Defined results: null and empty texts give no row; scripts that don't parse count, a literal
or comment that never closes runs to the end of the text; equal rows give equal rows; without
any labelled document no row comes out; further columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from lintmill.arrow import map_lists
from lintmill.llm.script_text import language_of
from lintmill.llm.secrets import line_numbers
from lintmill.syntax import lexer as L

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "pl", "ru", "ja", "zh")
ORDER = 4
TRAIN_DOCS = 60  # of each language at least, and
TRAIN_TOTAL = 1_000  # shared out by how many documents bear the label
TRAIN_CHARS = 150_000
MOST_BITS = 7.5  # where there is no other language to tell
HELD = 40  # sentences a language that tell what foreign ones cost
LEAST_WORDS = 6
LEAST_CJK = 12
UNDETERMINED = "und"
_ALPHABET = 4096.0

_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ]")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[^\W\d_]|[\"'(¿¡«„])|(?<=[。！？])")
_CODE_MARK = re.compile(
    r"^\s*(?:SELECT\b.*\bFROM\b|INSERT\s+INTO\b|UPDATE\b.*\bSET\b|DELETE\s+FROM\b|MERGE\s+INTO\b|CREATE\s+(?:OR\s+ALTER\s+)?(?:TABLE|VIEW|PROC|INDEX|FUNCTION|LOGIN|USER)|"
    r"ALTER\s+\w+\s|DROP\s+\w+\s|DECLARE\s+@|SET\s+@|EXEC(?:UTE)?\s|IF\s+@|WHILE\s+@|GRANT\s|BEGIN\s+TRAN)",
    re.IGNORECASE | re.DOTALL,
)
_CODE_CHARS = re.compile(r"[=<>;{}\[\]@#$\\|]|\w\.\w|\w_\w|\(\)|::")
_MARGIN = re.compile(r"^[ \t]*(?:\*|--+|//+|#+)?[ \t]*")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$")
_RULER = re.compile(r"[-=*_#~+/\s]{3,}")


# -- context trees ---------------------------------------------------------


def normal(s: str) -> str:
    """What the trees see: lower case, digits as 0, runs of white space as one blank, a blank at both ends."""
    return " " + re.sub(r"\s+", " ", re.sub(r"\d+", "0", s.lower())).strip() + " "


def train_tree(sentences: list[str], order: int = ORDER) -> dict[str, dict[str, int]]:
    """Counts of the characters after each context of up to ``order`` characters."""
    grams: Counter[str] = Counter()
    for s in sentences:
        t = normal(s)
        for k in range(order + 1):
            grams.update([t[i - k : i + 1] for i in range(max(1, k), len(t))])
    tree: dict[str, dict[str, int]] = {}
    for g, n in grams.items():
        tree.setdefault(g[:-1], {})[g[-1]] = n
    return tree


class Model:
    """Trees of all languages; costs of character-in-context are remembered in a bounded table."""

    def __init__(self, trees: list[dict[str, dict[str, int]]], languages: tuple[str, ...], limits: tuple[float, ...] = (), order: int = ORDER, most: int = 200_000):
        self.trees, self.languages, self.order, self.most = trees, languages, order, most
        self.limits = limits or (MOST_BITS,) * len(languages)
        self.totals = [{k: (sum(v.values()), len(v)) for k, v in t.items()} for t in trees]
        self._reset()

    def _reset(self):
        self.rows: dict[str, int] = {}
        self.costs = np.empty((1024, len(self.trees)), dtype=np.float32)

    def _cost(self, gram: str) -> list[float]:
        out = []
        c, ctx = gram[-1], gram[:-1]
        for tree, totals in zip(self.trees, self.totals):
            bits = 0.0
            k = len(ctx)
            while True:
                node = tree.get(ctx[len(ctx) - k :])
                if node is not None:
                    n, distinct = totals[ctx[len(ctx) - k :]]
                    seen = node.get(c)
                    if seen:
                        bits -= math.log2(seen / (n + distinct))
                        break
                    bits -= math.log2(distinct / (n + distinct))
                if k == 0:
                    bits += math.log2(_ALPHABET)
                    break
                k -= 1
            out.append(bits)
        return out

    def entropies(self, s: str) -> np.ndarray:
        """Cross-entropy in bits a character, for each language."""
        t = normal(s)
        rows, n = self.rows, len(t)
        order = self.order
        grams = [t[max(0, i - order) : i + 1] for i in range(1, n)]
        idx = list(map(rows.get, grams))
        if None in idx:
            if len(rows) + n > self.most:
                self._reset()
                rows = self.rows
                idx = [None] * len(grams)
            for j, r in enumerate(idx):
                if r is None:
                    g = grams[j]
                    r = rows.get(g)
                    if r is None:
                        r = len(rows)
                        if r >= len(self.costs):
                            self.costs = np.concatenate([self.costs, np.empty_like(self.costs)])
                        self.costs[r] = self._cost(g)
                        rows[g] = r
                    idx[j] = r
        return self.costs[idx].sum(axis=0) / max(1, n - 1)

    def classify(self, s: str) -> tuple[str, float]:
        """(language, bits a character); undetermined above the language's limit or where code says it in fewer bits."""
        e = self.entropies(s)
        k = int(e[: len(self.languages)].argmin())
        fits = e[k] <= self.limits[k] and e[k] <= e.min()
        return (self.languages[k] if fits else UNDETERMINED), float(e[k])


# -- spans -----------------------------------------------------------------


#: A span and the places of its stretches, ascending: (offset in the span, offset in the text).
Span = tuple[str, list[tuple[int, int]]]


def place_of(places: list[tuple[int, int]], at: int) -> int:
    """Offset in the text of an offset in a span."""
    a, b = places[bisect_right(places, at, key=lambda p: p[0]) - 1]
    return b + at - a


def _comment_span(tok: str, pos: int) -> Span:
    body = tok[2:]
    if body.endswith("*/"):
        body = body[:-2]
    return body, [(0, pos + 2)]


def _string_span(tok: str, pos: int) -> Span:
    start = 2 if tok[0] in "nN" else 1
    body = tok[start:-1] if tok[-1:] == "'" and len(tok) > start else tok[start:]
    places = [(0, pos + start)]
    for k, m in enumerate(re.finditer("''", body)):
        places.append((m.end() - k - 1, pos + start + m.end()))
    return body.replace("''", "'"), places


def _run_span(run: list[tuple[str, int]]) -> Span:
    places, at = [], 0
    for body, pos in run:
        places.append((at, pos))
        at += len(body) + 1
    return "\n".join(body for body, _ in run), places


def tsql_spans(text: str) -> Iterator[Span]:
    """Comments and string literals; line comments on neighbouring lines make one span."""
    lexemes, _ = L.split(text)
    run: list[tuple[str, int]] = []
    gap = ""
    end = 0
    for tok in lexemes:
        pos, end = end, end + len(tok)
        two = tok[:2]
        if two == "--":
            if run and gap.count("\n") + gap.count("\r") - gap.count("\r\n") > 1:
                yield _run_span(run)
                run = []
            body = tok.lstrip("-")
            run.append((body, end - len(body)))
            gap = ""
            continue
        c = tok[0]
        if c in L.TRIVIA_FIRST:
            gap += tok
            continue
        if run:
            yield _run_span(run)
            run = []
        if two == "/*":
            yield _comment_span(tok, pos)
        elif c == "'" or (c in "nN" and two[1:] == "'"):
            if len(tok) > LEAST_CJK:
                yield _string_span(tok, pos)
    if run:
        yield _run_span(run)


_JSON_STRING = re.compile(r'"([^"\\]*(?:\\.[^"\\]*)*)(?:"(\s*:)?|\\?\Z)', re.DOTALL)
_JSON_ESCAPE = re.compile(r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\.", re.DOTALL)
_XML_NOTE = re.compile(r"<!--(.*?)(?:-->|$)", re.DOTALL)


def _json_span(v: str, pos: int) -> Span:
    places = [(0, pos)]
    if "\\" in v:
        try:
            plain = json.loads('"' + v + '"')
        except ValueError:
            return v, places
        less = 0  # characters by which the value is shorter so far
        for m in _JSON_ESCAPE.finditer(v):
            less += m.end() - m.start() - 1
            places.append((m.end() - less, pos + m.end()))
        v = plain
    return v, places


def markup_spans(text: str, language: str) -> Iterator[Span]:
    """String values of JSON, comments of XML."""
    if language == "xml":
        for m in _XML_NOTE.finditer(text):
            yield m.group(1), [(0, m.start(1))]
        return
    for m in _JSON_STRING.finditer(text):
        if m.group(2) is None and len(m.group(1)) >= LEAST_CJK:
            yield _json_span(m.group(1), m.start(1))


def sentences(span: str) -> Iterator[str]:
    """Sentences of a span: lines without their margin, joined where a line goes on."""
    for s, _, _ in placed_sentences(span):
        yield s


def placed_sentences(span: str) -> Iterator[tuple[str, int, int]]:
    """Each sentence with the offsets in the span of its first character and behind its last."""
    parts: list[str] = []
    starts: list[int] = []  # of the parts in the span
    words = cjk = 0  # of the parts
    end = 0
    for raw in _LINE.findall(span):
        at, end = end, end + len(raw)
        line = raw[_MARGIN.match(raw).end() :]
        at += len(raw) - len(line.lstrip())
        line = line.strip()
        if not line or _RULER.fullmatch(line) or not any(c.isalpha() for c in line):
            if parts:
                yield from _split(parts, starts)
                parts, starts, words, cjk = [], [], 0, 0
            continue
        if parts:
            # a line of capital start after lines that are a sentence already is another one
            enough = words >= LEAST_WORDS or cjk >= LEAST_CJK
            anew = enough and (line[0].isupper() or line[0] in "¿¡" or _CJK.match(line)) and is_long_enough(line)
            if anew or parts[-1][-1] in ".!?。！？:":
                yield from _split(parts, starts)
                parts, starts, words, cjk = [], [], 0, 0
        parts.append(line)
        starts.append(at)
        words += len(_WORDS.findall(line))
        cjk += len(_CJK.findall(line))
    if parts:
        yield from _split(parts, starts)


def _split(parts: list[str], starts: list[int]) -> Iterator[tuple[str, int, int]]:
    text = " ".join(parts)
    _, places = _run_span(list(zip(parts, starts)))
    ends = [(m.start(), m.end()) for m in _SENTENCE_END.finditer(text)] if any(c in text for c in ".!?。！") else []
    a = 0
    for b, after in [*ends, (len(text), len(text))]:
        s = text[a:b]
        if s.strip():
            yield s, place_of(places, a + len(s) - len(s.lstrip())), place_of(places, a + len(s.rstrip()) - 1) + 1
        a = after


def is_long_enough(s: str) -> bool:
    if len(_CJK.findall(s)) >= LEAST_CJK // 2 and len(re.sub(r"\s", "", s)) >= LEAST_CJK:
        return True
    return len(_WORDS.findall(s)) >= LEAST_WORDS


def is_plain(s: str) -> bool:
    """Few marks of code; only what trees are trained on is chosen so, what a script's spans are the trees tell."""
    if _CODE_MARK.match(s) and (_CODE_CHARS.search(s) or s.isupper()):
        return False
    words = _WORDS.findall(s)
    if sum(map(len, words)) < 0.55 * len(s.replace(" ", "")):
        return False
    marks = len(_CODE_CHARS.findall(s))
    return marks * 5 <= len(words) or (marks <= 3 and len(_CJK.findall(s)) >= LEAST_CJK)


def spans_of(text: str, path: str | None) -> Iterator[Span]:
    lang = language_of(path)
    return tsql_spans(text) if lang == "tsql" else markup_spans(text, lang)


# -- training --------------------------------------------------------------


def language_code(column: str):
    """Declared language as one of the codes: case, region and script ignored."""
    return F.lower(F.regexp_extract(F.trim(F.col(column)), r"^([A-Za-z]{2})(?:[-_].*)?$", 1))


def pick(ranked: dict[str, list[tuple[int, int]]], docs: int, total: int) -> dict[int, str]:
    """Ids and labels to train on, of the ``total`` smallest (hash, id) of each label.

    ``docs`` of each label, of large ones their share of ``total``: how many documents bear a label
    is read off how dense its smallest hashes lie.  The bulk of a language must outweigh what bears
    another label by mistake, in each kind of text.
    """
    volume = {}
    for k, hs in ranked.items():
        reach = (max(h for h, _ in hs) + 2**63) / 2**64
        volume[k] = len(hs) if len(hs) < total else (len(hs) - 1) / max(reach, 2**-64)
    everything = sum(volume.values())
    return {i: k for k, hs in ranked.items() for _, i in sorted(hs)[: max(docs, round(total * volume[k] / everything))]}


def training_rows(documents: DataFrame, docs: int = TRAIN_DOCS, chars: int = TRAIN_CHARS, total: int = TRAIN_TOTAL) -> list[tuple[str, str]]:
    """(language, text) of the documents that ``pick`` chooses; bounded by ``total`` + 11 * ``docs``, on the driver.

    One scan of ids and labels (each task keeps ``total`` rows a language before the exchange), one for
    the texts, of which no more than the ``chars`` characters that a tree may be trained on are taken.
    """
    order = Window.partitionBy("code").orderBy("h", "doc_id")
    coded = documents.select("doc_id", language_code("lang").alias("code")).where(F.col("doc_id").isNotNull() & F.col("code").isin(*LANGUAGES))
    ranked: dict[str, list[tuple[int, int]]] = {}
    for r in coded.withColumn("h", F.xxhash64("doc_id")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= total).select("code", "h", "doc_id").collect():
        ranked.setdefault(r["code"], []).append((r["h"], r["doc_id"]))
    ids = pick(ranked, docs, total)
    if not ids:
        return []
    rows = documents.where(F.col("doc_id").isin(list(ids))).where("text is not null").select("doc_id", F.substring("text", 1, chars).alias("text")).collect()
    return sorted((ids[r["doc_id"]], r["text"]) for r in rows)


_FENCE = re.compile(r"```.*?```", re.DOTALL)
_MARKUP = re.compile(r"<[^<>]+>|\[[^\]\n]*\]\([^)\n]*\)|https?://\S+|[#*`|]+")


def train(rows: list[tuple[str, str]], chars: int = TRAIN_CHARS) -> Model | None:
    """Trees of the languages and of code from labelled texts, and the entropy above which a span is no sentence.

    Sentences go to the language whose they are (``relabel``); code is what stands between code
    fences.  The limit of a language is what sentences of its nearest neighbour cost on average in
    its tree: a span that fits no better than foreign text is in none of the languages.
    """
    said: list[tuple[str, str]] = []  # label, sentence
    code: list[str] = []
    coded = 0
    for lang, text in rows:
        if lang not in LANGUAGES:
            continue
        for block in _FENCE.findall(text):
            if coded < chars:
                code += [line for line in block.strip("`").splitlines()[1:] if line.strip()]
                coded += len(block)
        for s in sentences(_MARKUP.sub(" ", _FENCE.sub(" ", text))):
            if is_long_enough(s) and is_plain(s):
                said.append((lang, s))
    by: dict[str, list[str]] = {k: [] for k in LANGUAGES}
    for (_, s), lang in zip(said, relabel(said)):
        by[lang].append(s)
    for k, own in by.items():  # up to ``chars`` characters, from all documents
        own.sort(key=lambda s: zlib.crc32(s.encode()))
        by[k] = own[: bisect_right(list(accumulate(map(len, own))), chars)]
    langs = tuple(k for k in LANGUAGES if by[k])
    if not langs:
        return None
    trees = [train_tree(by[k]) for k in langs]
    model = Model(trees + ([train_tree(code)] if code else []), langs)
    bits = np.array([np.mean([model.entropies(s)[: len(langs)] for s in by[k][:: max(1, len(by[k]) // HELD)]], axis=0) for k in langs])
    np.fill_diagonal(bits, np.inf)
    model.limits = tuple(float(b) for b in bits.min(axis=0)) if len(langs) > 1 else (MOST_BITS,)
    return model


def relabel(said: list[tuple[str, str]], rounds: int = 2) -> list[str]:
    """The language of each labelled sentence by the relative frequencies of its three-character strings.

    Declared languages are sometimes wrong and documents mix languages.  Relative frequencies know
    the base rate that cross-entropy doesn't: foreign passages are the smaller part of a label.
    """
    if not said:
        return []
    langs = sorted({k for k, _ in said})
    labels = np.array([langs.index(k) for k, _ in said])
    grams = []
    for _, s in said:
        points = np.frombuffer(normal(s).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        grams.append((points[:-2] << 42) + (points[1:-1] << 21) + points[2:])
    sizes = np.array([len(g) for g in grams])
    _, ids = np.unique(np.concatenate(grams), return_inverse=True)
    kinds = int(ids.max()) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for _ in range(rounds):
        counts = np.bincount(ids * len(langs) + np.repeat(labels, sizes), minlength=kinds * len(langs)).reshape(kinds, len(langs)) + 0.5
        logs = np.log(counts / counts.sum(axis=0))
        labels = np.stack([np.add.reduceat(logs[:, k][ids], starts) for k in range(len(langs))]).argmax(axis=0)
    return [langs[k] for k in labels]


# -- operators -------------------------------------------------------------


def found_sentences(model: Model, text: str, path: str | None) -> Iterator[tuple[int, int, str, str, float]]:
    """(start, end, sentence, language, bits a character) of each sentence, ``und`` where no language fits."""
    for span, places in spans_of(text, path):
        if len(span) < LEAST_CJK or not is_long_enough(span):
            continue
        for s, a, b in placed_sentences(span):
            if is_long_enough(s):
                yield place_of(places, a), place_of(places, b - 1) + 1, s, *model.classify(s)


def _text_rows(model, ids, paths, texts):
    for i, path, text in zip(ids, paths, texts):
        if text:
            found = sorted(found_sentences(model, text, path))
            for (a, b, s, lang, bits), n in zip(found, line_numbers(text, [f[0] for f in found])):
                yield i, n, a, b - a, s.strip(), lang, bits, len(s) / len(text)


def _share_rows(model, ids, paths, texts):
    for i, path, text in zip(ids, paths, texts):
        if not text:
            continue
        chars: dict[str, int] = {}
        count: dict[str, int] = {}
        for _, _, s, lang, _ in found_sentences(model, text, path):
            chars[lang] = chars.get(lang, 0) + len(s)
            count[lang] = count.get(lang, 0) + 1
        for lang in sorted(chars):
            yield i, lang, count[lang], chars[lang], chars[lang] / len(text)


_TEXTS = "script_id long, line_no long, start long, length long, text string, lang string, bits double, share double"
_SHARES = "script_id long, lang string, sentences int, chars long, share double"


def _judged(scripts: DataFrame, documents: DataFrame, docs: int, rows, schema: str) -> DataFrame:
    model = train(training_rows(documents, docs))
    if model is None:
        return scripts.sparkSession.createDataFrame([], schema)
    shared = scripts.sparkSession.sparkContext.broadcast((model.trees, model.languages, model.limits, model.order))  # bounded by TRAIN_CHARS a language

    def once():
        return Model(*shared.value)

    return map_lists(scripts, ["script_id", "file_path", "text"], rows, schema, once=once)


def language_texts(scripts: DataFrame, documents: DataFrame, docs: int = TRAIN_DOCS) -> DataFrame:
    """Each sentence with its place, language, bits a character and share of its script; one pass, no shuffle.

    ``line_no``, ``start`` and ``length`` are of the stretch of the script from the first to the last
    character of the sentence (zero-based, in characters); ``text`` is the sentence without line
    breaks, margins and escapes.  ``und`` where no language fits.
    """
    return _judged(scripts, documents, docs, _text_rows, _TEXTS)


def language_shares(scripts: DataFrame, documents: DataFrame, docs: int = TRAIN_DOCS) -> DataFrame:
    """The sentences of ``language_texts`` summed per script row: ``script_id, lang, sentences, chars, share``."""
    return _judged(scripts, documents, docs, _share_rows, _SHARES)


def languages_found(scripts: DataFrame, documents: DataFrame) -> DataFrame:
    """``script_id, lang``: one row per script and language of at least one sentence."""
    return language_shares(scripts, documents).where(F.col("lang") != UNDETERMINED).select("script_id", "lang").distinct()
