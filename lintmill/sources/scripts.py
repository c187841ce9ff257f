"""Sources and sinks of scripts: directories, texts, rulesets; decoding, encoding and writing back."""

from __future__ import annotations

import codecs
import fnmatch
import posixpath
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintmill.arrow import map_lists

MAX_BYTES = 10 * 1024 * 1024
#: Byte-order marks, the codec of what follows and the name under which a text is written with its mark again.
_MARKS = (
    (codecs.BOM_UTF8, "utf-8", "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32-le", "utf-32-le-sig"), (codecs.BOM_UTF32_BE, "utf-32-be", "utf-32-be-sig"),
    (codecs.BOM_UTF16_LE, "utf-16-le", "utf-16-le-sig"), (codecs.BOM_UTF16_BE, "utf-16-be", "utf-16-be-sig"),
)
_OTHERS = {"cp1252": "cp1252", "shift_jis": "cp932", "euc_jp": "euc_jp", "gb18030": "gb18030", "cp1251": "cp1251"}  # name and codec
_JAPANESE = re.compile(r"[぀-ヿ]+")
_HAN = re.compile(r"[㐀-鿿]+")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]+")
_HALF_KANA = re.compile(r"[｡-ﾟ]+")
_LATIN = re.compile(r"[À-ÖØ-öø-ÿŒœŠšŽžŸ]")
_SIGNS = frozenset("€‚„…†‡‰‹‘’“”•–—™›¡¢£¥§©«®°±²³µ¶·¹º»¼½¾¿")


def _level_one(c: str, name: str) -> bool:
    """Whether an ideograph is among the frequent ones that the code page lists first."""
    codec, low, high = ("gb2312", 0xB0, 0xD7) if name == "gb18030" else ("cp932", 0x88, 0x97)
    try:
        return low <= c.encode(codec)[0] <= high
    except UnicodeEncodeError:
        return False


def _plausible(text: str, name: str) -> float:
    """How much the characters beyond ASCII look like writing: runs of one script, not lone signs among other letters."""
    far = [c for c in text if c > "\x7f"]
    good = 0.0
    if name in ("shift_jis", "euc_jp", "gb18030"):
        han = [m.group() for m in _HAN.finditer(text)]
        run = 0.0
        for m in re.finditer(r"[぀-ヿ㐀-鿿、。「」・ー！？（）]+", text):
            beside = text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
            run += len(m.group()) if len(m.group()) > 1 else -1 if any(c.isascii() and c.isalpha() for c in beside) else 0.5
        kana = sum(len(m.group()) for m in _JAPANESE.finditer(text))
        good = run - 1.5 * sum(not _level_one(c, name) for h in han for c in h) - sum(len(m.group()) for m in _HALF_KANA.finditer(text))
        good += (0.5 if name != "gb18030" else -1.5) * kana
        good -= sum(c not in "、。「」・ー！？（）" and not ("぀" <= c <= "ヿ" or "㐀" <= c <= "鿿") for c in far)
    elif name == "cp1251":
        for m in _CYRILLIC.finditer(text):
            w = m.group()
            odd = sum(a.islower() and b.isupper() for a, b in zip(w, w[1:]))
            good += len(w) - 2 * odd if len(w) > 1 else -1
        good -= sum(not "Ѐ" <= c <= "ӿ" and c not in "–—«»„“”…№ " for c in far)
    else:
        for i, c in enumerate(text):
            if c > "\x7f":
                beside = text[i - 1 : i] + text[i + 1 : i + 2]
                letter = _LATIN.match(c) is not None
                good += 1.2 if letter and (any(x.isascii() and x.isalpha() for x in beside) or not beside.strip(" '")) else 0.3 if c in _SIGNS else -1
    return good / max(1, len(far))


def decode(raw: bytes) -> tuple[str, str]:
    """(text, encoding): a byte-order mark decides, then UTF-8 if all is valid, then the most plausible of the old code pages."""
    for mark, codec, name in _MARKS:
        if raw.startswith(mark):
            return raw[len(mark) :].decode(codec, "replace"), name
    try:
        return raw.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        pass
    best = None
    for name, codec in _OTHERS.items():
        try:
            text = raw.decode(codec)
        except UnicodeDecodeError:
            continue
        score = _plausible(text, name)
        if best is None or score > best[0]:
            best = score, text, name
    return best[1:] if best else (raw.decode("latin-1"), "latin-1")


def encode(text: str, encoding: str | None) -> bytes:
    """The bytes of a text in the encoding that ``decode`` named; what it can't hold goes to UTF-8 with a mark."""
    for mark, codec, name in _MARKS:
        if encoding == name:
            return mark + text.encode(codec, "surrogatepass")
    try:
        return text.encode(_OTHERS.get(encoding, encoding) or "utf-8")
    except (UnicodeEncodeError, LookupError):
        return codecs.BOM_UTF8 + text.encode("utf-8", "surrogatepass")


def ignore_patterns(text: str) -> list[str]:
    """Globs of an ignore file: one a line, # starts a comment."""
    return [x for x in (line.split("#", 1)[0].strip() for line in text.splitlines()) if x]


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression; ``**`` crosses directories, letter case doesn't count."""
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", pattern):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"(?i)(?:^|/){out}$"


def matches(path: str, pattern: str) -> bool:
    return re.search(glob_regex(pattern), path.replace("\\", "/")) is not None or fnmatch.fnmatch(path.lower(), pattern.lower())


def any_case(pattern: str) -> str:
    """A file glob that doesn't mind the case of letters."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() and c.lower() != c.upper() else c for c in pattern)


_SCRIPTS = "script_id long, file_path string, text string, encoding string, n_bytes long"


def _decoded(files: DataFrame) -> DataFrame:
    def run(ids, paths, contents, lengths):
        for i, p, c, n in zip(ids, paths, contents, lengths):
            text, name = decode(bytes(c))
            yield i, p, text, name, n

    return map_lists(files.withColumn("script_id", F.xxhash64("path")), ["script_id", "path", "content", "length"], run, _SCRIPTS)


def read_directory(
    spark: SparkSession, directory: str, ignore: list[str] | None = None, max_bytes: int = MAX_BYTES, pattern: str = "*.sql"
) -> tuple[DataFrame, DataFrame]:
    """(scripts ``script_id, file_path, text, encoding, n_bytes``, rejected ``file_path, reason``) of a directory tree.

    The id is a hash of the path.  The size limit is part of the scan, so large files are not read; files
    that vanish meanwhile are skipped.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", any_case(pattern)).option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(directory)
    )
    if ignore:
        files = files.where(~F.col("path").rlike("|".join(f"(?:{glob_regex(p)})" for p in ignore)))
    rejected = files.where(F.col("length") > max_bytes).select(F.col("path").alias("file_path"), F.lit("too large").alias("reason"))
    return _decoded(files.where(F.col("length") <= max_bytes)), rejected


def read_files(spark: SparkSession, paths: list[str], max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """As ``read_directory`` for named files; those that don't exist are rejected as ``not found``."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            there.append(p)
    gone = spark.createDataFrame([(p, "not found") for p in paths if p not in there], "file_path string, reason string")
    if not there:
        return spark.createDataFrame([], _SCRIPTS), gone
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(there)
    rejected = files.where(F.col("length") > max_bytes).select(F.col("path").alias("file_path"), F.lit("too large").alias("reason"))
    return _decoded(files.where(F.col("length") <= max_bytes)), rejected.unionByName(gone)


def write_scripts(scripts: DataFrame, directory: str | None = None) -> DataFrame:
    """Write ``file_path, text, encoding``, each in its encoding; one row ``file_path, n_bytes, error`` per script.

    Paths are those of the rows, below ``directory`` if one is given.  A file is written beside its place
    and then moved there, so a task that is repeated or lost leaves no half file.  The folders must be
    shared by the executors.  Nothing is written before the result is asked for; null texts are left out.
    """
    import pyarrow.fs as fs

    def run(paths, texts, encodings):
        for p, t, e in zip(paths, texts, encodings):
            if t is None or not p:
                continue
            to = posixpath.join(directory, p.replace("\\", "/").lstrip("/")) if directory else p
            try:
                system, path = fs.FileSystem.from_uri(to) if re.match(r"[a-z][a-z0-9+.-]+:/", to) else (fs.LocalFileSystem(), to)
                raw = encode(t, e)
                system.create_dir(posixpath.dirname(path), recursive=True)
                beside = f"{path}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(beside) as out:
                    out.write(raw)
                system.move(beside, path)
                yield p, len(raw), None
            except (OSError, ValueError) as error:
                yield p, 0, str(error)

    return map_lists(scripts, ["file_path", "text", "encoding"], run, "file_path string, n_bytes long, error string")


def write_changed(rewritten: DataFrame, scripts: DataFrame, text: str = "fixed_text", directory: str | None = None) -> DataFrame:
    """Write what ``fix`` or ``format_scripts`` changed, in the encoding of the original; scripts left as they were aren't touched."""
    changed = rewritten.where("changed").select("script_id", F.col(text).alias("text"))
    return write_scripts(changed.join(scripts.select("script_id", "file_path", "encoding"), "script_id"), directory)


def from_texts(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """Scripts from (path, text) pairs, as of standard input; ids are positions."""
    rows = [(i, p, t, "utf-8", len(t.encode("utf-8", "surrogatepass"))) for i, (p, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "script_id long, file_path string, text string, encoding string, n_bytes long")


def within_size(scripts: DataFrame, max_bytes: int) -> DataFrame:
    return scripts.where(F.col("n_bytes") <= max_bytes)


def read_ruleset(spark: SparkSession, path: str) -> DataFrame:
    """``rule_id, severity`` of a ruleset file, later duplicates win."""
    raw = spark.read.option("multiLine", "true").schema("rules array<struct<id: string, severity: string>>").json(path)
    rows = raw.select(F.posexplode("rules").alias("pos", "r"))
    return rows.groupBy(F.col("r.id").alias("rule_id")).agg(F.max_by("r.severity", "pos").alias("severity"))
