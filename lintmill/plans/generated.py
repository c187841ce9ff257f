"""Queries over generated scripts: every customer gets one of a list of texts, so what must come out is known in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintmill.operators import format as fmt
from lintmill.operators import lint as ops
from lintmill.plans.rule_cases import CASES, expected
from lintmill.plans.tables import tsql_scripts
from lintmill.rules.catalog import RULES, Rule, preset
from lintmill.rules.engine import Options
from lintmill.rules.model import Finding
from lintmill.rules.rulesets import Ruleset
from lintmill.session import shared_folder, table
from lintmill.sources.scripts import read_directory, write_changed, write_scripts


def corpus(spark: SparkSession, d: str, texts: list[str]) -> DataFrame:
    """``script_id, file_path, text``: customer k gets text k mod n, with {k} replaced."""
    c = table(spark, d, "customer")
    pick = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.pmod(F.col("c_custkey"), F.lit(len(texts))) + 1).cast("int"))
    return c.select(
        F.col("c_custkey").alias("script_id"),
        F.concat(F.lit("gen/"), F.col("c_custkey"), F.lit(".sql")).alias("file_path"),
        F.replace(pick, F.lit("{k}"), F.col("c_custkey").cast("string")).alias("text"),
    )


def quote(s: str) -> str:
    """SQL literal; line breaks and tabs through chr()."""
    out = "'" + s.replace("'", "''") + "'"
    for c, code in (("\r", 13), ("\n", 10), ("\t", 9)):
        out = out.replace(c, f"' || chr({code}) || '")
    return f"({out})" if "||" in out else out


def case_sql(column: str, texts: list[str]) -> str:
    """The text of every customer as SQL."""
    n = len(texts)
    whens = " ".join(f"WHEN {i} THEN replace({quote(t)}, '{{k}}', CAST(c_custkey AS VARCHAR))" for i, t in enumerate(texts))
    return f"SELECT c_custkey AS script_id, CASE c_custkey % {n} {whens} END AS {column} FROM customer"


def rule_query(rule: str) -> Callable:
    texts = [expected(m)[0] for m in CASES[rule]]

    def run(spark: SparkSession, d: str) -> DataFrame:
        found = ops.lint(corpus(spark, d, texts), Options(ruleset=Ruleset.of_rule(rule)))
        return found.select("script_id", "code", "start_line", "start_char")

    return run


def rule_sql(rule: str) -> str:
    cases = CASES[rule]
    rows = [f"({i}, {line}, {char})" for i, m in enumerate(cases) for line, char in expected(m)[1]]
    return (
        f"SELECT c_custkey AS script_id, '{rule}' AS code, v.l AS start_line, v.c AS start_char FROM customer "
        f"JOIN (VALUES {', '.join(rows)}) AS v(t, l, c) ON c_custkey % {len(cases)} = v.t"
    )


#: Texts before and after the fixes of one rule.
FIXES: dict[str, list[tuple[str, str]]] = {
    "avoid-null-comparison": [
        ("SELECT a FROM dbo.t WHERE a = NULL AND b <> NULL;", "SELECT a FROM dbo.t WHERE a IS NULL AND b IS NOT NULL;"),
        ("IF NULL != @x SELECT {k};", "IF @x IS NOT NULL SELECT {k};"),
        ("SELECT a FROM dbo.t WHERE NULL = NULL;", "SELECT a FROM dbo.t WHERE NULL = NULL;"),
    ],
    "escape-keyword-identifier": [("SELECT value, {k} FROM dbo.role;", "SELECT [value], {k} FROM dbo.[role];"), ("SELECT a FROM dbo.t;", "SELECT a FROM dbo.t;")],
    "semantic-data-type-length": [
        ("DECLARE @x VARCHAR, @y nchar;", "DECLARE @x VARCHAR(50), @y nchar(1);"),
        ("CREATE TABLE dbo.t{k} (a VARBINARY NOT NULL);", "CREATE TABLE dbo.t{k} (a VARBINARY(50) NOT NULL);"),
    ],
    "semantic-unicode-string": [("DECLARE @x VARCHAR(10); SET @x = 'Grün {k}';", "DECLARE @x NVARCHAR(10); SET @x = 'Grün {k}';")],
    "normalize-execute-keyword": [("EXEC dbo.p {k};\nexec dbo.q;", "EXECUTE dbo.p {k};\nEXECUTE dbo.q;")],
    "normalize-inequality-operator": [("SELECT a FROM dbo.t WHERE a != {k} AND b<>1;", "SELECT a FROM dbo.t WHERE a <> {k} AND b<>1;")],
    "normalize-procedure-keyword": [("CREATE PROC dbo.p{k} AS SELECT 1;", "CREATE PROCEDURE dbo.p{k} AS SELECT 1;"), ("drop proc dbo.p;", "drop PROCEDURE dbo.p;")],
    "normalize-transaction-keyword": [
        ("BEGIN TRAN;\nSELECT {k};\nCOMMIT;", "BEGIN TRANSACTION;\nSELECT {k};\nCOMMIT TRANSACTION;"),
        ("begin tran;\nrollback tran;", "begin TRANSACTION;\nrollback TRANSACTION;"),
    ],
    "prefer-unicode-string-literals": [("SELECT 'a{k}', N'b';", "SELECT N'a{k}', N'b';"), ("SELECT a FROM dbo.t WHERE a = 'x';", "SELECT a FROM dbo.t WHERE a = 'x';")],
    "require-as-for-column-alias": [("SELECT a x, {k} y FROM dbo.t;", "SELECT a AS x, {k} AS y FROM dbo.t;")],
    "require-as-for-table-alias": [("SELECT x.a FROM dbo.t x JOIN dbo.u{k} y ON x.a = y.a;", "SELECT x.a FROM dbo.t AS x JOIN dbo.u{k} AS y ON x.a = y.a;")],
    "require-begin-end-strict": [
        ("IF @a = {k}\n    SELECT 1;\nELSE\n    SELECT 2;", "IF @a = {k}\nBEGIN\n    SELECT 1;\nEND\nELSE\nBEGIN\n    SELECT 2;\nEND"),
    ],
    "require-explicit-join-type": [
        ("SELECT t.a FROM dbo.t JOIN dbo.u ON t.a = u.a left join dbo.v ON v.a = {k};", "SELECT t.a FROM dbo.t INNER JOIN dbo.u ON t.a = u.a left OUTER join dbo.v ON v.a = {k};"),
    ],
    "semicolon-termination": [("SELECT 1\nSELECT {k}", "SELECT 1;\nSELECT {k};"), ("SELECT {k};\nGO\nSELECT 2 -- x", "SELECT {k};\nGO\nSELECT 2; -- x")],
}


def fix_query(rule: str) -> Callable:
    texts = [b for b, _ in FIXES[rule]]

    def run(spark: SparkSession, d: str) -> DataFrame:
        return ops.fix(corpus(spark, d, texts), Options(ruleset=Ruleset.of_rule(rule))).select("script_id", "fixed_text")

    return run


#: Texts before and after a formatter pass.
PASSES: dict[str, list[tuple[str, str]]] = {
    "strip_lone_cr": [("SELECT {k};\r\n", "SELECT {k};\r\n"), ("SELECT \r{k};\n", "SELECT {k};\n")],
    "keyword_spacing": [("SELECT a FROM t LEFT \t  OUTER   JOIN u ON a = {k} ORDER  BY a", "SELECT a FROM t LEFT OUTER JOIN u ON a = {k} ORDER BY a")],
    "element_casing": [
        ("select A, count(*), cast(B as INT) from Dbo.T where @X = {k}", "SELECT A, COUNT(*), CAST(B AS int) FROM Dbo.T WHERE @x = {k}"),
        ("exec dbo.Proc{k} @A = N'select'", "EXEC dbo.Proc{k} @a = N'select'"),
    ],
    "whitespace": [("\tSELECT a,  \n\t\t{k} -- x \nFROM 'a  \n\tb'", "    SELECT a,\n        {k} -- x\nFROM 'a  \n\tb'")],
    "blank_lines": [("\n\nSELECT {k};\n\n\nSELECT 2;", "SELECT {k};\n\n\nSELECT 2;")],
    "inline_spacing": [("SELECT a ,b,{k} ,  'x , y'", "SELECT a, b, {k}, 'x , y'")],
    "function_spacing": [("SELECT COUNT (*), dbo.f  ({k}) FROM t WHERE a IN (1)", "SELECT COUNT(*), dbo.f({k}) FROM t WHERE a IN (1)"), ("INSERT INTO dbo.t (a) VALUES ({k})", "INSERT INTO dbo.t (a) VALUES ({k})")],
    "operator_spacing": [("SELECT a+b*-1,t.*,COUNT(*) FROM t WHERE a>={k} AND b<>-2", "SELECT a + b * -1,t.*,COUNT(*) FROM t WHERE a >= {k} AND b <> -2")],
    "leading_commas": [("SELECT a,\n    b, -- x\n    {k}\nFROM t", "SELECT a\n    , b -- x\n    , {k}\nFROM t")],
    "trailing_commas": [("SELECT a\n    , b\n    , {k}\nFROM t", "SELECT a,\n    b,\n    {k}\nFROM t")],
}

DEFAULT_FORMAT = [
    ("select  a ,b from  dbo.T  where a={k}\n\n\ngo", "SELECT a, b FROM dbo.T WHERE a = {k}\n\n\nGO\n"),
    ("begin   tran\n\tupdate dbo.T set A=getdate ( ) where B in (1,{k})\ncommit", "BEGIN TRAN\n    UPDATE dbo.T SET A = GETDATE( ) WHERE B IN (1, {k})\nCOMMIT\n"),
]


def pass_query(name: str) -> Callable:
    texts = [b for b, _ in PASSES[name]]

    def run(spark: SparkSession, d: str) -> DataFrame:
        return fmt.format_pass(corpus(spark, d, texts), name)

    return run


def format_default(spark: SparkSession, d: str) -> DataFrame:
    return fmt.format_scripts(corpus(spark, d, [b for b, _ in DEFAULT_FORMAT])).select("script_id", "formatted")


def format_twice(spark: SparkSession, d: str) -> DataFrame:
    """Scripts that a second formatting would change again: none."""
    once = fmt.format_scripts(tsql_scripts(spark, d))
    twice = fmt.format_scripts(once.select("script_id", F.col("formatted").alias("text")))
    return twice.agg(F.count_if("changed").alias("unstable"))


# -- every rule's texts once more, in other surroundings ------------------------

_BEFORE = "SELECT a\nFROM dbo.t;\nGO\n"
#: Rules that look at the first statements of a script and report at its start, so that nothing can be put before theirs.
_AT_START = frozenset(
    "set-ansi set-ansi-padding set-ansi-warnings set-arithabort set-concat-null-yields-null set-nocount set-quoted-identifier set-transaction-isolation-level".split()
)
_PLACED = [(r, *expected(m)) for r in CASES for m in CASES[r] if r not in _AT_START]
_ELSEWHERE = {
    "rules_behind_a_batch": (lambda t: _BEFORE + t, 3),
    "rules_with_crlf": (lambda t: t.replace("\r\n", "\n").replace("\n", "\r\n"), 0),
    "rules_behind_a_comment": (lambda t: "/* it's a comment ( */\n-- '\n" + t, 2),
}


def elsewhere_query(name: str) -> Callable:
    """All rules over all rules' texts; of each text the findings of its own rule."""
    change, _ = _ELSEWHERE[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        found = ops.lint(corpus(spark, d, [change(t) for _, t, _ in _PLACED]), Options(ruleset=Ruleset.of_preset("strict"), compat=160))
        own = F.element_at(F.array(*[F.lit(r) for r, _, _ in _PLACED]), (F.pmod("script_id", F.lit(len(_PLACED))) + 1).cast("int"))
        return found.where(F.col("code") == own).select("script_id", "code", "start_line", "start_char")

    return run


def elsewhere_sql(name: str) -> str:
    _, shift = _ELSEWHERE[name]
    rows = [(i, r, line + shift, char) for i, (r, _, places) in enumerate(_PLACED) for line, char in places]
    return _modulus(rows, len(_PLACED), "v.a AS code, v.b AS start_line, v.c AS start_char")


# -- pipeline ----------------------------------------------------------------

_DIRECTIVES = [
    "-- lintmill-disable avoid-select-star: legacy\nSELECT * FROM dbo.t{k};\n-- lintmill-enable avoid-select-star\nSELECT * FROM dbo.t;",
    "/* lintmill-disable */\nSELECT * FROM dbo.t;\nPRINT 'x';",
    "-- lintmill-disabled\nSELECT * FROM dbo.t;",
    "SELECT * FROM dbo.t; -- lintmill-disable AVOID-SELECT-STAR, avoid-print-statement\nPRINT 'x{k}';",
]
_DIRECTIVE_RANGES = [(0, "avoid-select-star", 0, 2), (1, None, 0, None), (3, "avoid-select-star", 0, None), (3, "avoid-print-statement", 0, None)]


def directive_ranges(spark: SparkSession, d: str) -> DataFrame:
    return ops.disabled_ranges(corpus(spark, d, _DIRECTIVES)).select("script_id", "rule_id", "start_line", "end_line")


def lint_suppressed(spark: SparkSession, d: str) -> DataFrame:
    o = Options(ruleset=Ruleset({"avoid-select-star": "inherit", "avoid-print-statement": "inherit"}))
    return ops.lint(corpus(spark, d, _DIRECTIVES), o).select("script_id", "code", "start_line")


_MIXED = ["SELECT * FROM dbo.t WHERE a = NULL; PRINT 'x{k}';", "UPDATE dbo.t SET a = {k};", "SELECT a FROM dbo.t;", "SELECT FROM dbo.t{k};"]


def _mixed_options(threshold: int, overrides: dict | None = None) -> Options:
    base = Ruleset(dict.fromkeys(["avoid-select-star", "avoid-null-comparison", "avoid-print-statement", "dml-without-where"], "inherit"))
    return Options(ruleset=base.with_overrides(overrides or {}), threshold=threshold)


def severity_threshold(spark: SparkSession, d: str) -> DataFrame:
    return ops.lint(corpus(spark, d, _MIXED), _mixed_options(2)).select("script_id", "code", "severity")


def ruleset_override(spark: SparkSession, d: str) -> DataFrame:
    o = _mixed_options(4, {"avoid-select-star": "none", "avoid-print-statement": "error", "dml-without-where": "info"})
    return ops.lint(corpus(spark, d, _MIXED), o).select("script_id", "code", "severity")


def parse_errors(spark: SparkSession, d: str) -> DataFrame:
    found = ops.lint(corpus(spark, d, _MIXED), Options()).where("parse_error")
    return found.select("script_id", "code", "start_line", "start_char")


def lint_summary(spark: SparkSession, d: str) -> DataFrame:
    return ops.summary(ops.lint(corpus(spark, d, _MIXED), _mixed_options(4)))


def lint_text_lines(spark: SparkSession, d: str) -> DataFrame:
    """The text report without the wording of its messages, which is our own."""
    lines = ops.report_text(ops.lint(corpus(spark, d, _MIXED), _mixed_options(4)))
    return lines.select(F.regexp_replace("value", r"^(\S+: \w+: ).*( \([^()]*\))$", "$1...$2").alias("line"))


def lint_carets(spark: SparkSession, d: str) -> DataFrame:
    """Source lines and carets of parse errors in the text report."""
    lines = ops.report_text(ops.lint(corpus(spark, d, _MIXED), _mixed_options(1)).where("parse_error"), context=True)
    return lines.where("value like '  %'").select(F.col("value").alias("line"))


def lint_json_files(spark: SparkSession, d: str) -> DataFrame:
    r = ops.report_json(ops.lint(corpus(spark, d, _MIXED), _mixed_options(4)))
    codes = F.from_json("report", "files array<struct<filePath: string, diagnostics: array<struct<code: string, severity: string>>>>")["files"][0]
    return r.select("script_id", codes["filePath"].alias("path"), F.array_join(F.array_sort(codes["diagnostics"]["code"]), ",").alias("codes"))


def lint_status(spark: SparkSession, d: str) -> DataFrame:
    some = corpus(spark, d, _MIXED)
    codes = [ops.run_status(lambda x=x: ops.lint(x, _mixed_options(4))) for x in (some.limit(0), some.where("script_id % 4 = 0"), some)]
    codes.append(ops.run_status(lambda: ops.lint(some, Options(ruleset=Ruleset.of_rule("unknown")))))
    codes.append(ops.run_status(lambda: ops.lint(some.drop("text"))))
    return spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "run int, status int")


def fix_rounds(spark: SparkSession, d: str) -> DataFrame:
    """What a round of fixes changes, applies and leaves, over known texts."""
    texts = ["exec dbo.p; SELECT a FROM dbo.t WHERE a != {k};", "SELECT a FROM dbo.t;", "SELECT * FROM dbo.t WHERE a = NULL;"]
    o = Options(ruleset=Ruleset(dict.fromkeys(["normalize-execute-keyword", "normalize-inequality-operator", "avoid-null-comparison", "avoid-select-star"], "inherit")))
    f = ops.fix(corpus(spark, d, texts), o)
    return f.groupBy("changed", "remaining").agg(F.count(F.lit(1)).alias("scripts"), F.sum(F.size("applied")).cast("long").alias("applied"), F.sum(F.size("skipped")).cast("long").alias("skipped"))


def files_rewritten(spark: SparkSession, d: str) -> DataFrame:
    """All T-SQL scripts as files of four encodings, read as a directory and written again where a fix changes them."""
    folder = shared_folder(spark)
    names = ["utf-8", "utf-8-sig", "utf-16-le-sig", "utf-16-be-sig"]
    encoding = F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod("script_id", F.lit(4)) + 1).cast("int"))
    texts = tsql_scripts(spark, d).where("text is not null").select(
        "script_id", F.concat(F.col("script_id"), F.lit(".Sql")).alias("file_path"), F.regexp_replace("text", "^\ufeff", "").alias("text"), encoding.alias("encoding")
    )
    write_scripts(texts, folder).where("error is not null").count()
    scripts, _ = read_directory(spark, folder)
    fixed = ops.fix(scripts, Options(ruleset=Ruleset.of_rule("normalize-inequality-operator")))
    write_changed(fixed, scripts).where("error is not null").count()
    again, _ = read_directory(spark, folder)
    bangs = F.size(F.split("text", "!=")) - 1
    return again.groupBy("encoding").agg(F.count(F.lit(1)).alias("scripts"), F.sum(F.length("text") - bangs).alias("chars"))


def fix_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Two rules want to edit the same place: the one that comes first is applied."""
    texts = ["SELECT a FROM dbo.t WHERE a != NULL AND b = {k};"]
    o = Options(ruleset=Ruleset({"avoid-null-comparison": "inherit", "normalize-inequality-operator": "inherit"}))
    f = ops.fix(corpus(spark, d, texts), o)
    return f.select("script_id", "fixed_text", F.array_join("applied", ",").alias("applied"), F.array_join(F.col("skipped.reason"), ",").alias("skipped"))


def _magic_numbers(s) -> list[Finding]:
    """Example of a user's rule: numbers of more than two digits."""
    return [
        Finding("", b.start(i), b.end(i), "Name the number.") for b in s.batches for i, k in enumerate(b.k) if k == "NUM" and len(b.t[i]) > 2
    ]


MAGIC = Rule("no-magic-numbers", "Style", "", 2, False, 100)


def plugin_rule(spark: SparkSession, d: str) -> DataFrame:
    o = Options(ruleset=Ruleset({}).with_plugins([MAGIC.id]), plugins=((MAGIC, _magic_numbers),))
    return ops.lint(corpus(spark, d, ["SELECT 1, 99, 12345;", "SELECT a FROM dbo.t;"]), o).select("script_id", "code", "start_char")


def rule_catalog(spark: SparkSession, d: str) -> DataFrame:
    return ops.rule_catalog(spark).select("rule_id", "category", "severity", "fixable", "preset")


def preset_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = [(p, r) for p in ("security-only", "pragmatic", "recommended", "strict-logic", "strict") for r in sorted(preset(p))]
    return spark.createDataFrame(rows, "preset string, rule_id string").groupBy("preset").agg(F.count(F.lit(1)).alias("rules"))


def _modulus(rows: list[tuple], n: int, columns: str) -> str:
    values = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else quote(v) for v in r) + ")" for r in rows)
    return f"SELECT c_custkey AS script_id, {columns} FROM customer JOIN (VALUES {values}) AS v(t, a, b, c) ON c_custkey % {n} = v.t"


_FOUND = [(0, "avoid-select-star", 2, 0), (0, "avoid-null-comparison", 1, 0), (0, "avoid-print-statement", 3, 0), (1, "dml-without-where", 1, 0), (3, "parse-error", 1, 0)]

QUERIES: dict[str, Callable] = {
    **{f"rule_{r.replace('-', '_')}": rule_query(r) for r in RULES},
    **{f"fix_{r.replace('-', '_')}": fix_query(r) for r in FIXES},
    **{f"format_{p}": pass_query(p) for p in PASSES},
    **{n: elsewhere_query(n) for n in _ELSEWHERE},
    "format_default": format_default,
    "format_twice": format_twice,
    "directive_ranges": directive_ranges,
    "lint_suppressed": lint_suppressed,
    "lint_severity_threshold": severity_threshold,
    "lint_ruleset_override": ruleset_override,
    "parse_errors": parse_errors,
    "lint_summary": lint_summary,
    "fix_conflicts": fix_conflicts,
    "lint_text_lines": lint_text_lines,
    "lint_carets": lint_carets,
    "lint_json_files": lint_json_files,
    "lint_status": lint_status,
    "fix_rounds": fix_rounds,
    "files_rewritten": files_rewritten,
    "plugin_rule": plugin_rule,
    "rule_catalog": rule_catalog,
    "preset_matrix": preset_matrix,
}

_LABEL = {1: "Error", 2: "Warning", 3: "Information"}
_PRESET = {"S": "security-only", "P": "pragmatic", "R": "recommended", "L": "strict-logic", "C": "strict"}

ORACLES: dict[str, str] = {
    **{f"rule_{r.replace('-', '_')}": rule_sql(r) for r in RULES},
    **{f"fix_{r.replace('-', '_')}": case_sql("fixed_text", [a for _, a in FIXES[r]]) for r in FIXES},
    **{f"format_{p}": case_sql("formatted", [a for _, a in PASSES[p]]) for p in PASSES},
    **{n: elsewhere_sql(n) for n in _ELSEWHERE},
    "format_default": case_sql("formatted", [a for _, a in DEFAULT_FORMAT]),
    "format_twice": "SELECT 0::BIGINT AS unstable",
    "directive_ranges": _modulus(_DIRECTIVE_RANGES, 4, "v.a AS rule_id, v.b AS start_line, v.c AS end_line"),
    "lint_suppressed": _modulus([(0, "avoid-select-star", 3, 0), (2, "avoid-select-star", 1, 0)], 4, "v.a AS code, v.b AS start_line"),
    "lint_severity_threshold": _modulus([r for r in _FOUND if r[2] <= 2], 4, "v.a AS code, v.b AS severity"),
    "lint_ruleset_override": _modulus(
        [(0, "avoid-null-comparison", 1, 0), (0, "avoid-print-statement", 1, 0), (1, "dml-without-where", 3, 0), (3, "parse-error", 1, 0)], 4, "v.a AS code, v.b AS severity"
    ),
    "parse_errors": _modulus([(3, "parse-error", 0, 7)], 4, "v.a AS code, v.b AS start_line, v.c AS start_char"),
    "lint_summary": (
        "SELECT sum(CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 3 THEN 1 ELSE 0 END)::BIGINT AS total, "
        "sum(CASE c_custkey % 4 WHEN 2 THEN 0 ELSE 1 END)::BIGINT AS errors, count(*) FILTER (c_custkey % 4 = 0) AS warnings, "
        "count(*) FILTER (c_custkey % 4 = 0) AS fixable, count(*) FILTER (c_custkey % 4 <> 2) AS files, bool_or(c_custkey % 4 = 3) AS any_parse_error FROM customer"
    ),
    "fix_conflicts": (
        "SELECT c_custkey AS script_id, replace('SELECT a FROM dbo.t WHERE a IS NOT NULL AND b = {k};', '{k}', CAST(c_custkey AS VARCHAR)) AS fixed_text, "
        "'avoid-null-comparison' AS applied, 'Conflicts with another fix.' AS skipped FROM customer"
    ),
    "lint_text_lines": (
        "SELECT 'gen/' || c_custkey || '.sql:' || v.rest AS line FROM customer JOIN (VALUES "
        "(0, '1:8: Warning: ... (avoid-select-star)'), (0, '1:27: Error: ... (avoid-null-comparison,Fixable)'), (0, '1:37: Information: ... (avoid-print-statement)'), "
        "(1, '1:1: Error: ... (dml-without-where)'), (3, '1:8: Error: ... (parse-error)')) AS v(t, rest) ON c_custkey % 4 = v.t"
    ),
    "lint_carets": (
        "SELECT '  1 | SELECT FROM dbo.t' || c_custkey || ';' AS line FROM customer WHERE c_custkey % 4 = 3 "
        "UNION ALL SELECT '    |        ^' FROM customer WHERE c_custkey % 4 = 3"
    ),
    "lint_json_files": (
        "SELECT c_custkey AS script_id, 'gen/' || c_custkey || '.sql' AS path, CASE c_custkey % 4 WHEN 0 THEN 'avoid-null-comparison,avoid-print-statement,avoid-select-star' "
        "WHEN 1 THEN 'dml-without-where' ELSE 'parse-error' END AS codes FROM customer WHERE c_custkey % 4 <> 2"
    ),
    "lint_status": "SELECT * FROM (VALUES (0, 0), (1, 1), (2, 2), (3, 3), (4, 4)) AS v(run, status)",
    "fix_rounds": (
        "SELECT c_custkey % 3 <> 1 AS changed, CASE c_custkey % 3 WHEN 2 THEN 1 ELSE 0 END::INTEGER AS remaining, count(*) AS scripts, "
        "sum(CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 2 THEN 1 ELSE 0 END)::BIGINT AS applied, 0::BIGINT AS skipped FROM customer GROUP BY 1, 2"
    ),
    "files_rewritten": (
        "SELECT ['utf-8', 'utf-8-sig', 'utf-16-le-sig', 'utf-16-be-sig'][script_id % 4 + 1] AS encoding, count(*) AS scripts, "
        "sum(length(regexp_replace(text, '^\ufeff', '')) - len(string_split(text, '!=')) + 1)::BIGINT AS chars "
        "FROM scripts WHERE text IS NOT NULL AND NOT coalesce(regexp_matches(lower(file_path), '\\.(json|xml)\\s*$'), false) GROUP BY 1"
    ),
    "plugin_rule": "SELECT c_custkey AS script_id, 'no-magic-numbers' AS code, 14 AS start_char FROM customer WHERE c_custkey % 2 = 0",
    "rule_catalog": "SELECT * FROM (VALUES "
    + ", ".join(f"('{r.id}', '{r.category}', '{_LABEL[r.severity]}', {str(r.fixable).lower()}, '{_PRESET[r.tier]}')" for r in RULES.values())
    + ") AS v(rule_id, category, severity, fixable, preset)",
    "preset_matrix": "SELECT preset, rules::BIGINT AS rules FROM (VALUES ('security-only', 14), ('pragmatic', 43), ('recommended', 87), ('strict-logic', 107), ('strict', 130)) AS v(preset, rules)",
}

