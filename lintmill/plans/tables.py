"""Queries over whole tables that SQL can state too: lexing, line maps, suppression, reports, construct pairs, functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintmill.functions import tsql as T
from lintmill.operators import lint as ops
from lintmill.rules.engine import Options
from lintmill.rules.rulesets import Ruleset
from lintmill.session import table
from lintmill.sources.scripts import within_size

#: Lexemes in syntax that Java's and RE2's regular expressions share.
LEXEME = (
    r"(?s)--[^\r\n]*|/\*.*?\*/|N?'(?:[^']|'')*'|\[(?:[^\]]|\]\])*\]|\"(?:[^\"]|\"\")*\"|@{0,2}[A-Za-z_#][A-Za-z0-9_@#$]*"
    r"|[0-9]+(?:\.[0-9]+)?|[ \t\r\n]+|<>|!=|<=|>=|."
)
_SQL_LEXEME = LEXEME.replace("'", "''")
CLASS_SQL = (
    "CASE WHEN starts_with(tok, '--') THEN 'line_comment' WHEN starts_with(tok, '/*') AND length(tok) > 1 THEN 'block_comment' "
    "WHEN {re}(tok, '^N?''') AND length(tok) > 1 THEN 'string' WHEN {re}(tok, '^[ \\t\\r\\n]') THEN 'whitespace' "
    "WHEN {re}(tok, '^@{{1,2}}[A-Za-z_#]') THEN 'variable' WHEN {re}(tok, '^[A-Za-z_#]') THEN 'word' WHEN {re}(tok, '^[0-9]') THEN 'number' "
    "WHEN {re}(tok, '^\\[|^\"') AND length(tok) > 1 THEN 'quoted' ELSE 'other' END"
)


def regex_lexemes(df: DataFrame, id_: str) -> DataFrame:
    """Lexemes by the shared regular expression, inside the JVM."""
    return df.where("text is not null").select(F.col(id_), F.posexplode(F.regexp_extract_all("text", F.lit(LEXEME), F.lit(0))).alias("idx", "tok"))


def _lex(name: str, id_: str) -> Callable:
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = regex_lexemes(table(spark, d, name), id_)
        return t.groupBy(id_).agg(F.count(F.lit(1)).alias("tokens"), F.sum(F.length("tok")).cast("long").alias("chars"))

    return run


def _lex_sql(name: str, id_: str) -> str:
    return (
        f"SELECT {id_}, count(*) AS tokens, sum(length(tok))::BIGINT AS chars FROM "
        f"(SELECT {id_}, unnest(regexp_extract_all(text, '{_SQL_LEXEME}')) AS tok FROM {name} WHERE text IS NOT NULL) GROUP BY {id_}"
    )


def token_class_counts(spark: SparkSession, d: str) -> DataFrame:
    t = regex_lexemes(table(spark, d, "scripts"), "script_id")
    return t.groupBy(F.expr(CLASS_SQL.format(re="regexp").replace("starts_with", "startswith").replace("\\", "\\\\").replace("''", "\\'")).alias("class")).agg(F.count(F.lit(1)).alias("tokens"))


def comment_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = regex_lexemes(table(spark, d, "scripts"), "script_id").where(F.col("tok").startswith("--"))
    return t.groupBy("script_id").agg(F.count(F.lit(1)).alias("comments"), F.max(F.length("tok")).cast("long").alias("longest"))


def longest_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = regex_lexemes(table(spark, d, "scripts"), "script_id").select("script_id", "idx", F.length("tok").cast("long").alias("chars"))
    return t.orderBy(F.desc("chars"), "script_id", "idx").limit(20)


def exact_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The exact lexer: lexemes cover every text."""
    t = ops.tokens(table(spark, d, "scripts"))
    return t.groupBy("script_id").agg(F.sum(F.length("text")).cast("long").alias("chars"))


def scripts_scan(spark: SparkSession, d: str) -> DataFrame:
    return within_size(table(spark, d, "scripts"), 2000).select("script_id", "n_bytes")


def line_map(spark: SparkSession, d: str) -> DataFrame:
    lines = ops.line_map(table(spark, d, "scripts"))
    return lines.select("script_id", F.col("line_no").cast("long").alias("line_no"), F.length("line").cast("long").alias("chars"))


def duplicate_empty_line(spark: SparkSession, d: str) -> DataFrame:
    return ops.duplicate_empty_lines(table(spark, d, "scripts"))


def suppression(spark: SparkSession, d: str) -> DataFrame:
    diags = table(spark, d, "diagnostics").withColumn("start_line", F.col("diag_range.start_pos.line"))
    return ops.suppress(diags, table(spark, d, "disabled_ranges")).select("diag_id", "script_id", "code", "start_line", "ingested_at")


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    return ops.latest_deliveries(table(spark, d, "diagnostics")).select("diag_id", "script_id", "ingested_at")


def normalised(spark: SparkSession, d: str) -> DataFrame:
    n = ops.normalise(table(spark, d, "diagnostics"), table(spark, d, "rules"))
    return n.groupBy("severity", "category").agg(F.count(F.lit(1)).alias("n"))


def threshold(spark: SparkSession, d: str) -> DataFrame:
    n = ops.above_threshold(ops.normalise(table(spark, d, "diagnostics"), table(spark, d, "rules")), "warning")
    return n.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def violations_by_rule(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "diagnostics").where("code is not null").select("code", "severity", "script_id")
    return ops.by_rule(x).select("code", "severity", "diagnostics", "scripts")


def worst_scripts(spark: SparkSession, d: str) -> DataFrame:
    return ops.worst_scripts(table(spark, d, "diagnostics"), 25)


def tsql_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Scripts whose path names neither JSON nor XML; one without extension or path is T-SQL."""
    return table(spark, d, "scripts").where(~F.coalesce(F.lower("file_path").rlike(r"\.(json|xml)\s*$"), F.lit(False)))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Findings and scripts per rule over all T-SQL scripts, all rules."""
    return ops.by_rule(ops.lint(tsql_scripts(spark, d), Options(ruleset=Ruleset.of_preset("strict"))))


def lint_report(spark: SparkSession, d: str) -> DataFrame:
    return ops.report_json(ops.lint(tsql_scripts(spark, d), Options(ruleset=Ruleset.of_preset("strict"))))


def lint_text(spark: SparkSession, d: str) -> DataFrame:
    return ops.report_text(ops.lint(tsql_scripts(spark, d), Options(ruleset=Ruleset.of_preset("strict"))))


def fix_all(spark: SparkSession, d: str) -> DataFrame:
    f = ops.fix(tsql_scripts(spark, d), Options(ruleset=Ruleset.of_preset("strict")))
    return f.groupBy("changed").agg(F.count(F.lit(1)).alias("scripts"), F.sum(F.size("applied")).alias("applied"), F.sum(F.size("skipped")).alias("skipped"))


# -- construct pairs: what a rule advises against, and what it advises ---------


def pair_not_exists(spark: SparkSession, d: str) -> DataFrame:
    """NOT IN against a column without NULL as an anti-join."""
    big = table(spark, d, "orders").where("o_totalprice > 200000")
    return table(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def pair_exists(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 300000")
    return table(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


def pair_left_filtered(spark: SparkSession, d: str) -> DataFrame:
    """LEFT JOIN whose WHERE rejects NULLs is an inner join."""
    j = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").where("o_orderstatus = 'F'")
    return j.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def pair_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


def pair_top_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


def pair_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus")
    return g.agg(F.grouping_id().cast("long").alias("gid"), F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("s"))


def pair_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def pair_string_agg(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("nations"))


def pair_half_open(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderdate >= timestamp'1995-01-01' and o_orderdate < timestamp'1996-01-01'")
    return o.groupBy(F.month("o_orderdate").cast("long").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def pair_union_types(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("k"))
    b = table(spark, d, "supplier").select(F.col("s_name").alias("k"))
    return a.union(b).distinct().agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("last"))


def pair_except_intersect(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    e = c.subtract(s).select("k", F.lit("except").alias("op"))
    return e.union(c.intersect(s).select("k", F.lit("intersect").alias("op")))


def pair_window_ranks(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    c = table(spark, d, "customer")
    r = lambda f: f.over(w).cast("long")
    return c.select(
        "c_custkey", r(F.row_number()).alias("rn"), r(F.rank()).alias("rk"), r(F.dense_rank()).alias("dr"), r(F.ntile(4)).alias("nt"),
        F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"),
    )


def pair_scalar_subquery(spark: SparkSession, d: str) -> DataFrame:
    """Correlated scalar subquery as a left join on an aggregate."""
    m = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last_order"))
    return table(spark, d, "customer").join(m, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "last_order")


def pair_apply(spark: SparkSession, d: str) -> DataFrame:
    """CROSS APPLY (TOP 2 ... ORDER BY) as a ranked join."""
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))
    o = table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    return o.select("o_custkey", "o_orderkey", F.col("rn").cast("long").alias("rn"))


def pair_pivot(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return p.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


def pair_unpivot(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("nation"), F.col("s_suppkey").alias("copy"))
    return s.unpivot("s_suppkey", ["nation", "copy"], "name", "value")


def pair_recursive(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 50) SELECT n FROM r")


def pair_full_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    j = c.join(s, F.col("c_nationkey") == F.col("s_nationkey"), "full")
    return j.select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), "customers", "suppliers")


def pair_merge(spark: SparkSession, d: str) -> DataFrame:
    """MERGE (update matched, insert others) as one full join."""
    t = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("v")).groupBy("k").agg(F.max("v").alias("v"))
    u = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.lit(-1).cast("long").alias("v"))
    return t.alias("t").join(u.alias("u"), F.col("t.k") == F.col("u.k"), "full").select(
        F.coalesce("t.k", "u.k").alias("k"), F.coalesce("u.v", "t.v").alias("v")
    )


def pair_openjson(spark: SparkSession, d: str) -> DataFrame:
    """OPENJSON over a column: member names and values as rows."""
    e = table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("name", "value"))
    return e.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("last"))


def pair_for_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("js"))


def pair_offset_fetch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").offset(20).limit(15).select("c_custkey")


def pair_top_percent(spark: SparkSession, d: str) -> DataFrame:
    """TOP 10 PERCENT: the number of rows is rounded up."""
    c = table(spark, d, "supplier")
    n = -(-c.count() // 10)
    return c.orderBy(F.desc("s_acctbal"), "s_suppkey").limit(n).select("s_suppkey")


def pair_like_class(spark: SparkSession, d: str) -> DataFrame:
    """LIKE with a character class."""
    return table(spark, d, "part").where(T.like(F.col("p_brand"), "Brand#[1-3]_%")).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


def pair_all_any(spark: SparkSession, d: str) -> DataFrame:
    """> ALL (subquery) as a comparison with the maximum."""
    most = table(spark, d, "supplier").agg(F.max("s_acctbal"))
    return table(spark, d, "customer").where(F.col("c_acctbal") > most.scalar()).select("c_custkey")


def pair_values(spark: SparkSession, d: str) -> DataFrame:
    v = spark.createDataFrame([("F", 1), ("O", 2), ("P", 3)], "s string, rank int")
    return table(spark, d, "orders").join(F.broadcast(v), F.col("o_orderstatus") == F.col("s")).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


def pair_case_having(spark: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "middle").otherwise("large")
    return table(spark, d, "part").groupBy("p_type", size.alias("size")).agg(F.count(F.lit(1)).alias("n")).where("n > 3")


def pair_lag_lead(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"))


def pair_null_safe(spark: SparkSession, d: str) -> DataFrame:
    """= NULL against IS NULL and IS NOT DISTINCT FROM."""
    g = table(spark, d, "diagnostics")
    return g.agg(
        F.count_if(F.col("code") == F.lit(None).cast("string")).alias("equals"), F.count_if(F.col("code").isNull()).alias("is_null"),
        F.count_if(F.col("code").eqNullSafe(F.lit(None).cast("string"))).alias("same"),
    )


def fn_more(spark: SparkSession, d: str) -> DataFrame:
    f = T.FUNCTIONS
    return table(spark, d, "part").select(
        "p_partkey", f["PATINDEX"]("%[aeiou]_%", F.col("p_name")).cast("long").alias("pat"), f["STR"](F.col("p_retailprice"), 10, 1).alias("str"),
        f["DATENAME"]("month", F.make_date(F.lit(2024), F.pmod(F.col("p_partkey"), F.lit(12)).cast("int") + 1, F.lit(1))).alias("mon"),
    )


# -- T-SQL functions ----------------------------------------------------------


def fn_strings(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("p_name")
    f = T.FUNCTIONS
    return table(spark, d, "part").select(
        "p_partkey", f["LEN"](F.concat(x, F.lit("  "))).cast("long").alias("len"), f["LEFT"](x, 4).alias("l4"), f["RIGHT"](x, 4).alias("r4"),
        f["SUBSTRING"](x, 2, 5).alias("sub"), f["UPPER"](x).alias("up"), f["LOWER"](x).alias("low"), f["TRIM"](F.concat(F.lit(" "), x, F.lit(" "))).alias("trim"),
        f["REPLACE"](x, "e", "#").alias("rep"), f["REPLICATE"](F.col("p_brand"), 2).alias("repl"), f["REVERSE"](x).alias("rev"),
        f["STUFF"](x, 2, 3, "zz").alias("stuff"), f["CHARINDEX"]("a", x).cast("long").alias("ci"), f["CONCAT"](x, F.lit(None), F.col("p_size")).alias("cat"),
        f["CONCAT_WS"]("-", x, F.col("p_brand")).alias("ws"), f["QUOTENAME"](x).alias("q"), f["ASCII"](x).cast("long").alias("asc"),
    )


def fn_dates(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("o_orderdate"), F.lit("1996-07-15 10:20:30").cast("timestamp")
    f = T.FUNCTIONS
    parts = ("year", "quarter", "month", "week", "day", "hour")
    return table(spark, d, "orders").select(
        "o_orderkey", *[f["DATEDIFF"](p, x, y).cast("long").alias(f"d_{p}") for p in parts], f["DATEADD"]("day", 10, x).alias("plus_days"),
        f["DATEADD"]("month", 1, x).alias("plus_month"), f["EOMONTH"](x).alias("eom"), f["YEAR"](x).cast("long").alias("y"),
        f["MONTH"](x).cast("long").alias("m"), f["DAY"](x).cast("long").alias("dd"), f["DATEPART"]("quarter", x).cast("long").alias("q"),
    )


def fn_numbers(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("c_acctbal")
    f = T.FUNCTIONS
    r = lambda c: F.round(c, 6)
    return table(spark, d, "customer").select(
        "c_custkey", f["ABS"](x).alias("abs"), f["CEILING"](x).cast("long").alias("ceil"), f["FLOOR"](x).cast("long").alias("floor"),
        r(f["SQUARE"](x)).alias("sq"), r(f["SQRT"](F.abs(x))).alias("sqrt"), r(f["LOG"](F.abs(x) + 1)).alias("ln"), r(f["LOG10"](F.abs(x) + 1)).alias("lg"),
        f["SIGN"](x).cast("long").alias("sign"), r(f["SIN"](x)).alias("sin"), r(f["ATN2"](x, F.lit(2.0))).alias("atn2"), r(f["DEGREES"](F.lit(1.0) * F.col("c_nationkey"))).alias("deg"),
        r(f["POWER"](F.col("c_nationkey"), F.lit(2))).alias("pow"),
    )


def fn_logic(spark: SparkSession, d: str) -> DataFrame:
    f = T.FUNCTIONS
    seg = F.col("c_mktsegment")
    return table(spark, d, "customer").select(
        "c_custkey", f["IIF"](F.col("c_acctbal") > 0, F.lit("plus"), F.lit("minus")).alias("iif"),
        f["CHOOSE"](F.pmod(F.col("c_custkey"), F.lit(4)), F.lit("a"), F.lit("b"), F.lit("c")).alias("choose"),
        f["ISNULL"](f["NULLIF"](seg, F.lit("BUILDING")), F.lit("none")).alias("isnull"), f["TRY_CAST"](F.substring("c_name", 10, 9), "bigint").alias("tc"),
        f["HASHBYTES"](seg).alias("hash"),
    )


def fn_aggregates(spark: SparkSession, d: str) -> DataFrame:
    f = T.FUNCTIONS
    x = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        f["COUNT_BIG"](F.lit(1)).alias("n"), F.round(f["AVG"](x), 6).alias("avg"), f["MIN"](x).alias("lo"), f["MAX"](x).alias("hi"),
        F.round(f["STDEV"](x), 6).alias("sd"), F.round(f["STDEVP"](x), 6).alias("sdp"), F.round(f["VAR"](x), 5).alias("v"), F.round(f["VARP"](x), 5).alias("vp"),
    )


def fn_json(spark: SparkSession, d: str) -> DataFrame:
    f = T.FUNCTIONS
    return table(spark, d, "events").select("event_id", f["ISJSON"](F.col("props")).cast("long").alias("ok"))


_NAMES = [
    "token_class_counts", "comment_tokens", "longest_tokens", "exact_tokens", "scripts_scan", "line_map", "duplicate_empty_line", "suppression", "deliveries",
    "normalised", "threshold", "violations_by_rule", "worst_scripts", "flagship", "lint_report", "lint_text", "fix_all",
]
QUERIES: dict[str, Callable] = {
    **{n: globals()[n] for n in _NAMES},
    "lex_documents": _lex("documents", "doc_id"),
    "lex_scripts": _lex("scripts", "script_id"),
    **{k: v for k, v in globals().items() if k.startswith(("pair_", "fn_"))},
}

_LINES = "(SELECT script_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM (SELECT script_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM scripts WHERE text IS NOT NULL))"
_NORMAL = (
    "(SELECT d.code, coalesce(d.severity, r.default_severity, 'Warning') AS severity, coalesce(d.diag_data.category, r.category) AS category "
    "FROM diagnostics d LEFT JOIN rules r ON lower(d.code) = lower(r.rule_id))"
)

ORACLES: dict[str, str] = {
    "lex_documents": _lex_sql("documents", "doc_id"),
    "lex_scripts": _lex_sql("scripts", "script_id"),
    "token_class_counts": (
        f"SELECT {CLASS_SQL.format(re='regexp_matches')} AS class, count(*) AS tokens FROM "
        f"(SELECT unnest(regexp_extract_all(text, '{_SQL_LEXEME}')) AS tok FROM scripts WHERE text IS NOT NULL) GROUP BY 1"
    ),
    "comment_tokens": (
        f"SELECT script_id, count(*) AS comments, max(length(tok))::BIGINT AS longest FROM "
        f"(SELECT script_id, unnest(regexp_extract_all(text, '{_SQL_LEXEME}')) AS tok FROM scripts WHERE text IS NOT NULL) WHERE starts_with(tok, '--') GROUP BY 1"
    ),
    "longest_tokens": (
        f"SELECT script_id, idx::INTEGER AS idx, length(tok)::BIGINT AS chars FROM (SELECT script_id, generate_subscripts(ts, 1) - 1 AS idx, unnest(ts) AS tok FROM "
        f"(SELECT script_id, regexp_extract_all(text, '{_SQL_LEXEME}') AS ts FROM scripts WHERE text IS NOT NULL)) ORDER BY chars DESC, script_id, idx LIMIT 20"
    ),
    "exact_tokens": "SELECT script_id, length(text)::BIGINT AS chars FROM scripts WHERE length(text) > 0",
    "scripts_scan": "SELECT script_id, n_bytes FROM scripts WHERE n_bytes <= 2000",
    "line_map": f"SELECT script_id, line_no::BIGINT AS line_no, length(line)::BIGINT AS chars FROM {_LINES}",
    "duplicate_empty_line": (
        f"SELECT script_id, min(line_no)::BIGINT AS start_line, count(*) AS run FROM (SELECT script_id, line_no, line_no - row_number() OVER (PARTITION BY script_id ORDER BY line_no) AS island "
        f"FROM {_LINES} WHERE trim(replace(replace(line, chr(9), ' '), chr(12), ' ')) = '') GROUP BY script_id, island HAVING count(*) > 1"
    ),
    "suppression": (
        "SELECT diag_id, script_id, code, diag_range.start_pos.line AS start_line, ingested_at FROM diagnostics d WHERE NOT EXISTS (SELECT 1 FROM disabled_ranges r WHERE r.script_id = d.script_id "
        "AND (r.rule_id IS NULL OR lower(r.rule_id) = lower(d.code)) AND d.diag_range.start_pos.line >= r.start_line AND (r.end_line IS NULL OR d.diag_range.start_pos.line < r.end_line))"
    ),
    "deliveries": (
        "SELECT diag_id, script_id, ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY diag_id ORDER BY ingested_at DESC, script_id) AS rn FROM diagnostics) WHERE rn = 1 OR diag_id IS NULL"
    ),
    "normalised": f"SELECT severity, category, count(*) AS n FROM {_NORMAL} GROUP BY ALL",
    "threshold": f"SELECT code, count(*) AS n FROM {_NORMAL} WHERE lower(severity) IN ('error', 'warning') GROUP BY code",
    "violations_by_rule": "SELECT code, severity, count(*)::BIGINT AS diagnostics, count(DISTINCT script_id) AS scripts FROM diagnostics WHERE code IS NOT NULL GROUP BY ALL",
    "worst_scripts": "SELECT script_id, count(*) AS diagnostics FROM diagnostics GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25",
    "pair_not_exists": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 200000)",
    "pair_exists": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "pair_left_filtered": "SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY 1",
    "pair_distinct": "SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY ALL",
    "pair_top_order": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "pair_grouping_sets": (
        "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS gid, count(*) AS n, sum(l_linenumber)::BIGINT AS s FROM lineitem "
        "GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())"
    ),
    "pair_rollup": "SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)",
    "pair_string_agg": "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "pair_half_open": "SELECT month(o_orderdate)::BIGINT AS month, count(*) AS n FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1",
    "pair_union_types": "SELECT count(*) AS n, max(k) AS last FROM (SELECT CAST(c_custkey AS VARCHAR) AS k FROM customer UNION SELECT s_name FROM supplier)",
    "pair_except_intersect": (
        "SELECT k, 'except' AS op FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL "
        "SELECT k, 'intersect' FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)"
    ),
    "pair_window_ranks": (
        "SELECT c_custkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt, round(percent_rank() OVER w, 6) AS pr, "
        "round(cume_dist() OVER w, 6) AS cd FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)"
    ),
    "pair_scalar_subquery": "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last_order FROM customer",
    "pair_apply": "SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn <= 2",
    "pair_pivot": "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1",
    "pair_unpivot": "SELECT s_suppkey, 'nation' AS name, s_nationkey::BIGINT AS value FROM supplier UNION ALL SELECT s_suppkey, 'copy', s_suppkey FROM supplier",
    "pair_recursive": "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 50) SELECT n FROM r",
    "pair_full_join": (
        "SELECT coalesce(c.k, s.k) AS nation, customers, suppliers FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) c "
        "FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) s ON c.k = s.k"
    ),
    "pair_merge": "SELECT n_nationkey AS k, -1::BIGINT AS v FROM nation UNION ALL SELECT s_nationkey, max(s_suppkey) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation) GROUP BY 1",
    "pair_openjson": "SELECT name, count(*) AS n, max(value) AS last FROM (SELECT unnest(json_keys(props)) AS name, props FROM events) x, LATERAL (SELECT json_extract_string(x.props, '$.\"' || x.name || '\"') AS value) GROUP BY name",
    "pair_for_json": "SELECT n_nationkey, CAST(to_json({n_nationkey: n_nationkey, n_name: n_name}) AS VARCHAR) AS js FROM nation",
    "pair_offset_fetch": "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15 OFFSET 20",
    "pair_top_percent": "SELECT s_suppkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rn, count(*) OVER () AS n FROM supplier) WHERE rn <= ceil(n / 10.0)",
    "pair_like_class": "SELECT p_brand, count(*) AS n FROM part WHERE regexp_matches(p_brand, '^Brand#[1-3].') GROUP BY 1",
    "pair_all_any": "SELECT c_custkey FROM customer WHERE c_acctbal > ALL (SELECT s_acctbal FROM supplier)",
    "pair_values": "SELECT rank, count(*) AS n FROM orders JOIN (VALUES ('F', 1), ('O', 2), ('P', 3)) AS v(s, rank) ON o_orderstatus = s GROUP BY rank",
    "pair_case_having": (
        "SELECT p_type, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 3"
    ),
    "pair_lag_lead": "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "pair_null_safe": "SELECT 0::BIGINT AS equals, count(*) FILTER (code IS NULL) AS is_null, count(*) FILTER (code IS NOT DISTINCT FROM NULL) AS same FROM diagnostics",
    "fn_more": (
        "SELECT p_partkey, coalesce(length(regexp_extract(p_name, '^(.*?)[aeiou].', 1)) + 1, 0) * regexp_matches(p_name, '[aeiou].')::BIGINT AS pat, "
        "lpad(printf('%.1f', round(p_retailprice, 1)), 10, ' ') AS str, monthname(make_date(2024, (p_partkey % 12)::INTEGER + 1, 1)) AS mon FROM part"
    ),
    "fn_strings": (
        "SELECT p_partkey, length(rtrim(p_name || '  ')) AS len, left(p_name, 4) AS l4, right(p_name, 4) AS r4, substring(p_name, 2, 5) AS sub, upper(p_name) AS up, lower(p_name) AS low, "
        "trim(' ' || p_name || ' ') AS trim, replace(p_name, 'e', '#') AS rep, repeat(p_brand, 2) AS repl, reverse(p_name) AS rev, left(p_name, 1) || 'zz' || substring(p_name, 5) AS stuff, "
        "instr(p_name, 'a') AS ci, p_name || CAST(p_size AS VARCHAR) AS cat, p_name || '-' || p_brand AS ws, '[' || replace(p_name, ']', ']]') || ']' AS q, ascii(p_name)::BIGINT AS asc FROM part"
    ),
    "fn_dates": (
        "SELECT o_orderkey, date_diff('year', o_orderdate, e) AS d_year, date_diff('quarter', o_orderdate, e) AS d_quarter, date_diff('month', o_orderdate, e) AS d_month, "
        "CAST(date_diff('day', date_trunc('week', o_orderdate + INTERVAL 1 DAY), date_trunc('week', e + INTERVAL 1 DAY)) / 7 AS BIGINT) AS d_week, date_diff('day', o_orderdate, e) AS d_day, date_diff('hour', o_orderdate, e) AS d_hour, "
        "o_orderdate + INTERVAL 10 DAY AS plus_days, o_orderdate + INTERVAL 1 MONTH AS plus_month, last_day(o_orderdate) AS eom, year(o_orderdate) AS y, month(o_orderdate) AS m, "
        "day(o_orderdate) AS dd, quarter(o_orderdate) AS q FROM (SELECT *, TIMESTAMP '1996-07-15 10:20:30' AS e FROM orders)"
    ),
    "fn_numbers": (
        "SELECT c_custkey, abs(c_acctbal) AS abs, ceil(c_acctbal)::BIGINT AS ceil, floor(c_acctbal)::BIGINT AS floor, round(c_acctbal * c_acctbal, 6) AS sq, round(sqrt(abs(c_acctbal)), 6) AS sqrt, "
        "round(ln(abs(c_acctbal) + 1), 6) AS ln, round(log10(abs(c_acctbal) + 1), 6) AS lg, sign(c_acctbal)::BIGINT AS sign, round(sin(c_acctbal), 6) AS sin, round(atan2(c_acctbal, 2.0), 6) AS atn2, "
        "round(degrees(1.0::DOUBLE * c_nationkey), 6) AS deg, round(pow(c_nationkey::DOUBLE, 2), 6) AS pow FROM customer"
    ),
    "fn_logic": (
        "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END AS iif, CASE c_custkey % 4 WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' END AS choose, "
        "coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS isnull, try_cast(substring(c_name, 10, 9) AS BIGINT) AS tc, sha256(c_mktsegment) AS hash FROM customer"
    ),
    "fn_aggregates": (
        "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS avg, min(l_quantity) AS lo, max(l_quantity) AS hi, round(stddev_samp(l_quantity), 6) AS sd, "
        "round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 5) AS v, round(var_pop(l_quantity), 5) AS vp FROM lineitem GROUP BY 1"
    ),
    "fn_json": "SELECT event_id, json_valid(props)::BIGINT AS ok FROM events",
}
