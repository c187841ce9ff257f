"""Lint, fix and tokenize collections of scripts; one Arrow-batched pass each, no shuffle.

A script is analysed where it is read, as no rule looks beyond one script.  Ruleset, threshold
and directives are applied in the same pass, so only what is reported leaves it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintmill.arrow import map_lists
from lintmill.rules import engine
from lintmill.rules.catalog import LABELS, RULES
from lintmill.rules.engine import Options
from lintmill.rules.model import Script
from lintmill.rules.rulesets import ConfigError, Ruleset

DIAGNOSTICS = (
    "script_id long, file_path string, code string, severity int, category string, fixable boolean, message string, "
    "start_line int, start_char int, end_line int, end_char int, parse_error boolean, source_line string"
)
FIXED = (
    "script_id long, file_path string, fixed_text string, changed boolean, applied array<string>, "
    "skipped array<struct<rule_id: string, reason: string>>, remaining int"
)
TOKENS = "script_id long, idx int, class string, text string, line int, char_pos int, length int, start long"
RANGES = "script_id long, file_path string, rule_id string, start_line int, end_line int"


def lint(scripts: DataFrame, options: Options = Options()) -> DataFrame:
    """One row per diagnostic of ``script_id, file_path, text``; a null text has none.  Of parse errors ``source_line`` is the line they stand on."""

    def run(ids, paths, texts):
        for i, p, t in zip(ids, paths, texts):
            if t is None:
                continue
            lines = None
            for d in engine.diagnose(t, p, options):
                if d.parse_error and lines is None:
                    lines = re.split(r"\r\n|\r|\n", t)
                yield i, p, d.code, d.severity, d.category, d.fixable, d.message, *d.start, *d.end, d.parse_error, lines[d.start[0]] if d.parse_error else None

    return map_lists(scripts, ["script_id", "file_path", "text"], run, DIAGNOSTICS)


def fix(scripts: DataFrame, options: Options = Options()) -> DataFrame:
    """Text of every script after one round of fixes, what was applied and skipped, and how many diagnostics remain."""

    def run(ids, paths, texts):
        for i, p, t in zip(ids, paths, texts):
            if t is None:
                continue
            found = list(engine.diagnose(t, p, options))
            new, applied, skipped = engine.fix_found(t, found)
            left = list(engine.diagnose(new, p, options)) if new != t else found
            yield i, p, new, new != t, applied, [{"rule_id": r, "reason": w} for r, w in skipped], len(left)

    return map_lists(scripts, ["script_id", "file_path", "text"], run, FIXED)


def tokens(scripts: DataFrame) -> DataFrame:
    """All lexemes of the scripts; together they are the text."""

    def run(ids, texts):
        for i, t in zip(ids, texts):
            if t:
                for row in engine.tokens(t):
                    yield i, *row

    return map_lists(scripts, ["script_id", "text"], run, TOKENS)


def disabled_ranges(scripts: DataFrame, prefix: str = engine.PREFIX) -> DataFrame:
    """Ranges that directives in comments switch off: ``[start_line, end_line)``, null rule for all, null end for the rest."""

    def run(ids, paths, texts):
        for i, p, t in zip(ids, paths, texts):
            if t and f"{prefix}-" in t.lower():
                for rule, a, z in engine.directives(Script(p, t), prefix):
                    yield i, p, rule, a, z

    return map_lists(scripts, ["script_id", "file_path", "text"], run, RANGES)


def suppress(diagnostics: DataFrame, ranges: DataFrame, line: str = "start_line", code: str = "code") -> DataFrame:
    """Interval anti-join: diagnostics that lie in no range of their script.

    Rows meet on the script id; the ranges of a script are few, so the join stays linear in the
    diagnostics.  A diagnostic of no code is only switched off by a range for all rules.
    """
    r = ranges.select(
        F.col("script_id").alias("r_script"), F.lower("rule_id").alias("r_rule"), F.col("start_line").alias("r_start"), F.col("end_line").alias("r_end")
    ).distinct()
    hit = (
        (F.col("script_id") == F.col("r_script"))
        & (F.col("r_rule").isNull() | (F.col("r_rule") == F.lower(F.col(code))))
        & (F.col(line) >= F.col("r_start"))
        & (F.col("r_end").isNull() | (F.col(line) < F.col("r_end")))
    )
    return diagnostics.join(r, hit, "left_anti")


def latest_deliveries(diagnostics: DataFrame) -> DataFrame:
    """One row per ``diag_id``: the one delivered last (ties by the smallest script id); rows of a null id all stay.

    ``max_by`` combines partially, so a row that was delivered many times doesn't gather in one task.
    """
    cols = [c for c in diagnostics.columns if c != "diag_id"]
    newest = (
        diagnostics.where("diag_id is not null")
        .groupBy("diag_id")
        .agg(F.max_by(F.struct(*cols), F.struct(F.col("ingested_at"), -F.col("script_id"))).alias("row"))
        .select("diag_id", *[F.col(f"row.{c}").alias(c) for c in cols])
    )
    return newest.unionByName(diagnostics.where("diag_id is null").select("diag_id", *cols))


def severity_rank(column: str) -> Column:
    """1 Error to 4 Hint; null for none."""
    c = F.lower(F.col(column))
    return (
        F.when(c == "error", 1).when(c == "warning", 2).when(c.isin("information", "info"), 3).when(c == "hint", 4).otherwise(F.lit(None).cast("int"))
    )


def normalise(diagnostics: DataFrame, rules: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Severity from the overrides, else the diagnostic, else the rule, else Warning; category from the rule where missing.

    The catalogue of rules has a fixed size and is checked before it is sent to all executors.
    """
    dim = rules.select(F.lower("rule_id").alias("r_id"), F.col("category").alias("r_category"), F.col("default_severity").alias("r_severity")).dropDuplicates(["r_id"])
    if rules.limit(10_001).count() <= 10_000:
        dim = F.broadcast(dim)
    out = diagnostics.join(dim, F.lower(F.col("code")) == F.col("r_id"), "left")
    own = F.col("severity")
    if overrides:
        pairs = [x for k, v in sorted(overrides.items()) for x in (F.lit(k.lower()), F.lit(v))]
        own = F.coalesce(F.create_map(*pairs)[F.lower(F.col("code"))], own)
    return out.withColumn("severity", F.coalesce(own, F.col("r_severity"), F.lit("Warning"))).withColumn(
        "category", F.coalesce(F.col("diag_data.category"), F.col("r_category"))
    ).drop("r_id", "r_category", "r_severity")


def above_threshold(diagnostics: DataFrame, threshold: str) -> DataFrame:
    """Diagnostics at least as severe as the threshold."""
    from lintmill.rules.rulesets import severity_rank as rank

    return diagnostics.where(severity_rank("severity") <= rank(threshold))


def summary(diagnostics: DataFrame) -> DataFrame:
    """One row: diagnostics, errors, warnings, fixable, files, any parse error."""
    return diagnostics.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("severity") == 1).alias("errors"),
        F.count_if(F.col("severity") == 2).alias("warnings"),
        F.count_if(F.col("fixable")).alias("fixable"),
        F.countDistinct("script_id").alias("files"),
        F.coalesce(F.max("parse_error"), F.lit(False)).alias("any_parse_error"),
    )


def by_rule(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics and scripts per rule."""
    per_script = diagnostics.groupBy("code", "severity", "script_id").agg(F.count(F.lit(1)).alias("m"))
    return per_script.groupBy("code", "severity").agg(F.sum("m").alias("diagnostics"), F.count(F.lit(1)).alias("scripts"))


def worst_scripts(diagnostics: DataFrame, k: int) -> DataFrame:
    """The k scripts of most diagnostics, ties by id."""
    return diagnostics.groupBy("script_id").agg(F.count(F.lit(1)).alias("diagnostics")).orderBy(F.desc("diagnostics"), "script_id").limit(k)


def report_text(diagnostics: DataFrame, context: bool = False) -> DataFrame:
    """Lines ``path:line:column: Severity: message (rule[,Fixable])``, one-based, sorted by path and position.

    With ``context``, the source line of a parse error and a caret under its column follow.
    """
    label = F.create_map(*[x for k, v in LABELS.items() for x in (F.lit(k), F.lit(v))])
    line = F.format_string(
        "%s:%d:%d: %s: %s (%s%s)",
        F.coalesce("file_path", F.lit("<stdin>")), F.col("start_line") + 1, F.col("start_char") + 1, label[F.col("severity")],
        F.col("message"), F.col("code"), F.when(F.col("fixable"), F.lit(",Fixable")).otherwise(F.lit("")),
    )
    sorted_ = diagnostics.orderBy(F.lower("file_path"), "file_path", "start_line", "start_char", "code")
    if not context:
        return sorted_.select(line.alias("value"))
    number = (F.col("start_line") + 1).cast("string")
    source = F.concat(F.lit("  "), number, F.lit(" | "), F.col("source_line"))
    caret = F.concat(F.repeat(F.lit(" "), F.length(number) + 2), F.lit(" | "), F.repeat(F.lit(" "), F.least(F.col("start_char"), F.length("source_line"))), F.lit("^"))
    return sorted_.select(F.explode(F.when(F.col("source_line").isNull(), F.array(line)).otherwise(F.array(line, source, caret))).alias("value"))


def report_json(diagnostics: DataFrame, tool: str = "lintmill", version: str = "0.1.0", command: str = "lint") -> DataFrame:
    """One JSON report per script, nulls left out; diagnostics in order of position."""
    label = F.create_map(*[x for k, v in LABELS.items() for x in (F.lit(k), F.lit(v))])
    d = F.struct(
        F.struct(
            F.struct(F.col("start_line").alias("line"), F.col("start_char").alias("character")).alias("start"),
            F.struct(F.col("end_line").alias("line"), F.col("end_char").alias("character")).alias("end"),
        ).alias("range"),
        F.col("message"), label[F.col("severity")].alias("severity"), F.col("code"), F.lit(tool).alias("source"),
        F.struct(F.col("code").alias("ruleId"), "category", "fixable").alias("data"),
    )
    order = F.struct("start_line", "start_char", "code", d.alias("d"))
    files = diagnostics.groupBy("script_id", "file_path").agg(F.sort_array(F.collect_list(order)).alias("ds"))
    return files.select(
        "script_id",
        F.to_json(
            F.struct(
                F.lit(tool).alias("tool"), F.lit(version).alias("version"), F.lit(command).alias("command"),
                F.array(F.struct(F.col("file_path").alias("filePath"), F.transform("ds", lambda x: x["d"]).alias("diagnostics"))).alias("files"),
            ),
            {"ignoreNullFields": "true"},
        ).alias("report"),
    )


def exit_status(diagnostics: DataFrame) -> int:
    """0 clean, 1 violations, 2 if something doesn't parse."""
    row = summary(diagnostics).first()
    return 2 if row["any_parse_error"] else 1 if row["total"] else 0


def run_status(action: Callable[[], DataFrame]) -> int:
    """``exit_status`` of what the action gives; 3 if settings can't be used, 4 if it fails otherwise."""
    try:
        return exit_status(action())
    except (ConfigError, json.JSONDecodeError, FileNotFoundError):
        return 3
    except Exception:  # noqa: BLE001 - the status is what tells
        return 4


def rule_catalog(spark, category: str | None = None, fixable: bool | None = None, enabled: Ruleset | None = None) -> DataFrame:
    """The rules with category, severity, fixability and smallest preset, sorted by id; only those of a category, that can be fixed, or that a ruleset enables."""
    names = {"S": "security-only", "P": "pragmatic", "R": "recommended", "L": "strict-logic", "C": "strict"}
    kept = [
        r
        for r in sorted(RULES.values(), key=lambda r: r.id)
        if (category is None or r.category.lower() == category.lower()) and (fixable is None or r.fixable == fixable) and (enabled is None or enabled.enabled(r.id))
    ]
    rows = [(r.id, r.category, LABELS[r.severity], r.fixable, names[r.tier], r.min_compat) for r in kept]
    return spark.createDataFrame(rows, "rule_id string, category string, severity string, fixable boolean, preset string, min_compat int")


def line_map(scripts: DataFrame) -> DataFrame:
    """``script_id, line_no, start, length`` of every line (CRLF, CR or LF ends one), zero-based, in characters."""
    broken = F.split(F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "\r", "\n"), "\n", -1)
    return scripts.where("text is not null").select("script_id", F.posexplode(broken).alias("line_no", "line"))


def duplicate_empty_lines(scripts: DataFrame) -> DataFrame:
    """Runs of more than one blank line, by gaps and islands over the line map; partitions are single scripts."""
    lines = line_map(scripts).withColumn("blank", F.trim(F.regexp_replace("line", "[\\t\\f]", " ")) == "")
    w = W.partitionBy("script_id").orderBy("line_no")
    runs = lines.where("blank").withColumn("island", F.col("line_no") - F.row_number().over(w))
    return (
        runs.groupBy("script_id", "island")
        .agg(F.min("line_no").alias("start_line"), F.count(F.lit(1)).alias("run"))
        .where("run > 1")
        .select("script_id", F.col("start_line").cast("long").alias("start_line"), "run")
    )
