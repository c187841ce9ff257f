"""Queries of the problems tagged llm, and the SQL that states the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintmill.session import cut, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from lintmill.llm.syntax_check import invalid_scripts

    return invalid_scripts(table(spark, d, "scripts"))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    from lintmill.llm.syntax_check import invalid_rates

    return invalid_rates(table(spark, d, "scripts"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from lintmill.llm.secrets import credential_lines

    return credential_lines(table(spark, d, "scripts"))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    from lintmill.llm.secrets import redact_credentials

    return redact_credentials(table(spark, d, "scripts"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from lintmill.llm.layout_copies import layout_copies

    return layout_copies(table(spark, d, "scripts"))


def p3_distinct(spark: SparkSession, d: str) -> DataFrame:
    from lintmill.llm.layout_copies import distinct_scripts

    return distinct_scripts(table(spark, d, "scripts"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from lintmill.llm.code_language import languages_found

    return languages_found(table(spark, d, "scripts"), table(spark, d, "documents"))


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    from lintmill.llm.code_language import language_shares

    return language_shares(table(spark, d, "scripts"), table(spark, d, "documents"))


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    from lintmill.llm.code_language import language_texts

    return language_texts(table(spark, d, "scripts"), table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    from lintmill.llm.containers import fill

    return fill(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p7_utilisation(spark: SparkSession, d: str) -> DataFrame:
    from lintmill.llm.containers import utilisation

    return utilisation(p7_containers(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from lintmill.llm.eval_leaks import leaks

    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    from lintmill.llm.eval_leaks import leaked_items

    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from lintmill.llm.stuffed_pages import stuffed_pages

    return stuffed_pages(table(spark, d, "documents"))


# -- what must hold of the results, in terms that SQL can state ----------------------


def p2_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Every script is judged once, by the language that its path names."""
    return p2_rates(spark, d).where("invalid between 0 and scripts").select("repo", "language", "scripts")


def p3_sums(spark: SparkSession, d: str) -> DataFrame:
    """Copies of all distinct scripts add up to the scripts, and members to copies."""
    sets = p3_distinct(spark, d).agg(F.sum("copies").cast("long").alias("scripts"), F.sum(F.col("copies") - 1).cast("long").alias("copies"), F.min("first_id").alias("least"))
    return sets.withColumn("members", p3_found(spark, d).agg(F.count(F.lit(1))).scalar() - F.col("copies")).select("scripts", "members", "least")


def p6_places(spark: SparkSession, d: str) -> DataFrame:
    """Each sentence lies in its script, on its line, and takes the share that its length makes."""
    t = p6_texts(spark, d)
    s = table(spark, d, "scripts").select("script_id", F.col("text").alias("script"))
    breaks = F.regexp_count(F.regexp_replace(F.expr("substring(script, 1, start)"), "\r\n", "\n"), F.lit("[\r\n]"))
    held = F.expr("substring(script, start + 1, length)")
    ok = (F.length(held) == F.col("length")) & (breaks == F.col("line_no")) & F.col("share").between(0, 1) & (F.col("bits") > 0)
    return t.join(s, "script_id").agg(F.count_if(~ok).alias("wrong"), (F.count(F.lit(1)) > 0).alias("some"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every document is placed whole, once; no container holds more than its capacity, which is a permitted one; only what is too long is in pieces."""
    placed = cut(p7_containers(spark, d))
    boxes = placed.groupBy("container").agg(F.sum("tokens").alias("used"), F.max("capacity").alias("capacity"), F.countDistinct("capacity").alias("kinds"))
    docs = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"), F.max("piece").alias("last"))
    most = table(spark, d, "pack_sizes").agg(F.max("capacity_tokens")).scalar()
    a = boxes.agg(F.count_if((F.col("used") > F.col("capacity")) | (F.col("kinds") > 1)).alias("overfull"), (F.sum("used") / F.sum("capacity") > 0.99).alias("dense"))
    b = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("tokens") / most))).alias("split"))
    sizes = boxes.select("capacity").distinct().join(table(spark, d, "pack_sizes"), F.col("capacity") == F.col("capacity_tokens"), "left_anti").agg(F.count(F.lit(1)))
    return b.select("documents", "split", a.select("overfull").scalar().alias("overfull"), a.select("dense").scalar().alias("dense"), sizes.scalar().alias("unknown"))


def p8_suites(spark: SparkSession, d: str) -> DataFrame:
    """Every test item is reported, with the documents that ``p8_found`` gives it."""
    items = p8_items(spark, d)
    return items.groupBy("suite").agg(F.count(F.lit(1)).alias("items"), F.min(F.col("documents") >= 0).alias("counted"))


def p9_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page that isn't blank is measured."""
    from lintmill.llm.stuffed_pages import page_measures

    ok = F.col("unstructured").between(0, 1) & F.col("repeated").between(0, 1) & F.col("stuffing").between(0, F.col("unstructured") + 1e-9)
    return page_measures(table(spark, d, "documents")).where(ok).select("doc_id")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


_LANGUAGE = "CASE lower(regexp_extract(coalesce(file_path, ''), '\\.([A-Za-z0-9]+)\\s*$', 1)) WHEN 'json' THEN 'json' WHEN 'xml' THEN 'xml' ELSE 'tsql' END"


def oracle_sql() -> dict[str, str]:
    return {
        "p2_scripts": f"SELECT repo, {_LANGUAGE} AS language, count(*) AS scripts FROM scripts GROUP BY ALL",
        "p3_sums": "SELECT count(*) AS scripts, 0::BIGINT AS members, min(script_id) AS least FROM scripts WHERE text IS NOT NULL",
        "p6_places": "SELECT 0::BIGINT AS wrong, true AS some",
        "p7_checks": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS split, 0::BIGINT AS overfull, true AS dense, 0::BIGINT AS unknown FROM documents",
        "p8_suites": "SELECT suite, count(*) AS items, true AS counted FROM eval_items GROUP BY suite",
        "p9_pages": "SELECT doc_id FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''",
    }
