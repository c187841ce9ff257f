"""Queries of the general data problems (4 and 5) and the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintmill.operators import hot_keys, nested_reports
from lintmill.session import table

SHARE = 0.05
QUANTILES = [0.5, 0.9]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.heavy_keys(table(spark, d, "diagnostics"), "code", SHARE).select(F.col("key").alias("code"))


def p4_codes(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.code_report(table(spark, d, "diagnostics"))


def p4_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.code_quantiles(table(spark, d, "diagnostics"), QUANTILES)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nested_reports.found(table(spark, d, "lint_results"))


def _reports(name: str, *columns: str):
    """Query of one of the flat tables; ``copy``, which tells equal rows of a delivery apart, is left out."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        out = getattr(nested_reports, name)(table(spark, d, "lint_results"))
        return out.select(*columns) if columns else out.drop("copy")

    return query


p5_results = _reports("results_table", "result_id", "complete", "tool", "version", "command")
p5_files = _reports("files_table", "result_id", "file_ord", "file_path")
p5_diagnostics = _reports("diagnostics_table", "result_id", "file_ord", "diag_ord", "code", "message", "severity", "source")
p5_tags = _reports("tags_table", "result_id", "file_ord", "diag_ord", "ord", "tag")
p5_ranges = _reports("ranges_table")
p5_data = _reports("data_table")
p5_related = _reports("related_table")


QUERIES = {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}

#: Reports, files and diagnostics of the payloads: decoded as often as they are strings of JSON, member names without case and signs.
_NODES = """WITH RECURSIVE
 raw AS (SELECT result_id, row_number() OVER () AS c, trim(payload, chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) AS t FROM lint_results),
 decoded AS (
  SELECT result_id, c, t AS j FROM raw WHERE json_valid(t)
  UNION ALL
  SELECT result_id, c, json_extract_string(j, '$') FROM decoded WHERE json_type(j) = 'VARCHAR' AND json_valid(json_extract_string(j, '$'))),
 docs AS (SELECT result_id, c, j FROM decoded WHERE json_type(j) = 'OBJECT'),
 tree AS (SELECT result_id, c, t.id, t.parent, t.type, t.key, regexp_replace(lower(t.key), '[^a-z0-9]', '', 'g') AS name,
   CASE t.type WHEN 'VARCHAR' THEN json_extract_string(t.value, '$') WHEN 'NULL' THEN NULL ELSE CAST(t.value AS VARCHAR) END AS txt FROM docs, json_tree(docs.j) AS t),
 top AS (SELECT c, min(id) AS id FROM tree WHERE name = 'files' GROUP BY c),
 report AS (SELECT t.result_id, t.c, t.id, t.parent, t.type FROM tree t JOIN top USING (c, id)),
 file AS (SELECT r.result_id, r.c, t.id, CASE WHEN r.type = 'ARRAY' THEN CAST(t.key AS BIGINT) ELSE 0 END AS file_ord
   FROM report r JOIN tree t ON t.c = r.c AND t.type = 'OBJECT' AND (r.type = 'ARRAY' AND t.parent = r.id OR r.type = 'OBJECT' AND t.id = r.id)),
 diags AS (SELECT f.result_id, f.c, f.file_ord, t.id, t.type FROM file f JOIN tree t ON t.c = f.c AND t.parent = f.id AND t.name = 'diagnostics'),
 diag AS (SELECT d.result_id, d.c, d.file_ord, t.id, CASE WHEN d.type = 'ARRAY' THEN CAST(t.key AS BIGINT) ELSE 0 END AS diag_ord
   FROM diags d JOIN tree t ON t.c = d.c AND t.type = 'OBJECT' AND (d.type = 'ARRAY' AND t.parent = d.id OR d.type = 'OBJECT' AND t.id = d.id)),
 member AS (SELECT c, parent, name, max(txt) AS txt FROM tree GROUP BY c, parent, name)
"""


def _member(of: str, name: str) -> str:
    return f"(SELECT m.txt FROM member m WHERE m.c = {of}.c AND m.parent = {of}.id AND m.name = '{name}')"


ORACLES = {
    "p5_found": _NODES
    + f"SELECT d.result_id, d.file_ord, d.diag_ord, coalesce({_member('f', 'filepath')}, '') AS file_path, coalesce({_member('d', 'code')}, '') AS code "
    "FROM diag d JOIN file f ON f.c = d.c AND f.file_ord = d.file_ord",
    "p5_results": _NODES
    + ", holder AS (SELECT d.result_id, d.c, coalesce(r.parent, 0) AS id FROM docs d LEFT JOIN report r USING (c)) "
    + "SELECT raw.result_id, h.c IS NOT NULL AS complete, "
    + ", ".join(f"{_member('h', n)} AS {n}" for n in ("tool", "version", "command"))
    + " FROM raw LEFT JOIN holder h USING (c)",
    "p5_files": _NODES + f"SELECT f.result_id, f.file_ord, {_member('f', 'filepath')} AS file_path FROM file f",
    "p5_diagnostics": _NODES + "SELECT d.result_id, d.file_ord, d.diag_ord, " + ", ".join(f"{_member('d', n)} AS {n}" for n in ("code", "message", "severity", "source")) + " FROM diag d",
    "p5_tags": _NODES
    + ", tags AS (SELECT d.*, t.id AS tag_id, t.type, t.txt FROM diag d JOIN tree t ON t.c = d.c AND t.parent = d.id AND t.name = 'tags' AND t.type <> 'NULL') "
    "SELECT g.result_id, g.file_ord, g.diag_ord, CASE WHEN g.type = 'ARRAY' THEN CAST(t.key AS BIGINT) ELSE 0 END AS ord, coalesce(t.txt, g.txt) AS tag "
    "FROM tags g LEFT JOIN tree t ON g.type = 'ARRAY' AND t.c = g.c AND t.parent = g.tag_id WHERE coalesce(t.txt, CASE WHEN g.type <> 'ARRAY' THEN g.txt END) IS NOT NULL",
    "p4_found": "SELECT code FROM diagnostics WHERE code IS NOT NULL GROUP BY code HAVING count(*) >= 0.05 * (SELECT count(*) FROM diagnostics)",
    "p4_codes": (
        "SELECT code, count(*) AS n, min(reported_at) AS first_report, max(reported_at) AS last_report, "
        "count(DISTINCT script_id) AS scripts FROM diagnostics WHERE code IS NOT NULL GROUP BY code"
    ),
    "p4_quantiles": (
        "SELECT code, count(*) AS n, quantile_disc(reported_at, 0.5) AS q50_report, quantile_disc(reported_at, 0.9) AS q90_report "
        "FROM diagnostics WHERE code IS NOT NULL GROUP BY code"
    ),
}
