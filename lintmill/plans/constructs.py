"""More constructs and functions as queries, and the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintmill.functions import tsql as T
from lintmill.session import cut, table

f = T.FUNCTIONS


# -- joins and sources -------------------------------------------------------------


def pair_right_join(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 200000").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return big.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "right").select("c_custkey", "n")


def pair_cross_join(spark: SparkSession, d: str) -> DataFrame:
    """CROSS JOIN of two dimension tables of fixed size."""
    return table(spark, d, "region").crossJoin(table(spark, d, "nation")).select("r_regionkey", "n_nationkey", (F.col("r_regionkey") == F.col("n_regionkey")).alias("own"))


def pair_outer_apply(spark: SparkSession, d: str) -> DataFrame:
    """OUTER APPLY (TOP 1 ... ORDER BY): rows without a match stay."""
    top = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("top_order"))
    return table(spark, d, "customer").join(top, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "top_order")


def pair_join_hints(spark: SparkSession, d: str) -> DataFrame:
    """MERGE, HASH and LOOP hints name a strategy; the result is the same."""
    o, c = table(spark, d, "orders").select("o_custkey", "o_totalprice"), table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    merged = o.hint("merge").join(c, F.col("o_custkey") == F.col("c_custkey"))
    hashed = o.join(c.hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey"))
    return merged.select("c_mktsegment", F.lit("merge").alias("how")).unionByName(hashed.select("c_mktsegment", F.lit("hash").alias("how"))).groupBy("how", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def pair_always_true_on(spark: SparkSession, d: str) -> DataFrame:
    """JOIN ... ON 1 = 1 against the join that was meant."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    return r.crossJoin(n).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("r_regionkey") == F.col("n_regionkey")).alias("meant"))


def pair_table_function(spark: SparkSession, d: str) -> DataFrame:
    """STRING_SPLIT and GENERATE_SERIES in FROM."""
    words = table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    series = spark.range(1, 11).select(F.col("id").alias("value"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).select("word", "n")
    return counted.unionByName(series.select(F.concat(F.lit("#"), F.col("value").cast("string")).alias("word"), F.col("value").alias("n")))


def pair_not_in(spark: SparkSession, d: str) -> DataFrame:
    """NOT IN over a list with NULL gives no row; NOT EXISTS gives the rest."""
    n = table(spark, d, "nation")
    listed = table(spark, d, "region").where("r_regionkey < 2").select(F.col("r_regionkey").alias("k"))
    with_null = listed.unionByName(spark.createDataFrame([(None,)], listed.schema))
    n.createOrReplaceTempView("pair_not_in_nation")
    with_null.createOrReplaceTempView("pair_not_in_keys")
    none = spark.sql("SELECT 'not in' AS how, n_nationkey FROM pair_not_in_nation WHERE n_regionkey NOT IN (SELECT k FROM pair_not_in_keys)")
    rest = n.join(with_null, F.col("n_regionkey") == F.col("k"), "left_anti").select(F.lit("not exists").alias("how"), "n_nationkey")
    return none.unionByName(rest)


def pair_contains(spark: SparkSession, d: str) -> DataFrame:
    """CONTAINS(text, '"formatter" AND NOT "parser"') as a search for whole words."""
    has = lambda w: F.col("text").rlike(rf"(?i)\b{w}\b")
    return table(spark, d, "documents").where(has("formatter") & ~has("parser")).select("doc_id")


# -- statements that change rows: the new state and what OUTPUT would give ---------------


def pair_select_into(spark: SparkSession, d: str) -> DataFrame:
    """SELECT ... INTO #t, then a query of #t: a table written once."""
    t = cut(table(spark, d, "lineitem").where("l_quantity > 40").select("l_orderkey", "l_quantity"))
    return t.agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("least"))


def pair_insert_select(spark: SparkSession, d: str) -> DataFrame:
    """INSERT INTO t (k, name) SELECT ...: columns by name, not by place."""
    t = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    return t.unionByName(table(spark, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") + 100).alias("k")))


def pair_update_output(spark: SparkSession, d: str) -> DataFrame:
    """UPDATE ... OUTPUT deleted.c_acctbal, inserted.c_acctbal."""
    c = table(spark, d, "customer")
    return c.where("c_acctbal < 0").select("c_custkey", F.col("c_acctbal").alias("before"), F.lit(0.0).alias("after"))


def pair_delete(spark: SparkSession, d: str) -> DataFrame:
    """DELETE with a join: what stays; a NULL condition deletes nothing."""
    gone = F.coalesce(F.col("o_orderstatus") == "F", F.lit(False)) & (F.col("o_totalprice") < 50000)
    return table(spark, d, "orders").where(~gone).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def pair_openrowset(spark: SparkSession, d: str) -> DataFrame:
    """OPENROWSET(BULK ...): a file read where it is named, only the columns asked for."""
    return spark.read.parquet(f"{d}/supplier.parquet").where("s_acctbal > 5000").select("s_suppkey", "s_nationkey")


def pair_dml_source(spark: SparkSession, d: str) -> DataFrame:
    """INSERT INTO archive SELECT ... FROM (DELETE ... OUTPUT deleted.*): the rows that leave one table enter the other."""
    gone = F.coalesce(F.col("o_orderstatus") == "F", F.lit(False)) & (F.col("o_totalprice") > 250000)
    o = table(spark, d, "orders")
    kept, moved = o.where(~gone), o.where(gone)
    return kept.select("o_orderkey", F.lit("orders").alias("place")).unionByName(moved.select("o_orderkey", F.lit("archive").alias("place"))).groupBy("place").agg(F.count(F.lit(1)).alias("n"))


def pair_full_text_table(spark: SparkSession, d: str) -> DataFrame:
    """CONTAINSTABLE(.., 'formatter', 10): keys by rank, here the number of hits."""
    hits = F.regexp_count(F.lower("text"), F.lit(r"\bformatter\b"))
    return table(spark, d, "documents").select("doc_id", hits.cast("long").alias("rank")).where("rank > 0").orderBy(F.desc("rank"), "doc_id").limit(10)


def pair_changetable(spark: SparkSession, d: str) -> DataFrame:
    """CHANGETABLE(CHANGES ..): rows inserted, updated and deleted between two states."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    old = c.where("c_custkey % 10 <> 0").alias("o")
    new = c.where("c_custkey % 7 <> 0").withColumn("c_acctbal", F.when(F.col("c_acctbal") < 0, F.lit(0.0)).otherwise(F.col("c_acctbal"))).alias("n")
    both = old.join(new, F.col("o.c_custkey") == F.col("n.c_custkey"), "full")
    kind = F.when(F.col("o.c_custkey").isNull(), "I").when(F.col("n.c_custkey").isNull(), "D").when(F.col("o.c_acctbal") != F.col("n.c_acctbal"), "U")
    return both.select(F.coalesce("o.c_custkey", "n.c_custkey").alias("key"), kind.alias("operation")).where("operation is not null")


def pair_first_last_value(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return table(spark, d, "orders").select("o_orderkey", F.first("o_totalprice").over(w).alias("first"), F.last("o_totalprice").over(w).alias("last"))


# -- functions ------------------------------------------------------------------------------


def fn_trigonometry(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("n_nationkey") / 30.0
    names = ("ACOS", "ASIN", "ATAN", "COS", "TAN", "EXP", "RADIANS")
    return table(spark, d, "nation").select("n_nationkey", *[F.round(f[n](x), 9).alias(n.lower()) for n in names], f["ROUND"](x * 100, 1).alias("rounded"))


def fn_texts(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("p_name")
    k = F.pmod(F.col("p_partkey"), F.lit(26)).cast("int") + 65
    return table(spark, d, "part").select(
        "p_partkey", f["LTRIM"](F.concat(F.lit("  "), x)).alias("lt"), f["RTRIM"](F.concat(x, F.lit("  "))).alias("rt"), F.concat(x, f["SPACE"](3), F.lit("|")).alias("sp"),
        f["UNICODE"](x).cast("long").alias("uni"), f["CHAR"](k).alias("ch"), f["NCHAR"](k).alias("nch"), f["CAST"](F.col("p_size"), "string").alias("ca"),
        f["CONVERT"]("string", F.col("p_partkey")).alias("cv"), f["TRY_CONVERT"]("int", x).alias("tcv"), f["PARSE"](F.col("p_size").cast("string"), "bigint").alias("pa"),
        f["TRY_PARSE"](x, "bigint").alias("tp"), f["COALESCE"](F.nullif(x, x), F.lit("none")).alias("co"),
    )


def fn_date_parts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("int")
    y, mo, day = F.lit(2000) + k, F.pmod(k, F.lit(12)) + 1, F.pmod(k * 3, F.lit(28)) + 1
    t = f["DATETIME2FROMPARTS"](y, mo, day, F.pmod(k, F.lit(24)), F.lit(5) + k, F.lit(9))
    return table(spark, d, "nation").select(
        "n_nationkey", f["DATEFROMPARTS"](y, mo, day).alias("d"), t.alias("dt2"), f["DATETIMEFROMPARTS"](y, mo, day, 1, 2, 3).alias("dt"),
        f["SMALLDATETIMEFROMPARTS"](y, mo, day, 1, 2).alias("sdt"), f["DATETIMEOFFSETFROMPARTS"](y, mo, day, 4, 5, 6).alias("dto"), f["TIMEFROMPARTS"](F.pmod(k, F.lit(30)), 5, 6, 7, 2).alias("tm"),
        f["DATETRUNC"]("month", t).cast("timestamp_ntz").alias("tr"), f["DATE_BUCKET"]("week", 2, t).alias("bw"), f["DATE_BUCKET"]("month", 5, t).alias("bm"), f["DATE_BUCKET"]("hour", 7, t).alias("bh"),
        f["DATEDIFF_BIG"]("minute", F.lit("2000-01-01").cast("timestamp_ntz"), t).cast("long").alias("big"), f["DATENAME"]("year", t).alias("dn"),
        f["ISDATE"](F.concat(F.lit("2001-01-"), (k + 10).cast("string"))).cast("long").alias("isd"),
    )


def fn_json_values(spark: SparkSession, d: str) -> DataFrame:
    js = F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.struct(F.col("n_name").alias("name")).alias("o")))
    return table(spark, d, "nation").select(
        "n_nationkey", f["JSON_VALUE"](js, "$.o.name").alias("v"), f["JSON_QUERY"](js, "$.o").alias("q"),
        f["JSON_VALUE"](f["JSON_MODIFY"](js, "k", "7"), "$.k").alias("m"), f["ISJSON"](js).cast("long").alias("ok"),
    )


def fn_xml(spark: SparkSession, d: str) -> DataFrame:
    """FOR XML written, OPENXML read again."""
    xml = f["FOR XML"](F.struct("n_nationkey", "n_name"))
    n = table(spark, d, "nation")
    return n.select("n_nationkey", F.element_at(f["OPENXML"](xml, F.lit("//n_name/text()")), 1).alias("name"))


def fn_moments(spark: SparkSession, d: str) -> DataFrame:
    now = [f[n]() for n in ("GETDATE", "SYSDATETIME", "GETUTCDATE", "SYSUTCDATETIME", "SYSDATETIMEOFFSET", "CURRENT_TIMESTAMP")]
    return spark.range(1).select((now[0] == now[1]).alias("local"), ((now[2] == now[3]) & (now[3] == now[4]) & (now[4] == now[5])).alias("utc"), (F.year(now[5]) > 2000).alias("real"))


def fn_session(spark: SparkSession, d: str) -> DataFrame:
    users = [f[n]() for n in ("CURRENT_USER", "SESSION_USER", "SYSTEM_USER", "USER", "USER_NAME", "SUSER_NAME")]
    same = users[0].isNotNull()
    for u in users[1:]:
        same = same & (u == users[0])
    n = table(spark, d, "nation")
    return spark.range(1).select(
        same.alias("users"), f["DB_NAME"]().alias("db"), f["SCHEMA_NAME"]().alias("schema"), f["@@VERSION"]().isNotNull().alias("version"),
        F.lit(f["COL_NAME"](n, 2)).alias("second"), F.lit(f["COL_LENGTH"](n, "n_name")).cast("long").alias("length"),
    )


def fn_identifiers(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "customer").select(f["NEWID"]().alias("a"), f["NEWSEQUENTIALID"]().alias("b"), f["RAND"](7).alias("r"))
    return ids.agg(
        (F.countDistinct("a") == F.count(F.lit(1))).alias("new_ids"), (F.countDistinct("b") == F.count(F.lit(1))).alias("sequential"),
        F.min(F.length("b") == 36).alias("form"), F.min((F.col("r") >= 0) & (F.col("r") < 1)).alias("random"),
    )


def fn_checksums(spark: SparkSession, d: str) -> DataFrame:
    """Equal rows have equal checksums; the aggregate doesn't depend on the order of rows; the estimate is near."""
    o = table(spark, d, "orders")
    sums = o.select("o_custkey", f["CHECKSUM"](F.col("o_custkey")).alias("c"), f["BINARY_CHECKSUM"](F.col("o_custkey")).alias("b"))
    down = sums.orderBy(F.desc("o_custkey")).agg(f["CHECKSUM_AGG"](F.col("c")).alias("down"))
    up = sums.agg(
        (F.countDistinct("c", "b") == F.countDistinct("o_custkey")).alias("same"), f["CHECKSUM_AGG"](F.col("c")).alias("up"),
        (F.abs(f["APPROX_COUNT_DISTINCT"](F.col("o_custkey")) / F.countDistinct("o_custkey") - 1) < 0.1).alias("near"),
    )
    return up.join(down, F.col("up") == F.col("down"), "left").select("same", F.col("down").isNotNull().alias("agg"), "near")


def fn_grouping(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.cube("n_regionkey", "c_mktsegment").agg(
        f["GROUPING"]("n_regionkey").cast("long").alias("g1"), f["GROUPING_ID"]("n_regionkey", "c_mktsegment").cast("long").alias("gid"), f["COUNT"](F.lit(1)).alias("n")
    )


QUERIES = {k: v for k, v in globals().items() if k.startswith(("pair_", "fn_"))}

_DAYS = "make_date(2000 + k, k % 12 + 1, k * 3 % 28 + 1)"
ORACLES = {
    "pair_right_join": "SELECT c_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1) RIGHT JOIN customer ON o_custkey = c_custkey",
    "pair_cross_join": "SELECT r_regionkey, n_nationkey, r_regionkey = n_regionkey AS own FROM region CROSS JOIN nation",
    "pair_outer_apply": "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1) AS top_order FROM customer",
    "pair_join_hints": "SELECT how, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey, (VALUES ('merge'), ('hash')) AS v(how) GROUP BY ALL",
    "pair_always_true_on": "SELECT count(*) AS pairs, count(*) FILTER (r_regionkey = n_regionkey) AS meant FROM region JOIN nation ON 1 = 1",
    "pair_table_function": "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word UNION ALL SELECT '#' || CAST(i AS VARCHAR), i FROM range(1, 11) AS t(i)",
    "pair_not_in": "SELECT 'not exists' AS how, n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey < 2)",
    "pair_contains": "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\\bformatter\\b') AND NOT regexp_matches(text, '(?i)\\bparser\\b')",
    "pair_select_into": "SELECT count(*) AS n, min(l_quantity) AS least FROM lineitem WHERE l_quantity > 40",
    "pair_insert_select": "SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation",
    "pair_update_output": "SELECT c_custkey, c_acctbal AS before, 0.0::DOUBLE AS after FROM customer WHERE c_acctbal < 0",
    "pair_delete": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE NOT (o_orderstatus IS NOT DISTINCT FROM 'F' AND o_totalprice < 50000) GROUP BY 1",
    "pair_openrowset": "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "pair_dml_source": "SELECT CASE WHEN o_orderstatus = 'F' AND o_totalprice > 250000 THEN 'archive' ELSE 'orders' END AS place, count(*) AS n FROM orders GROUP BY 1",
    "pair_full_text_table": (
        "SELECT doc_id, len(regexp_extract_all(lower(text), '\\bformatter\\b'))::BIGINT AS rank FROM documents WHERE regexp_matches(lower(text), '\\bformatter\\b') ORDER BY rank DESC, doc_id LIMIT 10"
    ),
    "pair_changetable": (
        "SELECT key, operation FROM (SELECT coalesce(o.c_custkey, n.c_custkey) AS key, CASE WHEN o.c_custkey IS NULL THEN 'I' WHEN n.c_custkey IS NULL THEN 'D' WHEN o.c_acctbal <> n.b THEN 'U' END AS operation "
        "FROM (SELECT * FROM customer WHERE c_custkey % 10 <> 0) o FULL JOIN (SELECT c_custkey, greatest(c_acctbal, 0.0) AS b FROM customer WHERE c_custkey % 7 <> 0) n ON o.c_custkey = n.c_custkey) WHERE operation IS NOT NULL"
    ),
    "pair_first_last_value": (
        "SELECT o_orderkey, first_value(o_totalprice) OVER w AS first, last_value(o_totalprice) OVER w AS last FROM orders "
        "WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    ),
    "fn_trigonometry": (
        "SELECT n_nationkey, round(acos(x), 9) AS acos, round(asin(x), 9) AS asin, round(atan(x), 9) AS atan, round(cos(x), 9) AS cos, round(tan(x), 9) AS tan, round(exp(x), 9) AS exp, "
        "round(radians(x), 9) AS radians, round(x * 100, 1) AS rounded FROM (SELECT n_nationkey, n_nationkey / 30.0::DOUBLE AS x FROM nation)"
    ),
    "fn_texts": (
        "SELECT p_partkey, p_name AS lt, p_name AS rt, p_name || '   |' AS sp, unicode(p_name)::BIGINT AS uni, chr((p_partkey % 26 + 65)::INTEGER) AS ch, chr((p_partkey % 26 + 65)::INTEGER) AS nch, "
        "CAST(p_size AS VARCHAR) AS ca, CAST(p_partkey AS VARCHAR) AS cv, try_cast(p_name AS INTEGER) AS tcv, p_size::BIGINT AS pa, try_cast(p_name AS BIGINT) AS tp, 'none' AS co FROM part"
    ),
    "fn_date_parts": (
        f"SELECT n_nationkey, {_DAYS} AS d, t AS dt2, {_DAYS} + INTERVAL 3723 SECOND AS dt, {_DAYS} + INTERVAL 3720 SECOND AS sdt, {_DAYS} + INTERVAL 14706 SECOND AS dto, "
        "lpad(CAST(k % 30 AS VARCHAR), 2, '0') || ':05:06.07' AS tm, date_trunc('month', t)::TIMESTAMP AS tr, "
        "time_bucket(INTERVAL 14 DAY, t, TIMESTAMP '1900-01-01') AS bw, TIMESTAMP '1900-01-01' + to_months((date_diff('month', TIMESTAMP '1900-01-01', t) // 5 * 5)::INTEGER) AS bm, "
        "time_bucket(INTERVAL 7 HOUR, t, TIMESTAMP '1900-01-01') AS bh, date_diff('minute', TIMESTAMP '2000-01-01', t) AS big, CAST(year(t) AS VARCHAR) AS dn, (k + 10 <= 31)::BIGINT AS isd "
        f"FROM (SELECT n_nationkey, n_nationkey::INTEGER AS k, make_timestamp(2000 + n_nationkey, n_nationkey % 12 + 1, n_nationkey * 3 % 28 + 1, n_nationkey % 24, 5 + n_nationkey, 9) AS t FROM nation)"
    ),
    "fn_json_values": "SELECT n_nationkey, n_name AS v, '{\"name\":\"' || n_name || '\"}' AS q, '7' AS m, 1::BIGINT AS ok FROM nation",
    "fn_xml": "SELECT n_nationkey, n_name AS name FROM nation",
    "fn_moments": "SELECT true AS local, true AS utc, true AS real",
    "fn_session": "SELECT true AS users, 'default' AS db, 'default' AS schema, true AS version, 'n_name' AS second, -1::BIGINT AS length",
    "fn_identifiers": "SELECT true AS new_ids, true AS sequential, true AS form, true AS random",
    "fn_checksums": "SELECT true AS same, true AS agg, true AS near",
    "fn_grouping": (
        "SELECT n_regionkey, c_mktsegment, grouping(n_regionkey)::BIGINT AS g1, grouping(n_regionkey, c_mktsegment)::BIGINT AS gid, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey "
        "GROUP BY CUBE (n_regionkey, c_mktsegment)"
    ),
}
