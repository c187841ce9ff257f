"""Per-key results when a few keys hold most rows (problem 4).

Method: distributed exact selection.  Values are 64-bit integers and histograms count their high
bits.  Counts of bins are mergeable, so each partition sends a few numbers however many rows it
holds, and a row only ever adds one to a counter.  The bin that holds a wanted rank is refined by
further bits, until the rank resolves.

* ``heavy_keys`` selects over the hashes of the keys themselves: a bin that holds fewer rows than
  the threshold holds no heavy key, and at most ``1 / share`` bins stay to be refined.
* ``quantiles_per_key``: keys of more than ``1 / MOST_HOT`` of all rows, of which there are fewer
  than ``MOST_HOT``, are selected by histograms of their values; their ranges have that bound and
  are broadcast.  A range of at most ``FINISH`` rows is resolved by sorting it.  All other keys are
  too small to hold up a task: their rows meet by the key's hash and are ranked in sorted order, as
  a stream that spills, without a join on a hot key at any size.

Counts, distinct counts and extremes per key combine before they are shuffled, and keys are
salted where something has to be deduplicated.

Defined results: rows with a null key form a key of their own (null) and are left out where
asked; null values don't count for quantiles, a key without values has null quantiles; rows
delivered twice count as they stand; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

SALTS = 16
HASH_BITS = 16  # of the keys' hashes in each round
MOST_HOT = 10_000  # keys that are selected by histograms, at most
MOST_BINS = 4_000_000  # of all histograms of a round
FINISH = 1_000  # rows of a range that are sorted rather than counted again


def distinct_per_key(df: DataFrame, key: str, value: str, salts: int = SALTS) -> DataFrame:
    """``key, distinct``: exact distinct values per key, a key's values spread over ``salts`` tasks.

    Equal values meet in the same salt, so the counts of the salts add up.
    """
    pairs = df.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).alias("v")).distinct()
    salted = pairs.groupBy("key", F.pmod(F.xxhash64("v"), F.lit(salts)).alias("salt")).agg(F.count(F.lit(1)).alias("m"))
    return salted.groupBy("key").agg(F.sum("m").alias("distinct"))


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """``key, n, total`` of the non-null keys that hold at least ``share`` of all rows (rows of a null key count in the total).

    What is shuffled is 2 ** ``HASH_BITS`` counts a partition in the first round and those of the few bins left
    afterwards, never the long tail of keys.
    """
    rows = df.select(F.col(key).alias("key"), F.xxhash64(key).alias("hash"))
    total = df.count()
    shift, bins, fewer = 64, None, True
    while shift > 0 and fewer and bins != []:
        shift -= HASH_BITS
        counted = _within(rows, bins, shift + HASH_BITS).where(F.col("key").isNotNull()).groupBy(F.shiftright("hash", shift).alias("bin")).agg(F.count(F.lit(1)).alias("m"))
        full = counted.where(F.col("m") >= total * share).select("bin").collect()  # 1 / share at most
        fewer = bins is None or len(full) < len(bins)  # else further bits part nothing more, most likely
        bins = [(r["bin"],) for r in full]
    held = _within(rows, bins, shift).where(F.col("key").isNotNull())
    return held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= total * share).withColumn("total", F.lit(total).cast("long"))


def _within(rows: DataFrame, bins: list[tuple] | None, shift: int) -> DataFrame:
    """Rows whose hash lies in the bins of a round."""
    if bins is None:
        return rows
    if not bins:
        return rows.limit(0)
    kept = rows.sparkSession.createDataFrame(bins, "bin long")
    return rows.withColumn("bin", F.shiftright("hash", shift)).join(F.broadcast(kept), "bin", "left_semi").drop("bin")


def quantiles_per_key(df: DataFrame, key: str, value: str | Column, quantiles: list[float], most_hot: int = MOST_HOT, finish: int = FINISH) -> DataFrame:
    """``key, n, v0, v1, ..``: rows of each key and its exact quantiles (lower: the value of rank ceil(q * values))."""
    v = (F.col(value) if isinstance(value, str) else value).cast("long")
    rows = df.select(F.col(key).alias("key"), v.alias("v"))
    total = rows.agg(F.count("v")).first()[0]
    limits = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    hot = [tuple(r) for r in limits.where(F.col("k") > total / most_hot).collect()]  # fewer than most_hot
    names = [f"v{i}" for i in range(len(quantiles))]
    cold, of_hot = rows, None
    if hot:
        key_field = StructField("key", rows.schema["key"].dataType)
        found = _select(rows, hot, quantiles, key_field, finish)
        of_hot = df.sparkSession.createDataFrame(found, StructType([key_field, *(StructField(x, LongType()) for x in ("n", *names))]))
        keys = F.broadcast(of_hot.select(F.col("key").alias("hot")))
        cold = rows.join(keys, F.col("key").eqNullSafe(F.col("hot")), "left_anti")
    own = Window.partitionBy("key")
    ranked = cold.select("key", "v", F.row_number().over(own.orderBy(F.col("v").asc_nulls_last())).alias("at"), F.count("v").over(own).alias("k"))
    picks = [F.max(F.when(F.col("at") == _rank(q, F.col("k")), F.col("v"))).alias(x) for q, x in zip(quantiles, names)]
    of_cold = ranked.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *picks)  # the window has dealt the rows by key already
    return of_cold if of_hot is None else of_cold.unionByName(of_hot)


def _rank(q: float, k):
    if isinstance(k, int):
        return max(1, math.ceil(q * k))
    return F.greatest(F.lit(1), F.ceil(F.lit(float(q)) * k)).cast("long")


def _select(rows: DataFrame, hot: list[tuple], quantiles: list[float], key_field: StructField, finish: int) -> list[tuple]:
    """(key, rows, value of each quantile) of hot keys ``(key, rows, values, least, greatest)``: histograms refined until the ranks resolve."""
    spark = rows.sparkSession
    width = max(4, int(math.log2(MOST_BINS / (len(hot) * len(quantiles)))))  # bits a round
    # (key index, quantile, bits left, prefix, rank within the range, values in it); a key's values agree in all but the bits left
    open_ = []
    for i, (_, _, k, lo, hi) in enumerate(hot):
        left = 64 if lo < 0 <= hi else (lo ^ hi).bit_length()
        open_ += [(i, j, left, lo >> left if left < 64 else 0, _rank(q, k), k) for j, q in enumerate(quantiles)]
    schema = StructType([key_field, *(StructField(x, IntegerType()) for x in ("i", "j", "s")), *(StructField(x, LongType()) for x in ("prefix", "rank"))])
    done: dict[tuple[int, int], int] = {}
    sort: list[tuple] = []
    while open_:
        sort += [x for x in open_ if x[5] <= finish and x[2]]
        done |= {(x[0], x[1]): x[3] for x in open_ if not x[2]}
        open_ = [x for x in open_ if x[5] > finish and x[2]]
        if not open_:
            break
        to = {x[2]: max(0, x[2] - width) for x in open_}
        wanted = spark.createDataFrame([(hot[i][0], i, j, s, p, r) for i, j, s, p, r, _ in open_], schema).withColumn("to", F.expr(_case("s", to)))
        ranges = wanted.select(F.col("key").alias("range_key"), "i", "s", "prefix", "to").distinct()
        counted = (
            rows.join(F.broadcast(ranges), F.col("key").eqNullSafe(F.col("range_key")) & _in_range())
            .groupBy("i", "s", "prefix", F.expr("shiftright(v, `to`)").alias("bin")).agg(F.count(F.lit(1)).alias("m"))
        )
        reach = counted.withColumn("upto", F.sum("m").over(Window.partitionBy("i", "s", "prefix").orderBy("bin")))
        hit = reach.join(F.broadcast(wanted.drop("key")), ["i", "s", "prefix"]).where("upto >= rank and upto - m < rank")
        open_ = [(r["i"], r["j"], r["to"], r["bin"], r["rank"] - (r["upto"] - r["m"]), r["m"]) for r in hit.collect()]  # one row a quantile of a hot key
    if sort:
        wanted = spark.createDataFrame([(hot[i][0], i, j, s, p, r) for i, j, s, p, r, _ in sort], schema).withColumnRenamed("key", "range_key")
        at = F.row_number().over(Window.partitionBy("i", "j").orderBy("v"))
        last = rows.join(F.broadcast(wanted), F.col("key").eqNullSafe(F.col("range_key")) & _in_range()).withColumn("at", at).where("at = rank")
        done |= {(r["i"], r["j"]): r["v"] for r in last.select("i", "j", "v").collect()}
    return [(h[0], h[1], *(done[i, j] for j in range(len(quantiles)))) for i, h in enumerate(hot)]


def _in_range() -> Column:
    return (F.col("s") == 64) | (F.expr("shiftright(v, least(s, 63))") == F.col("prefix"))


def _case(column: str, to: dict[int, int]) -> str:
    return "case " + column + "".join(f" when {a} then {b}" for a, b in to.items()) + " end"


def select_ranks(df: DataFrame, key: str, value: str, quantiles: list[float], most_hot: int = MOST_HOT, finish: int = FINISH) -> DataFrame:
    """``key, q, value``: the quantiles of ``quantiles_per_key``, one row each, of keys that have values."""
    wide = quantiles_per_key(df.where(F.col(value).isNotNull()), key, value, quantiles, most_hot, finish)
    each = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col(f"v{i}").alias("value")) for i, q in enumerate(quantiles)]))
    return wide.select("key", each.alias("x")).select("key", "x.q", "x.value")


def code_report(diagnostics: DataFrame, quantiles: list[float] | None = None) -> DataFrame:
    """Per code: rows, scripts touched, first and last report, exact quantiles of the time of report (null code left out)."""
    d = diagnostics.where(F.col("code").isNotNull())
    base = d.groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.min("reported_at").alias("first_report"), F.max("reported_at").alias("last_report")
    )
    scripts = distinct_per_key(d, "code", "script_id").withColumnRenamed("key", "code").withColumnRenamed("distinct", "scripts")
    out = base.join(scripts, "code", "left").withColumn("scripts", F.coalesce("scripts", F.lit(0)))
    if quantiles:
        out = out.join(code_quantiles(d, quantiles).drop("n"), "code", "left")
    return out


def code_quantiles(diagnostics: DataFrame, quantiles: list[float]) -> DataFrame:
    """Per code: rows and exact quantiles of the time of report (null code left out): ``code, n, q50_report, ..``."""
    d = diagnostics.where(F.col("code").isNotNull())
    wide = quantiles_per_key(d, "code", F.unix_micros("reported_at"), quantiles)
    return wide.select(F.col("key").alias("code"), "n", *(F.timestamp_micros(f"v{i}").alias(f"q{round(q * 100):02d}_report") for i, q in enumerate(quantiles)))
