"""T-SQL scalar functions as Spark expressions.

Each entry takes Columns and gives a Column, all of built-in expressions, so plans stay inside
code generation.  Where T-SQL differs from the Spark function of the same name, the T-SQL
meaning is kept: ``LEN`` ignores trailing blanks, ``CONCAT`` treats NULL as empty, ``DATEDIFF``
counts boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(x: Column) -> Column:
    return F.length(F.rtrim(x))


def concat(*xs: Column) -> Column:
    """NULL counts as the empty string."""
    return F.concat(*[F.coalesce(x.cast("string"), F.lit("")) for x in xs])


def stuff(x: Column, start: int, n: int, new: str) -> Column:
    """NULL if the start lies outside the string."""
    return F.when((F.lit(start) >= 1) & (F.lit(start) <= F.length(x)), F.concat(F.substring(x, 1, start - 1), F.lit(new), F.substr(x, F.lit(start + n))))


def quotename(x: Column) -> Column:
    return F.concat(F.lit("["), F.replace(x, F.lit("]"), F.lit("]]")), F.lit("]"))


def datediff(part: str, start: Column, end: Column) -> Column:
    """Boundaries of the part between two moments; weeks start on Sunday."""
    if part == "year":
        return F.year(end) - F.year(start)
    if part == "quarter":
        return (F.year(end) - F.year(start)) * 4 + F.quarter(end) - F.quarter(start)
    if part == "month":
        return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    if part == "week":
        sunday = lambda x: F.date_sub(x.cast("date"), F.dayofweek(x) - 1)
        return (F.datediff(sunday(end), sunday(start)) / 7).cast("int")
    if part == "day":
        return F.datediff(end, start)
    unit = {"hour": 3600, "minute": 60, "second": 1}[part]
    trunc = lambda x: F.floor(F.unix_timestamp(F.date_trunc(part, x)) / unit)
    return trunc(end) - trunc(start)


def dateadd(part: str, n: int, x: Column) -> Column:
    if part in ("year", "quarter", "month"):
        return x + F.make_ym_interval(F.lit(0), F.lit(n * {"year": 12, "quarter": 3, "month": 1}[part]))
    seconds = n * {"week": 604800, "day": 86400, "hour": 3600, "minute": 60, "second": 1}[part]
    return x + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def isnull(x: Column, y: Column) -> Column:
    return F.coalesce(x, y)


def iif(c: Column, x: Column, y: Column) -> Column:
    return F.when(c, x).otherwise(y)


def choose(n: Column, *xs: Column) -> Column:
    out = F.when(n == 1, xs[0])
    for i, x in enumerate(xs[1:], 2):
        out = out.when(n == i, x)
    return out


def square(x: Column) -> Column:
    return x * x


def isjson(x: Column) -> Column:
    return F.when(x.isNull(), None).otherwise(F.try_parse_json(x).isNotNull().cast("int"))


def try_cast(x: Column, type_: str) -> Column:
    return x.try_cast(type_)


def patindex(pattern: str, x: Column) -> Column:
    """Position of a LIKE pattern (%, _, [classes]) in a string, 0 if there is none."""
    body, head, tail = pattern, "^", "$"
    if body.startswith("%"):
        body, head = body[1:], ""
    if body.endswith("%"):
        body, tail = body[:-1], ""
    return F.regexp_instr(x, F.lit(head + like_regex(body) + tail))


def like_regex(pattern: str) -> str:
    """Regular expression of a T-SQL LIKE pattern without its ends."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        j = pattern.find("]", i + 1) if c == "[" else -1
        if j > 0:
            out += "[" + pattern[i + 1 : j].replace("\\", "\\\\") + "]"
            i = j
        elif c == "%":
            out += ".*"
        elif c == "_":
            out += "."
        else:
            out += "\\" + c if c in ".^$*+?{}|()[]\\" else c
        i += 1
    return out


def like(x: Column, pattern: str) -> Column:
    """LIKE with character classes, which Spark's LIKE lacks."""
    return x.rlike("(?s)^" + like_regex(pattern) + "$")


def str_(x: Column, width: int = 10, decimals: int = 0) -> Column:
    """STR: right-aligned number, stars if it doesn't fit."""
    s = F.format_string(f"%.{decimals}f", F.round(x.cast("double"), decimals))
    return F.when(F.length(s) > width, F.lit("*" * width)).otherwise(F.lpad(s, width, " "))


def datename(part: str, x: Column) -> Column:
    if part == "month":
        return F.date_format(x, "MMMM")
    if part == "weekday":
        return F.date_format(x, "EEEE")
    return F.date_part(F.lit(part), x).cast("int").cast("string")


def timestamp_from_parts(y, mo, d, h=0, mi=0, s=0) -> Column:
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.make_timestamp_ntz(*map(col, (y, mo, d, h, mi, s)))


def json_modify(x: Column, member: str, value: str) -> Column:
    """JSON_MODIFY of a top-level member: members in order, the named one replaced or added."""
    m = F.from_json(x, "map<string,string>")
    rest = F.map_filter(m, lambda k, v: k != F.lit(member))
    return F.to_json(F.map_concat(rest, F.create_map(F.lit(member), F.lit(value))))


def time_from_parts(h, mi, s, fraction: int = 0, precision: int = 0) -> Column:
    """TIMEFROMPARTS as text ``hh:mm:ss[.fff]``; NULL if a part is out of range."""
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    h, mi, s = map(col, (h, mi, s))
    text = F.format_string("%02d:%02d:%02d", h, mi, s)
    if precision:
        text = F.concat(text, F.lit("." + str(fraction).rjust(precision, "0")))
    return F.when(h.between(0, 23) & mi.between(0, 59) & s.between(0, 59), text)


def date_bucket(part: str, n: int, x: Column, origin: str = "1900-01-01 00:00:00") -> Column:
    """Start of the bucket of ``n`` parts, counted from the origin, that holds a moment."""
    start = F.lit(origin).cast("timestamp_ntz")
    x = x.cast("timestamp_ntz")
    if part in ("year", "quarter", "month"):
        width = n * {"year": 12, "quarter": 3, "month": 1}[part]
        months = (F.year(x) - F.year(start)) * 12 + F.month(x) - F.month(start)
        return start + F.make_ym_interval(F.lit(0), (F.floor(months / width) * width).cast("int"))
    width = n * {"week": 604800, "day": 86400, "hour": 3600, "minute": 60, "second": 1}[part]
    passed = F.timestamp_diff("SECOND", start, x)
    return F.timestamp_add("SECOND", (F.floor(passed / width) * width).cast("long"), start)


def newsequentialid() -> Column:
    """A GUID of rising order within a partition, unique in the query."""
    n = F.monotonically_increasing_id()
    return F.concat(F.lit("00000000-0000-0000-"), F.lpad(F.hex(F.shiftright(n, 48)), 4, "0"), F.lit("-"), F.lpad(F.hex(n.bitwiseAND(F.lit(0xFFFFFFFFFFFF))), 12, "0"))


def col_name(table, number: int) -> str | None:
    """COL_NAME: the column of a one-based number."""
    return table.columns[number - 1] if 1 <= number <= len(table.columns) else None


def col_length(table, column: str) -> int | None:
    """COL_LENGTH: bytes of a column's type, -1 for types without a fixed length, None without such a column."""
    sizes = {"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8}
    types = {k.lower(): v for k, v in table.dtypes}
    return sizes.get(types[column.lower()], -1) if column.lower() in types else None


#: Functions of the registry that ask the server about itself or its objects: Spark has no such state.
WITHOUT_EQUIVALENT = (
    "SCOPE_IDENTITY IDENT_CURRENT IDENT_INCR IDENT_SEED SERVERPROPERTY CONNECTIONPROPERTY DB_ID TYPE_ID TYPE_NAME SCHEMA_ID "
    "COLUMNPROPERTY OBJECT_ID OBJECT_NAME @@IDENTITY @@ROWCOUNT @@ERROR @@TRANCOUNT"
).split()

#: T-SQL name -> function of Columns.
FUNCTIONS = {
    "LEN": length, "SUBSTRING": lambda x, a, n: F.substring(x, a, n), "LEFT": lambda x, n: F.left(x, F.lit(n)), "RIGHT": lambda x, n: F.right(x, F.lit(n)),
    "UPPER": F.upper, "LOWER": F.lower, "TRIM": F.trim, "LTRIM": F.ltrim, "RTRIM": F.rtrim, "REPLACE": lambda x, a, b: F.replace(x, F.lit(a), F.lit(b)),
    "REPLICATE": lambda x, n: F.repeat(x, n), "REVERSE": F.reverse, "STUFF": stuff, "CHARINDEX": lambda s, x: F.locate(s, x),
    "CONCAT": concat, "CONCAT_WS": lambda s, *xs: F.concat_ws(s, *xs), "QUOTENAME": quotename, "SOUNDEX": F.soundex, "SPACE": lambda n: F.repeat(F.lit(" "), n),
    "ASCII": F.ascii, "UNICODE": F.ascii, "CHAR": F.chr, "NCHAR": F.chr,
    "DATEADD": dateadd, "DATEDIFF": datediff, "DATEFROMPARTS": F.make_date, "DATEPART": lambda p, x: F.date_part(F.lit(p), x), "DAY": F.dayofmonth,
    "MONTH": F.month, "YEAR": F.year, "EOMONTH": F.last_day, "ISDATE": lambda x: F.try_to_timestamp(x).isNotNull().cast("int"),
    "CAST": lambda x, t: x.cast(t), "CONVERT": lambda t, x: x.cast(t), "TRY_CAST": try_cast, "TRY_CONVERT": lambda t, x: try_cast(x, t),
    "ISNULL": isnull, "COALESCE": F.coalesce, "NULLIF": F.nullif,
    "ABS": F.abs, "CEILING": F.ceil, "FLOOR": F.floor, "ROUND": F.round, "POWER": F.pow, "SQRT": F.sqrt, "SQUARE": square, "EXP": F.exp, "LOG": F.log,
    "LOG10": F.log10, "SIGN": F.signum, "SIN": F.sin, "COS": F.cos, "TAN": F.tan, "ASIN": F.asin, "ACOS": F.acos, "ATAN": F.atan, "ATN2": F.atan2,
    "DEGREES": F.degrees, "RADIANS": F.radians, "RAND": F.rand,
    "ISJSON": isjson, "JSON_VALUE": F.get_json_object, "JSON_QUERY": F.get_json_object,
    "IIF": iif, "CHOOSE": choose, "HASHBYTES": lambda x: F.sha2(x, 256), "CHECKSUM": F.hash, "BINARY_CHECKSUM": F.xxhash64,
    "NEWID": F.uuid if hasattr(F, "uuid") else lambda: F.expr("uuid()"), "GETDATE": F.localtimestamp, "SYSDATETIME": F.localtimestamp,
    "GETUTCDATE": F.current_timestamp, "SYSUTCDATETIME": F.current_timestamp, "SYSDATETIMEOFFSET": F.current_timestamp, "CURRENT_TIMESTAMP": F.current_timestamp,
    "CURRENT_USER": F.current_user, "SESSION_USER": F.current_user, "SYSTEM_USER": F.current_user, "DB_NAME": F.current_database, "SCHEMA_NAME": F.current_schema,
    "ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank, "NTILE": F.ntile, "PERCENT_RANK": F.percent_rank, "CUME_DIST": F.cume_dist,
    "COUNT": F.count, "COUNT_BIG": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "STDEV": F.stddev_samp, "STDEVP": F.stddev_pop,
    "VAR": F.var_samp, "VARP": F.var_pop, "STRING_AGG": F.listagg, "APPROX_COUNT_DISTINCT": F.approx_count_distinct, "CHECKSUM_AGG": F.bit_xor,
    "FORMAT": F.date_format, "STR": str_, "PATINDEX": patindex, "DATEDIFF_BIG": datediff, "DATENAME": datename, "DATETRUNC": F.date_trunc,
    "DATETIME2FROMPARTS": timestamp_from_parts, "DATETIMEFROMPARTS": timestamp_from_parts, "SMALLDATETIMEFROMPARTS": timestamp_from_parts,
    "DATETIMEOFFSETFROMPARTS": timestamp_from_parts, "PARSE": lambda x, t: x.cast(t), "TRY_PARSE": try_cast, "JSON_MODIFY": json_modify,
    "OPENJSON": F.from_json, "FOR JSON": F.to_json, "OPENXML": F.xpath, "FOR XML": F.to_xml, "USER_NAME": F.current_user, "SUSER_NAME": F.current_user,
    "@@VERSION": F.version, "CASE": F.when, "USER": F.current_user, "TIMEFROMPARTS": time_from_parts, "DATE_BUCKET": date_bucket, "NEWSEQUENTIALID": newsequentialid,
    "COL_NAME": col_name, "COL_LENGTH": col_length,
    "GROUPING": F.grouping, "GROUPING_ID": F.grouping_id,
}
