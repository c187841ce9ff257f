"""Word lists of the formatter (fixed values)."""

#: Keyword pairs inside which one blank stands.
PAIRS = frozenset(
    tuple(p.split())
    for p in """LEFT OUTER,RIGHT OUTER,FULL OUTER,LEFT JOIN,RIGHT JOIN,FULL JOIN,INNER JOIN,CROSS JOIN,OUTER JOIN,CROSS APPLY,OUTER APPLY,
GROUP BY,ORDER BY,PARTITION BY,IS NOT,NOT NULL,NOT IN,NOT EXISTS,NOT BETWEEN,NOT LIKE,INSERT INTO,DELETE FROM,UNION ALL,EXCEPT ALL,
INTERSECT ALL,CREATE TABLE,CREATE VIEW,CREATE PROCEDURE,CREATE FUNCTION,CREATE INDEX,CREATE TRIGGER,CREATE SCHEMA,CREATE DATABASE,
CREATE TYPE,ALTER TABLE,ALTER VIEW,ALTER PROCEDURE,ALTER FUNCTION,ALTER INDEX,ALTER SCHEMA,ALTER DATABASE,DROP TABLE,DROP VIEW,
DROP PROCEDURE,DROP FUNCTION,DROP INDEX,DROP TRIGGER,DROP SCHEMA,DROP DATABASE,PRIMARY KEY,FOREIGN KEY,BEGIN TRANSACTION,BEGIN TRAN,
COMMIT TRANSACTION,COMMIT TRAN,ROLLBACK TRANSACTION,ROLLBACK TRAN,BEGIN TRY,END TRY,BEGIN CATCH,END CATCH,IF EXISTS,IF NOT""".replace(
        "\n", ""
    ).split(",")
)

FUNCTIONS = frozenset(
    """COUNT SUM AVG MIN MAX STDEV STDEVP VAR VARP CHECKSUM_AGG COUNT_BIG GROUPING GROUPING_ID
    LEN SUBSTRING LEFT RIGHT UPPER LOWER TRIM LTRIM RTRIM REPLACE REPLICATE REVERSE STUFF CHARINDEX PATINDEX CONCAT CONCAT_WS
    STRING_AGG FORMAT QUOTENAME SOUNDEX SPACE STR UNICODE ASCII CHAR NCHAR
    GETDATE GETUTCDATE SYSDATETIME SYSUTCDATETIME SYSDATETIMEOFFSET CURRENT_TIMESTAMP DATEADD DATEDIFF DATEDIFF_BIG DATEFROMPARTS
    DATETIME2FROMPARTS DATETIMEFROMPARTS DATETIMEOFFSETFROMPARTS SMALLDATETIMEFROMPARTS TIMEFROMPARTS DATENAME DATEPART DAY MONTH
    YEAR EOMONTH ISDATE CAST CONVERT PARSE TRY_CAST TRY_CONVERT TRY_PARSE ISNULL COALESCE NULLIF
    ABS CEILING FLOOR ROUND POWER SQRT SQUARE EXP LOG LOG10 SIGN RAND SIN COS TAN ASIN ACOS ATAN ATN2 DEGREES RADIANS
    ROW_NUMBER RANK DENSE_RANK NTILE PERCENT_RANK CUME_DIST
    SCOPE_IDENTITY IDENT_CURRENT IDENT_INCR IDENT_SEED NEWID NEWSEQUENTIALID SERVERPROPERTY CONNECTIONPROPERTY CURRENT_USER
    SESSION_USER SYSTEM_USER USER_NAME SUSER_NAME DB_ID DB_NAME OBJECT_ID OBJECT_NAME TYPE_ID TYPE_NAME SCHEMA_ID SCHEMA_NAME
    COL_LENGTH COL_NAME COLUMNPROPERTY ISJSON JSON_VALUE JSON_QUERY JSON_MODIFY OPENJSON OPENXML IIF CHOOSE HASHBYTES CHECKSUM
    BINARY_CHECKSUM""".split()
)
PAREN_FREE = frozenset("CURRENT_TIMESTAMP CURRENT_USER SESSION_USER SYSTEM_USER USER".split())
TYPES = frozenset(
    """BIT TINYINT SMALLINT INT INTEGER BIGINT DECIMAL NUMERIC MONEY SMALLMONEY FLOAT REAL DATE TIME DATETIME DATETIME2 DATETIMEOFFSET
    SMALLDATETIME CHAR VARCHAR TEXT NCHAR NVARCHAR NTEXT BINARY VARBINARY IMAGE UNIQUEIDENTIFIER XML SQL_VARIANT CURSOR HIERARCHYID
    GEOMETRY GEOGRAPHY ROWVERSION TIMESTAMP""".split()
)
SYSTEM_SCHEMAS = frozenset("sys information_schema".split())
