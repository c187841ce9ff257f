import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lintmill.syntax import lexer as L
from lintmill.syntax.parser import ParseError, Parser, StatementMemo, batches


def error(sql, memo=None):
    lexemes, open_ = L.split(sql)
    if open_:
        return open_
    for _, _, toks, kinds in batches(lexemes):
        try:
            Parser(toks, kinds, memo).script()
        except ParseError as e:
            return e.message
    return None


VALID = """SELECT 1
SELECT TOP (5) WITH TIES a, t.*, COUNT(*) OVER (PARTITION BY b ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) FROM dbo.t AS t ORDER BY a
;WITH c (x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM c WHERE x < 9) SELECT x FROM c OPTION (MAXRECURSION 10)
SELECT a FROM t LEFT OUTER HASH JOIN u ON t.a = u.a CROSS APPLY dbo.f(t.b) AS f OUTER APPLY (SELECT 1 AS z) AS g
SELECT * FROM (VALUES (1, 'a'), (2, N'b')) AS v(x, y) PIVOT (MAX(y) FOR x IN ([1], [2])) AS p
SELECT CASE WHEN a = 1 AND NOT (b LIKE 'x%' ESCAPE '\\' OR c IS NOT NULL) THEN 1 ELSE -2 END, x = 5, 'y' = 6, z 'alias' FROM t
SELECT a FROM t WHERE a IN (SELECT b FROM u) AND EXISTS (SELECT 1) AND c BETWEEN 1 AND 2 AND d > ALL (SELECT 1)
SELECT a FROM t FOR XML PATH('x'), ROOT('r'), TYPE
SELECT a, SUM(b) FROM t GROUP BY GROUPING SETS ((a), (a, b), ()) HAVING SUM(b) > 1
SELECT a FROM t ORDER BY a OFFSET 5 ROWS FETCH NEXT 5 ROWS ONLY
SELECT CAST(a AS DECIMAL(9, 2)), CONVERT(VARCHAR(MAX), b, 112), TRY_CAST(c AS INT), IIF(a > 1, 2, 3), x.value('(a)[1]', 'int') FROM t
SELECT a FROM t AS OF_ WITH (NOLOCK, INDEX(1)) WHERE a = 0x1F AND b = $1.5 AND c = 1e5
INSERT INTO t (a, b) OUTPUT inserted.a INTO @x VALUES (1, DEFAULT), (2, NULL)
INSERT t EXEC dbo.p @a = 1
UPDATE t SET a += 1, @x = b = 2 FROM dbo.t AS t WHERE CURRENT OF c
DELETE TOP (5) FROM t OUTPUT deleted.* FROM t JOIN u ON t.a = u.a WHERE u.b = 1
MERGE t USING u ON t.a = u.a WHEN MATCHED AND u.b = 1 THEN UPDATE SET b = 2 WHEN NOT MATCHED BY SOURCE THEN DELETE OUTPUT $action;
CREATE TABLE t (a INT IDENTITY(1,1) NOT NULL CONSTRAINT pk PRIMARY KEY CLUSTERED, b AS a + 1 PERSISTED, c XML, CONSTRAINT fk FOREIGN KEY (a) REFERENCES u (x) ON DELETE CASCADE, INDEX ix (a DESC)) ON [PRIMARY] WITH (DATA_COMPRESSION = PAGE)
ALTER TABLE t WITH CHECK ADD c INT NULL, CONSTRAINT df DEFAULT 0 FOR c
ALTER TABLE t DROP CONSTRAINT IF EXISTS x, COLUMN y
CREATE UNIQUE NONCLUSTERED INDEX ix ON dbo.t (a, b DESC) INCLUDE (c) WHERE a > 1 WITH (FILLFACTOR = 80) ON ps(a)
CREATE OR ALTER PROC dbo.p @a INT = 1, @b VARCHAR(9) OUTPUT WITH RECOMPILE AS SET NOCOUNT ON; RETURN 0
CREATE FUNCTION dbo.f (@a INT) RETURNS TABLE AS RETURN (SELECT @a AS a)
CREATE TRIGGER tr ON dbo.t AFTER INSERT, UPDATE AS BEGIN SELECT 1 END
CREATE VIEW v WITH SCHEMABINDING AS SELECT a FROM dbo.t WITH CHECK OPTION
BEGIN TRY BEGIN TRAN; COMMIT TRAN x END TRY BEGIN CATCH IF @@TRANCOUNT > 0 ROLLBACK; THROW 50000, N'x', 1; END CATCH
IF @a = 1 PRINT 'x' ELSE IF @a = 2 BEGIN PRINT 'y' END
WHILE 1 = 1 BEGIN BREAK; CONTINUE; END
DECLARE @a INT = 1, @t TABLE (a INT PRIMARY KEY), @c CURSOR
DECLARE c CURSOR LOCAL FAST_FORWARD FOR SELECT a FROM t FOR READ ONLY
FETCH NEXT FROM c INTO @a, @b
EXEC @r = dbo.p 'x', @b = @c OUTPUT, @d = DEFAULT WITH RECOMPILE
EXEC (N'SELECT ' + @x) AT srv
sp_who 'x'
retry: IF 1 = 1 GOTO retry
WAITFOR DELAY '00:00:01'
CREATE LOGIN x WITH PASSWORD = 'y', CHECK_POLICY = OFF
GRANT SELECT, INSERT ON dbo.t TO x WITH GRANT OPTION
RAISERROR('x %d', 16, 1, @a) WITH NOWAIT
SET TRANSACTION ISOLATION LEVEL READ COMMITTED
SELECT N'a''b' /* a /* nested */ b */ AS [x]]y], "q""r" -- end""".split("\n")

INVALID = """SELECT FROM t
SELECT a, FROM t
SELECT a FORM dbo.t x y
SELECT a FROM t WHERE
SELECT a FROM t WHERE a
SELECT a FROM t LIMIT 5
SELECT `a` FROM t
SELECT COUNT(a)) FROM t
SELECT (a FROM t
INSERT INTO t (a, b VALUES (1, 2)
UPDATE t SET a = WHERE b = 1
DELETE FROM t WHERE a == 1
CREATE TABLE t (a INT NULL b INT)
CREATE TABLE IF NOT EXISTS t (a INT)
IF @a = 1 THEN SELECT 1
BEGIN SELECT 1
END
BEGIN TRY SELECT 1 END TRY
MERGE t USING u ON t.a = u.a WHEN MATCHED THEN DELETE
SELECT 'abc
SELECT [abc
/* abc
SELECT CASE WHEN 1 = 1 THEN 2
DECLARE x INT
<<<<<<< HEAD
using System; namespace X
{ "a": 1 }
SELECT 1; CREATE VIEW v AS SELECT 1
SELECT a FROM t GROUP a""".split("\n")


@pytest.mark.parametrize("sql", VALID)
def test_valid(sql):
    assert error(sql) is None


@pytest.mark.parametrize("sql", INVALID)
def test_invalid(sql):
    assert error(sql) is not None


def test_batches_split_at_go_lines():
    sql = "SELECT 1\nGO\nSELECT 2 AS go\r\n  go 5 -- x\rSELECT 3\nGO;\n/* \nGO\n */ SELECT 4"
    assert [b[2][1] for b in batches(L.split(sql)[0])] == ["1", "2", "3", "4"]


@given(st.text(alphabet="aN'\"[]-/*\r\n @#1.x;(),=\t", max_size=60))
@settings(max_examples=300, deadline=None)
def test_lexemes_cover_the_text(s):
    assert "".join(L.split(s)[0]) == s


def test_memo_never_changes_a_verdict():
    memo = StatementMemo()
    rng = random.Random(1)
    pool = VALID + INVALID
    for _ in range(3000):
        sql = "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 3)))
        assert (error(sql) is None) == (error(sql, memo) is None), sql


@given(st.lists(st.sampled_from("SELECT FROM a , ( ) = 1 'x' WHERE AND CASE WHEN END BEGIN @v [q] JOIN ON * ; INSERT VALUES".split()), max_size=15))
@settings(max_examples=300, deadline=None)
def test_random_fragments_only_raise_parse_errors(parts):
    error(" ".join(parts))
