"""Word lists of the SQL Server grammar (fixed values from the public language reference)."""

#: Reserved words: never a name unless quoted.
RESERVED = frozenset(
    """ADD ALL ALTER AND ANY AS ASC AUTHORIZATION BACKUP BEGIN BETWEEN BREAK BROWSE BULK BY CASCADE CASE CHECK
    CHECKPOINT CLOSE CLUSTERED COALESCE COLLATE COLUMN COMMIT COMPUTE CONSTRAINT CONTAINS CONTAINSTABLE CONTINUE
    CONVERT CREATE CROSS CURRENT CURRENT_DATE CURRENT_TIME CURRENT_TIMESTAMP CURRENT_USER CURSOR DATABASE DBCC
    DEALLOCATE DECLARE DEFAULT DELETE DENY DESC DISTINCT DISTRIBUTED DOUBLE DROP ELSE END ERRLVL ESCAPE EXCEPT EXEC
    EXECUTE EXISTS EXIT EXTERNAL FETCH FILE FILLFACTOR FOR FOREIGN FREETEXT FREETEXTTABLE FROM FULL FUNCTION GOTO
    GRANT GROUP HAVING HOLDLOCK IDENTITY IDENTITY_INSERT IDENTITYCOL IF IN INDEX INNER INSERT INTERSECT INTO IS JOIN
    KEY KILL LEFT LIKE LINENO MERGE NATIONAL NOCHECK NONCLUSTERED NOT NULL NULLIF OF OFF OFFSETS ON OPEN
    OPENDATASOURCE OPENQUERY OPENROWSET OPENXML OPTION OR ORDER OUTER OVER PERCENT PIVOT PLAN PRIMARY PRINT PROC
    PROCEDURE PUBLIC RAISERROR READ READTEXT RECONFIGURE REFERENCES REPLICATION RESTORE RESTRICT RETURN REVERT REVOKE
    RIGHT ROLLBACK ROWCOUNT ROWGUIDCOL RULE SAVE SCHEMA SELECT SEMANTICKEYPHRASETABLE
    SEMANTICSIMILARITYDETAILSTABLE SEMANTICSIMILARITYTABLE SESSION_USER SET SETUSER SHUTDOWN SOME STATISTICS
    SYSTEM_USER TABLE TABLESAMPLE TEXTSIZE THEN TO TOP TRAN TRANSACTION TRIGGER TRUNCATE TRY_CONVERT TSEQUAL UNION
    UNIQUE UNPIVOT UPDATE UPDATETEXT USE USER VALUES VARYING VIEW WAITFOR WHEN WHERE WHILE WITH WRITETEXT""".split()
)

#: Words with a meaning in some place that are names elsewhere.
CONTEXTUAL = frozenset(
    """ABSOLUTE ACTION AFTER APPLY ASYMMETRIC AT AUTO BULK CALLED CAST CATALOG CATCH CERTIFICATE COLUMNS COMMITTED CONCAT CONVERSATION
    CREDENTIAL CUBE CURSOR_STATUS DATA DELAY DIALOG DISABLE ENABLE ENCRYPTION EVENTS EXPLICIT FILENAME FIRST FOLLOWING FORCE
    FORCESEEK FULLTEXT GET GLOBAL GROUPING HASH IIF INCLUDE INCREMENTAL INPUT INSTEAD ISOLATION JSON LANGUAGE LAST
    LEVEL LOCAL LOGIN LOOP MASTER MATCHED MAX MOVE NEXT NO NODES NOCOUNT NONE NOWAIT OBJECT OFFSET ONLINE ONLY OPENJSON
    OPTIMIZE OUT OUTPUT OWNER PAGE PARSE PARTITION PASSWORD PATH PERSISTED PRECEDING PRECISION PRIOR PRIVILEGES RANGE RAW READONLY
    REBUILD RECEIVE RECOMPILE RELATIVE REMOTE RENAME REORGANIZE REPEATABLE RETURNS ROLE ROLLUP ROOT ROW ROWS
    SCHEMABINDING SCHEME SECURITY SEND SEQUENCE SERIALIZABLE SERVER SETS SNAPSHOT SOURCE SPARSE SPATIAL START SWITCH SYMMETRIC SYNONYM SYSTEM
    SYSTEM_TIME TARGET THROW TIES TIME TRY TRY_CAST TRY_PARSE TYPE UNBOUNDED UNCOMMITTED UNKNOWN USING VALUE VIEW_METADATA WAITFOR WINDOW WITHIN WITHOUT WORK
    XML XMLNAMESPACES ZONE ELEMENTS RETURN CONTAINED AFTER HIDDEN GENERATED ALWAYS MASKED ENCRYPTED IGNORE_DUP_KEY ROWVERSION
    OUTPUT CALLER SELF PERIOD EDGE NODE STATUS MODE STREAM MATCH WAIT ABORT_AFTER_WAIT HIERARCHYID TIMEOUT MESSAGE END_CONVERSATION DEFAULT_SCHEMA
    """.split()
) - RESERVED

KEYWORDS = RESERVED | CONTEXTUAL

#: Words that start a statement.
STARTERS = frozenset(
    """SELECT INSERT UPDATE DELETE MERGE WITH CREATE ALTER DROP TRUNCATE EXEC EXECUTE DECLARE SET IF WHILE BEGIN PRINT
    RAISERROR RETURN BREAK CONTINUE GOTO WAITFOR COMMIT ROLLBACK SAVE OPEN FETCH CLOSE DEALLOCATE GRANT DENY REVOKE USE
    BACKUP RESTORE DBCC KILL CHECKPOINT RECONFIGURE BULK REVERT SETUSER SHUTDOWN READTEXT WRITETEXT UPDATETEXT
    THROW ADD LINENO""".split()
)
