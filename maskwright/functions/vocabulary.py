"""Words of SQL: what a statement shape may keep, what a log scan looks for."""

# The keywords a shape keeps. Words often used as names are left out.
SHAPE_KEYWORDS = """
SELECT FROM WHERE GROUP HAVING ORDER BY LIMIT OFFSET FETCH FIRST NEXT ROWS ONLY UNION ALL DISTINCT
DISTINCTROW INTERSECT EXCEPT MINUS JOIN INNER LEFT RIGHT FULL OUTER CROSS NATURAL ON USING AS AND
OR NOT XOR IN IS NULL LIKE ILIKE GLOB REGEXP RLIKE SIMILAR ESCAPE BETWEEN SYMMETRIC EXISTS CASE
WHEN THEN ELSE END CAST CONVERT WITH RECURSIVE EXPLAIN ANALYZE INSERT INTO VALUES UPDATE SET DELETE
MERGE REPLACE CREATE ALTER DROP TRUNCATE RENAME TABLE VIEW SHOW DESCRIBE ASC PRAGMA FOR SHARE
LOCK UNLOCK OVER PARTITION WINDOW FILTER WITHIN LATERAL RETURNING TRUE FALSE INTERVAL COLLATE ANY
SOME NULLS TIES ROLLUP CUBE GROUPING SETS BEGIN COMMIT ROLLBACK SAVEPOINT GRANT REVOKE COPY LOAD
CALL EXECUTE PREPARE DEALLOCATE OUTFILE DUMPFILE PROCEDURE STRAIGHT_JOIN SEPARATOR FORCE IGNORE
PRECEDING FOLLOWING UNBOUNDED CURRENT_DATE CURRENT_TIME CURRENT_TIMESTAMP CURRENT_USER
SESSION_USER LOCALTIME LOCALTIMESTAMP MATERIALIZED TABLESAMPLE QUALIFY NOWAIT HIGH_PRIORITY
SQL_CALC_FOUND_ROWS SQL_NO_CACHE ATTACH DETACH VACUUM REINDEX HANDLER KILL OPTIMIZE
""".split()

# The functions a read may call, by family.
AGGREGATE_FUNCTIONS = """
COUNT MIN MAX SUM AVG ANY_VALUE GROUP_CONCAT STRING_AGG ARRAY_AGG STDDEV STDDEV_POP STDDEV_SAMP VARIANCE
VAR_POP VAR_SAMP STD BIT_AND BIT_OR BIT_XOR BOOL_AND BOOL_OR EVERY TOTAL JSON_AGG JSONB_AGG JSON_ARRAYAGG
JSON_GROUP_ARRAY JSON_OBJECT_AGG JSONB_OBJECT_AGG JSON_OBJECTAGG JSON_GROUP_OBJECT
""".split()
WINDOW_FUNCTIONS = """
ROW_NUMBER RANK DENSE_RANK PERCENT_RANK CUME_DIST NTILE LAG LEAD FIRST_VALUE LAST_VALUE NTH_VALUE
""".split()
STRING_FUNCTIONS = """
LOWER UPPER LENGTH CHAR_LENGTH CHARACTER_LENGTH OCTET_LENGTH SUBSTRING SUBSTR TRIM LTRIM RTRIM REPLACE CONCAT
CONCAT_WS LEFT RIGHT LPAD RPAD REVERSE POSITION INSTR REPEAT INITCAP ASCII CHR CHAR HEX UNHEX FORMAT
LOCATE MID LCASE UCASE FIELD FIND_IN_SET ELT SPACE STRCMP SUBSTRING_INDEX STRPOS SPLIT_PART BTRIM TRANSLATE
STARTS_WITH REGEXP_REPLACE REGEXP_MATCH PRINTF UNICODE ZEROBLOB TYPEOF
""".split()
CONDITIONAL_FUNCTIONS = """
COALESCE NULLIF IFNULL IF IIF GREATEST LEAST NVL NUM_NONNULLS NUM_NULLS LIKELIHOOD LIKELY UNLIKELY
""".split()
NUMBER_FUNCTIONS = """
ABS ROUND FLOOR CEIL CEILING MOD POWER POW SQRT SIGN TRUNC TRUNCATE EXP LN LOG LOG10 LOG2 PI DEGREES RADIANS SIN
COS TAN ASIN ACOS ATAN ATAN2 COT DIV RAND CRC32 CONV BIN OCT WIDTH_BUCKET CBRT RANDOM GCD LCM SCALE
""".split()
DATE_FUNCTIONS = """
NOW EXTRACT DATE TIME YEAR MONTH DAY HOUR MINUTE SECOND INTERVAL
CURDATE CURTIME SYSDATE UTC_DATE UTC_TIME UTC_TIMESTAMP DATE_FORMAT DATE_ADD DATE_SUB ADDDATE SUBDATE ADDTIME
SUBTIME DATEDIFF TIMEDIFF TIMESTAMPDIFF TIMESTAMPADD DAYOFWEEK DAYOFMONTH DAYOFYEAR DAYNAME MONTHNAME WEEK
WEEKDAY WEEKOFYEAR QUARTER YEARWEEK LAST_DAY MAKEDATE MAKETIME STR_TO_DATE FROM_UNIXTIME UNIX_TIMESTAMP
FROM_DAYS TO_DAYS TO_SECONDS SEC_TO_TIME TIME_TO_SEC CONVERT_TZ TIMESTAMP MICROSECOND PERIOD_ADD PERIOD_DIFF
TO_CHAR TO_DATE TO_TIMESTAMP TO_NUMBER DATE_TRUNC DATE_PART AGE MAKE_DATE MAKE_TIME MAKE_TIMESTAMP
MAKE_INTERVAL JUSTIFY_DAYS JUSTIFY_HOURS JUSTIFY_INTERVAL ISFINITE CLOCK_TIMESTAMP STATEMENT_TIMESTAMP
TRANSACTION_TIMESTAMP TIMEOFDAY STRFTIME DATETIME JULIANDAY UNIXEPOCH
""".split()
JSON_FUNCTIONS = """
JSON_EXTRACT JSON_UNQUOTE JSON_VALUE JSON_CONTAINS JSON_CONTAINS_PATH JSON_LENGTH JSON_KEYS JSON_TYPE JSON_VALID
JSON_OBJECT JSON_ARRAY JSON_QUOTE JSON_SEARCH JSON_DEPTH JSONB_EXTRACT_PATH JSONB_EXTRACT_PATH_TEXT
JSON_EXTRACT_PATH JSON_EXTRACT_PATH_TEXT JSONB_TYPEOF JSON_TYPEOF JSONB_ARRAY_LENGTH JSON_ARRAY_LENGTH
JSONB_BUILD_OBJECT JSON_BUILD_OBJECT JSONB_BUILD_ARRAY JSON_BUILD_ARRAY TO_JSON TO_JSONB JSONB_PRETTY JSON
ARRAY_LENGTH CARDINALITY
""".split()

# Functions refused in every class, by name and by prefix.
FORBIDDEN_FUNCTIONS = """
SLEEP BENCHMARK GET_LOCK RELEASE_LOCK RELEASE_ALL_LOCKS IS_FREE_LOCK IS_USED_LOCK
MASTER_POS_WAIT SOURCE_POS_WAIT MASTER_GTID_WAIT WAIT_FOR_EXECUTED_GTID_SET WAIT_UNTIL_SQL_THREAD_AFTER_GTIDS
LOAD_FILE SYS_EXEC SYS_EVAL SYS_BINEVAL SYS_GET SYS_SET LIB_MYSQLUDF_SYS_INFO GEN_DICTIONARY_LOAD
SERVICE_GET_READ_LOCKS SERVICE_GET_WRITE_LOCKS SERVICE_RELEASE_LOCKS
PG_READ_FILE PG_READ_BINARY_FILE PG_STAT_FILE LO_IMPORT LO_EXPORT PG_FILE_WRITE PG_FILE_RENAME PG_FILE_UNLINK
PG_LOGDIR_LS LO_UNLINK LO_CREATE LO_CREAT LO_OPEN LO_PUT LO_GET LO_FROM_BYTEA LO_TRUNCATE LO_WRITE LOREAD
LOWRITE LO_CLOSE QUERY_TO_XML QUERY_TO_XMLSCHEMA QUERY_TO_XML_AND_XMLSCHEMA TS_STAT
TABLE_TO_XML TABLE_TO_XMLSCHEMA TABLE_TO_XML_AND_XMLSCHEMA SCHEMA_TO_XML SCHEMA_TO_XMLSCHEMA
SCHEMA_TO_XML_AND_XMLSCHEMA DATABASE_TO_XML DATABASE_TO_XMLSCHEMA DATABASE_TO_XML_AND_XMLSCHEMA
CURSOR_TO_XML CURSOR_TO_XMLSCHEMA SET_CONFIG
PG_TERMINATE_BACKEND PG_CANCEL_BACKEND PG_RELOAD_CONF PG_ROTATE_LOGFILE PG_PROMOTE PG_SWITCH_WAL
PG_SWITCH_XLOG PG_CREATE_RESTORE_POINT PG_START_BACKUP PG_STOP_BACKUP PG_LOG_BACKEND_MEMORY_CONTEXTS
PG_LOG_STANDBY_SNAPSHOT PG_IMPORT_SYSTEM_COLLATIONS PG_FILE_SYNC PG_NOTIFY
PG_CREATE_PHYSICAL_REPLICATION_SLOT PG_CREATE_LOGICAL_REPLICATION_SLOT PG_DROP_REPLICATION_SLOT
PG_COPY_PHYSICAL_REPLICATION_SLOT PG_COPY_LOGICAL_REPLICATION_SLOT PG_SYNC_REPLICATION_SLOTS
PG_STAT_STATEMENTS_RESET PG_RESTORE_RELATION_STATS PG_RESTORE_ATTRIBUTE_STATS PG_CLEAR_RELATION_STATS
PG_CLEAR_ATTRIBUTE_STATS LOAD_EXTENSION FTS3_TOKENIZER READFILE WRITEFILE EDIT FSDIR ZIPFILE ZIPFILE_CDS
""".split()
FORBIDDEN_PREFIXES = """
PG_SLEEP PG_ADVISORY PG_TRY_ADVISORY PG_LS_ DBLINK PG_LOGICAL_ PG_REPLICATION_ PG_BACKUP_ PG_WAL_REPLAY_
PG_XLOG_REPLAY_ PG_STAT_RESET SPIDER_ KEYRING_ AUDIT_LOG_ GROUP_REPLICATION_
ASYNCHRONOUS_CONNECTION_FAILOVER_ VERSION_TOKENS_
""".split()

READ_FUNCTIONS = sorted(
    {
        *AGGREGATE_FUNCTIONS,
        *WINDOW_FUNCTIONS,
        *STRING_FUNCTIONS,
        *CONDITIONAL_FUNCTIONS,
        *NUMBER_FUNCTIONS,
        *DATE_FUNCTIONS,
        *JSON_FUNCTIONS,
    }
)
KNOWN_FUNCTIONS = sorted({*READ_FUNCTIONS, *FORBIDDEN_FUNCTIONS})

# Statement kinds by first word, for every dialect and for one.
COMMON_LEADING = {
    "SELECT": ("read", "select"),
    "WITH": ("read", "select"),
    "VALUES": ("read", "select"),
    "INSERT": ("write", "insert"),
    "UPDATE": ("write", "update"),
    "DELETE": ("write", "delete"),
    "CREATE": ("ddl", "create"),
    "ALTER": ("ddl", "alter"),
    "DROP": ("ddl", "drop"),
    "ANALYZE": ("admin", "analyze"),
}
DIALECT_LEADING = {
    "mysql": {
        "SHOW": ("read", "show"),
        "DESCRIBE": ("read", "describe"),
        "DESC": ("read", "describe"),
        "TABLE": ("read", "select"),
        "REPLACE": ("write", "replace"),
        "TRUNCATE": ("ddl", "truncate"),
        "RENAME": ("ddl", "rename"),
        "GRANT": ("admin", "grant"),
        "REVOKE": ("admin", "revoke"),
        "KILL": ("admin", "kill"),
        "SET": ("admin", "set"),
        "OPTIMIZE": ("admin", "optimize"),
        "CALL": ("admin", "call"),
    },
    "postgres": {
        "SHOW": ("read", "show"),
        "TABLE": ("read", "select"),
        "MERGE": ("write", "merge"),
        "TRUNCATE": ("ddl", "truncate"),
        "COMMENT": ("ddl", "comment"),
        "GRANT": ("admin", "grant"),
        "REVOKE": ("admin", "revoke"),
        "SET": ("admin", "set"),
        "VACUUM": ("admin", "vacuum"),
        "CALL": ("admin", "call"),
        "REINDEX": ("admin", "reindex"),
        "CLUSTER": ("admin", "cluster"),
        "REFRESH": ("admin", "refresh"),
    },
    "sqlite": {
        "PRAGMA": ("read", "pragma"),
        "REPLACE": ("write", "replace"),
        "VACUUM": ("admin", "vacuum"),
        "REINDEX": ("admin", "reindex"),
    },
}
# First words refused in every class.
FORBIDDEN_LEADING = """
EXPLAIN LOAD COPY ATTACH DETACH INSTALL UNINSTALL BEGIN START COMMIT END ROLLBACK SAVEPOINT RELEASE XA USE RESET
DISCARD LOCK UNLOCK DO PREPARE EXECUTE DEALLOCATE HANDLER SHUTDOWN RESTART FLUSH PURGE CHECKPOINT CHANGE STOP
CLONE BINLOG BACKUP SIGNAL RESIGNAL LISTEN NOTIFY UNLISTEN
""".split()
# Session settings a statement may not set, and their prefixes.
SESSION_SETTINGS = """
ROLE AUTHORIZATION SESSION_AUTHORIZATION TRANSACTION CHARACTERISTICS TRANSACTION_READ_ONLY TX_READ_ONLY
DEFAULT_TRANSACTION_READ_ONLY AUTOCOMMIT SESSION_REPLICATION_ROLE STATEMENT_TIMEOUT MAX_STATEMENT_TIME
MAX_EXECUTION_TIME LOCK_TIMEOUT IDLE_IN_TRANSACTION_SESSION_TIMEOUT TRANSACTION_TIMEOUT NAMES CHARSET CHARACTER
SQL_MODE CLIENT_ENCODING STANDARD_CONFORMING_STRINGS SEARCH_PATH SQL_LOG_BIN
""".split()
SESSION_PREFIXES = ["CHARACTER_SET_", "COLLATION_"]
SQLITE_RAW_TABLES = "SQLITE_DBPAGE DBSTAT SQLITE_DBDATA SQLITE_DBPTR SQLITE_STMT".split()
PRAGMA_INTROSPECT = """
TABLE_INFO TABLE_XINFO TABLE_LIST INDEX_INFO INDEX_XINFO INDEX_LIST FOREIGN_KEY_LIST COLLATION_LIST DATABASE_LIST
FUNCTION_LIST MODULE_LIST PRAGMA_LIST COMPILE_OPTIONS
""".split()
PRAGMA_SETTINGS = """
APPLICATION_ID AUTO_VACUUM AUTOMATIC_INDEX BUSY_TIMEOUT CACHE_SIZE CACHE_SPILL CELL_SIZE_CHECK
CHECKPOINT_FULLFSYNC DATA_VERSION DEFER_FOREIGN_KEYS ENCODING FOREIGN_KEYS FREELIST_COUNT FULLFSYNC HARD_HEAP_LIMIT
IGNORE_CHECK_CONSTRAINTS JOURNAL_MODE JOURNAL_SIZE_LIMIT LEGACY_ALTER_TABLE LOCKING_MODE MAX_PAGE_COUNT MMAP_SIZE
PAGE_COUNT PAGE_SIZE QUERY_ONLY READ_UNCOMMITTED RECURSIVE_TRIGGERS REVERSE_UNORDERED_SELECTS SECURE_DELETE
SOFT_HEAP_LIMIT SYNCHRONOUS TEMP_STORE THREADS TRUSTED_SCHEMA USER_VERSION SCHEMA_VERSION WAL_AUTOCHECKPOINT
ANALYSIS_LIMIT
""".split()
# Relations that hold sampled values, and those that hold past statements.
STATS_RELATIONS = """
PG_STATS PG_STATISTIC PG_STATS_EXT PG_STATS_EXT_EXPRS PG_STATISTIC_EXT_DATA COLUMN_STATS COLUMN_STATISTICS
SQLITE_STAT3 SQLITE_STAT4
""".split()
STATEMENT_RELATIONS = ["PG_STAT_STATEMENTS", "PG_STAT_ACTIVITY"]
MYSQL_STATEMENT_RELATIONS = ["PROCESSLIST", "GENERAL_LOG", "SLOW_LOG", r"EVENTS_STATEMENTS_\S*"]
MYSQL_STATEMENT_SCHEMAS = ["PERFORMANCE_SCHEMA", "SYS"]
