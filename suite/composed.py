"""Log analyses over statements composed of parts, and their results composed of the parts' results.

Verb, relation, number of columns or rows, literal, condition, LIMIT, remark
and letter case are drawn from different numbers of an event, so thousands
of statements differ; no answer is looked up by statement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from maskwright.functions.sqltext import statement_shape
from maskwright.operators import masking, statements
from maskwright.session import spread
from pyspark.sql import functions as F
from suite import query, table

PARTS = """
select event_id, (event_id * 7 + user_id) % 5 as verb, event_id % 4 + 1 as n, (event_id + user_id * 3) % 4 as lit, event_id % 3 as cond, (event_id * 5 + user_id) % 260 + 1 as lim,
  (user_id + event_id * 11) % 6 as rel, (event_id * 13 + user_id) % 7 as remark, event_id % 11 as style, user_id % 4 as eng, user_id from events"""

# The statement, in SQL that both engines read.
TEXT = """
select *, case eng when 0 then 'mysql' when 1 then 'mariadb' when 2 then 'postgres' else 'sqlite' end as engine,
  case when style = 0 then lower(body) else body end as sql
from (
  select *, concat(case verb
    when 0 then concat('SELECT ', repeat('c, ', n - 1), 'c FROM ', relation, condition, case when lim % 5 > 0 then concat(' LIMIT ', lim) else '' end)
    when 1 then concat('UPDATE ', relation, ' SET ', repeat('c = 1, ', n - 1), 'd = ', literal, condition)
    when 2 then concat('DELETE FROM ', relation, condition)
    when 3 then concat('INSERT INTO ', relation, ' (a, b) VALUES ', repeat('(1, ''x''), ', n - 1), '(', literal, ', 2)')
    else concat('CREATE TABLE t', event_id, ' (a INT)') end, case when remark = 0 then ' -- why' when remark = 1 then ' /* why */' else '' end) as body
  from (
    select *, case when cond = 0 then '' when cond = 1 then concat(' WHERE k', n, ' = ', literal) else ' WHERE 1 = 1' end as condition
    from (
      select *, case rel when 0 then 'pg_stats' when 1 then 'pg_stat_activity' when 2 then 'performance_schema.threads' else concat('r', user_id % 50) end as relation,
        case lit when 0 then concat('', event_id) when 1 then concat('''v', event_id, '''') when 2 then concat('''it''''s ', user_id, '''') else 'NULL' end as literal
      from parts) a) b) c"""

CLEAN = "remark > 1"  # a remark is refused
LIMITED = "verb = 0 and lim % 5 > 0"


def _sql(select: str) -> str:
    return f"with parts as ({PARTS}), log as ({TEXT}) {select}"


def _log(spark, sf) -> DataFrame:
    parts = spark.sql(PARTS.replace("from events", "from {events}"), events=spread(table(spark, sf, "events"), per_core=4))
    return spark.sql(TEXT.replace("from parts", "from {parts}"), parts=parts)


MARK = "case lit when 0 then 'N' when 3 then 'NULL' else '''?''' end"
RELATION = "case rel when 2 then 'id . id' else 'id' end"


@query(
    "h3_composed_shapes",
    _sql(
        f"""select event_id, concat(case verb
    when 0 then concat('SELECT ', repeat('id , ', n - 1), 'id FROM ', {RELATION}, cnd, case when lim % 5 > 0 then ' LIMIT N' else '' end)
    when 1 then concat('UPDATE ', {RELATION}, ' SET ', repeat('id = N , ', n - 1), 'id = ', {MARK}, cnd)
    when 2 then concat('DELETE FROM ', {RELATION}, cnd)
    when 3 then concat('INSERT INTO ', {RELATION}, ' ( id , id ) VALUES ', repeat('( N , ''?'' ) , ', n - 1), '( ', {MARK}, ' , N )')
    else 'CREATE TABLE id ( id id )' end, case when remark = 0 then ' --…' when remark = 1 then ' /*…*/' else '' end) as shape
from (select *, case cond when 0 then '' when 1 then concat(' WHERE id = ', {MARK}) else ' WHERE N = N' end as cnd from log) q"""
    ),
)
def shapes(spark, sf):
    return _log(spark, sf).select("event_id", statement_shape(F.col("sql")).alias("shape"))


CODE = f"case when not ({CLEAN}) then 'E_FORBIDDEN_TOKEN' when verb = 0 and lim % 5 = 0 then 'E_NO_LIMIT' when verb = 0 and lim > 200 then 'E_LIMIT_TOO_HIGH' end"


@query(
    "h8_composed_classes",
    _sql(
        f"""select event_id, code as stmt_code, case when code is null then case verb when 0 then 'read' when 4 then 'ddl' else 'write' end end as stmt_class,
  case when code is null then case verb when 0 then 'select' when 1 then 'update' when 2 then 'delete' when 3 then 'insert' else 'create' end end as stmt_kind,
  case when code is null and {LIMITED} then cast(lim as bigint) end as stmt_limit from (select *, {CODE} as code from log) q"""
    ),
)
def classes(spark, sf):
    return statements.classify_log(_log(spark, sf), max_rows=200).select("event_id", "stmt_code", "stmt_class", "stmt_kind", "stmt_limit")


@query("h10_composed_whole_table", _sql(f"select event_id, {CLEAN} and verb in (1, 2) and cond <> 1 as whole_table from log"))
def whole(spark, sf):
    return statements.whole_table_writes(_log(spark, sf)).select("event_id", "whole_table")


@query("h11_composed_rows", _sql(f"select event_id, cast(case when {CLEAN} and verb = 3 then n else 0 end as bigint) as values_rows from log"))
def inserted(spark, sf):
    return statements.values_rows(_log(spark, sf)).select("event_id", "values_rows")


@query(
    "h26_composed_relations",
    _sql(
        f"""select event_id, case when {CLEAN} and verb < 4 and rel = 0 then 'pg_stats' end as stats_relation,
  case when {CLEAN} and verb < 4 and rel = 1 then 'pg_stat_activity' when {CLEAN} and verb < 4 and rel = 2 and eng < 2 then 'performance_schema.threads' end as statement_relation from log"""
    ),
)
def relations(spark, sf):
    return statements.sensitive_relations(_log(spark, sf)).select("event_id", "stats_relation", "statement_relation")


# A literal that a detector knows, or looks alike and is not: by kind and by a number of its own.
LITERALS = """
select event_id, user_id, kind, 'mysql' as engine, concat('SELECT c', user_id % 9, ' FROM t WHERE k', event_id % 5, ' = ', literal, ' LIMIT 5') as sql from (
  select *, case kind when 0 then concat('''u', event_id, '@mail', user_id % 7, '.example.com''') when 1 then concat('''u', event_id, ' at mail.example.com''')
    when 2 then '''4111 1111 1111 1111''' when 3 then '''4111 1111 1111 1112''' when 4 then concat('''word ', event_id, '''') else concat('', event_id) end as literal
  from (select event_id, user_id, (event_id * 3 + user_id) % 6 as kind from events) a) b"""


@query("d11_composed_literals", f"select event_id, kind in (0, 2) as clear_literal from ({LITERALS}) q")
def literals(spark, sf):
    log = spark.sql(LITERALS.replace("from events", "from {events}"), events=table(spark, sf, "events"))
    return statements.clear_literals(log).select("event_id", "clear_literal")


# A server's message quotes a name of the statement, or a value of a row.
MESSAGES = """
select event_id, concat('SELECT c', user_id % 9, ' FROM t', event_id % 5) as sql,
  case kind when 0 then concat('Unknown column ''c', user_id % 9, ''' in ''field list''') when 1 then concat('Unknown column ''v', event_id, ''' in ''field list''')
    when 2 then concat('Duplicate entry ''v', event_id, ''' for key ''t', event_id % 5, '''') when 3 then concat('Data truncated for ''v', event_id)
    else concat('Lost connection after ', event_id, ' rows') end as error, kind
from (select event_id, user_id, (event_id * 3 + user_id) % 5 as kind from events) a"""


@query(
    "d9_composed_errors",
    f"""select event_id, case kind when 1 then 'Unknown column "<value redacted>"' when 2 then 'Duplicate entry "<value redacted>"' when 3 then 'Data truncated for "<value redacted>"' else error end as error
from ({MESSAGES}) q""",
)
def errors(spark, sf):
    log = spark.sql(MESSAGES.replace("from events", "from {events}"), events=table(spark, sf, "events"))
    return masking.redact_errors(log).select("event_id", "error")
