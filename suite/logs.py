"""Queries of the audit log and of logged statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions.sqltext import export_token, statement_shape
from maskwright.operators import audit_stats, governance, statements
from maskwright.plans.refusals import CODES
from maskwright.session import run_dir
from maskwright.sources import audit_log
from suite import query, table
from suite.derived import derive, idiv, with_sql

# The log as JSON lines: every 40th line is blank, every 50th no JSON, every 60th without an event.
LINE = """case when event_id % 40 = 39 then '  ' when event_id % 50 = 49 then concat('not json ', event_id) when event_id % 60 = 59 then concat('{"sql":"SELECT ', event_id, '"}')
  else concat('{"ts":"2024-01-01T00:00:00.000Z","event":"', event, '","engine":"', engine, '","sql":"', replace(sql, '"', '\\\\"'), '"',
    coalesce(concat(',"code":"', code, '"'), ''), coalesce(concat(',"span":{"line":1,"col":2,"token":"', token, '"}'), ''), ',"rows":', n_rows, '}') end"""
READABLE = "event_id % 40 <> 39 and event_id % 50 <> 49 and event_id % 60 <> 59"


def log_events(spark, sf):
    """The derived log with the columns the statistics read."""
    audit = derive(spark, sf, "audit")
    return audit.withColumn("span", F.struct(F.lit(1).alias("line"), F.lit(2).alias("col"), F.col("token").alias("token")))


def write_log(spark, sf):
    path = run_dir(spark, "audit")
    derive(spark, sf, "audit").select(F.expr(LINE.replace("\\\\", "\\\\\\\\")).alias("value")).write.text(path)
    return path


@query(
    "a4_read_audit",
    with_sql(
        "audit",
        body=f"""select event, engine, code, token, count(*) as n, cast(sum(n_rows) as bigint) as total_rows, cast(sum(length(sql)) as bigint) as sql_chars,
  (select count(*) from audit where event_id % 40 <> 39 and (event_id % 50 = 49 or event_id % 60 = 59)) as skipped
from audit where {READABLE} group by event, engine, code, token""",
    ),
)
def read_audit(spark, sf):
    events, skipped = audit_log.read_audit(spark, write_log(spark, sf))
    counts = events.groupBy("event", "engine", "code", F.col("span.token").alias("token")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("rows").alias("total_rows"), F.sum(F.char_length("sql")).alias("sql_chars")
    )
    return counts.withColumn("skipped", skipped.scalar())


REFUSED = "event = 'refused'"


@query("h1_refusals_by_code", with_sql("audit", body=f"select coalesce(code, 'uncoded') as code, count(*) as n from audit where {REFUSED} group by 1"))
def by_code(spark, sf):
    return audit_stats.refusals_by_code(log_events(spark, sf))


@query(
    "h2_refusals_by_token",
    with_sql(
        "audit",
        body=f""", g as (select coalesce(code, 'uncoded') as code, coalesce(upper(token), '-') as token, count(*) as n from audit where {REFUSED} group by 1, 2)
select code, token, n, greatest((select count(*) from g) - 20, 0) as more from g order by n desc, code, token limit 20""",
    ),
)
def by_token(spark, sf):
    return audit_stats.refusals_by_token(log_events(spark, sf), 20)


SHAPES = """case event_id % 13
  when 0 then 'SELECT id , id FROM id WHERE id LIKE ''?'' LIMIT N' when 1 then 'SELECT LOWER ( id ) FROM id . id id LIMIT N'
  when 2 then 'UPDATE id SET id = N WHERE id = N' when 3 then 'DELETE FROM id'
  when 4 then 'INSERT INTO LOG ( id , id ) VALUES ( N , ''?'' ) , ( N , ''?'' ) , ( N , ''?'' )' when 5 then 'SELECT id FROM id WHERE id = ''?'' LIMIT N'
  when 6 then 'SELECT id FROM id WHERE id = ''?'' LIMIT N' when 7 then 'SELECT SLEEP ( N ) LIMIT N' when 8 then 'SELECT id FROM id --…'
  when 9 then 'UPDATE id SET id = N WHERE N = N' when 10 then 'CREATE TABLE id ( id id )' when 11 then 'SELECT id FROM id ; DROP TABLE id'
  else 'SELECT id FROM id' end"""


@query("h3_statement_shape", with_sql("audit", body=f"select event_id, {SHAPES} as shape from audit"))
def shape(spark, sf):
    return derive(spark, sf, "audit").select("event_id", statement_shape(F.col("sql")).alias("shape"))


EXPORTED = "case when token is null then '-' when token in ('--', '&&') then token when token = 'ssn_col' then 'id' else upper(token) end"


@query("h4_export_token", with_sql("audit", body=f"select event_id, {EXPORTED} as token from audit"))
def token(spark, sf):
    return derive(spark, sf, "audit").select("event_id", export_token(F.col("token")).alias("token"))


KNOWN = "(" + ", ".join(f"'{c}'" for c in CODES) + ")"
ANON = f"""select case when code in {KNOWN} then code else 'uncoded' end as code, case when engine = 'oracle' then 'other' else engine end as engine,
  {EXPORTED} as token, {SHAPES} as shape from audit where {REFUSED}"""


@query(
    "h5_top_shapes",
    with_sql("audit", body=f", a as ({ANON}) select code, engine, shape, n from (select code, engine, shape, count(*) as n from a group by all) q order by n desc, code, engine, shape limit 100"),
)
def top(spark, sf):
    return audit_stats.top_shapes(log_events(spark, sf), 100)


@query(
    "h6_export_report",
    with_sql(
        "audit",
        body=f""", a as ({ANON}), c as (select code, count(*) as n from a group by code), k as (select code, token, count(*) as n from a group by all),
s as (select * from (select code, engine, shape, count(*) as n from a group by all) q order by n desc, code, engine, shape limit 100)
select 'code' as part, code, null as detail, n from c union all select 'construct', code, token, n from k union all select 'shape', code, engine || ' ' || shape, n from s
union all select 'refusals', null, null, (select count(*) from a) union all select 'skipped', null, null, 0""",
    ),
)
def export(spark, sf):
    report = audit_stats.refusal_export(log_events(spark, sf))
    schema = """refusals bigint, skipped bigint, by_code array<struct<code:string,n:bigint>>,
      by_construct array<struct<code:string,token:string,n:bigint>>, shapes array<struct<code:string,engine:string,shape:string,n:bigint>>"""
    parsed = report.select(F.from_json("report", schema).alias("r"))
    null = F.lit(None).cast("string")
    row = lambda part, code, detail, n: F.struct(F.lit(part).alias("part"), code.alias("code"), detail.alias("detail"), n.alias("n"))
    items = F.concat(
        F.transform("r.by_code", lambda x: row("code", x["code"], null, x["n"])),
        F.transform("r.by_construct", lambda x: row("construct", x["code"], x["token"], x["n"])),
        F.transform("r.shapes", lambda x: row("shape", x["code"], F.concat_ws(" ", x["engine"], x["shape"]), x["n"])),
        F.array(row("refusals", null, null, F.col("r.refusals")), row("skipped", null, null, F.col("r.skipped"))),
    )
    return parsed.select(F.inline(items))


@query("h7_vocabulary", with_sql("audit", body="select cast(0 as bigint) as violations, count(*) as statements from audit"))
def vocabulary(spark, sf):
    shaped = derive(spark, sf, "audit").select(statement_shape(F.col("sql")).alias("shape"))
    bad = audit_stats.vocabulary_violations(shaped).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint"))
    return shaped.agg(F.count(F.lit(1)).alias("statements")).withColumn("violations", bad.scalar())


LIMITS = "case event_id % 13 when 0 then event_id % 400 + 1 when 1 then event_id % 30 + 1 when 5 then 5 when 6 then 10 end"
CODE = f"""case when engine = 'oracle' then 'E_ENGINE' when event_id % 13 = 8 and engine = 'postgres' then 'E_FORBIDDEN_TOKEN'
  when event_id % 13 = 7 then 'E_FORBIDDEN' when event_id % 13 = 8 then 'E_FORBIDDEN_TOKEN' when event_id % 13 = 11 then 'E_MULTI_STATEMENT'
  when event_id % 13 = 12 then 'E_NO_LIMIT' when event_id % 13 in (0, 1, 5, 6) and {LIMITS} > 200 then 'E_LIMIT_TOO_HIGH' end"""
CLASS = "case when event_id % 13 in (0, 1, 5, 6) then 'read' when event_id % 13 = 10 then 'ddl' else 'write' end"
KIND = "case when event_id % 13 in (0, 1, 5, 6) then 'select' when event_id % 13 in (2, 9) then 'update' when event_id % 13 = 3 then 'delete' when event_id % 13 = 4 then 'insert' else 'create' end"
CLASSIFIED = f"""select event_id, profile, unmask, {CODE} as stmt_code, case when {CODE} is null then {CLASS} end as stmt_class, case when {CODE} is null then {KIND} end as stmt_kind,
  case when {CODE} is null and {CLASS} = 'read' then cast({LIMITS} as bigint) end as stmt_limit from audit"""


@query("h8_classify_log", with_sql("audit", body=f"select event_id, stmt_class, stmt_kind, stmt_limit, stmt_code from ({CLASSIFIED}) q"))
def classify(spark, sf):
    return statements.classify_log(derive(spark, sf, "audit"), max_rows=200).select(
        "event_id", "stmt_class", "stmt_kind", "stmt_limit", "stmt_code"
    )


TIERS = "select distinct profile, split_part('read,write,ddl,admin', ',', cast(user_id % 4 + 1 as int)) as tier from {audit}"
RANK = "case {c} when 'read' then 0 when 'write' then 1 when 'ddl' then 2 when 'admin' then 3 end"


@query(
    "h9_tier_violations",
    with_sql(
        "audit",
        body=f", c as ({CLASSIFIED}), t as ({TIERS.replace('{audit}', 'audit')}) select event_id, tier, stmt_class from c join t using (profile) where {RANK.format(c='stmt_class')} > {RANK.format(c='tier')}",
    ),
)
def tier(spark, sf):
    audit = derive(spark, sf, "audit")
    log = statements.classify_log(audit, max_rows=200)
    return statements.tier_violations(log, spark.sql(TIERS, audit=audit)).select("event_id", "tier", "stmt_class")


@query(
    "h9_workload",
    with_sql(
        "audit",
        body=f""", c as ({CLASSIFIED}), t as ({TIERS.replace('{audit}', 'audit')}) select stmt_class, tier, case when stmt_class is null then 'refused' when {RANK.format(c='stmt_class')} > {RANK.format(c='tier')} then 'above_tier' else 'allowed' end as verdict, count(*) as n
from c join t using (profile) group by 1, 2, 3""",
    ),
)
def workload(spark, sf):
    audit = derive(spark, sf, "audit")
    return statements.workload(statements.classify_log(audit, max_rows=200), spark.sql(TIERS, audit=audit))


@query("h10_whole_table_writes", with_sql("audit", body="select event_id, engine <> 'oracle' and event_id % 13 in (3, 9) as whole_table from audit"))
def whole(spark, sf):
    return statements.whole_table_writes(derive(spark, sf, "audit")).select("event_id", "whole_table")


@query("h11_values_rows", with_sql("audit", body="select event_id, cast(case when engine <> 'oracle' and event_id % 13 = 4 then 3 else 0 end as bigint) as values_rows from audit"))
def values(spark, sf):
    return statements.values_rows(derive(spark, sf, "audit")).select("event_id", "values_rows")


NORMAL = """case when engine = 'oracle' or event_id % 13 = 8 then sql else case event_id % 13
  when 0 then concat('SELECT ID , EMAIL FROM USERS WHERE EMAIL LIKE ''a', event_id % 50, '%'' LIMIT ', event_id % 400 + 1)
  when 1 then concat('SELECT LOWER ( EMAIL ) FROM APP . USERS U LIMIT ', event_id % 30 + 1)
  when 2 then concat('UPDATE ACCOUNTS SET BALANCE = ', event_id % 100, ' WHERE ID = ', event_id % 20)
  when 3 then 'DELETE FROM SESSIONS' when 4 then concat('INSERT INTO LOG ( A , B ) VALUES ( 1 , ''x'' ) , ( ', event_id % 10, ' , ''y'' ) , ( 3 , ''z'' )')
  when 5 then 'SELECT NAME FROM PG_STATS WHERE TABLENAME = ''t'' LIMIT 5'
  when 6 then concat('SELECT ID FROM USERS WHERE EMAIL = ''user', event_id % 1500, '@mail', event_id % 7, '.example.com'' LIMIT 10')
  when 7 then 'SELECT SLEEP ( 5 ) LIMIT 1' when 9 then 'UPDATE USERS SET ACTIVE = 0 WHERE 1 = 1' when 10 then 'CREATE TABLE COPY_OF ( ID INT )'
  when 11 then concat('SELECT A FROM T ; DROP TABLE T', event_id % 4) else 'SELECT ID FROM ORDERS' end end"""


@query("h12_fingerprint", with_sql("audit", body=f"select sha256(s) as fingerprint, count(*) as n, min(s) as normalised_sql from (select {NORMAL} as s from audit) q group by s"))
def frequency(spark, sf):
    return statements.statement_frequency(derive(spark, sf, "audit"))


@query(
    "h26_sensitive_relations",
    with_sql("audit", body="select event_id, case when engine <> 'oracle' and event_id % 13 = 5 then 'pg_stats' end as stats_relation, cast(null as varchar) as statement_relation from audit"),
)
def relations(spark, sf):
    return statements.sensitive_relations(derive(spark, sf, "audit")).select("event_id", "stats_relation", "statement_relation")


# A log per hundred events: odd lines are unchained, an even line carries the hash of the line before it, every 17th a wrong one.
def chain_sql(sha: str) -> str:
    plain = lambda n: f"""concat('<"event":"e', {n}, '">')"""
    return f"""
select concat('log', no) as file, cast(seq as bigint) as seq,
  translate(case when prev is null and event_id % 3 = 0 then concat('<"event":"e', event_id, '","prev_hash":"', repeat('0', 64), '">')
    when seq % 2 = 1 then {plain('event_id')}
    when event_id % 17 = 0 then concat('<"event":"e', event_id, '","prev_hash":"', repeat('f', 64), '">')
    else concat('<"event":"e', event_id, '","prev_hash":"', {sha.format("translate(" + plain('prev') + ", '<>', chr(123) || chr(125))")}, '">') end, '<>', chr(123) || chr(125)) as line
from (select event_id, {idiv('event_id', 100)} as no, event_id % 100 + 1 as seq, case when event_id % 100 > 0 then event_id - 1 end as prev from {{events}}) q
"""


@query(
    "h25_verify_chain",
    f"""with c as ({chain_sql('sha256({})').replace('{events}', 'events')}), l as (select file, seq, line, json_extract_string(line, '$.prev_hash') as stated, lag(line) over (partition by file order by seq) as before from c)
select file, count(*) as records, count(*) filter (where stated is not null and not (before is null and stated = repeat('0', 64)) and coalesce(sha256(before) <> stated, true)) as breaks,
  count(*) filter (where before is null and stated = repeat('0', 64)) as genesis, count(*) filter (where stated is null) as legacy,
  min(seq) filter (where stated is not null and not (before is null and stated = repeat('0', 64)) and coalesce(sha256(before) <> stated, true)) as first_break
from l group by file""",
)
def verify(spark, sf):
    log = spark.sql(chain_sql("sha2({}, 256)"), events=table(spark, sf, "events"))
    return governance.verify_chain(log)


@query(
    "h25_numbered_lines",
    with_sql("audit", body="select count(*) as lines, cast(1 as bigint) as first_seq_ok, count(*) as distinct_places from audit"),
)
def numbered(spark, sf):
    lines = audit_log.numbered_lines(spark, write_log(spark, sf))
    per_file = lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count_distinct("seq").alias("d")
    )
    return per_file.agg(
        F.sum("n").alias("lines"),
        F.min(((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)).cast("bigint")).alias("first_seq_ok"),
        F.sum("d").alias("distinct_places"),
    )
