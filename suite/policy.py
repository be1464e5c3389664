"""Queries of plan weighing, lineage, grants, privileges and policy drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions.detectors import DEFAULT_DETECTORS
from maskwright.operators import governance, lineage, plan_weight, rules
from maskwright.operators.output import Limits
from maskwright.operators.rules import RuleSet
from suite import query, table
from suite.derived import derive, with_sql
from suite.discovery import MANDATORY, RESOLVED, RULES, rules_sql

# ---- drift ----

BEFORE = "select case n_nationkey % 2 when 0 then 'view' else 'function' end as kind, p_name as name, concat(p_brand, p_type) as definition from (select p_partkey, concat('o', p_partkey) as p_name, p_brand, p_type, p_partkey as n_nationkey from {part}) q where p_partkey % 11 <> 3"
AFTER = "select case n_nationkey % 2 when 0 then 'view' else 'function' end as kind, p_name as name, case when p_partkey % 13 = 5 then concat('new ', p_brand) else concat(p_brand, p_type) end as definition from (select p_partkey, concat('o', p_partkey) as p_name, p_brand, p_type, p_partkey as n_nationkey from {part}) q where p_partkey % 17 <> 4"
DRIFT = f"""b as ({BEFORE.replace('{part}', 'part')}), a as ({AFTER.replace('{part}', 'part')}),
drift as (select coalesce(b.kind, a.kind) as kind, coalesce(b.name, a.name) as name,
  case when b.name is null then 'added' when a.name is null then 'removed' when a.definition <> b.definition then 'changed' end as change
  from b full join a on a.kind = b.kind and a.name = b.name)"""


def _snapshots(spark, sf):
    part = table(spark, sf, "part")
    return spark.sql(BEFORE, part=part), spark.sql(AFTER, part=part)


@query("h13_definition_drift", f"with {DRIFT} select kind, name, change from drift where change is not null")
def drift(spark, sf):
    return governance.definition_drift(*_snapshots(spark, sf))


@query(
    "h13_stale_plans",
    f"with {DRIFT} select cast(l_orderkey as varchar) as plan_id, count(distinct l_partkey) as changed_objects from lineitem where concat('o', l_partkey) in (select name from drift where change is not null) group by l_orderkey",
)
def stale(spark, sf):
    plans = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("plan_id")).agg(
        F.collect_set(F.concat(F.lit("o"), F.col("l_partkey"))).alias("refs")
    )
    return governance.stale_plans(plans, *_snapshots(spark, sf))


# ---- plan weighing ----

TOP = "9223372036854775807::hugeint"
PLAN_LIMITS = Limits(explain_rows_warn=10_000, explain_rows_refuse=100_000, explain_cost_refuse=450_000.0)


def _product(parent: int) -> str:
    return f"""(select plan_id, list_reduce(list(greatest(est_rows, 1)::hugeint), lambda a, b: least(a * b, {TOP})) as p, count(*) as t
from plan_nodes where "table" is not null and parent_id = {parent} group by plan_id)"""


WEIGHED = f"""
, costs as (
  select r.plan_id, r.cost, coalesce(p0.p, 1) as pipe0, coalesce(p1.p, 1) as pipe1, case when p0.t > 0 then p0.p else 0 end as own0,
    case when p1.t > 0 then p1.p else 0 end as own1, case when p2.t > 0 then p2.p else 0 end as total2, g1.correlated as c1, g2.correlated as c2
  from plan_nodes r left join {_product(0)} p0 using (plan_id) left join {_product(1)} p1 using (plan_id) left join {_product(2)} p2 using (plan_id)
    join (select plan_id, correlated from plan_nodes where node_id = 1) g1 using (plan_id) join (select plan_id, correlated from plan_nodes where node_id = 2) g2 using (plan_id)
  where r.node_id = 0),
t1 as (select *, least(own1 + case when c2 then least(total2 * pipe1, {TOP}) else total2 end, {TOP}) as total1 from costs),
t0 as (select *, least(own0 + case when c1 then least(total1 * pipe0, {TOP}) else total1 end, {TOP}) as total0 from t1),
found as (
  select plan_id, case when total0 > 100000 then 2 else 1 end as rank from t0 where total0 > 10000
  union all select plan_id, case when est_rows > 100000 then 2 else 1 end from plan_nodes where access in ('full', 'index') and est_rows > 10000
  union all select plan_id, case when total0 > 10000 then 2 else 1 end from plan_nodes join t0 using (plan_id) where "table" is not null and no_join_cond
  union all select plan_id, 1 from plan_nodes join t0 using (plan_id) where sort and case when "table" is not null then greatest(est_rows, 0) when node_id = 0 then total0 when node_id = 1 then total1 else total2 end > 10000
  union all select plan_id, 1 from plan_nodes join t0 using (plan_id) where temp and case when "table" is not null then greatest(est_rows, 0) when node_id = 0 then total0 when node_id = 1 then total1 else total2 end > 10000
  union all select plan_id, 1 from plan_nodes where "table" is null and recursive
  union all select plan_id, 2 from t0 where cost > 450000
  union all select plan_id, 1 from plan_nodes where "table" is not null and est_rows < 0 and access in ('full', 'index', 'unknown'))
"""


@query(
    "h14_weigh_plans",
    with_sql(
        "plan_nodes",
        body=WEIGHED
        + """select plan_id, case coalesce(max(rank), 0) when 0 then 'OK' when 1 then 'WARN' else 'REFUSE' end as level, cast(any_value(total0) as bigint) as estimated_rows,
  count(rank) as reasons from t0 left join found using (plan_id) group by plan_id""",
    ),
)
def weigh(spark, sf):
    nodes = derive(spark, sf, "plan_nodes").withColumnRenamed("table", "table")
    return plan_weight.weigh_plans(nodes, PLAN_LIMITS)[0]


@query(
    "h14_findings",
    with_sql(
        "plan_nodes",
        body="""select plan_id, 'reads all of ' || "table" || ', however large it is' as reason, cast(1 as int) as rank, count(*) as n
from plan_nodes where "table" is not null and est_rows < 0 and access in ('full', 'index', 'unknown') group by plan_id, "table" """,
    ),
)
def findings(spark, sf):
    _, found = plan_weight.weigh_plans(derive(spark, sf, "plan_nodes"), PLAN_LIMITS)
    return found.where("ord = 7").groupBy("plan_id", "reason", "rank").agg(F.count(F.lit(1)).alias("n"))


# ---- rule sets ----

LOCAL = "select case when p_partkey % 5 = 0 then 'allow' else 'mask' end as kind, concat('db.t', p_partkey, '.c') as pattern, case when p_partkey % 5 = 0 then 'redact' when p_size % 3 = 0 then 'partial' when p_size % 3 = 1 then 'email' else 'redact' end as mode from {part} where p_partkey % 7 <> 1"
IMPORTED = "select case when p_partkey % 5 = 0 then 'allow' else 'mask' end as kind, concat('db.t', p_partkey, '.c') as pattern, case when p_partkey % 5 = 0 then 'redact' when p_size % 4 = 0 then 'partial' when p_size % 4 = 1 then 'email' else 'redact' end as mode from {part} where p_partkey % 6 <> 2"


@query(
    "h15_merge_rules",
    f"""with l as ({LOCAL.replace('{part}', 'part')}), i as ({IMPORTED.replace('{part}', 'part')})
select coalesce(l.kind, i.kind) as kind, coalesce(l.pattern, i.pattern) as pattern, case when l.mode <> i.mode then 'redact' else coalesce(l.mode, i.mode) end as mode,
  coalesce(l.mode <> i.mode, false) as conflict, l.mode as local_mode, i.mode as imported_mode from l full join i on l.kind = i.kind and l.pattern = i.pattern""",
)
def merge(spark, sf):
    part = table(spark, sf, "part")
    return rules.merge_rules(spark.sql(LOCAL, part=part), spark.sql(IMPORTED, part=part))


LOOSER = RuleSet.of({"*.*.*mail*": "partial", "db2.t2.*": "redact", "*.*.*_number": "email", "*.*.phone*": "partial"}, allow=["*.*.mail_id", "db3.*.*", "db4.*.login"])


@query(
    "h16_protection_diff",
    with_sql(
        "inventory",
        body=f", {rules_sql(RULES)}, b as ({RESOLVED}), r2 as (select * from ({RESOLVED.replace('rules', 'rules2')}) q)".replace(
            ", r2 as", f", {rules_sql(LOOSER).replace('rules(', 'rules2(', 1)}, r2 as"
        )
        + """, d as (select db, "table", "column", b.mode as old_mode, a.mode as new_mode,
  case when b.mode is not null and a.mode is null then 'unprotected' when b.mode is null and a.mode is not null then 'protected' when b.mode is distinct from a.mode then 'mode' when not b.allowed and a.allowed then 'allowed' end as change
  from b join r2 a using (db, "table", "column", type, "view", generated, type_loose))
select distinct db, "table", "column", old_mode, new_mode, change, change in ('unprotected', 'allowed') or (change = 'mode' and new_mode <> 'redact') as loosens from d where change is not null""",
    ),
)
def protection(spark, sf):
    inventory = derive(spark, sf, "inventory")
    return rules.protection_diff(rules.resolve_modes(inventory, RULES), rules.resolve_modes(inventory, LOOSER)).distinct()


USER_RULES = """select concat('p', p_size % 9) as profile, case when p_partkey % 3 = 0 then 'allow' else 'mask' end as kind,
  case when p_partkey % 50 = 0 and p_partkey % 3 > 0 then '*.*.phone' when p_partkey % 4 = 0 then concat('db1.t1', p_partkey % 7, '.last_name') else concat('db2.t', p_partkey % 30, '.', substr(p_name, 1, 3)) end as pattern,
  case when p_partkey % 3 = 0 then 'redact' when p_partkey % 5 = 0 then 'email' else 'partial' end as mode from {part}"""


@query(
    "h17_apply_mandatory",
    f"""with u as (select distinct * from ({USER_RULES.replace('{part}', 'part')}) q), {rules_sql(MANDATORY)}
select profile, kind, pattern, mode from u where not (kind = 'mask' and pattern in (select pattern from rules))
union select p.profile, 'mask', r.pattern, r.mode from (select distinct profile from u) p, rules r""",
)
def mandatory(spark, sf):
    kept, _ = rules.apply_mandatory(spark.sql(USER_RULES, part=table(spark, sf, "part")), MANDATORY)
    return kept.distinct()


@query(
    "h17_refused_allows",
    f"""select distinct profile, pattern, case when starts_with(pattern, 'db1.') then 'db1.t1*.last_name' else 'db2.*.c*' end as mandatory
from ({USER_RULES.replace('{part}', 'part')}) q where kind = 'allow' and (starts_with(pattern, 'db1.t1') or (starts_with(pattern, 'db2.') and split_part(pattern, '.', 3) like 'c%'))""",
)
def refused(spark, sf):
    _, bad = rules.apply_mandatory(spark.sql(USER_RULES, part=table(spark, sf, "part")), MANDATORY)
    return bad.select("profile", "pattern", "mandatory").distinct()


# ---- lineage ----

LINEAGE_RULES = RuleSet.of({"raw.users.c1": "email", "raw.users.c2*": "partial", "*.users.c3*": "redact", "raw.*.c45": "email"}, allow=["raw.users.c33"])
RAW_MODES = """case when c = 'c33' then 0 when c = 'c1' or c = 'c45' then 4 when starts_with(c, 'c2') then 2 when starts_with(c, 'c3') then 1 else 0 end"""
SPREAD = f"""
, e as (select distinct dst, src, case kind when 'const' then 0 when 'count' then 1 when 'identity' then 2 when 'aggregate' then 3 else 4 end as k, literal from edges),
base as (select distinct src as node, 2 as kind, {RAW_MODES} as modes, false as lit from (select src, split_part(src, '.', 3) as c from e where src not in (select dst from e) and starts_with(src, 'raw.')) q
  union select distinct src, 2, 0, false from e where src not in (select dst from e) and not starts_with(src, 'raw.')),
walk as (
  select node, kind, modes, lit from base
  union
  select e.dst, case when k = 0 then 0 when k = 1 then 1 when k = 2 then w.kind when w.kind = 0 then 0 else greatest(w.kind, k) end, case when k >= 2 then w.modes else 0 end, e.literal or (w.lit and k >= 2) or k = 0
  from walk w join e on e.src = w.node),
state as (select node, max(kind) as kind, bit_or(modes) as modes, bool_or(lit) as lit from walk group by node)
select node, kind, modes, lit, case when modes = 0 then null when kind = 2 and modes = 1 then 'redact' when kind = 2 and modes = 2 then 'partial' when kind = 2 and modes = 4 then 'email' else 'redact' end as mask from state"""


@query("h18_propagate", with_sql("edges", body=SPREAD).replace("with edges", "with recursive edges", 1))
def propagate(spark, sf):
    return lineage.propagate(derive(spark, sf, "edges"), LINEAGE_RULES)


@query(
    "h18_sources",
    with_sql(
        "edges",
        body=""", e as (select distinct dst, src from edges where kind <> 'const'),
walk as (select dst, src as source from e where src not in (select dst from e) union select e.dst, w.source from walk w join e on e.src = w.dst)
select dst, source from walk""",
    ).replace("with edges", "with recursive edges", 1),
)
def sources(spark, sf):
    return lineage.sources(derive(spark, sf, "edges"))


USE_RULES = RuleSet.of({"app.users.email": "partial", "app.users.salary": "redact", "app.contacts.email": "email"})
_PII = "in ('app.users.email', 'app.users.salary', 'app.contacts.email')"
EVALUATED = f"""select statement_id, case when not source {_PII} and not coalesce(partner {_PII}, false) then null
  when clause = 'order by' then case when source {_PII} then 'E_MASKED_ORDER' end
  when clause = 'write' then case when source {_PII} then 'E_MASKED_WRITE' end
  when clause = 'set operation' then case when partner is null or not source {_PII} or not partner {_PII} then 'E_MASKED_SET_OP' when partner = source then 'E_MASKED_FILTER' end
  when clause in ('where', 'having', 'join') then case when op not in ('=', 'in', 'is null') or not positive then 'E_MASKED_FILTER'
    when partner is null then case when clause = 'join' then 'E_MASKED_FILTER' end when not source {_PII} or not partner {_PII} or partner = source then 'E_MASKED_FILTER' end
  when op = 'expression' then case when source {_PII} then 'E_MASKED_EXPRESSION' end end as code from uses"""


@query("h19_evaluate_uses", with_sql("uses", body=EVALUATED))
def evaluate(spark, sf):
    return lineage.evaluate_uses(derive(spark, sf, "uses"), USE_RULES).select("statement_id", "code")


CATALOGUE = """select 'app' as db, split_part(c, '.', 2) as "table", split_part(c, '.', 3) as "column",
  case c when 'app.users.id' then 'bigint' when 'app.users.salary' then 'decimal(10,2)' when 'app.orders.total' then 'date' else 'varchar(80)' end as type,
  false as "view", c = 'app.users.id' as generated, false as type_loose
from (select distinct source as c from {uses}) q where c <> 'app.users.name'"""


@query(
    "h20_steering_risk",
    with_sql(
        "uses",
        body="""select statement_id, source, clause, op, positive, partner, case when source = 'app.users.salary' then 'number' else 'text' end as risk from uses
where not (clause = 'select' and op = 'plain') and source not in ('app.users.id', 'app.orders.total', 'app.contacts.email')""",
    ),
)
def steering(spark, sf):
    uses = derive(spark, sf, "uses")
    inventory = spark.sql(CATALOGUE.replace('"', "`"), uses=uses)
    return lineage.steering_risk(uses, inventory, RuleSet.of(allow=["app.contacts.*"]), DEFAULT_DETECTORS)


# ---- grants ----


def _grants(spark, sf):
    return derive(spark, sf, "grants").withColumn("tables", F.split("tables_text", ";"))


GRANTED = """
, c as (select p.plan_id, g.grant_id, g.statements >= 1 and g."rows" >= 1 and g.bytes >= 512 and p.est_rows <= g."rows" as ok,
    row_number() over (partition by p.plan_id order by g.start, g.grant_id) as rn
  from plans p join grants g on p.agent = g.agent and p.db = g.db and p.ts >= g.start and p.ts < g.expires
  where p.class = 'read' and not p.unmask and p.warnings = 0 and p.k_checks = 0 and p.verdict <> 'REFUSE' and not p.pii_filter and not p.hidden and not p.steers
    and list_has_all(string_split(g.tables_text, ';'), string_split(p.relations_text, ';')))
select p.plan_id, c.grant_id from plans p left join c on c.plan_id = p.plan_id and c.rn = 1 and c.ok"""


@query("h21_grant_coverage", with_sql("plans", "grants", body=GRANTED))
def coverage(spark, sf):
    plans = derive(spark, sf, "plans").withColumn("relations", F.split("relations_text", ";"))
    return governance.grant_coverage(plans, _grants(spark, sf)).select("plan_id", "grant_id")


LEDGER = """
, t as (select r.*, g.expires, g.statements as gs, g."rows" as gr, g.bytes as gb, r.ts < g.expires as live from runs r join grants g using (grant_id)),
s as (select *, sum(case when live then 1 else 0 end) over w as us, sum(case when live then "rows" else 0 end) over w as ur, sum(case when live then bytes else 0 end) over w as ub
  from t window w as (partition by grant_id order by ts, run_id rows unbounded preceding)),
q as (select *, case when not live then 'expired' when us - 1 >= gs then 'statements' when ur - "rows" >= gr then 'rows' when gb - (ub - bytes) < 512 then 'bytes' end as end_reason from s)
select run_id, grant_id, cast(case when end_reason is null then greatest(0, gs - us) end as bigint) as statements_left, cast(case when end_reason is null then greatest(0, gr - ur) end as bigint) as rows_left,
  cast(case when end_reason is null then greatest(0, gb - ub) end as bigint) as bytes_left, end_reason from q"""


@query("h22_grant_ledger", with_sql("runs", "grants", body=LEDGER))
def ledger(spark, sf):
    return governance.grant_ledger(derive(spark, sf, "runs"), _grants(spark, sf), bucket_seconds=3600).select(
        "run_id", "grant_id", "statements_left", "rows_left", "bytes_left", "end_reason"
    )


AUTO = {"read": "auto", "write": "ask", "ddl": "deny", "unmask": "ask"}


@query(
    "h23_auto_decision",
    with_sql(
        "plans",
        body="""select plan_id, case when class = 'write' then case when unmask then 'unmask' else 'write' end when unmask then 'unmask' else 'read' end as auto_action,
  case when unmask or class = 'write' then 'ask' else 'auto' end as auto_value from plans""",
    ),
)
def auto(spark, sf):
    log = derive(spark, sf, "plans").withColumnRenamed("class", "stmt_class")
    return governance.auto_decision(log, AUTO).select("plan_id", "auto_action", "auto_value")


PRIVILEGES = "SELECT INSERT DELETE TRUNCATE OWNER SUPERUSER CREATEDB".split()
GRANTED_ROWS = f"select concat('u', o_custkey) as principal, concat('t', o_orderkey % 50) as object, split_part('{','.join(PRIVILEGES)}', ',', cast(o_orderkey % 7 + 1 as int)) as privilege, split_part('read,write,ddl,admin', ',', cast(o_custkey % 4 + 1 as int)) as tier from {{orders}}"


@query(
    "h24_excess_privileges",
    f"""select distinct principal, object, privilege, tier from ({GRANTED_ROWS.replace('{orders}', 'orders')}) q where privilege <> 'SELECT' and case tier when 'read' then true
  when 'write' then privilege not in ('INSERT', 'DELETE') when 'ddl' then privilege = 'SUPERUSER' else false end""",
)
def excess(spark, sf):
    return governance.excess_privileges(spark.sql(GRANTED_ROWS, orders=table(spark, sf, "orders")))


@query(
    "h27_rowbound_violations",
    with_sql("audit", body="select event_id, affected, event_id % 50 as max_affected from audit where event_id % 50 > 0 and affected > event_id % 50 and event_id % 3 = 0"),
)
def rowbound(spark, sf):
    audit = derive(spark, sf, "audit")
    runs = audit.select(
        "event_id", F.col("event_id").alias("plan_id"), F.when(F.col("event_id") % 3 == 0, "write").otherwise("read").alias("class"), "affected"
    )
    approvals = audit.select(F.col("event_id").alias("plan_id"), (F.col("event_id") % 50).alias("max_affected"))
    return governance.rowbound_violations(runs, approvals).select("event_id", "affected", "max_affected")


# ---- limits and detectors of two policies ----

LIMITS_BEFORE = "select case p_partkey when 1 then 'k_anonymity' when 2 then 'ticket_window' else concat('limit', p_partkey) end as name, cast(p_size as bigint) as value from {part} where p_partkey % 7 <> 6"
LIMITS_AFTER = "select case p_partkey when 1 then 'k_anonymity' when 2 then 'ticket_window' else concat('limit', p_partkey) end as name, cast(case when p_partkey % 3 = 0 then p_size else (p_size * 7) % 11 end as bigint) as value from {part} where p_partkey % 11 <> 9"


@query(
    "h16_limits_diff",
    f"""with b as ({LIMITS_BEFORE.replace('{part}', 'part')}), a as ({LIMITS_AFTER.replace('{part}', 'part')})
select coalesce(b.name, a.name) as name, b.value as old, a.value as new,
  coalesce(case when coalesce(b.name, a.name) in ('k_anonymity', 'ticket_window') then a.value < b.value else b.value <> 0 and (a.value = 0 or a.value > b.value) end, true) as loosens
from b full join a on a.name = b.name where a.value is distinct from b.value""",
)
def limits(spark, sf):
    part = table(spark, sf, "part")
    return rules.limits_diff(spark.sql(LIMITS_BEFORE, part=part), spark.sql(LIMITS_AFTER, part=part)).select("name", "old", "new", "loosens")


@query(
    "h16_detectors_diff",
    """with b as (select distinct p_brand || p_size as detector from part where p_partkey % 3 > 0), a as (select distinct p_brand || p_size as detector from part where p_partkey % 4 > 0)
select coalesce(b.detector, a.detector) as detector, a.detector is null as loosens from b full join a on a.detector = b.detector where a.detector is null or b.detector is null""",
)
def detectors(spark, sf):
    part = table(spark, sf, "part")
    named = lambda rest: part.where(rest).select(F.concat("p_brand", F.col("p_size").cast("string")).alias("detector")).distinct()
    return rules.detectors_diff(named("p_partkey % 3 > 0"), named("p_partkey % 4 > 0"))
