"""Tables derived from the given ones, by the same SQL in both engines.

The given tables hold no contact data, logs or plans. Each select below makes
rows of that kind out of them, one or more per given row, so the derived
tables grow with the given ones.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from maskwright.session import spread
from suite import table


def idiv(a: str, b: int) -> str:
    return f"cast(floor(({a}) / {b}.0) as bigint)"


def pick(words: list[str], n: str) -> str:
    return f"split_part('{','.join(words)}', ',', cast(({n}) % {len(words)} + 1 as int))"


def pad(n: str, width: int) -> str:
    return f"lpad(cast({n} as string), {width}, '0')"


def plus(engine: str, ts: str, seconds: str) -> str:
    return f"timestampadd(SECOND, cast({seconds} as int), {ts})" if engine == "spark" else f"({ts} + to_seconds({seconds}))"


FIRST = ["Alice", "Bob", "Chloé", "David", "Emma", "Farid", "Greta"]
LAST = ["Dupont", "Martin", "Lambert", "Peeters", "Janssens"]


def _doubled(n: str) -> str:
    """A digit as Luhn counts it in every second place."""
    return f"(case when {n} > 4 then {n} * 2 - 9 else {n} * 2 end)"


def _digit(n: str, place: int) -> str:
    return f"({idiv(n, 10 ** place)} % 10)"


def _card(n: str) -> str:
    """400000, nine digits of n, and the Luhn check digit: 16 digits."""
    doubled = " + ".join(_doubled(_digit(n, p)) for p in (0, 2, 4, 6, 8))
    plain = " + ".join(_digit(n, p) for p in (1, 3, 5, 7))
    return f"concat('400000', {pad(n, 9)}, cast((10 - (8 + {doubled} + {plain}) % 10) % 10 as string))"


_BSN8 = "(10000000 + (c_custkey * 137) % 89999999)"
_BSN_SUM = " + ".join(f"{_digit(_BSN8, 7 - i)} * {9 - i}" for i in range(8))

PEOPLE = f"""
select *,
  case id % 4
    when 0 then concat('call ', phone, ' or write ', email, ' now')
    when 1 then concat('paid with ', substr(card, 1, 4), ' ', substr(card, 5, 4), ' ', substr(card, 9, 4), ' ', substr(card, 13, 4), ', iban ', iban, '.')
    when 2 then concat('niss ', niss, ' bsn ', coalesce(bsn, 'none'), ' ref 12345')
    else 'nothing personal here, order 42 of 2024-01-02'
  end as note
from (
  select c_custkey as id,
    concat({pick(FIRST, 'c_custkey')}, ' ', {pick(LAST, idiv('c_custkey', 7))}) as name,
    concat('user', c_custkey, '@mail', c_custkey % 7, '.example.com') as email,
    concat('+32 4', {pad('c_custkey % 90 + 10', 2)}, ' ', {pad('c_custkey % 1000', 3)}, ' ', {pad('(c_custkey * 7) % 1000', 3)}) as phone,
    concat('BE', {pad('98 - (((c_custkey * 7919 + 1000) % 1000000000000) * 1000000 + 111400) % 97', 2)}, {pad('(c_custkey * 7919 + 1000) % 1000000000000', 12)}) as iban,
    {_card('c_custkey')} as card,
    concat({pad('850730001 + c_custkey % 998', 9)}, {pad('97 - (850730001 + c_custkey % 998) % 97', 2)}) as niss,
    concat(cast(1850578006000 + c_custkey % 1000 as string), {pad('97 - (1850578006000 + c_custkey % 1000) % 97', 2)}) as nir,
    case when ({_BSN_SUM}) % 11 < 10 then concat(cast({_BSN8} as string), cast(({_BSN_SUM}) % 11 as string)) end as bsn,
    concat({pad('c_custkey % 900 + 1', 3)}, '-', {pad('c_custkey % 99 + 1', 2)}, '-', {pad('c_custkey % 9999 + 1', 4)}) as ssn,
    concat('19', {pad('c_custkey % 90 + 10', 2)}, '-01-', {pad('c_custkey % 28 + 1', 2)}) as birth_date,
    concat('zip', c_custkey % 40) as zip_code,
    {pick(['f', 'm', 'x'], 'c_custkey')} as gender,
    c_nationkey as nationkey,
    c_acctbal as balance
  from {{customer}}
) p
"""

# Column names of the derived catalogue: personal, quasi-identifying, "name", neutral.
PERSONAL = """email prenom voornaam telefoon street_name EmailAddress recipientName customer_name nom_client last_name
card_number password_hash account_nr national_id client_ip mobile_num login username e_mail rijksregisternummer""".split()
QUASI = "birth_date zip_code gender dob notes latitude bio geboortedatum code_postal sexe".split()
NAMES = "name nom".split()
NEUTRAL = """template_name mail_id status created_at email_id phone_type file_name login_count nombre_lignes amount
order_total id postal_handling_id zip_code_id checksum scan_pdf""".split()
COLUMN_NAMES = PERSONAL + QUASI + NAMES + NEUTRAL
TYPES = ["varchar(80)", "text", "bigint", "character varying(40)", "timestamp", "TEXT", "inet", "bytea", "date", "text[]"]

INVENTORY = f"""
select concat('db', {idiv('p_partkey', len(COLUMN_NAMES))} % 5) as db,
  concat('t', {idiv('p_partkey', len(COLUMN_NAMES))}) as "table",
  {pick(COLUMN_NAMES, 'p_partkey')} as "column",
  {pick(TYPES, 'p_size')} as type,
  {idiv('p_partkey', len(COLUMN_NAMES))} % 7 = 3 as "view",
  p_size % 17 = 0 as generated,
  p_size % 13 = 0 as type_loose
from {{part}}
"""

CODES = "E_MASKED_FILTER E_NO_LIMIT E_FORBIDDEN E_COST E_MASKED_ORDER E_FUNCTION E_OLD_CODE E_TIER".split()
TOKENS = ["like", "BETWEEN", "", "ssn_col", "--", "lower", "&&"]
ENGINES = ["mysql", "mariadb", "postgres", "sqlite", "oracle"]

_SQL = [
    "concat('SELECT id, email FROM users WHERE email LIKE ''a', event_id % 50, '%'' LIMIT ', event_id % 400 + 1)",
    "concat('select lower(email) from app.users u limit ', event_id % 30 + 1)",
    "concat('UPDATE accounts SET balance = ', event_id % 100, ' WHERE id = ', event_id % 20)",
    "'DELETE FROM sessions'",
    "concat('INSERT INTO log (a, b) VALUES (1, ''x''), (', event_id % 10, ', ''y''), (3, ''z'')')",
    "'SELECT name FROM pg_stats WHERE tablename = ''t'' LIMIT 5'",
    "concat('SELECT id FROM users WHERE email = ''user', event_id % 1500, '@mail', event_id % 7, '.example.com'' LIMIT 10')",
    "'SELECT SLEEP(5) LIMIT 1'",
    "concat('SELECT id FROM orders -- all of them ', event_id % 3)",
    "'UPDATE users SET active = 0 WHERE 1 = 1'",
    "'CREATE TABLE copy_of (id int)'",
    "concat('SELECT a FROM t; DROP TABLE t', event_id % 4)",
    "'SELECT id FROM orders'",
]

AUDIT = f"""
select event_id, ts, user_id, concat('agent', user_id) as agent,
  case event_type when 'error' then 'refused' when 'purchase' then 'run' when 'view' then 'approved' when 'click' then 'pending' else 'login' end as event,
  {pick(ENGINES, 'event_id')} as engine,
  concat('p', user_id % 4) as profile,
  case when event_type = 'error' and event_id % 13 > 0 then {pick(CODES, 'event_id')} end as code,
  case when event_type = 'error' then nullif({pick(TOKENS, 'event_id')}, '') end as token,
  case event_id % {len(_SQL)} {' '.join(f'when {i} then {s}' for i, s in enumerate(_SQL))} end as sql,
  case event_id % 4
    when 0 then 'invalid input syntax for type integer: "Smith"'
    when 1 then concat('Unknown column ''emial'' in ''where clause''')
    when 2 then 'syntax error at or near "FROM"'
    else concat('bad thing user', event_id, '@mail.example.com here') end as error,
  event_id % 6 = 0 as unmask,
  cast(event_id % 90 as bigint) as n_rows,
  cast((event_id * 37) % 9000 as bigint) as n_bytes,
  cast(event_id % 70 as bigint) as affected,
  concat('tk', {idiv('event_id', 5)}) as ticket
from {{events}}
"""

# One plan per order: a root group, its lines as tables, some in a nested group and one below it.
ACCESS = ["full", "index", "range", "lookup", "unknown"]
PLAN_NODES = f"""
select cast(o_orderkey as string) as plan_id, 0 as node_id, cast(null as int) as parent_id, cast(null as string) as "table",
  cast(null as string) as access, cast(-1 as bigint) as est_rows, o_orderkey % 3 = 0 as sort, o_orderkey % 5 = 0 as temp,
  false as correlated, false as no_join_cond, false as recursive, o_totalprice as cost
from {{orders}}
union all
select cast(o_orderkey as string), 1, 0, null, null, -1, o_orderkey % 4 = 0, false, o_orderkey % 2 = 0, false, o_orderkey % 97 = 0, null from {{orders}}
union all
select cast(o_orderkey as string), 2, 1, null, null, -1, false, o_orderkey % 7 = 0, o_orderkey % 3 = 1, false, false, null from {{orders}}
union all
select cast(l_orderkey as string), cast(1000 + l_linenumber as int),
  case when l_linenumber % 3 = 0 then 1 when l_linenumber % 5 = 0 then 2 else 0 end,
  concat('t', l_partkey % 100), {pick(ACCESS, 'l_suppkey')},
  case when l_partkey % 29 = 0 then cast(-1 as bigint) else cast(l_quantity as bigint) * (1 + (l_partkey % 11) * 40) end,
  false, l_partkey % 41 = 0, false, l_partkey % 31 = 0, false, null
from {{lineitem}} where l_orderkey in (select o_orderkey from {{orders}})
"""

# Seven layers of columns: each line is an edge from one layer to the next.
EDGE_KINDS = ["identity", "identity", "aggregate", "identity", "expr", "count", "identity", "const"]
EDGES = f"""
select concat('layer', l_linenumber % 7 + 1, '.t', (l_partkey * 3) % 11, '.c', (l_suppkey * 5) % 23) as dst,
  case when l_linenumber % 7 = 0 then concat('raw.users.c', l_partkey % 60)
       else concat('layer', l_linenumber % 7, '.t', l_partkey % 11, '.c', l_suppkey % 23) end as src,
  {pick(EDGE_KINDS, 'l_orderkey')} as kind,
  l_orderkey % 50 = 0 as literal
from {{lineitem}}
"""

USE_SOURCES = ["app.users.email", "app.users.name", "app.users.salary", "app.contacts.email", "app.orders.total", "app.users.id"]
CLAUSES = ["where", "join", "order by", "group by", "select", "having", "set operation", "write"]
OPS = ["=", "in", "like", "<", "plain", "expression", "is null", "<>"]
USES = f"""
select cast(event_id as string) as statement_id,
  {pick(USE_SOURCES, 'event_id')} as source,
  {pick(CLAUSES, idiv('event_id', 6))} as clause,
  {pick(OPS, idiv('event_id', 48))} as op,
  event_id % 5 > 0 as positive,
  case when event_id % 4 = 1 then {pick(USE_SOURCES, idiv('event_id', 11))} end as partner
from {{events}}
"""

# A grant per signup, for an hour; the other events of the agent in it are its plans and runs.
TABLE_SETS = ["app.users;app.orders", "app.orders", "app.users;app.orders;app.notes"]


def grants_sql(engine: str) -> str:
    return f"""
select concat('g', event_id) as grant_id, concat('agent', user_id) as agent, concat('db', user_id % 3) as db,
  {pick(TABLE_SETS, 'event_id')} as tables_text, ts as start, {plus(engine, 'ts', '3600 * (event_id % 12 + 1)')} as expires,
  cast(event_id % 5 + 1 as bigint) as statements, cast((event_id % 7) * 40 as bigint) as "rows", cast((event_id % 9) * 3000 as bigint) as bytes
from {{events}} where event_type = 'signup'
"""


PLANS = f"""
select concat('q', event_id) as plan_id, concat('agent', user_id) as agent, concat('db', user_id % 3) as db, ts,
  {pick(['app.users', 'app.orders', 'app.users;app.orders', 'app.notes'], 'event_id')} as relations_text,
  {pick(['read', 'read', 'read', 'write'], 'event_id')} as class, event_id % 6 = 0 as unmask,
  cast(case when event_id % 10 = 0 then 1 else 0 end as int) as warnings, cast(case when event_id % 14 = 0 then 1 else 0 end as int) as k_checks,
  {pick(['OK', 'WARN', 'OK', 'REFUSE', 'OK'], 'event_id')} as verdict, cast(event_id % 300 as bigint) as est_rows,
  event_id % 22 = 3 as pii_filter, event_id % 26 = 5 as hidden, event_id % 9 = 2 as steers
from {{events}} where event_type <> 'signup'
"""

# The runs of a grant: what its agent does, but for signing up, until the next grant. Numbers go by time.
RUNS = """
select concat('r', event_id) as run_id, concat('g', latest) as grant_id, ts, cast(event_id % 60 as bigint) as "rows", cast((event_id * 13) % 4000 as bigint) as bytes
from (select *, max(case when event_type = 'signup' then event_id end) over (partition by user_id order by event_id rows between unbounded preceding and current row) as latest from {events}) e
where event_type <> 'signup' and latest is not null
"""

NEEDS = {
    "people": (PEOPLE, ["customer"]),
    "inventory": (INVENTORY, ["part"]),
    "audit": (AUDIT, ["events"]),
    "plan_nodes": (PLAN_NODES, ["orders", "lineitem"]),
    "edges": (EDGES, ["lineitem"]),
    "uses": (USES, ["events"]),
    "grants": (grants_sql, ["events"]),
    "plans": (PLANS, ["events"]),
    "runs": (RUNS, ["events"]),
}


def _text(name: str, engine: str) -> str:
    sql = NEEDS[name][0]
    return sql(engine) if callable(sql) else sql


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = _text(name, "spark").replace('"', "`") if name != "audit" else _text(name, "spark")
    # Contact rows and statements cost much per row: their sources are dealt out.
    deal = spread if name in ("people", "inventory") else partial(spread, per_core=4) if name == "audit" else (lambda df: df)
    return spark.sql(sql, **{t: deal(table(spark, sf_dir, t)) for t in NEEDS[name][1]})


def with_sql(*names: str, body: str) -> str:
    """The oracle text: derived tables as common table expressions, then body."""
    parts = []
    for n in names:
        sql = _text(n, "duckdb")
        for t in NEEDS[n][1]:
            sql = sql.replace("{" + t + "}", t)
        parts.append(f"{n} as ({sql})")
    return f"with {', '.join(parts)} {body}"
