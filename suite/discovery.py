"""Queries of the catalogue, of name-based discovery and of rule matching."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from maskwright.operators import discovery, rules
from maskwright.operators.rules import RuleSet
from maskwright.session import run_dir, spread
from maskwright.sources import catalog
from maskwright.sources.sinks import load_rules, save_rules, valid_rules
from suite import query, table
from suite.derived import COLUMN_NAMES, PERSONAL, QUASI, derive, pick, with_sql
from suite.fragments import found

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE_RULES = RuleSet.of({"*.customer.c_name": "partial", "*.customer.c_acctbal": "redact", "*.supplier.s_*": "partial"}, allow=["*.*.s_suppkey"])
CORE_MODES = {
    ("customer", "c_name"): "partial",
    ("customer", "c_acctbal"): "redact",
    ("supplier", "s_name"): "partial",
    ("supplier", "s_nationkey"): "partial",
    ("supplier", "s_acctbal"): "partial",
}
SPARK_TYPES = """case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'VARCHAR' then 'string'
  when 'DOUBLE' then 'double' when 'TIMESTAMP' then 'timestamp_ntz' when 'FLOAT[]' then 'array<float>' end"""


def _counts_sql(tables, columns) -> str:
    return " union all ".join(
        f"select '{t}' as \"table\", '{c}' as \"column\", count(*) as row_count, count(*) - count({c}) as null_count from {t}"
        for t in tables
        for c in columns[t]
    )


COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split(),
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}


@query(
    "a1_column_inventory",
    f"""with counts as ({_counts_sql(TABLES, COLUMNS)})
select 'shop' as db, c."table", c."column", {SPARK_TYPES} as type, false as "view", false as generated, false as type_loose, row_count
from counts c join information_schema.columns i on i.table_name = c."table" and i.column_name = c."column" """,
)
def inventory(spark, sf):
    frames = {t: table(spark, sf, t) for t in TABLES}
    found_cols = catalog.column_inventory(spark, frames, "shop")
    counts = None
    for t, df in frames.items():
        one = catalog.describe_table(df, "shop", t).select("db", "table", "column", "row_count")
        counts = one if counts is None else counts.unionAll(one)
    return found_cols.join(counts, ["db", "table", "column"])


@query(
    "a2_sample_columns",
    """select 'lang' as "column", least(20, count(lang)) as samples, least(20, count(lang)) as known, true as short from documents
union all select 'source', least(20, count(source)), least(20, count(source)), true from documents
union all select 'text', least(20, count(text)), least(20, count(text)), true from documents""",
)
def samples(spark, sf):
    docs = table(spark, sf, "documents")
    cols = ["text", "lang", "source"]
    taken = catalog.sample_columns(docs, cols)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.substring(c, 1, 256).alias("value")) for c in cols])
    real = docs.select(F.inline(cells)).distinct().withColumn("known", F.lit(1))
    return (
        taken.join(real, ["column", "value"], "left")
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("samples"),
            F.count("known").alias("known"),
            (F.max(F.char_length("value")) <= 256).alias("short"),
        )
    )


def _mode_case() -> str:
    whens = " ".join(f"when c.\"table\" = '{t}' and c.\"column\" = '{c}' then '{m}'" for (t, c), m in CORE_MODES.items())
    return f"case {whens} end"


@query(
    "a3_describe_table",
    f"""with c as ({_counts_sql(TABLES, COLUMNS)})
select 'shop' as db, "table", "column", row_count, null_count, {_mode_case()} as mode from c""",
)
def describe(spark, sf):
    out = None
    for t in TABLES:
        one = catalog.describe_table(table(spark, sf, t), "shop", t, CORE_RULES)
        out = one if out is None else out.unionAll(one)
    return out.select("db", "table", "column", "row_count", "null_count", "mode")


@query(
    "a1_catalog_inventory",
    f"""select c."table", c."column", {SPARK_TYPES} as type, c."table" = 'region' as "view", row_count from ({_counts_sql(TABLES, COLUMNS)}) c
join information_schema.columns i on i.table_name = c."table" and i.column_name = c."column" """,
)
def catalogued(spark, sf):
    """The tables as a database of the session catalogue, one of them behind a view."""
    db = f"shop_{hashlib.sha256(sf.encode()).hexdigest()[:12]}"
    if not spark.catalog.databaseExists(db):
        spark.sql(f"create database {db} location '{run_dir(spark, db)}'")
    counts = None
    for t in TABLES:
        if t == "region":
            spark.sql(f"create view if not exists {db}.region as select * from parquet.`{sf}/region.parquet`")
        elif not spark.catalog.tableExists(f"{db}.{t}"):
            spark.catalog.createTable(f"{db}.{t}", path=f"{sf}/{t}.parquet", source="parquet")
        one = catalog.describe_table(spark.table(f"{db}.{t}"), db, t).select("db", "table", "column", "row_count")
        counts = one if counts is None else counts.unionAll(one)
    return catalog.catalog_inventory(spark, db).join(counts, ["db", "table", "column"]).select("table", "column", "type", "view", "row_count")


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


# The same verdicts by the names the derived catalogue is made of.
_DATES = "(lower(type) like 'timestamp%' or lower(type) like 'date%')"
IS_PERSONAL = f"""(case when type = 'inet' then true when {_DATES} then false when type = 'bytea' then "column" = 'scan_pdf'
  else "column" in {_in(PERSONAL)} end)"""
IS_QUASI = f"""(not {IS_PERSONAL} and "column" in {_in(QUASI)})"""
IS_TEXT = "(type_loose or ((lower(type) like '%char%' or lower(type) like '%text%') and type not like '%[]'))"
IS_CANDIDATE = f"""(not "view" and not generated and {IS_TEXT} and "column" in ('name', 'nom') and not {IS_PERSONAL})"""
PATTERN = "db || '.' || \"table\" || '.' || \"column\""


@query("b1_propose", with_sql("inventory", body=f"select distinct {PATTERN} as pattern from inventory where {IS_PERSONAL}"))
def propose(spark, sf):
    return discovery.propose(derive(spark, sf, "inventory"))


@query("b2_propose_quasi", with_sql("inventory", body=f"select distinct {PATTERN} as pattern from inventory where {IS_QUASI}"))
def propose_quasi(spark, sf):
    return discovery.propose_quasi(derive(spark, sf, "inventory"))


@query(
    "b3_name_candidates",
    with_sql("inventory", body=f"select distinct db, \"table\", \"column\", type from inventory where {IS_CANDIDATE}"),
)
def candidates(spark, sf):
    return discovery.name_candidates(derive(spark, sf, "inventory")).select("db", "table", "column", "type").distinct()


# Values of the "name" columns: people in even tables, postal codes in odd ones, a mix in every fifth.
SAMPLE_ROWS = """
select concat('db', t % 5) as db, concat('t', t) as "table", 'name' as "column",
  case when t % 5 = 0 and id % 2 = 0 then zip_code when t % 2 = 0 then name else zip_code end as value
from (select id, id % 300 as t, name, zip_code from {people}) s
"""
PERSON = "^\\p{Lu}\\p{Ll}+( \\p{Lu}\\p{Ll}+)+$"


def name_samples(spark, sf):
    return spark.sql(SAMPLE_ROWS.replace('"', "`"), people=derive(spark, sf, "people"))


NAMED = f"""select distinct {PATTERN} as pattern from inventory i where {IS_CANDIDATE} and exists (
  select 1 from ({SAMPLE_ROWS.replace('{people}', 'people')}) s where s.db = i.db and s."table" = i."table" and s."column" = i."column"
  group by s.db having sum(case when regexp_matches(value, '{PERSON}') then 1 else 0 end) >= count(value) * 0.6)"""


@query("b4_propose_name", with_sql("inventory", "people", body=NAMED))
def propose_name(spark, sf):
    return discovery.propose_name(discovery.name_candidates(derive(spark, sf, "inventory")), name_samples(spark, sf))


SCANNED = ["name", "email", "phone", "iban", "card", "niss", "ssn", "note"]
KINDS = ["email", "iban", "card", "phone"]


@query(
    "b5_scan_content",
    with_sql(
        "people",
        body=" union all ".join(
            f"select 'people' as \"table\", '{c}' as \"column\", '{k}' as detector, cast(sum(len({found(k, c)})) as bigint) as cell_hits, "
            f"cast(count(*) filter (where len({found(k, c)}) > 0) as bigint) as row_hits from people"
            for c in SCANNED
            for k in KINDS
        ),
    ),
)
def scan(spark, sf):
    return discovery.scan_content(derive(spark, sf, "people").select(SCANNED), "people")


@query(
    "b5_scan_documents",
    "select 'documents' as \"table\", 'text' as \"column\", k as detector, cast(sum(n) as bigint) as cell_hits, cast(sum(case when n > 0 then 1 else 0 end) as bigint) as row_hits from ("
    + " union all ".join(f"select '{k}' as k, len({found(k, 'text')}) as n from documents" for k in ("email", "card", "phone"))
    + ") q group by k",
)
def scan_documents(spark, sf):
    return discovery.scan_content(spread(table(spark, sf, "documents")).select("text"), "documents", ("email", "card", "phone"))


RULES = RuleSet.of(
    {
        "*.*.*mail*": "email",
        "db1.*.email": "partial",
        "*.*.phone*": "partial",
        "db2.t2.*": "redact",
        "*.t1*.LAST_name": "partial",
        "*.*.*_number": "redact",
        "*.*.bio": "redact",
        "*.t0.e_mail": "email",
        "nowhere.t4.email": "redact",
        "nowhere.nothing.login": "redact",
        "db0.nothing.absent": "redact",
        "db9.t1.*name": "partial",
        "*.*.prénom": "partial",
    },
    allow=["*.*.mail_id", "db3.*.*", "*.*.phone_type", "db7.t9.email"],
)


def rules_sql(r: RuleSet) -> str:
    return "rules(kind, pattern, mode) as (values " + ", ".join(f"('{x.kind}', '{x.pattern}', '{x.mode}')" for x in r.rules) + ")"


def seg_sql(i: int, name: str, p: str = "pattern") -> str:
    s = f"lower(split_part({p}, '.', {i}))"
    n = f"lower({name})"
    return (
        f"(case when {s} = '*' then true when {s} like '*%' and {s} like '%*' then contains({n}, trim({s}, '*')) "
        f"when {s} like '*%' then ends_with({n}, trim({s}, '*')) when {s} like '%*' then starts_with({n}, trim({s}, '*')) else {n} = {s} end)"
    )


MATCH = f"{seg_sql(1, 'db')} and {seg_sql(2, chr(34) + 'table' + chr(34))} and {seg_sql(3, chr(34) + 'column' + chr(34))}"


def _with_rules(body: str, *names: str, r: RuleSet = RULES) -> str:
    return with_sql("inventory", *names, body=", " + rules_sql(r) + " " + body)


@query("b7_match_rules", _with_rules(f'select db, "table", "column", kind, pattern, mode from inventory join rules on {MATCH}'))
def match(spark, sf):
    return rules.match_rules(derive(spark, sf, "inventory"), RULES)


RESOLVED = f"""select db, "table", "column", type, "view", generated, type_loose,
  case when bool_or(coalesce(kind = 'allow', false)) then null when count(distinct case when kind = 'mask' then mode end) = 1 then max(case when kind = 'mask' then mode end)
    when count(distinct case when kind = 'mask' then mode end) > 1 then 'redact' end as mode,
  bool_or(coalesce(kind = 'allow', false)) as allowed, count(kind) > 0 as covered
from inventory left join rules on {MATCH} group by all"""


@query("b8_resolve_modes", _with_rules(f'select db, "table", "column", mode, allowed, covered from ({RESOLVED}) q'))
def resolve(spark, sf):
    return rules.resolve_modes(derive(spark, sf, "inventory"), RULES).select("db", "table", "column", "mode", "allowed", "covered")


BOOT = f"""select 'mask' as kind, {PATTERN} as pattern from inventory where {IS_PERSONAL} and not covered
union select 'mask', pattern from ({NAMED.replace('from inventory i where', 'from inventory i where not covered and')}) q
union select 'quasi', {PATTERN} from inventory where {IS_QUASI} and not covered"""


@query(
    "b6_bootstrap",
    with_sql("inventory", "people", body=f", {rules_sql(RULES)}, inv as (select * from ({RESOLVED}) q) " + BOOT.replace("from inventory", "from inv")),
)
def bootstrap(spark, sf):
    mask, quasi = discovery.bootstrap(derive(spark, sf, "inventory"), name_samples(spark, sf), RULES)
    return mask.select(F.lit("mask").alias("kind"), "pattern").unionByName(quasi.select(F.lit("quasi").alias("kind"), "pattern"))


LABELS = """select distinct case when p_partkey % 3 = 0 then concat("column", 'é') when p_partkey % 3 = 1 then upper("column") else "column" end as label from (
  select p_partkey, {name} as "column" from {part}) q"""


def _labels_sql():
    return LABELS.replace("{name}", pick(COLUMN_NAMES, "p_partkey")).replace("{part}", "part")


@query(
    "b9_match_by_name",
    f"""with labels as ({_labels_sql()}), {rules_sql(RULES)}
select label, case
    when bool_or(kind = 'allow' and starts_with(pattern, '*.*.') and {seg_sql(3, 'label')}) then null
    when count(distinct m) = 1 then max(m) when count(distinct m) > 1 then 'redact' end as mode
from (select label, kind, pattern,
    case when kind = 'mask' and (strlen(label) > length(label) or {seg_sql(3, 'label')}
      or (contains(pattern, 'prénom') and regexp_matches(lower(label), '^pr.nom$'))) then mode end as m from labels, rules) q
group by label""",
)
def by_name(spark, sf):
    sql = LABELS.replace("{name}", pick(COLUMN_NAMES, "p_partkey")).replace('"', "`")
    return rules.match_by_name(spark.sql(sql, part=table(spark, sf, "part")), RULES, "label")


DEAD = f"select kind, pattern, mode from rules where not exists (select 1 from inventory where {MATCH})"


@query("b10_dead_rules", _with_rules(DEAD))
def dead(spark, sf):
    return rules.unmatched(derive(spark, sf, "inventory"), RULES)


CANDIDATES = f"""
, dead as ({DEAD}), near as (
  select distinct pattern, {PATTERN} as candidate, case when {seg_sql(2, chr(34) + 'table' + chr(34))} then 1 else 2 end as tier
  from dead, inventory where {seg_sql(3, chr(34) + 'column' + chr(34))}),
best as (select *, min(tier) over (partition by pattern) as t from near),
ranked as (select pattern, tier, candidate, cast(row_number() over (partition by pattern order by candidate) as int) as rank from best where tier = t)
select pattern, tier, candidate, rank from ranked where rank <= 5"""


@query("b11_rule_candidates", _with_rules(CANDIDATES))
def rule_candidates(spark, sf):
    return rules.rule_candidates(derive(spark, sf, "inventory"), RULES)


MANDATORY = RuleSet.of({"*.*.*mail*": "redact", "db1.t1*.last_name": "redact", "*.*.phone": "partial", "db2.*.c*": "redact"})
# An allow pattern per column of the catalogue, in six spellings.
ALLOWS = """select distinct case p_size % 6 when 0 then concat(db, '.', "table", '.', "column") when 1 then concat('*.*.', substr("column", 1, 3), '*')
  when 2 then concat('*.', "table", '.*', substr("column", 2)) when 3 then concat(db, '.*.*', substr("column", 2, 3), '*')
  when 4 then concat('*.t1*.', "column") else concat(db, '.t*.', "column") end as pattern
from (select i.*, length("column") + length("table") as p_size from {inventory} i) q"""


def _overlap_sql(i: int) -> str:
    """Whether segment i of two patterns can name one thing (a: allow, m: mandatory)."""
    a, m = f"lower(split_part(a.pattern, '.', {i}))", f"lower(split_part(m.pattern, '.', {i}))"
    al, ml = f"trim({a}, '*')", f"trim({m}, '*')"
    both = lambda s: f"({s} = '*' or ({s} like '*%' and {s} like '%*'))"
    return f"""(case when not contains({a}, '*') and not contains({m}, '*') then {a} = {m}
      when {both(a)} or {both(m)} then case when not contains({a}, '*') then contains({a}, {ml}) when not contains({m}, '*') then contains({m}, {al}) else true end
      when not contains({a}, '*') then case when {m} like '*%' then ends_with({a}, {ml}) else starts_with({a}, {ml}) end
      when not contains({m}, '*') then case when {a} like '*%' then ends_with({m}, {al}) else starts_with({m}, {al}) end
      when {a} like '%*' and {m} like '%*' then starts_with({al}, {ml}) or starts_with({ml}, {al})
      when {a} like '*%' and {m} like '*%' then ends_with({al}, {ml}) or ends_with({ml}, {al})
      else true end)"""


@query(
    "b12_overlapping_rules",
    with_sql(
        "inventory",
        body=f", {rules_sql(MANDATORY)}, a as ({ALLOWS.replace('{inventory}', 'inventory')}) "
        f"select a.pattern, m.pattern as mandatory from a join rules m on {_overlap_sql(1)} and {_overlap_sql(2)} and {_overlap_sql(3)}",
    ),
)
def overlapping(spark, sf):
    allows = spark.sql(ALLOWS.replace('"', "`"), inventory=derive(spark, sf, "inventory"))
    return rules.overlapping_rules(allows, MANDATORY)


# A rule table per catalogue column, some of it invalid.
RULE_ROWS = """select case when n % 3 = 0 then 'allow' else 'mask' end as kind,
  case n % 8 when 0 then concat("table", '.', "column") when 1 then concat(db, '..', "column") when 2 then concat(db, '.', "table", '.a*b*c') else concat(db, '.', "table", '.', "column") end as pattern,
  case n % 5 when 1 then 'partial' when 2 then 'email' when 3 then 'hash' else 'redact' end as mode
from (select i.*, length("column") * 7 + length("table") * 3 + length(db) + length(type) as n from {inventory} i) q"""
VALID = "(not (pattern like '%..%' or pattern like '%*%' or pattern not like '%.%.%') and mode <> 'hash' and not (kind = 'allow' and mode <> 'redact'))"


@query(
    "a6_rule_table",
    with_sql("inventory", body=f"select distinct kind, pattern, mode from ({RULE_ROWS.replace('{inventory}', 'inventory')}) r where {VALID}"),
)
def rule_table(spark, sf):
    rows = spark.sql(RULE_ROWS.replace('"', "`"), inventory=derive(spark, sf, "inventory"))
    path = run_dir(spark, "rules")
    save_rules(rows, path)
    return load_rules(spark, path)


@query(
    "a6_rule_problems",
    with_sql(
        "inventory",
        body=f"select {VALID} as valid, count(*) as n from ({RULE_ROWS.replace('{inventory}', 'inventory')}) r group by 1",
    ),
)
def rule_problems(spark, sf):
    rows = spark.sql(RULE_ROWS.replace('"', "`"), inventory=derive(spark, sf, "inventory"))
    return valid_rules(rows).groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


