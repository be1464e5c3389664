"""Queries of the masks and of the masked sink."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from maskwright.functions import masks
from maskwright.operators import masking, statements
from maskwright.operators.rules import RuleSet
from maskwright.session import run_dir
from maskwright.sources.sinks import publish_masked, publish_masked_table
from suite import query, table
from suite.derived import derive, with_sql
from suite.fragments import masked, partial

PEOPLE_RULES = RuleSet.of(
    {"crm.people.email": "email", "*.*.name": "partial", "*.people.*bsn*": "redact", "crm.people.n*": "partial"},
    allow=["crm.people.nationkey"],
)


@query("d1_redact", "select c_custkey, case when c_custkey % 9 > 0 then '<redacted>' end as name from customer")
def redact(spark, sf):
    name = F.when(F.col("c_custkey") % 9 > 0, F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", masks.mask_redact(name).alias("name"))


@query(
    "d2_partial",
    f"select c_custkey, {partial('c_name')} as name, {partial('c_mktsegment')} as segment, {partial('cast(c_custkey as varchar)')} as key_text from customer",
)
def partial_cells(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        masks.mask_partial(F.col("c_name")).alias("name"),
        masks.mask_partial(F.col("c_mktsegment")).alias("segment"),
        masks.mask_partial(F.col("c_custkey")).alias("key_text"),
    )


@query(
    "d3_email",
    with_sql(
        "people",
        body=f"select id, substr(email, 1, 1) || '***@' || split_part(email, '@', 2) as email, {partial('name')} as name from people",
    ),
)
def email_cells(spark, sf):
    return derive(spark, sf, "people").select(
        "id", masks.mask_email(F.col("email")).alias("email"), masks.mask_email(F.col("name")).alias("name")
    )


@query(
    "d4_binary",
    "select c_custkey, '<masked bytes:' || cast(octet_length(encode(c_name)) as varchar) || '>' as photo, '<redacted>' as scan from customer",
)
def binary_cells(spark, sf):
    customer = table(spark, sf, "customer").withColumn("photo", F.encode("c_name", "UTF-8"))
    binary = customer.schema["photo"].dataType
    return customer.select(
        "c_custkey",
        masks.mask_value(F.col("photo"), "partial", binary).alias("photo"),
        masks.mask_value(F.col("photo"), "redact", binary).alias("scan"),
    )


MASKED_PEOPLE = f"""
select id, {partial('name')} as name, substr(email, 1, 1) || '***@' || split_part(email, '@', 2) as email, {partial('phone')} as phone,
  {partial('iban')} as iban, {partial('card')} as card, {partial('niss')} as niss, {partial('nir')} as nir,
  case when bsn is not null then '<redacted>' end as bsn, gender, zip_code, nationkey, {partial('note')} as note
from people"""


@query("d5_mask_table", with_sql("people", body=MASKED_PEOPLE))
def mask_people(spark, sf):
    cols = "id name email phone iban card niss nir bsn gender zip_code nationkey note".split()
    return masking.mask_table(derive(spark, sf, "people").select(cols), "crm", "people", PEOPLE_RULES)


@query(
    "d5_mask_lineitem",
    f"""select * replace ({partial('l_returnflag')} as l_returnflag, '<redacted>' as l_extendedprice) from lineitem""",
)
def mask_lineitem(spark, sf):
    rules = RuleSet.of({"*.lineitem.l_returnflag": "partial", "*.*.*extended*": "redact"})
    return masking.mask_table(table(spark, sf, "lineitem"), "shop", "lineitem", rules)


@query(
    "d6_nested",
    with_sql(
        "people",
        body=f"""
select id, {masked('email', "'to ' || email")} as in_struct, {masked('email', 'email')} || '|' || name as in_array,
  {masked('email', 'email')} || '=' || {masked('email', "'cc ' || email")} as in_map from people""",
    ),
)
def nested(spark, sf):
    people = derive(spark, sf, "people").select(
        "id",
        F.struct(F.concat(F.lit("to "), "email").alias("line"), "id").alias("s"),
        F.array("email", "name").alias("a"),
        F.create_map("email", F.concat(F.lit("cc "), "email")).alias("m"),
    )
    types = {f.name: f.dataType for f in people.schema.fields}
    out = people.select("id", *[masks.mask_nested(F.col(c), types[c], ("email",)).alias(c) for c in ("s", "a", "m")])
    return out.select(
        "id",
        F.col("s.line").alias("in_struct"),
        F.array_join("a", "|").alias("in_array"),
        F.concat_ws("=", F.col("m")[0]["key"], F.col("m")[0]["value"]).alias("in_map"),
    )


@query(
    "d7_by_label",
    with_sql("people", body=f"select id, substr(email, 1, 1) || '***@' || split_part(email, '@', 2) as EMAIL, {partial('name')} as full_name, gender, zip_code as place from people"),
)
def by_label(spark, sf):
    people = derive(spark, sf, "people").select("id", F.col("email").alias("EMAIL"), F.col("name").alias("full_name"), "gender", F.col("zip_code").alias("place"))
    rules = RuleSet.of({"crm.people.email": "email", "*.*.*name": "partial", "crm.people.gender": "redact"}, allow=["*.*.gender"])
    return masking.mask_by_label(people, rules)


ERRORS = with_sql(
    "audit",
    body=f"""
select event_id, case event_id % 4
  when 0 then 'invalid input syntax for type integer: "<value redacted>"'
  when 1 then case when contains(lower(sql), 'emial') then error else 'Unknown column "<value redacted>"' end
  when 2 then case when contains(lower(sql), 'from') then error else 'syntax error at or near "<value redacted>"' end
  else 'bad thing u***(' || cast(length(split_part(error, ' ', 3)) as varchar) || ') here' end as error
from audit""",
)


@query("d9_redact_errors", ERRORS)
def errors(spark, sf):
    return masking.redact_errors(derive(spark, sf, "audit"), "error", "sql").select("event_id", "error")


LITERAL = "''[^'']*''|\\b[0-9]+\\b"


@query(
    "d10_redact_literals",
    with_sql(
        "audit",
        body=f"""
select event_id, case when engine = 'oracle' or contains(sql, '--') then '<redacted: may hold a secret>'
  else regexp_replace(sql, '{LITERAL}', '''<redacted>''', 'g') end as redacted_sql from audit""",
    ),
)
def literals(spark, sf):
    return statements.redact_literals(derive(spark, sf, "audit")).select("event_id", "redacted_sql")


@query(
    "d11_clear_literals",
    with_sql("audit", body="select event_id, event_id % 13 = 6 and engine <> 'oracle' as clear_literal from audit"),
)
def clear(spark, sf):
    return statements.clear_literals(derive(spark, sf, "audit")).select("event_id", "clear_literal")


CAP = 300
CAPPED = f"""
select doc_id, md5(case when strlen(text) > {CAP} then regexp_replace(
    left(text, cast(list_max(list_filter(range(0, {CAP}), lambda k: strlen(left(text, k)) <= {CAP - 3})) as int)),
    '[0-9A-Za-z@._%+\\-/() ]{{1,64}}$', '') || '…' else text end) as text_md5,
  cast(strlen(text) > {CAP} as int) as cut_cells
from documents"""


@query("d12_cap_cells", CAPPED)
def capped(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return masks.cap_cells(docs, CAP).select("doc_id", F.md5("text").alias("text_md5"), "cut_cells")


LEAKS = with_sql(
    "people",
    body="""
, cells as (
  select 'handle' as "column", lower(case id % 3 when 0 then reverse(email) else zip_code end) as cell from people
  union all select 'tag', lower(case id % 5 when 0 then hex(encode(email)) else gender end) from people
  union all select 'token', lower(case id % 7 when 0 then 'v=' || base64(encode(email)) else 'none' end) from people
  union all select 'note', lower(note) from people
), needles as (
  select distinct email as seed, form, lower(needle) as needle from (
    select email, 'plain' as form, email as needle from people union all select email, 'lower', lower(email) from people
    union all select email, 'reversed', reverse(email) from people union all select email, 'hex', hex(encode(email)) from people
    union all select email, 'base64', rtrim(base64(encode(email)), '=') from people)
)
select "column", form, cast(count(*) as bigint) as cells, count(distinct seed) as seeds
from cells join needles on contains(cell, needle) group by "column", form""",
)


@query("d13_leak_scan", LEAKS)
def leaks(spark, sf):
    people = derive(spark, sf, "people")
    published = people.select(
        F.expr("case id % 3 when 0 then reverse(email) else zip_code end").alias("handle"),
        F.expr("case id % 5 when 0 then hex(encode(email, 'UTF-8')) else gender end").alias("tag"),
        F.expr("case id % 7 when 0 then 'v=' || base64(encode(email, 'UTF-8')) else 'none' end").alias("token"),
        "note",
    )
    return masking.leak_scan(published, people.select(F.col("email").alias("seed")))


@query("a7_publish_masked", with_sql("people", body=MASKED_PEOPLE))
def publish(spark, sf):
    cols = "id name email phone iban card niss nir bsn gender zip_code nationkey note".split()
    path = run_dir(spark, "published")
    publish_masked(derive(spark, sf, "people").select(cols), "crm", "people", PEOPLE_RULES, path, partition_by=["gender"])
    return spark.read.parquet(path).select(cols)


@query("a7_publish_table", with_sql("people", body=MASKED_PEOPLE))
def publish_table(spark, sf):
    cols = "id name email phone iban card niss nir bsn gender zip_code nationkey note".split()
    db = f"published_{uuid.uuid4().hex}"
    spark.sql(f"create database {db} location '{run_dir(spark, db)}'")
    for _ in range(2):
        publish_masked_table(derive(spark, sf, "people").select(cols), "crm", "people", PEOPLE_RULES, f"{db}.people", "first")
    return spark.table(f"{db}.people").select(cols)
