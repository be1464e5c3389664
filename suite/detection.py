"""Queries of the value detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import detectors as det
from maskwright.session import spread
from suite import query, table
from suite.derived import derive, with_sql
from suite.fragments import found, masked, partial


def _texts(kind, name="documents", key="doc_id", text="text"):
    def run(spark, sf):
        rows = spread(table(spark, sf, name))
        hits = F.size(det.find(kind, F.col(text)))
        keys = key.split(", ")
        return rows.select(*keys, hits.alias("hits"), F.md5(det.mask(kind, F.col(text))).alias("masked_md5")).where("hits > 0")

    return run


def _texts_sql(kind, name="documents", key="doc_id", text="text"):
    return f"""
select * from (select {key}, cast(len({found(kind, text)}) as int) as hits, md5({masked(kind, text)}) as masked_md5 from {name})
where hits > 0"""


def _notes(kind, column):
    def run(spark, sf):
        people = derive(spark, sf, "people")
        text = F.concat_ws(" ", "note", column)
        return people.select(
            "id", F.array_join(det.find(kind, text), "|").alias("found"), det.mask(kind, text).alias("masked")
        )

    return run


def _notes_sql(kind, column):
    text = f"concat_ws(' ', note, {column})"
    return with_sql(
        "people",
        body=f"select id, array_to_string({found(kind, 't')}, '|') as found, {masked(kind, 't')} as masked from (select id, {text} as t from people) q",
    )


query("c1_email_documents", _texts_sql("email"))(_texts("email"))
for _kind in ("email", "phone", "card", "iban"):
    for _name, _key, _text in (("conversations", "conv_id, turn", "text"), ("pages", "page_id", "html")):
        query(f"{dict(email='c1', phone='c2', card='c5', iban='c4')[_kind]}_{_kind}_{_name}", _texts_sql(_kind, _name, _key, _text))(_texts(_kind, _name, _key, _text))
query("c1_email_notes", _notes_sql("email", "email"))(_notes("email", "email"))
query("c2_phone_documents", _texts_sql("phone"))(_texts("phone"))
query("c2_phone_notes", _notes_sql("phone", "phone"))(_notes("phone", "phone"))
query("c4_iban_notes", _notes_sql("iban", "iban"))(_notes("iban", "iban"))
query("c5_card_documents", _texts_sql("card"))(_texts("card"))
query("c6_be_niss_notes", _notes_sql("be_niss", "niss"))(_notes("be_niss", "niss"))
query("c7_fr_nir_notes", _notes_sql("fr_nir", "nir"))(_notes("fr_nir", "nir"))
query("c8_nl_bsn_notes", _notes_sql("nl_bsn", "bsn"))(_notes("nl_bsn", "bsn"))
query("c9_us_ssn_notes", _notes_sql("us_ssn", "ssn"))(_notes("us_ssn", "ssn"))


@query(
    "c3_phone_loose",
    with_sql(
        "people",
        body=f"""
select id, n as number, case when id % 3 = 2 then n else {partial('n')} end as masked from (
  select id, case id % 3 when 0 then '(415) 555-' || lpad(cast(id % 10000 as varchar), 4, '0')
    when 1 then '612 345 ' || lpad(cast(id % 1000 as varchar), 3, '0')
    else '2026-01-' || lpad(cast(id % 28 + 1 as varchar), 2, '0') end as n from people) q""",
    ),
)
def phone_loose(spark, sf):
    people = derive(spark, sf, "people")
    number = F.expr(
        "case id % 3 when 0 then '(415) 555-' || lpad(cast(id % 10000 as string), 4, '0')"
        " when 1 then '612 345 ' || lpad(cast(id % 1000 as string), 3, '0')"
        " else '2026-01-' || lpad(cast(id % 28 + 1 as string), 2, '0') end"
    )
    return people.select("id", number.alias("number")).select(
        "id", "number", det.mask("phone_loose", F.col("number")).alias("masked")
    )


@query(
    "c10_numbers",
    with_sql(
        "people",
        body=f"""
select id, {partial('card')} as card, case when id % 2 = 0 then {partial('card')} else cast(id + 0.5 as varchar) end as amount,
  {partial('niss')} as niss, cast(nationkey as varchar) as nation from people""",
    ),
)
def numbers(spark, sf):
    people = derive(spark, sf, "people").select(
        "id",
        F.col("card").cast("bigint").alias("card"),
        F.when(F.col("id") % 2 == 0, F.col("card").cast("double")).otherwise(F.col("id") + F.lit(0.5)).alias("amount"),
        F.col("niss").cast("bigint").alias("niss"),
        "nationkey",
    )
    return people.select(
        "id",
        det.mask_number(F.col("card"), det.DEFAULT_DETECTORS).alias("card"),
        det.mask_number(F.col("amount"), det.DEFAULT_DETECTORS, floating=True).alias("amount"),
        det.mask_number(F.col("niss"), ("be_niss",)).alias("niss"),
        det.mask_number(F.col("nationkey"), ("be_niss", "card")).alias("nation"),
    )


@query(
    "c11_chain_notes",
    with_sql(
        "people",
        body=f"""
select id, {masked('phone', 'b')} as masked, id % 4 < 2 as hit from (
  select id, {masked('be_niss', 'a')} as b from (
    select id, {masked('card', masked('iban', masked('email', 'note')))} as a from people) q) r""",
    ),
)
def chain(spark, sf):
    names = det.DEFAULT_DETECTORS + ("be_niss",)
    return derive(spark, sf, "people").select(
        "id",
        det.mask_all(F.col("note"), names).alias("masked"),
        det.detects(F.col("note")).alias("hit"),
    )


FLAGSHIP_SQL = f"""
select lang, source, count(*) as documents,
  cast(count(*) filter (where len({found('email', 'text')}) > 0) as bigint) as with_email,
  cast(count(*) filter (where len({found('phone', 'text')}) > 0) as bigint) as with_phone,
  cast(count(*) filter (where len({found('card', 'text')}) > 0) as bigint) as with_card,
  cast(sum(length({masked('phone', 'b')})) as bigint) as protected_chars
from (select *, {masked('card', masked('email', 'text'))} as b from documents) q group by lang, source"""


@query("flagship_documents", FLAGSHIP_SQL)
def flagship(spark, sf):
    """Per language and source: documents with e-mail, phone and card values, and their protected text's size."""
    kinds = ("email", "phone", "card")
    docs = spread(table(spark, sf, "documents")).select(
        "lang",
        "source",
        F.char_length(det.mask_all(F.col("text"), kinds)).alias("protected"),
        *[(F.size(det.find(k, F.col("text"))) > 0).alias(k) for k in kinds],
    )
    return docs.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("documents"),
        *[F.count_if(k).alias(f"with_{k}") for k in kinds],
        F.sum("protected").alias("protected_chars"),
    )
