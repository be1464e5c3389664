"""Queries of governed frames and of the k-anonymity counts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from maskwright.operators import disclosure
from maskwright.operators.output import Limits
from maskwright.operators.rules import RuleSet
from maskwright.plans.aggregates import agg
from maskwright.plans.governed import governed
from maskwright.session import run_dir
from suite import query, table
from suite.derived import derive, with_sql
from suite.fragments import partial

SHOP = RuleSet.of({"*.customer.c_name": "partial", "*.customer.c_acctbal": "redact", "*.supplier.s_name": "partial"})
CRM = RuleSet.of({"crm.people.email": "email", "crm.people.name": "partial", "crm.contacts.mail": "email"})


def shop(spark, sf, name):
    return governed(table(spark, sf, name), "shop", name, SHOP)


def people(spark, sf):
    cols = ["id", "name", "email", "zip_code", "gender", "nationkey", "note"]
    return governed(derive(spark, sf, "people").select(cols), "crm", "people", CRM)


CONTACTS = "select id * 2 as cid, concat('user', id * 2, '@mail', (id * 2) % 7, '.example.com') as mail, zip_code as place from {people}"


def contacts(spark, sf):
    return governed(spark.sql(CONTACTS, people=derive(spark, sf, "people")), "crm", "contacts", CRM)


def with_people(body: str) -> str:
    return with_sql("people", body=f", contacts as ({CONTACTS.replace('{people}', 'people')}) {body}")


NAME, RED = partial("c_name"), "'<redacted>'"
MAIL = "substr(email, 1, 1) || '***@' || split_part(email, '@', 2)"
CONTACT_MAIL = "substr(mail, 1, 1) || '***@' || split_part(mail, '@', 2)"


@query("e1_scan", f"select c_custkey, {NAME} as c_name, c_nationkey, {RED} as c_acctbal, c_mktsegment from customer")
def scan(spark, sf):
    return shop(spark, sf, "customer").result()


@query("e2_project", f"select {NAME} as who, c_custkey as key, {NAME} as again, c_mktsegment from customer")
def project(spark, sf):
    g = shop(spark, sf, "customer")
    return g.select(("c_name", "who"), ("c_custkey", "key"), ("c_name", "again"), "c_mktsegment").result()


@query(
    "e3_computed",
    f"""select c_custkey, {NAME} as c_name, case when c_nationkey < 10 then 'low' else upper(c_mktsegment) end as band,
  cast(c_custkey as varchar) as key_text, c_custkey * 2 + 1 as odd, c_mktsegment || '-' || c_nationkey as tag from customer""",
)
def computed(spark, sf):
    return (
        shop(spark, sf, "customer")
        .with_column("band", "case when c_nationkey < 10 then 'low' else upper(c_mktsegment) end")
        .with_column("key_text", "cast(c_custkey as string)")
        .with_column("odd", "c_custkey * 2 + 1")
        .with_column("tag", "c_mktsegment || '-' || c_nationkey")
        .select("c_custkey", "c_name", "band", "key_text", "odd", "tag")
        .result()
    )


FILTER = """(o_totalprice between 50000 and 250000 or o_orderpriority like '1-%') and not (o_orderstatus in ('F'))
 and o_orderpriority is not null and o_orderpriority is distinct from '5-LOW' and (o_custkey % 2 = 0) is true"""


@query("e4_filter", f"select o_orderkey, o_custkey, o_orderpriority from orders where {FILTER}")
def filtered(spark, sf):
    return shop(spark, sf, "orders").filter(FILTER).select("o_orderkey", "o_custkey", "o_orderpriority").result()


@query(
    "e5_filter_pii",
    with_people(f"select id, {partial('name')} as name, zip_code from people where name in ('Alice Dupont', 'Farid Martin', 'Nobody Here') and nationkey < 20"),
)
def filtered_pii(spark, sf):
    g = people(spark, sf).filter_pii("name", ["Alice Dupont", "Farid Martin", "Nobody Here"]).filter("nationkey < 20")
    return g.select("id", "name", "zip_code").result()


@query(
    "e6_join_inner",
    f"select o_orderkey, {NAME} as c_name, {RED} as c_acctbal, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey",
)
def joined(spark, sf):
    return (
        shop(spark, sf, "orders")
        .join(shop(spark, sf, "customer"), on=[("o_custkey", "c_custkey")])
        .join(shop(spark, sf, "nation"), on=[("c_nationkey", "n_nationkey")])
        .select("o_orderkey", "c_name", "c_acctbal", "n_name")
        .result()
    )


for _how in ("left", "right", "full"):

    @query(
        f"e6_join_{_how}",
        f"""select c_custkey, {NAME} as c_name, o_orderkey, o_orderstatus from customer {_how} join
(select o_orderkey, o_custkey + 40 as buyer, o_orderstatus from orders) o on c_custkey = buyer""",
    )
    def outer(spark, sf, how=_how):
        orders = shop(spark, sf, "orders").with_column("buyer", "o_custkey + 40").select("o_orderkey", "buyer", "o_orderstatus")
        g = shop(spark, sf, "customer").join(orders, on=[("c_custkey", "buyer")], how=how)
        return g.select("c_custkey", "c_name", "o_orderkey", "o_orderstatus").result()


@query(
    "e6_join_pii",
    with_people(f"select id, {MAIL} as email, cid, {CONTACT_MAIL} as mail, place from people join contacts on email = mail"),
)
def joined_pii(spark, sf):
    g = people(spark, sf).join(contacts(spark, sf), on=[("email", "mail")])
    return g.select("id", "email", "cid", "mail", "place").result()


@query(
    "e7_join_using",
    f"select nationkey, c_custkey, {NAME} as c_name, n_name from (select *, c_nationkey as nationkey from customer) c join (select *, n_nationkey as nationkey from nation) n using (nationkey)",
)
def using(spark, sf):
    c = shop(spark, sf, "customer").rename(nationkey="c_nationkey")
    n = shop(spark, sf, "nation").rename(nationkey="n_nationkey")
    return c.join(n, using=["nationkey"]).select("nationkey", "c_custkey", "c_name", "n_name").result()


@query(
    "e7_natural_join",
    f"select nationkey, s_suppkey, {partial('s_name')} as s_name, n_name from (select s_suppkey, s_name, s_nationkey as nationkey from supplier) natural join (select n_name, n_nationkey as nationkey from nation)",
)
def natural(spark, sf):
    s = shop(spark, sf, "supplier").select("s_suppkey", "s_name", ("s_nationkey", "nationkey"))
    n = shop(spark, sf, "nation").select("n_name", ("n_nationkey", "nationkey"))
    return s.natural_join(n).select("nationkey", "s_suppkey", "s_name", "n_name").result()


@query("e8_cross_join", f"select {partial('s_name')} as s_name, r_name from supplier cross join region")
def crossed(spark, sf):
    return shop(spark, sf, "supplier").cross_join(shop(spark, sf, "region")).select("s_name", "r_name").result()


@query("e9_theta_join", "select c_custkey, n_nationkey from customer join nation on n_nationkey < c_nationkey and c_nationkey - n_nationkey < 3")
def theta(spark, sf):
    c, n = shop(spark, sf, "customer").select("c_custkey", "c_nationkey"), shop(spark, sf, "nation").select("n_nationkey")
    return c.band_join(n, "c_nationkey", "n_nationkey", 1, 2).select("c_custkey", "n_nationkey").result()


@query("e9_band_join", "select s_suppkey, p_partkey from supplier join part on p_partkey - s_suppkey between -1 and 2")
def band(spark, sf):
    parts, suppliers = shop(spark, sf, "part").select("p_partkey"), shop(spark, sf, "supplier").select("s_suppkey")
    return parts.band_join(suppliers, "p_partkey", "s_suppkey", -1, 2).select("s_suppkey", "p_partkey").result()


@query(
    "e9_overlap_join",
    """select p_partkey, s_suppkey from (select p_partkey, p_partkey + p_size as p_end from part) p
join (select s_suppkey, s_suppkey * 20 as s_from, s_suppkey * 20 + s_nationkey * s_nationkey as s_end from supplier) s on p_partkey <= s_end and s_from <= p_end""",
)
def overlap(spark, sf):
    parts = shop(spark, sf, "part").with_column("p_end", "p_partkey + p_size").select("p_partkey", "p_end")
    spans = {"s_from": "s_suppkey * 20", "s_end": "s_suppkey * 20 + s_nationkey * s_nationkey"}
    suppliers = shop(spark, sf, "supplier").with_columns(spans).select("s_suppkey", "s_from", "s_end")
    return parts.overlap_join(suppliers, ("p_partkey", "p_end"), ("s_from", "s_end")).select("p_partkey", "s_suppkey").result()


@query(
    "e9_overlap_join_keys",
    """select a.o_orderkey as a_key, b.o_orderkey as b_key from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey
and cast(a.o_orderdate as date) <= cast(b.o_orderdate as date) + cast(b.o_orderkey % 90 as int) and cast(b.o_orderdate as date) <= cast(a.o_orderdate as date) + cast(a.o_orderkey % 90 as int)""",
)
def overlap_keys(spark, sf):
    spans = {"since": "cast(o_orderdate as date)", "until": "date_add(cast(o_orderdate as date), cast(o_orderkey % 90 as int))"}
    open_orders = shop(spark, sf, "orders").with_columns(spans).select(("o_orderkey", "key"), ("o_custkey", "cust"), "since", "until")
    a, b = open_orders.prefix("a_"), open_orders.prefix("b_")
    met = a.overlap_join(b, ("a_since", "a_until"), ("b_since", "b_until"), on=[("a_cust", "b_cust")])
    return met.filter("a_key < b_key").select("a_key", "b_key").result()


@query("e10_semi_join", f"select c_custkey, {NAME} as c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
def semi(spark, sf):
    big = shop(spark, sf, "orders").filter("o_totalprice > 300000")
    return shop(spark, sf, "customer").semi_join(big, on=[("c_custkey", "o_custkey")]).select("c_custkey", "c_name").result()


@query("e10_semi_join_pii", with_people(f"select id, {MAIL} as email from people where email in (select mail from contacts)"))
def semi_pii(spark, sf):
    return people(spark, sf).semi_join(contacts(spark, sf), on=[("email", "mail")]).select("id", "email").result()


@query("e11_anti_join", f"select c_custkey, {NAME} as c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def anti(spark, sf):
    some = shop(spark, sf, "orders").filter("o_orderstatus = 'P'")
    return shop(spark, sf, "customer").anti_join(some, on=[("c_custkey", "o_custkey")]).select("c_custkey", "c_name").result()


_ABOVE = "o_totalprice > 9000 * (c_nationkey + 1)"


@query("e10_exists_residual", f"select c_custkey, {NAME} as c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and {_ABOVE} and o_orderstatus <> 'P')")
def exists_residual(spark, sf):
    g = shop(spark, sf, "customer").semi_join(shop(spark, sf, "orders"), on=[("c_custkey", "o_custkey")], where=f"{_ABOVE} and o_orderstatus <> 'P'")
    return g.select("c_custkey", "c_name").result()


@query("e11_not_exists_residual", f"select c_custkey, {NAME} as c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and {_ABOVE})")
def not_exists_residual(spark, sf):
    g = shop(spark, sf, "customer").anti_join(shop(spark, sf, "orders"), on=[("c_custkey", "o_custkey")], where=_ABOVE)
    return g.select("c_custkey", "c_name").result()


_NULLED = "case when c_custkey % 10 > 0 then c_custkey end"


@query(
    "e11_not_in",
    f"""select 'no nulls' as case_name, k from (select {_NULLED} as k from customer) where k not in (select o_custkey from orders where o_orderstatus = 'F')
union all select 'a null', k from (select {_NULLED} as k from customer) where k not in (select nullif(o_custkey, 7) from orders where o_orderstatus = 'F')
union all select 'no rows', k from (select {_NULLED} as k from customer) where k not in (select o_custkey from orders where o_orderstatus = 'none')""",
)
def not_in(spark, sf):
    keys = shop(spark, sf, "customer").with_column("k", _NULLED).select("k")
    orders = shop(spark, sf, "orders").with_column("maybe", "nullif(o_custkey, 7)")
    out = None
    for name, other, col in (
        ("no nulls", orders.filter("o_orderstatus = 'F'"), "o_custkey"),
        ("a null", orders.filter("o_orderstatus = 'F'"), "maybe"),
        ("no rows", orders.filter("o_orderstatus = 'none'"), "o_custkey"),
    ):
        one = keys.anti_join(other, on=[("k", col)], not_in=True).with_column("case_name", f"'{name}'").select("case_name", "k")
        out = one if out is None else out.union_all(one)
    return out.result(names=())


@query(
    "e12_lateral",
    f"""select c_custkey, {NAME} as c_name, o_orderkey from customer, lateral (
  select o_orderkey, o_totalprice from orders where o_custkey = c_custkey order by o_totalprice desc, o_orderkey limit 2) t""",
)
def lateral(spark, sf):
    g = shop(spark, sf, "customer").lateral(
        shop(spark, sf, "orders"), on=[("c_custkey", "o_custkey")], order_by=["o_totalprice desc", "o_orderkey"], limit=2
    )
    return g.select("c_custkey", "c_name", "o_orderkey").result()


@query(
    "e12_lateral_aggregate",
    f"""select c_custkey, {NAME} as c_name, n, top, cast(urgent as bigint) as urgent from customer, lateral (
  select count(*) as n, max(o_totalprice) as top, count(*) filter (o_orderstatus = 'O') as urgent from orders where o_custkey = c_custkey and {_ABOVE}) t""",
)
def lateral_aggregate(spark, sf):
    body = [agg("count", alias="n"), agg("max", "o_totalprice", alias="top"), agg("count", alias="urgent", where="o_orderstatus = 'O'")]
    g = shop(spark, sf, "customer").lateral_join(shop(spark, sf, "orders"), on=[("c_custkey", "o_custkey")], where=_ABOVE, aggs=body)
    return g.select("c_custkey", "c_name", "n", "top", "urgent").result()


@query(
    "e12_lateral_top",
    f"""select c_custkey, {NAME} as c_name, o_orderkey, round(surplus, 2) as surplus from customer, lateral (
  select o_orderkey, o_totalprice - 9000 * c_nationkey as surplus from orders where o_custkey = c_custkey order by abs(o_totalprice - 9000 * c_nationkey), o_orderkey desc limit 2) t""",
)
def lateral_top(spark, sf):
    g = shop(spark, sf, "customer").lateral_join(
        shop(spark, sf, "orders"),
        on=[("c_custkey", "o_custkey")],
        columns={"order_key": "o_orderkey", "over": "o_totalprice - 9000 * c_nationkey"},
        order_by=["abs(o_totalprice - 9000 * c_nationkey)", "o_orderkey desc"],
        limit=2,
    )
    g = g.with_column("surplus", "round(over, 2)")
    return g.select("c_custkey", "c_name", ("order_key", "o_orderkey"), "surplus").result()


@query(
    "e12_lateral_left",
    f"""select c_custkey, {NAME} as c_name, o_orderkey, o_totalprice from customer left join lateral (
  select o_orderkey, o_totalprice from orders where o_custkey = c_custkey and {_ABOVE} order by o_totalprice desc, o_orderkey limit 1) t on true""",
)
def lateral_left(spark, sf):
    g = shop(spark, sf, "customer").lateral_join(
        shop(spark, sf, "orders"), on=[("c_custkey", "o_custkey")], where=_ABOVE, order_by=["o_totalprice desc", "o_orderkey"], limit=1, how="left"
    )
    return g.select("c_custkey", "c_name", "o_orderkey", "o_totalprice").result()


@query("e13_scalar", "select o_orderkey, o_totalprice = (select max(o_totalprice) from orders) as is_top from orders where o_totalprice > (select max(o_totalprice) from orders) * 0.9")
def scalar(spark, sf):
    orders = shop(spark, sf, "orders")
    top = orders.agg(agg("max", "o_totalprice", alias="top"))
    g = orders.with_scalar("top", top).filter("o_totalprice > top * 0.9").with_column("is_top", "o_totalprice = top")
    return g.select("o_orderkey", "is_top").result()


@query("e14_group_pii", with_people(f"select {partial('name')} as name, gender, n from (select name, gender, count(*) as n from people group by name, gender) q"))
def group_pii(spark, sf):
    return people(spark, sf).group_by("name", "gender").agg(agg("count", alias="n")).result()


@query(
    "e14_group_expression",
    "select c_nationkey % 5 as bucket, c_mktsegment, count(*) as n, cast(max(c_custkey) as bigint) as last from customer group by 1, 2",
)
def group_expression(spark, sf):
    g = shop(spark, sf, "customer").group_by(("bucket", "c_nationkey % 5"), "c_mktsegment")
    return g.agg(agg("count", alias="n"), agg("max", "c_custkey", alias="last")).result()


@query("e15_having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12")
def having(spark, sf):
    return shop(spark, sf, "orders").group_by("o_custkey").agg(agg("count", alias="n")).having("n > 12").result()


@query(
    "e16_count",
    "select c_mktsegment, count(*) as n, count(c_name) as names, count(nullif(c_nationkey, 3)) as nations from customer group by c_mktsegment",
)
def count(spark, sf):
    g = shop(spark, sf, "customer").group_by("c_mktsegment")
    return g.agg(
        agg("count", alias="n"), agg("count", "c_name", alias="names"), agg("count", "nullif(c_nationkey, 3)", alias="nations")
    ).result()


@query(
    "e17_min_max",
    f"select c_nationkey, {RED} as first_name, {RED} as richest, min(c_mktsegment) as low, max(c_mktsegment) as high, any_value(c_nationkey) as some, {partial('any_value(seg)')} as any_name from (select *, 'Same Name' as seg from customer) q group by c_nationkey",
)
def min_max(spark, sf):
    rules = RuleSet.of({"*.customer.c_name": "partial", "*.customer.c_acctbal": "redact", "*.customer.seg": "partial"})
    base = table(spark, sf, "customer").withColumn("seg", F.lit("Same Name"))
    g = governed(base, "shop", "customer", rules).group_by("c_nationkey")
    return g.agg(
        agg("min", "c_name", alias="first_name"),
        agg("max", "c_acctbal", alias="richest"),
        agg("min", "c_mktsegment", alias="low"),
        agg("max", "c_mktsegment", alias="high"),
        agg("any_value", "c_nationkey", alias="some"),
        agg("any_value", "seg", alias="any_name"),
    ).result()


_STATS = ["stddev", "stddev_samp", "stddev_pop", "variance", "var_samp", "var_pop", "avg"]


@query(
    "e18_statistics",
    "select l_returnflag, cast(sum(cast(l_quantity as bigint)) as bigint) as total, cast(sum(cast(l_quantity as bigint)) as double) as total_double, "
    + ", ".join(f"round({'stddev_samp' if f == 'stddev' else 'var_samp' if f == 'variance' else f}(l_quantity), 6) as {f}_q" for f in _STATS)
    + " from lineitem group by l_returnflag",
)
def statistics(spark, sf):
    g = shop(spark, sf, "lineitem").group_by("l_returnflag").agg(
        agg("sum", "cast(l_quantity as bigint)", alias="total"),
        agg("total", "l_quantity", alias="total_double"),
        *[agg(f, "l_quantity", alias=f"raw_{f}") for f in _STATS],
    )
    for f in _STATS:
        g = g.with_column(f"{f}_q", f"round(raw_{f}, 6)")
    return g.select("l_returnflag", "total", "total_double", *[f"{f}_q" for f in _STATS]).result()


@query(
    "e19_bits",
    """select l_orderkey, bit_and(l_linenumber) as a, bit_or(l_linenumber) as o, bit_xor(l_linenumber) as x,
  bool_and(l_tax > 0.01) as all_taxed, bool_or(l_tax > 0.07) as some_high, bool_and(l_quantity > 5) as every_big from lineitem group by l_orderkey""",
)
def bits(spark, sf):
    return (
        shop(spark, sf, "lineitem")
        .group_by("l_orderkey")
        .agg(
            agg("bit_and", "l_linenumber", alias="a"),
            agg("bit_or", "l_linenumber", alias="o"),
            agg("bit_xor", "l_linenumber", alias="x"),
            agg("bool_and", "l_tax > 0.01", alias="all_taxed"),
            agg("bool_or", "l_tax > 0.07", alias="some_high"),
            agg("every", "l_quantity > 5", alias="every_big"),
        )
        .result()
    )


@query(
    "e20_mixed_order",
    """select l_orderkey, string_agg(cast(l_linenumber as varchar), ',' order by l_returnflag desc, l_linenumber) as falling,
  string_agg(cast(l_linenumber as varchar), ',' order by nullif(l_returnflag, 'N') asc nulls last, l_linenumber desc) as last from lineitem group by l_orderkey""",
)
def mixed_order(spark, sf):
    keys = ("l_returnflag desc", "l_linenumber"), ("nullif(l_returnflag, 'N') asc nulls last", "l_linenumber desc")
    g = shop(spark, sf, "lineitem").group_by("l_orderkey")
    return g.agg(*[agg("string_agg", "l_linenumber", alias=n, order_by=k) for n, k in zip(("falling", "last"), keys)]).result()


_DISTINCT = ["stddev", "stddev_pop", "variance", "var_pop"]
_DISTINCT_BITS = ["bit_and", "bit_or", "bit_xor"]


@query(
    "e22_distinct_more",
    "select l_returnflag, "
    + ", ".join(f"round({f}(distinct l_quantity), 6) as {f}_q" for f in _DISTINCT)
    + ", "
    + ", ".join(f"{f}(distinct l_linenumber) filter (l_linenumber > 2) as {f}_n" for f in _DISTINCT_BITS)
    + " from lineitem group by l_returnflag",
)
def distinct_more(spark, sf):
    g = shop(spark, sf, "lineitem").group_by("l_returnflag").agg(
        *[agg(f, "l_quantity", alias=f"raw_{f}", distinct=True) for f in _DISTINCT],
        *[agg(f, "l_linenumber", alias=f"{f}_n", distinct=True, where="l_linenumber > 2") for f in _DISTINCT_BITS],
    )
    g = g.with_columns({f"{f}_q": f"round(raw_{f}, 6)" for f in _DISTINCT})
    return g.select("l_returnflag", *[f"{f}_q" for f in _DISTINCT], *[f"{f}_n" for f in _DISTINCT_BITS]).result()


@query(
    "e20_string_agg",
    """select l_orderkey, string_agg(l_returnflag, '|' order by l_linenumber, l_partkey, l_suppkey) as flags,
  string_agg(cast(l_linenumber as varchar), ',' order by l_linenumber desc) as numbers, string_agg(distinct l_linestatus, ',' order by l_linestatus) as statuses from lineitem group by l_orderkey""",
)
def strings(spark, sf):
    return (
        shop(spark, sf, "lineitem")
        .group_by("l_orderkey")
        .agg(
            agg("string_agg", "l_returnflag", alias="flags", separator="|", order_by=("l_linenumber", "l_partkey", "l_suppkey")),
            agg("group_concat", "l_linenumber", alias="numbers", order_by="l_linenumber", descending=True),
            agg("string_agg", "l_linestatus", alias="statuses", distinct=True),
        )
        .result()
    )


@query(
    "e21_collections",
    """select o_custkey, to_json(list(o_orderkey order by o_orderkey)) as keys_json, cast(len(list(o_orderkey)) as int) as n_keys,
  '{' || string_agg('"' || o_orderkey || '":"' || o_orderstatus || '"', ',' order by cast(o_orderkey as varchar)) || '}' as by_key from orders group by o_custkey""",
)
def collections(spark, sf):
    return (
        shop(spark, sf, "orders")
        .group_by("o_custkey")
        .agg(
            agg("json_agg", "o_orderkey", alias="keys_json", order_by="o_orderkey"),
            agg("array_agg", "o_orderkey", alias="keys"),
            agg("json_object_agg", "o_orderkey", "o_orderstatus", alias="by_key"),
        )
        .with_column("n_keys", "size(keys)")
        .select("o_custkey", "keys_json", "n_keys", "by_key")
        .result()
    )


@query(
    "e22_distinct_aggregate",
    "select c_mktsegment, count(distinct c_name) as names, count(distinct c_nationkey) as nations, cast(sum(distinct c_nationkey) as bigint) as total, avg(distinct c_nationkey) as mean from customer group by c_mktsegment",
)
def distinct_aggregate(spark, sf):
    return (
        shop(spark, sf, "customer")
        .group_by("c_mktsegment")
        .agg(
            agg("count", "c_name", alias="names", distinct=True),
            agg("count", "c_nationkey", alias="nations", distinct=True),
            agg("sum", "c_nationkey", alias="total", distinct=True),
            agg("avg", "c_nationkey", alias="mean", distinct=True),
        )
        .result()
    )


@query(
    "e23_filter_aggregate",
    "select o_custkey, count(*) filter (where o_orderstatus = 'F') as done, max(o_orderkey) filter (where o_totalprice > 100000) as last_big, cast(sum(o_orderkey) filter (where o_orderstatus = 'O') as bigint) as open_sum from orders group by o_custkey",
)
def filter_aggregate(spark, sf):
    return (
        shop(spark, sf, "orders")
        .group_by("o_custkey")
        .agg(
            agg("count", alias="done", where="o_orderstatus = 'F'"),
            agg("max", "o_orderkey", alias="last_big", where="o_totalprice > 100000"),
            agg("sum", "o_orderkey", alias="open_sum", where="o_orderstatus = 'O'"),
        )
        .result()
    )


@query("e24_distinct", with_people(f"select {partial('name')} as name, gender from (select distinct name, gender from people) q"))
def distinct(spark, sf):
    return people(spark, sf).select("name", "gender").distinct().result()


@query("e25_distinct_on", "select distinct on (o_custkey) o_custkey, o_orderkey, o_totalprice from orders order by o_custkey, o_totalprice desc, o_orderkey desc")
def distinct_on(spark, sf):
    g = shop(spark, sf, "orders").distinct_on(["o_custkey"], ["o_totalprice desc", "o_orderkey desc"])
    return g.select("o_custkey", "o_orderkey", "o_totalprice").result()


_OVER = "(partition by o_custkey order by o_totalprice desc, o_orderkey)"


@query(
    "e26_ranking",
    f"""select o_orderkey, cast(row_number() over {_OVER} as int) as rn, cast(rank() over (partition by o_custkey order by o_orderpriority) as int) as rk,
  cast(dense_rank() over (partition by o_custkey order by o_orderpriority) as int) as dr, round(percent_rank() over {_OVER}, 9) as pr,
  round(cume_dist() over {_OVER}, 9) as cd, cast(ntile(3) over {_OVER} as int) as nt from orders""",
)
def ranking(spark, sf):
    g = shop(spark, sf, "orders")
    by = {"partition_by": ["o_custkey"], "order_by": ["o_totalprice desc", "o_orderkey"]}
    ties = {"partition_by": ["o_custkey"], "order_by": ["o_orderpriority"]}
    g = g.window("rn", "row_number", **by).window("rk", "rank", **ties).window("dr", "dense_rank", **ties)
    g = g.window("pr0", "percent_rank", **by).window("cd0", "cume_dist", **by).window("nt", "ntile", "3", **by)
    g = g.with_column("pr", "round(pr0, 9)").with_column("cd", "round(cd0, 9)")
    return g.select("o_orderkey", "rn", "rk", "dr", "pr", "cd", "nt").result()


_HOT = "(partition by o_orderpriority order by o_totalprice desc, o_orderkey)"
_PEERS = "(partition by o_orderpriority order by o_orderdate)"


@query(
    "e26_ranking_hot",
    f"""select o_orderkey, cast(row_number() over {_HOT} as int) as rn, cast(rank() over {_PEERS} as int) as rk, cast(dense_rank() over {_PEERS} as int) as dr,
  round(percent_rank() over {_PEERS}, 9) as pr, round(cume_dist() over {_PEERS}, 9) as cd, cast(ntile(7) over {_HOT} as int) as nt from orders""",
)
def ranking_hot(spark, sf):
    """Five partitions hold all orders: each is cut along its order."""
    g = shop(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    by = {"partition_by": ["o_orderpriority"], "order_by": ["o_totalprice desc", "o_orderkey"], "hot_rows": 500}
    peers = {"partition_by": ["o_orderpriority"], "order_by": ["o_orderdate"], "hot_rows": 500}
    g = g.windows({"rn": ("row_number",), "nt": ("ntile", "7")}, **by)
    g = g.windows({"rk": ("rank",), "dr": ("dense_rank",), "pr0": ("percent_rank",), "cd0": ("cume_dist",)}, **peers)
    g = g.with_columns({"pr": "round(pr0, 9)", "cd": "round(cd0, 9)"})
    return g.select("o_orderkey", "rn", "rk", "dr", "pr", "cd", "nt").result()


_SOFAR = "(partition by o_orderstatus order by o_orderdate, o_orderkey rows between unbounded preceding and current row)"


@query(
    "e28_running_hot",
    f"""select o_orderkey, cast(sum(o_custkey) over {_SOFAR} as bigint) as total, count(*) over {_SOFAR} as seen,
  min(o_totalprice) over {_SOFAR} as low, max(o_totalprice) over {_SOFAR} as high from orders""",
)
def running_hot(spark, sf):
    by = {
        "partition_by": ["o_orderstatus"],
        "order_by": ["o_orderdate", "o_orderkey"],
        "frame": "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW",
        "hot_rows": 700,
    }
    g = shop(spark, sf, "orders").windows(
        {"total": ("sum", "o_custkey"), "seen": ("count", "*"), "low": ("min", "o_totalprice"), "high": ("max", "o_totalprice")}, **by
    )
    return g.select("o_orderkey", "total", "seen", "low", "high").result()


@query(
    "e27_analytic",
    f"""select o_orderkey, lag(o_orderkey) over {_OVER} as before, lead(o_orderkey, 2, -1) over {_OVER} as after2, first_value(o_orderkey) over {_OVER} as first,
  last_value(o_orderkey) over (partition by o_custkey order by o_totalprice desc, o_orderkey rows between unbounded preceding and unbounded following) as last,
  nth_value(o_orderkey, 2) over {_OVER} as second from orders""",
)
def analytic(spark, sf):
    by = {"partition_by": ["o_custkey"], "order_by": ["o_totalprice desc", "o_orderkey"]}
    whole = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    g = shop(spark, sf, "orders").window("before", "lag", "o_orderkey", **by).window("after2", "lead", "o_orderkey", "2", "-1", **by)
    g = g.window("first", "first_value", "o_orderkey", **by).window("last", "last_value", "o_orderkey", frame=whole, **by)
    return g.window("second", "nth_value", "o_orderkey", "2", **by).select("o_orderkey", "before", "after2", "first", "last", "second").result()


@query(
    "e28_frames",
    """select o_orderkey, cast(sum(o_orderkey) over (partition by o_custkey order by o_orderkey rows between 2 preceding and 1 following) as bigint) as near,
  count(*) over (partition by o_custkey order by o_orderkey range between 3000 preceding and current row) as recent,
  max(o_orderkey) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding) as last_before from orders""",
)
def frames(spark, sf):
    by = {"partition_by": ["o_custkey"], "order_by": ["o_orderkey"]}
    g = shop(spark, sf, "orders").window("near", "sum", "o_orderkey", frame="ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING", **by)
    g = g.window("recent", "count", "*", frame="RANGE BETWEEN 3000 PRECEDING AND CURRENT ROW", **by)
    g = g.window("last_before", "max", "o_orderkey", frame="ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", **by)
    return g.select("o_orderkey", "near", "recent", "last_before").result()


@query(
    "e29_union_all",
    f"select {NAME} as label, c_nationkey as nation from customer union all select {partial('s_name')}, s_nationkey from supplier union all select {partial('n_name')}, n_nationkey from nation",
)
def union_all(spark, sf):
    c = shop(spark, sf, "customer").select(("c_name", "label"), ("c_nationkey", "nation"))
    s = shop(spark, sf, "supplier").select(("s_name", "label"), ("s_nationkey", "nation"))
    n = shop(spark, sf, "nation").select(("n_name", "label"), ("n_nationkey", "nation"))
    return c.union_all(s).union_all(n).result()


_SETS = {
    "union": ("union", "union", {}),
    "intersect": ("intersect", "intersect", {}),
    "intersect_all": ("intersect all", "intersect", {"all": True}),
    "except": ("except", "except_", {}),
    "except_all": ("except all", "except_", {"all": True}),
}
for _name, (_op, _method, _args) in _SETS.items():

    @query(f"e30_{_name}", with_people(f"select {MAIL} as email from (select email from people {_op} select mail from contacts) q"))
    def set_operation(spark, sf, method=_method, args=_args):
        left, right = people(spark, sf).select("email"), contacts(spark, sf).select("mail")
        return getattr(left, method)(right, **args).result()


@query("e30_set_plain", "select o_custkey as k from orders intersect all select c_custkey from customer where c_nationkey < 12")
def set_plain(spark, sf):
    some = shop(spark, sf, "customer").filter("c_nationkey < 12").select("c_custkey")
    return shop(spark, sf, "orders").select(("o_custkey", "k")).intersect(some, all=True).result()


@query(
    "e31_order_limit",
    f"select c_custkey, {NAME} as c_name, c_mktsegment from customer order by c_mktsegment desc nulls last, c_custkey % 7, c_custkey limit 150",
)
def ordered(spark, sf):
    g = shop(spark, sf, "customer").order_by("c_mktsegment desc nulls last", "c_custkey % 7", "c_custkey")
    return g.select("c_custkey", "c_name", "c_mktsegment").limit(150).result(Limits())


@query("e32_limit_offset", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100 offset 40")
def offset(spark, sf):
    g = shop(spark, sf, "orders").order_by("o_totalprice desc", "o_orderkey").limit(100, offset=40)
    return g.select("o_orderkey", "o_totalprice").result(Limits())


TREE = """
with recursive tree as (
  select c_custkey, 0 as depth from customer where c_custkey = 0
  union all select c.c_custkey, t.depth + 1 from tree t join customer c on cast(floor(c.c_custkey / 3.0) as bigint) = t.c_custkey and c.c_custkey > 0)
select c_custkey, depth from tree"""


@query("e33_recursive", TREE)
def recursive(spark, sf):
    customer = shop(spark, sf, "customer").select("c_custkey")
    children = customer.filter("c_custkey > 0").with_column("parent", "cast(floor(c_custkey / 3.0) as bigint)")
    root = customer.filter("c_custkey = 0").with_column("depth", "0")

    def step(rows):
        found = rows.prefix("r_").join(children, on=[("r_c_custkey", "parent")])
        return found.with_column("depth", "r_depth + 1").select("c_custkey", "depth")

    return root.recursive(step).result()


@query(
    "e34_result_report",
    f"""select c_custkey, {NAME} as c_name, total, 'crm note 0***(10)' as note from (
  select c_custkey, c_name, cast(count(*) as bigint) as total from customer join orders on c_custkey = o_custkey group by c_custkey, c_name) q order by total desc, c_custkey limit 50""",
)
def governed_result(spark, sf):
    g = shop(spark, sf, "customer").join(shop(spark, sf, "orders"), on=[("c_custkey", "o_custkey")])
    g = g.group_by("c_custkey", "c_name").agg(agg("count", alias="total")).with_column("note", "'crm note 0475123456'")
    return g.order_by("total desc", "c_custkey").limit(50).result(Limits())


@query("e35_protected_write", "select c_custkey, c_mktsegment, cast(null as varchar) as c_name from customer")
def protected_write(spark, sf):
    path = run_dir(spark, "written")
    g = shop(spark, sf, "customer").select("c_custkey", "c_mktsegment").with_column("c_name", "null")
    g.write_to(path, "shop", "customer", SHOP)
    return spark.read.parquet(path)


@query(
    "e35_write_table",
    """select c_custkey, c_mktsegment, cast(null as varchar) as c_name, 'all' as batch from customer
union all select c_custkey, c_mktsegment, cast(null as varchar), 'building' from customer where c_mktsegment = 'BUILDING'""",
)
def write_table(spark, sf):
    db = f"written_{uuid.uuid4().hex}"
    spark.sql(f"create database {db} location '{run_dir(spark, db)}'")
    g = shop(spark, sf, "customer").select("c_custkey", "c_mktsegment").with_column("c_name", "null")
    # Each batch is written again, as after a lost driver: it replaces itself.
    for _ in range(2):
        g.write_table(db, "customer", SHOP, "all")
        g.filter("c_mktsegment = 'BUILDING'").write_table(db, "customer", SHOP, "building")
    return spark.table(f"{db}.customer")


# ---- k-anonymity ----


@query("f1_k_rows", with_people("select count(*) as n from people where name = 'Alice Dupont' and gender = 'f'"))
def k_rows(spark, sf):
    return disclosure.k_rows(derive(spark, sf, "people").where("name = 'Alice Dupont' and gender = 'f'"))


@query("f2_k_min_group", "select min(n) as n from (select count(*) as n from customer group by c_mktsegment, c_nationkey having count(*) > 2) q")
def k_min_group(spark, sf):
    return disclosure.k_min_group(table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"], having="_k > 2")


_VALUES = ["Alice Dupont", "Farid Martin", "Nobody Here", "Greta Janssens"]


@query(
    "f3_k_subjects",
    with_people(
        "select v as value, (select count(*) from people where name = v) as n from (select unnest(['Alice Dupont', 'Farid Martin', 'Nobody Here', 'Greta Janssens']) as v) q"
    ),
)
def k_subjects(spark, sf):
    return disclosure.k_values(derive(spark, sf, "people"), "name", _VALUES)


REPORT = f"""
, f as (select * from people where name in ('Alice Dupont', 'Nobody Here') and gender = 'f'),
g as (select count(*) as n from f group by zip_code)
select 'the PII filter' as "check", least((select count(*) from people where name = 'Alice Dupont'), 0) as n, true as under_k,
  'the PII filter: covers 0 rows, under k = 5' as warning
union all select 'a group', (select min(n) from g), (select min(n) from g) < 5, case when (select min(n) from g) < 5 then 'a group: covers ' || (select min(n) from g) || ' rows, under k = 5' end"""


@query("f4_k_report", with_people(REPORT))
def report(spark, sf):
    g = people(spark, sf).filter_pii("name", ["Alice Dupont", "Nobody Here"]).filter("gender = 'f'")
    return g.group_by("zip_code").agg(agg("count", alias="n")).k_report(5)


@query("f5_k_profile", with_people("select birth_date, zip_code, gender, count(*) as n from people group by all having count(*) < 5"))
def profile(spark, sf):
    return disclosure.k_profile(derive(spark, sf, "people"), ["birth_date", "zip_code", "gender"], 5)


@query("f6_group_flagged", with_people("select zip_code, gender, count(*) as n, cast(max(id) as bigint) as last, count(*) < 13 as under_k from people group by zip_code, gender"))
def flagged(spark, sf):
    return disclosure.group_by_flagged(derive(spark, sf, "people"), ["zip_code", "gender"], 13, [F.max("id").alias("last")])
