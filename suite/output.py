"""Queries of the output caps and of the capped export."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions.render import cap_chars, escape
from maskwright.operators import output
from maskwright.operators.output import Limits
from maskwright.session import run_dir
from maskwright.sources.sinks import export_capped
from suite import query, table


@query(
    "g1_cap_rows",
    "select c_custkey, cast(row_number() over (order by c_acctbal desc, c_custkey) as int) as row_no, (select count(*) from customer) > 200 as truncated from customer order by c_acctbal desc, c_custkey limit 200",
)
def rows(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return output.cap_rows(customer, 200, [F.desc("c_acctbal"), "c_custkey"]).select("c_custkey", "row_no", "truncated")


@query(
    "g2_cap_chars",
    "select doc_id, case when length(text) > 200 then left(text, 199) || '…' else text end as text from documents",
)
def chars(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cap_chars(F.col("text"), 200).alias("text"))


LINE = "c_custkey || chr(9) || c_name || chr(9) || c_mktsegment"


@query(
    "g3_cap_bytes",
    f"""select * from (select row_no, line, cast(sum(strlen(line) + 1) over (order by row_no) as bigint) as running_bytes, count(*) over () as total_rows
from (select row_number() over (order by c_acctbal desc, c_custkey) as row_no, {LINE} as line from customer order by c_acctbal desc, c_custkey limit 200) q) r
where running_bytes <= 3000""",
)
def size(spark, sf):
    customer = table(spark, sf, "customer")
    top = output.cap_rows(customer, 200, [F.desc("c_acctbal"), "c_custkey"])
    lines = top.select(F.col("row_no").cast("bigint").alias("row_no"), F.concat_ws("\t", "c_custkey", "c_name", "c_mktsegment").alias("line"))
    return output.cap_bytes(lines, 3000)


@query(
    "g4_render_cells",
    """select cast(o_orderkey as varchar) as o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as placed,
  case when floor(o_totalprice) = o_totalprice then cast(cast(o_totalprice as bigint) as varchar) else cast(o_totalprice as varchar) end as total,
  case when o_orderkey % 3 = 0 then 'NULL' else o_orderstatus end as status, cast(o_orderkey % 2 = 0 as varchar) as flag,
  '<bytes:' || cast(length(o_orderpriority) as varchar) || '>' as raw,
  case o_orderkey % 4 when 0 then 'NaN' when 1 then 'Infinity' when 2 then '-Infinity' else '0.5' end as odd
from orders""",
)
def cells(spark, sf):
    odd = F.expr("case o_orderkey % 4 when 0 then double('NaN') when 1 then double('Infinity') when 2 then double('-Infinity') else 0.5D end")
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_orderdate").alias("placed"),
        F.col("o_totalprice").alias("total"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("status"),
        (F.col("o_orderkey") % 2 == 0).alias("flag"),
        F.encode("o_orderpriority", "UTF-8").alias("raw"),
        odd.alias("odd"),
    )
    return output.render_cells(orders)


@query(
    "g5_escape_cells",
    """select doc_id, md5(replace(replace(replace(replace(text, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r') || '\\x1b[31m \\u202e \\x7f') as text_md5 from documents""",
)
def escaped(spark, sf):
    docs = table(spark, sf, "documents")
    text = F.concat("text", F.lit("\x1b[31m ‮ \x7f"))
    return docs.select("doc_id", F.md5(escape(text)).alias("text_md5"))


NOTE = "cells shown in part, up to the … (limits: 200 characters, 65536 bytes)]"


@query(
    "g6_cut_note",
    f"select n as cut_cells, '[' || cast(n as varchar) || ' {NOTE}' as note from (select cast(sum(case when length(text) > 200 then 1 else 0 end + case when length(lang) > 200 then 1 else 0 end) as bigint) as n from documents) q",
)
def note(spark, sf):
    docs = table(spark, sf, "documents").select("text", "lang")
    return output.cut_note(output.cap_cell_chars(docs, 200), 200)


EXPORT = f"""
with top as (select row_number() over (order by c_acctbal desc, c_custkey) as ord, {LINE} as line from customer order by c_acctbal desc, c_custkey limit 200),
cut as (select *, sum(strlen(line) + 1) over (order by ord) as running from top),
shown as (select * from cut where running <= 2000)
select 'c_custkey' || chr(9) || 'c_name' || chr(9) || 'c_mktsegment' as value
union all select line from shown
union all select '[output cut at 2000 bytes: ' || (select count(*) from shown) || ' of ' || (select count(*) from top) || ' rows shown]'
union all select '(' || (select count(*) from shown) || ' rows)' || case when (select count(*) from customer) > 200 then ' — more rows exist beyond the row cap' else '' end"""


@query("a8_export_capped", EXPORT)
def export(spark, sf):
    customer = table(spark, sf, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").select("c_custkey", "c_name", "c_mktsegment")
    path = run_dir(spark, "export")
    export_capped(customer, path, Limits(max_output_bytes=2000))
    return spark.read.text(path)
