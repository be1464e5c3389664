"""Queries of the scalar function families over governed frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import scalars
from maskwright.plans.governed import governed
from suite import query, table
from suite.governed import SHOP, shop


def _computed(g, exprs: dict[str, str], *keep: str):
    return g.with_columns(exprs).select(*keep, *exprs).result(names=())


STRINGS = {
    "s_lower": ("lower(p_name)", "lower(p_name)"),
    "s_upper": ("upper(p_type)", "upper(p_type)"),
    "s_len": ("length(p_name)", "cast(length(p_name) as int)"),
    "s_bytes": ("octet_length(p_name)", "cast(strlen(p_name) as int)"),
    "s_sub": ("substring(p_name, 2, 4)", "substr(p_name, 2, 4)"),
    "s_mid": ("mid(p_name, 2, 3)", "substr(p_name, 2, 3)"),
    "s_trim": ("trim(concat('  ', p_name, ' '))", "p_name"),
    "s_btrim": ("btrim(concat('xx', p_brand, 'x'), 'x')", "trim(concat('xx', p_brand, 'x'), 'x')"),
    "s_replace": ("replace(p_name, 'r', 'RR')", "replace(p_name, 'r', 'RR')"),
    "s_concat": ("concat_ws('-', p_brand, p_type)", "concat_ws('-', p_brand, p_type)"),
    "s_left": ("left(p_name, 3)", "left(p_name, 3)"),
    "s_right": ("right(p_name, 3)", "right(p_name, 3)"),
    "s_lpad": ("lpad(p_name, 20, '*')", "lpad(p_name, 20, '*')"),
    "s_rpad": ("rpad(p_name, 20, '.')", "rpad(p_name, 20, '.')"),
    "s_reverse": ("reverse(p_name)", "reverse(p_name)"),
    "s_pos": ("strpos(p_name, 'i')", "cast(instr(p_name, 'i') as int)"),
    "s_locate": ("locate('e', p_name)", "cast(instr(p_name, 'e') as int)"),
    "s_repeat": ("repeat(left(p_name, 1), 3)", "repeat(left(p_name, 1), 3)"),
    "s_initcap": ("initcap(p_name)", "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"),
    "s_ascii": ("ascii(p_name)", "ascii(p_name)"),
    "s_unicode": ("unicode(p_name)", "unicode(p_name)"),
    "s_chr": ("chr(65 + p_size % 26)", "chr(65 + p_size % 26)"),
    "s_hex": ("hex(p_brand)", "hex(p_brand)"),
    "s_unhex": ("cast(unhex(hex(p_brand)) as string)", "p_brand"),
    "s_space": ("concat('[', space(3), ']')", "'[   ]'"),
    "s_split": ("split_part(p_name, ' ', 2)", "split_part(p_name, ' ', 2)"),
    "s_subidx": ("substring_index(p_name, ' ', 1)", "split_part(p_name, ' ', 1)"),
    "s_translate": ("translate(p_name, 'aei', '123')", "translate(p_name, 'aei', '123')"),
    "s_starts": ("starts_with(p_name, 'red')", "starts_with(p_name, 'red')"),
    "s_regexp": ("regexp_replace(p_name, '[aeiou]', '_')", "regexp_replace(p_name, '[aeiou]', '_', 'g')"),
    "s_match": ("element_at(regexp_match(p_brand, '[0-9]+'), 1)", "regexp_extract(p_brand, '[0-9]+')"),
    "s_findset": ("find_in_set(p_type, 'ECONOMY,PROMO,LARGE')", "case p_type when 'ECONOMY' then 1 when 'PROMO' then 2 when 'LARGE' then 3 else 0 end"),
    "s_elt": ("elt(p_size % 3 + 1, 'a', 'b', 'c')", "split_part('a,b,c', ',', p_size % 3 + 1)"),
    "s_strcmp": ("strcmp(p_name, p_brand)", "case when p_name < p_brand then -1 when p_name > p_brand then 1 else 0 end"),
    "s_format": ("format_string('%s/%05d', p_brand, p_size)", "printf('%s/%05d', p_brand, p_size)"),
    "s_number": ("format(p_retailprice, 2)", "format('{:,.2f}', p_retailprice)"),
    "s_zero": ("hex(zeroblob(p_size % 4))", "repeat('00', p_size % 4)"),
}


def _family(name, exprs, base, keys, build):
    sql = f"select {', '.join(keys)}, {', '.join(f'{b} as {n}' for n, (_, b) in exprs.items())} from {base}"

    @query(name, sql)
    def run(spark, sf):
        scalars.register(spark)
        return _computed(build(spark, sf), {n: a for n, (a, _) in exprs.items()}, *keys)

    return run


_family("j1_strings", STRINGS, "part", ["p_partkey"], lambda spark, sf: shop(spark, sf, "part"))


@query(
    "j1_field",
    "select p_partkey, cast(case p_type when 'PROMO' then 1 when 'ECONOMY' then 2 else 0 end as int) as place, cast((p_size % 2 = 0)::int + (p_size % 3 = 0)::int as int) as nulls from part",
)
def field(spark, sf):
    g = shop(spark, sf, "part").with_column("place", scalars.field(F.col("p_type"), "PROMO", "ECONOMY"))
    a, b = F.when(F.col("p_size") % 2 != 0, 1), F.when(F.col("p_size") % 3 != 0, 1)
    return g.with_column("nulls", scalars.num_nulls(a, b)).select("p_partkey", "place", "nulls").result(names=())


CONDITIONALS = {
    "c_coalesce": ("coalesce(nullif(c_mktsegment, 'BUILDING'), 'none')", "coalesce(nullif(c_mktsegment, 'BUILDING'), 'none')"),
    "c_ifnull": ("ifnull(nullif(c_nationkey, 3), -1)", "ifnull(nullif(c_nationkey, 3), -1)"),
    "c_if": ("if(c_nationkey > 10, 'high', 'low')", "case when c_nationkey > 10 then 'high' else 'low' end"),
    "c_iif": ("iif(c_nationkey > 5, 'a', 'b')", "case when c_nationkey > 5 then 'a' else 'b' end"),
    "c_greatest": ("greatest(c_nationkey, nullif(10, c_nationkey % 11))", "greatest(c_nationkey, nullif(10, c_nationkey % 11))"),
    "c_least": ("least(c_nationkey, nullif(10, c_nationkey % 11))", "least(c_nationkey, nullif(10, c_nationkey % 11))"),
    "c_nvl": ("nvl(nullif(c_mktsegment, 'MACHINERY'), 'm')", "coalesce(nullif(c_mktsegment, 'MACHINERY'), 'm')"),
    "c_likely": ("likely(c_nationkey > 2)", "c_nationkey > 2"),
    "c_case": ("case c_nationkey % 3 when 0 then 'x' when 1 then 'y' end", "case c_nationkey % 3 when 0 then 'x' when 1 then 'y' end"),
}
_family("j2_conditionals", CONDITIONALS, "customer", ["c_custkey"], lambda spark, sf: shop(spark, sf, "customer"))

NUMBERS = {
    "n_abs": ("abs(p_size - 25)", "abs(p_size - 25)"),
    "n_round": ("round(p_retailprice, 1)", "round(p_retailprice, 1)"),
    "n_floor": ("floor(p_retailprice / 7)", "cast(floor(p_retailprice / 7) as bigint)"),
    "n_ceil": ("ceiling(p_retailprice / 7)", "cast(ceil(p_retailprice / 7) as bigint)"),
    "n_mod": ("mod(p_partkey, 7)", "p_partkey % 7"),
    "n_power": ("power(p_size, 2)", "cast(p_size * p_size as double)"),
    "n_sqrt": ("round(sqrt(p_size), 9)", "round(sqrt(p_size), 9)"),
    "n_cbrt": ("round(cbrt(p_size), 9)", "round(cbrt(p_size), 9)"),
    "n_sign": ("cast(sign(p_size - 25) as int)", "cast(sign(p_size - 25) as int)"),
    "n_trunc": ("truncate(p_retailprice - 950.55D, 0)", "trunc(p_retailprice - 950.55)"),
    "n_exp": ("round(exp(p_size / 50.0D), 9)", "round(exp(p_size / 50.0), 9)"),
    "n_ln": ("round(ln(p_size + 1), 9)", "round(ln(p_size + 1), 9)"),
    "n_log10": ("round(log10(p_size + 1), 9)", "round(log10(p_size + 1), 9)"),
    "n_log2": ("round(log2(p_size + 1), 9)", "round(log2(p_size + 1), 9)"),
    "n_trig": ("round(sin(p_size) + cos(p_size) + atan2(p_size, 3), 9)", "round(sin(p_size) + cos(p_size) + atan2(p_size, 3), 9)"),
    "n_deg": ("round(degrees(p_size) + radians(p_size), 6)", "round(degrees(p_size) + radians(p_size), 6)"),
    "n_div": ("p_partkey div 7", "p_partkey // 7"),
    "n_bucket": ("width_bucket(p_size, 0, 50, 10)", "cast(case when p_size >= 50 then 11 else floor(p_size / 5.0) + 1 end as bigint)"),
    "n_gcd": ("gcd(p_partkey, 36)", "gcd(p_partkey, 36)"),
    "n_lcm": ("lcm(p_size, 6)", "cast(lcm(p_size, 6) as bigint)"),
    "n_bin": ("bin(p_size)", "bin(p_size)"),
    "n_oct": ("oct(p_size)", "case when p_size >= 8 then cast(p_size // 8 as varchar) else '' end || cast(p_size % 8 as varchar)"),
    "n_conv": ("conv(cast(p_size as string), 10, 16)", "printf('%X', p_size)"),
    "n_scale": ("scale(cast(cast(p_size as decimal(10,3)) as string))", "3"),
    "n_pi": ("round(pi() * p_size, 9)", "round(pi() * p_size, 9)"),
}
_family("j3_numbers", NUMBERS, "part", ["p_partkey"], lambda spark, sf: shop(spark, sf, "part"))

D = "cast(o_orderdate as date)"
DATES = {
    "d_year": ("year(o_orderdate)", "cast(year(o_orderdate) as int)"),
    "d_month": ("extract(month from o_orderdate)", "cast(month(o_orderdate) as int)"),
    "d_day": ("dayofmonth(o_orderdate)", "cast(day(o_orderdate) as int)"),
    "d_quarter": ("quarter(o_orderdate)", "cast(quarter(o_orderdate) as int)"),
    "d_doy": ("dayofyear(o_orderdate)", "cast(dayofyear(o_orderdate) as int)"),
    "d_dow": ("dayofweek(o_orderdate)", "cast(dayofweek(o_orderdate) + 1 as int)"),
    "d_weekday": ("weekday(o_orderdate)", "cast(isodow(o_orderdate) - 1 as int)"),
    "d_isoweek": ("weekofyear(o_orderdate)", "cast(weekofyear(o_orderdate) as int)"),
    "d_week": (f"week({D})", "cast(strftime(o_orderdate, '%U') as int)"),
    "d_dayname": ("date_format(o_orderdate, 'EEEE')", "dayname(o_orderdate)"),
    "d_monthname": ("date_format(o_orderdate, 'MMMM')", "monthname(o_orderdate)"),
    "d_format": ("mysql_date_format(cast(o_orderdate as timestamp), '%d/%m/%Y')", "strftime(o_orderdate, '%d/%m/%Y')"),
    "d_strftime": ("strftime('%Y-%m', cast(o_orderdate as timestamp))", "strftime(o_orderdate, '%Y-%m')"),
    "d_add": (f"cast(date_add({D}, 40) as string)", f"cast(cast({D} + 40 as date) as varchar)"),
    "d_sub": (f"cast(subdate({D}, 40) as string)", f"cast(cast({D} - 40 as date) as varchar)"),
    "d_diff": (f"datediff({D}, date'1995-01-01')", f"cast(date_diff('day', date '1995-01-01', {D}) as int)"),
    "d_tsdiff": (f"timestampdiff(MONTH, date'1990-01-01', {D})", f"datesub('month', date '1990-01-01', {D})"),
    "d_last": (f"cast(last_day({D}) as string)", f"cast(last_day({D}) as varchar)"),
    "d_make": ("cast(makedate(year(o_orderdate), 60) as string)", "cast(cast(make_date(year(o_orderdate), 1, 1) + 59 as date) as varchar)"),
    "d_todays": (f"to_days({D})", f"cast(date_diff('day', date '1970-01-01', {D}) + 719528 as int)"),
    "d_fromdays": (f"cast(from_days(to_days({D})) as string)", f"cast({D} as varchar)"),
    "d_trunc": ("date_format(date_trunc('QUARTER', o_orderdate), 'yyyy-MM-dd')", "strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d')"),
    "d_period": ("period_add(year(o_orderdate) * 100 + month(o_orderdate), 5)", "cast(strftime(o_orderdate + interval 5 month, '%Y%m') as int)"),
    "d_pdiff": ("period_diff(year(o_orderdate) * 100 + month(o_orderdate), 199001)", "cast(date_diff('month', date '1990-01-01', o_orderdate) as int)"),
    "d_sectime": ("sec_to_time(o_orderkey)", "printf('%02d:%02d:%02d', o_orderkey // 3600, o_orderkey // 60 % 60, o_orderkey % 60)"),
    "d_timesec": ("time_to_sec(sec_to_time(o_orderkey))", "o_orderkey"),
    "d_parse": ("date_format(str_to_date(date_format(o_orderdate, 'dd/MM/yyyy'), '%d/%m/%Y'), 'yyyyMMdd')", "strftime(o_orderdate, '%Y%m%d')"),
    "d_age": (f"age(date'2024-03-31', {D})", f"(select format('{{}} years {{}} mons {{}} days', m // 12, m % 12, date_diff('day', cast({D} + to_months(cast(m as int)) as date), date '2024-03-31')) from (select datesub('month', {D}, date '2024-03-31') as m) q)"),
}
_family("j4_dates", DATES, "orders", ["o_orderkey"], lambda spark, sf: shop(spark, sf, "orders"))

DOC = """concat('{"id":', user_id, ',"type":"', event_type, '","tags":["a","t', event_id % 5, '"],"deep":{"k":', event_id % 7, '}}')"""
JSONS = {
    "j_extract": ("json_extract(doc, '$.deep.k')", "json_extract_string(doc, '$.deep.k')"),
    "j_value": ("json_value(doc, '$.type')", "json_extract_string(doc, '$.type')"),
    "j_unquote": ("json_unquote(concat('\"', event_type, '\"'))", "event_type"),
    "j_valid": ("json_valid(doc)", "json_valid(doc)"),
    "j_broken": ("json_valid(concat(doc, '{'))", "json_valid(concat(doc, '{'))"),
    "j_length": ("json_length(doc)", "4"),
    "j_tags": ("json_array_length(json_extract(doc, '$.tags'))", "cast(json_array_length(doc, '$.tags') as int)"),
    "j_keys": ("json_keys(doc)", "to_json(json_keys(doc))"),
    "j_typeof": ("json_typeof(json_extract(doc, '$.tags'))", "lower(json_type(doc, '$.tags'))"),
    "j_quote": ("json_quote(event_type)", "to_json(event_type)"),
    "j_contains": ("json_contains(json_extract(doc, '$.tags'), '\"t3\"')", "list_contains(json_extract_string(doc, '$.tags[*]'), 't3')"),
    "j_path": ("json_extract_path_text(doc, 'type')", "json_extract_string(doc, '$.type')"),
    "j_props": ("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"),
    "j_object": ("to_json(named_struct('id', event_id, 'kind', event_type))", "'{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\"}'"),
    "j_array": ("to_json(array(event_id, user_id))", "to_json([event_id, user_id])"),
}


def _events(spark, sf):
    doc = DOC.replace("concat(", "concat(", 1)
    return governed(table(spark, sf, "events").withColumn("doc", F.expr(doc)), "shop", "events", SHOP)


_family("j5_json", JSONS, f"(select *, {DOC} as doc from events) e", ["event_id"], _events)

ARRAYS = {
    "a_len": ("array_length(words, 1)", "cast(len(words) as int)"),
    "a_card": ("cardinality(words)", "cast(len(words) as int)"),
    "a_overlap": ("arrays_overlap(words, array('red', 'small'))", "list_has_any(words, ['red', 'small'])"),
    "a_all": ("array_contains_all(words, array('red'))", "list_has_all(words, ['red'])"),
    "a_pick": ("element_at(words, 1)", "words[1]"),
}
_family(
    "j6_arrays",
    ARRAYS,
    "(select *, string_split(p_name, ' ') as words from part) p",
    ["p_partkey"],
    lambda spark, sf: governed(table(spark, sf, "part").withColumn("words", F.split("p_name", " ")), "shop", "part", SHOP),
)

OPERATORS = {
    "o_add": ("l_linenumber + 2 * 3 - 1", "l_linenumber + 5"),
    "o_div": ("try_divide(10, l_linenumber - 3)", "case when l_linenumber <> 3 then 10 / (l_linenumber - 3) end"),
    "o_mod": ("l_orderkey % 7", "l_orderkey % 7"),
    "o_and": ("l_linenumber & 6", "l_linenumber & 6"),
    "o_or": ("l_linenumber | 8", "l_linenumber | 8"),
    "o_xor": ("l_linenumber ^ 5", "xor(l_linenumber, 5)"),
    "o_not": ("~l_linenumber", "~l_linenumber"),
    "o_shl": ("shiftleft(l_linenumber, 3)", "l_linenumber << 3"),
    "o_shr": ("shiftright(l_linenumber, 1)", "l_linenumber >> 1"),
    "o_cat": ("l_returnflag || l_linestatus", "l_returnflag || l_linestatus"),
    "o_nulleq": ("nullif(l_returnflag, 'A') <=> null", "nullif(l_returnflag, 'A') is not distinct from null"),
    "o_imatch": ("l_returnflag rlike '(?i)^a'", "regexp_matches(l_returnflag, '(?i)^a')"),
}
_LINES = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
_family("j7_operators", OPERATORS, "lineitem", _LINES.split(", "), lambda spark, sf: shop(spark, sf, "lineitem"))

MATCHES = {
    "m_like": ("p_name like '%ring'", "p_name like '%ring'"),
    "m_escape": ("concat(p_brand, '%') like '%5^%' escape '^'", "concat(p_brand, '%') like '%5^%' escape '^'"),
    "m_ilike": ("p_type ilike 'eco%'", "p_type ilike 'eco%'"),
    "m_glob": ("glob('r*d ?i*', p_name)", "p_name glob 'r*d ?i*'"),
    "m_regexp": ("p_name regexp '^(red|small) '", "regexp_matches(p_name, '^(red|small) ')"),
    "m_rlike": ("p_brand rlike '#1[0-9]$'", "regexp_matches(p_brand, '#1[0-9]$')"),
    "m_not": ("p_name not like '%e%'", "p_name not like '%e%'"),
}
_family("j8_patterns", MATCHES, "part", ["p_partkey"], lambda spark, sf: shop(spark, sf, "part"))


# More names of the same families.
STRINGS_MORE = {
    "s_position": ("position('e' in p_name)", "cast(instr(p_name, 'e') as int)"),
    "s_ltrim": ("ltrim(concat('  ', p_name))", "p_name"),
    "s_rtrim": ("rtrim(concat(p_name, '  '))", "p_name"),
    "s_lcase": ("lcase(p_type)", "lower(p_type)"),
    "s_ucase": ("ucase(p_name)", "upper(p_name)"),
    "s_chars": ("char_length(p_name)", "cast(length(p_name) as int)"),
    "s_character": ("character_length(p_brand)", "cast(length(p_brand) as int)"),
    "s_char": ("char(97 + p_size % 26)", "chr(97 + p_size % 26)"),
}
NUMBERS_MORE = {
    "n_tan": ("round(tan(p_size), 6)", "round(tan(p_size), 6)"),
    "n_asin": ("round(asin(p_size / 100D), 6)", "round(asin(p_size / 100.0), 6)"),
    "n_acos": ("round(acos(p_size / 100D), 6)", "round(acos(p_size / 100.0), 6)"),
    "n_atan": ("round(atan(p_size), 6)", "round(atan(p_size), 6)"),
    "n_cot": ("round(cot(p_size), 6)", "round(cot(p_size), 6)"),
    "n_log": ("round(log(p_size), 6)", "round(ln(p_size), 6)"),
    "n_log_base": ("round(log(2, p_size), 6)", "round(ln(p_size) / ln(2), 6)"),
    "n_pow": ("pow(p_size, 2)", "pow(p_size, 2)"),
}
DATES_MORE = {
    "d_hour": ("hour(o_orderdate)", "cast(hour(o_orderdate) as int)"),
    "d_minute": ("minute(o_orderdate)", "cast(minute(o_orderdate) as int)"),
    "d_second": ("second(o_orderdate)", "cast(second(o_orderdate) as int)"),
    "d_sub": ("cast(date_sub(cast(o_orderdate as date), 5) as string)", "cast(cast(o_orderdate as date) - 5 as varchar)"),
    "d_add": ("date_format(timestampadd(DAY, 3, o_orderdate), 'yyyy-MM-dd HH:mm')", "strftime(o_orderdate + interval 3 day, '%Y-%m-%d %H:%M')"),
    "d_part": ("cast(date_part('doy', o_orderdate) as int)", "cast(date_part('doy', o_orderdate) as int)"),
    "d_unix": ("unix_timestamp(cast(o_orderdate as timestamp))", "cast(epoch(o_orderdate) as bigint)"),
    "d_from": ("from_unixtime(o_orderkey * 3600)", "strftime(make_timestamp(o_orderkey * 3600000000), '%Y-%m-%d %H:%M:%S')"),
    "d_to": ("cast(to_date(concat('2024-', lpad(o_orderkey % 12 + 1, 2, '0'), '-07')) as string)", "concat('2024-', lpad(cast(o_orderkey % 12 + 1 as varchar), 2, '0'), '-07')"),
    "d_make": ("date_format(make_timestamp(2024, cast(o_orderkey % 12 + 1 as int), 3, 4, 5, 6), 'yyyy-MM-dd HH:mm:ss')", "strftime(make_timestamp(2024, o_orderkey % 12 + 1, 3, 4, 5, 6), '%Y-%m-%d %H:%M:%S')"),
}
_family("j1_strings_more", STRINGS_MORE, "part", ["p_partkey"], lambda spark, sf: shop(spark, sf, "part"))
_family("j3_numbers_more", NUMBERS_MORE, "part", ["p_partkey"], lambda spark, sf: shop(spark, sf, "part"))
_family("j4_dates_more", DATES_MORE, "orders", ["o_orderkey"], lambda spark, sf: shop(spark, sf, "orders").select("o_orderkey", "o_orderdate"))


# JSON search, layout and builders.
TREE = """concat('{"kind":"', event_type, '","list":["t', event_id % 5, '",{"a b":"', event_type, '"}],"n":', event_id % 7, '}')"""
JSONS_MORE = {
    "j_search_all": ("json_search(doc, 'all', event_type)", """'["$.kind","$.list[1].\\"a b\\""]'"""),
    "j_search_one": ("json_search(doc, 'one', 't_')", """'"$.list[0]"'"""),
    "j_search_none": ("json_search(doc, 'all', 'absent')", "cast(null as varchar)"),
    "j_elements": ("size(json_array_elements(json_extract(doc, '$.list')))", "cast(json_array_length(doc, '$.list') as int)"),
    "j_pretty": (
        "jsonb_pretty(json_extract(doc, '$.list'))",
        """concat('[', chr(10), '    "t', event_id % 5, '",', chr(10), '    {', chr(10), '        "a b": "', event_type, '"', chr(10), '    }', chr(10), ']')""",
    ),
}
_family(
    "j5_json_search",
    JSONS_MORE,
    f"(select *, {TREE} as doc from events) e",
    ["event_id"],
    lambda spark, sf: governed(table(spark, sf, "events").withColumn("doc", F.expr(TREE)).select("event_id", "event_type", "doc"), "shop", "events", SHOP),
)


@query(
    "j5_json_builders",
    """select event_id, to_json({'id': event_id, 'kind': event_type, 'none': null, 'list': [event_id, null]}) as j_object, json_array(event_type, event_id, null) as j_array,
  to_json(event_type) as j_text from events""",
)
def json_builders(spark, sf):
    g = governed(table(spark, sf, "events").select("event_id", "event_type"), "shop", "events", SHOP)
    number, kind, none = F.col("event_id"), F.col("event_type"), F.lit(None).cast("string")
    pairs = [F.lit("id"), number, F.lit("kind"), kind, F.lit("none"), none, F.lit("list"), F.array(number, F.lit(None).cast("bigint"))]
    g = g.with_column("j_object", scalars.json_object(*pairs)).with_column("j_array", scalars.json_array(kind, number, none))
    return g.with_column("j_text", scalars.to_jsonb(kind)).select("event_id", "j_object", "j_array", "j_text").result(names=())


# Names whose value is not fixed are held to their type and range.
DATES_NAMED = {
    "d_tochar": ("pg_to_char(cast(o_orderdate as timestamp), 'DD.MM.YYYY HH24:MI:SS')", "strftime(o_orderdate, '%d.%m.%Y %H:%M:%S')"),
    "d_interval": ("date_format(o_orderdate + make_interval(0, 1, 0, cast(o_orderkey % 9 as int), 3), 'yyyy-MM-dd HH:mm')", "strftime(o_orderdate + interval 1 month + to_days(cast(o_orderkey % 9 as int)) + interval 3 hour, '%Y-%m-%d %H:%M')"),
    "d_justify": ("cast(justify_days(make_interval(0, 0, 0, cast(o_orderkey % 25 + 31 as int))) as string)", "case when o_orderkey % 25 = 24 then '1 months 25 days' else '1 months ' || (o_orderkey % 25 + 1) || ' days' end"),
    "d_justify_hours": ("cast(justify_hours(make_interval(0, 0, 0, 0, cast(o_orderkey % 20 + 25 as int))) as string)", "'1 days ' || (o_orderkey % 20 + 1) || ' hours'"),
    "d_now": ("now() >= cast('2024-01-01' as timestamp) and curdate() = to_date(now())", "true"),
    "d_curtime": ("curtime() rlike '^[0-2][0-9]:[0-5][0-9]:[0-5][0-9]$'", "true"),
}
NUMBERS_NAMED = {
    "n_number": ("to_number(format_number(p_partkey + 1000, 0), '9,999,999,999')", "cast(p_partkey + 1000 as decimal(10, 0))"),
    "n_crc": ("crc32(cast(p_size % 2 as string))", "case p_size % 2 when 0 then 4108050209 else 2212294583 end"),
}
_family("j4_dates_named", DATES_NAMED, "orders", ["o_orderkey"], lambda spark, sf: shop(spark, sf, "orders").select("o_orderkey", "o_orderdate"))
_family("j3_numbers_named", NUMBERS_NAMED, "part", ["p_partkey"], lambda spark, sf: shop(spark, sf, "part").select("p_partkey", "p_size"))
