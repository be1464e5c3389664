from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from maskwright.functions import scalars

# Expression, value: fixed facts of the dialects.
CASES = [
    ("mid('hello', 2, 3)", "ell"), ("strpos('abc', 'c')", 3), ("starts_with('abc', 'ab')", True), ("strcmp('a', 'b')", -1),
    ("unicode('é')", 233), ("hex(zeroblob(3))", "000000"), ("format(1234567.891D, 2)", "1,234,567.89"),
    ("regexp_match('foobar', 'o+')", ["oo"]), ("regexp_match('x', 'o+')", None), ("glob('a*c?', 'abbcd')", True), ("glob('a.c', 'abc')", False),
    ("glob('(a)+', '(a)+')", True), ("xor(true, false)", True), ("xor(true, null)", None),
    ("iif(1 > 2, 'a', 'b')", "b"), ("truncate(-1.567D, 2)", -1.56), ("oct(8)", "10"), ("gcd(48, -18)", 6), ("lcm(4, 6)", 12), ("lcm(0, 6)", 0),
    ("scale('1.250')", 3), ("to_days(date'2024-01-01')", 739251), ("to_seconds(timestamp'2024-01-01 00:00:00')", 63871286400),
    ("cast(makedate(2024, 60) as string)", "2024-02-29"), ("week(date'2024-01-06')", 0), ("yearweek(date'2024-01-06')", 202353), ("yearweek(date'2024-01-07')", 202401),
    ("period_add(202411, 3)", 202502), ("period_add(202401, -1)", 202312), ("period_diff(202502, 202411)", 3), ("sec_to_time(3661)", "01:01:01"), ("time_to_sec('01:01:01')", 3661),
    ("maketime(1, 2, 3)", "01:02:03"), ("cast(addtime(timestamp_ntz'2024-01-01 23:00:00', '02:00:01') as string)", "2024-01-02 01:00:01"),
    ("cast(subtime(timestamp_ntz'2024-01-01 01:00:00', '02:00:00') as string)", "2023-12-31 23:00:00"),
    ("timediff(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-02 01:00:05')", "-25:00:05"),
    ("microsecond(timestamp_ntz'2024-01-01 00:00:00.001234')", 1234), ("isfinite(timestamp'2024-01-01 00:00:00')", True),
    ("datetime(timestamp'2024-01-01 10:00:00')", "2024-01-01 10:00:00"), ("strftime('%Y/%m %H:%M', timestamp'2024-03-05 13:14:15')", "2024/03 13:14"),
    ("mysql_date_format(timestamp'2024-03-05 13:14:15', '%d.%m.%y %H:%i:%s')", "05.03.24 13:14:15"), ("julianday(timestamp'2024-01-01 12:00:00')", 2460311.0),
    ("age(date'2024-03-05', date'2022-01-31')", "2 years 1 mons 5 days"), ("json_extract('{\"a\":{\"b\":1}}', '$.a.b')", "1"), ("json_valid('{}')", True), ("json_valid('{}{')", False),
    ("json_valid('1,2')", False), ("json_valid('')", False), ("json_valid(null)", None), ("json_length('[1,2,3]')", 3), ("json_length('{\"a\":1}')", 1), ("json_length('5')", 1),
    ("json_keys('{\"a\":1,\"b\":2}')", '["a","b"]'), ("json_typeof('[1]')", "array"), ("json_type('1.5')", "DOUBLE"), ("json_type('{}')", "OBJECT"), ("jsonb_typeof('1')", "number"),
    ("json_depth('1')", 1), ("json_depth('[]')", 1), ("json_depth('[1]')", 2), ("json_depth('{\"a\":[]}')", 2), ("json_depth('{\"a\":[{\"b\":\"x[[[\"}]}')", 4),
    ("json_contains_path('{\"a\":{\"b\":1}}', 'one', '$.a.b')", True), ("json_contains_path('{\"a\":1}', 'one', '$.c')", False), ("json_quote('a\"b')", '"a\\"b"'),
    ("json_search('{\"a\":\"x\",\"b\":[\"y\",{\"c d\":\"x\"}]}', 'all', 'x')", '["$.a","$.b[1].\\"c d\\""]'),
    ("json_search('{\"a\":\"x\",\"b\":[\"y\",\"xy\"]}', 'one', 'x%')", '"$.a"'), ("json_search('[1,\"1\",[\"1\"]]', 'all', '1')", '["$[1]","$[2][0]"]'),
    ("json_search('{\"x\":1}', 'all', 'x')", None), ("json_search('\"x\"', 'one', 'x')", '"$"'), ("json_search('[', 'one', 'x')", None), ("json_search('{\"k\":{},\"a,b\":[[],\"q\"]}', 'one', 'q')", '"$.\\"a,b\\"[1]"'),
    ("jsonb_pretty('{\"a\":[1,\"x:  \"],\"b\":{}}')", '{\n    "a": [\n        1,\n        "x:  "\n    ],\n    "b": {\n    }\n}'), ("jsonb_pretty('3')", "3"), ("jsonb_pretty('{')", None),
    ("crc32('123456789')", 3421780262), ("to_number('12,345', '99,999')", Decimal(12345)), ("pg_to_char(timestamp'2024-03-05 13:04:15', 'DD.MM.YYYY HH24:MI:SS')", "05.03.2024 13:04:15"),
    ("pg_to_char(timestamp'2024-03-05 13:04:15', 'DDD Mon YY')", "065 Mar 24"), ("cast(justify_days(make_interval(0, 0, 0, 65)) as string)", "2 months 5 days"), ("cast(justify_hours(make_interval(0, 0, 0, 1, 50)) as string)", "3 days 2 hours"),
    ("random() between 0 and 1", True), ("curtime() rlike '^[0-2][0-9]:[0-5][0-9]:[0-5][0-9]$'", True), ("json_array_elements('[1,\"a\",{\"b\":2}]')", ["1", '"a"', '{"b":2}']),
    ("json_contains('[\"a\",\"b\"]', '\"a\"')", True), ("array_length(array('a', 'b'), 1)", 2), ("array_contains_all(array('a', 'b'), array('a', 'c'))", False),
]


@pytest.fixture(scope="module")
def registered(spark):
    scalars.register(spark)
    return spark


def test_values(registered):
    row = registered.sql("select " + ", ".join(f"{e} as c{i}" for i, (e, _) in enumerate(CASES))).first()
    assert [(e, row[i]) for i, (e, want) in enumerate(CASES) if row[i] != want] == []


def test_functions_are_inlined(registered):
    plan = registered.range(3).selectExpr("strpos(cast(id as string), '1') p")._jdf.queryExecution().optimizedPlan().toString()
    assert "instr" in plan and "strpos" not in plan


def test_json_builders(spark):
    df = spark.sql("select 'a\"b' as s, 1 as n, cast(null as string) as z, array(1, null) as l, named_struct('x', 1, 'y', cast(null as int)) as o")
    c = F.col
    got = df.select(
        scalars.to_jsonb(c("s")), scalars.to_jsonb(c("z")), scalars.to_jsonb(c("o")), scalars.json_array(c("s"), c("n"), c("z"), c("l")), scalars.json_build_array(),
        scalars.json_object(F.lit("k"), c("s"), c("s"), c("z"), F.lit("o"), c("o")), scalars.jsonb_build_object(),
    ).first()
    assert list(got) == ['"a\\"b"', None, '{"x":1,"y":null}', '["a\\"b",1,null,[1,null]]', "[]", '{"k":"a\\"b","a\\"b":null,"o":{"x":1,"y":null}}', "{}"]
    with pytest.raises(ValueError):
        scalars.json_object(F.lit("k"))
    with pytest.raises(PySparkException):
        df.select(scalars.json_object(c("z"), c("n"))).collect()
