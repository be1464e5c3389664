"""Scalar functions of other SQL dialects that Spark does not have under their name.

Each is a SQL function whose body is Spark SQL, so Catalyst inlines it into
the plan: no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_MYSQL_PATTERN = "fmt"
for _a, _b in (
    ("%Y", "yyyy"),
    ("%m", "MM"),
    ("%d", "dd"),
    ("%H", "HH"),
    ("%i", "mm"),
    ("%s", "ss"),
    ("%y", "yy"),
    ("%M", "MMMM"),
    ("%b", "MMM"),
    ("%a", "EEE"),
    ("%W", "EEEE"),
    ("%j", "DDD"),
    ("%T", "HH:mm:ss"),
    ("%h", "hh"),
    ("%p", "a"),
):
    _MYSQL_PATTERN = f"replace({_MYSQL_PATTERN}, '{_a}', '{_b}')"
_STRFTIME_PATTERN = "fmt"
for _a, _b in (
    ("%Y", "yyyy"),
    ("%m", "MM"),
    ("%d", "dd"),
    ("%H", "HH"),
    ("%M", "mm"),
    ("%S", "ss"),
    ("%j", "DDD"),
):
    _STRFTIME_PATTERN = f"replace({_STRFTIME_PATTERN}, '{_a}', '{_b}')"

_TO_CHAR_PATTERN = "fmt"
for _a, _b in (
    ("YYYY", "yyyy"),
    ("YY", "yy"),
    ("DDD", "D__"),
    ("DD", "dd"),
    ("D__", "DDD"),
    ("HH24", "HH"),
    ("HH12", "hh"),
    ("MI", "mm"),
    ("SS", "ss"),
    ("Month", "MMMM"),
    ("Mon", "MMM"),
    ("Day", "EEEE"),
    ("Dy", "EEE"),
    ("AM", "a"),
):
    _TO_CHAR_PATTERN = f"replace({_TO_CHAR_PATTERN}, '{_a}', '{_b}')"

# A JSON text as its marks: strings, punctuation, bare words and numbers.
_MARKS = r"""regexp_extract_all(j, '(\"(?:[^\"\\\\]|\\\\.)*\"|[{}\\[\\],:]|[^\\s{}\\[\\],:\"]+)', 1)"""
_TEXT_OF_MARK = "get_json_object(concat('{\"v\":', t, '}'), '$.v')"
_UP = "slice(a.path, 1, greatest(size(a.path) - 1, 0))"
_LAST = "try_element_at(a.path, -1)"
# The walk holds the way to the value at hand: per open container its last key or index, and whether a key comes next.
_FOUND = f"""aggregate({_MARKS},
  struct(cast(array() AS ARRAY<STRING>) AS path, cast(array() AS ARRAY<STRING>) AS kinds, false AS at_key, cast(array() AS ARRAY<STRING>) AS found),
  (a, t) -> CASE
    WHEN t = '{{' THEN struct(array_append(a.path, '') AS path, array_append(a.kinds, 'o') AS kinds, true AS at_key, a.found AS found)
    WHEN t = '[' THEN struct(array_append(a.path, '[0]') AS path, array_append(a.kinds, 'a') AS kinds, false AS at_key, a.found AS found)
    WHEN t IN ('}}', ']') THEN struct({_UP} AS path, slice(a.kinds, 1, greatest(size(a.kinds) - 1, 0)) AS kinds, false AS at_key, a.found AS found)
    WHEN t = ':' THEN struct(a.path AS path, a.kinds AS kinds, false AS at_key, a.found AS found)
    WHEN t = ',' AND try_element_at(a.kinds, -1) = 'o' THEN struct(a.path AS path, a.kinds AS kinds, true AS at_key, a.found AS found)
    WHEN t = ',' THEN struct(array_append({_UP}, concat('[', cast(try_cast(substring({_LAST}, 2, char_length({_LAST}) - 2) AS INT) + 1 AS STRING), ']')) AS path,
      a.kinds AS kinds, false AS at_key, a.found AS found)
    WHEN a.at_key THEN struct(array_append({_UP}, concat('.', if({_TEXT_OF_MARK} RLIKE '^[A-Za-z_][A-Za-z0-9_]*$', {_TEXT_OF_MARK}, t))) AS path,
      a.kinds AS kinds, true AS at_key, a.found AS found)
    WHEN startswith(t, '\"') AND {_TEXT_OF_MARK} LIKE p THEN struct(a.path AS path, a.kinds AS kinds, false AS at_key,
      array_append(a.found, concat('$', array_join(a.path, ''))) AS found)
    ELSE a END,
  a -> a.found)"""

# (name, parameters, result type, body)
FUNCTIONS = [
    # strings
    ("mid", "s STRING, p INT, n INT", "STRING", "substring(s, p, n)"),
    ("strpos", "s STRING, t STRING", "INT", "instr(s, t)"),
    ("starts_with", "s STRING, t STRING", "BOOLEAN", "startswith(s, t)"),
    ("strcmp", "a STRING, b STRING", "INT", "CASE WHEN a < b THEN -1 WHEN a > b THEN 1 WHEN a = b THEN 0 END"),
    ("unicode", "s STRING", "INT", "ascii(s)"),
    ("zeroblob", "n INT", "BINARY", "unhex(repeat('00', n))"),
    ("format", "x DOUBLE, d INT", "STRING", "format_number(x, d)"),
    ("regexp_match", "s STRING, p STRING", "ARRAY<STRING>", "CASE WHEN s RLIKE p THEN array(regexp_extract(s, p, 0)) END"),
    (
        "glob",
        "p STRING, s STRING",
        "BOOLEAN",
        r"s RLIKE concat('(?s)^', replace(replace(regexp_replace(p, '([.+(){}|^$\\\\])', '\\\\$1'), '*', '.*'), '?', '.'), '$')",
    ),
    # conditionals
    ("xor", "a BOOLEAN, b BOOLEAN", "BOOLEAN", "a <> b"),
    ("iif", "c BOOLEAN, a STRING, b STRING", "STRING", "if(c, a, b)"),
    ("likely", "c BOOLEAN", "BOOLEAN", "c"),
    ("unlikely", "c BOOLEAN", "BOOLEAN", "c"),
    ("likelihood", "c BOOLEAN, p DOUBLE", "BOOLEAN", "c"),
    # numbers
    (
        "truncate",
        "x DOUBLE, d INT",
        "DOUBLE",
        "CASE WHEN x < 0 THEN ceil(x * power(10, d)) ELSE floor(x * power(10, d)) END / power(10, d)",
    ),
    ("oct", "n BIGINT", "STRING", "conv(cast(n AS STRING), 10, 8)"),
    (
        "gcd",
        "a BIGINT, b BIGINT",
        "BIGINT",
        "aggregate(sequence(1, 93), struct(abs(a) AS x, abs(b) AS y), (s, i) -> if(s.y = 0, s, struct(s.y AS x, s.x % s.y AS y)), s -> s.x)",
    ),
    (
        "lcm",
        "a BIGINT, b BIGINT",
        "BIGINT",
        "CASE WHEN a = 0 OR b = 0 THEN 0 ELSE abs(a div aggregate(sequence(1, 93), struct(abs(a) AS x, abs(b) AS y), (s, i) -> if(s.y = 0, s, struct(s.y AS x, s.x % s.y AS y)), s -> s.x) * b) END",
    ),
    ("scale", "x STRING", "INT", "char_length(regexp_extract(x, '[.]([0-9]*)$', 1))"),
    # dates
    ("to_days", "d DATE", "INT", "unix_date(d) + 719528"),
    ("from_days", "n INT", "DATE", "date_from_unix_date(n - 719528)"),
    ("to_seconds", "t TIMESTAMP", "BIGINT", "unix_seconds(t) + 719528L * 86400"),
    ("makedate", "y INT, n INT", "DATE", "date_add(make_date(y, 1, 1), n - 1)"),
    ("week", "d DATE", "INT", "cast(floor((dayofyear(d) + 7 - dayofweek(d)) / 7) AS INT)"),
    (
        "yearweek",
        "d DATE",
        "INT",
        "CASE WHEN dayofyear(d) + 7 - dayofweek(d) >= 7 THEN year(d) * 100 + cast(floor((dayofyear(d) + 7 - dayofweek(d)) / 7) AS INT) "
        "ELSE (year(d) - 1) * 100 + cast(floor((dayofyear(make_date(year(d) - 1, 12, 31)) + 7 - dayofweek(make_date(year(d) - 1, 12, 31))) / 7) AS INT) END",
    ),
    ("adddate", "d DATE, n INT", "DATE", "date_add(d, n)"),
    ("subdate", "d DATE, n INT", "DATE", "date_sub(d, n)"),
    ("utc_date", "", "DATE", "to_date(to_utc_timestamp(current_timestamp(), current_timezone()))"),
    ("period_add", "p INT, n INT", "INT", "cast((p div 100 * 12 + p % 100 - 1 + n) div 12 * 100 + (p div 100 * 12 + p % 100 - 1 + n) % 12 + 1 AS INT)"),
    ("period_diff", "a INT, b INT", "INT", "cast((a div 100 * 12 + a % 100) - (b div 100 * 12 + b % 100) AS INT)"),
    ("convert_tz", "t TIMESTAMP_NTZ, a STRING, b STRING", "TIMESTAMP_NTZ", "convert_timezone(a, b, t)"),
    ("sec_to_time", "n BIGINT", "STRING", "format_string('%02d:%02d:%02d', n div 3600, n div 60 % 60, n % 60)"),
    (
        "time_to_sec",
        "t STRING",
        "BIGINT",
        "cast(split(t, ':')[0] AS BIGINT) * 3600 + cast(split(t, ':')[1] AS BIGINT) * 60 + cast(split(t, ':')[2] AS BIGINT)",
    ),
    ("str_to_date", "s STRING, fmt STRING", "TIMESTAMP", f"to_timestamp(s, {_MYSQL_PATTERN})"),
    ("mysql_date_format", "t TIMESTAMP, fmt STRING", "STRING", f"date_format(t, {_MYSQL_PATTERN})"),
    ("strftime", "fmt STRING, t TIMESTAMP", "STRING", f"date_format(t, {_STRFTIME_PATTERN})"),
    ("julianday", "t TIMESTAMP", "DOUBLE", "unix_micros(t) / 86400000000D + 2440587.5D"),
    ("utc_timestamp", "", "TIMESTAMP_NTZ", "convert_timezone('UTC', current_timestamp())"),
    ("sysdate", "", "TIMESTAMP", "current_timestamp()"),
    ("statement_timestamp", "", "TIMESTAMP", "current_timestamp()"),
    ("transaction_timestamp", "", "TIMESTAMP", "current_timestamp()"),
    ("clock_timestamp", "", "TIMESTAMP", "current_timestamp()"),
    ("maketime", "h INT, m INT, s INT", "STRING", "format_string('%02d:%02d:%02d', h, m, s)"),
    (
        "addtime",
        "t TIMESTAMP_NTZ, d STRING",
        "TIMESTAMP_NTZ",
        "timestampadd(SECOND, cast(split(d, ':')[0] AS INT) * 3600 + cast(split(d, ':')[1] AS INT) * 60 + cast(split(d, ':')[2] AS INT), t)",
    ),
    (
        "subtime",
        "t TIMESTAMP_NTZ, d STRING",
        "TIMESTAMP_NTZ",
        "timestampadd(SECOND, -(cast(split(d, ':')[0] AS INT) * 3600 + cast(split(d, ':')[1] AS INT) * 60 + cast(split(d, ':')[2] AS INT)), t)",
    ),
    (
        "timediff",
        "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ",
        "STRING",
        "concat(if(a < b, '-', ''), format_string('%02d:%02d:%02d', abs(timestampdiff(SECOND, b, a)) div 3600, "
        "abs(timestampdiff(SECOND, b, a)) div 60 % 60, abs(timestampdiff(SECOND, b, a)) % 60))",
    ),
    ("microsecond", "t TIMESTAMP_NTZ", "INT", "cast(date_format(t, 'SSSSSS') AS INT)"),
    ("isfinite", "t TIMESTAMP", "BOOLEAN", "CASE WHEN t IS NOT NULL THEN true END"),
    ("datetime", "t TIMESTAMP", "STRING", "date_format(t, 'yyyy-MM-dd HH:mm:ss')"),
    ("unixepoch", "t TIMESTAMP", "BIGINT", "unix_seconds(t)"),
    (
        "age",
        "a DATE, b DATE",
        "STRING",
        "format_string('%d years %d mons %d days', floor(months_between(a, b)) div 12, floor(months_between(a, b)) % 12, "
        "datediff(a, add_months(b, cast(floor(months_between(a, b)) AS INT))))",
    ),
    ("curtime", "", "STRING", "date_format(current_timestamp(), 'HH:mm:ss')"),
    ("pg_to_char", "t TIMESTAMP, fmt STRING", "STRING", f"date_format(t, {_TO_CHAR_PATTERN})"),
    # Thirty days are a month and 24 hours a day; signs follow the interval's.
    (
        "justify_days",
        "i INTERVAL",
        "INTERVAL",
        "make_interval(0, cast(extract(YEAR FROM i) * 12 + extract(MONTH FROM i) + extract(DAY FROM i) div 30 AS INT), 0, cast(extract(DAY FROM i) % 30 AS INT), "
        "cast(extract(HOUR FROM i) AS INT), cast(extract(MINUTE FROM i) AS INT), extract(SECOND FROM i))",
    ),
    (
        "justify_hours",
        "i INTERVAL",
        "INTERVAL",
        "make_interval(cast(extract(YEAR FROM i) AS INT), cast(extract(MONTH FROM i) AS INT), 0, cast(extract(DAY FROM i) + extract(HOUR FROM i) div 24 AS INT), "
        "cast(extract(HOUR FROM i) % 24 AS INT), cast(extract(MINUTE FROM i) AS INT), extract(SECOND FROM i))",
    ),
    # JSON
    ("json_extract", "j STRING, p STRING", "STRING", "get_json_object(j, p)"),
    ("json_value", "j STRING, p STRING", "STRING", "get_json_object(j, p)"),
    ("json_unquote", "j STRING", "STRING", "if(startswith(j, '\"'), get_json_object(concat('{\"v\":', j, '}'), '$.v'), j)"),
    # Inside brackets, so that nothing may follow the value.
    (
        "json_valid",
        "j STRING",
        "BOOLEAN",
        "CASE WHEN j IS NOT NULL THEN try_parse_json(concat('[', j, ']')) IS NOT NULL AND coalesce(json_array_length(concat('[', j, ']')), 0) = 1 END",
    ),
    (
        "json_length",
        "j STRING",
        "INT",
        "CASE WHEN try_parse_json(j) IS NULL THEN NULL WHEN json_array_length(j) IS NOT NULL THEN json_array_length(j) "
        "WHEN json_object_keys(j) IS NOT NULL THEN size(json_object_keys(j)) ELSE 1 END",
    ),
    ("json_keys", "j STRING", "STRING", "to_json(json_object_keys(j))"),
    (
        "json_typeof",
        "j STRING",
        "STRING",
        "CASE WHEN try_parse_json(j) IS NULL THEN NULL WHEN ltrim(j) LIKE '{%' THEN 'object' WHEN ltrim(j) LIKE '[%' THEN 'array' "
        "WHEN ltrim(j) LIKE '\"%' THEN 'string' WHEN trim(j) IN ('true', 'false') THEN 'boolean' WHEN trim(j) = 'null' THEN 'null' ELSE 'number' END",
    ),
    (
        "json_type",
        "j STRING",
        "STRING",
        "CASE WHEN try_parse_json(j) IS NULL THEN NULL WHEN ltrim(j) LIKE '{%' THEN 'OBJECT' WHEN ltrim(j) LIKE '[%' THEN 'ARRAY' "
        "WHEN ltrim(j) LIKE '\"%' THEN 'STRING' WHEN trim(j) IN ('true', 'false') THEN 'BOOLEAN' WHEN trim(j) = 'null' THEN 'NULL' "
        "WHEN trim(j) RLIKE '[.eE]' THEN 'DOUBLE' ELSE 'INTEGER' END",
    ),
    ("json_contains_path", "j STRING, mode STRING, p STRING", "BOOLEAN", "CASE WHEN j IS NOT NULL THEN try_variant_get(parse_json(j), p, 'variant') IS NOT NULL END"),
    # A string is one mark, a number one or more; what a bracket holds is one level deeper.
    (
        "json_depth",
        "j STRING",
        "INT",
        r"CASE WHEN try_parse_json(j) IS NOT NULL THEN aggregate(split(regexp_replace(regexp_replace(j, '\"(?:[^\"\\\\]|\\\\.)*\"', 's'), '[\\s,:]', ''), ''), "
        "struct(0 AS d, 0 AS m), (a, c) -> CASE WHEN c IN ('{', '[') THEN struct(a.d + 1 AS d, greatest(a.m, a.d + 1) AS m) "
        "WHEN c IN ('}', ']') THEN struct(a.d - 1 AS d, a.m AS m) ELSE struct(a.d AS d, greatest(a.m, a.d + 1) AS m) END, a -> a.m) END",
    ),
    (
        "jsonb_typeof",
        "j STRING",
        "STRING",
        "CASE WHEN try_parse_json(j) IS NULL THEN NULL WHEN ltrim(j) LIKE '{%' THEN 'object' WHEN ltrim(j) LIKE '[%' THEN 'array' "
        "WHEN ltrim(j) LIKE '\"%' THEN 'string' WHEN trim(j) IN ('true', 'false') THEN 'boolean' WHEN trim(j) = 'null' THEN 'null' ELSE 'number' END",
    ),
    ("json_extract_path", "j STRING, k STRING", "STRING", "get_json_object(j, concat('$.', k))"),
    ("jsonb_extract_path", "j STRING, k STRING", "STRING", "get_json_object(j, concat('$.', k))"),
    ("jsonb_extract_path_text", "j STRING, k STRING", "STRING", "get_json_object(j, concat('$.', k))"),
    ("json_quote", "s STRING", "STRING", "substring(to_json(array(s)), 2, char_length(to_json(array(s))) - 2)"),
    ("json_contains", "j STRING, v STRING", "BOOLEAN", "array_contains(from_json(j, 'array<string>'), if(startswith(v, '\"'), get_json_object(concat('{\"v\":', v, '}'), '$.v'), v))"),
    ("json_extract_path_text", "j STRING, k STRING", "STRING", "get_json_object(j, concat('$.', k))"),
    ("jsonb_array_length", "j STRING", "INT", "json_array_length(j)"),
    # The paths of string values that match a LIKE pattern: the first one, or all (one text, or a list of them).
    (
        "json_search",
        "j STRING, mode STRING, p STRING",
        "STRING",
        f"CASE WHEN try_parse_json(j) IS NOT NULL THEN transform(array({_FOUND}), f -> CASE WHEN size(f) = 0 THEN NULL "
        "WHEN lower(mode) = 'one' OR size(f) = 1 THEN substring(to_json(slice(f, 1, 1)), 2, char_length(to_json(slice(f, 1, 1))) - 2) ELSE to_json(f) END)[0] END",
    ),
    ("json_array_elements", "j STRING", "ARRAY<STRING>", "transform(from_json(j, 'array<variant>'), v -> to_json(v))"),
    # One line per value, four blanks per level; keys stay in the order of the text. Work grows with the square of a cell's marks.
    (
        "jsonb_pretty",
        "j STRING",
        "STRING",
        f"CASE WHEN try_parse_json(j) IS NOT NULL THEN aggregate({_MARKS}, struct('' AS s, 0 AS d), "
        "(a, t) -> CASE WHEN t IN ('{', '[') THEN struct(concat(a.s, t, '\\n', repeat(' ', 4 * (a.d + 1))) AS s, a.d + 1 AS d) "
        "WHEN t IN ('}', ']') THEN struct(concat(rtrim(' ', a.s), if(endswith(rtrim(' ', a.s), '\\n'), '', '\\n'), repeat(' ', 4 * (a.d - 1)), t) AS s, a.d - 1 AS d) "
        "WHEN t = ',' THEN struct(concat(a.s, ',\\n', repeat(' ', 4 * a.d)) AS s, a.d AS d) "
        "WHEN t = ':' THEN struct(concat(a.s, ': ') AS s, a.d AS d) ELSE struct(concat(a.s, t) AS s, a.d AS d) END, a -> a.s) END",
    ),
    # arrays
    ("array_length", "a ARRAY<STRING>, dim INT", "INT", "if(dim = 1 AND size(a) > 0, size(a), NULL)"),
    ("array_contains_all", "a ARRAY<STRING>, b ARRAY<STRING>", "BOOLEAN", "forall(b, x -> array_contains(a, x))"),
]


def register(spark: SparkSession) -> None:
    """Make the functions known to the session, for expressions and SQL alike."""
    if spark.catalog.functionExists(FUNCTIONS[-1][0]):
        return
    for name, params, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")


# Functions of any number of arguments, as column expressions.


def field(value: Column, *choices) -> Column:
    """The place of value among the choices, 0 when it is none of them."""
    return F.coalesce(F.array_position(F.array(*[F.lit(c) for c in choices]), value), F.lit(0)).cast("int")


def num_nulls(*cols: Column) -> Column:
    total = F.lit(0)
    for c in cols:
        total = total + c.isNull().cast("int")
    return total


def num_nonnulls(*cols: Column) -> Column:
    return F.lit(len(cols)) - num_nulls(*cols)


def to_jsonb(value: Column) -> Column:
    """A value of any type as compact JSON text; null is null."""
    inside = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.when(value.isNotNull(), F.substring(inside, F.lit(2), F.char_length(inside) - 2))


def json_build_array(*values: Column) -> Column:
    """A JSON array of values of any types; nulls stay as null."""
    return F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(to_jsonb(v), F.lit("null")) for v in values]), F.lit("]"))


def json_build_object(*pairs: Column) -> Column:
    """A JSON object of keys and values in turn; a null key is an error, a null value stays as null."""
    if len(pairs) % 2:
        raise ValueError("json_build_object: want a value for every key")
    items = []
    for key, value in zip(pairs[::2], pairs[1::2]):
        name = F.when(key.isNull(), F.raise_error(F.lit("a JSON object has no null key")).cast("string")).otherwise(to_jsonb(key.cast("string")))
        items.append(F.concat(name, F.lit(":"), F.coalesce(to_jsonb(value), F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *items), F.lit("}"))


# The names that other dialects give to the same builders.
json_array = jsonb_build_array = json_build_array
json_object = jsonb_build_object = json_build_object
