import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions import masks
from maskwright.operators.masking import leak_hits, leak_scan, mask_by_label, mask_table, numeric_columns_hit, redact_errors
from maskwright.operators.rules import RuleSet
from maskwright.sources.sinks import publish_masked


def one(spark, value, ddl, fn):
    return spark.createDataFrame([(value,)], f"v {ddl}").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "mode, value, ddl, want",
    [
        ("redact", "alice@example.com", "string", "<redacted>"),
        ("redact", bytearray(b"abc"), "binary", "<redacted>"),
        ("partial", "alice@example.com", "string", "a***(17)"),
        ("email", "alice@example.com", "string", "a***@example.com"),
        ("email", "not an address", "string", "n***(14)"),
        ("partial", bytearray(b"abc"), "binary", "<masked bytes:3>"),
        ("email", bytearray(b"abc"), "binary", "<masked bytes:3>"),
        ("partial", 12345, "int", "1***(5)"),
        ("partial", "", "string", "***(0)"),
        ("partial", None, "string", None),
        ("redact", None, "binary", None),
    ],
)
def test_modes(spark, mode, value, ddl, want):
    dtype = T.StructType.fromDDL(f"v {ddl}")["v"].dataType
    assert one(spark, value, ddl, lambda c: masks.mask_value(c, mode, dtype)) == want


def test_unknown_mode():
    with pytest.raises(ValueError):
        masks.mask_value(None, "hash")


def test_mask_table_by_rule_then_detectors(spark):
    rules = RuleSet.of({"app.users.email": "redact", "*.*.name": "redact"}, allow=["app.t.name"])
    df = spark.createDataFrame([("jean@ex.be", "mail me at jean@ex.be", bytearray(b"abc"), 5), (None, None, None, None)], "email string, note string, name binary, n int")
    rows = mask_table(df, "app", "users", rules, ("email",)).collect()
    assert tuple(rows[0]) == ("<redacted>", "mail me at j***(10)", "<redacted>", 5)
    assert tuple(rows[1]) == (None, None, None, None)
    kept = mask_table(spark.createDataFrame([("Template A",)], "name string"), "app", "t", rules).first()
    assert kept["name"] == "Template A"


def test_numbers_become_text_only_where_hit(spark):
    df = spark.createDataFrame([(1, 4111111111111111, 2.5), (2, 7, 3.0)], "id int, ref bigint, x double")
    hit = numeric_columns_hit(df)
    assert hit == ("ref",)
    out = mask_table(df, "a", "t", RuleSet(), numbers=hit)
    assert dict(out.dtypes) == {"id": "int", "ref": "string", "x": "double"}
    assert [r["ref"] for r in out.orderBy("id").collect()] == ["4***(16)", "7"]


def test_by_label(spark):
    rules = RuleSet.of({"app.users.email": "redact"})
    row = mask_by_label(spark.createDataFrame([("x@y.zz", "1")], "EMAIL string, id string"), rules, ()).first()
    assert tuple(row) == ("<redacted>", "1")


def test_nested_leaves(spark):
    schema = "s struct<a:string,b:array<string>,n:int>, m map<string,string>"
    df = spark.createDataFrame([((("x a@b.cd", ["c@d.ef", None], 1)), {"a@b.cd": "v", "z": None}), (None, None)], schema)
    types = {f.name: f.dataType for f in df.schema.fields}
    got = df.select(*[masks.mask_nested(F.col(c), types[c], ("email",)).alias(c) for c in df.columns]).collect()
    assert got[0]["s"].asDict(True) == {"a": "x a***(6)", "b": ["c***(6)", None], "n": 1}
    assert sorted((e["key"], e["value"]) for e in got[0]["m"] if e["value"]) == [("a***(6)", "v")]
    assert got[1]["s"] is None and got[1]["m"] is None


def test_cap_text(spark):
    cap = lambda t, n: one(spark, t, "string", lambda c: masks.cap_text(c, n))
    assert cap("x" * 10, 10) == "x" * 10
    assert cap("é" * 10, 10) == "é" * 3 + "…"
    assert cap("#" * 20, 10) == "#" * 7 + "…"
    # The cut retreats over what may be half a value, no further than 64 characters.
    assert cap("§ mail bob@exam" + "ple.com" * 9, 20) == "§…"
    assert cap("a" * 200, 103) == "a" * 36 + "…"
    assert cap("line one\nline two is long", 12) == "line one\n…"
    assert cap(None, 5) is None


def test_cap_cells_counts(spark):
    df = spark.createDataFrame([("x" * 50, bytearray(b"y" * 50), 1), (None, None, 2)], "t string, b binary, i int")
    rows = masks.cap_cells(df, 20).orderBy("i").collect()
    assert rows[0]["cut_cells"] == 2 and len(rows[0]["b"]) == 20
    assert rows[1]["cut_cells"] == 0


# Message, statement, what must be gone, what must stay.
ERRORS = [
    ('ERROR 22P02: invalid input syntax for type integer: "Smith"', "SELECT id FROM users WHERE last_name::int = 0", "Smith", "22P02"),
    ("error 1772: Malformed GTID set specification 'Smith'.", "SELECT GTID_SUBSET(last_name, '')", "Smith", "1772"),
    ("XPATH syntax error: '~alice@example.com'", "SELECT EXTRACTVALUE(1, CONCAT(0x7e, email))", "alice", "XPATH syntax error"),
    ('invalid input syntax for type integer: ""Smith""', "SELECT ('\"' || last_name || '\"')::int", "Smith", "invalid"),
    ("Truncated incorrect DOUBLE value: 'O'Brien'", "SELECT last_name + 0", "Brien", "DOUBLE"),
    ("bad value 'Smith", "SELECT 1", "Smith", "bad value"),
    ('syntax error at or near "FROMM"', "SELECT id FROMM users", "", '"FROMM"'),
    ('column "emial" does not exist', "SELECT EMIAL FROM users", "", '"emial"'),
    ("Unknown column 'emial' in 'where clause'", "SELECT id FROM users WHERE emial = 1", "", "'emial' in 'where clause'"),
    ("near 'FROMM users LIMIT 1' at line 1", "SELECT id FROMM users LIMIT 1", "", "'FROMM users LIMIT 1'"),
    ("bad thing alice@example.com here", "SELECT 1", "alice@example.com", "bad thing"),
]


def test_error_messages(spark):
    df = spark.createDataFrame([(m, s) for m, s, _, _ in ERRORS], "error string, sql string")
    got = {(r["sql"], i): r["error"] for i, r in enumerate(redact_errors(df, names=("email",)).collect())}
    for (m, s, leak, keep), out in zip(ERRORS, got.values()):
        assert keep in out and (not leak or leak not in out), (m, out)


def test_leak_scan(spark, tmp_path):
    seeds = spark.createDataFrame([("Alice.Canary@x.org",), ("S3cretValue",)], "seed string")
    clean = spark.createDataFrame([("alice.canary@x.org wrote", 1), ("nothing", 2)], "note string, id int")
    publish_masked(clean, "a", "t", RuleSet(), str(tmp_path / "out"))
    assert leak_scan(spark.read.parquet(str(tmp_path / "out")), seeds).count() == 0
    dirty = spark.createDataFrame([("euLAVTERc3s!", "533363726574" + "56616c7565"), ("UzNjcmV0VmFsdWU=", "x S3CRETVALUE")], "a string, b string")
    got = {(r["column"], r["form"]) for r in leak_scan(dirty, seeds).collect()}
    assert got == {("a", "reversed"), ("b", "hex"), ("a", "base64"), ("b", "plain"), ("b", "lower")}


def test_leaks_of_short_long_and_repeated_values(spark):
    seeds = spark.createDataFrame([(f"seed-value-{i:03d}",) for i in range(40)] + [("ab",), ("",), (None,), ("ééé" * 9,)], "seed string")
    cells = [f"x seed-value-{i:03d} y" for i in range(0, 60, 3)] + ["x AB\ny", "x AB\ny", None, "", "é" * 30, "seed-value-0000"]
    got = [(r["seed"], r["form"]) for r in leak_hits(spark.createDataFrame([(c,) for c in cells], "t string"), seeds).collect() if r["form"] == "plain"]
    want = [(s, "plain") for c in cells if c for s in [f"seed-value-{i:03d}" for i in range(40)] + ["ab", "ééé" * 9] if s in c.lower()]
    assert sorted(got) == sorted(want)


