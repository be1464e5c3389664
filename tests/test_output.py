import pytest
from pyspark.sql import functions as F

from maskwright.functions.render import cap_chars, escape
from maskwright.operators import output as O
from maskwright.operators.output import Limits
from maskwright.sources.sinks import export_capped


def exported(spark, df, path, limits=Limits(), **kw):
    export_capped(df, str(path), limits, **kw)
    return [r["value"] for r in spark.read.text(str(path)).collect()]


def test_values(spark):
    df = spark.sql(
        """select cast(null as string) a, unhex('0001') b, timestamp_ntz'2026-10-07 14:03:00' c, cast(1.50 as decimal(5,2)) d, double('NaN') e,
        double('-Infinity') f, true g, 9223372036854775807 h, 2.5D i, 73.0D j, 12345678.25D k, date'2026-10-07' l, array(1, 2) m, 1e20D n"""
    )
    row = O.render_cells(df).first()
    assert tuple(row) == (
        "NULL", "<bytes:2>", "2026-10-07T14:03:00", "1.50", "NaN", "-Infinity", "true", "9223372036854775807", "2.5", "73", "12345678.25", "2026-10-07", "[1,2]", "1.0E20",
    )
    zoned = spark.sql("select timestamp'2026-10-07 14:03:00Z' t")
    assert O.render_cells(zoned).first()[0] == "2026-10-07T14:03:00Z"


def test_escapes(spark):
    text = "x\ty\nz\r\\ \x1b[31m ‮ \x7f é 😀"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(escape(F.col("t"))).collect()
    assert got[0][0] == "x\\ty\\nz\\r\\\\ \\x1b[31m \\u202e \\x7f é 😀" and got[1][0] is None
    bad = spark.sql("select cast(unhex('6f6bfffe656e64') as string) t").select(escape(F.col("t"))).first()[0]
    assert bad == "ok��end"


def test_cell_cut(spark):
    cut = lambda t: spark.createDataFrame([(t,)], "t string").select(cap_chars(F.col("t"), 200)).first()[0]
    assert cut("x" * 500) == "x" * 199 + "…" and cut("é" * 300) == "é" * 199 + "…" and cut("y" * 200) == "y" * 200


def test_rows_and_order(spark):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("a"))
    got = O.cap_rows(df, 3, ["a"]).collect()
    assert [(r["a"], r["row_no"], r["truncated"]) for r in got] == [(0, 1, True), (1, 2, True), (2, 3, True)]
    assert {r["truncated"] for r in O.cap_rows(spark.range(3), 3).collect()} == {False}


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "sent"), (2, "failed")], "id int, status string")
    assert exported(spark, df, tmp_path / "a", order=["id"]) == ["id\tstatus", "1\tsent", "2\tfailed", "(2 rows)"]
    wide = spark.range(1000).select(F.lit("y" * 150).alias("a"))
    lines = exported(spark, wide, tmp_path / "b", Limits(max_output_bytes=2000))
    assert "[output cut at 2000 bytes: 13 of 200 rows shown]" in lines and len(lines) == 1 + 13 + 2
    assert lines[-1] == "(13 rows) — more rows exist beyond the row cap"
    lines = exported(spark, spark.range(3).toDF("a"), tmp_path / "c", Limits(max_rows=2), order=["a"])
    assert lines == ["a", "0", "1", "(2 rows) — more rows exist beyond the row cap"]
    assert exported(spark, spark.range(0).toDF("a"), tmp_path / "d") == ["a", "(0 rows)"]
    rows = exported(spark, spark.createDataFrame([("a\nb", None, "z" * 300)], "s string, n string, l string"), tmp_path / "e", fmt="json")
    assert rows == ['{"s":"a\\nb","n":null,"l":"' + "z" * 199 + '…"}']
    with pytest.raises(ValueError):
        export_capped(df, str(tmp_path / "f"), fmt="csv")


def test_cut_note(spark):
    df = spark.createDataFrame([("x" * 300, "y" * 300), ("a", "b")], "a string, b string")
    note = O.cut_note(O.cap_cell_chars(df, 200), 200).first()
    assert note["cut_cells"] == 2 and note["note"].startswith("[2 cells shown in part")
    one = O.cut_note(O.cap_cell_chars(df.select("a"), 200), 200).first()
    assert one["note"].startswith("[1 cell shown in part")
    assert O.cut_note(O.cap_cell_chars(df.limit(0), 200), 200).first()["note"] is None


def test_limits():
    p = Limits.production()
    assert (p.k_anonymity, p.explain_rows_warn, p.explain_rows_refuse, p.max_rows) == (10, 20_000, 200_000, 200)
    assert Limits().k_anonymity == 5


def test_a_line_over_the_byte_cap_is_told(spark, tmp_path):
    from maskwright.sources.sinks import export_capped

    wide = spark.range(3).select(*[F.lit("x" * 200).alias(f"c{i}") for i in range(400)])
    export_capped(wide, str(tmp_path / "out"), Limits())
    lines = [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 3 and "0 of 3 rows" in lines[1] and lines[2].startswith("(0 rows)")
