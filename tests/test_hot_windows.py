import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from maskwright.operators import hot_windows as hw
from maskwright.operators.hot_windows import RANKS, RUNNING, hot_windows


@pytest.fixture(scope="module")
def rows(spark):
    return (
        spark.range(4000)
        .selectExpr(
            "id",
            "case when id % 3 = 0 then 'hot' when id % 41 = 0 then null else concat('k', id % 5) end k",
            "case when id % 50 = 7 then null else (id * 37 % 211) end v",
            "timestamp_seconds(id * 91 % 7001) t",
            "case when id % 4 = 0 then null else id % 17 end x",
        )
        .cache()
    )


@pytest.mark.parametrize("order", [[("v", False), ("id", False)], [("v", True), ("id", False)], [("t", False)]])
def test_agrees_with_one_task_per_key(rows, order):
    sort = [F.col(c).desc() if d else F.col(c).asc() for c, d in order]
    w = Window.partitionBy("k").orderBy(*sort)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ranks = {f: (f, 6 if f == "ntile" else None) for f in RANKS}
    running = {f"r_{f}": (f, "x") for f in RUNNING}
    wanted = {**ranks, **(running if len(order) > 1 else {})}
    if len(order) == 1:
        # Rows that tie have no fixed number.
        wanted = {f: a for f, a in wanted.items() if f not in ("row_number", "ntile")}
    got = hot_windows(rows, wanted, ["k"], order, hot_rows=100)
    want = rows
    for name, (fn, arg) in wanted.items():
        if fn in RUNNING:
            want = want.withColumn(name, F.call_function(fn, F.col("x")).over(upto))
        elif fn == "ntile":
            want = want.withColumn(name, F.ntile(6).over(w))
        else:
            want = want.withColumn(name, F.call_function(fn).over(w))
    rounded = [F.round(c, 9).alias(c) if c in ("percent_rank", "cume_dist") else F.col(c) for c in want.columns]
    got, want = got.select(*rounded), want.select(*rounded)
    assert got.count() == 4000 and got.exceptAll(want).count() == 0


def test_without_hot_keys(rows):
    got = hot_windows(rows, {"n": ("row_number", None)}, ["k"], [("id", False)], hot_rows=10_000)
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    assert got.exceptAll(want).count() == 0


def test_refused(rows):
    with pytest.raises(ValueError):
        hot_windows(rows, {"n": ("lag", None)}, ["k"], [("id", False)])
    with pytest.raises(ValueError):
        hot_windows(rows, {"n": ("rank", None)}, ["id"], [("k", False)])


def test_segments_follow_the_order_and_rows_carry_no_bounds(rows):
    """A row is no wider for more segments; ties share one; few small ones beyond a handful for each core."""
    hot = rows.where("k = 'hot'")
    cut = hw._segment(hot, hot.count(), ["k"], F.col("v").desc(), 10)
    assert cut.columns == [*hot.columns, "_seg"] and "percentile" not in cut._jdf.queryExecution().executedPlan().toString()
    parts = cut.groupBy("_seg").agg(F.max("v").alias("high"), F.min("v").alias("low"), F.count("*").alias("n")).orderBy("_seg").collect()
    assert 8 <= len(parts) <= 16 and max(p["n"] for p in parts) <= 3 * hot.count() / len(parts)
    assert all(a["low"] > b["high"] for a, b in zip(parts, parts[1:]) if b["high"] is not None and a["low"] is not None)
    assert cut.where("v is null").select("_seg").distinct().first()[0] == parts[-1]["_seg"]
