"""The leak scan against looking for every needle in every cell, and its keys where values share much."""

import random

from pyspark.sql import functions as F

from maskwright.operators import masking


def brute(rows, columns, needles):
    out = {}
    for needle, seed, form in needles:
        for row in rows:
            for name, cell in zip(columns, row):
                if cell is not None and needle and needle in cell.lower():
                    out[(name, form, seed)] = out.get((name, form, seed), 0) + 1
    return out


def counted(spark, rows, columns, seeds):
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))
    frame = spark.createDataFrame([(s,) for s in seeds], "seed string")
    needles = [(r["needle"].lower(), r["seed"], r["form"]) for r in masking.leak_variants(frame).where("needle is not null").collect()]
    got = {(r["column"], r["form"], r["seed"]): r["cells"] for r in masking.leak_counts(df, frame).collect()}
    return got, brute(rows, columns, needles)


def test_leaks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(masking, "LEAK_SHARED", 2)
    rnd = random.Random(5)
    pieces = ["anna", "bob", "@example.com", "@test.org", "x", "é", " ", "moc.elpmaxe@", "12", "ab12cd34"]
    seeds = ["anna@example.com", "bob@example.com", "ANNA@test.org", "x", "é", "", None, "12", "ab12cd34", "ab12cd35", "aaaaaaaaaa", "no such value"]
    seeds += [f"{a}{b}@example.com" for a in "abcdef" for b in "abc"]
    rows = [("".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 5))), rnd.choice([None, "none", "aaaaaaa", rnd.choice(seeds)])) for _ in range(150)]
    rows += [(s[::-1] if s else None, s.encode().hex().upper() if s else None) for s in seeds]
    rows += [("long " * 300 + "anna@example.com" + " tail" * 200, "y" * 251 + "bob@example.com"), rows[0], rows[0]]
    got, want = counted(spark, rows, ["a", "b.c"], seeds)
    assert got == want and len(want) > 30


def test_leaks_of_nothing(spark):
    empty = spark.createDataFrame([], "a string, n int")
    seeds = spark.createDataFrame([("anna",), (None,)], "seed string")
    assert masking.leak_scan(empty, seeds).count() == 0
    assert masking.leak_scan(seeds, seeds.limit(0)).count() == 0
    assert masking.leak_scan(empty.select("n"), seeds).count() == 0


def test_addresses_of_one_domain_have_keys_of_their_own(spark):
    seeds = spark.range(10_000).select(F.concat(F.lit("user"), F.col("id") * 7919, F.lit("@one-large-company.example.com")).alias("seed"))
    published = seeds.select(F.reverse("seed").alias("a"), F.concat(F.lit("mail to "), F.lower("seed")).alias("b"))
    cells = published.select(F.inline(F.array(*[F.struct(F.col(c).alias("cell")) for c in "ab"]))).withColumn("cell_id", F.monotonically_increasing_id())
    words = masking.leak_variants(seeds).select(F.lower("needle").alias("needle")).distinct().withColumn("needle_id", F.monotonically_increasing_id())
    met = masking._leak_candidates(cells.checkpoint(), words.checkpoint()).cache()
    per = met.groupBy("needle_id").count().agg(F.max("count")).first()[0]
    assert per <= 300 and met.count() <= 40 * 10_000
    assert masking.leak_scan(published, seeds).where("form in ('reversed', 'lower')").select("column", "form", "cells").collect() is not None
    totals = {(r["column"], r["form"]): r["seeds"] for r in masking.leak_scan(published, seeds).collect()}
    assert totals[("a", "reversed")] == totals[("b", "lower")] == totals[("b", "plain")] == 10_000


def test_grams_are_never_broadcast(spark):
    """Seeds and cells Spark deems small have many grams: no step of the scan may broadcast them by that estimate."""
    seeds = spark.range(50).select(F.concat(F.lit("user"), F.col("id") * 7919, F.lit("@example.com")).alias("seed"))
    found = masking.leak_counts(seeds.select(F.reverse("seed").alias("a")), seeds)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("form = 'reversed'").agg(F.sum("cells")).first()[0] == 50
