"""Rules as a table: the same as testing every rule, and plans that stay small with many of both."""

import random
from itertools import product

from pyspark.sql import functions as F

from maskwright.operators import rule_index
from maskwright.operators import rules as R

NAMES = ["", "a", "b", "ab", "ba", "aa", "é", "aé", "éb", "abé", "ABA"]
SEGMENTS = ["*", "a", "*a", "a*", "*a*", "ab", "*ab", "ab*", "*ab*", "É*", "*é*", "b", "aba", "*bab*", "*aba*"]


def ruleset(rnd, n):
    return {(rnd.choice(["mask", "allow"]), ".".join(rnd.choice(SEGMENTS) for _ in range(3))) for _ in range(n)}


def pieces(rnd, n):
    return R.RuleSet(tuple(R.Rule(k, p, rnd.choice(["redact", "partial"]) if k == "mask" else "redact") for k, p in sorted(ruleset(rnd, n))))


def test_rules_as_a_table_match_like_single_ones(spark):
    rnd = random.Random(3)
    rules = pieces(rnd, 60)
    names = [(rnd.choice(NAMES), rnd.choice(NAMES), rnd.choice(NAMES)) for _ in range(120)] + [(None, "a", "b"), ("a", "b", None), ("a", "b", "ab"), ("a", "b", "ab")]
    inventory = spark.createDataFrame(names, "db string, table string, column string")
    whole = [n for n in names if None not in n]
    want = sorted((*n, r.kind, r.pattern, r.mode) for n in whole for r in rules.rules if r.matches(*n))
    for given in (rules, rules.frame(spark)):
        assert sorted(tuple(r) for r in R.match_rules(inventory, given).collect()) == want
    got = sorted(R.resolve_modes(inventory, rules).collect(), key=str)
    assert len(got) == len(names)
    for r in got:
        if None not in (r["db"], r["table"], r["column"]):
            n = (r["db"], r["table"], r["column"])
            assert (r["mode"], r["allowed"], r["covered"]) == (rules.mode(*n), rules.allowed(*n), any(x.matches(*n) for x in rules.rules)), n
        else:
            assert (r["mode"], r["allowed"], r["covered"]) == (None, False, False)
    by_name = {r["column"]: r["mode"] for r in R.match_by_name(inventory.select("column").distinct(), rules).collect()}
    assert by_name == {c: None if c is None else rules.mode_by_name(c) for c in {n[2] for n in names}}
    few = R.RuleSet(tuple(x for x in rules.rules if not x.pattern.startswith("*")))
    assert {c: few.mode_by_name(c) for c in NAMES} == {r["column"]: r["mode"] for r in R.match_by_name(spark.createDataFrame([(c,) for c in NAMES], "column string"), few).collect()}
    dead = {(r["kind"], r["pattern"]) for r in R.unmatched(inventory, rules).collect()}
    assert dead == {(x.kind, x.pattern) for x in rules.rules if not any(x.matches(*n) for n in whole)}


def test_no_rules_and_no_columns(spark):
    inventory = spark.createDataFrame([("a", "b", "c")], "db string, table string, column string")
    assert [tuple(r) for r in R.resolve_modes(inventory, R.RuleSet()).collect()] == [("a", "b", "c", None, False, False)]
    assert R.match_by_name(inventory.select("column"), R.RuleSet()).first()["mode"] is None
    assert R.match_rules(inventory.limit(0), R.RuleSet.of(["*.*.*"])).count() == 0
    odd = spark.createDataFrame([("mask", "a.b", "redact"), ("mask", None, None), ("mask", "*.*.c", None)], R.RULE_SCHEMA)
    assert [r["pattern"] for r in R.match_rules(inventory, odd).collect()] == ["*.*.c"]


def test_overlap_against_names(spark):
    """Two patterns overlap if some short name fits both in each segment."""
    names = ["".join(p) for n in range(1, 8) for p in product("ab", repeat=n)]
    segments = ["*", "a", "b", "ab", "a*", "*b", "*a*", "ab*", "*ab", "*ba*", "aba"]
    fits = {s: {n for n in names if R._seg_match(s, n)} for s in segments}
    rnd = random.Random(4)
    left = sorted({".".join(rnd.choice(segments) for _ in range(3)) for _ in range(160)})
    right = sorted({".".join(rnd.choice(segments) for _ in range(3)) for _ in range(90)})
    want = {(a, b) for a in left for b in right if all(fits[x] & fits[y] for x, y in zip(a.split("."), b.split(".")))}
    patterns = spark.createDataFrame([(p, i, "x") for i, p in enumerate(left + left[:3])], "pattern string, id int, a string")
    got = R.overlapping_rules(patterns, R.RuleSet.of(right)).collect()
    assert {(r["pattern"], r["mandatory"]) for r in got} == want and len(want) > 500
    assert len(got) == len(want) + sum(1 for p in left[:3] for a, _ in want if a == p)


def test_many_rules_and_columns_meet_by_equality(spark):
    column = F.concat(F.lit("col_"), (F.col("id") % 20011).cast("string"), F.lit("_"), F.element_at(F.array(*map(F.lit, ["id", "name", "mail"])), (F.col("id") % 3 + 1).cast("int")))
    inventory = spark.range(1_000_000).select(F.concat(F.lit("db"), F.col("id") % 7).alias("db"), F.concat(F.lit("t"), F.col("id") % 503).alias("table"), column.alias("column"))
    i = F.col("id")
    pattern = (
        F.when(i % 4 == 0, F.concat(F.lit("db1.t"), i % 503, F.lit(".col_"), i, F.lit("*")))
        .when(i % 4 == 1, F.concat(F.lit("*.t"), i % 503, F.lit(".*_"), i, F.lit("_name")))
        .when(i % 4 == 2, F.concat(F.lit("*.*.*l_"), i, F.lit("_*")))
        .otherwise(F.concat(F.lit("db2.*.col_"), i, F.lit("_id")))
    )
    rules = spark.range(20_000).select(F.lit("mask").alias("kind"), pattern.alias("pattern"), F.lit("redact").alias("mode"))
    found = R.match_rules(inventory, rules)
    text = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text and "col_19999" not in text
    # Run on a part of the columns, all rules.
    some = inventory.where("db = 'db2'").limit(60_000)
    every = {r["pattern"]: r["count"] for r in R.match_rules(some, rules).groupBy("pattern").count().collect()}
    assert len(every) > 5_000
    for r, like in (("*.*.*l_2_*", "column like '%l\\_2\\_%'"), ("db2.*.col_3_id", "db = 'db2' and column = 'col_3_id'")):
        assert every.get(r, 0) == some.where(like).count()


def test_many_patterns_overlap_without_all_pairs(spark):
    i = F.col("id")
    left = spark.range(20_000).select(F.concat(F.lit("*.*.col"), i, F.when(i % 2 == 0, "_x").otherwise("*")).alias("pattern"))
    right = spark.range(20_000).select(F.lit("mask").alias("kind"), F.concat(F.lit("db.t"), i % 100, F.lit(".col"), i, F.when(i % 3 == 0, "*").otherwise("_x")).alias("pattern"), F.lit("redact").alias("mode"))
    found = R.overlapping_rules(left, right)
    text = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
    # Equal numbers, and starts of one another.
    starts = lambda a, b: a == b or (b % 3 == 0 and str(a).startswith(str(b))) or (a % 2 and str(b).startswith(str(a)))
    a = 1234
    assert found.where(f"pattern = '*.*.col{a}_x'").count() == sum(1 for b in range(20_000) if starts(a, b) and (b % 3 == 0 or a == b))


def test_names_are_never_broadcast(spark, monkeypatch):
    """A catalogue Spark deems small has many keys: the rules are sent to it if few, and met by a shuffle if many."""
    n = F.col("id").cast("string")
    inventory = spark.range(2_000).select(F.lit("db1").alias("db"), F.concat(F.lit("t"), n).alias("table"), F.concat(F.lit("c"), n, F.lit("_mail")).alias("column"))
    rules = R.RuleSet.of({"*.*.*mail*": "redact", "*.t1*.*": "partial", "*.*.c7*": "email"}, allow=["db1.t5.c5_mail", "*.*.gone"])
    patterns = inventory.select(F.concat_ws(".", "db", "table", "column").alias("pattern"))
    answers = []
    for few in (10_000, 0):
        monkeypatch.setattr(rule_index, "FEW", few)
        found = R.match_rules(inventory, rules), R.overlapping_rules(patterns, rules)
        for df in found:
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BuildLeft" not in plan and ("BuildRight" in plan) == (few > 0)
        answers.append([sorted(map(tuple, df.collect())) for df in found] + [sorted(map(tuple, R.rule_candidates(inventory, rules).collect()))])
    assert answers[0] == answers[1] and len(answers[0][0]) > 3_000 and len(answers[0][1]) > 3_000
