"""EXISTS with further conditions, lateral bodies, interval joins, and aggregates with an order or DISTINCT of their own."""

import random

import pytest

from maskwright.operators.rules import RuleSet
from maskwright.plans.aggregates import agg
from maskwright.plans.governed import governed
from maskwright.plans.refusals import Refused

RULES = RuleSet.of({"app.users.email": "partial", "app.orders.note": "redact"})
USERS = [(1, 10, "a@x.be"), (2, 5, "b@x.be"), (3, None, "c@x.be"), (4, 50, None), (None, 1, "d@x.be"), (1, 10, "e@x.be")]
ORDERS = [(10, 1, 7, "n"), (11, 1, 12, "n"), (12, 1, 12, None), (13, 2, 3, "n"), (14, 3, 9, "n"), (15, None, 99, "n"), (16, 4, None, "n")]


@pytest.fixture(scope="module")
def users(spark):
    return governed(spark.createDataFrame(USERS, "id int, least int, email string"), "app", "users", RULES)


@pytest.fixture(scope="module")
def orders(spark):
    return governed(spark.createDataFrame(ORDERS, "key int, user_id int, total int, note string"), "app", "orders", RULES)


def rows(g):
    return sorted((tuple(r) for r in g.result(names=()).collect()), key=repr)


def code(fn):
    with pytest.raises(Refused) as e:
        fn()
    return e.value.code


def plan(g):
    return g.result()._jdf.queryExecution().executedPlan().toString()


ON = [("id", "user_id")]


def found(u):
    return [o for o in ORDERS if u[0] is not None and o[1] == u[0] and None not in (o[2], u[1]) and o[2] > u[1]]


def test_exists_with_a_condition_over_both_sides(users, orders):
    kept = users.semi_join(orders, on=ON, where="total > least").select("id", "least")
    assert rows(kept) == sorted(((u[0], u[1]) for u in USERS if found(u)), key=repr)
    rest = users.anti_join(orders, on=ON, where="total > least").select("id", "least")
    assert rows(rest) == sorted(((u[0], u[1]) for u in USERS if not found(u)), key=repr)
    assert "NestedLoop" not in plan(kept) + plan(rest)


def test_what_an_existence_test_may_ask(users, orders):
    assert code(lambda: users.semi_join(orders, on=ON, where="note > email")) == "E_MASKED_FILTER"
    assert code(lambda: users.anti_join(orders, on=ON, where="length(email) < total")) == "E_MASKED_FILTER"
    assert code(lambda: users.semi_join(orders, on=[], where="total > least")) == "E_COST"
    assert code(lambda: users.anti_join(orders, on=ON, not_in=True, where="total > least")) == "E_UNSUPPORTED_SYNTAX"
    assert code(lambda: users.semi_join(users, on=[("id", "id")], where="least > 1")) == "E_UNKNOWN_NAME"
    assert code(lambda: users.semi_join(orders, on=ON, where="nothing > 1")) == "E_UNKNOWN_NAME"
    assert "least" in " ".join(users.semi_join(orders, on=ON, where="total > least").report()["steering"])


def test_a_lateral_body_of_aggregates_has_a_row_for_every_outer_row(users, orders):
    g = users.lateral_join(orders, ON, where="total > least", aggs=[agg("count", alias="n"), agg("max", "total + least", alias="top")])
    want = [(u[0], u[1], len(found(u)), max((o[2] + u[1] for o in found(u)), default=None)) for u in USERS]
    assert rows(g.select("id", "least", "n", "top")) == sorted(want, key=repr)
    assert "NestedLoop" not in plan(g) and "Cartesian" not in plan(g)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_lateral_body_of_first_rows(users, orders, how):
    g = users.lateral_join(orders, ON, where="total > least", columns={"at": "key", "over": "total - least"}, order_by=["total - least desc", "key desc"], limit=1, how=how)
    want = []
    for u in USERS:
        best = sorted(found(u), key=lambda o: (-(o[2] - u[1]), -o[0]))[:1]
        want += [(u[0], u[2] and "x", o[0], o[2] - u[1]) for o in best] or ([(u[0], u[2] and "x", None, None)] if how == "left" else [])
    got = [(r["id"], r["email"] and "x", r["at"], r["over"]) for r in g.result(names=()).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert "NestedLoop" not in plan(g) and "Cartesian" not in plan(g)
    assert all(r["email"] is None or "***" in r["email"] for r in g.result(names=()).collect())


def test_a_lateral_body_without_outer_columns_carries_masks(users, orders):
    g = users.lateral_join(orders, ON, order_by=["key"], limit=1)
    assert {r["note"] for r in g.result(names=()).collect()} == {"<redacted>"}
    assert "WindowGroupLimit" in plan(g).rsplit("Exchange", 1)[1]  # below the shuffle


def test_what_a_lateral_body_may_not_do(users, orders):
    assert code(lambda: users.lateral_join(orders, ON, where="email > 'b'")) == "E_MASKED_FILTER"
    assert code(lambda: users.lateral_join(orders, ON, columns={"x": "concat(email, total)"})) == "E_MASKED_EXPRESSION"
    assert code(lambda: users.lateral_join(orders, ON, order_by=["note"], limit=1)) == "E_MASKED_ORDER"
    assert code(lambda: users.lateral_join(orders, ON, aggs=[agg("count", "note", alias="n")])) == "E_MASKED_EXPRESSION"
    assert code(lambda: users.lateral_join(orders, [], limit=1)) == "E_COST"
    assert code(lambda: users.lateral_join(orders, ON, columns={"least": "total"})) == "E_UNKNOWN_NAME"
    assert code(lambda: users.lateral_join(orders, ON, how="full")) == "E_UNSUPPORTED_SYNTAX"


def test_empty_sides(users, orders):
    none = orders.filter("false")
    assert rows(users.semi_join(none, on=ON, where="total > least").select("id")) == []
    assert len(rows(users.anti_join(none, on=ON, where="total > least").select("id"))) == len(USERS)
    assert {r[1] for r in rows(users.lateral_join(none, ON, aggs=[agg("count", alias="n")]).select("id", "n"))} == {0}
    assert rows(users.filter("false").lateral_join(orders, ON, limit=1).select("id")) == []


def intervals(seed, n):
    r = random.Random(seed)
    out = [(i, s, s + r.choice([0, 1, 3, 15, 16, 17, 200, 5000])) for i, s in ((i, r.randint(-3000, 3000)) for i in range(n))]
    return out + [(n, None, 5), (n + 1, 5, None), (n + 2, 9, 3), (n + 3, 7, 7), (n + 4, 7, 7)]


def test_intervals_meet_once(spark):
    left, right = intervals(1, 150), intervals(2, 140)
    a = governed(spark.createDataFrame(left, "i int, s long, e long"), "d", "a", RULES)
    b = governed(spark.createDataFrame(right, "j int, t long, f long"), "d", "b", RULES)
    g = a.overlap_join(b, ("s", "e"), ("t", "f")).select("i", "j")
    ok = lambda x: x[1] is not None and x[2] is not None and x[1] <= x[2]
    want = [(x[0], y[0]) for x in left if ok(x) for y in right if ok(y) and x[1] <= y[2] and y[1] <= x[2]]
    assert rows(g) == sorted(want, key=repr)
    assert "NestedLoop" not in plan(g) and "Cartesian" not in plan(g)
    assert rows(a.overlap_join(b.filter("false"), ("s", "e"), ("t", "f")).select("i")) == []


def test_intervals_of_fractions_dates_and_times(spark):
    a = governed(spark.sql("select 1 as i, 0.5D as s, 1.2D as e, date'2024-01-31' as d, timestamp'2024-01-31 10:00:00' as u"), "d", "a", RULES)
    b = governed(spark.sql("select * from values (1, 1.2D, 9D, date'2024-01-31', timestamp'2024-01-31 10:00:00'), (2, 1.3D, 9D, date'2024-02-01', timestamp'2024-01-31 10:00:00.000001') as t(j, t, f, d2, u2)"), "d", "b", RULES)
    assert rows(a.overlap_join(b, ("s", "e"), ("t", "f")).select("j")) == [(1,)]
    assert rows(a.overlap_join(b, ("d", "d"), ("d2", "d2")).select("j")) == [(1,)]
    assert rows(a.overlap_join(b, ("u", "u"), ("u2", "u2")).select("j")) == [(1,)]


def test_an_overlap_reads_no_masked_end(spark, users, orders):
    masked = RuleSet.of({"d.a.s": "redact"})
    a = governed(spark.sql("select 1L as s, 2L as e"), "d", "a", masked)
    b = governed(spark.sql("select 1L as t, 2L as f"), "d", "b", masked)
    assert code(lambda: a.overlap_join(b, ("s", "e"), ("t", "f"))) == "E_MASKED_FILTER"
    assert code(lambda: users.overlap_join(orders, ("email", "email"), ("key", "total"))) == "E_MASKED_FILTER"


def test_each_key_of_an_aggregate_has_its_direction(spark):
    data = [("b", 1), ("a", 2), (None, 3), ("b", 4), ("a", 5), ("a", 2)]
    g = governed(spark.createDataFrame(data, "k string, n int"), "d", "t", RULES)
    got = lambda *keys, **o: g.agg(agg("string_agg", "n", alias="x", order_by=keys, **o)).result(names=()).first()["x"]
    assert got("k desc", "n") == "1,4,2,2,5,3"
    assert got("k", "n desc") == "3,5,2,2,4,1"
    assert got("k asc nulls last", "n desc") == "5,2,2,4,1,3"
    assert got("k desc nulls first", "n") == "3,1,4,2,2,5"
    assert got("k asc", "n", descending=True) == "3,5,2,2,4,1"
    assert got("k", "n", descending=True) == "4,1,5,2,2,3"


def test_distinct_statistics_and_bits(spark):
    g = governed(spark.createDataFrame([(1,), (1,), (2,), (7,), (None,)], "n int"), "d", "t", RULES)
    out = g.agg(
        agg("variance", "n", alias="v", distinct=True),
        agg("bit_xor", "n", alias="x", distinct=True),
        agg("bit_xor", "n", alias="y", distinct=True, where="n > 1"),
    ).result(names=()).first()
    assert round(out["v"], 6) == 10.333333 and (out["x"], out["y"]) == (1 ^ 2 ^ 7, 2 ^ 7)
