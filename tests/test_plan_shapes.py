"""The physical plans at the places where scale depends on them."""

import pytest
from pyspark.sql import functions as F

from maskwright.operators import disclosure, rules
from maskwright.operators.masking import mask_table
from maskwright.operators.rules import RuleSet
from maskwright.operators.statements import classify_log
from maskwright.plans.aggregates import agg
from maskwright.plans.governed import governed
from maskwright.session import spread
from suite import QUERIES, load, table
from suite.derived import derive

load()
SF = "/root/testdata/sf0.001"
SHOP = RuleSet.of({"*.customer.c_name": "partial", "*.customer.c_acctbal": "redact"})


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def customer(spark):
    return table(spark, SF, "customer")


def test_masking_is_a_projection_that_reads_what_it_needs(customer):
    p = plan(mask_table(customer, "shop", "customer", SHOP).select("c_custkey", "c_name"))
    assert "Exchange" not in p and "Python" not in p
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in p


def test_filters_reach_the_scan_below_masks(customer):
    masked = mask_table(customer, "shop", "customer", SHOP).where("c_custkey = 7").select("c_custkey", "c_name")
    assert "PushedFilters: [IsNotNull(c_custkey), EqualTo(c_custkey,7)]" in plan(masked)
    g = governed(customer, "shop", "customer", SHOP).filter("c_nationkey = 3").select("c_custkey", "c_name").result()
    assert "EqualTo(c_nationkey,3)" in plan(g)
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_nationkey:int>" in plan(g)


def test_wide_tables_share_expressions(spark):
    wide = spark.range(3).select("id", *[F.concat(F.lit(f"c{i} a@b.cd "), "id").alias(f"c{i}") for i in range(40)])
    out = mask_table(wide, "d", "t", RuleSet.of(["d.t.c7"]), ("email",))
    assert out.columns == wide.columns
    row = out.where("id = 2").first()
    assert row["c0"] == "c0 a***(6) 2" and row["c39"] == "c39 a***(6) 2" and row["c7"] == "<redacted>"
    assert len(plan(out)) < 60_000


def test_rules_meet_by_equality_and_are_in_no_plan(spark):
    inv = derive(spark, SF, "inventory")
    p = plan(rules.resolve_modes(inv, SHOP)) + plan(rules.match_rules(inv, SHOP))
    assert "NestedLoop" not in p and "Cartesian" not in p and "acctbal" not in p


def test_counts_are_partial_aggregates(customer):
    p = plan(disclosure.k_min_group(customer, ["c_nationkey"]))
    assert p.count("HashAggregate") == 4 and "Sort" not in p


def test_distinct_on_does_not_sort_its_groups(spark):
    orders = governed(table(spark, SF, "orders"), "shop", "orders", SHOP)
    p = plan(orders.distinct_on(["o_custkey"], ["o_totalprice desc"]).result())
    assert "Window" not in p


def test_first_rows_per_key_are_limited_before_the_shuffle(spark):
    c, o = (governed(table(spark, SF, t), "shop", t, SHOP) for t in ("customer", "orders"))
    p = plan(c.lateral(o, on=[("c_custkey", "o_custkey")], order_by=["o_orderkey"], limit=2).result())
    assert p.count("WindowGroupLimit") == 2


def test_top_rows_are_taken_without_a_full_sort(spark):
    g = governed(table(spark, SF, "orders"), "shop", "orders", SHOP).order_by("o_totalprice desc").limit(5)
    assert "TakeOrderedAndProject" in plan(g.result())


def test_no_pairs_of_all_rows(spark):
    c, s = governed(table(spark, SF, "customer"), "shop", "customer", SHOP), governed(table(spark, SF, "supplier"), "shop", "supplier", SHOP)
    assert "Cartesian" not in plan(c.cross_join(s).result())
    assert "Cartesian" not in plan(c.join(s, where="s_nationkey < c_nationkey").result())




def test_spread_leaves_split_tables_alone(spark):
    many = spark.range(0, 100, 1, 16)
    assert spread(many) is many
    one = spread(spark.range(0, 100, 1, 1))
    assert one.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_group_by_of_masked_keys_checks_with_one_more_aggregate(spark, customer):
    g = governed(customer, "shop", "customer", SHOP).group_by("c_name").agg(agg("count", alias="n"))
    assert "_k" not in plan(g.result()) and len(g.k_checks()) == 1


def test_a_band_join_has_no_nested_loop(spark):
    o = governed(table(spark, SF, "orders"), "shop", "orders", SHOP)
    got = o.band_join(governed(table(spark, SF, "part"), "shop", "part", SHOP), "o_custkey", "p_size", 0, 2)
    assert "NestedLoop" not in plan(got.result()) and "Cartesian" not in plan(got.result())


def test_rounds_of_a_recursion_do_not_pile_up_conditions(customer):
    g = governed(customer, "shop", "customer", SHOP).select("c_custkey")
    children = g.filter("c_custkey > 0").with_column("parent", "cast(floor(c_custkey / 3.0) as bigint)")
    plans = []

    def step(frame):
        found = frame.prefix("r_").join(children, on=[("r_c_custkey", "parent")]).select("c_custkey")
        plans.append(plan(found._df).upper().count("FLOOR("))
        return found

    got = g.filter("c_custkey = 0").recursive(step).result()
    assert got.count() == customer.count()
    assert plans[-1] <= 6


def test_a_recursion_carries_columns_no_table_can_hold(customer):
    g = governed(customer, "shop", "customer", SHOP).select("c_custkey").with_column("nothing", "null")
    step = lambda frame: frame.filter("c_custkey < 2").with_column("k", "c_custkey + 1").select(("k", "c_custkey"), "nothing")
    assert sorted(r["c_custkey"] for r in g.filter("c_custkey = 0").recursive(step).result().collect()) == [0, 1, 2]


def test_statements_are_dealt_out_in_more_tasks_than_cores(spark):
    for name in ("h8_classify_log", "h8_composed_classes", "h9_workload"):
        p = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "RoundRobinPartitioning(16)" in p, name


def test_statements_without_a_hint_meet_no_costly_pattern(spark):
    log = spark.createDataFrame([("SELECT a FROM t LIMIT 5", "mysql")], "sql string, engine string")
    p = plan(classify_log(log))
    assert p.count("MERGE)(?= ") == 1 and "Contains(_n" in p
