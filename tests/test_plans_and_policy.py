import hashlib
import json

import pytest
from pyspark.sql import functions as F

from maskwright.operators import disclosure, governance, lineage, plan_weight
from maskwright.operators.output import Limits
from maskwright.operators.rules import RuleSet

NODES = """plan_id string, node_id int, parent_id int, ord int, table string, access string, est_rows bigint, sort boolean,
temp boolean, correlated boolean, no_join_cond boolean, recursive boolean, detail string, cost double"""
LIMITS = Limits(explain_rows_warn=10_000, explain_rows_refuse=100_000)


def group(*children, **flags):
    return {"children": children, **flags}


def table(name, access, rows, **flags):
    return {"table": name, "access": access, "rows": rows, **flags}


def flatten(plan_id, root):
    out, todo = [], [(root, None)]
    while todo:
        node, parent = todo.pop(0)
        i = len(out)
        f = lambda k: bool(node.get(k))
        out.append((plan_id, i, parent, i, node.get("table"), node.get("access"), node.get("rows", -1), f("sort"), f("temp"), f("correlated"), f("no_join_cond"), f("recursive"), None, node.get("cost", -1.0)))
        todo += [(c, i) for c in node.get("children", ())]
    return out


MAX = 2**63 - 1
# Plan, level, rows examined.
PLANS = {
    "ref": (group(table("big", "lookup", 1)), "OK", 1),
    "range": (group(table("big", "range", 500)), "OK", 500),
    "small_scan": (group(table("small", "full", 3)), "OK", 3),
    "join": (group(table("s", "full", 3), table("a", "lookup", 1)), "OK", 3),
    "full_scan": (group(table("big", "full", 49_840)), "WARN", 49_840),
    "full_refused": (group(table("big", "full", 500_000)), "REFUSE", 500_000),
    "index_scan": (group(table("t", "index", 20_000)), "WARN", 20_000),
    "filesort": (group(table("big", "full", 49_840), sort=True), "WARN", 49_840),
    "cartesian_small": (group(table("a", "full", 20), table("b", "full", 30, no_join_cond=True)), "WARN", 600),
    "cartesian": (group(table("a", "full", 3), table("b", "full", 20_000, no_join_cond=True)), "REFUSE", 60_000),
    "join_no_index": (group(table("a", "full", 50_000), table("b", "full", 50_000)), "REFUSE", 2_500_000_000),
    "correlated": (group(table("s", "full", 3), group(table("b", "full", 49_959), correlated=True)), "REFUSE", 3 + 3 * 49_959),
    "subquery": (group(table("s", "full", 3), group(table("b", "lookup", 9))), "OK", 12),
    "nested": (group(table("a", "full", 5), group(table("b", "lookup", 2), group(table("c", "full", 10), correlated=True), correlated=True)), "OK", 115),
    "derived": (group(group(table("big", "full", 50_000), temp=True)), "WARN", 50_000),
    "no_table": (group(), "OK", 0),
    "unknown": (group(table("nostat", "full", -1)), "WARN", 1),
    "recursive": (group(table("r", "full", 2), recursive=True), "WARN", 2),
    "recursive_big": (group(table("r", "full", 500_000), recursive=True), "REFUSE", 500_000),
    "saturated": (group(*[table("t", "lookup", MAX // 2)] * 3), "REFUSE", MAX),
    "many_tables": (group(*[table("t", "lookup", 2)] * 100), "REFUSE", MAX),
    "many_ones": (group(*[table("t", "lookup", 1)] * 100), "OK", 1),
    "deep_saturated": (group(table("t", "lookup", MAX // 2), group(table("u", "lookup", MAX // 2), correlated=True)), "REFUSE", MAX),
    "exact": (group(table("a", "lookup", 3037000499), table("b", "lookup", 3037000499)), "REFUSE", 3037000499**2),
}


@pytest.fixture(scope="module")
def weighed(spark):
    rows = [r for name, (root, _, _) in PLANS.items() for r in flatten(name, root)]
    nodes = spark.createDataFrame(rows, NODES)
    verdict, found = plan_weight.weigh_plans(nodes, LIMITS)
    return nodes, verdict.cache(), found.cache()


def test_levels(weighed):
    got = {r["plan_id"]: (r["level"], r["estimated_rows"]) for r in weighed[1].collect()}
    assert got == {n: (level, rows) for n, (_, level, rows) in PLANS.items()}


def test_reasons(weighed):
    reasons = {}
    for r in weighed[2].collect():
        reasons.setdefault(r["plan_id"], set()).add(r["reason"])
    assert reasons["full_scan"] == {"would read 49 840 rows, over the mark of 10 000", "reads all of big: 49 840 rows"}
    assert "sorts 49 840 rows" in reasons["filesort"] and "puts 50 000 rows aside" in reasons["derived"]
    assert reasons["cartesian_small"] == {"nothing joins b to the rest"}
    assert reasons["correlated"] >= {"would read 149 880 rows, over the limit of 100 000"}
    assert reasons["recursive"] == {"recursion: nobody knows its rows beforehand"}
    assert len(reasons["unknown"]) == 1 and "however large" in reasons["unknown"].pop()
    assert "ok" not in reasons and "join" not in reasons


def test_cost_limit_and_summary(spark):
    root = group(table("s", "full", 3), table("a", "lookup", 1), cost=0.024)
    nodes = spark.createDataFrame(flatten("p", root), NODES)
    verdict, found = plan_weight.weigh_plans(nodes, Limits(explain_cost_refuse=0.01))
    assert verdict.first()["level"] == "REFUSE" and "costs" in found.first()["reason"]
    parts = [r["part"] for r in plan_weight.plan_summary(nodes, verdict.select("plan_id", "estimated_rows")).orderBy("ord").collect()]
    assert " · ".join(parts) == "s full ~3 · a lookup ~1 · reads 3 rows · cost 0.02"


# ---- lineage ----

RULES = RuleSet.of({"raw.u.email": "email", "raw.u.salary": "redact", "raw.u.name": "partial"})
EDGES = [
    ("l1.v.mail", "raw.u.email", "identity", False),
    ("l1.v.any", "raw.u.email", "identity", False),
    ("l1.v.any", "raw.u.name", "identity", False),
    ("l1.v.upper", "raw.u.name", "expr", False),
    ("l1.v.n", "raw.u.email", "count", False),
    ("l1.v.top", "raw.u.salary", "aggregate", False),
    ("l1.v.id", "raw.u.id", "identity", False),
    ("l2.w.mail", "l1.v.mail", "identity", True),
    ("l2.w.sum", "l1.v.n", "aggregate", False),
    ("l2.w.mix", "l1.v.n", "expr", False),
    ("l2.w.mix", "l1.v.id", "expr", False),
    ("l2.w.one", "l1.v.mail", "const", False),
    ("l3.x.loop", "l2.w.mail", "identity", False),
    ("l2.w.mail", "l3.x.loop", "identity", False),
]


def test_propagation(spark):
    edges = spark.createDataFrame(EDGES, "dst string, src string, kind string, literal boolean")
    got = {r["node"]: (r["kind"], r["mask"], r["lit"]) for r in lineage.propagate(edges, RULES).collect()}
    assert got["l1.v.mail"] == (2, "email", False) and got["l1.v.any"] == (2, "redact", False)
    assert got["l1.v.upper"] == (4, "redact", False) and got["l1.v.n"] == (1, None, False) and got["l1.v.top"] == (3, "redact", False)
    assert got["l2.w.mail"] == (2, "email", True) and got["l3.x.loop"] == (2, "email", True)
    assert got["l2.w.sum"] == (3, None, False) and got["l2.w.mix"] == (4, None, False) and got["l2.w.one"] == (0, None, True)
    src = {(r["dst"], r["source"]) for r in lineage.sources(edges).collect()}
    assert ("l3.x.loop", "raw.u.email") in src and ("l2.w.mix", "raw.u.id") in src and not any(d == "l2.w.one" for d, _ in src)


@pytest.mark.parametrize(
    "clause, op, positive, partner, source, want",
    [
        ("where", "=", True, None, "raw.u.email", None),
        ("where", "in", True, None, "raw.u.email", None),
        ("where", "is null", True, None, "raw.u.email", None),
        ("where", "=", False, None, "raw.u.email", "E_MASKED_FILTER"),
        ("where", "like", True, None, "raw.u.email", "E_MASKED_FILTER"),
        ("join", "=", True, None, "raw.u.email", "E_MASKED_FILTER"),
        ("join", "=", True, "raw.u.name", "raw.u.email", None),
        ("join", "=", True, "raw.u.id", "raw.u.email", "E_MASKED_FILTER"),
        ("join", "=", True, "raw.u.email", "raw.u.email", "E_MASKED_FILTER"),
        ("join", "=", True, "raw.u.email", "raw.u.id", "E_MASKED_FILTER"),
        ("order by", "plain", True, None, "raw.u.email", "E_MASKED_ORDER"),
        ("partition by", "plain", True, None, "raw.u.email", "E_MASKED_ORDER"),
        ("select", "plain", True, None, "raw.u.email", None),
        ("select", "expression", True, None, "raw.u.email", "E_MASKED_EXPRESSION"),
        ("select", "expression", True, None, "raw.u.id", None),
        ("set operation", "union", True, "raw.u.id", "raw.u.email", "E_MASKED_SET_OP"),
        ("set operation", "union", True, "raw.u.email", "raw.u.email", "E_MASKED_FILTER"),
        ("set operation", "union", True, "raw.u.name", "raw.u.email", None),
        ("write", "=", True, None, "raw.u.email", "E_MASKED_WRITE"),
    ],
)
def test_uses(spark, clause, op, positive, partner, source, want):
    df = spark.createDataFrame([("s", source, clause, op, positive, partner)], "statement_id string, source string, clause string, op string, positive boolean, partner string")
    assert lineage.evaluate_uses(df, RULES).first()["code"] == want


def test_steering_risk(spark):
    inv = spark.createDataFrame(
        [("a", "t", c, ty, False, g, lo) for c, ty, g, lo in [("txt", "json", False, False), ("num", "int", False, False), ("gen", "bigint", True, False), ("day", "date", False, False), ("loose", "", False, True), ("ok", "text", False, False)]],
        "db string, table string, column string, type string, view boolean, generated boolean, type_loose boolean",
    )
    uses = spark.createDataFrame([(c, f"a.t.{c}", "where", "=") for c in ("txt", "num", "gen", "day", "loose", "ok", "gone")], "id string, source string, clause string, op string")
    run = lambda names: {r["id"]: r["risk"] for r in lineage.steering_risk(uses, inv, RuleSet.of(allow=["a.t.ok"]), names).collect()}
    assert run(("email", "card")) == {"txt": "text", "num": "number", "loose": "text", "gone": "text"}
    assert run(("email",)) == {"txt": "text", "loose": "text", "gone": "text"}


# ---- grants ----


def test_running_sums_agree_with_a_window(spark):
    from pyspark.sql import Window

    df = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id % 7)) k", "timestamp_seconds(id * 7 % 9000) ts", "id % 11 v")
    got = governance.running_sums(df, ["k"], "ts", ["id"], {"total": F.col("v")}, bucket_seconds=60)
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    assert got.exceptAll(df.withColumn("total", F.sum("v").over(w))).count() == 0 and got.count() == 5000


def test_ledger(spark):
    grants = spark.createDataFrame([("g", "2024-01-01 01:00:00", 3, 100, 5000), ("d", "2024-01-01 01:00:00", None, None, None)], "grant_id string, e string, statements bigint, rows bigint, bytes bigint").withColumn("expires", F.to_timestamp("e")).drop("e")
    runs = spark.createDataFrame(
        [("r1", "g", "2024-01-01 00:00:01", 30, 100), ("r2", "g", "2024-01-01 00:10:00", 80, 100), ("r3", "g", "2024-01-01 00:20:00", 1, 1), ("r4", "g", "2024-01-01 01:00:00", 1, 1), ("d1", "d", "2024-01-01 00:00:00", 5, 2**20), ("d2", "d", "2024-01-01 00:00:09", 5, 1)],
        "run_id string, grant_id string, t string, rows bigint, bytes bigint",
    ).withColumn("ts", F.to_timestamp("t")).drop("t")
    got = {r["run_id"]: (r["statements_left"], r["rows_left"], r["bytes_left"], r["end_reason"]) for r in governance.grant_ledger(runs, grants).collect()}
    assert got == {
        "r1": (2, 70, 4900, None), "r2": (1, 0, 4800, None), "r3": (None, None, None, "rows"), "r4": (None, None, None, "expired"),
        "d1": (199, 9995, 0, None), "d2": (None, None, None, "bytes"),
    }


def test_chain(spark):
    lines, prev = [], None
    for i in range(6):
        rec = {"event": f"e{i}"}
        if i:
            rec["prev_hash"] = hashlib.sha256(prev.encode()).hexdigest()
        else:
            rec["prev_hash"] = governance.GENESIS
        prev = json.dumps(rec)
        lines.append(prev)
    mk = lambda ls, f: [(f, i, x) for i, x in enumerate(ls)]
    edited = list(lines)
    edited[2] = edited[2].replace("e2", "eX")
    old = ['{"event":"old"}'] + [json.dumps({"event": "n", "prev_hash": hashlib.sha256(b'{"event":"old"}').hexdigest()})]
    df = spark.createDataFrame(mk(lines, "good") + mk(edited, "edited") + mk(old, "old") + mk(lines[1:], "cut"), "file string, seq bigint, line string")
    got = {r["file"]: tuple(r)[1:] for r in governance.verify_chain(df).collect()}
    assert got == {"good": (6, 0, 1, 0, None), "edited": (6, 1, 1, 0, 3), "old": (2, 0, 0, 1, None), "cut": (5, 1, 0, 0, 0)}


def test_auto_privileges_bounds(spark):
    log = spark.createDataFrame([("read", False), ("read", True), ("write", False), ("write", True), ("admin", False), ("ddl", True)], "stmt_class string, unmask boolean")
    got = [(r["auto_action"], r["auto_value"]) for r in governance.auto_decision(log, {"read": "auto", "write": "ask", "ddl": "deny", "unmask": "ask"}).collect()]
    assert got == [("read", "auto"), ("unmask", "ask"), ("write", "ask"), ("unmask", "ask"), ("ddl", "deny"), ("ddl", "deny")]
    rows = [("u", "t", p, tier) for p, tier in [("SELECT", "read"), ("INSERT", "read"), ("INSERT", "write"), ("TRUNCATE", "write"), ("TRUNCATE", "ddl"), ("SUPERUSER", "ddl"), ("SUPERUSER", "admin")]]
    got = {(r["privilege"], r["tier"]) for r in governance.excess_privileges(spark.createDataFrame(rows, "principal string, object string, privilege string, tier string")).collect()}
    assert got == {("INSERT", "read"), ("TRUNCATE", "write"), ("SUPERUSER", "ddl")}
    runs = spark.createDataFrame([(1, "write", 10), (2, "write", 10), (3, "write", 10), (4, "read", 10)], "plan_id int, class string, affected bigint")
    caps = spark.createDataFrame([(1, 9), (2, 10), (3, 0), (4, 1)], "plan_id int, max_affected bigint")
    assert [r["plan_id"] for r in governance.rowbound_violations(runs, caps).collect()] == [1]


def test_coverage_takes_the_first_grant_only(spark):
    ts = lambda c: F.to_timestamp(c)
    grants = spark.createDataFrame(
        [("g1", "a", "db", ["t", "u"], "2024-01-01 00:00:00", "2024-01-01 01:00:00", 5, 10, 9999), ("g2", "a", "db", ["t"], "2024-01-01 00:30:00", "2024-01-01 02:00:00", 5, 1000, 9999)],
        "grant_id string, agent string, db string, tables array<string>, s string, e string, statements bigint, rows bigint, bytes bigint",
    ).withColumn("start", ts("s")).withColumn("expires", ts("e"))
    base = ("a", "db", "2024-01-01 00:45:00", ["t"], "read", False, 0, 0, "OK", 5)
    changes = {"ok": {}, "late": {2: "2024-01-01 01:30:00"}, "gone": {2: "2024-01-01 02:00:00"}, "short": {9: 50}, "both": {3: ["t", "u"]}, "more": {3: ["t", "x"]}, "unmask": {5: True}, "warned": {6: 1}, "refused": {8: "REFUSE"}, "write": {4: "write"}, "other": {0: "b"}, "none": {3: []}}
    rows = [(n, *[c.get(i, v) for i, v in enumerate(base)]) for n, c in changes.items()]
    plans = spark.createDataFrame(rows, "plan_id string, agent string, db string, t string, relations array<string>, class string, unmask boolean, warnings int, k_checks int, verdict string, est_rows bigint").withColumn("ts", ts("t"))
    got = {r["plan_id"]: r["grant_id"] for r in governance.grant_coverage(plans, grants).collect()}
    assert got == {**{n: None for n in changes}, "ok": "g1", "late": "g2", "both": "g1"}


def test_drift_and_k(spark):
    mk = lambda *r: spark.createDataFrame(r, "kind string, name string, definition string")
    before, after = mk(("view", "v", "1"), ("view", "w", "1"), ("view", "x", "1")), mk(("view", "v", "1"), ("view", "w", "2"), ("view", "y", "1"))
    assert {(r["name"], r["change"]) for r in governance.definition_drift(before, after).collect()} == {("w", "changed"), ("x", "removed"), ("y", "added")}
    plans = spark.createDataFrame([("p", ["v"]), ("q", ["w", "w", "y"])], "plan_id string, refs array<string>")
    assert [tuple(r) for r in governance.stale_plans(plans, before, after).collect()] == [("q", 2)]
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert disclosure.k_min_group(df, ["k"]).first()["n"] == 1 and disclosure.k_min_group(df.limit(0), ["k"]).first()["n"] is None
    assert {(r["value"], r["n"]) for r in disclosure.k_values(df, "k", ["a", "z"]).collect()} == {("a", 2), ("z", 0)}
    assert disclosure.k_subjects(df, "k", None).first()["n"] == 0


def test_plans_in_a_circle_are_refused_and_unset_limits_are_the_usual_ones(spark):
    fields = "plan_id string, node_id int, parent_id int, ord int, table string, access string, est_rows bigint, sort boolean, temp boolean, correlated boolean, no_join_cond boolean, recursive boolean, detail string, cost double"
    flat = lambda p, n, up, table=None, est=-1: (p, n, up, n, table, "ref" if table else None, est, False, False, False, False, False, "", 0.0)
    nodes = spark.createDataFrame([flat("round", 1, 2), flat("round", 2, 1), flat("round", 3, 1, "t", 5), flat("plain", 1, None), flat("plain", 2, 1, "t", 3)], fields)
    verdict, found = plan_weight.weigh_plans(nodes, Limits(explain_rows_warn=0, explain_rows_refuse=0))
    assert {r["plan_id"]: r["level"] for r in verdict.collect()} == {"round": "REFUSE", "plain": "OK"}
    assert {r["plan_id"] for r in found.collect()} == {"round"}


def test_many_rules(spark):
    rules = RuleSet.of([f"db.t{i}.c" for i in range(20_000)])
    assert rules.mode("db", "t19999", "c") == "redact" and rules.mode("db", "t20000", "c") is None
