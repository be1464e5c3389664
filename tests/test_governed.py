import pytest
from pyspark.sql import functions as F

from maskwright.functions import scalars
from maskwright.operators.output import Limits
from maskwright.operators.disclosure import k_values
from maskwright.operators.rules import RuleSet
from maskwright.plans.aggregates import agg
from maskwright.plans.governed import governed
from maskwright.plans.provenance import Kind
from maskwright.plans.refusals import CODES, Refused, refusal_codes

RULES = RuleSet.of({"app.users.email": "partial", "app.users.salary": "redact", "app.contacts.email": "email"})


@pytest.fixture(scope="module")
def t(spark):
   frames = {
       "users": spark.createDataFrame(
           [(1, "a@x.be", "Ann", 10.0, "on"), (2, "b@x.be", "Bob", 20.0, "on"), (3, "b@x.be", "Cid", 30.0, "off"), (4, None, "Dee", None, "off")],
           "id bigint, email string, name string, salary double, status string",
       ),
       "orders": spark.createDataFrame(
           [(10, 1, "a@x.be", 5.0), (11, 1, "z@x.be", 7.0), (12, 2, None, 9.0), (13, None, "q@x.be", 1.0)],
           "id bigint, user_id bigint, email string, total double",
       ),
       "contacts": spark.createDataFrame([(7, "a@x.be"), (8, "b@x.be"), (9, "b@x.be")], "id bigint, email string"),
       "notes": spark.createDataFrame([(1, "call 0475 12 34 56"), (2, "a@x.be")], "id bigint, v string"),
   }
   return {n: governed(df, "app", n, RULES) for n, df in frames.items()}


def code(fn):
   with pytest.raises(Refused) as e:
       fn()
   return e.value.code


def rows(df):
   return sorted(tuple(r) for r in df.collect())


# ---- masks follow the source, whatever the path ----


def test_masks_follow_aliases_and_shapes(t):
   u, c = t["users"], t["contacts"]
   base = rows(u.select("id", "email").result())
   assert base == [(1, "a***(6)"), (2, "b***(6)"), (3, "b***(6)"), (4, None)]
   same = [
       u.select("id", ("email", "x")).select("id", ("x", "email")),
       u.rename(mail="email").select("id", ("mail", "email")),
       u.prefix("p_").select(("p_id", "id"), ("p_email", "email")),
       u.filter("true").select("id", "email"),
       u.select("id", "email").union_all(u.filter("false").select("id", "email")),
       u.semi_join(u.prefix("o_"), on=[("id", "o_id")]).select("id", "email"),
       u.join(u.prefix("o_"), on=[("id", "o_id")]).select("id", "email"),
       u.order_by("id").limit(10).select("id", "email"),
       u.with_column("y", "id + 1").select("id", "email"),
       u.group_by("id", "email").agg(agg("count", alias="n")).select("id", "email"),
   ]
   for g in same:
       assert rows(g.result()) == base
   # Two modes in one column: redacted.
   both = u.select("email").union_all(c.select("email")).result()
   assert {r[0] for r in both.collect()} == {"<redacted>", None}


def test_detectors_read_the_rest(t):
   assert rows(t["notes"].result()) == [(1, "call 0***(13)"), (2, "a***(6)")]
   assert rows(t["orders"].select("id", "email").result()) == [(10, "a***(6)"), (11, "z***(6)"), (12, None), (13, "q***(6)")]


def test_origin_is_a_label_of_the_result(t):
   schema = t["users"].select(("email", "x"), "id").with_column("y", "id * 2").result().schema
   assert schema["x"].metadata == {"origin": "app.users.email"} and schema["y"].metadata == {}


def test_masking_off(spark, t):
   df = spark.createDataFrame([("a@x.be",)], "email string")
   assert rows(governed(df, "app", "users", RULES, masking=False).result(names=())) == [("a@x.be",)]


def test_provenance_kinds(t):
   u = t["users"]
   g = u.group_by("status").agg(
       agg("count", "email", alias="c"), agg("min", "email", alias="lo"), agg("any_value", "email", alias="any"), agg("min", "name", alias="first"),
       agg("sum", "salary", alias="s"), agg("count", alias="n"),
   )
   assert {k: g.provenance(k).kind for k in ("c", "lo", "any", "first", "s", "n")} == {
       "c": Kind.COUNT, "lo": Kind.AGGREGATE, "any": Kind.IDENTITY, "first": Kind.IDENTITY, "s": Kind.AGGREGATE, "n": Kind.CONST,
   }
   by = {r["status"]: r for r in g.result().collect()}
   assert by["on"]["lo"] == "<redacted>" and by["on"]["s"] == "<redacted>" and by["on"]["c"] == 2 and by["on"]["first"] == "Ann"


# ---- refusals ----


@pytest.mark.parametrize(
   "want, use",
   [
       ("E_MASKED_FILTER", lambda t: t["users"].filter("email like 'a%'")),
       ("E_MASKED_FILTER", lambda t: t["users"].filter("email = 'a@x.be'")),
       ("E_MASKED_FILTER", lambda t: t["users"].filter("not (email is null)")),
       ("E_MASKED_FILTER", lambda t: t["users"].filter("id = 1 or salary > 10")),
       ("E_MASKED_FILTER", lambda t: t["users"].filter(F.col("email").startswith("a"))),
       ("E_MASKED_FILTER", lambda t: t["users"].filter("exists(array(email), x -> x > 'a')")),
       ("E_MASKED_FILTER", lambda t: t["users"].filter("`email` > 'a'")),
       ("E_MASKED_FILTER", lambda t: t["users"].filter("EMAIL > 'a'")),
       ("E_MASKED_FILTER", lambda t: t["users"].filter_pii("email", ["a"], op="not in")),
       ("E_MASKED_FILTER", lambda t: t["users"].filter_pii("email", "a", op="<>")),
       ("E_MASKED_FILTER", lambda t: t["users"].filter_pii("email", F.col("name"))),
       ("E_MASKED_FILTER", lambda t: t["users"].filter_pii("email", [])),
       ("E_INVALID_SQL", lambda t: t["users"].filter_pii("name", "Ann")),
       ("E_MASKED_EXPRESSION", lambda t: t["users"].with_column("x", "upper(email)")),
       ("E_MASKED_EXPRESSION", lambda t: t["users"].with_column("x", "case when salary > 1 then 1 end")),
       ("E_MASKED_EXPRESSION", lambda t: t["users"].with_column("x", "struct(email)")),
       ("E_MASKED_EXPRESSION", lambda t: t["users"].agg(agg("max", "lower(email)", alias="m"))),
       ("E_MASKED_EXPRESSION", lambda t: t["users"].group_by(("k", "substr(email, 1, 1)")).agg(agg("count", alias="n"))),
       ("E_MASKED_EXPRESSION", lambda t: t["users"].window("x", "lag", "email", partition_by=["status"], order_by=["id"])),
       ("E_MASKED_ORDER", lambda t: t["users"].order_by("email")),
       ("E_MASKED_ORDER", lambda t: t["users"].order_by("2")),
       ("E_MASKED_ORDER", lambda t: t["users"].order_by("salary desc nulls last")),
       ("E_MASKED_ORDER", lambda t: t["users"].window("x", "row_number", partition_by=["email"], order_by=["id"])),
       ("E_MASKED_ORDER", lambda t: t["users"].window("x", "rank", order_by=["salary"])),
       ("E_MASKED_ORDER", lambda t: t["users"].distinct_on(["email"], ["id"])),
       ("E_MASKED_ORDER", lambda t: t["users"].distinct_on(["id"], ["salary"])),
       ("E_MASKED_ORDER", lambda t: t["users"].group_by("status").agg(agg("string_agg", "name", alias="x", order_by="email"))),
       ("E_MASKED_ORDER", lambda t: t["users"].group_by("status").agg(agg("count", alias="x", where="salary > 10"))),
       ("E_MASKED_FILTER", lambda t: t["users"].join(t["orders"].prefix("o_"), on=[("email", "o_email")])),
       ("E_MASKED_FILTER", lambda t: t["users"].join(t["users"].prefix("o_"), on=[("email", "o_email")])),
       ("E_MASKED_FILTER", lambda t: t["users"].join(t["orders"].prefix("o_"), where="o_total > salary")),
       ("E_MASKED_FILTER", lambda t: t["users"].join(t["contacts"].rename(cid="id").with_column("k", "'a@x.be'").select("cid", "k"), on=[("email", "k")])),
       ("E_MASKED_FILTER", lambda t: t["users"].select("id", "email").natural_join(t["orders"].select("id", "email"))),
       ("E_MASKED_FILTER", lambda t: t["users"].anti_join(t["contacts"].prefix("c_"), on=[("email", "c_email")])),
       ("E_MASKED_FILTER", lambda t: t["users"].semi_join(t["orders"].prefix("o_"), on=[("email", "o_email")])),
       ("E_MASKED_SET_OP", lambda t: t["users"].select("email").union(t["orders"].select("email"))),
       ("E_MASKED_SET_OP", lambda t: t["users"].select("email").except_(t["orders"].select("email"))),
       ("E_MASKED_SET_OP", lambda t: t["users"].select("email").union_all(t["notes"].select("v")).distinct()),
       ("E_MASKED_SET_OP", lambda t: t["users"].select("email").union_all(t["notes"].select("v")).group_by("email").agg(agg("count", alias="n"))),
       ("E_MASKED_SET_OP", lambda t: t["users"].select("email").union_all(t["notes"].select("v")).agg(agg("count", "email", alias="n", distinct=True))),
       ("E_MASKED_FILTER", lambda t: t["users"].select("email").intersect(t["users"].select("email"))),
       ("E_UNSUPPORTED_SYNTAX", lambda t: t["users"].filter("id in (select 1)")),
       ("E_UNSUPPORTED_SYNTAX", lambda t: t["users"].with_column("x", "(SELECT max(id) FROM other)")),
       ("E_UNSUPPORTED_SYNTAX", lambda t: t["users"].with_column("x", t["notes"]._df.agg(F.max("v")).scalar())),
       ("E_UNKNOWN_NAME", lambda t: t["users"].filter("nothing = 1")),
       ("E_UNKNOWN_NAME", lambda t: t["users"].select("nothing")),
       ("E_UNKNOWN_NAME", lambda t: t["users"].join(t["orders"], on=[("id", "user_id")])),
       ("E_INVALID_SQL", lambda t: t["users"].filter("id = = 1")),
       ("E_INVALID_SQL", lambda t: t["users"].select("id", ("name", "ID"))),
       ("E_INVALID_SQL", lambda t: t["users"].union_all(t["notes"])),
       ("E_INVALID_SQL", lambda t: t["users"].window("x", "upper", "name", order_by=["id"])),
       ("E_UNSUPPORTED_SYNTAX", lambda t: t["users"].window("x", "sum", "id", order_by=["id"], frame="GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW")),
       ("E_UNSUPPORTED_SYNTAX", lambda t: t["users"].join(t["notes"], on=["id"], how="semi")),
       ("E_NO_LIMIT", lambda t: t["users"].result(Limits())),
       ("E_LIMIT_TOO_HIGH", lambda t: t["users"].limit(500).result(Limits())),
       ("E_MASK_UNCERTAIN", lambda t: t["users"].select("id").result(labels=["ID", "x"])),
       ("E_COST", lambda t: t["users"].window("x", "count", "*")),
       ("E_COST", lambda t: t["users"].window("x", "row_number", order_by=["id"])),
   ],
)
def test_refused(t, want, use):
   assert code(lambda: use(t)) == want


def test_a_literal_that_looks_like_a_column_is_none(t):
   g = t["users"].with_column("x", "concat('email ', name)").filter("name <> 'salary'").with_column("y", "cast(id as string) || ' as email'")
   assert g.provenance("x").sources == {"app.users.name"} and not g.provenance("y").sensitive


def test_view_columns_cannot_be_counted(spark):
   v = governed(spark.createDataFrame([("a@x.be",)], "email string"), "app", "users", RULES, view=True)
   assert code(lambda: v.filter_pii("email", "a@x.be")) == "E_MASKED_FILTER"


def test_products_are_bounded(spark):
   big = governed(spark.range(20_000).toDF("a"), "app", "big", RuleSet())
   other = governed(spark.range(20_000).toDF("b"), "app", "other", RuleSet())
   assert code(lambda: big.cross_join(other)) == code(lambda: big.cross_join(other, max_rows=19_999)) == "E_COST"
   assert big.join(other, on=[("a", "b")], where="a > 19990").result().count() == 9
   few = governed(spark.range(3).toDF("c"), "app", "few", RuleSet())
   assert big.cross_join(few, max_rows=10).result().count() == few.cross_join(big).result().count() == 60_000
   assert few.cross_join(big).columns == ["c", "a"]
   assert big.join(few, where="a < c").result().count() == 3


# Ways to read a table from within an expression, and names that hide one.
READS_A_TABLE = [
   "(table clear_people |> aggregate max(name) as m)",
   "(from clear_people |> aggregate max(name) as m)",
   "(/*'*/ select max(name) from clear_people /*'*/)",
   "(SELECT/**/max(name) FROM clear_people)",
   "exists(table clear_people |> where name = 'alice')",
   "id in (table clear_ids)",
   "id = (values (1))",
   "coalesce(null, (with x as (table clear_people) table x |> aggregate max(name)))",
]


@pytest.fixture(scope="module")
def clear_tables(spark):
   spark.createDataFrame([(1, "alice"), (2, "bob")], "id long, name string").createOrReplaceTempView("clear_people")
   spark.createDataFrame([(1,)], "id long").createOrReplaceTempView("clear_ids")
   yield
   spark.catalog.dropTempView("clear_people")
   spark.catalog.dropTempView("clear_ids")


@pytest.mark.parametrize("expr", READS_A_TABLE)
def test_no_expression_reads_a_table(t, clear_tables, expr):
   u = t["users"]
   truth = f"({expr}) is not null"
   for use in (
       lambda: u.with_column("z", expr),
       lambda: u.with_columns({"y": "id", "z": expr}),
       lambda: u.filter(truth),
       lambda: u.group_by(("z", expr)),
       lambda: u.group_by("status").agg(agg("count", alias="n")).having(truth),
       lambda: u.agg(agg("max", expr, alias="m")),
       lambda: u.agg(agg("count", alias="n", where=truth)),
       lambda: u.window("z", "count", "*", partition_by=[expr]),
       lambda: u.window("z", "max", expr, partition_by=["status"]),
       lambda: u.order_by(expr),
       lambda: u.distinct_on(["status"], [expr]),
       lambda: u.select("id").join(t["orders"].prefix("o_"), on=[("id", "o_user_id")], where=truth),
   ):
       assert code(use) in ("E_UNSUPPORTED_SYNTAX", "E_INVALID_SQL", "E_UNKNOWN_NAME")


def test_no_expression_calls_out(spark, t):
   spark.udf.register("own_code", lambda x: "x")
   for expr in ("reflect('java.lang.System', 'getProperty', 'user.name')", "java_method('java.util.UUID', 'randomUUID')", "own_code(name)", "input_file_name()"):
       assert code(lambda: t["users"].with_column("z", expr)) in ("E_UNSUPPORTED_SYNTAX", "E_INVALID_SQL")


def test_generated_expressions_read_what_they_name(t):
   import random

   rnd, u = random.Random(7), t["users"]
   clear, hidden = ["id", "name", "status"], ["email", "salary"]

   def make(depth):
       if depth == 0 or rnd.random() < 0.2:
           c = rnd.choice(clear + hidden) if rnd.random() < 0.7 else rnd.choice(["'email'", "1", "'it''s salary'", "null"])
           return c, {c} & set(hidden)
       (a, x), (b, y) = make(depth - 1), make(depth - 1)
       form = rnd.choice(["concat({0}, {1})", "coalesce(cast({0} as string), cast({1} as string))", "case when cast({0} as string) = 'x' then {1} end", "transform(array(cast({0} as string)), v -> concat(v, cast({1} as string)))[0]"])
       return form.format(a, b), x | y

   for _ in range(120):
       expr, reads = make(rnd.randint(1, 3))
       got = code(lambda: u.with_column("z", expr)) if reads and expr not in hidden else None
       assert got == ("E_MASKED_EXPRESSION" if got else None), expr
       if not reads:
           assert not u.with_column("z", expr).provenance("z").sensitive


def test_nulls_and_directions_of_distinct_on(spark):
   g = governed(spark.createDataFrame([(1, 10), (1, 20), (1, None)], "k int, x int"), "app", "x", RuleSet())
   for order, want in (("x", None), ("x asc nulls last", 10), ("x desc", 20), ("x desc nulls last", 20), ("x desc nulls first", None), ("x nulls first", None)):
       assert rows(g.distinct_on(["k"], [order]).select("x").result()) == [(want,)], order
       assert rows(g.distinct_on(["k"], ["k desc", order]).select("x").result()) == [(want,)], order


def test_null_as_a_filter_value(spark):
   g = governed(spark.createDataFrame([("a",), (None,), (None,)], "email string"), "app", "users", RULES)
   f = g.filter_pii("email", None, op="<=>")
   assert f.result().count() == 2
   assert {r["n"] for r in f.k_report(5).collect()} == {2}
   base = spark.createDataFrame([(1,), (None,)], "`a.b` int")
   assert {(r["value"], r["n"]) for r in k_values(base, "a.b", [1, None, 3]).collect()} == {(1, 1), (None, 1), (3, 0)}


def test_recursion_over_cycles_and_deep_chains(spark, t):
   edges = governed(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src int, dst int"), "app", "edges", RuleSet())
   start = edges.filter("src = 1").select("src")
   step = lambda g: g.join(edges.prefix("e_"), on=[("src", "e_src")]).select(("e_dst", "src"))
   assert rows(start.recursive(step, distinct=True).result()) == [(1,), (2,), (3,)]
   users = t["users"].select("email")
   assert code(lambda: users.recursive(lambda g: g.group_by("email").agg(agg("count", alias="n")).filter("1 = 0").select("email"))) == "E_MASKED_FILTER"
   assert code(lambda: users.recursive(lambda g: g.group_by("email").agg().filter("1 = 0"))) == "E_MASKED_FILTER"


# ---- what a query steers on ----


def test_steering(t):
   u, o = t["users"], t["orders"]
   cases = [
       (u.select("id", "name"), []),
       (u.select("*"), []),
       (u.filter("name = 'b'").select("id"), ["app.users.name"]),
       (u.filter("substr(name, 2, 1) = 'b'").select("id"), ["app.users.name"]),
       (u.order_by("name").select("id"), ["app.users.name"]),
       (u.select("name").order_by("1"), ["app.users.name"]),
       (u.group_by("status").agg(agg("count", alias="n")), ["app.users.status"]),
       (u.select("status").distinct(), ["app.users.status"]),
       (u.with_column("x", "upper(name)").select("x"), ["app.users.name"]),
       (u.join(o.prefix("o_"), on=[("id", "o_user_id")]).select("id"), ["app.orders.user_id", "app.users.id"]),
       (u.select("id", ("name", "n")).filter("n = 'b'"), ["app.users.name"]),
       (u.semi_join(o.filter("total > 1").prefix("o_"), on=[("id", "o_user_id")]), ["app.orders.total", "app.orders.user_id", "app.users.id"]),
       (u.select("name").union(u.select("name")), ["app.users.name"]),
       (u.select("name").union_all(u.select("name")), []),
   ]
   for g, want in cases:
       assert g.report()["steering"] == want


def test_report_names_uses_and_joins(t):
   g = t["users"].join(t["contacts"].prefix("c_"), on=[("email", "c_email")]).select("id", "email")
   r = g.report()
   assert r["pii_joins"] == ["app.contacts.email = app.users.email"]
   assert ("app.users.email", "join") in r["uses"] and ("app.users.email", "select") in r["uses"]
   assert r["relations"] == ["app.contacts", "app.users"] and not r["pii_filter"]


# ---- k-anonymity ----


def k(g, n=5):
   out = g.k_report(n)
   return sorted((r["check"], r["n"]) for r in out.collect()) if out is not None else None


def test_k_counts_subjects_in_their_own_table(t):
   u, o = t["users"], t["orders"]
   # A join multiplies the rows, never the subjects.
   g = u.filter_pii("email", "a@x.be").join(o.prefix("o_"), on=[("id", "o_user_id")]).select("id")
   assert k(g) == [("the PII filter", 1), ("the PII filter", 1)]
   # Each value of a list is counted apart; one that is absent counts 0.
   assert k(u.filter_pii("email", ["b@x.be", "zz@x.be"])) == [("the PII filter", 0), ("the PII filter", 2)]
   assert k(u.filter_pii("email", None)) == [("the PII filter", 1), ("the PII filter", 1)]
   assert k(u.group_by("email").agg(agg("count", alias="n"))) == [("a group", 1)]
   assert k(u.group_by("email").agg(agg("count", alias="n")).having("n > 1")) == [("a group", 2)]
   assert k(u.group_by("email").agg(agg("count", alias="n")).having("n > 9")) == [("a group", None)]
   assert k(u.agg(agg("sum", "salary", alias="s"))) == [("the PII filter", 4)]
   assert k(u.select("email").distinct()) == [("the PII filter", 4)]
   assert k(u.filter("id > 1").select("id", "name")) is None
   assert k(u.filter_pii("email", "a@x.be"), 1) is None


def test_k_warnings(t):
   out = t["users"].group_by("email").agg(agg("count", alias="n")).having("n > 9").k_report(5).first()
   assert out["under_k"] is False and out["warning"] is None
   out = t["users"].filter_pii("email", "b@x.be").k_report(3).collect()
   assert {r["warning"] for r in out} == {"the PII filter: covers 2 rows, under k = 3"}
   assert all(r["under_k"] is False for r in t["users"].filter_pii("email", "b@x.be").k_report(2).collect())


# ---- the rest ----


def test_left_join_and_not_in(t):
   u, o = t["users"], t["orders"].prefix("o_")
   got = u.join(o, on=[("id", "o_user_id")], how="left").select("id", "o_id").result().collect()
   assert {(r["id"], r["o_id"]) for r in got} == {(1, 10), (1, 11), (2, 12), (3, None), (4, None)}
   assert rows(u.anti_join(o, on=[("id", "o_user_id")]).select("id").result()) == [(3,), (4,)]
   assert rows(u.anti_join(o, on=[("id", "o_user_id")], not_in=True).select("id").result()) == []
   some = o.filter("o_user_id is not null")
   assert rows(u.anti_join(some, on=[("id", "o_user_id")], not_in=True).select("id").result()) == [(3,), (4,)]


def test_recursion_converges_or_is_refused(t):
   base = t["orders"].filter("id = 10").select("id").with_column("depth", "0")
   got = base.recursive(lambda g: g.filter("depth < 3").with_column("d2", "depth + 1").select("id", ("d2", "depth")))
   assert [r["depth"] for r in got.result().orderBy("depth").collect()] == [0, 1, 2, 3]
   with pytest.raises(Refused):
       base.recursive(lambda g: g.with_column("d2", "depth + 1").select("id", ("d2", "depth")), max_rounds=5)
   users = t["users"].select("email")
   assert code(lambda: users.recursive(lambda g: g.filter_pii("email", "a"))) == "E_MASKED_FILTER"


def test_protected_write(spark, t, tmp_path):
   u = t["users"]
   assert code(lambda: u.select("id", "email").write_to(str(tmp_path / "a"), "app", "copy", RuleSet())) == "E_MASKED_WRITE"
   chosen = t["notes"].select("id", ("v", "email"))
   assert code(lambda: chosen.write_to(str(tmp_path / "b"), "app", "users", RULES)) == "E_MASKED_WRITE"
   t["notes"].select("id").with_column("email", "null").write_to(str(tmp_path / "c"), "app", "users", RULES)
   assert rows(spark.read.parquet(str(tmp_path / "c"))) == [(1, None), (2, None)]


def test_a_batch_of_a_table_replaces_itself(spark, tmp_path):
   spark.sql(f"create database stored location '{tmp_path}/stored'")
   g = lambda values, ddl="id bigint, v string": governed(spark.createDataFrame(values, ddl), "app", "t", RuleSet())
   kept = lambda: sorted(tuple(r) for r in spark.table("stored.t").select("id", "v", "batch").collect())
   for _ in range(2):
      g([(1, "a"), (2, "b")]).write_table("stored", "t", RuleSet(), "one")
      g([("c", 3)], "V string, ID bigint").write_table("stored", "t", RuleSet(), "it's \\ two")
   assert kept() == [(1, "a", "one"), (2, "b", "one"), (3, "c", "it's \\ two")]
   g([]).write_table("stored", "t", RuleSet(), "one")
   g([(4, None)]).select("id").with_column("v", "null").write_table("stored", "t", RuleSet.of({"stored.t.v": "redact"}), "it's \\ two")
   assert kept() == [(4, None, "it's \\ two")]
   bad = [([(1,)], "id bigint"), ([(1, "a", 2)], "id bigint, v string, w int"), ([(1, "a")], "id int, v string"), ([(1, "a", "x")], "id bigint, v string, Batch string")]
   for values, ddl in bad:
      assert code(lambda: g(values, ddl).write_table("stored", "t", RuleSet(), "one")) == "E_INVALID_SQL"
   assert code(lambda: g([(1, "a")]).write_table("stored", "t` x", RuleSet(), "one")) == "E_INVALID_SQL"
   assert code(lambda: g([(1, "a")]).write_table("stored", "t", RuleSet.of({"stored.t.v": "redact"}), "one")) == "E_MASKED_WRITE"
   spark.sql("create table stored.plain (id bigint) using parquet")
   assert code(lambda: g([(1,)], "id bigint").write_table("stored", "plain", RuleSet(), "one")) == "E_INVALID_SQL"
   assert kept() == [(4, None, "it's \\ two")]


def test_dialect_functions_in_expressions(spark, t):
   scalars.register(spark)
   g = t["users"].with_columns({"a": "strpos(name, 'n')", "b": "json_valid('{}x')", "c": "json_valid('1, 2')", "d": "glob('A*', name)"})
   assert rows(g.filter("id = 1").select("a", "b", "c", "d").result()) == [(2, False, False, True)]
   assert code(lambda: t["users"].with_column("x", "strpos(email, 'a')")) == "E_MASKED_EXPRESSION"


def test_refusal_table(spark):
   assert refusal_codes(spark).count() == len(CODES)
   assert Refused("E_FORBIDDEN", "x").retry == "stop"
