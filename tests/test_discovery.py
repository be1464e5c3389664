import pytest

from maskwright.operators import discovery as D
from maskwright.operators.rules import RuleSet
from maskwright.sources import catalog

INV = "db string, table string, column string, type string, view boolean, generated boolean, type_loose boolean"


def frame(spark, cols, typ="text"):
    rows = [(("app", "t", *c) if isinstance(c, tuple) else ("app", "t", c, typ)) + (False, False, False) for c in cols]
    return spark.createDataFrame(rows, INV)


def names(df):
    return {r["pattern"].split(".", 2)[2] for r in df.collect()}


# Fixed facts: what a column name alone says.
PERSONAL = """email prenom voornaam telefoon street_name EmailAddress recipientName customer_name nom_client last_name
lastname achternaam Nachname apellido mail_address courriel gsm mobile_number city iban niss national_id
rijksregisternummer client_ip card_number password_hash phone_num tel_num card_num account_num card_no account_nr
mobile_num mail e_mail e-mail login username nickname pseudo handle birth_name""".split()
NEUTRAL = """id status table_name file_name template_name mail_id postal_handling_id created_at email_id
email_verified_at nombre_lignes phone_type login_count""".split()
QUASI = """birth_date dob date_naissance geboortedatum geburtsdatum zip_code postcode postal_code code_postal plz gender
sex sexe geslacht geschlecht lat lng latitude longitude notes comment bio""".split()
NOT_QUASI = "id email birth_date_verified zip_code_id status mail_id login_count template_name file_name".split()


def test_names(spark):
    df = frame(spark, PERSONAL + NEUTRAL + QUASI)
    assert names(D.propose(df)) == set(PERSONAL)
    assert names(D.propose_quasi(frame(spark, QUASI + NOT_QUASI, "varchar"))) == set(QUASI)
    assert not names(D.propose(df)) & names(D.propose_quasi(df))


def test_types(spark):
    typed = [("origin", "cidr"), ("ip_address", "inet"), ("scan_pdf", "bytea"), ("checksum", "varbinary(32)"), ("login", "VARCHAR(150)")]
    typed += [("last_login", t) for t in ("timestamp", "DATETIME", "Date", "timestamp with time zone", "TIMESTAMPTZ")]
    assert names(D.propose(frame(spark, typed))) == {"origin", "ip_address", "scan_pdf", "login"}


def test_names_that_break_the_syntax(spark):
    df = spark.createDataFrame([("my.db", "t", "email", "text", False, False, False)], INV)
    assert D.propose(df).first()["pattern"] == "*.t.email"


def test_name_candidates(spark):
    rows = [
        ("public", "customers", "name", "text", False, False, False),
        ("public", "customers", "email", "text", False, False, False),
        ("public", "customers", "status", "text", False, False, False),
        ("public", "products", "name", "character varying(80)", False, False, False),
        ("public", "v_customers", "name", "text", True, False, False),
        ("public", "codes", "name", "integer", False, False, False),
        ("public", "tags", "name", "text[]", False, False, False),
        ("main", "people", "nom", "", False, False, True),
    ]
    got = [f"{r['table']}.{r['column']}" for r in D.name_candidates(spark.createDataFrame(rows, INV)).collect()]
    assert sorted(got) == ["customers.name", "people.nom", "products.name"]


@pytest.mark.parametrize(
    "values, person",
    [
        (["Alice Dupont", "Bob Martin", "Chloé Lambert"], True),
        (["Jean-Pierre de la Tour", "Anna O'Brien"], True),
        (["Laptop Pro 14", "USB-C Hub"], False),
        (["admin", "editor"], False),
        (["Namur", "Liège", "Gent"], False),
        (["urgent", "billing"], False),
        ([], False),
    ],
)
def test_name_samples(spark, values, person):
    cand = spark.createDataFrame([("p", "t", "name", "text", False, False, False)], INV)
    samples = spark.createDataFrame([("p", "t", "name", v) for v in values], "db string, table string, column string, value string")
    assert D.propose_name(cand, samples).count() == int(person)


def test_bootstrap_leaves_decided_columns(spark):
    inv = frame(spark, ["email", "name", "zip_code", "mail", "gender"])
    samples = spark.createDataFrame([("app", "t", "name", "Bob Martin")], "db string, table string, column string, value string")
    mask, quasi = D.bootstrap(inv, samples, RuleSet.of(["*.*.mail"], allow=["app.t.gender"]))
    assert names(mask) == {"email", "name"} and names(quasi) == {"zip_code"}


def test_scan_and_catalogue(spark):
    df = spark.createDataFrame([(1, "a@b.cd e@f.gh", ["+32 475 12 34 56"]), (2, None, None), (3, "x@y.zz", [])], "id int, note string, tags array<string>")
    got = {(r["column"], r["detector"]): (r["cell_hits"], r["row_hits"]) for r in D.scan_content(df, "t", ("email", "phone")).collect()}
    assert got == {("note", "email"): (3, 2), ("note", "phone"): (0, 0), ("tags", "email"): (0, 0), ("tags", "phone"): (1, 1), ("id", "phone"): (0, 0)}
    inv = catalog.column_inventory(spark, {"t": df}, "app").collect()
    assert [(r["column"], r["type"]) for r in inv] == [("id", "int"), ("note", "string"), ("tags", "array<string>")]
    desc = {r["column"]: (r["row_count"], r["null_count"], r["mode"]) for r in catalog.describe_table(df, "app", "t", RuleSet.of(["*.*.note"])).collect()}
    assert desc == {"id": (3, 0, None), "note": (3, 1, "redact"), "tags": (3, 1, None)}


def test_samples_are_bounded_and_limited_before_the_shuffle(spark):
    df = spark.range(5000).selectExpr("cast(id as string) a", "repeat('x', 400) b", "cast(null as string) c")
    got = catalog.sample_columns(df, ["a", "b", "c"])
    counts = {r["column"]: r["count"] for r in got.groupBy("column").count().collect()}
    assert counts == {"a": 20, "b": 20}
    assert got.selectExpr("max(char_length(value))").first()[0] == 256
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
