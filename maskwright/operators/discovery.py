"""Discovery of personal data: by column name and type, by samples, by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions import detectors as det
from maskwright.functions.masks import holds_text
from maskwright.operators.rules import RuleSet, resolve_modes

# Words of column names that mean personal data, in English,
# French, Dutch, German and Spanish.
PERSONAL_WORDS = """
email mail courriel correo emailaddress mailaddress
firstname prenom voornaam vorname nombres lastname surname familyname achternaam nachname apellido apellidos
fullname maidenname birthname username login nickname pseudo handle
phone telephone telefoon telefon telefono tel gsm mobile mobiel handynummer portable fax
street straat strasse rue calle address adresse adres anschrift direccion
city ville stad stadt ciudad woonplaats gemeente
iban bic niss nir bsn ssn dni nif rijksregisternummer passport passeport paspoort reisepass
password passwd passwort wachtwoord ip ipaddress
""".split()
# Word pairs that mean personal data, in either order.
PERSONAL_PAIRS = """
card number|card num|card no|card nr|account number|account num|account no|account nr|account holder
national id|national number|national register|social security|identity card|license number|licence number
tax number|vat number|e mail|ip address|client ip|user agent
""".replace("\n", "|").strip("|").split("|")
# Words for a name, and the words that make it a person's.
NAME_WORDS = "name nom naam nome nombre noms names".split()
PERSON_WORDS = """
first last full middle maiden birth family given user customer client recipient sender contact owner person
patient employee member guest author buyer seller holder display legal beneficiary
klant kunde kunden cliente gebruiker empleado persona personne personnel
""".split()
# A name that ends with one of these describes the value, it does not hold it.
META_WORDS = """
id ids type types count counts at verified status flag enabled format template length valid verification
lignes lines handling domain provider opt optin confirmed date time
""".split()
# Words of quasi-identifiers, and pairs of them.
QUASI_WORDS = """
dob birthdate birthday geboortedatum geburtsdatum naissance nacimiento zip zipcode postcode postalcode plz codepostal
gender sex sexe geslacht geschlecht sexo genero lat lng lon latitude longitude
note notes comment comments commentaire opmerking bemerkung bio biography remarks
""".split()
QUASI_PAIRS = "birth date|date birth|date naissance|zip code|postal code|code postal|post code".split("|")
# Words of binary columns that hold a document about a person.
DOCUMENT_WORDS = "scan pdf document photo picture passport signature selfie portrait cv resume attachment".split()

DATE_TYPES = r"^(date|time|timestamp|datetime|timestamptz|timetz|interval|year)"
BINARY_TYPES = r"binary|blob|bytea|^bytes"
ADDRESS_TYPES = r"^(inet|cidr)"
TEXT_TYPES = r"char|text|clob|string"
PERSON_NAME = r"^\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)*(?: (?:de|du|van|von|der|den|la|le|di|\p{Lu}\.|(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)*)){1,4}\z"
NAME_SHARE = 0.6
SCAN_SCHEMA = "table string, column string, detector string, cell_hits bigint, row_hits bigint"


def name_tokens(c: Column) -> Column:
    """The lower-case words of a column name: snake case, camel case, dashes; accents dropped."""
    parted = F.regexp_replace(c, r"(\p{Ll}|\d)(\p{Lu})", "$1_$2")
    plain = F.translate(F.lower(parted), "àâäáãçéèêëíìîïñóòôöõúùûüß", "aaaaaceeeeiiiinooooouuuus")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _pairs(tokens: Column) -> Column:
    """Neighbouring words, and what they make written as one."""
    n = F.size(tokens)
    idx = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda i: F.concat(F.get(tokens, i), F.lit(" "), F.get(tokens, i + 1)))


def _some(items: Column, words: list[str]) -> Column:
    return F.exists(items, lambda w: w.isin(words))


def _joined(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: F.replace(p, F.lit(" "), F.lit("")))


def _described(inventory: DataFrame) -> DataFrame:
    """The inventory with its words (_w), pairs (_p) and lower-case type (_t)."""
    return (
        inventory.withColumn("_w", name_tokens(F.col("column")))
        .withColumn("_p", _pairs(F.col("_w")))
        .withColumn("_t", F.lower(F.trim(F.coalesce("type", F.lit("")))))
    )


def _personal() -> Column:
    w, p, t = F.col("_w"), F.col("_p"), F.col("_t")
    meta = F.element_at(w, -1).isin(META_WORDS)
    pair = _some(p, PERSONAL_PAIRS)
    word = _some(w, PERSONAL_WORDS) | _some(_joined(p), PERSONAL_WORDS)
    person = _some(w, NAME_WORDS) & _some(w, PERSON_WORDS)
    named = (F.size(w) > 0) & (pair | (~meta & (word | person)))
    return (
        F.when(F.rlike(t, F.lit(ADDRESS_TYPES)), F.lit(True))
        .when(F.rlike(t, F.lit(DATE_TYPES)), F.lit(False))
        .when(F.rlike(t, F.lit(BINARY_TYPES)), _some(w, DOCUMENT_WORDS))
        .otherwise(named)
    )


def _quasi() -> Column:
    w, p = F.col("_w"), F.col("_p")
    pair = _some(p, QUASI_PAIRS) & _some(F.slice(p, -1, 1), QUASI_PAIRS)
    meta = F.element_at(w, -1).isin([x for x in META_WORDS if x != "date"])
    return (F.size(w) > 0) & (pair | (~meta & _some(w, QUASI_WORDS)))


def pattern_segment(c: Column) -> Column:
    """A name as a pattern segment; one that would break the syntax becomes *."""
    return F.when(F.rlike(c, F.lit(r"""^\z|[*. \t\r\n"'`]""")), F.lit("*")).otherwise(c)


def _pattern() -> Column:
    return F.concat_ws(".", *[pattern_segment(F.col(c)) for c in ("db", "table", "column")])


def propose(inventory: DataFrame) -> DataFrame:
    """Mask patterns for the columns whose name or type means personal data."""
    return _described(inventory).where(_personal()).select(_pattern().alias("pattern")).distinct()


def propose_quasi(inventory: DataFrame) -> DataFrame:
    """Patterns of quasi-identifiers: birth date, postal code, gender, coordinates, free text."""
    return _described(inventory).where(~_personal() & _quasi()).select(_pattern().alias("pattern")).distinct()


def name_candidates(inventory: DataFrame) -> DataFrame:
    """Text columns of base tables whose name is just "name", not already proposed."""
    text = F.col("type_loose") | (F.rlike("_t", F.lit(TEXT_TYPES)) & ~F.endswith("_t", F.lit("[]")))
    just_name = F.exists("_w", lambda w: w.isin(NAME_WORDS)) & (F.size("_w") == 1)
    return (
        _described(inventory)
        .where(~F.col("view") & ~F.col("generated") & text & just_name & ~_personal())
        .select(*inventory.columns)
    )


def name_score(samples: DataFrame, keys=("db", "table", "column")) -> DataFrame:
    """The share of sampled values per column that read as first and last name."""
    person = F.rlike(F.trim("value"), F.lit(PERSON_NAME)).cast("int")
    return samples.groupBy(*keys).agg(F.count("value").alias("n"), F.sum(person).alias("persons"))


def propose_name(candidates: DataFrame, samples: DataFrame) -> DataFrame:
    """Patterns of the candidates whose sampled values are person names."""
    keys = ["db", "table", "column"]
    sure = name_score(samples).where(F.col("persons") >= F.col("n") * NAME_SHARE).where("n > 0")
    return candidates.join(sure, keys, "left_semi").select(_pattern().alias("pattern")).distinct()


def scan_content(df: DataFrame, table: str, names=det.DEFAULT_DETECTORS, numbers: bool = True) -> DataFrame:
    """Values and rows hit per column and detector. One pass, partial sums only travel."""
    texts, digits = {}, {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            texts[f.name] = c
        elif holds_text(f.dataType):
            texts[f.name] = F.to_json(c)
        elif numbers and isinstance(f.dataType, (T.IntegralType, T.FractionalType)):
            digits[f.name] = det.integral_text(c, isinstance(f.dataType, T.FractionalType))
    every = det.detectors(names)
    kinds = {"_texts": (texts, every), "_digits": (digits, [d for d in every if d.digits])}
    kinds = {k: (cols, use) for k, (cols, use) in kinds.items() if cols and use}
    if not kinds:
        return df.sparkSession.createDataFrame([], SCAN_SCHEMA)

    def counts(use):
        # The detectors are written once, for the cells of a row as an array.
        found = lambda t, d: F.greatest(F.coalesce(F.size(det.find(d.name, t)), F.lit(0)), F.lit(0))
        return lambda t: F.array(*[found(t, d) for d in use])

    counted = df.select(*[F.transform(F.array(*cols.values()), counts(use)).alias(k) for k, (cols, use) in kinds.items()])
    aggs, items = [], []
    for k, (cols, use) in kinds.items():
        for i, column in enumerate(cols):
            for j, d in enumerate(use):
                n = F.col(k)[i][j]
                aggs += [F.sum(n).alias(f"c{k}_{i}_{j}"), F.count_if(n > 0).alias(f"r{k}_{i}_{j}")]
                items.append(
                    F.struct(
                        F.lit(table).alias("table"),
                        F.lit(column).alias("column"),
                        F.lit(d.name).alias("detector"),
                        F.coalesce(F.col(f"c{k}_{i}_{j}"), F.lit(0)).cast("bigint").alias("cell_hits"),
                        F.col(f"r{k}_{i}_{j}").alias("row_hits"),
                    )
                )
    return counted.agg(*aggs).select(F.inline(F.array(*items)))


def bootstrap(inventory: DataFrame, samples: DataFrame, rules: RuleSet) -> tuple[DataFrame, DataFrame]:
    """Patterns to mask and quasi-identifiers to ask about, among columns no rule covers."""
    open_cols = resolve_modes(inventory, rules).where(~F.col("covered")).select(*inventory.columns)
    found = propose(open_cols).unionByName(propose_name(name_candidates(open_cols), samples)).distinct()
    return found, propose_quasi(open_cols)
