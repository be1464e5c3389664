"""Personal data by boosted trees over candidate spans.

Generators with high recall propose spans, which may overlap: e-mail
addresses (also "name (at) host"), dotted quads, runs of 13 to 19 digits,
telephone numbers with and without a plus. Those of a strict pattern are
checked (parts at most 255, Luhn digit, number of digits) and make the base.
All have features of format and context. Gradient-boosted trees learn from
them what the accepted look like; a threshold for each kind, the lowest at
which 95 in 100 of the strict candidates above it were accepted, selects
further spans that overlap none of the base.

All of it is DataFrame expressions: spans are arrays within a row, so there
is no shuffle but the one that counts candidates by features. That table has
at most as many rows as the features have combinations, whatever the corpus;
the trees are fitted on it in the driver and come back as expressions.

Positions are code points, the end exclusive. Null texts are empty; a null
identifier and repeated rows stay. Without candidates, or an empty table,
nothing is selected. Only the two named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import hold, quoted, whole_text

KINDS = ("email", "ip", "card", "phone")
# Strict patterns. A match starts where the one before ended or where no character of the class precedes, so a
# run is tried once; card and ip match at whole runs of digits, where the plain patterns match too.
LOCAL = "[A-Za-z0-9._%+-]"
STRICT = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++){{1,8}}",
    "phone": r"(?<![0-9+])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
}
CONTEXT = r"(?i)(tel|phone|fax|call|mail|contact|write|card|visa|pay|host|server|addr)"
FEATURES = ("digits", "marks", "size", "left", "right", "named", "opens")
SPAN = "array<struct<kind:int,start:long,stop:long,strict:boolean,base:boolean,digits:int,marks:int,size:int,left:int,right:int,named:int,opens:int>>"


def _hint(kind: str, text: Column) -> Column:
    """A cheap test that lets no text with a match through unseen."""
    return {
        "email": text.contains("@"),
        "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
        "phone": text.contains("+"),
    }[kind]


def _loose_hint(kind: str, text: Column) -> Column:
    return {"email": text.contains("(at)") | text.contains("[at]"), "phone": text.rlike(r"[0-9][ .-][0-9]{3,4}[ .-][0-9]{3}")}[kind]


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i):
        d = F.substring(digits, i.cast("int"), F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda s, x: s + x) % 10 == 0


def _octet(part: Column) -> Column:
    left = F.ltrim(part, F.lit("0"))
    return F.when(F.length(left) <= 3, F.concat(F.lit("0"), left).cast("int") <= 255).otherwise(False)


def _accepted(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), _octet)
    digits = _digits(match)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


def _class(char: Column) -> Column:
    return F.when((char == "") | char.rlike(r"\s"), 0).when(char.rlike("[0-9]"), 2).when(char.rlike(r"\p{L}"), 1).otherwise(3)


def candidates(text: Column, kind: str, strict: bool) -> Column:
    """The matches in one text, in order, with features: pieces between matches tell where they are."""
    pattern = STRICT[kind] if strict else LOOSE[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(F.split(text, pattern, -1), matches, lambda p, m: F.struct(p.alias("p"), m.alias("m"))), lambda x: x["m"].isNotNull())
    empty = F.array().cast(SPAN)

    def add(done, x):
        start = done["at"] + F.char_length(x["p"])
        stop = start + F.char_length(x["m"])
        before = F.right(x["p"], F.lit(24))
        n = F.length(_digits(x["m"]))
        span = F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            start.alias("start"),
            stop.alias("stop"),
            F.lit(strict).alias("strict"),
            (_accepted(kind, x["m"]) if strict else F.lit(False)).alias("base"),
            F.least(n, F.lit(20)).alias("digits"),
            F.least(F.length(F.regexp_replace(x["m"], "[A-Za-z0-9]", "")), F.lit(6)).alias("marks"),
            F.least(F.floor(F.char_length(x["m"]) / 4), F.lit(8)).cast("int").alias("size"),
            _class(F.right(before, F.lit(1))).alias("left"),
            _class(F.substring(text, (stop + 1).cast("int"), F.lit(1))).alias("right"),
            before.rlike(CONTEXT).cast("int").alias("named"),
            F.when(x["m"].startswith("+"), 1).when(x["m"].startswith("("), 2).otherwise(0).alias("opens"),
        )
        return F.struct(stop.alias("at"), F.concat(done["spans"], F.array(span)).cast(SPAN).alias("spans"))

    found = F.aggregate(pairs, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")), add, lambda done: done["spans"])
    return F.when((_hint if strict else _loose_hint)(kind, text), found).otherwise(empty)


# --- boosted trees on counts ---------------------------------------------------------------------


def _best_split(rows, gradient, curvature):
    best = (1e-9, None, None)
    g_all, h_all = sum(gradient), sum(curvature)
    for f in FEATURES:
        by = {}
        for r, g, h in zip(rows, gradient, curvature):
            old = by.get(r[f], (0.0, 0.0))
            by[r[f]] = (old[0] + g, old[1] + h)
        g = h = 0.0
        for value in sorted(by)[:-1]:
            g, h = g + by[value][0], h + by[value][1]
            gain = g * g / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all * g_all / (h_all + 1)
            if gain > best[0]:
                best = (gain, f, value)
    return best[1:]


def _tree(rows, gradient, curvature, depth, rate):
    """("leaf", value) or (feature, at most, tree, tree)."""
    f, value = _best_split(rows, gradient, curvature) if depth else (None, None)
    if f is None:
        return "leaf", rate * sum(gradient) / (sum(curvature) + 1)
    sides = [[i for i, r in enumerate(rows) if (r[f] <= value) == low] for low in (True, False)]
    return f, value, *(_tree([rows[i] for i in s], [gradient[i] for i in s], [curvature[i] for i in s], depth - 1, rate) for s in sides)


def _leaf(tree, row):
    while tree[0] != "leaf":
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[1]


def boost(rows: list[dict], rounds: int = 20, depth: int = 2, rate: float = 0.3) -> tuple[float, list]:
    """(start, trees) for rows of features with ``n`` candidates, ``yes`` of them accepted: logistic loss, Newton steps."""
    n, yes = sum(r["n"] for r in rows), sum(r["yes"] for r in rows)
    start, trees = math.log((yes + 1) / (n - yes + 1)), []
    z = [start] * len(rows)
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-x)) for x in z]
        tree = _tree(rows, [r["yes"] - r["n"] * q for r, q in zip(rows, p)], [r["n"] * q * (1 - q) for r, q in zip(rows, p)], depth, rate)
        trees.append(tree)
        z = [x + _leaf(tree, r) for x, r in zip(z, rows)]
    return start, trees


def threshold(rows: list[dict], model: tuple[float, list], precision: float) -> float | None:
    """The lowest score at which ``precision`` of the candidates at or above it were accepted."""
    scored = sorted(((model[0] + sum(_leaf(t, r) for t in model[1]), r) for r in rows), key=lambda x: -x[0])
    n = yes = 0
    best = None
    for i, (z, r) in enumerate(scored):
        n, yes = n + r["n"], yes + r["yes"]
        if yes >= precision * n and (i + 1 == len(scored) or scored[i + 1][0] < z):
            best = z
    return best


def _tree_column(tree, span: Column) -> Column:
    if tree[0] == "leaf":
        return F.lit(float(tree[1]))
    return F.when(span[tree[0]] <= tree[1], _tree_column(tree[2], span)).otherwise(_tree_column(tree[3], span))


def fit(found: DataFrame, precision: float) -> dict[int, tuple[tuple[float, list], float]]:
    """By kind: the model and its threshold, from all strict candidates. Kinds without a threshold are absent."""
    spans = found.select(F.explode("spans").alias("s")).where("s.strict").select("s.*")
    counted = spans.groupBy("kind", *FEATURES).agg(F.count("*").alias("n"), F.sum(F.col("base").cast("long")).alias("yes")).collect()
    models = {}
    for kind in range(len(KINDS)):
        rows = sorted((r.asDict() for r in counted if r["kind"] == kind), key=lambda r: [r[f] for f in FEATURES])
        if rows:
            model = boost(rows)
            if (at := threshold(rows, model, precision)) is not None:
                models[kind] = model, at
    return models


def _text_of(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    parts = F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(parts, ",")


def find_private(docs: DataFrame, precision: float = 0.95, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, and arrays of spans (kind, start, stop, features), sorted: base, spans (base and selected)."""
    read = docs.select(F.col(quoted(id)).alias("doc_id"), whole_text(text).alias("text"))
    t = F.col("text")
    found = read.select("doc_id", F.concat(*[candidates(t, k, True) for k in KINDS], *[candidates(t, k, False) for k in LOOSE]).alias("spans"))
    found = hold(found, "candidates")
    models = fit(found, precision)

    def selected(s):
        out = F.lit(False)
        for kind, ((start, trees), at) in models.items():
            score = F.lit(float(start))
            for tree in trees:
                score = score + _tree_column(tree, s)
            out = F.when(s["kind"] == kind, score >= at - 1e-9).otherwise(out)
        return out

    base = F.filter("spans", lambda s: s["base"])
    rows = found.select("doc_id", "spans", base.alias("base"))
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    more = F.filter("spans", lambda s: ~s["base"] & free(s) & selected(s))
    return rows.select("doc_id", F.sort_array("base").alias("base"), F.sort_array(F.concat("base", more)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of the base, all spans as text."""

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(F.col("spans")).alias("spans"))
