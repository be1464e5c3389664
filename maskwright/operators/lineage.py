"""Sensitivity over column lineage, and the usage rules of logged column uses.

edges: dst, src, kind (const, count, identity, aggregate, expr), literal.
Column names are ``db.table.column``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.operators.rules import RuleSet, resolve_modes
from maskwright.plans.provenance import Kind
from maskwright.session import cut_lineage

# Mask modes as bits, so that a union of modes is a bitwise or.
MODE_BITS = {"redact": 1, "partial": 2, "email": 4}


def _kind(c: Column) -> Column:
    out = F.lit(int(Kind.EXPR))
    for k in Kind:
        out = F.when(c == k.name.lower(), int(k)).otherwise(out)
    return out


def column_parts(name: Column) -> list[Column]:
    parts = F.split(name, r"\.", 3)
    return [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("db", "table", "column"))]


def modes_of(names: DataFrame, rules: RuleSet, column: str = "node") -> DataFrame:
    """names with the mask mode of each column name (null: none) and whether a rule allows it."""
    parted = names.select("*", *column_parts(F.col(column)))
    return resolve_modes(parted, rules).drop("db", "table", "column", "covered")


def _flow(edges_state: DataFrame) -> DataFrame:
    """What each source value hands to its destination, merged per destination."""
    edge, kind, modes = F.col("ekind"), F.col("kind"), F.col("modes")
    passes = edge >= int(Kind.IDENTITY)
    out_kind = (
        F.when(edge == int(Kind.CONST), int(Kind.CONST))
        .when(edge == int(Kind.COUNT), int(Kind.COUNT))
        .when(edge == int(Kind.IDENTITY), kind)
        .when(kind == int(Kind.CONST), kind)
        .otherwise(F.greatest(kind, edge))
    )
    return edges_state.groupBy(F.col("dst").alias("node")).agg(
        F.max(out_kind).alias("kind"),
        F.bit_or(F.when(passes, modes).otherwise(0)).alias("modes"),
        F.bool_or(F.col("literal") | (F.col("lit") & passes) | (edge == int(Kind.CONST))).alias("lit"),
    )


def propagate(edges: DataFrame, rules: RuleSet) -> DataFrame:
    """Kind, modes and mask of every column of a lineage graph, to the fixpoint.

    Each round carries on only the columns whose state changed: node, kind,
    modes (bits), lit, mask. Columns no edge leads to are base columns. A
    state only ever grows in its lattice, so the rounds end by themselves;
    changes are appended, and a column's state is the union of its changes.
    """
    # Parallel edges say the same: each is kept once before the rounds.
    edges = cut_lineage(
        edges.select(
            "dst", "src", _kind(F.col("kind")).alias("ekind"), F.coalesce("literal", F.lit(False)).alias("literal")
        ).distinct()
    )
    nodes = edges.select(F.col("src").alias("node")).distinct()
    base = nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    bits = F.coalesce(*[F.when(F.col("mode") == m, b) for m, b in MODE_BITS.items()], F.lit(0))
    base = modes_of(base, rules).select(
        "node", F.lit(int(Kind.IDENTITY)).alias("kind"), bits.alias("modes"), F.lit(False).alias("lit")
    )
    changes = frontier = cut_lineage(base)
    while not frontier.isEmpty():
        # AQE sends a small frontier to the edges: only what they hand on is
        # shuffled, merged per destination first.
        new = _flow(edges.join(frontier.withColumnRenamed("node", "src"), "src")).join(
            _state(changes).select("node", F.col("kind").alias("k0"), F.col("modes").alias("m0"), F.col("lit").alias("l0")),
            "node",
            "left",
        )
        merged = new.select(
            "node",
            F.greatest("kind", F.coalesce("k0", F.lit(0))).alias("kind"),
            F.col("modes").bitwiseOR(F.coalesce("m0", F.lit(0))).alias("modes"),
            (F.col("lit") | F.coalesce("l0", F.lit(False))).alias("lit"),
            "k0",
            "m0",
            "l0",
        ).where("k0 is null or kind <> k0 or modes <> m0 or lit <> l0")
        frontier = cut_lineage(merged.drop("k0", "m0", "l0"))
        changes = changes.unionByName(frontier)
    return _state(changes).withColumn("mask", _mask())


def _state(changes: DataFrame) -> DataFrame:
    return changes.groupBy("node").agg(F.max("kind").alias("kind"), F.bit_or("modes").alias("modes"), F.bool_or("lit").alias("lit"))


def _mask() -> Column:
    single = F.lit(None).cast("string")
    for m, b in MODE_BITS.items():
        single = F.when(F.col("modes") == b, F.lit(m)).otherwise(single)
    return F.when(F.col("modes") == 0, F.lit(None).cast("string")).when(
        F.col("kind") == int(Kind.IDENTITY), F.coalesce(single, F.lit("redact"))
    ).otherwise(F.lit("redact"))


def sources(edges: DataFrame) -> DataFrame:
    """The base columns behind every column: dst, source. Pairs, never a list per column."""
    edges = cut_lineage(edges.where("kind <> 'const'").select("dst", "src").distinct())
    derived = edges.select(F.col("dst").alias("src")).distinct()
    found = frontier = cut_lineage(edges.join(derived, "src", "left_anti").select("dst", F.col("src").alias("source")))
    while not frontier.isEmpty():
        step = edges.join(frontier.withColumnRenamed("dst", "src"), "src").select("dst", "source").distinct()
        frontier = cut_lineage(step.join(found, ["dst", "source"], "left_anti"))
        found = found.unionByName(frontier)
    return found


EQUALITY = ("=", "<=>", "is not distinct from", "in", "is null")


def evaluate_uses(uses: DataFrame, rules: RuleSet) -> DataFrame:
    """uses with ``code``: the refusal the usage rules give a logged column use, or null.

    uses: statement_id, source, clause, op, positive, partner (null: a literal).
    """
    own = modes_of(uses, rules, "source").withColumnRenamed("mode", "_mode").drop("allowed")
    both = modes_of(own, rules, "partner").withColumnRenamed("mode", "_pmode").drop("allowed")
    pii, partner_pii = F.col("_mode").isNotNull(), F.col("_pmode").isNotNull()
    clause, op, partner = F.lower("clause"), F.lower("op"), F.col("partner")
    positive = F.coalesce("positive", F.lit(True))
    same = partner == F.col("source")
    filters = clause.isin("where", "having", "join")
    code = (
        F.when(~pii & ~partner_pii, F.lit(None).cast("string"))
        .when(clause.isin("order by", "partition by", "window", "distinct on"), F.when(pii, F.lit("E_MASKED_ORDER")))
        .when(clause == "write", F.when(pii, F.lit("E_MASKED_WRITE")))
        .when(
            clause == "set operation",
            F.when(partner.isNull() | ~pii | ~partner_pii, F.lit("E_MASKED_SET_OP")).when(same, F.lit("E_MASKED_FILTER")),
        )
        .when(
            filters,
            F.when(~op.isin(*EQUALITY) | ~positive, F.lit("E_MASKED_FILTER"))
            .when(partner.isNull(), F.when(clause == "join", F.lit("E_MASKED_FILTER")))
            .when(~pii | ~partner_pii | same, F.lit("E_MASKED_FILTER")),
        )
        .when(clause.isin("select", "group by") & (op == "expression"), F.when(pii, F.lit("E_MASKED_EXPRESSION")))
    )
    return both.withColumn("code", code).drop("_mode", "_pmode")


NUMBER_TYPES = """
tinyint smallint mediumint int integer bigint int2 int4 int8 serial smallserial bigserial serial2 serial4 serial8
decimal numeric dec real double float float4 float8
""".split()
OPAQUE_TYPES = "bool boolean date time timetz timestamp timestamptz datetime year interval uuid timestamp_ntz".split()


def type_class(c: Column) -> Column:
    """text, number or opaque; an unknown type is text."""
    base = F.regexp_extract(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"^([^( ]*)", 1)
    return F.when(base.isin(NUMBER_TYPES), F.lit("number")).when(base.isin(OPAQUE_TYPES), F.lit("opaque")).otherwise(F.lit("text"))


def steering_risk(uses: DataFrame, inventory: DataFrame, rules: RuleSet, names) -> DataFrame:
    """Uses that steer a result on a column only the detectors protect, with ``risk`` (its type class)."""
    steering = uses.where(~((F.lower("clause") == "select") & (F.lower("op") == "plain")))
    parted = steering.select("*", *column_parts(F.col("source")))
    known = inventory.select("db", "table", "column", "type", "view", "generated", "type_loose", F.lit(True).alias("_known"))
    joined = resolve_modes(parted, rules).join(known, ["db", "table", "column"], "left")
    # An allow rule speaks of a base column; a view's may hold anything.
    joined = joined.where(~F.col("allowed") | F.coalesce("view", F.lit(False)))
    generated = F.coalesce("generated", F.lit(False))
    cls = F.when(
        F.col("_known").isNull() | (F.coalesce("type_loose", F.lit(False)) & ~generated), F.lit("text")
    ).otherwise(type_class(F.col("type")))
    digits = any(n != "email" for n in names)
    risky = (cls == "text") | ((cls == "number") & F.lit(digits) & ~generated)
    return joined.withColumn("risk", cls).where(risky).select(*uses.columns, "risk")
