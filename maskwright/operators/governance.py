"""Grants, budgets, privileges, drift and the integrity of the log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The default budget of a grant.
GRANT_DEFAULTS = {"seconds": 3600, "statements": 200, "rows": 10_000, "bytes": 1 << 20}
MIN_GRANT_BYTES = 512

# ---- drift ----


def definition_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Objects (kind, name, definition) added, removed or changed between two snapshots."""
    digest = lambda d, alias: d.select("kind", "name", F.sha2("definition", 256).alias(alias))
    both = digest(before, "old").join(digest(after, "new"), ["kind", "name"], "full_outer")
    change = (
        F.when(F.col("old").isNull(), F.lit("added"))
        .when(F.col("new").isNull(), F.lit("removed"))
        .when(F.col("old") != F.col("new"), F.lit("changed"))
    )
    return both.select("kind", "name", change.alias("change")).where("change is not null")


def stale_plans(plans: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Plans (plan_id, refs) that name an object the drift touched, with how many they name."""
    drift = definition_drift(before, after).select("name").distinct()
    refs = plans.select("plan_id", F.explode(F.array_distinct("refs")).alias("name"))
    return refs.join(drift, "name", "left_semi").groupBy("plan_id").agg(F.count(F.lit(1)).alias("changed_objects"))


# ---- grants ----


def grant_coverage(plans: DataFrame, grants: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """plans with ``grant_id``: the grant a plan may run under, or null when it must ask.

    plans: plan_id, agent, db, ts, relations, class, unmask, warnings, k_checks,
    verdict, est_rows, and if known pii_filter (a masked column is compared),
    hidden (the estimate is not shown) and steers (on a column that only the
    detectors protect). grants: grant_id, agent, db, tables, start, expires,
    statements, rows, bytes (what is left).

    A grant lies in at most two time buckets as wide as its lifetime, rounded
    up to a power of two; a plan looks in one bucket for each width there is.
    """
    second = lambda c: F.unix_seconds(c.cast("timestamp"))
    spans = grants.withColumn("_span", F.greatest(second(F.col("expires")) - second(F.col("start")), F.lit(1)))
    spans = spans.withColumn("_level", F.greatest(F.ceil(F.log2(F.col("_span") / bucket_seconds)), F.lit(0)).cast("int"))
    # A lifetime in seconds fits 63 widths.
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())
    bucket = lambda c, level: F.floor(second(c) / (F.pow(F.lit(2.0), level) * bucket_seconds))
    active = spans.select(
        "grant_id",
        "agent",
        "db",
        "tables",
        F.col("start").alias("_start"),
        F.col("expires").alias("_expires"),
        F.col("statements").alias("_statements"),
        F.col("rows").alias("_rows"),
        F.col("bytes").alias("_bytes"),
        "_level",
        F.explode(F.sequence(bucket(F.col("start"), F.col("_level")), bucket(F.col("expires"), F.col("_level")))).alias("_bucket"),
    ).where("_expires > _start")
    grantable = (
        (F.col("class") == "read")
        & ~F.col("unmask")
        & (F.col("warnings") == 0)
        & (F.col("k_checks") == 0)
        & (F.col("verdict") != "REFUSE")
        & (F.size("relations") > 0)
    )
    for flag in ("pii_filter", "hidden", "steers"):
        if flag in plans.columns:
            grantable = grantable & ~F.coalesce(F.col(flag), F.lit(False))
    candidates = (
        plans.where(grantable)
        .select("plan_id", "agent", "db", "ts", "relations", "est_rows", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")).alias("_level"))
        .withColumn("_bucket", bucket(F.col("ts"), F.col("_level")))
        .join(active, ["agent", "db", "_level", "_bucket"])
        .where((F.col("ts") >= F.col("_start")) & (F.col("ts") < F.col("_expires")))
        .where(F.size(F.array_except("relations", "tables")) == 0)
    )
    enough = (
        (F.col("_statements") >= 1)
        & (F.col("_rows") >= 1)
        & (F.col("_bytes") >= MIN_GRANT_BYTES)
        & (F.col("est_rows") <= F.col("_rows"))
    )
    # Only the first grant that covers the relations counts: if its budget is short, the plan asks.
    first = candidates.groupBy("plan_id").agg(
        F.min_by(F.struct("grant_id", enough.alias("ok")), F.struct("_start", "grant_id")).alias("g")
    )
    granted = first.where("g.ok").select("plan_id", F.col("g.grant_id").alias("grant_id"))
    return plans.join(granted, "plan_id", "left")


def running_sums(
    df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], sums: dict[str, Column], bucket_seconds: int = 60
) -> DataFrame:
    """Running totals per key in time order, for keys of any size.

    Rows are added up inside short time buckets, the bucket totals are added
    up per key, and the two are put together: no task holds a whole key.
    """
    bucketed = df.withColumn("_b", F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / bucket_seconds))
    totals = bucketed.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_b", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, 0)
    local = bucketed.select("*", *[F.sum(c).over(inside).alias(f"_l_{n}") for n, c in sums.items()])
    joined = local.join(offsets, [*keys, "_b"])
    return joined.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def grant_ledger(runs: DataFrame, grants: DataFrame, bucket_seconds: int = 60) -> DataFrame:
    """Every run under a grant with what the grant has left after it.

    runs: run_id, grant_id, ts, rows, bytes. A run past the grant's time or
    its budget is not charged: ``end_reason`` says why, and nothing is left.
    (A spent budget stays spent, so every run before a charged one was
    charged too, and the running totals are exact for it.)
    """
    keyed = runs.join(
        grants.select(
            "grant_id",
            F.col("expires").alias("_expires"),
            F.coalesce("statements", F.lit(GRANT_DEFAULTS["statements"])).alias("_statements"),
            F.coalesce("rows", F.lit(GRANT_DEFAULTS["rows"])).alias("_rows"),
            F.coalesce("bytes", F.lit(GRANT_DEFAULTS["bytes"])).alias("_bytes"),
        ),
        "grant_id",
    )
    in_time = F.col("ts") < F.col("_expires")
    charge = lambda c: F.when(in_time, c).otherwise(0).cast("bigint")
    sums = {"used_statements": charge(F.lit(1)), "used_rows": charge(F.col("rows")), "used_bytes": charge(F.col("bytes"))}
    run = running_sums(keyed, ["grant_id"], "ts", ["run_id"], sums, bucket_seconds)
    own = lambda used, c: F.col(used) - charge(c)
    reason = (
        F.when(~in_time, F.lit("expired"))
        .when(own("used_statements", F.lit(1)) >= F.col("_statements"), F.lit("statements"))
        .when(own("used_rows", F.col("rows")) >= F.col("_rows"), F.lit("rows"))
        .when(F.col("_bytes") - own("used_bytes", F.col("bytes")) < MIN_GRANT_BYTES, F.lit("bytes"))
    )
    left = lambda total, used: F.when(reason.isNull(), F.greatest(F.lit(0), F.col(total) - F.col(used))).cast("bigint")
    return run.select(
        *runs.columns,
        left("_statements", "used_statements").alias("statements_left"),
        left("_rows", "used_rows").alias("rows_left"),
        left("_bytes", "used_bytes").alias("bytes_left"),
        reason.alias("end_reason"),
    )


# ---- decisions and privileges ----

AUTO_RANK = {"deny": 0, "ask": 1, "auto": 2}


def auto_decision(log: DataFrame, rules: dict[str, str]) -> DataFrame:
    """log (stmt_class, unmask) with ``auto_action`` and ``auto_value``; the stricter rule wins for unmask.

    ``rules`` gives deny, ask or auto for read, write, ddl and unmask.
    """
    value = lambda a: F.element_at(F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]), a)
    rank = lambda v: F.element_at(F.create_map(*[F.lit(x) for kv in AUTO_RANK.items() for x in kv]), v)
    cls = F.col("stmt_class")
    action = F.when(cls.isin("ddl", "admin"), F.lit("ddl")).when(cls == "write", F.lit("write")).otherwise(F.lit("read"))
    stricter = F.coalesce("unmask", F.lit(False)) & (rank(value(F.lit("unmask"))) <= rank(value(action)))
    chosen = F.when(stricter, F.lit("unmask")).otherwise(action)
    return log.withColumn("auto_action", chosen).withColumn("auto_value", value(F.col("auto_action")))


# What each tier may hold beyond reading; admin may hold everything.
_WRITE = ("INSERT", "UPDATE", "DELETE", "pg_write_all_data")
_DDL = ("TRUNCATE", "REFERENCES", "TRIGGER", "MAINTAIN", "CREATE", "OWNER", "CREATEDB")
TIER_PRIVILEGES = {"read": (), "write": _WRITE, "ddl": _WRITE + _DDL}


def excess_privileges(granted: DataFrame) -> DataFrame:
    """Privileges (principal, object, privilege, tier) beyond what the tier allows."""
    allowed = F.col("privilege") == "SELECT"
    for tier, names in TIER_PRIVILEGES.items():
        allowed = allowed | ((F.col("tier") == tier) & F.col("privilege").isin(*names))
    return granted.where((F.col("tier") != "admin") & ~allowed).distinct()


def rowbound_violations(runs: DataFrame, approvals: DataFrame) -> DataFrame:
    """Writes whose affected rows passed the bound of their approval (0: no bound)."""
    bounds = approvals.select("plan_id", "max_affected")
    return runs.where("class = 'write'").join(bounds, "plan_id").where(
        (F.col("max_affected") > 0) & (F.col("affected") > F.col("max_affected"))
    )


# ---- log chain ----

GENESIS = "0" * 64


def chain_links(log: DataFrame) -> DataFrame:
    """Every line (file, seq, line) with ``link``: ok, break, genesis or legacy.

    A line is chained by prev_hash, the sha256 of the whole line before it.
    Neighbours meet by (file, seq), so a long file is no single task.
    """
    stated = F.get_json_object("line", "$.prev_hash")
    current = log.select("file", "seq", stated.alias("prev_hash"))
    before = log.select("file", (F.col("seq") + 1).alias("seq"), F.sha2("line", 256).alias("actual"))
    joined = current.join(before, ["file", "seq"], "left")
    link = (
        F.when(F.col("prev_hash").isNull(), F.lit("legacy"))
        .when(F.col("actual").isNull() & (F.col("prev_hash") == GENESIS), F.lit("genesis"))
        .when(F.coalesce(F.col("prev_hash") == F.col("actual"), F.lit(False)), F.lit("ok"))
        .otherwise(F.lit("break"))
    )
    return joined.select("file", "seq", link.alias("link"))


def verify_chain(log: DataFrame) -> DataFrame:
    """Per file: records, breaks, genesis and legacy lines."""
    is_ = lambda v: F.count_if(F.col("link") == v)
    return (
        chain_links(log)
        .groupBy("file")
        .agg(
            F.count(F.lit(1)).alias("records"),
            is_("break").alias("breaks"),
            is_("genesis").alias("genesis"),
            is_("legacy").alias("legacy"),
            F.min(F.when(F.col("link") == "break", F.col("seq"))).alias("first_break"),
        )
    )
