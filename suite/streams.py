"""Queries of the streams: each reads a table as a stream and drains it."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.operators.rules import RuleSet
from maskwright.session import run_dir
from maskwright.sources import audit_log
from maskwright.streaming import audit as st
from suite import query, table
from suite.derived import derive, with_sql
from suite.fragments import partial
from suite.logs import READABLE, write_log


def stream_of(spark, df, name):
    """A table written to the shared folder and read back as a stream."""
    path = run_dir(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


# An event far after all others closes the last windows and sessions.
def with_end(df, **values):
    end = df.limit(1).select(
        *[
            (values[f.name] if f.name in values else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in df.schema.fields
        ]
    )
    return df.unionByName(end)


def late():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def log_of(spark, sf, *cols):
    audit = derive(spark, sf, "audit").withColumn("ts", F.col("ts").cast("timestamp"))
    return audit.select(*cols) if cols else audit


@query(
    "a5_stream_audit",
    with_sql("audit", body=f"select event, engine, count(*) as n, cast(sum(n_rows) as bigint) as total_rows from audit where {READABLE} group by event, engine"),
)
def stream_log(spark, sf):
    events = audit_log.stream_audit(spark, write_log(spark, sf)).select("event", "engine", "rows")
    return st.drain(events, "log").groupBy("event", "engine").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("total_rows"))


@query(
    "i1_mask_stream",
    f"select c_custkey, {partial('c_name')} as c_name, '<redacted>' as c_acctbal, c_mktsegment from customer",
)
def masked(spark, sf):
    rules = RuleSet.of({"*.customer.c_name": "partial", "*.customer.c_acctbal": "redact"})
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return st.drain(st.mask_stream(stream_of(spark, customer, "customer"), "shop", "customer", rules), "masked")


@query(
    "i2_refusals_windowed",
    with_sql(
        "audit",
        body="""select strftime(time_bucket(interval '5 minutes', ts), '%Y-%m-%d %H:%M:%S') as window_start, coalesce(code, 'uncoded') as code, count(*) as n
from audit where event = 'refused' group by 1, 2""",
    ),
)
def windowed(spark, sf):
    log = with_end(log_of(spark, sf, "event", "code", "ts"), event=F.lit("refused"), ts=late())
    out = st.drain(st.refusals_windowed(stream_of(spark, log, "events")), "refusals")
    return out.where(F.col("window_start") < late()).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "code", "n"
    )


@query(
    "i3_rate_limited",
    with_sql(
        "audit",
        body="""select strftime(w, '%Y-%m-%d %H:%M:%S') as window_start, agent, count(*) as tickets
from (select agent, ts, time_bucket(interval '1 hour', ts) - to_hours(k) as w from audit, (select unnest(range(0, 12)) as k) r) q
where ts >= w and ts < w + interval '12 hours' group by w, agent having count(*) > 4""",
    ),
)
def rate(spark, sf):
    log = with_end(log_of(spark, sf, "agent", "ts"), agent=F.lit("end"), ts=late())
    out = st.drain(st.rate_limited(stream_of(spark, log, "events"), n=4, width="12 hours", slide="1 hour"), "rate")
    return out.where("agent <> 'end'").select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "agent", "tickets")


IDLE = """
, g as (select agent, ts, case when ts - lag(ts) over (partition by agent order by ts) < interval '6 hours' then 0 else 1 end as fresh from audit),
s as (select *, sum(fresh) over (partition by agent order by ts) as no from g)
select agent, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start, strftime(max(ts) + interval '6 hours', '%Y-%m-%d %H:%M:%S') as session_end, count(*) as events
from s group by agent, no"""


@query("i4_idle_sessions", with_sql("audit", body=IDLE))
def idle(spark, sf):
    log = with_end(log_of(spark, sf, "agent", "ts"), agent=F.lit("end"), ts=late())
    out = st.drain(st.idle_sessions(stream_of(spark, log, "events"), idle="6 hours"), "sessions")
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.where("agent <> 'end'").select("agent", fmt("session_start"), fmt("session_end"), "events")


LONGEST = """
, e as (select agent, cast(epoch(date_trunc('second', ts)) as bigint) as s, count(*) as n from audit group by 1, 2),
o as (select *, row_number() over (partition by agent order by s) as k from e),
walk as (
  select agent, k, s as start, s as last, n as events, false as fresh from o where k = 1
  union all
  select o.agent, o.k, case when o.s - w.last >= 21600 or o.s - w.start >= 43200 then o.s else w.start end, o.s,
    case when o.s - w.last >= 21600 or o.s - w.start >= 43200 then o.n else w.events + o.n end, o.s - w.last >= 21600 or o.s - w.start >= 43200
  from walk w join o on o.agent = w.agent and o.k = w.k + 1)
select agent, strftime(to_timestamp(start) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as session_start, strftime(to_timestamp(max(last)) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as last_seen, cast(max(events) as bigint) as events
from walk group by agent, start"""


@query("i4_sessions", with_sql("audit", body=LONGEST).replace("with audit", "with recursive audit", 1))
def sessions(spark, sf):
    log = with_end(log_of(spark, sf, "agent", "ts"), agent=F.lit("end"), ts=late())
    out = st.drain(st.sessions(stream_of(spark, log, "events"), idle="6 hours", max_session="12 hours"), "sessions")
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.where("agent <> 'end'").select("agent", fmt("session_start"), fmt("last_seen"), "events")


BUDGETS = """
, t as (select r.grant_id, r.run_id, r."rows", r.bytes, cast(epoch(date_trunc('second', r.ts)) as bigint) as sec, cast(epoch(date_trunc('second', g.expires)) as bigint) as ex, g.statements as gs, g."rows" as gr, g.bytes as gb from runs r join grants g using (grant_id)),
s as (select *, row_number() over w as k, lag(sec) over w as prev, sum("rows") over w - "rows" as ur, sum(bytes) over w - bytes as ub from t window w as (partition by grant_id order by sec, run_id rows unbounded preceding)),
q as (select *, case when sec >= ex then 'expired' when prev is not null and sec - prev >= 36000 then 'idle' when gs - (k - 1) < 1 or gr - ur < 1 or gb - ub < 512 then 'budget' end as why from s),
f as (select grant_id, min(k) filter (where why is not null) as stop from q group by grant_id),
u as (select q.grant_id, count(*) filter (where f.stop is null or k < f.stop) as statements, coalesce(sum("rows") filter (where f.stop is null or k < f.stop), 0) as r, coalesce(sum(bytes) filter (where f.stop is null or k < f.stop), 0) as b,
    max(why) filter (where k = f.stop) as why, max(case when f.stop is null or k < f.stop then sec end) as last, min(sec) as first, max(ex) as ex
  from q join f using (grant_id) group by q.grant_id)
select grant_id, statements, cast(r as bigint) as "rows", cast(b as bigint) as bytes, coalesce(why, case when ex <= coalesce(last, first) + 36000 then 'expired' else 'idle' end) as end_reason from u"""


@query("i5_grant_state", with_sql("runs", "grants", body=BUDGETS))
def budgets(spark, sf):
    runs = derive(spark, sf, "runs").withColumn("ts", F.col("ts").cast("timestamp"))
    grants = derive(spark, sf, "grants").select("grant_id", "expires", "statements", "rows", "bytes")
    # A closing run under a grant of its own lets the timers of the others fire.
    runs = with_end(runs, run_id=F.lit("end"), grant_id=F.lit("end"), ts=late(), rows=F.lit(0).cast("bigint"), bytes=F.lit(0).cast("bigint"))
    grants = with_end(grants, grant_id=F.lit("end"), expires=late().cast("timestamp_ntz"), statements=F.lit(9).cast("bigint"), rows=F.lit(9).cast("bigint"), bytes=F.lit(9999).cast("bigint"))
    out = st.drain(st.grant_state(stream_of(spark, runs, "runs"), grants, idle="10 hours"), "budgets")
    return out.where("grant_id <> 'end'")


@query("i6_dedupe_events", with_sql("audit", body="select event, count(*) as n from audit group by event"))
def dedupe(spark, sf):
    log = log_of(spark, sf, "event_id", "event", "ts")
    twice = log.unionAll(log.where("event_id % 3 = 0"))
    return st.drain(st.dedupe_events(stream_of(spark, twice, "events"), ["event_id"], "40 days"), "events").groupBy("event").agg(
        F.count(F.lit(1)).alias("n")
    )


PAIRS = """select a.event_id as plan_id, b.event_id as run_id, cast(epoch_us(b.ts) - epoch_us(a.ts) as bigint) as waited_us from {events} a join {events} b on b.event_id = a.event_id + 1
where a.event_id % 2 = 0 and b.ts <= a.ts + interval '10 minutes'"""


@query("i7_pair_runs", PAIRS.replace("{events}", "events"))
def pair(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    plans = events.where("event_id % 2 = 0").select(F.col("event_id").alias("plan_id"), "ts")
    runs = events.where("event_id % 2 = 1").select((F.col("event_id") - 1).alias("plan_id"), F.col("event_id").alias("run_id"), "ts")
    # Every run comes again a second later under another name: the earlier one stays.
    twice = runs.unionAll(runs.select("plan_id", (-F.col("run_id")).alias("run_id"), F.expr("ts + interval 1 second").alias("ts")))
    # The closing rows need keys: Spark takes rows without one out before it looks at their time.
    plans = with_end(plans, plan_id=F.lit(-1).cast("bigint"), ts=late())
    twice = with_end(twice, plan_id=F.lit(-2).cast("bigint"), ts=late())
    paired = st.pair_runs(stream_of(spark, plans, "plans"), stream_of(spark, twice, "runs"), delay="40 days")
    return st.drain(paired, "pairs").select(
        "plan_id", "run_id", (F.unix_micros("run_ts") - F.unix_micros("plan_ts")).alias("waited_us")
    )


@query(
    "i8_undecided",
    with_sql(
        "audit",
        body="""select a.event_id as ticket from audit a where a.event_id % 3 = 0 and not exists (
  select 1 from audit d where d.event_id = a.event_id + 2 and d.event_id % 7 > 0 and d.ts >= a.ts and d.ts <= a.ts + interval '20 minutes')""",
    ),
)
def undecided(spark, sf):
    log = log_of(spark, sf, "event_id", "ts")
    pending = log.where("event_id % 3 = 0").select(F.col("event_id").alias("ticket"), "ts")
    decided = log.where("event_id % 3 = 2 and event_id % 7 > 0").select((F.col("event_id") - 2).alias("ticket"), "ts")
    end = lambda df: with_end(df, ticket=F.lit(-1).cast("bigint"), ts=late())
    out = st.undecided(
        stream_of(spark, end(pending), "pending"), stream_of(spark, end(decided), "decided"), within="20 minutes"
    )
    return st.drain(out, "undecided").where("ticket >= 0").select("ticket")


@query(
    "i9_k_running",
    with_sql("people", body="select zip_code as value, cast(sum(case when id % 9 = 4 then 0 else 1 end) as bigint) as n from people group by zip_code"),
)
def k_running(spark, sf):
    people = derive(spark, sf, "people")
    changes = people.select("zip_code", F.lit("insert").alias("op")).unionAll(
        people.where("id % 9 = 4").select("zip_code", F.lit("delete").alias("op"))
    )
    return st.drain_updates(st.k_running(stream_of(spark, changes, "changes"), "zip_code"), ["value"], "k")
