"""Queries over captures: censuses, sessions, slots, quote records, pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import census
from . import revisions
from .registry import query, rounded, table


@query("""
with d as (select l_returnflag, l_linestatus, date_diff('day', date '1995-06-17', cast(l_shipdate as date)) as late from lineitem)
select l_returnflag, count(*) as requested, count(*) filter (l_linestatus = 'F') as passed, count(*) filter (l_linestatus = 'F') = count(*) as all_pass,
       count(late) filter (l_linestatus = 'F') as with_difference, min(late) filter (l_linestatus = 'F') as least, max(late) filter (l_linestatus = 'F') as greatest,
       count(*) filter (l_linestatus = 'F' and late < 0) as negative, count(*) filter (l_linestatus = 'F' and late > 0) as positive, count(*) filter (l_linestatus = 'F' and late = 0) as zero
from d group by 1
""")
def status_differences(spark, folder):
    """Signed days from a date to the shipping of finished lines, by return flag."""
    lines = table(spark, folder, "lineitem", "l_returnflag", "l_linestatus", "l_shipdate")
    return census.status_differences(lines.withColumn("late", F.datediff("l_shipdate", F.lit("1995-06-17").cast("date"))), ["l_returnflag"], "l_linestatus", "late", "F")


@query("""
with n as (select user_id, cast(ts as date) as label, count(*) as n, bool_and(value > 1) as f from events group by 1, 2)
select user_id, cast(sum(n) as bigint) as rows, count(*) filter (n > 1) as duplicate_labels, bool_and(f) as all_filled from n group by 1
""")
def duplicate_summary(spark, folder):
    """Days on which a user has several events, and whether all values are above 1."""
    events = table(spark, folder, "events", "user_id", "ts", "value").withColumn("label", F.to_date("ts"))
    return census.duplicate_summary(events, ["user_id"], "label", F.col("value") > 1)


@query("""
select cast(ts as date) as session, count(*) as cycles, count(*) filter (event_type = 'error') as errors, count(*) filter (event_type = 'purchase') as purchases, round(max(value), 6) as max_value
from events group by 1
""")
def session_statistics(spark, folder):
    """Counters of each day's events and their greatest value."""
    events = table(spark, folder, "events", "ts", "event_type", "value").withColumns({"session": F.to_date("ts"), "errors": (F.col("event_type") == "error").cast("int"), "purchases": (F.col("event_type") == "purchase").cast("int")})
    return rounded(census.session_statistics(events, ["session"], ["errors", "purchases"], "value"), "max_value")


@query("""
with h as (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-31 23:00:00', interval 1 hour)) as due),
     e as (select date_trunc('hour', ts) as due, min(ts) as ts from events where event_type = 'click' group by 1)
select h.due, e.ts as started, round((epoch_us(e.ts) - epoch_us(h.due)) / 1e6, 3) as delay_seconds,
       case when e.ts is null then 'ABSENT' when epoch_us(e.ts) - epoch_us(h.due) > 900e6 then 'MISSED_LATE_START' else 'STARTED' end as status
from h left join e on e.due = h.due
""")
def slot_states(spark, folder):
    """Hourly slots of January, their first click, and those that begin over 15 minutes late or not at all."""
    slots = spark.range(1).select(F.explode(F.expr("sequence(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-31 23:00:00', interval 1 hour)")).alias("due"))
    clicks = table(spark, folder, "events", "ts", "event_type").where("event_type = 'click'").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("due"), F.col("ts").alias("started"))
    return census.slot_states(slots, clicks, ["due"], "due", "started", 900).withColumn("delay_seconds", F.round("delay_seconds", 3))


@query("""
select o_orderkey, cast(o_custkey as varchar) as bid, cast(null as varchar) as volume, o_orderpriority as exchange, round(o_custkey * 0.5, 6) as request_elapsed_ms from orders
""")
def quote_records(spark, folder):
    """Orders as captured quotes with numeric field codes; one field was not captured."""
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    items = orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("84"), F.col("o_orderpriority").alias("6004"), F.lit(1_000_000).alias("sent"), (1_000_000 + F.col("o_custkey") * 500_000).alias("received"))
    found = census.quote_records(items, ["o_orderkey"], "sent", "received")
    return rounded(found.select("o_orderkey", "bid", "volume", "exchange", "request_elapsed_ms"), "request_elapsed_ms")


@query("""
select user_id, count(*) as bar_count, arg_min(ts, event_id) filter (event_type <> 'error') as first_time, arg_max(ts, event_id) filter (event_type <> 'error') as last_time from events group by 1
""")
def bar_summary(spark, folder):
    """Each user's number of events, and the times of the first and last that have one (errors have none)."""
    bars = table(spark, folder, "events", "user_id", "event_id", "event_type", "ts").withColumn("ts", F.when(F.col("event_type") != "error", F.col("ts")))
    return census.bar_summary(bars, ["user_id"], "event_id", "ts")


@query("""
with p as (select c_nationkey, c_mktsegment, c_custkey // 2 as strike, max(c_custkey) filter (c_custkey % 2 = 0) as yes_conid, max(c_custkey) filter (c_custkey % 2 = 1) as no_conid from customer group by 1, 2, 3)
select c_nationkey, c_mktsegment, strike, yes_conid, no_conid from p qualify row_number() over (partition by c_nationkey order by c_mktsegment, cast(strike as varchar)) <= 5
""")
def first_pairs(spark, folder):
    """The first five pairs of each nation: a top-k report."""
    contracts = table(spark, folder, "customer", "c_nationkey", "c_mktsegment", "c_custkey").withColumns({"strike": F.floor(F.col("c_custkey") / 2), "side": F.when(F.col("c_custkey") % 2 == 0, "Y").otherwise("N")})
    return census.first_pairs(contracts, ["c_nationkey"], "c_mktsegment", "strike", "side", "c_custkey", 5)


@query("""
with h as (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-31 23:00:00', interval 1 hour)) as hour),
     w as (select u.session, h.hour, u.event_type from h, (select distinct user_id % 3 as session, event_type from events) u)
select w.session, w.hour, w.event_type from w left join (select distinct user_id % 3 as session, date_trunc('hour', ts) as hour, event_type from events) e
on e.session = w.session and e.hour = w.hour and e.event_type = w.event_type where e.session is null
""")
def missing_keys(spark, folder):
    """Types of event that a group of users lacks in an hour of January; hours without any event too."""
    events = table(spark, folder, "events", "user_id", "ts", "event_type").select((F.col("user_id") % 3).alias("session"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type")
    hours = spark.range(1).select(F.explode(F.expr("sequence(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-31 23:00:00', interval 1 hour)")).alias("hour"))
    cycles = events.select("session").distinct().crossJoin(F.broadcast(hours))  # 744 hours beside each group
    return census.missing_keys(cycles, events, events, ["session"], ["hour"], ["event_type"])


@query("""
with q as (select user_id % 4 as k, date_trunc('hour', ts) as h, event_type, avg(value) as v from events group by 1, 2, 3),
     s as (select k, h, count(*) as n, list(event_type order by event_type) as types, bool_and(event_type <> 'error' or extract(hour from h) < 20) as open from q group by 1, 2),
     e as (select k, h, extract(hour from h) % 2 = 1 as soon from s),
     j as (select e.*, a.n as n0, b.n as n1, c.n as n2, a.types as t0, b.types as t1, c.types as t2, coalesce(a.open, false) and coalesce(b.open, false) and coalesce(c.open, false) as open
           from e join s a on a.k = e.k and a.h = e.h left join s b on b.k = e.k and b.h = e.h + interval 1 hour left join s c on c.k = e.k and c.h = e.h + interval 2 hour)
select count(*) as events, 0::bigint as pre_not_after_publication, 0::bigint as pre_not_before_old, 0::bigint as in_order, 0::bigint as post1_after_publication, 0::bigint as post2_after_publication, 0::bigint as post1_before_next,
       count(*) filter (soon) as post2_before_next, 0::bigint as pre_staleness_matches, 0::bigint as post1_lateness_matches, count(*) filter (k = 3) as post2_lateness_matches,
       count(*) filter (not (n0 = 5 and coalesce(n1, 0) = 5 and coalesce(n2, 0) = 5)) as whole_snapshots,
       count(*) filter (not (t0 = coalesce(t1, []) and t0 = coalesce(t2, []))) as same_members, count(*) filter (not (t0 = coalesce(t1, []) and t0 = coalesce(t2, []))) as same_labels,
       count(*) filter (not open) as before_close, false as passed from j
""")
def snapshot_audit(spark, folder):
    """Three hourly snapshots of the five types of event around made-up publications, some of which break the rules."""
    seen = table(spark, folder, "events", "user_id", "ts", "event_type", "value").select((F.col("user_id") % 4).alias("k"), F.date_trunc("hour", "ts").cast("timestamp").alias("h"), "event_type", "value")
    quotes = seen.groupBy("k", "h", "event_type").agg(F.avg("value").alias("v")).withColumns({"label": F.upper("event_type"), "is_pre_close": (F.col("event_type") != "error") | (F.hour("h") < 20)})
    after = lambda minutes: F.col("h") + F.expr(f"interval {minutes} minutes")
    times = {"old_publication": after(-30), "new_publication": after(30), "next_publication": F.when(F.hour("h") % 2 == 1, after(100)), "pre": F.col("h"), "post1": after(60), "post2": after(120), "post1_target": after(60), "post2_target": after(120)}
    stored = {"pre_staleness": F.lit(30.0), "post1_lateness": F.lit(0.0), "post2_lateness": F.when(F.col("k") == 3, 1.0).otherwise(0.0)}
    events = seen.select("k", "h").distinct().select("k", *[c.alias(n) for n, c in (times | stored).items()])
    return revisions.snapshot_audit(events, quotes, ["k"], "event_type", "label", "h", size=5, filled="v")
