"""As-of, window and streaming-shaped queries over the events table."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import aggregates, asof, ladder, sets, windows
from .registry import query, r6, rounded, table

#: The five types of event, the members of a complete group (fixed values).
TYPES = ["view", "signup", "purchase", "click", "error"]
_DECISION_HOURS = (6, 12, 18)


@query("""
with e as (select date_trunc('day', ts) as d, cast(extract(hour from ts) as int) // 6 * 6 as h, event_type, value from events),
     g as (select d, h from e group by d, h having count(distinct event_type) = 5),
     k as (select d, max(h) as h from g where h <= 18 group by d),
     s as (select e.d, e.h, e.event_type, avg(value) as v from e join k on e.d = k.d and e.h = k.h group by all)
select cast(d as date) as day, h as hour, event_type,
       round(v / sum(v) over (partition by d), 6) as share
from s
""")
def complete_group_asof(spark, folder):
    """Each day's last complete six-hour block (all five types) at or before 18:00, and the types' normalised mean values."""
    events = table(spark, folder, "events", "ts", "event_type", "value")
    rows = events.select(F.to_date("ts").alias("day"), (F.floor(F.hour("ts") / 6) * 6).cast("int").alias("hour"), "event_type", "value")
    rows = rows.groupBy("day", "hour", "event_type").agg(F.avg("value").alias("value"))
    decisions = rows.select("day").distinct().withColumn("decision", F.lit(_DECISION_HOURS[-1]))
    chosen = asof.latest_complete(rows, decisions, ["day"], "hour", "decision", "event_type", len(TYPES))
    return windows.share(chosen, ["day"], "value").select("day", F.col("hour").cast("int").alias("hour"), "event_type", r6("share").alias("share"))


@query("""
select p.event_id, max(v.ts) as before_ts
from events p left join events v on v.user_id = p.user_id and v.event_type = 'view' and v.ts < p.ts
where p.event_type = 'purchase' group by p.event_id
""")
def asof_backward_strict(spark, folder):
    """For each purchase the user's last view strictly before it."""
    events = table(spark, folder, "events", "event_id", "user_id", "event_type", "ts")
    found = asof.asof(events.where("event_type = 'purchase'"), events.where("event_type = 'view'"), ["user_id"], "ts", "ts", ["ts"], strict=True)
    return found.select("event_id", F.col("asof_ts").alias("before_ts"))


@query("""
with e as (select event_id, nullif(user_id % 7, 0) as k, event_type, ts from events)
select p.event_id, max(v.ts) as before_ts
from e p left join e v on v.k = p.k and v.event_type = 'signup' and v.ts <= p.ts
where p.event_type = 'purchase' group by p.event_id
""")
def asof_null_keys(spark, folder):
    """For each purchase the last signup of its group of users at or before it; a seventh of the users has no group."""
    events = table(spark, folder, "events", "event_id", "user_id", "event_type", "ts").withColumn("k", F.expr("nullif(user_id % 7, 0)"))
    found = asof.asof(events.where("event_type = 'purchase'"), events.where("event_type = 'signup'"), ["k"], "ts", "ts", ["ts"])
    return found.select("event_id", F.col("asof_ts").alias("before_ts"))


@query("""
select p.event_id, min(v.ts) as after_ts
from events p left join events v on v.user_id = p.user_id and v.event_type = 'view' and v.ts >= p.ts + interval 60 minute
where p.event_type = 'purchase' group by p.event_id
""")
def asof_forward(spark, folder):
    """For each purchase the user's first view at least an hour later."""
    events = table(spark, folder, "events", "event_id", "user_id", "event_type", "ts")
    targets = events.where("event_type = 'purchase'").withColumn("target", F.col("ts") + F.expr("interval 60 minutes"))
    found = asof.asof(targets, events.where("event_type = 'view'"), ["user_id"], "target", "ts", ["ts"], direction="forward")
    return found.select("event_id", F.col("asof_ts").alias("after_ts"))


@query("""
with e as (select event_type as k, cast(ts as date) as issue, ts as received, value from events),
     d as (select distinct event_type as k, timestamp '2024-01-15 12:00:00' as decision from events),
     known as (select e.*, decision, max(received) over (partition by e.k, issue) as last
               from e join d on e.k = d.k where received <= decision and issue <= cast(decision as date))
select k as event_type, issue, max(received) as received, round(max(value), 6) as value, min(value) <> max(value) as conflict
from known where received = last group by all
""")
def asof_versioned(spark, folder):
    """Every day's last receipt of each type that was known at noon of 15 January."""
    events = table(spark, folder, "events", "event_type", "ts", "value").select("event_type", F.to_date("ts").alias("issue"), F.col("ts").alias("received"), "value")
    decisions = events.select("event_type").distinct().withColumn("decision", F.expr("timestamp_ntz'2024-01-15 12:00:00'"))
    found = asof.latest_versions(events, decisions, ["event_type"], "issue", "received", "value", "decision")
    return rounded(found.drop("decision"), "value")


@query("""
select event_id, lead(ts) over (partition by user_id order by ts, event_id) as next_ts from events
""")
def lead_next(spark, folder):
    events = table(spark, folder, "events", "event_id", "user_id", "ts")
    return events.select("event_id", F.lead("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("next_ts"))


@query("""
select * from (
  select event_id, user_id, lag(event_type) over w as old_event_type, event_type,
         round(value - lag(value) over w, 6) as change, cast(row_number() over w - 1 as int) as sequence
  from events window w as (partition by user_id order by ts, event_id)) where sequence > 0
""")
def lag_pairs(spark, folder):
    """Consecutive states of each user with their change."""
    events = table(spark, folder, "events", "event_id", "user_id", "event_type", "ts", "value")
    pairs = windows.consecutive_pairs(events, ["user_id"], ["ts", "event_id"], ["event_type", "value"])
    return pairs.select("event_id", "user_id", "old_event_type", "event_type", r6(F.col("value") - F.col("old_value")).alias("change"), F.col("sequence").cast("int").alias("sequence"))


@query("""
select event_id, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as gap_micros from events
""")
def gap_minutes(spark, folder):
    events = table(spark, folder, "events", "event_id", "user_id", "ts")
    return windows.gaps(events, ["user_id"], "ts", "event_id").select("event_id", F.round(F.col("gap_minutes") * 60e6).cast("long").alias("gap_micros"))


@query("""
with g as (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-31 23:00:00', interval 1 hour)) as ts),
     k as (select distinct event_type from events)
select k.event_type, g.ts,
       round((select max_by(value, struct_pack(t := e.ts, v := e.value)) from events e where e.event_type = k.event_type and e.ts <= g.ts), 6) as last_value,
       round((select max(value) from events e where e.event_type = k.event_type and e.ts <= g.ts), 6) as running_max
from g, k
""")
def running_max_grid(spark, folder):
    """Hourly grid of January: last value and running maximum of each type by then."""
    events = table(spark, folder, "events", "event_type", "ts", "value")
    hours = spark.range(1).select(F.explode(F.expr("sequence(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-31 23:00:00', interval 1 hour)")).alias("ts"))
    grid = events.select("event_type").distinct().crossJoin(F.broadcast(hours))  # 744 hours beside each type
    return rounded(windows.on_grid(grid, events, ["event_type"], "ts", "value"), "last_value", "running_max")


@query("""
with e as (select user_id, event_type <> 'error' as ok, row_number() over (partition by user_id order by ts, event_id)
                  - row_number() over (partition by user_id, event_type <> 'error' order by ts, event_id) as g from events)
select user_id, coalesce(max(n) filter (ok), 0) as longest from (select user_id, ok, g, count(*) as n from e group by all) group by user_id
""")
def longest_run(spark, folder):
    """Most consecutive events of a user without an error."""
    events = table(spark, folder, "events", "event_id", "user_id", "event_type", "ts").withColumn("ok", F.col("event_type") != "error")
    return windows.longest_true_run(events, ["user_id"], ["ts", "event_id"], "ok")


@query("""
select user_id, count(*) filter (p is distinct from event_type or n = 1) as changes from (
  select user_id, event_type, lag(event_type) over w as p, row_number() over w as n from events window w as (partition by user_id order by ts, event_id))
group by user_id
""")
def change_detect(spark, folder):
    """How often the type changes along each user's events, the first included."""
    events = table(spark, folder, "events", "event_id", "user_id", "event_type", "ts")
    return windows.changes(events, ["user_id"], ["ts", "event_id"], "event_type").groupBy("user_id").agg(F.count_if("changed").alias("changes"))


@query("""
select user_id, event_id, round(value, 6) as value from (
  select *, row_number() over (partition by user_id order by ts, value, event_id) as n from events where event_type = 'purchase' and value > 5) where n = 1
""")
def first_qualifying_tiebreak(spark, folder):
    events = table(spark, folder, "events", "event_id", "user_id", "event_type", "ts", "value")
    first = windows.first_qualifying(events, ["user_id"], (F.col("event_type") == "purchase") & (F.col("value") > 5), [F.col("ts"), F.col("value"), F.col("event_id")])
    return rounded(first.select("user_id", "event_id", "value"), "value")


@query("""
with e as (select event_type, event_id, ts, epoch_us(ts) // 1800000000 as slot, row_number() over (partition by event_type, epoch_us(ts) // 1800000000 order by ts, event_id) as n from events),
     f as (select event_type, slot, ts, event_id from e where n = 1)
select event_type, slot, event_id from (
  select *, lag(slot) over w as s, lag(ts) over w as t from f window w as (partition by event_type order by slot))
where slot - s = 1 and (epoch_us(ts) - epoch_us(t)) / 1e6 between 900 and 2700
""")
def two_poll_confirm(spark, folder):
    """First events of half-hour slots that follow the slot before by 15 to 45 minutes."""
    events = table(spark, folder, "events", "event_id", "event_type", "ts")
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_800_000_000)
    first = windows.first_qualifying(events.withColumn("slot", slot), ["event_type", "slot"], F.lit(True), [F.col("ts"), F.col("event_id")])
    return ladder.confirmed(first, ["event_type"], "slot", "ts", F.lit(True), 900, 2700).select("event_type", "slot", "event_id")


@query("""
with h as (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-31 23:00:00', interval 1 hour)) as hour),
     e as (select date_trunc('hour', ts) as hour, count(*) as n, count(*) filter (event_type = 'error') as errors from events group by 1),
     s as (select h.hour, coalesce(n, 0) as n, coalesce(errors, 0) as errors from h left join e using (hour))
select cast(hour as date) as day, count(*) filter (n = 0) as empty_slots, count(*) filter (errors > 0) as error_slots,
       case when count(*) filter (n = 0) > 2 then 'INVALID' when count(*) filter (errors > 0) > 23 then 'DEGRADED' else 'NORMAL' end as health
from s group by 1
""")
def slot_health(spark, folder):
    """Health of each day from its 24 hourly slots, those without events included."""
    events = table(spark, folder, "events", "ts", "event_type").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), (F.col("event_type") == "error").cast("int").alias("error"))
    slots = spark.range(1).select(F.explode(F.expr("sequence(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-31 23:00:00', interval 1 hour)")).alias("hour"))
    counts = events.groupBy("hour").agg(F.count("*").alias("n"), F.sum("error").alias("errors"))
    filled = slots.join(counts, "hour", "left").na.fill(0)
    day = filled.groupBy(F.to_date("hour").alias("day")).agg(F.count_if(F.col("n") == 0).alias("empty_slots"), F.count_if(F.col("errors") > 0).alias("error_slots"))
    return day.withColumn("health", F.when(F.col("empty_slots") > 2, "INVALID").when(F.col("error_slots") > 23, "DEGRADED").otherwise("NORMAL"))


@query("""
select event_type, cast(sum(try_cast(json_extract_string(props, '$.k') as int)) as bigint) as k_sum, count(try_cast(json_extract_string(props, '$.k') as int)) as k_count from events group by 1
""")
def json_props_extract(spark, folder):
    """Nested values out of captured JSON text."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, folder, "events", "event_type", "props").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count(k).alias("k_count"))


@query("""
select cast(ts as date) as day, round(sum(1.0 / n), 6) as weight, round(sum(value / n), 6) as mean_value from (
  select ts, value, count(*) over (partition by cast(ts as date)) as n from events) group by 1
""")
def date_balanced_weight(spark, folder):
    """Weights of one over the day's rows: every day weighs one."""
    events = table(spark, folder, "events", "ts", "value").withColumn("day", F.to_date("ts"))
    weighted = aggregates.balanced_weights(events, "day")
    return rounded(weighted.groupBy("day").agg(F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("value")).alias("mean_value")), "weight", "mean_value")


@query("""
with w as (select event_type, value, 1.0 / count(*) over (partition by cast(ts as date)) as w from events),
     m as (select event_type, sum(w * value) / sum(w) as mean from w group by 1)
select event_type, round(any_value(mean), 6) as weighted_mean, round(sqrt(sum(w * (value - mean) * (value - mean)) / sum(w)), 6) as weighted_std from w join m using (event_type) group by 1
""")
def weighted_mean(spark, folder):
    events = table(spark, folder, "events", "event_type", "ts", "value").withColumn("day", F.to_date("ts"))
    return rounded(aggregates.weighted_moments(aggregates.balanced_weights(events, "day"), ["event_type"], "value", "weight"), "weighted_mean", "weighted_std")


@query("""
with s as (select event_type, value, sum(user_id % 7 + 1) as w from events group by 1, 2),
     c as (select *, sum(w) over (partition by event_type order by value) as c, sum(w) over (partition by event_type) as t from s)
select event_type, round(min(value) filter (c >= 0.9 * t - 1e-12), 6) as quantile from c group by 1
""")
def weighted_quantile(spark, folder):
    events = table(spark, folder, "events", "event_type", "user_id", "value").withColumn("w", F.col("user_id") % 7 + 1)
    return rounded(aggregates.weighted_quantile(events, ["event_type"], "value", "w", 0.9), "quantile")


@query("""
with c as (select event_type, value, count(*) as n from events where value is not null group by 1, 2)
select event_type, value, round(sum(n) over (partition by event_type order by value) / sum(n) over (partition by event_type), 6) as cdf,
       round(1 - sum(n) over (partition by event_type order by value) / sum(n) over (partition by event_type), 6) as survival from c
""")
def ecdf_cdf_survival(spark, folder):
    return rounded(aggregates.ecdf(table(spark, folder, "events", "event_type", "value"), ["event_type"], "value"), "cdf", "survival")


@query("""
with s as (select event_type, value, row_number() over (partition by event_type order by value) as i, count(*) over (partition by event_type) as n from events)
select event_type, round(avg(abs(value - 20.0)) - sum((2.0 * i - n - 1) * value) / max(n) / max(n), 6) as crps from s group by 1
""")
def crps_sample(spark, folder):
    """CRPS of each type's values as samples of a forecast of 20."""
    events = table(spark, folder, "events", "event_type", "value").withColumn("observed", F.lit(20.0))
    return rounded(aggregates.crps(events, ["event_type"], "value", "observed"), "crps")


@query("""
with p as (select least(cast(floor(10 * (extract(second from ts) / 60.0)) as int), 9) as decile, user_id % 3 + 1 as w from events)
select cast(d as int) as decile, round(coalesce(sum(w), 0) / (select sum(w) from p), 6) as mass from range(10) t(d) left join p on p.decile = d group by d
""")
def pit_deciles(spark, folder):
    events = table(spark, folder, "events", "ts", "user_id").select((F.second("ts") / 60.0).alias("pit"), (F.col("user_id") % 3 + 1).cast("double").alias("w"))
    return rounded(aggregates.pit_deciles(events, "pit", "w"), "mass")


@query("""
with p as (select (event_id * 7 % 1009) / 1010.0 as pit, user_id % 3 + 1 as w from events),
     m as (select sum(w * pit) / sum(w) as mean, sum(w) as t from p),
     d as (select pit, sum(w) as w from p group by pit),
     c as (select pit, sum(w) over (order by pit) as below, w from d)
select round((select mean from m), 6) as mean, round((select sum(w * (pit - mean) * (pit - mean)) / max(t) from p, m), 6) as variance,
       round(max(greatest(abs(below / t - pit), abs((below - w) / t - pit))), 6) as ks from c, m
""")
def pit_summary(spark, folder):
    """Mean, variance and distance from uniform of weighted numbers between 0 and 1."""
    events = table(spark, folder, "events", "event_id", "user_id").select(((F.col("event_id") * 7 % 1009) / 1010.0).alias("pit"), (F.col("user_id") % 3 + 1).cast("double").alias("w"))
    return rounded(aggregates.pit_summary(events, "pit", "w"), "mean", "variance", "ks")


@query("""
select d.user_id from (select distinct user_id from events) d
where not exists (select 1 from events e where e.user_id = d.user_id and e.event_type = 'purchase' and e.value > 60)
""")
def anti_missing(spark, folder):
    """Users without a purchase over 60."""
    events = table(spark, folder, "events", "user_id", "event_type", "value")
    return sets.missing(events.select("user_id").distinct(), events.where("event_type = 'purchase' and value > 60"), ["user_id"])
