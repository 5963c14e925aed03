"""Queries over distributions, states at instants, supports and quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markets
from ..operators import aggregates, distributions, versions
from . import nowcast
from .registry import query, rounded, table


@query("""
with c as (select c_acctbal / 1000 as z, 1.0 / count(*) over (partition by c_nationkey) as w from customer),
     t as (select sum(w) as t from c), pair as (select sum(a.w * b.w * abs(a.z - b.z)) as p from c a, c b)
select s_suppkey, round(sum(w) filter (z <= s_acctbal / 1000) / any_value(t), 6) as cdf, round(coalesce(sum(w) filter (z > s_acctbal / 1000), 0) / any_value(t), 6) as survival,
       round(sum(w * abs(z - s_acctbal / 1000)) / any_value(t), 6) as mean_distance,
       round(2 * (sum(w * abs(z - s_acctbal / 1000)) / any_value(t) - any_value(p) / any_value(t) / any_value(t) / 2), 6) as crps
from supplier, c, t, pair group by s_suppkey
""")
def ecdf_distance(spark, folder):
    """Each supplier's balance against the customers' balances, in which every nation weighs the same: probabilities, E|Z - a| and CRPS at scale 2."""
    customers = aggregates.balanced_weights(table(spark, folder, "customer", "c_nationkey", "c_acctbal"), "c_nationkey", "w").select((F.col("c_acctbal") / 1000).alias("z"), "w")
    suppliers = table(spark, folder, "supplier", "s_suppkey", "s_acctbal").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("a"))
    return rounded(distributions.crps(suppliers, "a", customers, [], "z", "w", F.lit(2.0)).drop("a"), "cdf", "survival", "mean_distance", "crps")


@query("""
with o as (select user_id % 5 as k, cast(ts as date) as d, date_trunc('hour', ts) as issue, ts as received, value as v from events where event_type <> 'purchase'),
     q as (select event_id, user_id % 5 as k, cast(ts as date) as d, ts as t from events where event_type = 'purchase'),
     each as (select k, d, issue, received, max(v) as v from o group by 1, 2, 3, 4),
     seen as (select event_id, t, q.k, q.d, issue, max_by(v, received) as v from q join each e on e.k = q.k and e.d = q.d and e.received <= q.t and e.issue <= q.t group by 1, 2, 3, 4, 5),
     state as (select event_id, count(*) as known, max(v) as running_max, max_by(v, issue) as current, max(issue) as latest_issue,
                      max_by(v, issue) filter (issue <= t - interval 60 minutes) as old from seen group by 1)
select q.event_id, round(current, 6) as current, round(running_max, 6) as running_max, round(current - running_max, 6) as below_max, round((epoch_us(t) - epoch_us(latest_issue)) / 1e6, 6) as age_seconds,
       round(current - old, 6) as change, coalesce(known, 0) as known
from q left join state on state.event_id = q.event_id and cast(t - interval 6 hour as date) = q.d
""")
def state_at_quote(spark, folder):
    """What was known at each purchase: hourly issues whose last version received by then counts, from events of the same group and UTC day; nothing where the day six hours west is another."""
    events = table(spark, folder, "events", "event_id", "user_id", "event_type", "ts", "value").withColumns({"k": F.col("user_id") % 5, "d": F.to_date("ts")})
    seen = events.where("event_type <> 'purchase'").select("k", "d", F.date_trunc("hour", "ts").alias("issue"), F.col("ts").cast("timestamp").alias("received"), "value")
    quotes = events.where("event_type = 'purchase'").select("event_id", "k", "d", F.col("ts").cast("timestamp").alias("t"))
    found = versions.state_at(quotes, seen, ["k", "d"], "t", "issue", "received", "value", F.col("d"), F.to_date(F.col("t") - F.expr("interval 6 hours")))
    found = found.withColumn("age_seconds", F.col("age_minutes") * 60)
    return rounded(found.select("event_id", "current", "running_max", "below_max", "age_seconds", "change", "known"), "current", "running_max", "below_max", "age_seconds", "change")


@query("""
with f as (select l_orderkey, l_linenumber, case l_suppkey % 3 when 0 then null when 1 then 'delayed' else 'real_time' end as delivery, l_linestatus = 'F' as ask_present,
                  case when l_returnflag = 'R' then null else l_returnflag = 'A' end as size_present, case when l_quantity > 45 then null else l_discount * 12 end as ask, l_tax * 100 - 2 as size from lineitem)
select l_orderkey, l_linenumber, array_to_string(list_filter([
       case when coalesce(delivery <> 'real_time', true) then 'not_real_time' end, case when coalesce(not ask_present, true) then 'ask_field_not_present' end, case when coalesce(not size_present, true) then 'ask_size_field_not_present' end,
       case when coalesce(not (ask > 0 and ask < 1), true) then 'invalid_or_missing_ask' end, case when coalesce(not size > 0, true) then 'invalid_or_missing_ask_size' end], lambda x: x is not null), '|') as reasons
from f
""")
def quote_reasons(spark, folder):
    """Lines taken as displayed quotes: every reason why one can't be taken, in order; the size comes as text."""
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_linestatus", "l_returnflag", "l_quantity", "l_discount", "l_tax")
    delivery = F.when(F.col("l_suppkey") % 3 == 1, "delayed").when(F.col("l_suppkey") % 3 == 2, "real_time")
    size_present = F.when(F.col("l_returnflag") != "R", F.col("l_returnflag") == "A")
    ask, size = F.when(F.col("l_quantity") <= 45, F.col("l_discount") * 12), (F.col("l_tax") * 100 - 2).cast("string")
    problems = markets.quote_problems(delivery, F.col("l_linestatus") == "F", size_present, ask, size)
    return lines.select("l_orderkey", "l_linenumber", F.array_join(problems, "|").alias("reasons"))


@query("""
with o as (select cast(extract(month from o_orderdate) as int) as month, o_orderpriority, cast(o_orderdate as date) as day, o_totalprice, case when o_custkey % 3 > 0 then o_custkey::double end as trend from orders)
select month, o_orderpriority, count(distinct day) as dates, count(*) as n, count(distinct day) >= 45 as supported, count(o_totalprice) as o_totalprice_filled, count(trend) as trend_filled,
       count(distinct day) filter (trend is null) as missing_trend_dates, round(quantile_cont(o_totalprice, 0.01), 6) as o_totalprice_q01, round(quantile_cont(o_totalprice, 0.99), 6) as o_totalprice_q99,
       round(quantile_cont(trend, 0.01), 6) as trend_q01, round(quantile_cont(trend, 0.99), 6) as trend_q99
from o group by 1, 2
""")
def support_census(spark, folder):
    """Support cells of months and priorities: dates, filled values, ranges, and the dates on which the trend is missing."""
    orders = table(spark, folder, "orders", "o_orderdate", "o_orderpriority", "o_totalprice", "o_custkey")
    rows = orders.select(F.month("o_orderdate").alias("month"), "o_orderpriority", F.to_date("o_orderdate").alias("day"), "o_totalprice", F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey").cast("double")).alias("trend"))
    return rounded(aggregates.support_cells(rows, ["month", "o_orderpriority"], "day", ["o_totalprice", "trend"], trend="trend"), "o_totalprice_q01", "o_totalprice_q99", "trend_q01", "trend_q99")


@query("""
with o as (select o_orderstatus, cast(o_orderdate as date) as day, o_totalprice / 500000 as q, case when o_custkey % 4 = 0 then 1.0 else 0.0 end as hit from orders),
     b as (select *, least(cast(floor((q - 0.05) / 0.05) as int), 17) as k from o where q between 0.05 and 0.95),
     d as (select o_orderstatus, k, day, count(*) as c, avg(q) as p, avg(hit) as h from b group by 1, 2, 3)
select o_orderstatus, printf('%.2f-%.2f', 0.05 + k * 0.05, 0.10 + k * 0.05) as q_bin, count(*) as dates, cast(sum(c) as bigint) as n, round(avg(p), 6) as mean_predicted, round(avg(h), 6) as mean_hit, round(avg(h) - avg(p), 6) as gap, count(*) >= 100 as supported
from d group by o_orderstatus, k
""")
def calibration_bins(spark, folder):
    """Calibration by probability bins of 0.05: means of the days' means, and whether a bin has enough days."""
    orders = table(spark, folder, "orders", "o_orderstatus", "o_orderdate", "o_totalprice", "o_custkey")
    rows = orders.select("o_orderstatus", F.to_date("o_orderdate").alias("day"), (F.col("o_totalprice") / 500000).alias("q"), (F.col("o_custkey") % 4 == 0).cast("double").alias("hit"))
    rows = rows.withColumn("q_bin", nowcast.q_bin(F.col("q"))).where("q_bin is not null")
    return rounded(aggregates.calibration_cells(rows, ["o_orderstatus", "q_bin"], "day", "q", "hit"), "mean_predicted", "mean_hit", "gap")


@query("""
with e as (select event_type, cast(ts as date) as day, value as crps, abs(value - 20) as median_error, (event_id * 7 % 1009) / 1010.0 as pit from events),
     w as (select *, 1.0 / count(*) over (partition by event_type, day) as w, floor(pit * 10) as decile from e),
     m as (select event_type, sum(w * pit) / sum(w) as pit_mean, sum(w) as t from w group by 1),
     d as (select event_type, pit, sum(w) as x from w group by 1, 2),
     c as (select event_type, pit, x, sum(x) over (partition by event_type order by pit) as below from d),
     k as (select event_type, max(greatest(abs(below / t - pit), abs((below - x) / t - pit))) as pit_ks from c join m using (event_type) group by 1)
select event_type, count(distinct day) as dates, count(*) as states, round(sum(w * crps) / sum(w), 6) as crps, round(sum(w * median_error) / sum(w), 6) as median_error,
       round(sum(w) filter (decile = 0) / sum(w), 6) as first_decile, round(sum(w) filter (decile = 9) / sum(w), 6) as last_decile,
       round(sum(w) filter (pit between 0.25 and 0.75) / sum(w), 6) as coverage_50, round(sum(w * crps * 0.5) / sum(w), 6) as width_50,
       round(any_value(pit_mean), 6) as pit_mean, round(sum(w * (pit - pit_mean) ** 2) / sum(w), 6) as pit_variance, round(any_value(pit_ks), 6) as pit_ks
from w join m using (event_type) join k using (event_type) group by 1
""")
def metric_summary(spark, folder):
    """Scores by type of event in which every day weighs the same: means, coverage, width, and how uniform the PIT is."""
    events = table(spark, folder, "events", "event_type", "ts", "value", "event_id")
    rows = events.select("event_type", F.to_date("ts").alias("day"), F.col("value").alias("crps"), F.abs(F.col("value") - 20).alias("median_error"), (F.col("event_id") * 7 % 1009 / 1010.0).alias("pit"))
    rows = rows.withColumns({c: x for n, level in ((50, 0.5), (80, 0.8), (90, 0.9)) for c, x in ((f"in_{n}", F.col("pit").between((1 - level) / 2, (1 + level) / 2)), (f"width_{n}", F.col("crps") * level))})
    found = nowcast.metric_summary(rows, "day", ["event_type"]).withColumns({"first_decile": F.get("pit_deciles", F.lit(0)), "last_decile": F.get("pit_deciles", F.lit(9))})
    names = ["crps", "median_error", "first_decile", "last_decile", "coverage_50", "width_50", "pit_mean", "pit_variance", "pit_ks"]
    return rounded(found.select("event_type", "dates", "states", *names), *names)
