"""Queries over records: first values, counts, pairs, strict numbers, chains, splits, indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markets, records
from ..operators import records as ops
from .registry import query, r6, rounded, table

SPLITS = [("train", "1995-01-01", "1998-12-31"), ("calibration", "1999-01-01", "2000-06-30"), ("validation", "2000-07-01", "2001-12-31")]


@query("select user_id, arg_min(value, event_id) filter (where event_type = 'purchase') as value from events group by user_id")
def first_present(spark, folder):
    """Each user's first purchase value in order of the events; null without one."""
    events = table(spark, folder, "events", "user_id", "event_id", "event_type", "value").withColumn("value", F.when(F.col("event_type") == "purchase", F.col("value")))
    return ops.first_present(events, ["user_id"], ["event_id"], "value")


@query("select event_type, round(median(abs(value - 20)), 6) as median_abs from events group by event_type")
def median_abs(spark, folder):
    """Median distance of the values from 20, by type."""
    return rounded(ops.median_abs(table(spark, folder, "events", "event_type", "value"), ["event_type"], F.col("value") - 20), "median_abs")


@query("select nullif(o_orderpriority, '2-HIGH') as priority, count(*) as count from orders group by 1")
def value_counts(spark, folder):
    """Orders by priority, with one priority taken as unknown."""
    orders = table(spark, folder, "orders", "o_orderpriority").select(F.expr("nullif(o_orderpriority, '2-HIGH')").alias("priority"))
    return ops.value_counts(orders, "priority", dropna=False)


@query("""
select event_type, count(*) filter (where user_id % 3 > 0 and user_id % 5 > 0) as pairs,
       round(avg(value - user_id / 10.0) filter (where user_id % 3 > 0 and user_id % 5 > 0), 6) as mean_difference
from events group by event_type
""")
def paired_mean(spark, folder):
    """Mean difference of two scores over the rows that have both."""
    events = table(spark, folder, "events", "event_type", "user_id", "value")
    events = events.withColumns({"a": F.when(F.col("user_id") % 3 > 0, F.col("value")), "b": F.when(F.col("user_id") % 5 > 0, F.col("user_id") / 10.0)})
    return rounded(ops.paired_mean(events, ["event_type"], "a", "b"), "mean_difference")


@query("select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 25")
def top_margin(spark, folder):
    """The 25 dearest lines: a top-k report."""
    return ops.top_margin(table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice"), 25, "l_extendedprice", ["l_orderkey", "l_linenumber"])


@query("select user_id, min(ts) as ts from events where ts > timestamp '2024-01-10 00:00:00' group by user_id")
def nearest_future(spark, folder):
    """Each user's first event after a moment."""
    return ops.nearest_future(table(spark, folder, "events", "user_id", "ts"), ["user_id"], "ts", F.lit("2024-01-10 00:00:00").cast("timestamp"))


@query("""
with o as (select l_orderkey, list_sort(list(l_linenumber)) as n from lineitem group by l_orderkey)
select l_orderkey, n[len(n) // 2 + 1] as middle from o
""")
def middle_element(spark, folder):
    """The middle line number of each order."""
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("n"))
    return lines.select("l_orderkey", records.middle(F.col("n")).alias("middle"))


@query("""
with c as (select l_orderkey,
                  string_agg(cast(l_linenumber as varchar), '>' order by l_shipdate, cast(l_linenumber as varchar)) as shipped,
                  string_agg(cast(l_linenumber as varchar), '>' order by l_extendedprice, cast(l_linenumber as varchar)) as priced
           from lineitem group by l_orderkey)
select *, shipped <> priced as differs from c
""")
def order_chain(spark, folder):
    """An order's lines in order of shipping and of price, and whether the chains differ."""
    events = F.collect_list(F.struct("l_shipdate", "l_extendedprice", "l_linenumber"))
    rows = table(spark, folder, "lineitem", "l_orderkey", "l_shipdate", "l_extendedprice", "l_linenumber").groupBy("l_orderkey").agg(events.alias("e"))
    rows = rows.select("l_orderkey", records.order_chain(F.col("e"), "l_shipdate", "l_linenumber").alias("shipped"), records.order_chain(F.col("e"), "l_extendedprice", "l_linenumber").alias("priced"))
    return rows.withColumn("differs", F.col("shipped") != F.col("priced"))


@query("""
select case when o_orderdate <= date '1998-12-31' then 'train' when o_orderdate <= date '2000-06-30' then 'calibration' else 'validation' end as split, count(*) as orders
from orders group by 1
""")
def split_dates(spark, folder):
    """Orders by the date range that holds them; a date outside of all fails the query."""
    orders = table(spark, folder, "orders", "o_orderdate")
    return orders.select(records.split_of(F.to_date("o_orderdate"), SPLITS).alias("split")).groupBy("split").agg(F.count("*").alias("orders"))


@query("""
with t as (select l_orderkey, l_linenumber, case l_linenumber % 4 when 0 then '-0.05' when 1 then '0.' || lpad(cast(cast(l_discount * 100 as int) as varchar), 2, '0') when 2 then '0.005' else '1e-2' end as ask from lineitem)
select l_orderkey, l_linenumber, case when l_linenumber % 4 = 1 and ask <> '0.00' then cast(ask as decimal(18,6)) end as price, l_linenumber as size from t
""")
def strict_decimals(spark, folder):
    """Asks that are plain decimals on the tick between 0 and 1; others are not there."""
    number = F.col("l_linenumber") % 4
    cents = F.concat(F.lit("0."), F.lpad(F.round(F.col("l_discount") * 100).cast("int").cast("string"), 2, "0"))
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_discount")
    lines = lines.withColumn("ask", F.when(number == 0, "-0.05").when(number == 1, cents).when(number == 2, "0.005").otherwise("1e-2"))
    return lines.select("l_orderkey", "l_linenumber", records.on_tick_ask(F.col("ask")).alias("price"), records.positive_size(F.col("l_linenumber").cast("string")).cast("int").alias("size"))


@query("""
with c as (select event_id, ['RPB', 'Dp', 'ivB', 'v', 'xqB', ''][event_id % 6 + 1] as code from events)
select event_id, ['real_time', 'delayed', 'incomplete', 'vdr_exempt', 'unknown:x', null][event_id % 6 + 1] as delivery,
       ['snapshot', 'consolidated', 'unknown:v', null, 'unknown:q', null][event_id % 6 + 1] as mode, code like '__B%' as book from c
""")
def availability_codes(spark, folder):
    """What market-data codes say, with those that are not known."""
    codes = F.array(*map(F.lit, ["RPB", "Dp", "ivB", "v", "xqB", ""]))
    rows = table(spark, folder, "events", "event_id").select("event_id", markets.availability(F.get(codes, (F.col("event_id") % 6).cast("int"))).alias("a"))
    return rows.select("event_id", "a.delivery", "a.mode", "a.book")


@query("""
select event_id, cast(cast(ts as date) + 1 as timestamp) as target, strftime(ts, '%Y%m%d_%H') as cycle,
       timezone('UTC', timezone('America/New_York', cast(cast(ts as date) as timestamp))) as opens,
       timezone('UTC', timezone('America/New_York', cast(cast(ts as date) + 1 as timestamp))) + interval 12 hour as unlocks
from events
""")
def day_targets(spark, folder):
    """Next midnight, run key, and the bounds of a New York day, for every event."""
    day = F.to_date("ts")
    rows = table(spark, folder, "events", "event_id", "ts").withColumn("s", records.session_bounds(day, F.lit("America/New_York")))
    plain = {c: F.col(c).cast("timestamp_ntz") for c in ("target", "opens", "unlocks")}
    return rows.select("event_id", records.next_midnight(day).alias("target"), records.cycle_name(F.col("ts")).alias("cycle"), "s.opens", "s.unlocks").withColumns(plain)


@query("""
with m as (select l_orderkey, max(l_extendedprice) as best_yes, max(l_extendedprice) filter (where l_returnflag = 'R') as best_no from lineitem group by l_orderkey)
select o_orderkey, case when o_orderkey % 4 > 0 then best_yes end as best_yes, case when o_orderkey % 4 > 0 then best_no end as best_no
from orders left join m on l_orderkey = o_orderkey
""")
def order_books(spark, folder):
    """Orders as markets, with the best of their lines' prices as two-sided books; a quarter has no book."""
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_extendedprice", "l_returnflag").where("l_orderkey % 4 > 0")
    level = F.struct(F.col("l_extendedprice").alias("price"))
    books = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(level).alias("yes"), F.collect_list(F.when(F.col("l_returnflag") == "R", level)).alias("no"))
    return ops.with_books(table(spark, folder, "orders", "o_orderkey"), books, "o_orderkey").select("o_orderkey", "best_yes", "best_no")


@query("""
select o_orderkey, least(o_orderdate, o_orderdate + interval 1 day * (o_custkey % 9 - 4)) as first, greatest(o_orderdate, o_orderdate + interval 1 day * (o_custkey % 9 - 4)) as last from orders
""")
def time_window(spark, folder):
    """The first and last of a record's times, one of which is missing."""
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    other = F.expr("o_orderdate + make_interval(0, 0, 0, cast(o_custkey % 9 - 4 as int))")
    return orders.select("o_orderkey", records.time_window([F.col("o_orderdate"), F.lit(None).cast("timestamp_ntz"), other]).alias("w")).select("o_orderkey", "w.first", "w.last")


@query("""
select c_custkey, c_custkey * 2 as conid, 'Y' as side from customer
union all select c_custkey, c_custkey * 2 + 1, 'N' from customer where c_custkey % 3 > 0
""")
def contract_index(spark, folder):
    """Both sides' ids of every target; a third has no second one."""
    targets = table(spark, folder, "customer", "c_custkey").withColumns({"yes_conid": F.col("c_custkey") * 2, "no_conid": F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") * 2 + 1)})
    return ops.contract_index(targets, ["c_custkey"])


@query("""
select c_custkey, case when c_custkey % 5 > 0 then sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":' || case when c_custkey % 7 > 0 then '"' || c_name || '"' else 'null' end || '}') end as fingerprint from customer
""")
def rules_fingerprint(spark, folder):
    """Hash of each record without its threshold; none where a required field is missing."""
    rows = table(spark, folder, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment").withColumn("c_name", F.when(F.col("c_custkey") % 7 > 0, F.col("c_name")))
    found = ops.rules_fingerprint(rows, ["c_mktsegment"], "c_acctbal")
    return rows.select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, found).alias("fingerprint"))


@query("""
with p as (select event_id, case event_id % 3 when 0 then '{"success":{"value":' || props || '}}' when 1 then props else '{"success":true,"k":7}' end as payload from events)
select event_id, case event_id % 3 when 2 then 7 else cast(json_extract_string((select props from events e where e.event_id = p.event_id), '$.k') as bigint) end as k from p
""")
def unwrapped_payloads(spark, folder):
    """A field of payloads that are wrapped, plain or only say that all went well."""
    events = table(spark, folder, "events", "event_id", "props")
    payload = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"success":{"value":'), "props", F.lit("}}"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise('{"success":true,"k":7}')
    return events.select("event_id", F.get_json_object(records.unwrapped(payload), "$.k").cast("long").alias("k"))


@query("""
with d as (select cast(ts as date) as day, count(*) as n, count(distinct user_id) as users, max(value) as high from events group by 1)
select day, n, users, case when n >= 20 and users >= 10 and high < 500 then 'PASS' else 'FAIL' end as status,
       array_to_string(list_filter([case when n < 20 then 'rows' end, case when users < 10 then 'users' end, case when high >= 500 then 'range' end], lambda x: x is not null), ',') as failed from d
""")
def date_passes(spark, folder):
    """Days that fulfil all conditions, and which the others break."""
    days = table(spark, folder, "events", "ts", "user_id", "value").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.max("value").alias("high"))
    found = ops.one_date_passes(days, {"rows": F.col("n") >= 20, "users": F.col("users") >= 10, "range": F.col("high") < 500})
    return found.select("day", "n", "users", "status", F.array_join("failed", ",").alias("failed"))


@query("""
with h as (select cast(ts as date) as day, cast(extract(hour from ts) as int) as hour, count(*) as n from events group by 1, 2)
select hour, count(*) as days, sum(n)::bigint as states, round(avg(n), 6) as mean_states from h group by hour
""")
def cadence_census(spark, folder):
    """How many days have states at each hour, and how many states."""
    hours = table(spark, folder, "events", "ts").groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return hours.groupBy("hour").agg(F.count("*").alias("days"), F.sum("n").alias("states"), r6(F.avg("n")).alias("mean_states"))


@query("""
with s as (select event_id, user_id, ts from events where event_type = 'purchase')
select s.event_id, round(epoch(max(v.ts) filter (where v.ts < s.ts)) / 60 - epoch(s.ts) / 60, 3) as before_minutes,
       round(epoch(min(v.ts) filter (where v.ts >= s.ts)) / 60 - epoch(s.ts) / 60, 3) as after_minutes
from s left join events v on v.user_id = s.user_id and v.event_type = 'view' group by s.event_id, s.ts
""")
def event_offsets(spark, folder):
    """Signed minutes from each purchase to the user's view before and after it."""
    from ..operators import asof

    events = table(spark, folder, "events", "event_id", "user_id", "event_type", "ts")
    views = events.where("event_type = 'view'")
    found = asof.asof(events.where("event_type = 'purchase'"), views, ["user_id"], "ts", "ts", ["ts"], strict=True).withColumnRenamed("asof_ts", "before")
    found = asof.asof(found, views, ["user_id"], "ts", "ts", ["ts"], direction="forward")
    minutes = lambda c: F.round((F.unix_micros(F.col(c).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 60e6, 3)
    return found.select("event_id", minutes("before").alias("before_minutes"), minutes("asof_ts").alias("after_minutes"))
