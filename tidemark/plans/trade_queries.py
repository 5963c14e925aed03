"""Price, aggregate and selection queries over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markets, normal
from ..operators import aggregates, ladder, sets, windows
from .registry import query, r6, rounded, table


@query("""
select l_orderkey, l_linenumber, round((l_discount + l_tax) / 2, 6) as midpoint, round(l_tax - l_discount, 6) as spread,
       round((epoch(timestamp '2002-01-01') - epoch(l_shipdate)) / 3600.0, 6) as hours_to_close, l_shipdate <= timestamp '2000-01-01' as is_pre_close
from lineitem where l_discount is not null and l_tax is not null
""")
def panel_midpoint_spread(spark, folder):
    """Typed panel: midpoint, spread, hours to the close, and whether a row is known by then."""
    rows = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_shipdate").where("l_discount is not null and l_tax is not null")
    hours = (F.unix_seconds(F.expr("timestamp'2002-01-01 00:00:00'")) - F.unix_seconds(F.col("l_shipdate").cast("timestamp"))) / 3600.0
    return rows.select(
        "l_orderkey", "l_linenumber", r6(markets.midpoint(F.col("l_discount"), F.col("l_tax"))).alias("midpoint"), r6(markets.spread(F.col("l_discount"), F.col("l_tax"))).alias("spread"),
        r6(hours).alias("hours_to_close"), (F.col("l_shipdate") <= F.expr("timestamp_ntz'2000-01-01 00:00:00'")).alias("is_pre_close"),
    )


@query("""
select l_orderkey, l_linenumber, cast(row_number() over (partition by l_orderkey order by l_extendedprice, l_linenumber, l_partkey, l_suppkey) as int) as bucket_index from lineitem
""")
def bucket_index_rownum(spark, folder):
    rows = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    order = [F.col(c) for c in ("l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey")]
    return windows.numbered(rows, ["l_orderkey"], order, "bucket_index").select("l_orderkey", "l_linenumber", "bucket_index")


@query("""
select l_orderkey, l_linenumber, round(l_extendedprice / sum(l_extendedprice) over (partition by l_orderkey), 6) as share from lineitem
""")
def group_share(spark, folder):
    rows = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    return windows.share(rows, ["l_orderkey"], "l_extendedprice").select("l_orderkey", "l_linenumber", r6("share").alias("share"))


@query("""
with c as (select *, row_number() over (partition by l_orderkey order by l_extendedprice * (1 - l_discount) desc, l_linenumber, l_partkey, l_suppkey) as n from lineitem)
select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) as value from c where n = 1
""")
def argmax_candidate(spark, folder):
    """The best line of each order; the first of equals in a fixed order."""
    rows = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount").withColumn("value", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    best = windows.first_qualifying(rows, ["l_orderkey"], F.lit(True), [F.col("value").desc(), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")])
    return rounded(best.select("l_orderkey", "l_linenumber", "value"), "value")


@query("""
with d as (select cast(unnest(generate_series(timestamp '1995-01-01', timestamp '1996-12-31', interval 1 day)) as date) as day)
select d.day, round(coalesce(sum(o_totalprice), 0), 6) as revenue, count(o_orderkey) as n
from d left join orders on cast(o_orderdate as date) = d.day group by d.day
""")
def calendar_zero_fill(spark, folder):
    """Every day of two years with its revenue, zero where there is none."""
    orders = table(spark, folder, "orders", "o_orderdate", "o_totalprice").select(F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("revenue"))
    return rounded(aggregates.calendar_fill(orders, "day", F.expr("date'1995-01-01'"), F.expr("date'1996-12-31'"), ["revenue"]), "revenue")


@query("""
with m as (select c_nationkey as k, avg(c_acctbal) filter (c_mktsegment = 'BUILDING') as a, avg(c_acctbal) filter (c_mktsegment = 'MACHINERY') as b from customer group by 1)
select k as nation, round(a - b, 6) as delta from m where a is not null and b is not null
""")
def paired_delta(spark, folder):
    """Difference of two segments' means in each nation that has both, from one pass."""
    rows = table(spark, folder, "customer", "c_nationkey", "c_mktsegment", "c_acctbal").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    mean = lambda s: F.avg(F.when(F.col("c_mktsegment") == s, F.col("c_acctbal")))
    both = rows.groupBy(F.col("c_nationkey").alias("nation")).agg(mean("BUILDING").alias("a"), mean("MACHINERY").alias("b"))
    return both.where("a is not null and b is not null").select("nation", r6(F.col("a") - F.col("b")).alias("delta"))


@query("""
with d as (select o_orderstatus, cast(o_orderdate as date) as day, avg(o_totalprice) as m from orders group by 1, 2)
select o_orderstatus, round(avg(m), 6) as mean, count(*) as groups from d group by 1
""")
def two_level_mean(spark, folder):
    orders = table(spark, folder, "orders", "o_orderstatus", "o_orderdate", "o_totalprice").withColumn("day", F.to_date("o_orderdate"))
    return rounded(aggregates.two_level_mean(orders, ["o_orderstatus"], "day", "o_totalprice"), "mean")


@query("""
select l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) as q05, round(quantile_cont(l_extendedprice, 0.5), 6) as q50, round(quantile_cont(l_extendedprice, 0.95), 6) as q95 from lineitem group by 1
""")
def quantile_summary(spark, folder):
    x = F.col("l_extendedprice")
    lines = table(spark, folder, "lineitem", "l_returnflag", "l_extendedprice")
    return rounded(aggregates.quantiles(lines, ["l_returnflag"], "l_extendedprice", {"q05": 0.05, "q50": 0.5, "q95": 0.95}), "q05", "q50", "q95")


@query("""
select p_brand, count(p_retailprice) as n, round(avg(p_retailprice), 6) as mean, round(median(p_retailprice), 6) as median, round(stddev_samp(p_retailprice), 6) as std,
       round(min(p_retailprice), 6) as min, round(quantile_cont(p_retailprice, 0.05), 6) as p05, round(quantile_cont(p_retailprice, 0.95), 6) as p95, round(max(p_retailprice), 6) as max
from part group by 1
""")
def describe_std(spark, folder):
    found = aggregates.describe(table(spark, folder, "part", "p_brand", "p_retailprice"), ["p_brand"], "p_retailprice")
    return rounded(found, "mean", "median", "std", "min", "p05", "p95", "max")


@query("""
select o_orderpriority, count(*) filter (o_orderstatus = 'F') as n_F, count(*) filter (o_orderstatus = 'O') as n_O, count(*) filter (o_orderstatus = 'P') as n_P from orders group by 1
""")
def crosstab(spark, folder):
    return aggregates.crosstab(table(spark, folder, "orders", "o_orderpriority", "o_orderstatus"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("""
select s as o_orderstatus, count(o_orderkey) as n from (values ('F'), ('O'), ('P'), ('X')) v(s) left join orders on o_orderstatus = s group by s
""")
def fixed_categories(spark, folder):
    return aggregates.fixed_categories(table(spark, folder, "orders", "o_orderstatus"), "o_orderstatus", ["F", "O", "P", "X"])


@query("""
select l_returnflag, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 6) as beta, count(*) as n from lineitem group by 1
""")
def ratio_beta(spark, folder):
    rows = table(spark, folder, "lineitem", "l_returnflag", "l_extendedprice", "l_discount").withColumn("num", F.col("l_extendedprice") * F.col("l_discount"))
    return rounded(aggregates.ratio_of_sums(rows, ["l_returnflag"], "num", "l_extendedprice"), "beta")


@query("""
with s as (select l_suppkey, sum(l_extendedprice) as s from lineitem group by 1), p as (select l_suppkey, s / (select sum(s) from s) as share from s),
     t as (select share from p order by share desc, l_suppkey limit 5)
select round((select max(share) from t), 6) as max_share, round((select sum(share) from t), 6) as top_share, round(sum(share * share), 6) as hhi, round(1 / sum(share * share), 6) as effective from p
""")
def hhi_concentration(spark, folder):
    found = aggregates.concentration(table(spark, folder, "lineitem", "l_suppkey", "l_extendedprice"), "l_suppkey", "l_extendedprice")
    return rounded(found, "max_share", "top_share", "hhi", "effective")


@query("""
with d as (select l_returnflag, cast(l_shipdate as date) as d, sum(l_extendedprice * (l_discount - l_tax)) as p from lineitem group by 1, 2),
     r as (select *, row_number() over (partition by l_returnflag order by p desc, d) as r from d)
select l_returnflag, round(coalesce(sum(p) filter (p > 0), 0), 6) as positive_sum,
       round(case when sum(p) filter (p > 0) > 0 then coalesce(sum(p) filter (p > 0 and r <= 1), 0) / sum(p) filter (p > 0) end, 6) as top1_share,
       round(case when sum(p) filter (p > 0) > 0 then coalesce(sum(p) filter (p > 0 and r <= 3), 0) / sum(p) filter (p > 0) end, 6) as top3_share,
       round(max(p), 6) as best, round(min(p), 6) as worst from r group by 1
""")
def top_share(spark, folder):
    rows = table(spark, folder, "lineitem", "l_returnflag", "l_shipdate", "l_extendedprice", "l_discount", "l_tax")
    rows = rows.select("l_returnflag", F.to_date("l_shipdate").alias("d"), (F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("pnl"))
    found = aggregates.pnl_concentration(rows, ["l_returnflag"], "d", "pnl")
    return rounded(found, "positive_sum", "top1_share", "top3_share", "best", "worst")


_PHI = "(case when {x} >= 0 then 1 - {t} else {t} end)"


def _phi_sql(x: str) -> str:
    t = f"(1 / (1 + {normal.P} * abs({x})))"
    b = normal.B
    poly = f"{t} * ({b[0]} + {t} * ({b[1]} + {t} * ({b[2]} + {t} * ({b[3]} + {t} * {b[4]}))))"
    return _PHI.format(x=x, t=f"(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {poly})")


@query(f"""
with p as (select p_partkey, p_retailprice / 100.0 as mu, p_size as lo from part)
select p_partkey, round(greatest({_phi_sql("((lo + 5.5 - mu) / 3.0)")} - {_phi_sql("((lo - 0.5 - mu) / 3.0)")}, 0), 6) as mass from p
""")
def bucket_mass_poly(spark, folder):
    """Normal mass of a six-degree range around each part."""
    rows = table(spark, folder, "part", "p_partkey", "p_retailprice", "p_size")
    mass = normal.bucket_mass(F.col("p_retailprice") / 100.0, F.lit(3.0), F.col("p_size"), F.col("p_size") + 5)
    return rows.select("p_partkey", r6(mass).alias("mass"))


@query("select l_orderkey, l_linenumber, round(ceil(0.07 * l_discount * (1 - l_discount) * 100 - 1e-12) / 100, 6) as fee from lineitem")
def taker_fee(spark, folder):
    return table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_discount").select("l_orderkey", "l_linenumber", r6(markets.taker_fee(F.col("l_discount"))).alias("fee"))


@query("""
with l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, 0.5 + l_tax as q, 0.4 + l_discount as ask, 0.35 + l_discount as bid from lineitem),
     c as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'YES' as side, 0 as rank, q - ask - ceil(0.07 * ask * (1 - ask) * 100 - 1e-12) / 100 as ev from l
           union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'NO', 1, (1 - q) - (1 - bid) - ceil(0.07 * (1 - bid) * (1 - (1 - bid)) * 100 - 1e-12) / 100 from l),
     b as (select *, row_number() over (partition by l_orderkey order by round(ev, 9) desc, l_linenumber, rank, l_partkey, l_suppkey) as n from c)
select l_orderkey, l_linenumber, side, round(ev, 6) as ev, round(ev, 9) > 0 as trade from b where n = 1
""")
def trade_ev(spark, folder):
    """The better side of the best line of each order, and whether it is worth its cost."""
    rows = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax")
    q, ask, bid = 0.5 + F.col("l_tax"), 0.4 + F.col("l_discount"), 0.35 + F.col("l_discount")
    side = lambda name, rank, ev: F.struct(F.lit(name).alias("side"), F.lit(rank).alias("rank"), ev.alias("ev"))
    sides = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.inline(F.array(side("YES", 0, markets.yes_value(q, ask)), side("NO", 1, markets.no_value(q, bid)))))
    best = windows.first_qualifying(sides, ["l_orderkey"], F.lit(True), [F.round("ev", 9).desc(), F.col("l_linenumber"), F.col("rank"), F.col("l_partkey"), F.col("l_suppkey")])
    return best.select("l_orderkey", "l_linenumber", "side", r6("ev").alias("ev"), (F.round("ev", 9) > 0).alias("trade"))


def _stress_sql(k: float) -> str:
    p = f"least(0.3 + l_discount + {k}, 1.0)"
    return f"(case when l_returnflag = 'R' then 1.0 else 0.0 end) - {p} - ceil(0.07 * {p} * (1 - {p}) * 100 - 1e-12) / 100"


@query(f"""
with s as (select l_linestatus, 'base' as scenario, {_stress_sql(0.0)} as pnl from lineitem union all select l_linestatus, 'plus_1c', {_stress_sql(0.01)} from lineitem
           union all select l_linestatus, 'plus_2c', {_stress_sql(0.02)} from lineitem)
select l_linestatus, scenario, count(*) as trades, round(sum(pnl), 4) as total, round(avg(pnl), 6) as mean, round(avg(case when pnl > 0 then 1.0 else 0.0 end), 6) as win_rate from s group by 1, 2
""")
def stress_scenarios(spark, folder):
    """Profits at the price and one and two cents worse, by segment."""
    rows = table(spark, folder, "lineitem", "l_linestatus", "l_returnflag", "l_discount")
    payoff, price = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0), 0.3 + F.col("l_discount")
    wide = rows.select("l_linestatus", *[markets.stressed_pnl(payoff, price, k).alias(n) for n, k in (("base", 0.0), ("plus_1c", 0.01), ("plus_2c", 0.02))])
    long = wide.unpivot("l_linestatus", ["base", "plus_1c", "plus_2c"], "scenario", "pnl")
    return long.groupBy("l_linestatus", "scenario").agg(F.count("*").alias("trades"), F.round(F.sum("pnl"), 4).alias("total"), r6(F.avg("pnl")).alias("mean"), r6(aggregates.rate(F.col("pnl") > 0)).alias("win_rate"))


@query("""
select l_orderkey, l_linenumber, cast(ceil((cast(round(greatest(l_discount, l_tax), 2) as decimal(18,9)) + cast(round(l_tax, 2) as decimal(18,9)) + cast('0.02' as decimal(18,9)) + cast('0.01' as decimal(18,9))) * 100) / 100 as decimal(18,2)) as cost from lineitem
""")
def decimal_cost(spark, folder):
    """Exact cost of two legs, rounded up to a cent."""
    rows = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_tax")
    a, b = F.round("l_discount", 2), F.round("l_tax", 2)
    return rows.select("l_orderkey", "l_linenumber", markets.conservative_cost([a, b], [b, b], "0.02", "0.01", "0", F.lit(0)).alias("cost"))


@query("""
select round(sum(w), 2) as sw, round(sum(w * x), 2) as swx, round(sum(w * z), 2) as swz, round(sum(w * x * x), 2) as swxx, round(sum(w * x * z), 2) as swxz, round(sum(w * z * z), 2) as swzz, round(sum(w * y), 2) as swy, round(sum(w * x * y), 2) as swxy, round(sum(w * z * y), 2) as swzy
from (select 1 + l_tax as w, l_quantity as x, l_discount as z, l_extendedprice / 1000 as y from lineitem)
""")
def ridge_normal_eq(spark, folder):
    """Weighted normal equations of a regression, in one aggregation."""
    rows = table(spark, folder, "lineitem", "l_tax", "l_quantity", "l_discount", "l_extendedprice").select((1 + F.col("l_tax")).alias("w"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("z"), (F.col("l_extendedprice") / 1000).alias("y"))
    terms = {"sw": "w", "swx": "w*x", "swz": "w*z", "swxx": "w*x*x", "swxz": "w*x*z", "swzz": "w*z*z", "swy": "w*y", "swxy": "w*x*y", "swzy": "w*z*y"}
    return rows.agg(*[F.round(F.sum(F.expr(e)), 2).alias(n) for n, e in terms.items()])


@query("""
select * from (select l_orderkey, l_partkey as threshold, lead(l_partkey) over (partition by l_orderkey order by l_partkey) as next_threshold from (select distinct l_orderkey, l_partkey from lineitem)) where next_threshold is not null
""")
def ladder_adjacent(spark, folder):
    """Adjacent pairs of each order's ladder of parts."""
    rungs = table(spark, folder, "lineitem", "l_orderkey", "l_partkey").distinct().withColumnRenamed("l_partkey", "threshold")
    return ladder.adjacent(rungs, ["l_orderkey"], "threshold", [])


@query("""
select o_orderkey, case when o_totalprice is null then 'NO_PRICE' when o_totalprice < 1000 then 'SMALL' when o_orderstatus = 'P' then 'PENDING' else 'OK' end as reason from orders
""")
def reason_cascade(spark, folder):
    """The first failing rule of each order."""
    rules = [("NO_PRICE", F.col("o_totalprice").isNull()), ("SMALL", F.col("o_totalprice") < 1000), ("PENDING", F.col("o_orderstatus") == "P")]
    return table(spark, folder, "orders", "o_orderkey", "o_totalprice", "o_orderstatus").select("o_orderkey", markets.first_reason(rules, "OK").alias("reason"))


@query("""
select o_orderkey, array_to_string(list_filter([case when o_totalprice < 100000 then 'LOW' end, case when o_orderstatus <> 'F' then 'NOT_FINAL' end, case when o_orderpriority like '5%' then 'LATE' end], lambda x: x is not null), ',') as reasons from orders
""")
def reason_array(spark, folder):
    """All failing rules of each order, in order."""
    rules = [("LOW", F.col("o_totalprice") < 100000), ("NOT_FINAL", F.col("o_orderstatus") != "F"), ("LATE", F.startswith("o_orderpriority", F.lit("5")))]
    return table(spark, folder, "orders").select("o_orderkey", F.array_join(markets.reasons(rules), ",").alias("reasons"))


@query("""
select c_custkey from customer where c_acctbal < 0 except select o_custkey from orders where o_totalprice > 400000
""")
def set_difference(spark, folder):
    customers = table(spark, folder, "customer", "c_custkey", "c_acctbal").where("c_acctbal < 0").select("c_custkey")
    return sets.missing(customers, table(spark, folder, "orders", "o_custkey", "o_totalprice").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).distinct()


@query("""
select l.l_orderkey, l.l_linenumber, case when o.o_orderkey is null then 'MISSING' when abs(l.l_quantity - p) <= 1e-12 + 1e-9 * abs(p) then 'MATCH' else 'MISMATCH' end as status
from lineitem l left join (select o_orderkey, cast(o_orderkey % 50 + 1 as double) as p from orders where o_orderkey % 10 <> 3) o on o.o_orderkey = l.l_orderkey
""")
def reconcile_source(spark, folder):
    """Lines held against a source table: match, mismatch or missing."""
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    source = table(spark, folder, "orders", "o_orderkey").where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 50 + 1).cast("double").alias("l_quantity"))
    return sets.reconcile(lines, source, ["l_orderkey"], ["l_quantity"], carry=["l_linenumber"])


@query("""
with d as (select cast(o_orderdate as date) as day, o_orderpriority, avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end) as h, avg(o_totalprice / 600000) as p from orders group by 1, 2)
select o_orderpriority, count(*) as dates, round(avg(p), 6) as mean_predicted, round(avg(h), 6) as mean_hit, round(avg(h) - avg(p), 6) as gap, count(*) >= 100 as supported from d group by 1
""")
def q_bin_cells(spark, folder):
    """Calibration cells: means of the days' means."""
    orders = table(spark, folder, "orders").select("o_orderpriority", F.to_date("o_orderdate").alias("day"), (F.col("o_totalprice") / 600000).alias("p"), (F.col("o_orderstatus") == "F").cast("double").alias("h"))
    return rounded(aggregates.calibration_cells(orders, ["o_orderpriority"], "day", "p", "h").drop("n"), "mean_predicted", "mean_hit", "gap")


@query("""
select cast(extract(month from o_orderdate) as int) as month, count(distinct cast(o_orderdate as date)) as dates, count(*) as n, round(quantile_cont(o_totalprice, 0.01), 6) as o_totalprice_q01, round(quantile_cont(o_totalprice, 0.99), 6) as o_totalprice_q99 from orders group by 1
""")
def support_cells(spark, folder):
    orders = table(spark, folder, "orders", "o_orderdate", "o_totalprice").withColumns({"month": F.month("o_orderdate"), "day": F.to_date("o_orderdate")})
    cells = aggregates.support_cells(orders, ["month"], "day", ["o_totalprice"]).drop("supported", "o_totalprice_filled")
    return rounded(cells, "o_totalprice_q01", "o_totalprice_q99")
