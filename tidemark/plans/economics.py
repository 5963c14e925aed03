"""Trades: candidates, decisions, profits, summaries, stress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markets
from ..operators import aggregates, asof, windows

KEYS = ["city", "event_date_local", "model"]


def candidates(predictions: DataFrame) -> DataFrame:
    """Both sides of every bucket: predictions(city, event_date_local, model, probs, buckets, outcome)."""
    each = predictions.select(*KEYS, "outcome", "probs", F.posexplode("buckets").alias("i", "b"))
    rows = each.select(*KEYS, "outcome", (F.col("i") + 1).alias("bucket_index"), F.col("b.market_ticker").alias("market_ticker"), F.get("probs", F.col("i")).alias("q"), F.col("b.yes_bid_close").alias("bid"), F.col("b.yes_ask_close").alias("ask"))
    won = (F.col("bucket_index") == F.col("outcome")).cast("double")
    yes = F.struct(F.lit("YES").alias("side"), F.lit(0).alias("side_rank"), F.col("ask").alias("price"), markets.yes_value(F.col("q"), F.col("ask")).alias("ev"), won.alias("payoff"))
    no = F.struct(F.lit("NO").alias("side"), F.lit(1).alias("side_rank"), (1 - F.col("bid")).alias("price"), markets.no_value(F.col("q"), F.col("bid")).alias("ev"), (1 - won).alias("payoff"))
    return rows.select("*", F.inline(F.array(yes, no)))


def decide(sides: DataFrame) -> DataFrame:
    """The best candidate of each event and model (the first of equals: bucket order, YES first); traded if its value is above 0."""
    best = windows.first_qualifying(sides, KEYS, F.col("ev").isNotNull(), [F.col("ev").desc(), F.col("bucket_index"), F.col("side_rank")])
    traded = F.col("ev") > 0
    pnl = F.col("payoff") - F.col("price") - markets.taker_fee(F.col("price"))
    return best.withColumns({"trade": traded, "pnl": F.when(traded, pnl)})


def summary(decided: DataFrame, keys: list[str]) -> DataFrame:
    gain = F.when(F.col("pnl") > 0, F.col("pnl"))
    return decided.groupBy(*keys).agg(
        F.count_if("trade").alias("trades"), F.count_if(~F.col("trade")).alias("no_trades"), F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("total_pnl"), F.avg("pnl").alias("mean_pnl"),
        F.avg((F.col("pnl") > 0).cast("int")).alias("win_rate"), F.max("pnl").alias("max_gain"), F.min("pnl").alias("max_loss"), F.when(F.sum(gain) > 0, F.max(gain) / F.sum(gain)).alias("largest_win_share"),
    )


def delayed_quotes(decided: DataFrame, quotes: DataFrame) -> DataFrame:
    """Trades with the quote at their exact later time (target_utc); unless exactly one is there, it is unavailable (null)."""
    later = quotes.select("market_ticker", F.col("timestamp_utc").alias("target_utc"), F.col("yes_bid_close").alias("later_bid"), F.col("yes_ask_close").alias("later_ask"))
    return asof.exactly_one(decided, later, ["market_ticker", "target_utc"], ["later_bid", "later_ask"])


def stress(decided: DataFrame, with_delay: bool = False) -> DataFrame:
    """(keys, scenario, pnl) at the price, a cent and two cents worse, and at the delayed quote."""
    traded = decided.where("trade")
    payoff, price = F.col("payoff"), F.col("price")
    scenarios = {"base": markets.stressed_pnl(payoff, price, 0.0), "plus_1c": markets.stressed_pnl(payoff, price, 0.01), "plus_2c": markets.stressed_pnl(payoff, price, 0.02)}
    if with_delay:
        later = F.when(F.col("side") == "YES", F.col("later_ask")).otherwise(1 - F.col("later_bid"))
        scenarios["delay_1h"] = F.when(later.isNotNull(), markets.stressed_pnl(payoff, later, 0.0))
    wide = traded.select(*KEYS, *[c.alias(n) for n, c in scenarios.items()])
    return wide.unpivot(KEYS, list(scenarios), "scenario", "pnl")


def stress_summary(scenarios: DataFrame) -> DataFrame:
    return scenarios.where("pnl is not null").groupBy("model", "scenario").agg(F.count("*").alias("trades"), F.sum("pnl").alias("total_pnl"), F.avg("pnl").alias("mean_pnl"), aggregates.rate(F.col("pnl") > 0).alias("win_rate"))
