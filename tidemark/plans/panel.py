"""From quotes and forecasts to one event table: decision times, complete snapshots, vectors, features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..expect import join_checked, unique
from ..functions import clocks, markets, normal, vectors
from ..operators import asof, windows

KEYS = ["city", "event_date_local"]


def decisions(city_days: DataFrame, zones: DataFrame, hour: int = 10) -> DataFrame:
    """(city, event_date_local, decision_time_utc): a local wall-clock hour of each city-day."""
    return city_days.join(zones, "city").select(*KEYS, clocks.local_to_utc(F.col("event_date_local"), hour, F.col("timezone")).alias("decision_time_utc"))


def snapshots(panel: DataFrame, decided: DataFrame, members: int = 6) -> DataFrame:
    """The quotes of each event's last complete snapshot at or before its decision, by bucket, with market probabilities."""
    quotes = panel.where("yes_bid_close is not null and yes_ask_close is not null")
    chosen = asof.latest_complete(quotes, decided, KEYS, "timestamp_utc", "decision_time_utc", "market_ticker", members)
    ranged = chosen.withColumn("range", markets.bucket(F.col("bucket_label"))).withColumns({"lower_f": F.col("range.lower"), "upper_f": F.col("range.upper")}).drop("range")
    placed = windows.numbered(ranged, KEYS, [F.coalesce("lower_f", F.lit(-1e9)), F.col("market_ticker")], "bucket_index")
    shared = windows.share(placed, KEYS, "midpoint_close", "market_prob")
    age = (F.unix_micros("decision_time_utc") - F.unix_micros("timestamp_utc")) / 60e6
    return shared.withColumns({"snapshot_age_minutes": age, "snapshot_fresh": F.coalesce(age.between(0, 60), F.lit(False))})


def events(long: DataFrame) -> DataFrame:
    """One row an event: buckets as an array of structs in order of bucket_index, the outcome's place or null."""
    fields = ["bucket_index", "market_ticker", "bucket_label", "lower_f", "upper_f", "yes_bid_close", "yes_ask_close", "midpoint_close", "market_prob", "outcome_yes"]
    grouped = long.groupBy(*KEYS, "event_ticker", "decision_time_utc").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("buckets"))
    won = F.filter(F.transform("buckets", lambda b: F.when(b["outcome_yes"] == 1, b["bucket_index"])), lambda i: i.isNotNull())
    return grouped.withColumns({"outcome": F.when(F.size(won) == 1, F.get(won, F.lit(0))), "contiguous": _contiguous()})


def _contiguous():
    """Every range but the last ends one below the start of the next."""
    n = F.size("buckets")
    steps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.element_at("buckets", i)["upper_f"] + 1 == F.element_at("buckets", i + 1)["lower_f"])
    return F.when(n > 1, F.coalesce(F.forall(steps, lambda x: x), F.lit(False))).otherwise(F.lit(False))


def features(event_table: DataFrame, weather: DataFrame) -> DataFrame:
    """Events with the forecast's bucket masses, and logs of forecast and market probabilities.

    weather: (city, event_date_local, mu, sigma). Masses use the exact normal
    distribution; the whole ladder is one array, exploded once for it.
    """
    joined = join_checked(event_table, weather, KEYS)
    each = joined.select(*KEYS, "mu", "sigma", F.posexplode("buckets").alias("i", "b"))
    mass = normal.bucket_mass(F.col("mu"), F.col("sigma"), F.col("b.lower_f"), F.col("b.upper_f"), normal.exact_cdf)
    masses = each.select(*KEYS, "i", mass.alias("m")).groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("weather_mass"))
    out = joined.join(masses, KEYS, "left")
    market = F.transform("buckets", lambda b: b["market_prob"])
    return out.withColumns({"weather_prob": vectors.clipped(F.col("weather_mass")), "log_weather": vectors.logs(F.col("weather_mass")), "market_prob": market, "log_market": vectors.logs(market)})


def wide(event_table: DataFrame, members: int = 6) -> DataFrame:
    """The export layout: columns bucket_1_label ... of every bucket."""
    flat = [F.element_at("buckets", k)[f].alias(f"bucket_{k}_{n}") for k in range(1, members + 1) for f, n in (("bucket_label", "label"), ("lower_f", "lower_f"), ("upper_f", "upper_f"), ("yes_bid_close", "bid"), ("yes_ask_close", "ask"), ("midpoint_close", "midpoint"), ("market_prob", "market_prob"), ("outcome_yes", "outcome"))]
    return event_table.select(*KEYS, "event_ticker", "decision_time_utc", "outcome", *flat)


def weather_days(forecast: DataFrame, city_days: DataFrame) -> DataFrame:
    """city_days(city, event_date_local, station, cycle, target_utc) with mu and sigma where exactly one forecast row fits, else why not."""
    rows = forecast.where("txn is not null and xnd is not null").select("station", F.col("runtime").alias("cycle"), F.col("ftime_utc").alias("target_utc"), F.col("txn").alias("mu"), F.col("xnd").alias("sigma"))
    keys = ["station", "cycle", "target_utc"]
    joined = asof.exactly_one(city_days, rows, keys, ["mu", "sigma"])
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    reason = markets.first_reason([("NO_CYCLE", F.col("cycle").isNull()), ("NO_FORECAST_ROW", F.col("_n").isNull()), ("AMBIGUOUS", F.col("_n") > 1), ("BAD_SIGMA", F.col("sigma") <= 0)])
    return joined.join(counts, keys, "left").withColumn("missing_reason", reason).drop("_n")


def published_cycle(city_days: DataFrame, cycles: DataFrame, decision: str = "decision_time_utc") -> DataFrame:
    """Each row's latest cycle among those published by its decision: cycles(cycle, published_at)."""
    unique(cycles, ["cycle"])
    days = city_days.withColumn("_all", F.lit(0))
    known = cycles.withColumn("_all", F.lit(0))
    found = asof.asof(days, known.withColumn("_cycle", F.col("cycle")), ["_all"], decision, "published_at", ["_cycle"])
    return found.withColumnRenamed("asof__cycle", "cycle").drop("_all")


def quality(panel: DataFrame) -> DataFrame:
    """One row of counts: rows, events, duplicate keys, missing quotes, rows after the close."""
    duplicate = panel.withColumn("_n", F.row_number().over(W.partitionBy("market_ticker", "candle_end_ts").orderBy("event_ticker")))
    return duplicate.agg(
        F.count("*").alias("rows"), F.countDistinct("event_ticker").alias("events"), F.count_if(F.col("_n") > 1).alias("duplicate_keys"),
        F.count_if(F.col("yes_bid_close").isNull() | F.col("yes_ask_close").isNull()).alias("missing_quotes"), F.count_if(~F.coalesce("is_pre_close", F.lit(True))).alias("after_close"),
    )
