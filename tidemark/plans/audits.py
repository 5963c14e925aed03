"""The point-in-time audit: what each event should have used, worked out again from rules and raw captures, against what it did use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..expect import join_checked
from ..functions import clocks, markets
from ..operators import asof

KEYS = ["city", "event_date_local"]
QUOTE = ["yes_bid_close", "yes_ask_close", "midpoint_close", "spread_close"]
#: The local hour of decisions, the forecast's cycles and minutes until they are out, and the oldest snapshot in minutes.
DECISION_HOUR, CYCLES, LAG_MINUTES, MOST_STALE = 10, [1, 7, 13, 19], 60, 60


def _is(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def weather_audit(features: DataFrame, weather: DataFrame, raw: DataFrame, cities: DataFrame, cycles: list[int] | None = None, lag_minutes: int = LAG_MINUTES) -> DataFrame:
    """features with a flag for each rule of the forecast's side that an event keeps.

    features: city, event_date_local, station, decision_time_utc, cycle_time_utc,
    available_at, txn, xnd; weather: the processed rows, one a city-day, with the
    same columns; cities: city, expected_station, timezone; raw: station,
    event_date_local, cycle_time_utc and ``wrapper`` (struct of city, station,
    event_date_local, cycle_time_utc, available_at, decision_time_utc) with data
    (array of struct of runtime, ftime_utc, txn, xnd). The value that counts is
    the one row of the capture for midnight UTC after the event's date.
    """
    used = join_checked(features, cities, ["city"]).withColumn("expected_decision", clocks.local_to_utc(F.col("event_date_local"), DECISION_HOUR, F.col("timezone")))
    used = used.withColumn("expected_cycle", clocks.latest_cycle(F.col("expected_decision"), cycles or CYCLES, lag_minutes / 60, back_days=2))
    processed = weather.select(*KEYS, F.struct("station", "txn", "xnd", "cycle_time_utc", "available_at").alias("_w"))
    captured = raw.select(F.col("station").alias("expected_station"), "event_date_local", "cycle_time_utc", F.struct("wrapper", "data").alias("_r"))
    both = join_checked(join_checked(used, processed, KEYS), captured, ["expected_station", "event_date_local", "cycle_time_utc"])
    c, w, r = F.col, F.col("_w"), F.col("_r")
    close = lambda a, b: markets.close_to(a, b)
    target = F.date_add("event_date_local", 1).cast("timestamp")
    rows = F.filter(r["data"], lambda x: (x["ftime_utc"] == target) & x["txn"].isNotNull() & x["xnd"].isNotNull())
    one = F.get(rows, F.lit(0))
    runtimes = F.array_distinct(F.array_compact(F.transform(r["data"], lambda x: x["runtime"])))
    wrapper = {"city": c("city"), "station": c("expected_station"), "event_date_local": c("event_date_local"), "cycle_time_utc": c("cycle_time_utc"), "available_at": c("available_at"), "decision_time_utc": c("decision_time_utc")}
    same = F.lit(True)
    for name, value in wrapper.items():
        same &= r["wrapper"][name] == value
    kept = {
        "cycle_not_after_decision": c("cycle_time_utc") <= c("decision_time_utc"), "available_at_decision": c("available_at") <= c("decision_time_utc"), "no_later_cycle": c("cycle_time_utc") <= c("expected_cycle"), "latest_cycle": c("cycle_time_utc") == c("expected_cycle"),
        "decision_time": c("decision_time_utc") == c("expected_decision"), "station_right": c("station") == c("expected_station"), "has_txn": c("txn").isNotNull(), "has_xnd": c("xnd").isNotNull(),
        "processed_same": (w["station"] == c("station")) & close(w["txn"], c("txn")) & close(w["xnd"], c("xnd")) & (w["cycle_time_utc"] == c("cycle_time_utc")) & (w["available_at"] == c("available_at")),
        "raw_exists": r.isNotNull(), "raw_wrapper_same": r["wrapper"].isNull() | same, "raw_one_target": F.size(rows) == 1, "raw_values_same": (F.size(rows) == 1) & close(one["txn"], c("txn")) & close(one["xnd"], c("xnd")),
        "raw_runtime_same": (F.size(runtimes) == 0) | (F.size(runtimes) == 1) & (F.get(runtimes, F.lit(0)) == c("cycle_time_utc")),
    }
    # A capture that is not there breaks its own rule; one without a wrapper has none to compare.
    present = F.when(r.isNull(), F.lit(False))
    kept |= {n: present.otherwise(kept[n]) for n in ("raw_wrapper_same", "raw_one_target", "raw_values_same")}
    kept["raw_runtime_same"] = F.when(r.isNull(), F.lit(True)).otherwise(kept["raw_runtime_same"])
    return both.select(*features.columns, "expected_decision", "expected_cycle", *[_is(x).alias(n) for n, x in kept.items()])


def market_audit(features: DataFrame, quotes: DataFrame, cities: DataFrame, members: int = 6) -> DataFrame:
    """(keys, event_ticker, market_snapshot_utc, flags): whether each event's snapshot is its last complete one, whole, and neither later than the decision nor stale.

    quotes: keys, event_ticker, market_ticker, timestamp_utc and the QUOTE columns.
    """
    keys = [*KEYS, "event_ticker"]
    used = join_checked(features, cities, ["city"]).select(*keys, "market_snapshot_utc", clocks.local_to_utc(F.col("event_date_local"), DECISION_HOUR, F.col("timezone")).alias("decision"))
    filled = quotes.where(" and ".join(f"{q} is not null" for q in QUOTE))
    latest = asof.asof(used, asof.complete_groups(filled, keys, "timestamp_utc", "market_ticker", members), keys, "decision", "timestamp_utc", ["timestamp_utc"]).withColumnRenamed("asof_timestamp_utc", "expected_snapshot")
    whole = quotes.groupBy(*keys, F.col("timestamp_utc").alias("market_snapshot_utc")).agg(F.count("*").alias("n"), F.countDistinct("market_ticker").alias("m"), *[F.count(q).alias(f"f{i}") for i, q in enumerate(QUOTE)])
    both = join_checked(latest, whole, [*keys, "market_snapshot_utc"])
    age = (F.unix_micros("decision") - F.unix_micros("market_snapshot_utc")) / 60e6
    full = (F.col("n") == members) & (F.col("m") == members)
    for i in range(len(QUOTE)):
        full &= F.col(f"f{i}") == members
    kept = {"not_after_decision": age >= 0, "not_stale": age.between(0, MOST_STALE), "whole_snapshot": full, "latest_snapshot": F.col("market_snapshot_utc") == F.col("expected_snapshot")}
    return both.select(*keys, "market_snapshot_utc", "expected_snapshot", age.alias("snapshot_age_minutes"), *[_is(x).alias(n) for n, x in kept.items()])


def quote_audit(used: DataFrame, quotes: DataFrame) -> DataFrame:
    """used rows (keys, event_ticker, market_ticker, market_snapshot_utc, QUOTE) with whether their source row is there and has their values."""
    keys = [*KEYS, "event_ticker", "market_ticker", "market_snapshot_utc"]
    source = quotes.select(*KEYS, "event_ticker", "market_ticker", F.col("timestamp_utc").alias("market_snapshot_utc"), F.struct(*QUOTE).alias("_s"))
    both = join_checked(used, source, keys, validate="1:1")
    same = F.lit(True)
    for q in QUOTE:
        same &= markets.close_to(F.col(q), F.col("_s")[q])
    return both.select(*used.columns, F.col("_s").isNotNull().alias("source_exists"), _is(same).alias("source_same"))


def hard_failures(weather: DataFrame, market: DataFrame, quote: DataFrame) -> DataFrame:
    """One row: the 22 counts of broken rules over the three audits, and whether all are 0."""
    broken = lambda c: F.count_if(~F.col(c))
    first = {
        "future_cycle_violations": "cycle_not_after_decision", "unavailable_at_decision_violations": "available_at_decision", "future_substitutions": "no_later_cycle", "nearest_cycle_substitutions": "latest_cycle", "later_missing_replacements": "no_later_cycle", "latest_cycle_mismatches": "latest_cycle",
        "decision_time_mismatches": "decision_time", "station_mismatches": "station_right", "missing_txn": "has_txn", "missing_xnd": "has_xnd", "processed_weather_mismatches": "processed_same", "raw_weather_files_missing": "raw_exists", "raw_wrapper_mismatches": "raw_wrapper_same",
        "raw_target_row_failures": "raw_one_target", "raw_txn_xnd_mismatches": "raw_values_same", "raw_runtime_mismatches": "raw_runtime_same",
    }
    second = {"future_market_candle_violations": "not_after_decision", "market_staleness_violations": "not_stale", "incomplete_market_snapshots": "whole_snapshot", "latest_market_snapshot_mismatches": "latest_snapshot"}
    third = {"market_quote_source_rows_missing": "source_exists", "market_quote_value_mismatches": "source_same"}
    counts = [rows.agg(*[broken(c).alias(n) for n, c in named.items()]) for rows, named in ((weather, first), (market, second), (quote, third))]
    total = counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each
    return total.withColumn("passed", sum((F.col(n) for n in (*first, *second, *third)), F.lit(0)) == 0)
