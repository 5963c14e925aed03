"""The point-in-time audit: a sound event passes, and each planted fault raises its own counters."""

import datetime as dt

import pytest

from tidemark.plans import audits

DAY = dt.date(2026, 6, 1)


def utc(h, m=0, day=1):
    return dt.datetime(2026, 6, day, h, m)


QUOTE = "yes_bid_close double, yes_ask_close double, midpoint_close double, spread_close double"
#: Ten in New York is 14:00 UTC; with cycles at 1, 7, 13, 19 and an hour's lag the last cycle is 13:00, out at 14:00.
FEATURE = {"city": "NY", "event_date_local": DAY, "event_ticker": "E", "station": "KNYC", "decision_time_utc": utc(14), "cycle_time_utc": utc(13), "available_at": utc(14), "txn": 71.0, "xnd": 2.0, "market_snapshot_utc": utc(13, 50)}
WRAPPER = ("NY", "KNYC", DAY, utc(13), utc(14), utc(14))
DATA = [(utc(13), dt.datetime(2026, 6, 2), 71.0, 2.0), (utc(13), dt.datetime(2026, 6, 2, 12), 60.0, 2.0)]


def quotes():
    return [("NY", DAY, "E", f"M{k}", t, 0.1, 0.2, 0.15, 0.1) for t in (utc(13), utc(13, 50), utc(14, 30)) for k in range(6)]


def failures(spark, feature=None, weather=None, wrapper=WRAPPER, data=DATA, raw=True, rows=None, used=None):
    f = FEATURE | (feature or {})
    features = spark.createDataFrame([tuple(f.values())], "city string, event_date_local date, event_ticker string, station string, decision_time_utc timestamp, cycle_time_utc timestamp, available_at timestamp, txn double, xnd double, market_snapshot_utc timestamp")
    w = {k: f[k] for k in ("city", "event_date_local", "station", "cycle_time_utc", "available_at", "txn", "xnd")} | (weather or {})
    processed = spark.createDataFrame([tuple(w.values())], "city string, event_date_local date, station string, cycle_time_utc timestamp, available_at timestamp, txn double, xnd double")
    schema = "station string, event_date_local date, cycle_time_utc timestamp, wrapper struct<city string, station string, event_date_local date, cycle_time_utc timestamp, available_at timestamp, decision_time_utc timestamp>, data array<struct<runtime timestamp, ftime_utc timestamp, txn double, xnd double>>"
    captured = spark.createDataFrame([("KNYC", DAY, f["cycle_time_utc"], wrapper, data)] if raw else [], schema)
    cities = spark.createDataFrame([("NY", "KNYC", "America/New_York")], "city string, expected_station string, timezone string")
    book = spark.createDataFrame(rows or quotes(), f"city string, event_date_local date, event_ticker string, market_ticker string, timestamp_utc timestamp, {QUOTE}")
    taken = used or [("NY", DAY, "E", f"M{k}", f["market_snapshot_utc"], 0.1, 0.2, 0.15, 0.1) for k in range(6)]
    long = spark.createDataFrame(taken, f"city string, event_date_local date, event_ticker string, market_ticker string, market_snapshot_utc timestamp, {QUOTE}")
    found = audits.hard_failures(audits.weather_audit(features, processed, captured, cities), audits.market_audit(features, book, cities), audits.quote_audit(long, book)).first().asDict()
    assert len(found) == 23 and found.pop("passed") == (not any(found.values()))
    return {k: v for k, v in found.items() if v}


def test_a_sound_event(spark):
    assert failures(spark) == {} and failures(spark, wrapper=None) == {}


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({"feature": {"decision_time_utc": utc(15)}}, {"decision_time_mismatches", "raw_wrapper_mismatches"}),
        ({"feature": {"cycle_time_utc": utc(7), "available_at": utc(8)}}, {"nearest_cycle_substitutions", "latest_cycle_mismatches", "raw_wrapper_mismatches", "raw_runtime_mismatches"}),
        ({"feature": {"cycle_time_utc": utc(19), "available_at": utc(20)}}, {"future_cycle_violations", "unavailable_at_decision_violations", "future_substitutions", "later_missing_replacements", "nearest_cycle_substitutions", "latest_cycle_mismatches", "raw_wrapper_mismatches", "raw_runtime_mismatches"}),
        ({"feature": {"station": "KLGA"}}, {"station_mismatches"}),
        ({"feature": {"txn": None}}, {"missing_txn", "processed_weather_mismatches", "raw_txn_xnd_mismatches"}),
        ({"feature": {"xnd": None}}, {"missing_xnd", "processed_weather_mismatches", "raw_txn_xnd_mismatches"}),
        ({"weather": {"txn": 72.0}}, {"processed_weather_mismatches"}),
        ({"raw": False}, {"raw_weather_files_missing", "raw_wrapper_mismatches", "raw_target_row_failures", "raw_txn_xnd_mismatches"}),
        ({"wrapper": ("LA", *WRAPPER[1:])}, {"raw_wrapper_mismatches"}),
        ({"data": DATA[1:]}, {"raw_target_row_failures", "raw_txn_xnd_mismatches"}),
        ({"data": [*DATA, DATA[0]]}, {"raw_target_row_failures", "raw_txn_xnd_mismatches"}),
        ({"data": [(utc(13), dt.datetime(2026, 6, 2), 70.0, 2.0)]}, {"raw_txn_xnd_mismatches"}),
        ({"data": [(utc(7), dt.datetime(2026, 6, 2), 71.0, 2.0)]}, {"raw_runtime_mismatches"}),
        ({"feature": {"market_snapshot_utc": utc(14, 30)}}, {"future_market_candle_violations", "market_staleness_violations", "latest_market_snapshot_mismatches"}),
        ({"feature": {"market_snapshot_utc": utc(13)}}, {"latest_market_snapshot_mismatches"}),
        ({"rows": quotes()[:6] + quotes()[7:]}, {"incomplete_market_snapshots", "latest_market_snapshot_mismatches", "market_quote_source_rows_missing", "market_quote_value_mismatches"}),
        ({"used": [("NY", DAY, "E", "M0", utc(13, 50), 0.1, 0.25, 0.15, 0.1)]}, {"market_quote_value_mismatches"}),
    ],
)
def test_each_fault(spark, change, want):
    assert set(failures(spark, **change)) == want
