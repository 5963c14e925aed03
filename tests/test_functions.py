"""Column expressions on known values."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import clocks, markets, normal, vectors


def one(spark, *columns, data=((1,),), schema="x int"):
    return tuple(spark.createDataFrame(list(data), schema).select(*columns).first())


def test_money(spark):
    assert one(spark, markets.taker_fee(F.lit(0.5)), markets.taker_fee(F.lit(0.01)), markets.taker_fee(F.lit(1.0))) == (0.02, 0.01, 0.0)
    assert one(spark, F.round(markets.stressed_pnl(F.lit(1.0), F.lit(0.995), 0.02), 9))[0] == 0.0
    cost = one(spark, markets.conservative_cost([F.lit("0.41"), F.lit("0.42")], [F.lit("0.50"), F.lit("0.49")], "0.02", "0.01", "0.0401", F.lit("0.1")))[0]
    assert str(cost) == "0.96"


def test_labels_and_numbers(spark):
    got = spark.createDataFrame([("70° or below",), ("71° to 72°",), ("79°F or above",), ("odd",)], "s string").select(markets.bucket(F.col("s")).alias("b")).collect()
    assert [tuple(r["b"]) for r in got] == [(None, 70.0), (71.0, 72.0), (79.0, None), (None, None)]
    assert one(spark, markets.parsed_number(F.lit("7,520")), markets.parsed_number(F.lit("--")), markets.parsed_number(F.lit("x1")), markets.parsed_bool(F.lit(" TRUE ")), markets.parsed_bool(F.lit(None))) == (7520.0, None, None, True, False)
    assert one(spark, markets.outcome(F.lit(" Yes")), markets.outcome(F.lit("no")), markets.outcome(F.lit("?"))) == (1, 0, None)
    assert one(spark, markets.event_date(F.lit("KXHIGH-26SEP05")), markets.event_date(F.lit("KXHIGH-26XXX05"))) == (dt.date(2026, 9, 5), None)
    assert one(spark, markets.reasons([("A", F.lit(True)), ("B", F.lit(None).cast("boolean")), ("C", F.lit(True))]), markets.first_reason([("A", F.lit(False)), ("B", F.lit(True)), ("C", F.lit(True))])) == (["A", "C"], "B")
    assert tuple(one(spark, markets.availability(F.lit("RPB")))[0]) == ("real_time", "snapshot", True)


def test_vectors(spark):
    p = F.array(*[F.lit(x) for x in (0.2, 0.5, 0.3)])
    got = one(spark, vectors.log_loss(p, F.lit(2)), vectors.brier(p, F.lit(2)), vectors.first_argmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0))), vectors.total(vectors.softmax(p)), vectors.normalised(F.array(F.lit(0.0), F.lit(0.0))))
    assert got[0] == pytest.approx(-math.log(0.5)) and got[1] == pytest.approx(0.04 + 0.25 + 0.09) and got[2] == 2 and got[3] == pytest.approx(1) and got[4] is None


def test_normal(spark):
    rows = spark.createDataFrame([(x / 10,) for x in range(-50, 51)], "x double")
    assert rows.select(F.max(F.abs(normal.cdf(F.col("x")) - normal.exact_cdf(F.col("x"))))).first()[0] < 1e-7
    mass = [normal.bucket_mass(F.lit(70.0), F.lit(3.0), F.lit(a).cast("double"), F.lit(b).cast("double"), normal.exact_cdf) for a, b in ((None, 68), (69, 70), (71, None))]
    assert sum(one(spark, *mass)) == pytest.approx(1)
    assert one(spark, normal.bucket_mass(F.lit(70.0), F.lit(0.0), F.lit(1.0), F.lit(2.0)))[0] is None


def test_day_grids_follow_the_clocks(spark):
    days = spark.createDataFrame([(dt.date(2026, 3, 8),), (dt.date(2026, 11, 1),), (dt.date(2026, 7, 1),)], "d date")
    assert [r[0] for r in days.select(F.size(clocks.day_grid(F.col("d"), F.lit("America/New_York")))).collect()] == [46, 50, 48]


def test_observation_labels(spark):
    label, zone = F.lit("KNYC 010551Z AUTO"), F.lit("America/New_York")
    got = one(spark, clocks.metar_issue(label, F.lit("2026-11-01 00:51:00").cast("timestamp"), zone).cast("string"), clocks.metar_issue(label, F.lit("2026-11-01 03:51:00").cast("timestamp"), zone).cast("string"), clocks.metar_nearest(label, F.lit("2026-10-30 00:00:00").cast("timestamp")).cast("string"))
    assert got == ("2026-11-01 04:51:00", None, "2026-11-01 05:51:00") or got == (None, None, "2026-11-01 05:51:00")
    assert one(spark, clocks.metar_issue(label, F.lit("2026-11-01 01:51:00").cast("timestamp"), zone).cast("string"))[0] == "2026-11-01 05:51:00"


def test_blocks_bins_schedules(spark):
    assert one(spark, clocks.day_block(F.lit(0)), clocks.day_block(F.lit(719)), clocks.day_block(F.lit(1439))) == ("00-06", "06-12", "18-24")
    assert one(spark, clocks.q_bin(F.lit(0.05)), clocks.q_bin(F.lit(0.15)), clocks.q_bin(F.lit(0.95)), clocks.q_bin(F.lit(0.96)), clocks.q_bin(F.lit(0.04))) == ("[0.05,0.10)", "[0.15,0.20)", "[0.90,0.95)", None, None)
    hours = F.array(F.struct(F.lit("10:00 PM").alias("open"), F.lit("2:00 AM").alias("close")))
    assert one(spark, *[clocks.schedule_open(hours, F.lit(m)) for m in (1320, 60, 120, 700)]) == (True, True, False, False)
    assert one(spark, clocks.parse_time(F.lit("2026-06-01T10:00:00Z")).cast("string"), clocks.parse_time(F.lit("1780308000")).cast("string"), clocks.parse_time(F.lit("bad"))) == ("2026-06-01 10:00:00", "2026-06-01 10:00:00", None)
    assert one(spark, clocks.local_to_utc(F.lit("2026-07-01").cast("date"), 10, F.lit("America/New_York")).cast("string"))[0] == "2026-07-01 14:00:00"
    decision = F.lit("2026-07-01 14:00:00").cast("timestamp")
    assert one(spark, clocks.latest_cycle(decision, [1, 7, 13, 19], 1.5).cast("string"))[0] == "2026-07-01 07:00:00"
