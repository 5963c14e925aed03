"""Whole analyses on hand-made inputs, and the numeric kernels."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import bootstrap, economics, fits, nowcast, panel, revisions, study

DAY = dt.date(2026, 6, 1)


def utc(h, m=0):
    return dt.datetime(2026, 6, 1, h, m)


def quotes(spark):
    labels = ["70° or below", "71° to 72°", "73° or above"]
    rows = []
    for t, mids in ((utc(13), (0.2, 0.5, 0.3)), (utc(13, 50), (0.1, 0.6, 0.3)), (utc(14, 30), (0.9, 0.05, 0.05))):
        rows += [("NY", DAY, "E", f"M{k}", labels[k], t, m - 0.01, m + 0.01, m, int(k == 1)) for k, m in enumerate(mids)]
    rows.append(("NY", DAY, "E", "M0", labels[0], utc(13, 55), 0.5, 0.6, 0.55, 0))
    return spark.createDataFrame(rows, "city string, event_date_local date, event_ticker string, market_ticker string, bucket_label string, timestamp_utc timestamp, yes_bid_close double, yes_ask_close double, midpoint_close double, outcome_yes int")


def test_panel_to_features(spark):
    decided = panel.decisions(spark.createDataFrame([("NY", DAY)], "city string, event_date_local date"), spark.createDataFrame([("NY", "America/New_York")], "city string, timezone string"))
    assert decided.first()["decision_time_utc"] == utc(14)
    long = panel.snapshots(quotes(spark), decided, members=3)
    event = panel.events(long).first()
    assert [round(b["market_prob"], 6) for b in event["buckets"]] == [0.1, 0.6, 0.3] and event["outcome"] == 2 and event["contiguous"]
    out = panel.features(panel.events(long), spark.createDataFrame([("NY", DAY, 71.5, 1.0)], "city string, event_date_local date, mu double, sigma double")).first()
    assert sum(out["weather_mass"]) == pytest.approx(1) and sum(out["market_prob"]) == pytest.approx(1) and out["log_weather"][1] == max(out["log_weather"])
    assert panel.wide(panel.events(long), 3).first()["bucket_2_outcome"] == 1


def test_trades_and_stress(spark):
    decided = panel.decisions(spark.createDataFrame([("NY", DAY)], "city string, event_date_local date"), spark.createDataFrame([("NY", "America/New_York")], "city string, timezone string"))
    events = panel.events(panel.snapshots(quotes(spark), decided, members=3))
    predictions = events.select("city", "event_date_local", F.lit("M").alias("model"), F.array(F.lit(0.05), F.lit(0.9), F.lit(0.05)).alias("probs"), "buckets", "outcome")
    sides = economics.candidates(predictions)
    assert sides.count() == 6
    best = economics.decide(sides)
    row = best.first()
    assert (row["bucket_index"], row["side"], row["trade"]) == (2, "YES", True) and row["pnl"] == pytest.approx(1 - 0.61 - 0.02)
    assert economics.summary(best, ["model"]).first()["trades"] == 1
    found = {r["scenario"]: r["total_pnl"] for r in economics.stress_summary(economics.stress(best)).collect()}
    assert found["base"] > found["plus_1c"] > found["plus_2c"]


def test_revisions(spark):
    states = [("NY", DAY, f"S{k}", True, utc(h), mu, 2.0) for k, (h, mu) in enumerate([(8, 70.0), (10, 71.0), (13, 71.0)])] + [("NY", DAY, "S9", False, utc(11), 0.0, 1.0)]
    table = spark.createDataFrame(states, "city string, event_date_local date, state_label string, usable boolean, published_at timestamp, mu double, sigma double")
    pairs = revisions.pairs(table)
    assert [(r["old_state_label"], r["state_label"], r["changed"]) for r in pairs.orderBy("published_at").collect()] == [("S0", "S1", True), ("S1", "S2", False)]
    complete = spark.createDataFrame([("NY", DAY, utc(9, 30)), ("NY", DAY, utc(10)), ("NY", DAY, utc(11, 10)), ("NY", DAY, utc(14))], "city string, event_date_local date, timestamp_utc timestamp")
    first = revisions.aligned(pairs, complete).orderBy("published_at").first()
    assert (first["pre_utc"], first["pre_ok"], first["post_1h_utc"], first["post_1h_ok"], first["post_2h_ok"]) == (utc(9, 30), True, utc(11, 10), True, False)
    vectors = spark.createDataFrame([([0.5, 0.5], [0.6, 0.4], [0.5, 0.5], [0.55, 0.45])], "q_old array<double>, q_new array<double>, p_pre array<double>, p_post array<double>")
    assert revisions.beta(revisions.market_reaction(vectors)).first()["beta"] == pytest.approx(0.5)
    assert revisions.beta(revisions.residual_assimilation(vectors)).first()["beta"] == pytest.approx(0.5)


def test_bootstrap(spark):
    rng = np.random.default_rng(5)
    places = bootstrap.block_starts(10, 3, 4, rng)
    assert places.shape == (4, 10) and all((np.diff(r)[[0, 1, 3, 4, 6, 7]] == 1).all() for r in places)
    days = spark.createDataFrame([(i, float(i % 4), 2.0) for i in range(10)], "d int, num double, den double")
    values = {r["rep"]: r["value"] for r in bootstrap.replicates(days, "d", "num", "den", places).collect()}
    num = np.array([i % 4 for i in range(10)], dtype=float)
    assert values == {k: pytest.approx(num[p].sum() / 20) for k, p in enumerate(places)}
    got = bootstrap.ratio_interval(days, "d", "num", "den", 3, 200, 1).first()
    assert got["low"] <= got["estimate"] <= got["high"] and got["reps"] == 200
    with pytest.raises(ValueError):
        bootstrap.block_starts(3, 4, 1, rng)


def test_softmax_fit_is_stationary():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 4, 2))
    p = fits.predict_softmax(np.array([0.3, -0.2, 0.1, 1.0, -0.5]), x)
    y = np.array([rng.choice(4, p=q) for q in p])
    theta = fits.fit_softmax(x, y, 0.01)

    def loss(t):
        return -np.log(fits.predict_softmax(t, x)[np.arange(200), y]).mean() + 0.005 * (t[3:] ** 2).sum()

    assert all(loss(theta) <= loss(theta + d) for d in 1e-3 * rng.normal(size=(50, 5)))
    assert theta[3] == pytest.approx(1.0, abs=0.4)


def test_location_scale(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i // 10), float(x), float(2 + 3 * x + e)) for i, (x, e) in enumerate(zip(rng.normal(size=400), rng.normal(size=400), strict=True))]
    table = spark.createDataFrame(rows, "date int, x double, y double")
    model = nowcast.fit_location_scale(table.where("date < 20"), table.where("date >= 20"), ["x"], "y", "date", alpha=0.1)
    got = nowcast.scored(table, model, "y").agg(F.avg("pit").alias("p"), F.avg(F.col("in_80").cast("int")).alias("c"), F.min("pit"), F.max("pit")).first()
    assert got["p"] == pytest.approx(0.5, abs=0.1) and got["c"] == pytest.approx(0.8, abs=0.12)
    with pytest.raises(ValueError):
        nowcast.fit_location_scale(table.withColumn("x", F.lit(1.0)), table, ["x"], "y", "date")


def test_state_grid_has_no_future(spark):
    seen = spark.createDataFrame([("K", dt.datetime(2026, 6, 1, h), float(t)) for h, t in ((5, 60), (9, 70), (15, 66))], "station string, utc timestamp, temperature_f double")
    days = spark.createDataFrame([("K", DAY, "America/New_York", 72.0)], "station string, event_date date, timezone string, final_max_f double")
    rows = {r["utc"]: r for r in nowcast.state_grid(days, seen).collect()}
    assert len(rows) == 48
    assert rows[utc(4)]["available"] is False and rows[utc(9)]["running_max"] == 70 and rows[utc(8, 30)]["running_max"] == 60
    late = rows[utc(16)]
    assert (late["temperature_f"], late["age_minutes"], late["change_60"], late["residual"]) == (66.0, 60.0, 0.0, 2.0)


def test_day_health_and_endpoint(spark):
    slots = spark.range(960).select(F.lit("d1").alias("date"), F.col("id").cast("int").alias("slot"), (~F.col("id").isin(5, 6, 100)).alias("valid"))
    broken = slots.withColumns({"date": F.lit("d2"), "valid": ~F.col("slot").isin(5, 6, 7)}).where("slot <> 8")
    got = {r["date"]: (r["normal"], r["longest_invalid"], r["healthy"]) for r in study.day_health(slots.unionByName(broken)).collect()}
    assert got == {"d1": (957, 2, True), "d2": (956, 4, False)}
    ledger = study.date_ledger("2026-06-01", 3, spark)
    hits = spark.createDataFrame([("NY", dt.date(2026, 6, 1)), ("LA", dt.date(2026, 6, 2))], "city string, date date")
    ends = study.endpoint(ledger, hits, spark.createDataFrame([(dt.date(2026, 6, 2),)], "date date"))
    assert [r["hit"] for r in ends.orderBy("date").collect()] == [1, 0, 0]


def test_questions_and_audits(spark):
    got = spark.createDataFrame([("Will the temperature on June 5, 2026 exceed 71.50 °F in NY?",), ("no date",)], "q string").select(study.question(F.col("q")).alias("x")).collect()
    assert got[0]["x"]["date"] == dt.date(2026, 6, 5) and float(got[0]["x"]["threshold"]) == 71.5 and got[1]["x"] is None
    rows = spark.createDataFrame([(1, 2), (3, 2), (None, 2)], "a int, b int")
    audit = study.point_in_time_audit(rows, {"late": F.col("a") <= F.col("b"), "set": F.col("b").isNotNull()}).first()
    assert (audit["late"], audit["set"], audit["passed"]) == (2, 0, False)
    contracts = spark.createDataFrame([("c", DAY, t, s, i, "h") for i, (t, s) in enumerate([(70, "Y"), (70, "N"), (72, "Y"), (72, "N")])], "city string, date date, threshold int, side string, conid int, rules_hash string")
    assert study.adjacent_pairs(contracts).first()["pair_id"] == "c|70|0|3"
    expected = spark.createDataFrame([(1,), (2,)], "slot int")
    assert {r["problem"]: r["rows"] for r in study.coverage(spark.createDataFrame([(1,), (1,), (9,)], "slot int"), expected, ["slot"]).collect()} == {"MISSING": 1, "UNKNOWN": 1, "REPEATED": 1}


def test_order_interval_of_flags(spark):
    """Against a plain loop over the same draws; constant series have no interval."""
    import random

    flags = [int(i % 3 == 0 or i > 15) for i in range(23)]
    days = spark.createDataFrame(list(enumerate(flags)), "day int, y int")
    draw, means = random.Random(7 + 4), []
    for _ in range(60):
        taken = []
        while len(taken) < len(flags):
            at = draw.choice(list(range(len(flags) - 3)))
            taken += flags[at : at + 4]
        means.append(sum(taken[: len(flags)]) / len(flags))
    means.sort()
    got = bootstrap.order_interval(days, "day", "y", 4, 60, 7).first()
    assert abs(got["low"] - means[int(0.025 * 59)]) < 1e-12 and abs(got["high"] - means[int(0.975 * 59)]) < 1e-12
    assert bootstrap.order_interval(days.where("day < 0"), "day", "y", 4, 60, 7).first()["low"] is None
    assert bootstrap.order_interval(days.withColumn("y", F.lit(1)), "day", "y", 4, 60, 7).first()["high"] is None


def test_date_intervals_share_one_draw(spark):
    values = np.random.default_rng(1).normal(size=(17, 2))
    days = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(values)], "day int, a double, b double")
    rng = np.random.default_rng(3)
    means = np.array([values[rng.integers(0, 17, size=17)].mean(axis=0) for _ in range(80)])
    got = {r["metric"]: r for r in bootstrap.date_intervals(days, "day", ["a", "b"], 80, 3).collect()}
    for j, m in enumerate(("a", "b")):
        assert np.allclose([got[m]["estimate"], got[m]["low"], got[m]["high"]], [values[:, j].mean(), *np.quantile(means[:, j], [0.025, 0.975])])
