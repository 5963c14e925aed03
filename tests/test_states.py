"""Distributions, states at instants, supports and the screen against plain loops."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.expect import ExpectationError
from tidemark.functions import markets
from tidemark.operators import aggregates, distributions, versions
from tidemark.plans import bootstrap, fits, nowcast

DAY = dt.date(2026, 6, 1)


def test_distributions_are_exact(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "SLICE_ROWS", 20)
    rng = np.random.default_rng(3)
    sample = [("a", float(np.round(z, 1)), float(w)) for z, w in zip(rng.normal(size=900), rng.uniform(0.1, 2, 900), strict=True)] + [("b", 1.0, 2.0), (None, 0.5, 1.0), (None, 1.5, 1.0)]
    points = [("a", float(np.round(x, 1))) for x in rng.normal(size=40) * 2] + [("b", 1.0), ("b", 0.0), (None, 1.0), ("c", 1.0), ("a", None)]
    z = spark.createDataFrame([*sample, ("a", None, 1.0), ("a", 3.0, None)], "k string, z double, w double")
    found = distributions.crps(spark.createDataFrame(points, "k string, a double"), "a", z, ["k"], "z", "w", F.lit(3.0)).collect()
    assert len(found) == len(points)
    for r in found:
        own = [(v, w) for k, v, w in sample if k == r["k"]]
        if r["a"] is None or not own:
            assert r["cdf"] is None and r["crps"] is None
            continue
        v, w = np.array(own).T
        near = (w * abs(v - r["a"])).sum() / w.sum()
        pairs = (w[:, None] * w[None, :] * abs(v[:, None] - v[None, :])).sum() / w.sum() ** 2
        assert r["cdf"] == pytest.approx(w[v <= r["a"]].sum() / w.sum(), abs=1e-12)
        assert r["mean_distance"] == pytest.approx(near, abs=1e-9) and r["crps"] == pytest.approx(3 * (near - pairs / 2), abs=1e-9)


def test_moments_of_large_values(spark):
    rows = spark.createDataFrame([("a", 1e8 + x, 1.0) for x in (0.0, 1.0, 2.0)] + [("b", 5.0, 2.0), ("b", None, 9.0), (None, 1.0, 1.0)], "k string, x double, w double")
    got = {r["k"]: r for r in aggregates.weighted_moments(rows, ["k"], "x", "w").collect()}
    assert got["a"]["weighted_std"] == pytest.approx(math.sqrt(2 / 3), abs=1e-9) and got["b"]["weighted_std"] == 0 and got[None]["weighted_mean"] == 1
    few = rows.where("k = 'a'")
    means, spread = aggregates.centre_and_scale(few, ["x"], "w")
    assert means == [1e8 + 1] and spread[0] == pytest.approx(0.816497, abs=1e-6)
    with pytest.raises(ExpectationError):
        aggregates.centre_and_scale(rows.where("k = 'b' and x is not null"), ["x"], "w")
    with pytest.raises(ExpectationError):
        aggregates.centre_and_scale(few.withColumn("w", F.lit(0.0)), ["x"], "w")


def test_calibration_intervals_and_support(spark):
    rng = np.random.default_rng(2)
    rows = [(k, d, float(rng.uniform()), float(rng.integers(0, 2))) for k in "ba" for d in range(12) for _ in range(rng.integers(1, 4))]
    got = {r["k"]: r for r in aggregates.calibration_cells(spark.createDataFrame(rows, "k string, d int, q double, y double"), ["k"], "d", "q", "y", 12, 300, 50).collect()}
    for place, k in ((1, "a"), (2, "b")):
        days = [[(q, y) for c, e, q, y in rows if (c, e) == (k, d)] for d in range(12)]
        gaps = np.array([np.mean([y for _, y in x]) - np.mean([q for q, _ in x]) for x in days])
        draw = np.random.default_rng(50 + place)
        low, high = np.quantile([gaps[draw.integers(0, 12, size=12)].mean() for _ in range(300)], [0.025, 0.975])
        assert (got[k]["low"], got[k]["high"]) == (pytest.approx(low), pytest.approx(high)) and got[k]["slack"] == pytest.approx(max(abs(low), abs(high)))
        assert got[k]["supported"] and got[k]["n"] == sum(c == k for c, *_ in rows)
    cells = aggregates.support_cells(spark.createDataFrame([(1, 1, 1.0, None), (1, 1, 2.0, 3.0), (1, 2, None, None)], "m int, d int, x double, t double"), ["m"], "d", ["x", "t"], 2, "t").first()
    assert (cells["dates"], cells["n"], cells["supported"], cells["x_filled"], cells["missing_trend_dates"], cells["t_q01"]) == (2, 3, True, 2, 2, 3.0)


def plain_state(seen, t, minutes=60):
    known = {}
    for issue, got, value in seen:
        if got <= t and issue <= t and (issue not in known or got >= known[issue][0]):
            known[issue] = (got, value)
    if not known:
        return None
    issues = sorted(known)
    old = [i for i in issues if i <= t - dt.timedelta(minutes=minutes)]
    current = known[issues[-1]][1]
    return current, max(v for _, v in known.values()), (t - issues[-1]).total_seconds() / 60, current - known[old[-1]][1] if old else None, len(known)


@pytest.mark.parametrize("width", [3600, 6 * 3600])
def test_state_at(spark, width, monkeypatch):
    monkeypatch.setattr(versions.active_at, "__defaults__", (width,))
    rng = random.Random(width)
    start = dt.datetime(2026, 6, 1)
    at = lambda m: start + dt.timedelta(minutes=m)
    seen, quotes = [], []
    for k in "abc":
        for i in range(70):
            issue = rng.randrange(0, 1800, 20)
            got = {issue + rng.choice([0, 3, 3, 40, 200, 900, -15]) for _ in range(rng.randint(1, 3))}
            seen += [(k, at(issue), at(g), float(rng.randint(50, 90))) for g in got]
        quotes += [(k, n, at(rng.randrange(-30, 3000))) for n in range(60)]
    unique = {(k, i, g): v for k, i, g, v in seen}
    table = spark.createDataFrame([(*x, v) for x, v in unique.items()] + [("a", None, at(5), 99.0), (None, at(1), at(2), 99.0), ("a", at(1), at(2), None)], "k string, issue timestamp, got timestamp, v double")
    asked = spark.createDataFrame([*quotes, ("d", 1, at(5)), ("a", 99, None), (None, 98, at(60))], "k string, n int, t timestamp")
    found = versions.state_at(asked, table, ["k"], "t", "issue", "got", "v", F.lit(DAY), F.lit(DAY)).collect()
    assert len(found) == len(quotes) + 3
    for r in found:
        want = r["k"] and r["t"] and plain_state([(i, g, v) for (k, i, g), v in unique.items() if k == r["k"]], r["t"])
        assert (r["known"] == 0) == (not want) and not r["clash"]
        if want:
            assert (r["current"], r["running_max"], r["age_minutes"], r["change"], r["known"]) == want and r["below_max"] == want[0] - want[1]


def test_state_at_midnight_and_a_clock_change(spark):
    at = dt.datetime
    seen = spark.createDataFrame([("s", at(2026, 11, 1, 4, 30), at(2026, 11, 1, 4, 31), 60.0), ("s", at(2026, 11, 1, 4, 30), at(2026, 11, 1, 4, 31), 61.0), ("s", at(2026, 11, 1, 6, 30), at(2026, 11, 1, 6, 31), 50.0)], "k string, issue timestamp, got timestamp, v double")
    # In Chicago 1 November 2026 begins at 05:00 UTC and has 25 hours: it ends at 06:00 UTC of the 2nd.
    times = [at(2026, 11, 1, 4, 45), at(2026, 11, 1, 5, 0), at(2026, 11, 1, 6, 31), at(2026, 11, 2, 5, 59), at(2026, 11, 2, 6, 0)]
    asked = spark.createDataFrame([("s", t, dt.date(2026, 11, 1)) for t in times], "k string, t timestamp, d date")
    found = versions.state_at(asked, seen, ["k"], "t", "issue", "got", "v", F.col("d"), F.to_date(F.from_utc_timestamp("t", "America/Chicago"))).orderBy("t").collect()
    assert [(r["known"], r["current"], r["clash"]) for r in found] == [(0, None, False), (1, 61.0, True), (2, 50.0, True), (2, 50.0, True), (0, None, False)]


def test_quote_problems(spark):
    cases = [
        (("real_time", True, True, "0.4", "7,520"), []),
        ((None, None, False, None, "-"), markets.QUOTE_REASONS),
        (("real_time", True, True, "1.0", "0"), markets.QUOTE_REASONS[3:]),
        (("delayed", True, True, "nan", " 3 "), [markets.QUOTE_REASONS[0], markets.QUOTE_REASONS[3]]),
        (("real_time", False, True, "0,4", "x"), [markets.QUOTE_REASONS[1], *markets.QUOTE_REASONS[3:]]),
    ]
    rows = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, delivery string, ap boolean, sp boolean, ask string, size string")
    got = rows.select("i", markets.quote_problems(*[F.col(c) for c in ("delivery", "ap", "sp", "ask", "size")]).alias("p")).orderBy("i").collect()
    assert [r["p"] for r in got] == [w for _, w in cases]


def test_bins(spark):
    q = [0.0499, 0.05, 0.0999999, 0.10, 0.5, 0.949, 0.95, 0.951, None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(q)], "i int, q double").select("i", nowcast.q_bin(F.col("q")).alias("b")).orderBy("i").collect()

    def label(x):
        if x is None or not 0.05 <= x <= 0.95:
            return None
        low = 0.9 if math.isclose(x, 0.95, abs_tol=1e-12) else math.floor((x - 0.05) / 0.05) * 0.05 + 0.05
        return f"{round(low, 10):.2f}-{round(low + 0.05, 10):.2f}"

    assert [r["b"] for r in got] == [label(x) for x in q]


def model(spark):
    z = spark.createDataFrame([(x, 1.0) for x in (-1.0, 0.0, 0.5, 1.0, 2.0)], "z double, w double")
    flat = np.array([1.0] + [0.0] * len(nowcast.FEATURES))
    return nowcast.LocationScale(nowcast.FEATURES, np.zeros(9), np.ones(9), flat, np.zeros(10), z, {q: 0.5 for q in (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)})


def test_screen(spark):
    """One quote for each fault, in the order in which faults are found."""
    at = lambda h, m=0: dt.datetime(2026, 6, 1, h, m)
    seen = spark.createDataFrame([("K", DAY, at(h), at(h, 2), float(t)) for h, t in ((12, 70), (13, 74), (14, 72), (15, 73))], "station string, event_date date, issue timestamp, received timestamp, temperature double")
    good = ("K", DAY, at(15, 30), 75.0, "Y", "real_time", True, True, "0.10", "1,000")
    change = lambda i, x: (*good[:i], x, *good[i + 1 :])
    cases = {
        "good": good, "no": change(4, "n"), "dear": change(8, "0.40"), "stale": change(5, "delayed"), "early": change(2, at(11)), "other day": change(1, dt.date(2026, 6, 2)), "far": change(3, 99.0), "old": change(2, at(16, 59)), "trend": change(2, at(12, 30)),
    }
    quotes = spark.createDataFrame([(n, *q) for n, q in cases.items()], "name string, station string, event_date date, received_at timestamp, threshold double, side string, delivery string, ask_present boolean, size_present boolean, ask string, ask_size string")
    ranges = {f"{c}_{e}": v for c, (a, b) in {"running_max": (60.0, 80.0), "below_max": (-9.0, 0.0), "age_minutes": (0.0, 200.0), "change": (-9.0, 9.0)}.items() for e, v in (("q01", a), ("q99", b))}
    cells = spark.createDataFrame([{"month": 6, "block": b, "supported": True, "missing_trend_dates": 3, **ranges} for b in ("06-12", "12-18")])
    # mu 1, sigma 1: the good quote's delta is 1 and its q = P(Z > 0) = 0.6.
    slacks = spark.createDataFrame([(b, q, q != "0.80-0.85", 0.25) for b in ("06-12", "12-18") for q in ("0.55-0.60", "0.60-0.65", "0.80-0.85")], "block string, q_bin string, supported boolean, slack double")
    out = nowcast.screen(quotes, seen, model(spark), cells, slacks, 0.02, "America/Chicago")
    got = {r["name"]: r for r in out.collect()}
    assert len(got) == len(cases)
    assert got["good"]["status"] == nowcast.STATUSES[2] and got["good"]["q"] == pytest.approx(0.6) and got["good"]["margin"] == pytest.approx(0.35 - 0.1 - 0.02) and got["good"]["ask_size"] == 1000
    assert got["no"]["status"] == nowcast.STATUSES[2] and got["no"]["margin"] == pytest.approx(1 - 0.85 - 0.12)
    assert got["dear"]["status"] == nowcast.STATUSES[3] and got["dear"]["margin"] == pytest.approx(0.35 - 0.4 - 0.02)
    assert got["stale"]["status"] == nowcast.STATUSES[0] and got["stale"]["quote_problems"] == ["not_real_time"] and got["stale"]["margin"] is None
    assert got["early"]["support_problems"] == [nowcast.NO_STATE] and got["other day"]["support_problems"] == [nowcast.NO_STATE]
    assert got["far"]["support_problems"] == ["threshold_delta_outside_frozen_range", "q_hat_outside_frozen_range", "calibration_cell_missing_or_failed"]
    assert got["old"]["support_problems"] == ["observation_age_exceeds_frozen_limit"]
    assert got["trend"]["support_problems"][0] == "temp_change_missing_without_frozen_support"
    total = nowcast.screen_summary(out).first()
    assert (total["quotes"], total["invalid"], total["insufficient"], total["Y_supported"]) == (9, 1, 5, 2) and (total["positive"], total["nonpositive"]) == (2, 1)
    clash = seen.unionByName(seen.limit(1).withColumn("temperature", F.lit(1.0)))
    with pytest.raises(ExpectationError):
        nowcast.screen(quotes, clash, model(spark), cells, slacks, 0.02, "America/Chicago")


def test_scored_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i // 10), float(x), float(2 + 3 * x + e)) for i, (x, e) in enumerate(zip(rng.normal(size=400), rng.normal(size=400), strict=True))]
    table = spark.createDataFrame(rows, "date int, x double, y double")
    fitted = nowcast.fit_location_scale(table.where("date < 20"), table.where("date >= 20"), ["x"], "y", "date", alpha=0.1)
    z = np.sort([r["z"] for r in fitted.z.collect()])
    w = np.full(len(z), 1 / len(z))
    quantile = lambda q: z[min(int(np.searchsorted(np.cumsum(w), q - 1e-12)), len(z) - 1)]
    scored = nowcast.scored(table, fitted, "y").collect()
    pairs = abs(z[:, None] - z[None, :]).mean()
    for r in scored[::7]:
        a = (r["y"] - r["mu"]) / r["sigma"]
        assert r["pit"] == pytest.approx((z <= a).mean(), abs=1e-9) and r["crps"] == pytest.approx(r["sigma"] * (abs(z - a).mean() - pairs / 2), abs=1e-9)
        assert r["median"] == pytest.approx(r["mu"] + r["sigma"] * quantile(0.5)) and r["width_80"] == pytest.approx(r["sigma"] * (quantile(0.9) - quantile(0.1)))
        assert r["in_50"] == (r["mu"] + r["sigma"] * quantile(0.25) <= r["y"] <= r["mu"] + r["sigma"] * quantile(0.75))
    total = nowcast.metric_summary(nowcast.scored(table, fitted, "y"), "date").first()
    assert total["crps"] == pytest.approx(np.mean([r["crps"] for r in scored])) and total["coverage_80"] == pytest.approx(np.mean([r["in_80"] for r in scored])) and sum(total["pit_deciles"]) == pytest.approx(1)
    high = nowcast.probability_above(table.withColumns({"limit": F.lit(3.0), "top": F.lit(1.0)}), fitted, "limit", "top").collect()
    assert all(r["q"] == pytest.approx((z > (2 - r["mu"]) / r["sigma"]).mean(), abs=1e-9) for r in high[::9])
    cells = nowcast.threshold_rows(nowcast.scored(table, fitted, "y"), fitted, "y", range(0, 3)).collect()
    assert 0 < len(cells) < 1200 and all(r["hit"] == float(r["y"] > r["delta"]) for r in cells)


def fold_rows(spark, days=20, events=9):
    rng = np.random.default_rng(4)
    rows, k = [], 4
    for d in range(days):
        for e in range(events):
            a, b = rng.normal(size=(2, k))
            s = a + 0.5 * b + np.array([0, 0.3, -0.2, 0.1])
            p = np.exp(s) / np.exp(s).sum()
            rows.append((DAY + dt.timedelta(days=d), e, int(rng.choice(k, p=p)), [float(x) for x in a], [float(x) for x in b]))
    return rows, spark.createDataFrame(rows, "day date, e int, outcome int, a array<double>, b array<double>").repartition(3)


def test_rolling_fits_equal_single_ones(spark):
    rows, table = fold_rows(spark)
    models, lams = {"M0": ("a",), "M1": ("b",), "M2": ("a", "b")}, [0.001, 0.1, 5.0]
    found = {(r["day"], r["model"], r["lam"]): r for r in fits.rolling_origin(table, models, lams, 14, 4).collect()}
    assert len(found) == 6 * 9
    for (day, name, lam), r in list(found.items())[::5]:
        pick = lambda part, name=name: np.stack([[np.array([x[3], x[4]])[[("a", "b").index(c) for c in models[name]]] for x in part]], axis=0)[0].transpose(0, 2, 1)
        train, test = [x for x in rows if x[0] < day], [x for x in rows if x[0] == day]
        theta = fits.fit_softmax(pick(train), np.array([x[2] for x in train]), lam)
        p = fits.predict_softmax(theta, pick(test))
        y = np.array([x[2] for x in test])
        assert r["events"] == len(test) and r["log_loss"] == pytest.approx(-np.log(p[np.arange(len(y)), y]).mean(), abs=1e-6)
        assert r["top1"] == pytest.approx((p.argmax(axis=1) == y).mean())
    best = {r["model"]: r["lam"] for r in fits.choose_lambda(fits.rolling_origin(table, models, lams, 18, 4)).collect()}
    assert set(best) == set(models) and set(best.values()) <= set(lams)
    assert fits.rolling_origin(table, models, lams, 20, 4).count() == 0


def test_frozen_evaluation(spark):
    rows, table = fold_rows(spark)
    first = DAY + dt.timedelta(days=15)
    found = fits.frozen_evaluation(table, {"M2": ("a", "b")}, {"M2": 0.01}, first, 4)
    theta = fits.fit_softmax(np.array([np.array(x[3:]).T for x in rows if x[0] < first]), np.array([x[2] for x in rows if x[0] < first]), 0.01)
    test = [x for x in rows if x[0] >= first]
    p = fits.predict_softmax(theta, np.array([np.array(x[3:]).T for x in test]))
    assert found.count() == 5 and found.agg(F.avg("log_loss")).first()[0] == pytest.approx(-np.log(p[np.arange(len(test)), [x[2] for x in test]]).mean(), abs=1e-6)
    with pytest.raises(ValueError):
        fits.frozen_evaluation(table, {"M2": ("a",)}, {"M2": 0.01}, DAY, 4)


def test_block_bootstrap_interval(spark):
    values = np.random.default_rng(6).normal(size=23)
    days = spark.createDataFrame([(i, float(v), 2.0) for i, v in enumerate(values)], "d int, num double, den double")
    rng, ratios = np.random.default_rng(9), []
    for _ in range(150):
        places = np.concatenate([np.arange(s, s + 5) for s in rng.choice(np.arange(19), size=5)])[:23]
        ratios.append(values[places].sum() / 46)
    got = bootstrap.ratio_interval(days, "d", "num", "den", 5, 150, 9).first()
    assert (got["low"], got["high"], got["reps"]) == (pytest.approx(np.quantile(ratios, 0.025)), pytest.approx(np.quantile(ratios, 0.975)), 150)
    assert got["estimate"] == pytest.approx(values.sum() / 46)
