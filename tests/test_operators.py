"""Operators on hand-made tables."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import expect
from tidemark.operators import aggregates, asof, ladder, sets, windows


def at(minute, day=1):
    return dt.datetime(2026, 6, day) + dt.timedelta(minutes=minute)


ROWS = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 4000))), max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(left=ROWS, right=ROWS, forward=st.booleans(), strict=st.booleans())
def test_asof_matches_a_scan(spark, left, right, forward, strict):
    stamp = lambda m: None if m is None else at(m)
    a = spark.createDataFrame([(i, k, stamp(m)) for i, (k, m) in enumerate(left)], "id long, k string, t timestamp")
    b = spark.createDataFrame([(k, stamp(m), j) for j, (k, m) in enumerate(right)], "k string, u timestamp, v int")
    strict = strict and not forward
    found = {r["id"]: r["asof_v"] for r in asof.asof(a, b, ["k"], "t", "u", ["v"], "forward" if forward else "backward", strict, slice_seconds=3600).collect()}
    assert len(found) == len(left)
    for i, (k, m) in enumerate(left):
        near = [(n, j) for j, (q, n) in enumerate(right) if q == k and n is not None and m is not None and (n >= m if forward else n < m if strict else n <= m)]
        best = (min(near, key=lambda x: (x[0], -x[1])) if forward else max(near)) if near else (None, None)
        assert found[i] == (best[1] if k is not None else None)


def test_asof_null_keys_match_nothing(spark):
    a = spark.createDataFrame([(1, None, at(10)), (2, "x", at(10))], "id long, k string, t timestamp")
    b = spark.createDataFrame([(None, at(5), 7), ("x", at(5), 8)], "k string, u timestamp, v int")
    for direction, times in (("backward", ("t", "u")), ("forward", ("u", "t"))):
        left, right = (a, b) if direction == "backward" else (b.withColumnRenamed("v", "id"), a.withColumnRenamed("id", "v"))
        found = asof.asof(left, right, ["k"], *times, ["v"], direction).collect()
        assert {r["k"]: r["asof_v"] is None for r in found} == {None: True, "x": False}


def test_versions_see_only_what_was_received(spark):
    rows = spark.createDataFrame([("s", at(0), at(1), 60.0), ("s", at(0), at(9), 61.0), ("s", at(5), at(6), 61.0), ("s", at(5), at(6), 63.0)], "k string, issue timestamp, got timestamp, v double")
    when = spark.createDataFrame([("s", at(4)), ("s", at(8)), ("s", at(10))], "k string, q timestamp")
    found = {(r["q"], r["issue"]): (r["v"], r["conflict"]) for r in asof.latest_versions(rows, when, ["k"], "issue", "got", "v", "q").collect()}
    assert found == {(at(4), at(0)): (60.0, False), (at(8), at(0)): (60.0, False), (at(8), at(5)): (63.0, True), (at(10), at(0)): (61.0, False), (at(10), at(5)): (63.0, True)}


def test_staleness_edges(spark):
    row = spark.createDataFrame([(at(60), at(0), at(60))], "e timestamp, old timestamp, same timestamp")
    got = row.select(asof.stale_before(F.col("e"), F.col("old")), asof.stale_before(F.col("e"), F.col("same")), asof.stale_after(F.col("old"), F.col("e")), asof.stale_after(F.col("e"), F.col("same")), asof.stale_after(F.col("e"), F.lit(None))).first()
    assert tuple(got) == (True, False, True, True, False)


def test_latest_complete_ignores_later_and_partial_snapshots(spark):
    rows = [("x", at(t), m, 0.1) for t in (0, 10) for m in "ab"] + [("x", at(20), "a", 0.1)] + [("x", at(40), m, 0.1) for m in "ab"]
    panel = spark.createDataFrame(rows, "city string, t timestamp, m string, p double")
    chosen = asof.latest_complete(panel, spark.createDataFrame([("x", at(30))], "city string, d timestamp"), ["city"], "t", "d", "m", 2)
    assert {r["t"] for r in chosen.collect()} == {at(10)}


def test_runs_changes_and_gaps(spark):
    rows = spark.createDataFrame([("u", i, ok, at(m)) for i, (ok, m) in enumerate([(True, 0), (True, 1), (False, 2), (True, 3), (True, 5), (True, 9)])], "u string, i int, ok boolean, t timestamp")
    assert windows.longest_true_run(rows, ["u"], ["i"], "ok").first()["longest"] == 3
    assert windows.changes(rows, ["u"], ["i"], "ok").where("changed").count() == 3
    assert [r["gap_minutes"] for r in windows.late_polls(rows, ["u"], "t", "i", 60).orderBy("i").collect()] == [2.0, 4.0]


def test_contiguous_and_spaced(spark):
    rungs = spark.createDataFrame([("a", None, 70.0), ("a", 71.0, 72.0), ("a", 73.0, None), ("b", None, 70.0), ("b", 72.0, 73.0), ("b", 74.0, None)], "k string, lo double, hi double")
    assert {r["k"]: r["contiguous"] for r in windows.contiguous(rungs, ["k"], "lo", "hi", 3).collect()} == {"a": True, "b": False}
    line = spark.range(6).select(F.lit("k").alias("k"), "id")
    assert sorted(r["id"] for r in windows.evenly_spaced(line, ["k"], ["id"], 3).collect()) == [0, 2, 5]
    assert sorted(r["id"] for r in windows.rotation(line, ["id"], ["k"], 3, 1).collect()) == [1, 4]
    assert windows.batches(line, ["k"], ["id"], 4).groupBy("batch").count().count() == 2


def test_weighted_quantile_and_crps(spark):
    rows = spark.createDataFrame([("k", v, w) for v, w in ((1.0, 1.0), (2.0, 1.0), (3.0, 2.0))], "k string, v double, w double")
    assert aggregates.weighted_quantile(rows, ["k"], "v", "w", 0.5).first()["quantile"] == 2.0
    two = spark.createDataFrame([("k", 0.0, 1.0), ("k", 2.0, 1.0)], "k string, v double, y double")
    assert aggregates.crps(two, ["k"], "v", "y").first()["crps"] == 0.5
    scaled = two.select("k", (F.col("v") * 3).alias("v"), (F.col("y") * 3).alias("y"))
    assert aggregates.crps(scaled, ["k"], "v", "y").first()["crps"] == 1.5


def test_cumulative_over_slices(spark):
    """A hot key, a null key, ties and null values give the sums of a plain loop, whatever the slices."""
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else "cold", None if i % 13 == 0 else float(i * 37 % 101), float(i % 5 + 1)) for i in range(900)]
    table = spark.createDataFrame(rows, "k string, v double, w double").repartition(7)
    expected = {}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k and r[1] is not None]
        for v in {r[1] for r in mine}:
            expected[k, v] = (sum(r[2] for r in mine if r[1] == v), sum(r[2] for r in mine if r[1] <= v), sum(r[2] for r in mine))
    for slices in (1, 5, 64):
        got = aggregates.cumulative(table, ["k"], "v", F.col("w"), slices).collect()
        assert {(r["k"], r["v"]): (r["mass"], r["below"], r["total"]) for r in got} == expected and len(got) == len(expected)
    assert aggregates.cumulative(table.where("false"), ["k"], "v", F.col("w")).count() == 0
    assert aggregates.weighted_quantile(table.where("v is null"), ["k"], "v", "w", 0.5).count() == 0


def test_grid_over_days(spark):
    """A value carries over days without one; nulls do not count."""
    seen = [("k", at(5), 3.0), ("k", at(10), 1.0), ("k", at(0, 3), None), ("k", at(20, 4), 2.0), ("k", None, 99.0), (None, at(1), 7.0)]
    points = [("k", at(0)), ("k", at(10)), ("k", at(0, 3)), ("k", at(20, 4)), ("k", None), (None, at(0, 2)), ("other", at(0, 2))]
    got = windows.on_grid(spark.createDataFrame(points, "k string, t timestamp"), spark.createDataFrame(seen, "k string, t timestamp, v double"), ["k"], "t", "v")
    found = {(r["k"], r["t"]): (r["last_value"], r["running_max"]) for r in got.collect()}
    assert found == dict(zip(points, [(None, None), (1.0, 3.0), (1.0, 3.0), (2.0, 3.0), (None, None), (7.0, 7.0), (None, None)], strict=True))


def test_quantiles_interpolate(spark):
    rows = [(k, float(v * v % 97)) for k in ("a", "b", None) for v in range(40 if k else 3)] + [("a", None), ("c", None)]
    got = {r["k"]: r for r in aggregates.describe(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    for k in ("a", "b", None):
        mine = [v for key, v in rows if key == k and v is not None]
        assert (got[k]["n"], got[k]["min"], got[k]["max"]) == (len(mine), min(mine), max(mine))
        assert np.allclose([got[k]["p05"], got[k]["median"], got[k]["p95"]], np.quantile(mine, [0.05, 0.5, 0.95]))
    assert got["c"]["n"] == 0 and got["c"]["median"] is None


def test_weighted_ks_is_exact(spark):
    rows = [(0.1, 1.0), (0.1001, 2.0), (0.7, 1.0), (None, 9.0)]
    got = aggregates.pit_summary(spark.createDataFrame(rows, "p double, w double"), "p", "w").first()
    assert abs(got["ks"] - (0.75 - 0.1001)) < 1e-12
    assert abs(got["mean"] - 0.25005) < 1e-12


def test_balanced_weights_keep_null_keys(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert sorted((r["k"] or "", r["weight"]) for r in aggregates.balanced_weights(rows, "k").collect()) == [("", 1.0), ("a", 0.5), ("a", 0.5)]


def test_concentration_and_pit(spark):
    rows = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "k string, v double")
    got = aggregates.concentration(rows, "k", "v").first()
    assert (got["max_share"], got["top_share"], got["hhi"], got["effective"]) == (0.75, 1.0, 0.625, 1.6)
    pit = spark.createDataFrame([(1.0,), (0.0,), (0.05,), (0.95,)], "p double")
    assert {r["decile"]: r["mass"] for r in aggregates.pit_deciles(pit, "p").collect() if r["mass"]} == {0: 0.5, 9: 0.5}


def test_sets(spark):
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (2, None, 1)], "k int, v string, n int")
    assert sorted((r["k"], r["v"], r["n"]) for r in sets.keep_first(rows, ["k"], ["n"]).collect()) == [(1, "b", 2), (2, None, 1)]
    assert sorted((r["k"], r["n"]) for r in sets.override([rows.select("k", "n"), spark.createDataFrame([(2, 9)], "k int, n int")], ["k", "n"]).collect()) == [(1, 2), (1, 3), (2, 1), (2, 9)]
    fixed = sets.correct(rows, spark.createDataFrame([(2, "z"), (1, "p"), (1, "q")], "k int, v string"), ["k"], ["v"])
    assert sorted((r["k"], r["v"], r["corrected"]) for r in fixed.where("k = 2").collect()) == [(2, "z", True)]
    assert fixed.where("corrected").count() == 1


def test_ladder(spark):
    rows = spark.createDataFrame([("c", 70, "Y", 1), ("c", 70, "N", 2), ("c", 72, "Y", 3), ("c", 72, "N", 4), ("c", 75, "Y", 5)], "city string, t int, side string, conid int")
    pairs = ladder.complements(rows, ["city", "t"], "side", "conid")
    assert sorted((r["t"], r["y_conid"], r["n_conid"]) for r in pairs.collect()) == [(70, 1, 2), (72, 3, 4)]
    assert [(r["t"], r["next_t"]) for r in ladder.adjacent(pairs, ["city"], "t", ["y_conid"]).collect()] == [(70, 72)]


def test_expectations(spark):
    rows = spark.createDataFrame([(1, None), (1, 2)], "k int, v int")
    for broken in (lambda: expect.unique(rows, ["k"]), lambda: expect.not_null(rows, ["v"]), lambda: expect.count(rows, 3), lambda: expect.columns(rows, ["z"]), lambda: expect.holds(rows, F.col("v") > 0, "positive"), lambda: expect.same_keys(rows, rows.where("v = 2"), ["v"])):
        with pytest.raises(expect.ExpectationError):
            broken()
    assert expect.same_keys(rows, rows, ["v"]) is None


@pytest.mark.parametrize("size", [1 << 18, 7])
def test_ordered_operators_over_slices(spark, monkeypatch, size):
    """Pairs, gaps, changes and runs of a group that is cut along its order equal a plain loop; so do null keys, times and values."""
    from tidemark.operators import windows

    monkeypatch.setattr(windows, "SLICE_ROWS", size)
    rng = random.Random(size)
    start = dt.datetime(2026, 6, 1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), start + dt.timedelta(minutes=rng.randrange(400)) if rng.random() > 0.04 else None, i, rng.choice([1, 1, 2, None]), rng.choice([True, True, True, False, None])) for i in range(150)]
    table = spark.createDataFrame(rows, "k string, t timestamp, i int, v int, ok boolean").repartition(3)
    groups = {k: sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or start, r[2])) for k in ("a", "b", None)}
    pairs = {r["i"]: (r["old_i"], r["old_v"], r["sequence"]) for r in windows.consecutive_pairs(table, ["k"], ["t", "i"], ["i", "v"]).collect()}
    assert pairs == {b[2]: (a[2], a[3], n) for g in groups.values() for n, (a, b) in enumerate(zip(g, g[1:]), 1)}
    gaps = {r["i"]: r["gap_minutes"] for r in windows.gaps(table, ["k"], "t", "i").collect()}
    assert gaps == {b[2]: (b[1] - a[1]).total_seconds() / 60 if a and a[1] and b[1] else None for g in groups.values() for a, b in zip([None, *g], g)}
    changed = {r["i"]: r["changed"] for r in windows.changes(table, ["k"], ["t", "i"], "v").collect()}
    assert changed == {b[2]: a is None or a[3] != b[3] for g in groups.values() for a, b in zip([None, *g], g)}
    longest = {r["k"]: r["longest"] for r in windows.longest_true_run(table, ["k"], ["t", "i"], "ok").collect()}
    runs = lambda g: max((len(x) for x in "".join("1" if r[4] else "0" for r in g).split("0")), default=0)
    assert longest == {k: runs(g) for k, g in groups.items()}
    assert windows.changes(table.where("false"), ["k"], ["t", "i"], "v").count() == 0
