"""Schedules, questions, pair snapshots, frozen files, station reports and market scores, each fault planted once."""

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.expect import ExpectationError
from tidemark.functions import clocks
from tidemark.plans import market_scores, study
from tidemark.sources import captures

ENTRIES = "array<struct<day_of_week string, trading_times array<struct<open string, close string>>>>"


def test_schedule_status(spark):
    week = [("Monday", [("8:30 AM", "4:15 PM"), ("4:16 PM", "11:00 PM")]), ("Tuesday", [("10:00 PM", "2:00 AM")]), ("Wednesday", [("8:30 AM", None)]), ("Thursday", [("25:00", "4:00 PM")]), ("Friday", []), ("Saturday", [("1:00 AM", "2:00 AM")]), ("Saturday", [("3:00 AM", "4:00 AM")])]
    at = lambda day, h, m=0: dt.datetime(2026, 6, day, h, m)  # noqa: E731  1 June 2026 is a Monday; Chicago is five hours behind
    cases = [
        (at(1, 13, 30), None), (at(1, 13, 29), "market schedule closed"), (at(1, 21, 15), "market schedule closed"), (at(1, 21, 16), None), (at(2, 3, 59), None), (at(2, 4, 0), "market schedule closed"),
        (at(3, 3, 0), None), (at(3, 6, 30), "malformed trading interval"), (at(2, 6, 30), "market schedule closed"), (at(4, 15), "unparseable trading interval"), (at(5, 15), "no trading intervals"), (at(6, 15), "schedule missing/ambiguous weekday row"), (at(7, 15), "schedule missing/ambiguous weekday row"),
    ]
    rows = spark.createDataFrame([(i, "America/Chicago", week, t) for i, (t, _) in enumerate(cases)] + [(90, None, week, at(1, 15)), (91, "America/Chicago", None, at(1, 15))], f"i int, z string, e {ENTRIES}, t timestamp")
    got = {r["i"]: r["s"] for r in rows.select("i", clocks.schedule_status(F.col("z"), F.col("e"), F.col("t")).alias("s")).collect()}
    assert [got[i]["problem"] for i in range(len(cases))] == [w for _, w in cases]
    assert got[90]["problem"] == got[91]["problem"] == "schedule missing timezone/trading_schedules" and got[0]["open"] and not got[1]["open"]


def test_event_question(spark):
    good = "Will the highest temperature at KMDW on June 5, 2026 exceed 71.5 °F?"
    cases = [(good, None), ("", "missing contract question"), (None, "missing contract question"), (good.replace("exceed", "pass"), "unexpected question predicate"), (good.replace("KMDW", "KJFK"), "question does not identify expected station"), (good.replace("June 5, 2026", "some day"), "question date/threshold could not be parsed")]
    got = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(cases)], "i int, q string").select("i", study.event_question(F.col("q"), F.lit("kmdw")).alias("x")).orderBy("i").collect()
    assert [r["x"]["problem"] for r in got] == [w for _, w in cases]
    assert got[0]["x"]["date"] == dt.date(2026, 6, 5) and float(got[0]["x"]["threshold"]) == 71.5 and got[3]["x"]["date"] is None


def test_pair_snapshot(spark):
    now = 1_780_000_000.0
    leg = lambda conid, **c: tuple(({"conid": conid, "availability": "RPB", "updated": int(now * 1000) - 2000, "ask": "0.40", "ask_size": "1,200"} | c).values())
    cases = [
        ([leg(2, updated=int(now * 1000) - 90_000), leg(1)], 0.4, None, None), ([leg(1), leg(2)], 5.1, "structural_failure", "request elapsed outside frozen bound"), ([leg(1), leg(2)], None, "structural_failure", "request elapsed outside frozen bound"),
        ([leg(1)], 0.4, "structural_failure", "pair response must contain exactly two rows"), (None, 0.4, "structural_failure", "pair response must contain exactly two rows"), ([leg(1), leg(None)], 0.4, "structural_failure", "invalid quote row/conid"), ([leg(1), leg(1)], 0.4, "structural_failure", "duplicate conid in pair response"), ([leg(1), leg(9)], 0.4, "structural_failure", "unexpected conid in pair response"),
        ([leg(1, ask=None), leg(2, availability="DPB")], 0.4, "structural_failure", "non-real-time delivery"), ([leg(1), leg(2, updated=None)], 0.4, "structural_failure", "missing/invalid broker _updated"), ([leg(1, updated=5), leg(2)], 0.4, "structural_failure", "broker _updated epoch is invalid"), ([leg(1), leg(2, updated=int(now * 1000) + 1500)], 0.4, "structural_failure", "broker _updated timestamp is implausibly future"),
        ([leg(1, ask="-"), leg(2, ask_size="0.5")], 0.4, "quote_unavailable", "1:ask; 2:ask_size"),
    ]
    schema = "i int, p array<struct<conid long, availability string, updated long, ask string, ask_size string>>, e double"
    rows = spark.createDataFrame([(i, p, e) for i, (p, e, _, _) in enumerate(cases)], schema)
    got = [r["s"] for r in rows.select("i", study.pair_snapshot(F.col("p"), F.lit(1).cast("long"), F.lit(2).cast("long"), F.col("e"), F.lit(now)).alias("s")).orderBy("i").collect()]
    assert [(g["failure_class"], g["reason"]) for g in got] == [(c, w) for _, _, c, w in cases]
    first = got[0]
    assert [(r["conid"], r["ask"], r["ask_size"], r["age"], r["is_old"]) for r in first["rows"]] == [(1, 0.4, 1200, 2.0, False), (2, 0.4, 1200, 90.0, True)] and first["skew"] == 88.0 and first["skew_is_old"]
    assert got[1]["rows"] is None and got[-1]["skew"] is None


def test_frozen_files(spark, tmp_path):
    (tmp_path / "f" / "sub").mkdir(parents=True)
    for name, body in (("a.txt", b"one"), ("sub/b.txt", b"two!"), ("c.txt", b"3"), ("d.txt", b"four")):
        (tmp_path / "f" / name).write_bytes(body)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    names = [("a.txt", 3, digest(b"one"), "OK"), ("sub/b.txt", 4, digest(b"two!"), "OK"), ("c.txt", 2, digest(b"3"), "SIZE"), ("d.txt", 4, digest(b"fore"), "CHANGED"), ("gone.txt", 1, digest(b""), "MISSING"), ("../f/a.txt", 3, digest(b"one"), "UNSAFE"), ("/a.txt", 3, digest(b"one"), "UNSAFE"), ("sub//b.txt", 4, digest(b"two!"), "UNSAFE"), ("sub\\b.txt", 4, digest(b"two!"), "UNSAFE"), ("file:a.txt", 3, digest(b"one"), "UNSAFE")]
    manifest = spark.createDataFrame([n[:3] for n in names], "name string, length long, sha256 string")
    got = captures.check_frozen(captures.fingerprints(spark, str(tmp_path / "f")), manifest, str(tmp_path / "f")).collect()
    assert sorted(map(tuple, got)) == sorted((n[0], n[3]) for n in names)
    pdfs = spark.createDataFrame([("a", bytearray(b"%PDF-1.7")), ("b", bytearray(b"<html>")), ("c", bytearray(b"%PDF-2"))], "path string, content binary")
    assert [r["status"] for r in captures.check_pdf(pdfs, F.lit(digest(b"%PDF-1.7"))).orderBy("path").collect()] == ["OK", "NOT_PDF", "CHANGED"]


def test_station_reports(spark):
    at = dt.datetime(2026, 6, 1, 15)
    good = "station,valid,tmpf,metar\nMDW,2026-06-01 10:00,70.0,KMDW 011500Z\nMDW,2026-06-01 11:00,M,SPECI KMDW 011600Z\nMDW,2026-06-01 12:00,68,\n"
    read = lambda text: captures.station_csv(spark.createDataFrame([(at, text)], "received_at timestamp, body string"), "body", "MDW", "2026-06-01").orderBy("valid").collect()
    assert [(r["tmpf"], r["running_max"]) for r in read(good)] == [(70.0, 70.0), (None, 70.0), (68.0, 70.0)]
    for bad in (good.replace("KMDW 011500Z", "KORD 011500Z"), good.replace("tmpf", "temp"), good.replace("MDW,2026-06-01 12", "ORD,2026-06-01 12"), good.replace("2026-06-01 12", "2026-06-02 12")):
        with pytest.raises(Exception):
            read(bad)


def test_market_scores(spark):
    rng = np.random.default_rng(3)
    rows = []
    for d in range(15):
        for city in "ab":
            p = rng.dirichlet(np.ones(6))
            if d == 3:
                p[0], p[1] = 0.0, p[0] + p[1]
            rows.append((dt.date(2026, 6, 1) + dt.timedelta(days=d), city, [float(x) for x in p], 1 if d == 3 else int(rng.integers(1, 7)), float(d % 4 == 0)))
    events = spark.createDataFrame(rows, "day date, city string, p array<double>, y int, snapshot_age_minutes double")
    scored = market_scores.event_scores(events, "p", "y")
    want = []
    for day, _, p, y, _ in rows:
        q = np.clip(p, 1e-6, 1 - 1e-6)
        q = q / q.sum()
        want.append((day, p[y - 1], -np.log(q[y - 1]), ((q - np.eye(6)[y - 1]) ** 2).sum(), int(np.argmax(p) == y - 1), -(q * np.log(q)).sum(), p[y - 1] == 0))
    for r, w in zip(scored.orderBy("day", "city").collect(), want, strict=True):
        assert (r["winner_prob"], r["top1"], r["zero_winner"]) == (w[1], w[4], w[6]) and np.allclose([r["log_loss"], r["brier"], r["entropy"]], [w[2], w[3], w[5]])
    total = market_scores.summary(scored).first()
    assert (total["events"], total["zero_winners"]) == (30, 2) and total["median_winner_prob"] == pytest.approx(np.median([w[1] for w in want])) and market_scores.stale(scored).count() == 8
    daily = np.array([[np.mean([w[k] for w in want if w[0] == day]) for k in (2, 3)] for day in sorted({w[0] for w in want})])
    draw, expected = np.random.default_rng(7), {}
    for block in (1, 3, 7):
        for k, name in enumerate(("log_loss", "brier")):
            means = []
            for _ in range(90):
                starts = draw.choice(np.arange(15 - block + 1), size=-(-15 // block))
                means.append(daily[np.concatenate([np.arange(s, s + block) for s in starts])[:15], k].mean())
            expected[block, name] = (daily[:, k].mean(), *np.quantile(means, [0.025, 0.975]))
    got = {(r["block"], r["metric"]): (r["estimate"], r["low"], r["high"]) for r in market_scores.intervals(scored, "day", 90, 7).collect()}
    assert set(got) == set(expected) and all(np.allclose(got[k], expected[k]) for k in got)
    for bad in (events.withColumn("y", F.lit(7)), events.withColumn("p", F.transform("p", lambda x: x * 2))):
        with pytest.raises(ExpectationError):
            market_scores.event_scores(bad, "p", "y")
