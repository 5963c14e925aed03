"""Streams with timers against plain loops and their batch forms."""

import datetime as dt
import json
import os
import random

import pytest

from tidemark.operators import census
from tidemark.streaming import jobs, timers

START = dt.datetime(2026, 6, 1, 10)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def stream_of(spark, path, schema, parts):
    """The parts as files that arrive one a trigger."""
    path.mkdir()
    for k, rows in enumerate(parts):
        (path / f"{k}.json").write_text("\n".join(json.dumps({n: f"{v:%Y-%m-%dT%H:%M:%S.%f}Z" if isinstance(v, dt.datetime) else v for n, v in r.items()}) for r in rows))
        os.utime(path / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    return jobs.capture(spark, str(path), schema, files_per_trigger=1)


@pytest.fixture
def drained(spark, tmp_path):
    timers.use_timers(spark)

    def run(stream, name):
        query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        return spark.table(name), query

    yield run
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def state_rows(query):
    return sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"])


def test_slot_states_equal_the_batch(spark, tmp_path, drained):
    rng = random.Random(1)
    plans = [{"session_id": s, "first_due": at(k * 100), "slots": 12} for k, s in enumerate("abc")]
    records = []
    for k, s in enumerate("abc"):
        for slot in range(12):
            if rng.random() < 0.8:
                records += [{"session_id": s, "slot": slot, "started_at": at(k * 100 + slot * 30 + d)} for d in rng.choice([[0.5], [4.9], [7.25], [1, 20], [12, 3]])]
    rng.shuffle(records)
    records.sort(key=lambda r: r["started_at"].timestamp() + rng.uniform(0, 8))  # out of order, within the watermark
    end = [{"session_id": "end", "slot": 0, "started_at": at(5000)}]
    flows = stream_of(spark, tmp_path / "p", "session_id string, first_due timestamp, slots int", [plans, [], []]), stream_of(spark, tmp_path / "r", "session_id string, slot long, started_at timestamp", [records[:15], records[15:40], [*records[40:], *end]])
    table, query = drained(timers.slot_states(*flows, horizon_seconds=25), "slots")
    found = sorted((r["session_id"], r["slot"], r["due"], r["started_at"], r["delay_seconds"], r["status"]) for r in table.collect())

    slots = spark.createDataFrame([(p["session_id"], i, p["first_due"] + dt.timedelta(seconds=30 * i)) for p in plans for i in range(12)], "session_id string, slot long, due timestamp")
    began = spark.createDataFrame([(r["session_id"], r["slot"], r["started_at"]) for r in records], "session_id string, slot long, started_at timestamp")
    want = census.slot_states(slots, began, ["session_id", "slot"], "due", "started_at", 5).collect()
    assert found == sorted((r["session_id"], r["slot"], r["due"], r["started_at"], r["delay_seconds"], r["status"]) for r in want)
    assert {r[5] for r in found} == {"STARTED", "MISSED_LATE_START", "ABSENT"}
    assert state_rows(query) <= 2  # what is left is the last record, of a session without a plan


def plain(passes, schedules, idle):
    out, due = [], {n: passes[0] for n in schedules}

    def skip(n, until):
        while due[n] + schedules[n][0] <= until:
            out.append((n, due[n], None, "SKIPPED"))
            due[n] += schedules[n][0]

    for t in passes:
        for n, (cadence, least) in schedules.items():
            skip(n, t)
            if t >= due[n]:
                out.append((n, due[n], t, "RUN"))
                due[n] = t + max(cadence, least)
    for n in schedules:
        skip(n, passes[-1] + idle)
    return sorted(out, key=str)


def test_sub_schedules_equal_a_loop(spark, tmp_path, drained):
    rng = random.Random(2)
    schedules = {"observations": (60.0, 5.0), "forecasts": (300.0, 30.0), "tickle": (20.0, 30.0)}
    sessions = {}
    for s, gap in (("a", 31), ("b", 47)):
        t, passes = 0.0, []
        for _ in range(40):
            passes.append(t)
            t += gap + rng.choice([0, 0.25, 2, 130])
        sessions[s] = passes
    rows = [{"session_id": s, "at": at(t)} for s, passes in sessions.items() for t in passes]
    rows.sort(key=lambda r: r["at"].timestamp() + rng.uniform(0, 8))
    parts = [rows[:20], rows[20:50], rows[50:], [{"session_id": "end", "at": at(50_000)}]]
    table, query = drained(timers.sub_schedules(stream_of(spark, tmp_path / "in", "session_id string, at timestamp", parts), schedules, 400), "ticks")
    seconds = lambda t: t and (t - START).total_seconds()
    for s, passes in sessions.items():
        found = [(r["schedule"], seconds(r["due"]), seconds(r["ran_at"]), r["status"]) for r in table.collect() if r["session_id"] == s]
        assert sorted(found, key=str) == plain(passes, schedules, 400)
    assert state_rows(query) <= 4  # only the last session, which has not begun


def test_missing_keys_equal_the_batch(spark, tmp_path, drained):
    rng = random.Random(3)
    cycles = [{"session_id": s, "cycle": c, "started_at": at(30 * c)} for s in "ab" for c in range(8)]
    seen = [{"session_id": r["session_id"], "cycle": r["cycle"], "key": k, "received_at": r["started_at"] + dt.timedelta(seconds=rng.uniform(0, 9))} for r in cycles for k in "xyz" if rng.random() < 0.6 and r["cycle"] != 5]
    expected = spark.createDataFrame([(s, k) for s in "ab" for k in "xyz"], "session_id string, key string")
    late = {"session_id": "end", "cycle": 99, "started_at": at(9000)}, {"session_id": "end", "cycle": 99, "key": "x", "received_at": at(9000)}
    flows = stream_of(spark, tmp_path / "c", "session_id string, cycle long, started_at timestamp", [cycles, [], [late[0]]]), stream_of(spark, tmp_path / "s", "session_id string, cycle long, key string, received_at timestamp", [seen[:9], seen[9:], [late[1]]])
    table, _ = drained(timers.missing_keys(flows[0], expected, flows[1]), "missing")
    found = sorted((r["session_id"], r["cycle"], r["key"]) for r in table.collect())
    batch = census.missing_keys(spark.createDataFrame([(r["session_id"], r["cycle"]) for r in cycles], "session_id string, cycle long"), expected, spark.createDataFrame([(r["session_id"], r["cycle"], r["key"]) for r in seen], "session_id string, cycle long, key string"), ["session_id"], ["cycle"], ["key"])
    assert found == sorted(tuple(r) for r in batch.collect()) and sum(c == 5 for _, c, _ in found) == 6
