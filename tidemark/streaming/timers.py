"""Streams whose results come from time passing: slots that begin late or never, sub-schedules, keys that a cycle lacks.

Event time moves with the watermark; timers fire when it has passed them, so what
did not come is reported too. State lives in the store that has timers
(``use_timers``) and goes when a session is over.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_timers(spark: SparkSession) -> SparkSession:
    """Queries that start in this session from now on keep their state in the store that has timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return spark


def _ms(micros: int) -> int:
    """The first whole millisecond at or after."""
    return -(-micros // 1000)


class _Slots(StatefulProcessor):
    """A session's slots in turn; a timer stands at the moment when the next one is decided."""

    def __init__(self, cadence: int, late: int, horizon: int):
        self.cadence, self.late, self.horizon = cadence, late, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.plan = handle.getValueState("plan", "start long, slots long, next long")
        self.firsts = handle.getMapState("firsts", "slot long", "at long")

    def _decided(self, start: int, slot: int) -> int:
        return _ms(start + slot * self.cadence + self.horizon)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            plan = self.plan.get() if self.plan.exists() else None
            if row.slots is not None:
                if plan is None and row.slots > 0:
                    self.plan.update((row.at, row.slots, 0))
                    self.handle.registerTimer(self._decided(row.at, 0))
            elif row.slot is not None and row.slot >= (plan[2] if plan else 0):
                before = self.firsts.getValue((row.slot,)) if self.firsts.containsKey((row.slot,)) else None
                if before is None or row.at < before[0]:
                    self.firsts.updateValue((row.slot,), (row.at,))
                if plan is None:
                    self.handle.registerTimer(_ms(row.at + self.horizon))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # All that the watermark decides: a timer that is set for a moment before it fires one trigger later.
        now, out = timerValues.getCurrentWatermarkInMs(), []
        if not self.plan.exists():
            self.firsts.clear()  # records of a session that no plan knows
            return iter(out)
        start, slots, following = self.plan.get()
        while following < slots and self._decided(start, following) <= now:
            due = start + following * self.cadence
            at = self.firsts.getValue((following,))[0] if self.firsts.containsKey((following,)) else None
            at = at if at is not None and at <= due + self.horizon else None
            status = "ABSENT" if at is None else "MISSED_LATE_START" if at - due > self.late else "STARTED"
            out.append(Row(session_id=key[0], slot=following, due=due, started=at, status=status))
            self.firsts.removeKey((following,))
            following += 1
        if following < slots:
            self.plan.update((start, slots, following))
            self.handle.registerTimer(self._decided(start, following))
        else:
            self.plan.clear()
            self.firsts.clear()
        return iter(out)

    def close(self) -> None:
        pass


def slot_states(plans: DataFrame, records: DataFrame, cadence_seconds: float = 30, late_seconds: float = 5, horizon_seconds: float | None = None, delay: str = "10 seconds") -> DataFrame:
    """(session_id, slot, due, started_at, delay_seconds, status) of every planned slot, as ``census.slot_states`` has them.

    plans: a stream (session_id, first_due, slots); records: a stream
    (session_id, slot, started_at). A slot is decided ``horizon_seconds`` after it
    was due (a cadence, unless said otherwise), once the watermark of ``delay``
    has passed that: STARTED, MISSED_LATE_START or ABSENT. Later records are
    dropped. A session's state goes with its last slot.
    """
    micros = lambda seconds: round(seconds * 1_000_000)
    opened = plans.select("session_id", F.col("first_due").alias("time"), F.lit(None).cast("long").alias("slot"), F.col("slots").cast("long").alias("slots"))
    began = records.select("session_id", F.col("started_at").alias("time"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("long").alias("slots"))
    both = opened.unionByName(began).withWatermark("time", delay).withColumn("at", F.unix_micros("time"))
    processor = _Slots(micros(cadence_seconds), micros(late_seconds), micros(cadence_seconds if horizon_seconds is None else horizon_seconds))
    out = both.groupBy("session_id").transformWithState(processor, "session_id string, slot long, due long, started long, status string", "Append", "EventTime")
    return out.select("session_id", "slot", F.timestamp_micros("due").alias("due"), F.timestamp_micros("started").alias("started_at"), ((F.col("started") - F.col("due")) / 1e6).alias("delay_seconds"), "status")


class _SubSchedules(StatefulProcessor):
    """Passes of a session in the order of their times, and for each schedule the tick that is due."""

    def __init__(self, schedules: dict[str, tuple[int, int]], idle: int):
        self.schedules, self.idle = schedules, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "n long")
        self.due = handle.getMapState("due", "name string", "at long")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            if row.at is not None and not self.waiting.containsKey((row.at,)):
                self.waiting.updateValue((row.at,), (1,))
                self.handle.registerTimer(_ms(row.at))
        return iter([])

    def _skipped(self, key, name: str, due: int, until: int, out: list) -> int:
        """Report the ticks that no pass reached within a cadence, and return the next."""
        cadence = self.schedules[name][0]
        while due + cadence <= until:
            out.append(Row(session_id=key[0], schedule=name, due=due, ran=None, status="SKIPPED"))
            due += cadence
        return due

    def _tick(self, key, until: int, out: list) -> None:
        """Skip what is skipped until then, and set the timers of what comes next."""
        for name, (cadence, _) in self.schedules.items():
            before = self.due.getValue((name,))[0]
            due = self._skipped(key, name, before, until, out)
            if due != before:
                self.due.updateValue((name,), (due,))
                self.handle.registerTimer(_ms(due + cadence))

    def _over(self, key, end: int, out: list) -> None:
        self._tick(key, end, out)
        self.due.clear()
        self.last.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, out = timerValues.getCurrentWatermarkInMs() * 1000, []
        for at in sorted(k[0] for k in self.waiting.keys() if k[0] <= now):
            self.waiting.removeKey((at,))
            if self.last.exists() and at > self.last.get()[0] + self.idle:
                self._over(key, self.last.get()[0] + self.idle, out)
            for name, (cadence, least) in self.schedules.items():
                due = self.due.getValue((name,))[0] if self.due.containsKey((name,)) else at
                due = self._skipped(key, name, due, at, out)
                if at >= due:
                    out.append(Row(session_id=key[0], schedule=name, due=due, ran=at, status="RUN"))
                    due = at + max(least, cadence)
                self.due.updateValue((name,), (due,))
                self.handle.registerTimer(_ms(due + cadence))
            self.last.update((at,))
            self.handle.registerTimer(_ms(at + self.idle))
        if self.last.exists():
            end = self.last.get()[0] + self.idle
            if end <= now:
                self._over(key, end, out)
            else:
                self._tick(key, now, out)
        return iter(out)

    def close(self) -> None:
        pass


def sub_schedules(passes: DataFrame, schedules: dict[str, tuple[float, float]], idle_seconds: float = 900, delay: str = "10 seconds") -> DataFrame:
    """(session_id, schedule, due, ran_at, status): what a session's passes do for schedules of their own cadence.

    passes: a stream (session_id, at) of the moments at which the session comes
    by. schedules: the cadence of each, and the least it may be, in seconds. A
    schedule is due at the first pass; the first pass at or after a due tick runs
    it, and the next is due the cadence (or the least) after that. A tick that no
    pass reaches within a cadence is SKIPPED, also if none comes any more; its
    timer says so. A session is over after idle_seconds without a pass, and its
    state goes. Passes are taken in the order of their times, whatever that of
    their arrival within the watermark.
    """
    micros = {n: (round(c * 1_000_000), round(least * 1_000_000)) for n, (c, least) in schedules.items()}
    timed = passes.select("session_id", F.col("at").alias("time")).withWatermark("time", delay).withColumn("at", F.unix_micros("time"))
    out = timed.groupBy("session_id").transformWithState(_SubSchedules(micros, round(idle_seconds * 1_000_000)), "session_id string, schedule string, due long, ran long, status string", "Append", "EventTime")
    return out.select("session_id", "schedule", F.timestamp_micros("due").alias("due"), F.timestamp_micros("ran").alias("ran_at"), "status")


def missing_keys(cycles: DataFrame, expected: DataFrame, seen: DataFrame, horizon: str = "30 seconds", delay: str = "10 seconds") -> DataFrame:
    """(session_id, cycle, started_at, key): expected keys that did not come within ``horizon`` of their cycle's start; cycles without any record too.

    cycles: a stream (session_id, cycle, started_at); expected: a table
    (session_id, key); seen: a stream (session_id, cycle, key, received_at). An
    outer join of the two streams: a row comes out once the watermark has passed
    its horizon, and state goes with it. Equals ``census.missing_keys``.
    """
    wanted = cycles.withWatermark("started_at", delay).join(expected, "session_id").select("session_id", "cycle", "started_at", "key")
    got = seen.withWatermark("received_at", delay).select(F.col("session_id").alias("_s"), F.col("cycle").alias("_c"), F.col("key").alias("_k"), "received_at")
    same = (F.col("session_id") == F.col("_s")) & (F.col("cycle") == F.col("_c")) & (F.col("key") == F.col("_k"))
    near = F.expr(f"received_at >= started_at and received_at <= started_at + interval {horizon}")
    return wanted.join(got, same & near, "left_outer").where("_k is null").select("session_id", "cycle", "started_at", "key")
