"""Structured Streaming jobs: deduplication, changes, gaps, slots, two-poll confirmation, late corrections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def capture(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Append-only JSON lines as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def deduplicated(stream: DataFrame, keys: list[str], time: str, horizon: str = "1 day") -> DataFrame:
    """The first record of each key within the horizon; the state survives restarts and is dropped after it."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys)


def slot_counts(stream: DataFrame, time: str, keys: list[str], slot: str = "30 seconds", late: str = "5 seconds") -> DataFrame:
    """(slot, keys, records) of nominal slots that have records; those behind the watermark of ``late`` are not counted."""
    slots = stream.withWatermark(time, late).groupBy(F.window(time, slot), *keys)
    return slots.agg(F.count("*").alias("records")).select(F.col("window.start").alias("slot"), *keys, "records")


def _in_order(batches: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    """A key's rows of one trigger as tuples in the order of the columns, times as seconds."""
    rows = []
    for batch in batches:
        parts = [batch[c].map(lambda t: t.timestamp()) if str(batch[c].dtype).startswith("datetime") else batch[c] for c in columns]
        rows += zip(*(p.tolist() for p in parts), strict=True)
    return sorted(rows)


def _stateful(rows: DataFrame, keys: list[str], step: Callable, output: str, state: str, idle_hours: float) -> DataFrame:
    """step(key, batches, state) for each key with new rows; the state of a key without any for ``idle_hours`` goes."""

    def run(key, batches, now):
        if now.hasTimedOut:
            now.remove()
            return
        yield step(key, batches, now)
        if now.exists:
            now.setTimeoutDuration(round(idle_hours * 3_600_000))

    return rows.groupBy(*keys).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def _confirm(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, low: float, high: float) -> pd.DataFrame:
    slot, at = state.get if state.exists else (None, None)
    out = []
    for number, now, valid in _in_order(batches, ["slot", "received_at", "valid"]):
        if not valid:
            status, slot, at = "INVALID_RESET", None, None
        elif slot is None:
            status, slot, at = "PENDING_FIRST", int(number), now
        elif number == slot + 1 and low <= now - at <= high:
            status, slot, at = "CONFIRMED_TWO_POLL", int(number), now
        else:
            status, slot, at = "RESET_NEW_FIRST", int(number), now
        out.append((*key, int(number), status))
    if slot is not None:
        state.update((slot, at))
    elif state.exists:
        state.remove()
    return pd.DataFrame(out, columns=["pair_id", "slot", "status"])


def two_poll_confirmation(stream: DataFrame, low: float = 25, high: float = 35, idle_hours: float = 48) -> DataFrame:
    """(pair_id, slot, status) for observations(pair_id, slot, received_at, valid).

    A pair is confirmed when two consecutive slots are valid and their receipts
    lie 25 to 35 seconds apart. An invalid one forgets the first; a gap starts
    anew. The state of a pair is one slot and one time.
    """
    rows = stream.select("pair_id", "slot", "received_at", "valid")
    return _stateful(rows, ["pair_id"], lambda k, b, s: _confirm(k, b, s, low, high), "pair_id string, slot long, status string", "slot long, at double", idle_hours)


def _changed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> pd.DataFrame:
    last = state.get[0] if state.exists else None
    out = []
    for now, _, digest in _in_order(batches, ["received_at", "tie", "digest"]):
        if digest != last:
            out.append((*key, pd.Timestamp(now, unit="s"), digest))
            last = digest
    if last is not None:
        state.update((last,))
    return pd.DataFrame(out, columns=["source", "received_at", "digest"])


def changed(stream: DataFrame, tie: str | None = None, idle_hours: float = 48) -> DataFrame:
    """Records(source, received_at, digest) whose digest differs from the source's last one; records of one time in the order of ``tie``, or of the digest."""
    rows = stream.select("source", "received_at", F.col(tie or "digest").alias("tie"), "digest")
    return _stateful(rows, ["source"], _changed, "source string, received_at timestamp, digest string", "digest string", idle_hours)


def _gaps(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, limit: float) -> pd.DataFrame:
    last = state.get[0] if state.exists else None
    out = []
    for (now,) in _in_order(batches, ["started_at"]):
        if last is not None and now - last > limit:
            out.append((*key, pd.Timestamp(now, unit="s"), now - last))
        last = now if last is None else max(last, now)
    state.update((last,))
    return pd.DataFrame(out, columns=["session_id", "started_at", "gap_seconds"])


def cadence_gaps(stream: DataFrame, cadence_seconds: float, slack: float = 1.75, idle_hours: float = 48) -> DataFrame:
    """(session_id, started_at, gap_seconds): cycles that start more than ``slack`` cadences after the one before."""
    rows = stream.select("session_id", "started_at")
    return _stateful(rows, ["session_id"], lambda k, b, s: _gaps(k, b, s, cadence_seconds * slack), "session_id string, started_at timestamp, gap_seconds double", "at double", idle_hours)


def raw_first(stream: DataFrame, archive: str, parsed: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], trigger: dict | None = None):
    """Store every raw batch before it is parsed; rows that fail to parse stay in the archive.

    Each batch goes to a folder of its number, which a repeated batch overwrites.
    """

    def both(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{archive}/batch={number}")
        stored = batch.sparkSession.read.schema(batch.schema).json(f"{archive}/batch={number}")
        parse(stored).write.mode("overwrite").parquet(f"{parsed}/batch={number}")

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def pending(planned: DataFrame, status: DataFrame, key: str) -> DataFrame:
    """Planned keys that have not passed yet, for a resumed run."""
    return planned.join(status.where("status = 'PASS'").select(key), key, "left_anti")
