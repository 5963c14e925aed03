"""Censuses of captures: statuses, duplicates, sessions, slots, quote records, contract pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Numeric field codes of a captured quote and what they hold.
QUOTE_FIELDS = {"31": "last", "84": "bid", "85": "ask_size", "86": "ask", "87": "volume", "88": "bid_size", "6004": "exchange", "6008": "conid_field", "6070": "sec_type", "6509": "market_data_availability", "7059": "last_size"}


def status_differences(rows: DataFrame, keys: list[str], status: str, difference: str, passed: str = "PASS") -> DataFrame:
    """(keys, requested, passed, all_pass, and of the passed rows: with_difference, least, greatest, negative, positive, zero)."""
    d = F.when(F.col(status) == passed, F.col(difference))
    n = F.count_if(F.col(status) == passed)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("requested"), n.alias("passed"), (n == F.count("*")).alias("all_pass"), F.count(d).alias("with_difference"), F.min(d).alias("least"), F.max(d).alias("greatest"),
        F.count_if(d < 0).alias("negative"), F.count_if(d > 0).alias("positive"), F.count_if(d == 0).alias("zero"),
    )


def duplicate_summary(rows: DataFrame, keys: list[str], label: str, filled: Column) -> DataFrame:
    """(keys, rows, duplicate_labels, all_filled): labels that occur more than once, a null label being a label of its own."""
    labels = rows.groupBy(*keys, label).agg(F.count("*").alias("_n"), F.bool_and(F.coalesce(filled, F.lit(False))).alias("_f"))
    return labels.groupBy(*keys).agg(F.sum("_n").alias("rows"), F.count_if(F.col("_n") > 1).alias("duplicate_labels"), F.bool_and("_f").alias("all_filled"))


def session_statistics(cycles: DataFrame, keys: list[str], counters: list[str], elapsed: str) -> DataFrame:
    """(keys, cycles, the counters' sums, greatest elapsed time)."""
    return cycles.groupBy(*keys).agg(F.count("*").alias("cycles"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters], F.max(elapsed).alias(f"max_{elapsed}"))


def slot_states(slots: DataFrame, records: DataFrame, keys: list[str], due: str, started: str, late_seconds: float = 5) -> DataFrame:
    """Every planned slot with its first start, the delay against its due time and a status.

    MISSED_LATE_START if it began more than ``late_seconds`` late, ABSENT if no
    record has the slot's keys, else STARTED.
    """
    first = records.groupBy(*keys).agg(F.min(started).alias(started))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    delay = (micros(started) - micros(due)) / 1e6
    joined = slots.join(first, keys, "left").withColumn("delay_seconds", delay)
    return joined.withColumn("status", F.when(F.col(started).isNull(), "ABSENT").when(F.col("delay_seconds") > late_seconds, "MISSED_LATE_START").otherwise("STARTED"))


def missing_keys(cycles: DataFrame, expected: DataFrame, seen: DataFrame, session: list[str], cycle: list[str], key: list[str]) -> DataFrame:
    """(session, cycle, key): expected keys of a session that one of its cycles has no record of; cycles without any record too.

    cycles has session and cycle, expected session and key, seen all three.
    """
    wanted = cycles.select(*session, *cycle).distinct().join(expected.select(*session, *key).distinct(), session)
    return wanted.join(seen.select(*session, *cycle, *key), [*session, *cycle, *key], "left_anti").select(*session, *cycle, *key)


def quote_records(items: DataFrame, kept: list[str], sent_ns: str, received_ns: str) -> DataFrame:
    """Columns named by field code under their names, absent ones null, with the request's milliseconds."""
    fields = [(F.col(f"`{code}`") if code in items.columns else F.lit(None).cast("string")).alias(name) for code, name in QUOTE_FIELDS.items()]
    return items.select(*kept, *fields, ((F.col(received_ns) - F.col(sent_ns)) / 1e6).alias("request_elapsed_ms"))


def bar_summary(bars: DataFrame, keys: list[str], place: str, time: str) -> DataFrame:
    """(keys, bar_count, first_time, last_time) in order of place; bars without a time count but are neither."""
    at = F.when(F.col(time).isNotNull(), F.col(place))
    return bars.groupBy(*keys).agg(F.count("*").alias("bar_count"), F.min_by(time, at).alias("first_time"), F.max_by(time, at).alias("last_time"))


def first_pairs(contracts: DataFrame, keys: list[str], expiration: str, strike: str, side: str, conid: str, most: int) -> DataFrame:
    """(keys, expiration, strike, yes_conid, no_conid): the first ``most`` pairs of each key, in order of their texts."""
    pairs = contracts.groupBy(*keys, expiration, strike).agg(F.max(F.when(F.col(side) == "Y", F.col(conid))).alias("yes_conid"), F.max(F.when(F.col(side) == "N", F.col(conid))).alias("no_conid"))
    order = W.partitionBy(*keys).orderBy(F.col(expiration).cast("string"), F.col(strike).cast("string"))
    return pairs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
