"""As-of joins: the last row before, the first after, complete groups, versions, exact times."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_LEFT, _TIME, _ROW = "_left", "_time", "_row"


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    values: list[str],
    direction: str = "backward",
    strict: bool = False,
    slice_seconds: int = 86_400,
) -> DataFrame:
    """``left`` with the ``values`` of the nearest right row of the same keys (null if none).

    direction backward: the last right row at or before (strict: before) the
    left time; forward: the first at or after it. Both tables are laid in one
    order and the last value is carried along: one sort, no pairs. Time is cut
    into slices, so that one key of many rows is many groups; the last right row
    of each slice is carried over the slices in a second, small window. Among
    right rows of one time the greatest struct of values wins. Left rows with a
    null key or time match nothing and stay.
    """
    forward = direction == "forward"
    sign = -1 if forward else 1
    micros = lambda c: sign * F.unix_micros(F.col(c).cast("timestamp"))
    kept = [F.col(c).alias(f"l_{c}") for c in left.columns]
    taken = F.struct(*[F.col(v) for v in values])
    a = left.select(*[F.col(k).alias(f"k_{i}") for i, k in enumerate(keys)], micros(left_time).alias(_TIME), F.struct(*kept).alias(_ROW), F.lit(1).alias(_LEFT))
    known = reduce(and_, [F.col(c).isNotNull() for c in (*keys, right_time)])
    b = right.where(known).select(*[F.col(k).alias(f"k_{i}") for i, k in enumerate(keys)], micros(right_time).alias(_TIME), taken.alias("_value"), F.lit(0).alias(_LEFT))
    key = [f"k_{i}" for i in range(len(keys))]
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_slice", F.floor(F.col(_TIME) / (slice_seconds * 1_000_000)))
    # A strict join lets left rows come before right rows of the same time.
    order = [F.col(_TIME).asc_nulls_first(), (F.col(_LEFT).desc() if strict else F.col(_LEFT).asc()), F.col("_value").asc_nulls_first()]
    within = W.partitionBy(*key, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    lasts = both.where(f"{_LEFT} = 0").groupBy(*key, "_slice").agg(F.max_by("_value", F.struct(_TIME, "_value")).alias("_last"))
    slices = both.select(*key, "_slice").distinct().join(lasts, [*key, "_slice"], "left")
    earlier = W.partitionBy(*key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = slices.withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")
    found = both.withColumn("_here", F.last("_value", ignorenulls=True).over(within)).where(f"{_LEFT} = 1").drop("_value")
    found = found.join(carried, [*key, "_slice"], "left").withColumn("_found", F.coalesce("_here", "_carried"))
    usable = reduce(and_, [F.col(c).isNotNull() for c in (*key, _TIME)])
    return found.select(*[F.col(f"{_ROW}.l_{c}").alias(c) for c in left.columns], *[F.when(usable, F.col(f"_found.{v}")).alias(f"asof_{v}") for v in values])


def stale_before(event: Column, quote: Column, minutes: int = 60) -> Column:
    """0 < age <= minutes of a quote strictly before an event."""
    age = (F.unix_micros(event.cast("timestamp")) - F.unix_micros(quote.cast("timestamp"))) / 60e6
    return F.coalesce((age > 0) & (age <= minutes), F.lit(False))


def stale_after(target: Column, quote: Column, minutes: int = 60) -> Column:
    """0 <= age <= minutes of a quote at or after a target time."""
    age = (F.unix_micros(quote.cast("timestamp")) - F.unix_micros(target.cast("timestamp"))) / 60e6
    return F.coalesce((age >= 0) & (age <= minutes), F.lit(False))


def complete_groups(rows: DataFrame, keys: list[str], time: str, member: str, size: int, filled: Column | None = None) -> DataFrame:
    """(keys, time) of snapshots with ``size`` rows of as many members, all ``filled``."""
    good = F.lit(True) if filled is None else filled
    counts = rows.groupBy(*keys, time).agg(F.count("*").alias("n"), F.countDistinct(member).alias("m"), F.count_if(good).alias("g"))
    return counts.where((F.col("n") == size) & (F.col("m") == size) & (F.col("g") == size)).select(*keys, time)


def latest_complete(rows: DataFrame, decisions: DataFrame, keys: list[str], time: str, decision: str, member: str, size: int, filled: Column | None = None) -> DataFrame:
    """The rows of each key's last complete snapshot at or before its decision, with the decision beside them.

    Whether a snapshot is complete does not depend on the decision, so the
    complete ones are carried to the decisions by ``asof``.
    """
    complete = complete_groups(rows, keys, time, member, size, filled)
    chosen = asof(decisions.select(*keys, decision).distinct(), complete, keys, decision, time, [time]).withColumnRenamed(f"asof_{time}", time)
    return rows.join(chosen.where(F.col(time).isNotNull()), [*keys, time])


def latest_versions(observations: DataFrame, decisions: DataFrame, keys: list[str], issue: str, received: str, value: str, decision: str) -> DataFrame:
    """For each decision, every issue's last receipt among those issued and received by then.

    conflict is true where the last receipt has several values; a correction
    that arrives later is not seen. Each version has the span in which it is the
    last, so a decision meets one version of an issue and no others are ranked.
    """
    each = observations.groupBy(*keys, issue, received).agg(F.max(value).alias(value), (F.min(value) != F.max(value)).alias("conflict"))
    spans = each.withColumn("_until", F.lead(received).over(W.partitionBy(*keys, issue).orderBy(received)))
    known = (F.col(received) <= F.col(decision)) & (F.col(issue) <= F.col(decision)) & (F.col("_until").isNull() | (F.col("_until") > F.col(decision)))
    return decisions.select(*keys, decision).distinct().join(spans, keys).where(known).select(*keys, decision, issue, received, value, "conflict")


def exactly_one(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """left with the right row's values where exactly one right row has the keys, else null."""
    single = right.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.max(v).alias(v) for v in values])
    return left.join(single, keys, "left").select(*left.columns, *[F.when(F.col("_n") == 1, F.col(v)).alias(v) for v in values])
