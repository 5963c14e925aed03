"""Ordered operators: pairs, gaps, runs, changes, grids, first qualifying rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a slice of a group that is cut along its order, and the most slices.
SLICE_ROWS, MOST_SLICES = 1 << 18, 256


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)], F.lit(True))


def in_slices(rows: DataFrame, on: str) -> DataFrame:
    """rows with ``_slice``, which rises with the column: one for some SLICE_ROWS rows, cut at approximate quantiles of the whole table.

    The cuts (at most MOST_SLICES) are read by the driver once; they decide where
    the work lies, not the result. Null values lie in the first slice.
    """
    kind = rows.schema[on].dataType.typeName()
    place = F.unix_micros(F.col(on).cast("timestamp")) if kind in ("timestamp", "timestamp_ntz", "date") else F.col(on)
    if kind in ("string", "binary", "boolean"):
        return rows.withColumn("_slice", F.lit(0))
    found = rows.agg(F.percentile_approx(place, [k / MOST_SLICES for k in range(1, MOST_SLICES)], 10_000).alias("c"), F.count("*").alias("n")).first()
    n = min(MOST_SLICES, -(-found["n"] // SLICE_ROWS))
    cuts = sorted({c for k, c in enumerate(found["c"] or [], 1) if k * n // MOST_SLICES > (k - 1) * n // MOST_SLICES})
    return rows.withColumn("_slice", F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < place)), F.lit(0)) if cuts else F.lit(0))


def carried_over(rows: DataFrame, keys: list[str], sums: dict[str, Column], lasts: dict[str, Column] | None = None) -> DataFrame:
    """rows of in_slices with, for each name, the sum over their group's earlier slices (0 if none), or the last of its earlier slices' values."""
    named = [f"_k{i}" for i in range(len(keys))]
    lasts = lasts or {}
    each = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], F.col("_slice").alias("_on")).agg(*[c.alias(n) for n, c in (sums | lasts).items()])
    earlier = W.partitionBy(*named).orderBy("_on").rowsBetween(W.unboundedPreceding, -1)
    before = each.select(*named, "_on", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums], *[F.last(n, ignorenulls=True).over(earlier).alias(n) for n in lasts])
    return rows.join(before, _same([*keys, "_slice"], [*named, "_on"])).drop(*named, "_on")


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str = "number") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def lagged(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """rows with each value of the row before in the group (null for the first) and ``_number``, their place from 1.

    A group that holds a third of all rows is many windows: slices of the first
    column of the order. The last row of each slice is carried to the next.
    """
    sliced = in_slices(rows, order[0]).withColumn("_now", F.struct(*[c.alias(n) for n, c in values.items()]))
    at = F.struct(*order)
    both = carried_over(sliced, keys, {"_before": F.count("*")}, {"_last": F.max_by("_now", at)})
    within = W.partitionBy(*keys, "_slice").orderBy(*order)
    inside = F.lag("_now").over(within)
    both = both.withColumns({"_own": F.row_number().over(within), "_lag": inside})
    found = F.when(F.col("_own") > 1, F.col("_lag")).otherwise(F.col("_last"))
    return both.select(*rows.columns, *[found[n].alias(n) for n in values], (F.col("_before") + F.col("_own")).alias("_number"))


def share(rows: DataFrame, keys: list[str], value: str, name: str = "share") -> DataFrame:
    """Each row's part of its group's total."""
    return rows.withColumn(name, F.col(value) / F.sum(value).over(W.partitionBy(*keys)))


def consecutive_pairs(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Each row but a group's first, with the values of the one before (``old_``) and its sequence number."""
    out = lagged(rows, keys, order, {f"old_{v}": F.col(v) for v in values})
    return out.withColumn("sequence", (F.col("_number") - 1).cast("int")).drop("_number").where("sequence > 0")


def gaps(rows: DataFrame, keys: list[str], time: str, tie: str, name: str = "gap_minutes") -> DataFrame:
    """Minutes since the row before in the group; null for the first."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    out = lagged(rows, keys, [time, tie], {"_then": micros})
    return out.withColumn(name, (micros - F.col("_then")) / 60e6).drop("_then", "_number")


def late_polls(rows: DataFrame, keys: list[str], time: str, tie: str, cadence_seconds: float, slack: float = 1.75) -> DataFrame:
    """Rows that come more than slack cadences after the one before."""
    return gaps(rows, keys, time, tie).where(F.col("gap_minutes") * 60 > cadence_seconds * slack)


def longest_true_run(rows: DataFrame, keys: list[str], order: list[str], flag: str) -> DataFrame:
    """(keys, longest): the most consecutive rows whose flag is true; 0 if none.

    Rows of one run have one difference between their place among all rows of
    the group and among those of their flag; both are counted over slices.
    """
    sliced = in_slices(rows.select(*keys, *order, F.coalesce(flag, F.lit(False)).alias("_flag")), order[0])
    both = carried_over(sliced, keys, {"_all": F.count("*"), "_true": F.count_if("_flag")})
    within, alike = W.partitionBy(*keys, "_slice").orderBy(*order), W.partitionBy(*keys, "_slice", "_flag").orderBy(*order)
    ahead = F.when(F.col("_flag"), F.col("_true")).otherwise(F.col("_all") - F.col("_true"))
    islands = both.withColumn("_island", F.col("_all") + F.row_number().over(within) - ahead - F.row_number().over(alike)).groupBy(*keys, "_flag", "_island").agg(F.count("*").alias("_n"))
    return islands.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_flag"), F.col("_n"))), F.lit(0)).alias("longest"))


def changes(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str = "changed") -> DataFrame:
    """Whether the value differs from the one before (null-safe); a group's first row is a change."""
    out = lagged(rows, keys, order, {"_was": F.col(value)})
    return out.withColumn(name, (F.col("_number") == 1) | ~F.col(value).eqNullSafe(F.col("_was"))).drop("_was", "_number")


def on_grid(grid: DataFrame, observations: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Grid points with the last value and the running maximum of what was observed by then.

    Days are windows of their own, and each day's last value and maximum are
    carried over the later ones, so one busy key is many groups. Null values and
    observations without a time do not count; a grid point without a time has
    nulls; null keys are a group.
    """
    points = grid.select(*keys, time).withColumns({"_grid": F.lit(1), value: F.lit(None).cast(observations.schema[value].dataType)})
    seen = observations.where(F.col(time).isNotNull() & F.col(value).isNotNull()).select(*keys, time, value).withColumn("_grid", F.lit(0))
    both = seen.unionByName(points).withColumn("_day", F.to_date(time))
    within = W.partitionBy(*keys, "_day").orderBy(time, "_grid", value).rowsBetween(W.unboundedPreceding, W.currentRow)
    here = both.withColumns({"_last": F.last(value, ignorenulls=True).over(within), "_max": F.max(value).over(within)}).where("_grid = 1")
    days = both.groupBy(*keys, "_day").agg(F.max_by(value, F.when(F.col("_grid") == 0, F.struct(time, value))).alias("_l"), F.max(value).alias("_m"))
    earlier = W.partitionBy(*keys).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    named = [f"_k{i}" for i in range(len(keys))]
    carried = days.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], F.col("_day").alias("_on"), F.last("_l", ignorenulls=True).over(earlier).alias("_before"), F.max("_m").over(earlier).alias("_peak"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip([*keys, "_day"], [*named, "_on"], strict=True)])
    return here.join(carried, same).select(*keys, time, F.coalesce("_last", "_before").alias("last_value"), F.greatest("_max", "_peak").alias("running_max"))


def first_qualifying(rows: DataFrame, keys: list[str], condition: Column, order: list[Column]) -> DataFrame:
    """The first row of each group that meets the condition; ``order`` ends in a unique column."""
    return numbered(rows.where(condition), keys, order, "_n").where("_n = 1").drop("_n")


def weighted_cumulative(rows: DataFrame, keys: list[str], order: list[str], weight: str, name: str = "cumulative") -> DataFrame:
    return rows.withColumn(name, F.sum(weight).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))


def contiguous(rows: DataFrame, keys: list[str], lower: str, upper: str, size: int) -> DataFrame:
    """(keys, contiguous): whether a group has ``size`` ranges, each starting one above the end of the one before."""
    w = W.partitionBy(*keys).orderBy(F.col(lower).asc_nulls_first())
    steps = rows.withColumn("_ok", F.coalesce(F.lead(lower).over(w) == F.col(upper) + 1, F.lead(F.lit(1)).over(w).isNull()))
    return steps.groupBy(*keys).agg(((F.count("*") == size) & F.bool_and("_ok")).alias("contiguous"))


def evenly_spaced(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """k rows of each group at even distances, first and last included; places round half to even."""
    w = W.partitionBy(*keys)
    placed = rows.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    places = F.transform(F.sequence(F.lit(0), F.least(F.lit(k), F.col("_n")).cast("int") - 1), lambda i: F.bround(i * (F.col("_n") - 1) / F.greatest(F.least(F.lit(k), F.col("_n")) - 1, F.lit(1)), 0).cast("int"))
    return placed.where(F.array_contains(places, F.col("_i"))).drop("_i", "_n")


def rotation(rows: DataFrame, order: list[str], keys: list[str], parts: int, index: int) -> DataFrame:
    """The rows of each group whose place leaves remainder ``index``."""
    return numbered(rows, keys, [F.col(c) for c in order], "_i").where((F.col("_i") - 1) % parts == index).drop("_i")


def batches(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Rows of each group numbered into batches of a size."""
    return numbered(rows, keys, [F.col(c) for c in order], "_i").withColumn("batch", F.floor((F.col("_i") - 1) / size)).drop("_i")
