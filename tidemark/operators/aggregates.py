"""Aggregates: ratios, concentration, weights, quantiles, cells, distribution scores."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..expect import ExpectationError

#: Slices of a running sum: one for so many rows, and at most so many.
SLICE_ROWS, MOST_SLICES = 1 << 18, 256

def ratio_of_sums(rows: DataFrame, keys: list[str], numerator: str, denominator: str) -> DataFrame:
    """(keys, beta, n): sum over sum, null unless the denominator is positive."""
    num, den = F.sum(numerator), F.sum(denominator)
    return rows.groupBy(*keys).agg(F.when(den > 0, num / den).alias("beta"), F.count("*").alias("n"))


def concentration(rows: DataFrame, key: str, value: str, top: int = 5) -> DataFrame:
    """One row: max_share, top_share, hhi, effective of the groups' shares in the total."""
    sums = rows.groupBy(key).agg(F.sum(value).alias("s"))
    total = sums.agg(F.sum("s").alias("t"))
    shares = sums.crossJoin(F.broadcast(total)).select(key, (F.col("s") / F.col("t")).alias("share"))
    # The k greatest come from a bounded top-k, not from one sorted group.
    best = shares.orderBy(F.col("share").desc(), key).limit(top).agg(F.max("share").alias("max_share"), F.sum("share").alias("top_share"))
    hhi = shares.agg(F.sum(F.col("share") * F.col("share")).alias("hhi"))
    return best.crossJoin(hhi).withColumn("effective", 1 / F.col("hhi"))


def two_level_mean(rows: DataFrame, keys: list[str], inner: str, value: str, name: str = "mean") -> DataFrame:
    """Mean over the groups' ``inner`` means, so that every inner group weighs the same."""
    return rows.groupBy(*keys, inner).agg(F.avg(value).alias("_m")).groupBy(*keys).agg(F.avg("_m").alias(name), F.count("*").alias("groups"))


def balanced_weights(rows: DataFrame, key: str, name: str = "weight") -> DataFrame:
    """One over the number of rows of the row's group; rows with a null key are one group.

    The counts come back by a join, so no group is held or sorted by one task.
    """
    counts = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    return rows.join(counts, F.col(key).eqNullSafe(F.col("_key"))).withColumn(name, F.lit(1.0) / F.col("_n")).drop("_key", "_n")


def weighted_moments(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """(keys, weighted_mean, weighted_std) over the population; null values do not count.

    The mean comes back to the rows, so that squares are of what is left beside it.
    """
    w, x = F.col(weight), F.col(value)
    known = rows.where(x.isNotNull())
    means = known.groupBy(*keys).agg(F.try_divide(F.sum(w * x), F.sum(w)).alias("weighted_mean"))
    both = join_groups(known, means, keys).withColumn("_d", x - F.col("weighted_mean"))
    spread = both.groupBy(*keys).agg(F.sqrt(F.try_divide(F.sum(w * F.col("_d") * F.col("_d")), F.sum(w))).alias("weighted_std"))
    return join_groups(means, spread, keys).select(*keys, "weighted_mean", "weighted_std")


def centre_and_scale(rows: DataFrame, columns: list[str], weight: str, least: float = 1e-12) -> tuple[list[float], list[float]]:
    """Weighted means and standard deviations of the columns; a weight that is not positive, or a column that hardly varies, is an error."""
    w = F.col(weight)
    first = rows.agg(F.sum(w).alias("w"), *[F.try_divide(F.sum(w * F.col(c)), F.sum(w)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    if not first["w"] or first["w"] <= 0:
        raise ExpectationError("the weights' sum is not positive")
    means = [float(first[f"m{i}"]) for i in range(len(columns))]
    second = rows.agg(*[F.sqrt(F.sum(w * (F.col(c) - m) * (F.col(c) - m)) / F.sum(w)).alias(f"s{i}") for i, (c, m) in enumerate(zip(columns, means, strict=True))]).first()
    spread = [float(second[f"s{i}"]) for i in range(len(columns))]
    if flat := [c for c, x in zip(columns, spread, strict=True) if x <= least]:
        raise ExpectationError(f"columns that do not vary: {flat}")
    return means, spread


def running_sums(rows: DataFrame, keys: list[str], value: str, sums: dict[str, Column], slices: int | None = None) -> DataFrame:
    """(keys, value, and for each name: name, upto_name, total_name): sums at each distinct value, up to and including it, and of the group.

    The values are cut into slices at approximate quantiles of the whole table,
    so a group that holds a third of all rows is many windows; the sums of the
    slices before are added to each slice's own running sum. There are more
    slices the more rows there are, up to MOST_SLICES. The cuts are read by the
    driver once, so that a task that runs again cuts alike; they decide where the
    work lies, not the result. Null values do not count; null keys are a group.
    """
    known = rows.where(F.col(value).isNotNull())
    found = known.agg(F.percentile_approx(value, [k / MOST_SLICES for k in range(1, MOST_SLICES)], 10_000).alias("c"), F.count("*").alias("n")).first()
    n = slices or max(16, min(MOST_SLICES, found["n"] // SLICE_ROWS))
    cuts = sorted({c for k, c in enumerate(found["c"] or [], 1) if k * n // MOST_SLICES > (k - 1) * n // MOST_SLICES})
    named, names = [f"_k{i}" for i in range(len(keys))], list(sums)
    mass = known.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], F.col(value).alias("_v")).agg(*[F.sum(c).alias(f"_m_{x}") for x, c in sums.items()])
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("_v"))) if cuts else F.lit(0)
    cut = mass.withColumn("_slice", part)
    every, earlier = W.partitionBy(*named), W.partitionBy(*named).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    within = W.partitionBy(*named, "_slice").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = cut.groupBy(*named, "_slice").agg(*[F.sum(f"_m_{x}").alias(f"_s_{x}") for x in names])
    before = parts.select(*[F.col(n).alias(f"b{n}") for n in [*named, "_slice"]], *[F.coalesce(F.sum(f"_s_{x}").over(earlier), F.lit(0)).alias(f"_b_{x}") for x in names], *[F.sum(f"_s_{x}").over(every).alias(f"_t_{x}") for x in names])
    here = cut.withColumns({f"_h_{x}": F.sum(f"_m_{x}").over(within) for x in names})
    same = reduce(and_, [F.col(n).eqNullSafe(F.col(f"b{n}")) for n in (*named, "_slice")])
    columns = [c for x in names for c in (F.col(f"_m_{x}").alias(x), (F.col(f"_b_{x}") + F.col(f"_h_{x}")).alias(f"upto_{x}"), F.col(f"_t_{x}").alias(f"total_{x}"))]
    return here.join(before, same).select(*[F.col(n).alias(k) for k, n in zip(keys, named, strict=True)], F.col("_v").alias(value), *columns)


def cumulative(rows: DataFrame, keys: list[str], value: str, weight: Column, slices: int | None = None) -> DataFrame:
    """(keys, value, mass, below, total): each distinct value's weight, and the weight up to and including it."""
    run = running_sums(rows, keys, value, {"w": weight}, slices)
    return run.select(*keys, value, F.col("w").alias("mass"), F.col("upto_w").alias("below"), F.col("total_w").alias("total"))


def weighted_quantile(rows: DataFrame, keys: list[str], value: str, weight: str, q: float) -> DataFrame:
    """(keys, quantile): the least value whose cumulative weight reaches q of the total (no interpolation)."""
    run = cumulative(rows, keys, value, F.col(weight))
    return run.where(F.col("below") >= q * F.col("total") - 1e-12).groupBy(*keys).agg(F.min(value).alias("quantile"))


def join_groups(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the columns of right's row of the same group; null keys are a group too."""
    named = [f"_k{i}" for i in range(len(keys))]
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, named, strict=True)], F.lit(True))
    return left.join(right.withColumnsRenamed(dict(zip(keys, named, strict=True))), same, "left").drop(*named)


def quantiles(rows: DataFrame, keys: list[str], value: str, named: dict[str, float]) -> DataFrame:
    """(keys, one column for each name): exact quantiles of the values that are not null, interpolated.

    They are read off the running counts, so no task holds a group's values.
    """
    run = cumulative(rows, keys, value, F.lit(1))
    v, found = F.col(value).cast("double"), {}
    for name, q in named.items():
        place = (F.col("total") - 1) * q
        low, high = (F.min(F.when(F.col("below") > at, v)) for at in (F.floor(place), F.ceil(place)))
        part = F.max(place - F.floor(place))
        found[name] = low + (high - low) * part
    return run.groupBy(*keys).agg(*[c.alias(n) for n, c in found.items()])


def describe(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, median, std (n - 1), min, p05, p95, max; quantiles interpolate."""
    v = F.col(value)
    sums = rows.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    both = join_groups(sums, quantiles(rows, keys, value, {"median": 0.5, "p05": 0.05, "p95": 0.95}), keys)
    return both.select(*keys, "n", "mean", "median", "std", "min", "p05", "p95", "max")


def crosstab(rows: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """Counts of the fixed values of a column for each key; absent ones are 0."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def fixed_categories(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """A count for every listed value, absent ones 0; other values do not appear."""
    fixed = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return fixed.join(rows.groupBy(column).count(), column, "left").select(column, F.coalesce("count", F.lit(0)).alias("n"))


def calendar_fill(rows: DataFrame, day: str, first: Column, last: Column, values: list[str]) -> DataFrame:
    """One row for each day of the calendar; days without rows have zeros."""
    days = rows.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias(day))
    sums = rows.groupBy(day).agg(*[F.sum(v).alias(v) for v in values], F.count("*").alias("n"))
    return days.join(sums, day, "left").select(day, *[F.coalesce(c, F.lit(0)).alias(c) for c in (*values, "n")])


def rate(condition: Column) -> Column:
    return F.avg(condition.cast("int"))


def pnl_concentration(rows: DataFrame, keys: list[str], date: str, pnl: str) -> DataFrame:
    """(keys, positive_sum, top1_share, top3_share, best, worst) over the dates' profits."""
    days = rows.groupBy(*keys, date).agg(F.sum(pnl).alias("p"))
    ranked = days.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("p").desc(), date)))
    gain = F.when(F.col("p") > 0, F.col("p"))
    total = F.coalesce(F.sum(gain), F.lit(0.0))
    part = lambda k: F.when(total > 0, F.coalesce(F.sum(F.when(F.col("r") <= k, gain)), F.lit(0.0)) / total)
    return ranked.groupBy(*keys).agg(total.alias("positive_sum"), part(1).alias("top1_share"), part(3).alias("top3_share"), F.max("p").alias("best"), F.min("p").alias("worst"))


def ecdf(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, cdf, survival): P(X <= value) and P(X > value), one row for each distinct value."""
    cdf = F.col("below") / F.col("total")
    return cumulative(rows, keys, value, F.lit(1)).select(*keys, value, cdf.alias("cdf"), (1 - cdf).alias("survival"))


def crps(samples: DataFrame, keys: list[str], value: str, observed: str) -> DataFrame:
    """(keys, crps) of the samples' distribution against each group's ``observed``: E|X - y| - E|X - X'| / 2.

    The mean difference comes from the ranks of the distinct values, not from
    pairs. Null samples do not count; a group without others has null.
    """
    run = cumulative(samples, keys, value, F.lit(1))
    # The ranks of m equal samples that end at rank b add up to m (2 b - m + 1) / 2.
    ranks = F.col("mass") * (2 * F.col("below") - F.col("mass") - F.col("total"))
    spread = run.groupBy(*keys).agg((F.sum(ranks * F.col(value)) / F.first("total") / F.first("total")).alias("_spread"))
    near = samples.groupBy(*keys).agg(F.avg(F.abs(F.col(value) - F.col(observed))).alias("_near"))
    return join_groups(near, spread, keys).select(*keys, (F.col("_near") - F.col("_spread")).alias("crps"))


def pit_deciles(rows: DataFrame, pit: str, weight: str | None = None) -> DataFrame:
    """(decile 0..9, mass): weights of the ten PIT bins over the total, the last bin closed."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    sums = rows.groupBy(F.least(F.floor(F.col(pit) * 10), F.lit(9)).cast("int").alias("decile")).agg(F.sum(w).alias("m"))
    total = sums.agg(F.sum("m").alias("t"))
    tens = rows.sparkSession.range(10).select(F.col("id").cast("int").alias("decile"))
    return tens.join(sums, "decile", "left").crossJoin(F.broadcast(total)).select("decile", (F.coalesce("m", F.lit(0.0)) / F.col("t")).alias("mass"))


def calibration_cells(rows: DataFrame, keys: list[str], date: str, predicted: str, hit: str, least_dates: int = 100, reps: int = 0, seed: int = 0) -> DataFrame:
    """(keys, dates, n, mean_predicted, mean_hit, gap, supported): means of the dates' means.

    With reps, also (low, high, slack): the 2.5 and 97.5 % quantiles of the gap's
    mean over draws of whole dates, and the greater of their absolute values.
    The cells draw from generators of their own, seeded with seed and the cell's
    place in order of its keys, from 1. A cell's task holds one row a date.
    """
    days = rows.groupBy(*keys, date).agg(F.count("*").alias("c"), F.avg(predicted).alias("p"), F.avg(hit).alias("h"))
    cells = days.groupBy(*keys).agg(F.count("*").alias("dates"), F.sum("c").alias("n"), F.avg("p").alias("mean_predicted"), F.avg("h").alias("mean_hit"))
    cells = cells.withColumns({"gap": F.col("mean_hit") - F.col("mean_predicted"), "supported": F.col("dates") >= least_dates})
    if not reps:
        return cells
    places = cells.select(*keys, F.row_number().over(W.orderBy(*keys)).alias("_place"))  # cells, not rows

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        gaps = part.sort_values(date)["gap"].to_numpy()
        rng = np.random.default_rng(seed + int(part["_place"].iloc[0]))
        means = [gaps[rng.integers(0, len(gaps), size=len(gaps))].mean() for _ in range(reps)]
        low, high = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame({"_place": part["_place"].iloc[:1], "low": [low], "high": [high]})

    gaps = join_groups(days, places, keys).select("_place", date, (F.col("h") - F.col("p")).alias("gap"))
    drawn = join_groups(cells, places, keys).join(gaps.groupBy("_place").applyInPandas(draw, "_place int, low double, high double"), "_place")
    return drawn.withColumn("slack", F.greatest(F.abs("low"), F.abs("high"))).drop("_place")


def support_cells(rows: DataFrame, keys: list[str], date: str, features: list[str], least_dates: int = 45, trend: str | None = None) -> DataFrame:
    """(keys, dates, n, supported, and of every feature: how many are filled, q01 and q99).

    trend: a column whose nulls are counted by their dates, as missing_trend_dates.
    """
    counts = [F.countDistinct(date).alias("dates"), F.count("*").alias("n"), *[F.count(c).alias(f"{c}_filled") for c in features]]
    if trend is not None:
        counts.append(F.countDistinct(F.when(F.col(trend).isNull(), F.col(date))).alias("missing_trend_dates"))
    cells = rows.groupBy(*keys).agg(*counts).withColumn("supported", F.col("dates") >= least_dates)
    for c in features:
        cells = join_groups(cells, quantiles(rows, keys, c, {f"{c}_q01": 0.01, f"{c}_q99": 0.99}), keys)
    return cells


def weighted_ks(rows: DataFrame, pit: str, weight: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, ks): greatest distance of the weighted distribution of ``pit`` from the uniform one, before and after each value."""
    after, before = F.col("below") / F.col("total"), (F.col("below") - F.col("mass")) / F.col("total")
    run = cumulative(rows, keys or [], pit, F.col(weight))
    return run.groupBy(*(keys or [])).agg(F.max(F.greatest(F.abs(after - F.col(pit)), F.abs(before - F.col(pit)))).alias("ks"))


def pit_summary(rows: DataFrame, pit: str, weight: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, mean, variance, ks): weighted mean, variance and distance from uniform of ``pit``; one row without keys."""
    keys = keys or []
    moments = weighted_moments(rows, keys, pit, weight)
    moments = moments.select(*keys, F.col("weighted_mean").alias("mean"), (F.col("weighted_std") * F.col("weighted_std")).alias("variance"))
    return join_groups(moments, weighted_ks(rows, pit, weight, keys), keys)
