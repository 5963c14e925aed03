"""Block bootstraps as joins: an index table of draws meets the daily values, and each replicate is a group."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Most starts (replicates x blocks) that one bootstrap may draw; the driver holds and sends four bytes for each.
MOST_STARTS = 20_000_000


def draw_starts(n: int, block: int, reps: int, rng: np.random.Generator) -> np.ndarray:
    """First days of the blocks that a moving-block bootstrap draws: (reps, blocks). One generator can serve several calls in turn."""
    if not 1 <= block <= n:
        raise ValueError("a block has between 1 and n days")
    blocks = -(-n // block)
    if reps * blocks > MOST_STARTS:
        raise ValueError("too many draws for one bootstrap")
    starts = np.arange(n - block + 1)
    return np.array([rng.choice(starts, size=blocks) for _ in range(reps)], dtype=np.int32).reshape(reps, blocks)


def places_of(starts: np.ndarray, block: int, n: int) -> np.ndarray:
    """The days of the drawn blocks in turn, cut at n: (reps, n)."""
    return (starts[:, :, None] + np.arange(block, dtype=starts.dtype)).reshape(len(starts), -1)[:, :n]


def block_starts(n: int, block: int, reps: int, rng: np.random.Generator) -> np.ndarray:
    """Places drawn by a moving-block bootstrap: (reps, n)."""
    return places_of(draw_starts(n, block, reps, rng), block, n)


def index_table(spark: SparkSession, starts: np.ndarray, block: int, n: int) -> DataFrame:
    """(rep, place, times): how often each replicate draws each day. Tasks expand the starts."""

    def expand(batches):
        for batch in batches:
            for rep in batch.column(0).to_pylist():
                times = np.bincount(places_of(starts[rep : rep + 1], block, n)[0], minlength=n)
                drawn = np.flatnonzero(times)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(drawn), rep), pa.int32()), pa.array(drawn, pa.int32()), pa.array(times[drawn], pa.int32())], names=["rep", "place", "times"])

    return spark.range(len(starts)).mapInArrow(expand, "rep int, place int, times int")


def numbered_days(days: DataFrame, day: str) -> DataFrame:
    """days, one row a day and so few, with their place from 0 in order."""
    return days.withColumn("place", F.row_number().over(W.orderBy(day)) - 1)


def replicates(days: DataFrame, day: str, numerator: str, denominator: str, starts: np.ndarray, block: int = 1, n: int | None = None) -> DataFrame:
    """(rep, value): ratio of sums over each replicate's days (blocks from the starts, cut at n days); the days are numbered in order."""
    numbered = numbered_days(days, day).select("place", numerator, denominator)
    drawn = index_table(days.sparkSession, starts, block, starts.shape[1] * block if n is None else n).join(numbered, "place")
    num, den = F.sum(F.col(numerator) * F.col("times")), F.sum(F.col(denominator) * F.col("times"))
    return drawn.groupBy("rep").agg(F.when(den > 0, num / den).alias("value")).where("value is not null")


def ratio_interval(days: DataFrame, day: str, numerator: str, denominator: str, block: int, reps: int, seed: int) -> DataFrame:
    """One row: estimate, low, high (2.5 and 97.5 %), reps. ``days`` has one row a day, so it is small."""
    n = days.count()
    if not n:
        return days.sparkSession.createDataFrame([], "estimate double, low double, high double, reps long")
    block = min(block, n)
    values = replicates(days, day, numerator, denominator, draw_starts(n, block, reps, np.random.default_rng(seed)), block, n)
    bounds = values.agg(F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"), F.count("*").alias("reps"))
    whole = days.agg((F.sum(numerator) / F.sum(denominator)).alias("estimate"))
    return whole.crossJoin(bounds)


def mean_interval(days: DataFrame, day: str, value: str, block: int, reps: int, seed: int) -> DataFrame:
    """The same for a mean of daily values."""
    return ratio_interval(days.withColumn("_one", F.lit(1.0)), day, value, "_one", block, reps, seed)


def order_interval(days: DataFrame, day: str, flag: str, block: int, reps: int, seed: int) -> DataFrame:
    """One row (low, high): moving-block interval of a 0/1 series' mean, from the sorted replicates' own values.

    ``days`` has one row a day. The starts come from Python's generator seeded
    with seed + block; the bounds are the replicates at the whole places below
    2.5 and 97.5 %. A constant or empty series has nulls.
    """
    size = days.agg(F.count("*").alias("n"), F.countDistinct(flag).alias("kinds")).first()
    if size["kinds"] < 2:
        return days.sparkSession.createDataFrame([(None, None)], "low double, high double")
    n = size["n"]
    block = max(1, min(block, n))
    blocks = -(-n // block)
    if reps * blocks > MOST_STARTS:
        raise ValueError("too many draws for one bootstrap")
    draw = random.Random(seed + block)
    starts = np.array([[draw.choice(range(n - block + 1)) for _ in range(blocks)] for _ in range(reps)], dtype=np.int32)
    values = replicates(days.withColumn("_one", F.lit(1.0)), day, flag, "_one", starts, block, n)
    ranked = F.array_sort(F.collect_list("value"))
    return values.agg(F.get(ranked, F.lit(int(0.025 * (reps - 1)))).alias("low"), F.get(ranked, F.lit(int(0.975 * (reps - 1)))).alias("high"))


def date_intervals(days: DataFrame, day: str, metrics: list[str], reps: int, seed: int) -> DataFrame:
    """(metric, estimate, low, high): means of daily metrics under one draw of whole dates for all of them."""
    n = days.count()
    if not n:
        return days.sparkSession.createDataFrame([], "metric string, estimate double, low double, high double")
    if reps * n > MOST_STARTS:
        raise ValueError("too many draws for one bootstrap")
    rng = np.random.default_rng(seed)
    places = np.array([rng.integers(0, n, size=n) for _ in range(reps)], dtype=np.int32)
    long = numbered_days(days, day).unpivot(["place"], metrics, "metric", "v")
    drawn = index_table(days.sparkSession, places, 1, n).join(long, "place").groupBy("rep", "metric").agg((F.sum(F.col("v") * F.col("times")) / n).alias("value"))
    bounds = drawn.groupBy("metric").agg(F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"))
    return long.groupBy("metric").agg(F.avg("v").alias("estimate")).join(bounds, "metric")
