"""Ladders of thresholds: adjacent pairs, complements, consecutive slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def adjacent(rows: DataFrame, keys: list[str], threshold: str, values: list[str]) -> DataFrame:
    """Each threshold with the next greater one of its ladder (``next_``); the last has no pair."""
    w = W.partitionBy(*keys).orderBy(threshold)
    out = rows.withColumns({f"next_{v}": F.lead(v).over(w) for v in [threshold, *values]})
    return out.where(F.col(f"next_{threshold}").isNotNull())


def complements(rows: DataFrame, keys: list[str], side: str, value: str) -> DataFrame:
    """Strikes with exactly one Y and one N row, and the value of each."""
    sides = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if(F.col(side) == "Y").alias("_y"), F.max(F.when(F.col(side) == "Y", F.col(value))).alias(f"y_{value}"), F.max(F.when(F.col(side) == "N", F.col(value))).alias(f"n_{value}"))
    return sides.where("_n = 2 and _y = 1").drop("_n", "_y")


def uniform(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Groups in which the column has one value only."""
    return rows.groupBy(*keys).agg(F.countDistinct(column).alias("_d"), F.count_if(F.col(column).isNull()).alias("_z")).where("_d = 1 and _z = 0").drop("_d", "_z")


def confirmed(rows: DataFrame, keys: list[str], slot: str, time: str, valid: Column, low: float = 25, high: float = 35) -> DataFrame:
    """Rows that confirm the slot before: both valid, slots consecutive, 25 to 35 seconds apart."""
    w = W.partitionBy(*keys).orderBy(slot)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    step = (micros - F.lag(micros).over(w)) / 1e6
    ok = valid & F.lag(valid).over(w) & (F.col(slot) - F.lag(slot).over(w) == 1) & (step >= low) & (step <= high)
    return rows.withColumn("confirmed", F.coalesce(ok, F.lit(False))).where("confirmed").drop("confirmed")
