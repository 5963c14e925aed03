"""Exact lookups in weighted empirical distributions of any size: probabilities, mean distances, proper scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import join_groups, running_sums


def looked_up(points: DataFrame, at: str, sample: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """points with upto_w, upto_wz, total_w, total_wz: the weight, and the weighted sum of values, of sample values up to ``at``.

    points and sample have the keys; null keys are a group. The points go among
    the sample's values with weight 0, and the running sums are read off there:
    no pairs, and no task holds a distribution. Null values and weights do not
    count; a null ``at``, or a group without a sample, finds nulls.
    """
    known = sample.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
    marks = points.where(F.col(at).isNotNull()).select(*keys, F.col(at).cast("double").alias("_z")).distinct().withColumn("_w", F.lit(0.0))
    both = known.select(*keys, F.col(value).cast("double").alias("_z"), F.col(weight).cast("double").alias("_w")).unionByName(marks)
    run = running_sums(both, keys, "_z", {"w": F.col("_w"), "wz": F.col("_w") * F.col("_z")})
    run = run.where("total_w > 0").select(*keys, F.col("_z").alias("_at"), "upto_w", "upto_wz", "total_w", "total_wz")
    return join_groups(points.withColumn("_at", F.col(at).cast("double")), run, [*keys, "_at"]).drop("_at")


def cdf() -> Column:
    """P(Z <= at) of looked-up rows."""
    return F.col("upto_w") / F.col("total_w")


def survival() -> Column:
    """P(Z > at), strictly above."""
    return 1 - cdf()


def mean_distance(at: str) -> Column:
    """E|Z - at|."""
    below = F.col(at) * F.col("upto_w") - F.col("upto_wz")
    above = (F.col("total_wz") - F.col("upto_wz")) - F.col(at) * (F.col("total_w") - F.col("upto_w"))
    return (below + above) / F.col("total_w")


def pair_distance(sample: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """(keys, pair_distance): E|Z - Z'| of two independent draws, from the running sums of the distinct values."""
    known = sample.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
    run = running_sums(known, keys, value, {"w": F.col(weight).cast("double"), "wz": F.col(weight).cast("double") * F.col(value)})
    step = F.col("w") * (F.col(value) * (F.col("upto_w") - F.col("w")) - (F.col("upto_wz") - F.col("wz")))
    return run.groupBy(*keys).agg((2 * F.sum(step) / F.first("total_w") / F.first("total_w")).alias("pair_distance"))


def crps(points: DataFrame, at: str, sample: DataFrame, keys: list[str], value: str, weight: str, scale: Column | None = None, name: str = "crps") -> DataFrame:
    """points with their continuous ranked probability score against the sample: scale (E|Z - at| - E|Z - Z'| / 2), at least 0."""
    found = join_groups(looked_up(points, at, sample, keys, value, weight), pair_distance(sample, keys, value, weight), keys)
    score = (F.lit(1.0) if scale is None else scale) * (mean_distance(at) - F.col("pair_distance") / 2)
    score = F.when(score.isNotNull(), F.greatest(score, F.lit(0.0)))
    return found.withColumn(name, score).select(*points.columns, cdf().alias("cdf"), survival().alias("survival"), mean_distance(at).alias("mean_distance"), name)
