"""Set operators: differences, equality, stable deduplication, overrides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def missing(expected: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that were not seen."""
    return expected.join(seen.select(*keys), keys, "left_anti")


def equal_sets(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same set."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in the order, which ends in a unique column. Rows meet once, as a minimum, not in a sorted group."""
    rest = [c for c in rows.columns if c not in keys]
    ranked = F.struct(*order, *[c for c in rest if c not in order])
    least = rows.groupBy(*keys).agg(F.min(ranked).alias("_r"))
    return least.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def repeated_values(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def override(tiers: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of all tables; of one key, the row of the last table that has it."""
    every = reduce(lambda a, b: a.unionByName(b), [t.withColumn("_tier", F.lit(-i)) for i, t in enumerate(tiers)])
    return every.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("_tier"))).where("_n = 1").drop("_n", "_tier")


def reconcile(left: DataFrame, source: DataFrame, keys: list[str], values: list[str], rtol: float = 1e-9, atol: float = 1e-12, carry: list[str] | None = None) -> DataFrame:
    """left's keys (and the columns to carry) with ``status``: MATCH, MISSING in the source, or MISMATCH of any value."""
    s = source.select(*keys, *[F.col(v).alias(f"s_{v}") for v in values], F.lit(1).alias("_in"))
    near = lambda v: F.coalesce(F.abs(F.col(v) - F.col(f"s_{v}")) <= atol + rtol * F.abs(F.col(f"s_{v}")), F.col(v).isNull() & F.col(f"s_{v}").isNull())
    same = reduce(Column.__and__, [near(v) for v in values])
    return left.join(s, keys, "left").select(*keys, *(carry or []), F.when(F.col("_in").isNull(), "MISSING").when(same, "MATCH").otherwise("MISMATCH").alias("status"))


def correct(rows: DataFrame, fixes: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """rows with the values of ``fixes`` where exactly one fix has the keys; ``original_`` columns keep what was there."""
    single = fixes.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.max(v).alias(f"_new_{v}") for v in values]).where("_n = 1")
    joined = rows.join(single, keys, "left")
    fresh = {v: F.when(F.col("_n").isNotNull(), F.col(f"_new_{v}")).otherwise(F.col(v)) for v in values}
    kept = {f"original_{v}": F.col(v) for v in values}
    return joined.withColumns(kept | {"corrected": F.col("_n").isNotNull()}).withColumns(fresh).drop("_n", *[f"_new_{v}" for v in values])
