"""Expectations on tables: cardinality, uniqueness, nulls, sets. A failed one raises ExpectationError."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ExpectationError(ValueError):
    """A table breaks a stated expectation."""


def columns(df: DataFrame, wanted: list[str], exact: bool = False) -> DataFrame:
    missing = [c for c in wanted if c not in df.columns]
    extra = [c for c in df.columns if c not in wanted] if exact else []
    if missing or extra:
        raise ExpectationError(f"missing columns {missing}, unexpected {extra}")
    return df


def count(df: DataFrame, n: int) -> DataFrame:
    found = df.count()
    if found != n:
        raise ExpectationError(f"{found} rows instead of {n}")
    return df


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if df.groupBy(*keys).count().where("count > 1").head(1):
        raise ExpectationError(f"repeated keys {keys}")
    return df


def not_null(df: DataFrame, names: list[str]) -> DataFrame:
    bad = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names]).first().asDict()
    if any(bad.values()):
        raise ExpectationError(f"nulls: {bad}")
    return df


def holds(df: DataFrame, condition: Column, what: str) -> DataFrame:
    """Every row meets the condition; null counts as not."""
    if df.where(~F.coalesce(condition, F.lit(False))).head(1):
        raise ExpectationError(what)
    return df


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    """Both tables hold the same set of keys (nulls compare as equal)."""
    on = reduce(Column.__and__, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    left, right = a.select(*keys).distinct().alias("a"), b.select(*keys).distinct().alias("b")
    if left.join(right, on, "left_anti").head(1) or right.join(left, on, "left_anti").head(1):
        raise ExpectationError(f"different sets of {keys}")


def join_checked(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", validate: str = "m:1") -> DataFrame:
    """An equi-join whose sides have the stated cardinality: 1:1, m:1 or 1:m."""
    if validate[0] == "1":
        unique(left, keys)
    if validate[-1] == "1":
        unique(right, keys)
    return left.join(right, keys, how)
