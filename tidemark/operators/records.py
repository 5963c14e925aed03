"""Small relational operators over captured records."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records
from . import aggregates


def first_present(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Each group's first non-null value in the given order; null where it has none."""
    place = F.when(F.col(value).isNotNull(), F.struct(*order, value))
    return rows.groupBy(*keys).agg(F.min(place)[value].alias(value))


def value_counts(rows: DataFrame, column: str, dropna: bool = True) -> DataFrame:
    """(column, count), with a row for nulls unless dropna."""
    return (rows.where(F.col(column).isNotNull()) if dropna else rows).groupBy(column).agg(F.count("*").alias("count"))


def median_abs(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Median of the absolute value: a group's rows are never in one place."""
    return aggregates.quantiles(rows.select(*keys, F.abs(value).alias("x")), keys, "x", {"median_abs": 0.5})


def paired_mean(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Mean difference over the rows that have both scores, and their number; null where a group has none."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return rows.groupBy(*keys).agg(F.count_if(both).alias("pairs"), F.avg(F.when(both, F.col(a) - F.col(b))).alias("mean_difference"))


def top_margin(rows: DataFrame, n: int, margin: str, ties: list[str]) -> DataFrame:
    """The n rows of the greatest margin; ties by the given columns. Null margins are no candidates."""
    return rows.where(F.col(margin).isNotNull()).orderBy(F.col(margin).desc(), *ties).limit(n)


def nearest_future(rows: DataFrame, keys: list[str], time: str, now: Column) -> DataFrame:
    """Each group's least time after now."""
    return rows.where(F.col(time) > now).groupBy(*keys).agg(F.min(time).alias(time))


def latest_attempts(status: DataFrame, attempts: DataFrame, key: str, pointer: str, attempt: str) -> DataFrame:
    """The attempt that each status row points at; a status whose pointer leads nowhere keeps nulls."""
    return status.join(attempts.withColumnRenamed(attempt, pointer), [key, pointer], "left")


def with_books(markets: DataFrame, books: DataFrame, key: str = "ticker") -> DataFrame:
    """Markets with their order books' levels and best bid and ask; markets without a book stay."""
    best = books.select(key, "yes", "no", records.best_price(F.col("yes")).alias("best_yes"), records.best_price(F.col("no")).alias("best_no"))
    return markets.join(best, key, "left")


def contract_index(targets: DataFrame, kept: list[str], yes: str = "yes_conid", no: str = "no_conid") -> DataFrame:
    """(conid, side, kept...): one row for each side of a target that has an id."""
    return targets.select(*kept, F.explode(F.array(F.struct(F.col(yes).alias("conid"), F.lit("Y").alias("side")), F.struct(F.col(no).alias("conid"), F.lit("N").alias("side")))).alias("s")).select(*kept, "s.conid", "s.side").where("conid is not null")


def rules_fingerprint(rows: DataFrame, required: list[str], left_out: str) -> Column:
    """Hash of a record's fields but one, in order of their names; null if a required field is."""
    fields = sorted(c for c in rows.columns if c != left_out)
    whole = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return F.when(reduce(and_, [F.col(c).isNotNull() for c in required]), F.sha2(whole, 256))


def only_allowed(rows: DataFrame, names: set[str]) -> DataFrame:
    """The allow-listed columns, and only allow-listed fields inside them."""
    return rows.select(*[records.allowed(F.col(f.name), f.dataType, names).alias(f.name) for f in rows.schema.fields if f.name in names])


def one_date_passes(summaries: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """summaries with ``status`` PASS if every condition holds, else FAIL, and the names of those that do not."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in conditions.items()]))
    return summaries.withColumn("failed", failed).withColumn("status", F.when(F.size("failed") == 0, "PASS").otherwise("FAIL"))
