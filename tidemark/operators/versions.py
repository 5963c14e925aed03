"""States at arbitrary instants from corrected observations: what was the last version of each issue, as received by then."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .aggregates import join_groups

_STATE = ["n", "highest", "newest", "clash"]


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def validity(observations: DataFrame, keys: list[str], issue: str, received: str, value: str) -> DataFrame:
    """(keys, issue, value, clash, since, until): when each version is the one to use, in microseconds.

    A version holds from its receipt, or its issue if that is later, until the
    next receipt of the same issue (null: for ever). clash marks receipts with
    several values, of which the greatest is kept. Rows with a null key, issue,
    receipt or value do not count.
    """
    known = observations.where(reduce(and_, [F.col(c).isNotNull() for c in (*keys, issue, received, value)]))
    each = known.groupBy(*keys, issue, received).agg(F.max(value).alias(value), (F.min(value) != F.max(value)).alias("clash"))
    following = F.lead(received).over(W.partitionBy(*keys, issue).orderBy(received))  # the versions of one issue
    spans = each.withColumns({"since": _micros(F.greatest(received, issue)), "until": _micros(following)})
    return spans.where("until is null or until > since").select(*keys, issue, value, "clash", "since", "until")


def _combined(sides: list[str]) -> dict[str, Column]:
    """The states of several disjoint sets of versions as one."""
    return {
        "n": sum((F.coalesce(f"{s}n", F.lit(0)) for s in sides), F.lit(0)),
        "highest": F.greatest(*[F.col(f"{s}highest") for s in sides]),
        "newest": F.greatest(*[F.col(f"{s}newest") for s in sides]),
        "clash": reduce(lambda a, b: a | b, [F.coalesce(f"{s}clash", F.lit(False)) for s in sides]),
    }


def active_at(points: DataFrame, spans: DataFrame, keys: list[str], at: str, issue: str, value: str, slice_seconds: int = 6 * 3600) -> DataFrame:
    """(keys, at, n, highest, newest, clash) for distinct points: over spans with since <= at < until, how many, the highest value, the struct (issue, value) of the greatest issue, and whether one clashes.

    Spans without an end add up along time: running sums by slices of time, so
    one key of many rows is many windows. Spans with an end are counted once for
    each slice that they cover whole; only those that begin or end in a point's
    slice meet it row by row.
    """
    width = slice_seconds * 1_000_000
    named = F.struct(F.col(issue).alias("issue"), F.col(value).alias("value"))
    marks = points.where(reduce(and_, [F.col(c).isNotNull() for c in (*keys, at)])).select(*keys, at, _micros(F.col(at)).alias("_t")).distinct()
    marks = marks.withColumn("_slice", F.floor(F.col("_t") / width))
    states = lambda: [F.count(F.col("_v")).alias("n"), F.max("_v").alias("highest"), F.max("_named").alias("newest"), F.bool_or("clash").alias("clash")]
    rows = spans.select(*keys, "since", "until", "clash", F.col(value).alias("_v"), named.alias("_named"))

    lasting = rows.where("until is null").withColumns({"_t": F.col("since"), "_slice": F.floor(F.col("since") / width)})
    both = lasting.select(*keys, "_t", "_slice", "_v", "_named", "clash").unionByName(marks.select(*keys, "_t", "_slice", F.col(at)), allowMissingColumns=True)
    order = [F.col("_t"), F.col("_v").isNull()]  # versions of an instant come before points of it
    within = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    here = both.select("*", *[c.alias(f"h_{n}") for n, c in zip(_STATE, (F.count("_v").over(within), F.max("_v").over(within), F.max("_named").over(within), F.bool_or("clash").over(within)), strict=True)])
    here = here.where(F.col(at).isNotNull()).select(*keys, at, "_t", "_slice", *[f"h_{n}" for n in _STATE])
    slices = both.groupBy(*keys, "_slice").agg(*states())
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = slices.select(*keys, "_slice", F.sum("n").over(earlier).alias("c_n"), F.max("highest").over(earlier).alias("c_highest"), F.max("newest").over(earlier).alias("c_newest"), F.bool_or("clash").over(earlier).alias("c_clash"))
    found = here.join(carried, [*keys, "_slice"])

    ending = rows.where("until is not null").withColumn("_slice", F.explode(F.sequence(F.floor(F.col("since") / width), F.floor((F.col("until") - 1) / width))))
    whole = (F.col("since") <= F.col("_slice") * width) & (F.col("until") >= (F.col("_slice") + 1) * width)
    covering = ending.where(whole).groupBy(*keys, "_slice").agg(*states()).select(*keys, "_slice", *[F.col(n).alias(f"w_{n}") for n in _STATE])
    partly = marks.join(ending.where(~whole), [*keys, "_slice"]).where("since <= _t and _t < until")
    partly = partly.groupBy(*keys, at).agg(*states()).select(*keys, at, *[F.col(n).alias(f"p_{n}") for n in _STATE])
    found = found.join(covering, [*keys, "_slice"], "left").join(partly, [*keys, at], "left")
    return found.select(*keys, at, *[c.alias(n) for n, c in _combined(["h_", "c_", "w_", "p_"]).items()])


def state_at(quotes: DataFrame, observations: DataFrame, keys: list[str], at: str, issue: str, received: str, value: str, on_date: Column, local_date: Column, minutes: int = 60) -> DataFrame:
    """quotes with the state that was known at each: current, running_max, below_max, age_minutes, change, reference_age_minutes, latest_issue, known.

    Of each issue the last version received by then counts; a correction that
    comes later is not seen. change compares with the newest issue at least
    ``minutes`` old, among what is known at the quote. All are null (known: 0)
    where nothing is known or the quote's local_date is not the date on_date;
    clash is true where a version that counts has several values of one receipt.
    """
    spans = validity(observations, keys, issue, received, value)
    now = active_at(quotes, spans, keys, at, issue, value).select(*keys, at, *[F.col(n).alias(f"_{n}") for n in _STATE])
    old = spans.withColumn("since", F.greatest("since", _micros(F.col(issue)) + minutes * 60_000_000)).where("until is null or until > since")
    then = active_at(quotes, old, keys, at, issue, value).select(*keys, at, F.col("newest").alias("_old"))
    both = now.join(then, [*keys, at])
    found = join_groups(quotes, both, [*keys, at])
    usable = F.coalesce((F.col("_n") > 0) & (on_date == local_date), F.lit(False))
    age = lambda x: (_micros(F.col(at)) - _micros(x)) / 60e6
    new = {
        "current": F.col("_newest.value"), "running_max": F.col("_highest"), "below_max": F.col("_newest.value") - F.col("_highest"), "age_minutes": age(F.col("_newest.issue")),
        "change": F.col("_newest.value") - F.col("_old.value"), "reference_age_minutes": age(F.col("_old.issue")), "latest_issue": F.col("_newest.issue"),
    }
    return found.select(*quotes.columns, *[F.when(usable, c).alias(n) for n, c in new.items()], F.when(usable, F.col("_n")).otherwise(0).alias("known"), F.coalesce(usable & F.col("_clash"), F.lit(False)).alias("clash"))
