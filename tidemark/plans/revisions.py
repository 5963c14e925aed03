"""Forecast revisions against market moves: pairs, alignment, projections, placebo, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import aggregates, asof, windows

KEYS = ["city", "event_date_local"]


def pairs(states: DataFrame) -> DataFrame:
    """Consecutive usable states of a city-day in order of publication, with the revision of mean and spread."""
    usable = states.where("usable")
    out = windows.consecutive_pairs(usable, KEYS, ["published_at", "state_label"], ["published_at", "state_label", "mu", "sigma"])
    next_publication = windows.consecutive_pairs(usable, KEYS, ["published_at", "state_label"], ["state_label"]).select(*KEYS, F.col("old_state_label").alias("state_label"), F.col("published_at").alias("next_published_at"))
    changed = (F.col("mu") != F.col("old_mu")) | (F.col("sigma") != F.col("old_sigma"))
    return out.join(next_publication, [*KEYS, "state_label"], "left").withColumns({"delta_mu": F.col("mu") - F.col("old_mu"), "changed": changed})


def aligned(revisions: DataFrame, complete: DataFrame, after_hours: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Revisions with the complete snapshots around them.

    complete: (city, event_date_local, timestamp_utc). pre: strictly before the
    publication, at most 60 minutes old; post: at or after each target, at most
    60 minutes late, and strictly before the next publication.
    """
    out = asof.asof(revisions, complete, KEYS, "published_at", "timestamp_utc", ["timestamp_utc"], strict=True).withColumnRenamed("asof_timestamp_utc", "pre_utc")
    out = out.withColumn("pre_ok", asof.stale_before(F.col("published_at"), F.col("pre_utc")))
    for h in after_hours:
        target = f"target_{h}h"
        out = out.withColumn(target, F.col("published_at") + F.make_dt_interval(F.lit(0), F.lit(h)))
        out = asof.asof(out, complete, KEYS, target, "timestamp_utc", ["timestamp_utc"], direction="forward").withColumnRenamed("asof_timestamp_utc", f"post_{h}h_utc")
        before_next = F.coalesce(F.col(f"post_{h}h_utc") < F.col("next_published_at"), F.col("next_published_at").isNull())
        out = out.withColumn(f"post_{h}h_ok", asof.stale_after(F.col(target), F.col(f"post_{h}h_utc")) & before_next)
    return out


def projection(delta_q: Column, delta_p: Column) -> list[Column]:
    """Numerator and denominator of the slope of market moves on forecast moves."""
    return [vectors.dot(delta_q, delta_p).alias("numerator"), vectors.dot(delta_q, delta_q).alias("denominator")]


def market_reaction(events: DataFrame, normalise: bool = True) -> DataFrame:
    """events(keys, q_old, q_new, p_pre, p_post) with numerator and denominator; q normalised or as it is."""
    q = (lambda c: vectors.normalised(F.col(c))) if normalise else F.col
    delta_q = vectors.difference(q("q_new"), q("q_old"))
    delta_p = vectors.difference(vectors.normalised(F.col("p_post")), vectors.normalised(F.col("p_pre")))
    return events.withColumns({"delta_q": delta_q, "delta_p": delta_p}).select("*", *projection(F.col("delta_q"), F.col("delta_p")))


def residual_assimilation(events: DataFrame) -> DataFrame:
    """The market's later move on what the forecast's move left open: (q_new - p_pre) against (p_post - p_pre)."""
    gap = vectors.difference(F.col("q_new"), vectors.normalised(F.col("p_pre")))
    move = vectors.difference(vectors.normalised(F.col("p_post")), vectors.normalised(F.col("p_pre")))
    return events.withColumns({"gap": gap, "move": move}).select("*", *projection(F.col("gap"), F.col("move")))


def date_contributions(scored: DataFrame, date: str = "event_date_local") -> DataFrame:
    return scored.groupBy(date).agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"), F.count("*").alias("n"))


def study_calendar(contributions: DataFrame, first: Column, last: Column, date: str = "event_date_local") -> DataFrame:
    """Every study date, zeros where nothing contributes."""
    days = contributions.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias(date))
    return days.join(contributions, date, "left").na.fill(0)


def beta(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return aggregates.ratio_of_sums(scored, keys or [], "numerator", "denominator")


def placebo_times(revisions: DataFrame, complete: DataFrame, minutes: int = 60) -> DataFrame:
    """Revisions whose exact time ``minutes`` before the pre snapshot is itself a complete snapshot."""
    shifted = revisions.withColumn("placebo_utc", F.col("pre_utc") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))
    there = complete.select(*KEYS, F.col("timestamp_utc").alias("placebo_utc")).distinct()
    return shifted.join(there, [*KEYS, "placebo_utc"], "left_semi")


#: The three snapshots of an event, in order.
SNAPSHOTS = ("pre", "post1", "post2")


def snapshot_audit(events: DataFrame, quotes: DataFrame, keys: list[str], member: str, label: str, time: str, size: int = 6, filled: str = "midpoint_close", tolerance: float = 1e-6) -> DataFrame:
    """One row: how many events break each rule of their three snapshots, recomputed from times and quotes alone, and whether none does.

    events: keys, old_publication, new_publication, next_publication (null if
    none), and pre, post1, post2 with post1_target, post2_target, and the stored
    pre_staleness, post1_lateness, post2_lateness in minutes; quotes: keys,
    member, label, time, ``filled``, is_pre_close. A snapshot is ``size`` rows of as
    many members, all filled; the three have the same members under the same
    labels, before the close. Null breaks a rule.
    """
    minutes = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / 60e6
    near = lambda a, b: F.abs(a - b) <= tolerance
    before_next = lambda c: F.col("next_publication").isNull() | (F.col(c) < F.col("next_publication"))
    numbered = events.withColumn("_event", F.sha2(F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"}), 256))
    taken = F.explode(F.array(*[F.struct(F.lit(s).alias("which"), F.col(s).alias(time)) for s in SNAPSHOTS])).alias("s")
    long = numbered.dropDuplicates(["_event"]).select("_event", *keys, taken).select("_event", *keys, "s.*")
    named = F.sort_array(F.collect_list(F.struct(member, label)))
    seen = long.join(quotes, [*keys, time], "left").groupBy("_event", "which").agg(
        F.count(member).alias("n"), F.countDistinct(member).alias("members"), F.count(filled).alias("filled"),
        F.sort_array(F.collect_list(member)).alias("set"), named.alias("map"), F.bool_and(F.coalesce("is_pre_close", F.lit(False))).alias("open"),
    )
    whole = (F.col("n") == size) & (F.col("members") == size) & (F.col("filled") == size)
    each = seen.groupBy("_event").agg(F.count_if(whole).alias("whole"), F.count_distinct("set").alias("sets"), F.count_distinct("map").alias("maps"), F.bool_and("open").alias("open"))
    c = F.col
    rules = {
        "pre_not_after_publication": c("pre") <= c("new_publication"), "pre_not_before_old": c("pre") >= c("old_publication"), "in_order": (c("pre") < c("post1")) & (c("post1") < c("post2")),
        "post1_after_publication": c("post1") > c("new_publication"), "post2_after_publication": c("post2") > c("new_publication"), "post1_before_next": before_next("post1"), "post2_before_next": before_next("post2"),
        "pre_staleness_matches": near(minutes("new_publication", "pre"), c("pre_staleness")), "post1_lateness_matches": near(minutes("post1", "post1_target"), c("post1_lateness")), "post2_lateness_matches": near(minutes("post2", "post2_target"), c("post2_lateness")),
        "whole_snapshots": c("whole") == len(SNAPSHOTS), "same_members": c("sets") == 1, "same_labels": c("maps") == 1, "before_close": c("open"),
    }
    checked = numbered.join(each, "_event", "left")
    counts = checked.agg(F.count("*").alias("events"), *[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    return counts.withColumn("passed", sum((c(n) for n in rules), F.lit(0)) == 0)
