"""Scores of the market's own probabilities: events, summaries, block-bootstrap intervals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..expect import ExpectationError
from ..functions import vectors
from . import bootstrap

#: The blocks of days that are drawn, in the order in which they share one generator.
BLOCKS = (1, 3, 7)


def event_scores(events: DataFrame, probs: str, outcome: str, tolerance: float = 1e-10) -> DataFrame:
    """events with winner_prob, log_loss, brier, top1, entropy and zero_winner.

    probs sum to 1 and outcome is a place from 1, or it is an error. Log loss,
    Brier score and entropy are of probabilities clipped to [1e-6, 1 - 1e-6] and
    normalised again; the winner's own and the first choice are of the raw ones.
    """
    p, y = F.col(probs), F.col(outcome)
    good = (F.abs(vectors.total(p) - 1) <= tolerance) & y.between(1, F.size(p))
    if events.where(~F.coalesce(good, F.lit(False))).head(1):
        raise ExpectationError("probabilities that do not sum to 1, or outcomes that are none of them")
    safe = vectors.normalised(F.transform(p, lambda x: F.least(F.greatest(x, F.lit(vectors.FLOOR)), F.lit(1 - vectors.FLOOR))))
    winner = F.element_at(p, y)
    scored = events.withColumn("_safe", safe)
    q = F.col("_safe")
    new = {
        "winner_prob": winner, "log_loss": -F.ln(F.element_at(q, y)), "brier": vectors.brier(q, y), "top1": (vectors.first_argmax(p) == y).cast("int"),
        "entropy": -vectors.total(F.transform(q, lambda x: x * F.ln(x))), "zero_winner": winner == 0,
    }
    return scored.withColumns(new).drop("_safe")


def summary(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, events, means of log_loss, brier, top1 and winner_prob, the median winner_prob, zero_winners)."""
    means = [F.avg(c).alias(c) for c in ("log_loss", "brier", "top1", "winner_prob")]
    return scored.groupBy(*(keys or [])).agg(F.count("*").alias("events"), *means, F.median("winner_prob").alias("median_winner_prob"), F.count_if("zero_winner").alias("zero_winners"))


def intervals(scored: DataFrame, date: str, reps: int, seed: int) -> DataFrame:
    """(block, metric, estimate, low, high): 95 % intervals of the dates' mean log_loss and brier.

    All events of a date stay together. One generator serves the blocks in turn,
    and in each first log_loss, then brier.
    """
    days = scored.groupBy(date).agg(F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier")).withColumn("_one", F.lit(1.0)).persist()
    try:
        n, rng, parts = days.count(), np.random.default_rng(seed), []
        for block in BLOCKS if n else ():
            for metric in ("log_loss", "brier"):
                size = min(block, n)
                values = bootstrap.replicates(days, date, metric, "_one", bootstrap.draw_starts(n, size, reps, rng), size, n)
                low, high = values.agg(F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))).first()[0]
                parts.append((block, metric, days.agg(F.avg(metric)).first()[0], low, high))
        return scored.sparkSession.createDataFrame(parts, "block int, metric string, estimate double, low double, high double")
    finally:
        days.unpersist()


def stale(scored: DataFrame, age: str = "snapshot_age_minutes") -> DataFrame:
    """Events whose snapshot is older than its decision."""
    return scored.where(F.col(age) > 0)
