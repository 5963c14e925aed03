"""Small convex fits: conditional softmax by Newton steps, weighted ridge from normal equations."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors


def fit_softmax(x: np.ndarray, y: np.ndarray, lam: float, tolerance: float = 1e-8, most_steps: int = 100) -> np.ndarray:
    """Coefficients of a conditional softmax: free intercepts (the first is 0), then one shared slope a feature.

    x: (events, buckets, features), y: the winning bucket from 0. Minimises the
    mean negative log-likelihood plus lam/2 times the slopes' squared length.
    Raises if the gradient does not vanish.
    """
    n, k, p = x.shape
    design = np.concatenate([np.broadcast_to(np.eye(k)[:, 1:], (n, k, k - 1)), x], axis=2)
    penalty = np.concatenate([np.full(k - 1, 1e-9), np.full(p, lam)])
    theta = np.zeros(k - 1 + p)

    def loss_at(t):
        s = design @ t
        high = s.max(axis=1, keepdims=True)
        logs = s - high - np.log(np.exp(s - high).sum(axis=1, keepdims=True))
        return -logs[np.arange(n), y].mean() + 0.5 * (penalty * t * t).sum(), np.exp(logs)

    loss, prob = loss_at(theta)
    for _ in range(most_steps):
        mean = np.einsum("nk,nkd->nd", prob, design)
        gradient = (mean - design[np.arange(n), y]).mean(axis=0) + penalty * theta
        if np.abs(gradient).max() <= tolerance:
            return theta
        second = np.einsum("nk,nkd,nke->de", prob, design, design) / n - mean.T @ mean / n + np.diag(penalty)
        step, scale = np.linalg.lstsq(second, gradient, rcond=None)[0], 1.0
        while scale > 1e-10:
            trial = theta - scale * step
            trial_loss, trial_prob = loss_at(trial)
            if trial_loss <= loss + 1e-15:
                break
            scale /= 2
        theta, loss, prob = trial, trial_loss, trial_prob
    raise RuntimeError("the fit has not converged")


def predict_softmax(theta: np.ndarray, x: np.ndarray) -> np.ndarray:
    k = x.shape[1]
    s = np.concatenate([[0.0], theta[: k - 1]]) + x @ theta[k - 1 :]
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def hourly_outcomes(events: DataFrame) -> tuple[DataFrame, int]:
    """(day, hour, outcome, by_value, by_mean) and the number of outcomes: the type with the most events in each hour.

    The features of an hour are the logs of the types' clipped shares in its
    values, and in their mean values.
    """
    types = [r["event_type"] for r in events.select("event_type").distinct().orderBy("event_type").collect()]  # the outcomes, a handful
    of = lambda t, c: F.when(F.col("event_type") == t, c)
    several = lambda f: F.array(*[f(t) for t in types])
    counts = events.groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(
        several(lambda t: F.count(of(t, F.lit(1))).cast("double")).alias("counts"),
        several(lambda t: F.coalesce(F.sum(of(t, F.col("value"))), F.lit(0.0))).alias("sums"),
        several(lambda t: F.coalesce(F.avg(of(t, F.col("value"))), F.lit(0.0))).alias("means"),
    )
    rows = counts.where(vectors.total(F.col("counts")) > 0)
    shares = lambda c: vectors.logs(F.transform(c, lambda x: x + 1.0))
    return rows.select("day", "hour", (vectors.first_argmax(F.col("counts")) - 1).alias("outcome"), shares("sums").alias("by_value"), shares("means").alias("by_mean")), len(types)


@dataclass(frozen=True)
class Fold:
    """A fit of a model (features: array columns) on the days before ``train_until``, to be scored on the days from ``test_from`` to before ``test_until``."""

    model: str
    features: tuple[str, ...]
    lam: float
    train_until: dt.date
    test_from: dt.date
    test_until: dt.date


def _design(batch: pa.RecordBatch, features: tuple[str, ...]) -> np.ndarray:
    """(rows, buckets, free intercepts and features)."""
    columns = [batch.column(f) for f in features]
    x = np.stack([c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) for c in columns], axis=2)
    return np.concatenate([np.broadcast_to(np.eye(x.shape[1])[:, 1:], (len(x), x.shape[1], x.shape[1] - 1)), x], axis=2)


def _statistics(folds: list[tuple[int, Fold, np.ndarray]], day: str, outcome: str):
    """The function that sums, over a task's rows, what a Newton step needs at each fold's coefficients: rows, loss, gradient, second derivatives."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            days, y = batch.column(day).to_numpy(zero_copy_only=False).astype("datetime64[D]"), batch.column(outcome).to_numpy()
            designs = {f.features: _design(batch, f.features) for _, f, _ in folds}
            for at, fold, theta in folds:
                mine = np.flatnonzero(days < np.datetime64(fold.train_until))
                if not len(mine):
                    continue
                x, z = designs[fold.features][mine], y[mine]
                s = x @ theta
                high = s.max(axis=1, keepdims=True)
                logs = s - high - np.log(np.exp(s - high).sum(axis=1, keepdims=True))
                p = np.exp(logs)
                mean = np.einsum("nk,nkd->nd", p, x)
                hit = x[np.arange(len(z)), z]
                second = np.einsum("nk,nkd,nke->de", p, x, x) - mean.T @ mean
                found = np.concatenate([[len(z), -logs[np.arange(len(z)), z].sum()], (mean - hit).sum(axis=0), second.ravel()])
                sums[at] = sums[at] + found if at in sums else found
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([sums[k].tolist() for k in keys], pa.list_(pa.float64()))], names=["fold", "sums"])

    return run


def fit_folds(rows: DataFrame, day: str, outcome: str, folds: list[Fold], buckets: int, tolerance: float = 1e-8, most_steps: int = 100) -> list[np.ndarray]:
    """The coefficients of ``fit_softmax`` for every fold, all fitted at once.

    A step is one aggregation: tasks sum gradients and second derivatives of
    their rows for all folds that are still on their way, and the driver, which
    reads one row a fold, solves the small systems. No fold copies its history.
    A fold without rows, or one that does not converge, is an error.
    """
    columns = [day, outcome, *sorted({f for fold in folds for f in fold.features})]
    table = rows.select(*columns).persist()
    try:
        sizes = [buckets - 1 + len(f.features) for f in folds]
        penalty = [np.concatenate([np.full(buckets - 1, 1e-9), np.full(len(f.features), f.lam)]) for f in folds]
        theta = [np.zeros(n) for n in sizes]
        trial, state, scale = list(theta), [None] * len(folds), [1.0] * len(folds)
        going = set(range(len(folds)))
        for _ in range(most_steps):
            work = [(i, folds[i], trial[i]) for i in sorted(going)]
            widest = 2 + max(sizes[i] + sizes[i] ** 2 for i in going)
            summed = table.mapInArrow(_statistics(work, day, outcome), "fold int, sums array<double>").groupBy("fold").agg(*[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(widest)])
            found = {r["fold"]: np.array(r[1:], dtype=np.float64) for r in summed.collect()}
            for i in sorted(going):
                if i not in found:
                    raise ValueError(f"no rows before {folds[i].train_until}")
                p, n = sizes[i], found[i][0]
                loss = found[i][1] / n + 0.5 * (penalty[i] * trial[i] ** 2).sum()
                if state[i] is not None and loss > state[i][0] + 1e-15:  # too far: half the step
                    scale[i] /= 2
                    if scale[i] < 1e-10:
                        raise RuntimeError("a fit has not converged")
                else:
                    theta[i], scale[i] = trial[i], 1.0
                    gradient = found[i][2 : 2 + p] / n + penalty[i] * theta[i]
                    second = found[i][2 + p : 2 + p + p * p].reshape(p, p) / n + np.diag(penalty[i])
                    state[i] = (loss, np.linalg.lstsq(second, gradient, rcond=None)[0])
                    if np.abs(gradient).max() <= tolerance:
                        going.discard(i)
                        continue
                trial[i] = theta[i] - scale[i] * state[i][1]
            if not going:
                return theta
        raise RuntimeError("a fit has not converged")
    finally:
        table.unpersist()


def score_folds(rows: DataFrame, day: str, outcome: str, folds: list[Fold], thetas: list[np.ndarray]) -> DataFrame:
    """(day, model, lam, events, log_loss, brier, top1) of every fold's test days: means over the day's events."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            days, y = batch.column(day).to_numpy(zero_copy_only=False).astype("datetime64[D]"), batch.column(outcome).to_numpy()
            for fold, theta in zip(folds, thetas, strict=True):
                mine = np.flatnonzero((days >= np.datetime64(fold.test_from)) & (days < np.datetime64(fold.test_until)))
                if not len(mine):
                    continue
                s = _design(batch, fold.features)[mine] @ theta
                p = np.exp(s - s.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                safe = np.clip(p, vectors.FLOOR, 1 - vectors.FLOOR)
                safe /= safe.sum(axis=1, keepdims=True)
                at = np.arange(len(mine)), y[mine]
                hits = np.zeros_like(p)
                hits[at] = 1
                values = [-np.log(safe[at]), ((p - hits) ** 2).sum(axis=1), (p.argmax(axis=1) == y[mine]).astype(float)]
                columns = [pa.array(days[mine].astype("datetime64[D]")), pa.array([fold.model] * len(mine)), pa.array(np.full(len(mine), fold.lam)), *map(pa.array, values)]
                yield pa.RecordBatch.from_arrays(columns, names=["day", "model", "lam", "loss", "brier", "hit"])

    each = rows.select(day, outcome, *sorted({f for fold in folds for f in fold.features})).mapInArrow(run, "day date, model string, lam double, loss double, brier double, hit double")
    return each.groupBy("day", "model", "lam").agg(F.count("*").alias("events"), F.avg("loss").alias("log_loss"), F.avg("brier").alias("brier"), F.avg("hit").alias("top1"))


def rolling_origin(rows: DataFrame, models: dict[str, tuple[str, ...]], lams: list[float], least_days: int, buckets: int, day: str = "day", outcome: str = "outcome") -> DataFrame:
    """(day, model, lam, events, log_loss, brier, top1): each day after the first ``least_days`` scored by fits on all days before it.

    models: the array columns that each uses. All days, models and penalties are
    fitted together; the driver holds the calendar's days and one small fit a
    fold. Fewer days give no rows.
    """
    days = [r[0] for r in rows.select(day).distinct().orderBy(day).collect()]
    folds = [Fold(m, tuple(features), lam, d, d, d + dt.timedelta(days=1)) for d in days[least_days:] for m, features in models.items() for lam in lams]
    if not folds:
        return rows.sparkSession.createDataFrame([], "day date, model string, lam double, events long, log_loss double, brier double, top1 double")
    return score_folds(rows, day, outcome, folds, fit_folds(rows, day, outcome, folds, buckets))


def frozen_evaluation(rows: DataFrame, models: dict[str, tuple[str, ...]], lams: dict[str, float], first_test: dt.date, buckets: int, day: str = "day", outcome: str = "outcome") -> DataFrame:
    """The scores of ``score_folds`` on the days from ``first_test``: each model fitted once, on the days before, with its frozen penalty."""
    folds = [Fold(m, tuple(features), lams[m], first_test, first_test, dt.date.max) for m, features in models.items()]
    return score_folds(rows, day, outcome, folds, fit_folds(rows, day, outcome, folds, buckets))


def choose_lambda(scores: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """(model, lam, log_loss): of each model (if scores tell them apart) the greatest penalty whose mean loss is within ``tolerance`` of the least."""
    keys = [c for c in ("model",) if c in scores.columns]
    means = scores.groupBy(*keys, "lam").agg(F.avg("log_loss").alias("log_loss"))
    least = means.groupBy(*keys).agg(F.min("log_loss").alias("_least"))
    near = (means.join(least, keys) if keys else means.crossJoin(F.broadcast(least))).where(F.col("log_loss") <= F.col("_least") + tolerance)
    best = near.groupBy(*keys).agg(F.max(F.struct("lam", "log_loss")).alias("_best"))
    return best.where("_best is not null").select(*keys, "_best.lam", "_best.log_loss")


def normal_equations(rows: DataFrame, features: list[str], target: str, weight: str) -> tuple[np.ndarray, np.ndarray]:
    """X'WX and X'Wy with an intercept first, from one aggregation."""
    terms = [F.lit(1.0), *[F.col(c) for c in features]]
    w, y, k = F.col(weight), F.col(target), len(features) + 1
    sums = [F.sum(w * terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(w * t * y).alias(f"b{i}") for i, t in enumerate(terms)]
    row = rows.agg(*sums).first()
    a, b = np.zeros((k, k)), np.zeros(k)
    for i in range(k):
        b[i] = row[f"b{i}"]
        for j in range(i, k):
            a[i, j] = a[j, i] = row[f"a{i}_{j}"]
    return a, b


def fit_ridge(rows: DataFrame, features: list[str], target: str, weight: str, alpha: float) -> np.ndarray:
    """Intercept and slopes of a weighted ridge regression; the intercept has no penalty."""
    a, b = normal_equations(rows, features, target, weight)
    return np.linalg.solve(a + alpha * np.diag([0.0, *[1.0] * len(features)]), b)
