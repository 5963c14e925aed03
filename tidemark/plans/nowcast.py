"""Intraday nowcast: canonical observations, state grids, location-scale model, scores, screen."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..expect import ExpectationError
from ..functions import clocks, markets
from ..operators import aggregates, asof, distributions, versions, windows
from . import fits


def canonical(observations: DataFrame) -> DataFrame:
    """One row for each station and instant: (station, utc, temperature_f).

    Null temperatures go. Two temperatures of one instant are an error. Of equal
    ones the least (observation_key, metar) stays.
    """
    rows = observations.where("temperature_f is not null and utc is not null")
    if rows.groupBy("station", "utc").agg(F.min("temperature_f").alias("a"), F.max("temperature_f").alias("b")).where("a <> b").head(1):
        raise ExpectationError("conflicting temperatures at one instant")
    return windows.first_qualifying(rows, ["station", "utc"], F.lit(True), [F.col("observation_key"), F.col("metar")])


def state_grid(days: DataFrame, observations: DataFrame, minutes: int = 30) -> DataFrame:
    """States of each local day on a UTC grid from what was observed by then.

    days: (station, event_date, timezone, final_max_f). Each state has the last
    temperature and its age, the running maximum of the day, the change over 60
    minutes and the rise still to come (residual).
    """
    grid = days.select("station", "event_date", "final_max_f", F.explode(clocks.day_grid(F.col("event_date"), F.col("timezone"), minutes)).alias("utc"))
    zones = days.select("station", "timezone").distinct()
    dated = observations.join(zones, "station").withColumn("event_date", F.to_date(F.from_utc_timestamp("utc", F.col("timezone")))).select("station", "event_date", "utc", "temperature_f")
    stamped = dated.withColumn("observed_at", F.col("utc"))
    now = asof.asof(grid, stamped, ["station", "event_date"], "utc", "utc", ["temperature_f", "observed_at"]).withColumnsRenamed({"asof_temperature_f": "temperature_f", "asof_observed_at": "observed_at"})
    now = now.withColumn("hour_ago", F.col("utc") - F.expr("interval 60 minutes"))
    then = asof.asof(now, stamped, ["station", "event_date"], "hour_ago", "utc", ["temperature_f"]).withColumnRenamed("asof_temperature_f", "temperature_60_ago")
    peaks = windows.on_grid(grid, dated, ["station", "event_date"], "utc", "temperature_f").select("station", "event_date", "utc", "running_max")
    out = then.join(peaks, ["station", "event_date", "utc"]).drop("hour_ago")
    age = (F.unix_micros("utc") - F.unix_micros("observed_at")) / 60e6
    return out.withColumns({"age_minutes": age, "change_60": F.col("temperature_f") - F.col("temperature_60_ago"), "residual": F.col("final_max_f") - F.col("running_max"), "available": F.col("running_max").isNotNull()})


#: The least scale, what is added before the logarithm, and the central intervals that are scored.
LEAST_SCALE, LOG_OFFSET, LEVELS = 0.25, 0.5, (0.5, 0.8, 0.9)


@dataclass
class LocationScale:
    """Ridge fits of the residual's mean and log absolute deviation on standardised features, and the calibration's z.

    z is a table (z, w) of any size: what is read off its distribution is exact.
    quantiles has z at 0.5 and at the ends of the central intervals.
    """

    features: list[str]
    centre: np.ndarray
    scale: np.ndarray
    location: np.ndarray
    log_scale: np.ndarray
    z: DataFrame | None = None
    quantiles: dict[float, float] = field(default_factory=dict)

    def columns(self) -> tuple[Column, Column]:
        """mu and sigma (at least LEAST_SCALE) as expressions."""
        x = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(self.features, self.centre, self.scale, strict=True)]
        line = lambda b: sum((float(k) * v for k, v in zip(b[1:], x, strict=True)), F.lit(float(b[0])))
        return line(self.location), F.greatest(F.exp(line(self.log_scale)), F.lit(LEAST_SCALE))


def ends(level: float) -> tuple[float, float]:
    """The probabilities at the ends of a central interval."""
    return (1 - level) / 2, 1 - (1 - level) / 2


def fit_location_scale(train: DataFrame, calibrate: DataFrame, features: list[str], target: str, date: str, alpha: float = 1.0) -> LocationScale:
    """Every date weighs the same. A feature that does not vary is an error."""
    rows = aggregates.balanced_weights(train, date, "w")
    centre, scale = map(np.array, aggregates.centre_and_scale(rows, features, "w"))
    named = [f"x{i}" for i in range(len(features))]
    standard = rows.withColumns({n: (F.col(c) - float(m)) / float(s) for n, c, m, s in zip(named, features, centre, scale, strict=True)})
    location = fits.fit_ridge(standard, named, target, "w", alpha)
    fitted = sum((float(k) * F.col(n) for k, n in zip(location[1:], named, strict=True)), F.lit(float(location[0])))
    spread = standard.withColumn("log_abs", F.ln(F.abs(F.col(target) - fitted) + LOG_OFFSET))
    model = LocationScale(features, centre, scale, location, fits.fit_ridge(spread, named, "log_abs", "w", alpha))
    mu, sigma = model.columns()
    model.z = aggregates.balanced_weights(calibrate, date, "w").select(((F.col(target) - mu) / sigma).alias("z"), "w").where("z is not null")
    run = aggregates.cumulative(model.z, [], "z", F.col("w"))
    wanted = sorted({0.5, *(e for level in LEVELS for e in ends(level))})
    # A hair below, as the running sums of the weights are rounded.
    row = run.agg(*[F.min(F.when(F.col("below") >= q * F.col("total") - 1e-12, F.col("z"))).alias(str(i)) for i, q in enumerate(wanted)]).first()
    model.quantiles = {q: row[str(i)] for i, q in enumerate(wanted)}
    return model


def scored(states: DataFrame, model: LocationScale, target: str) -> DataFrame:
    """States with mu, sigma, the predictive median and its absolute error, the PIT and CRPS of the target, and of each central interval the ends, width and whether it holds the target."""
    mu, sigma = model.columns()
    rows = states.withColumns({"mu": mu, "sigma": sigma}).withColumn("z", (F.col(target) - F.col("mu")) / F.col("sigma"))
    rows = distributions.crps(rows, "z", model.z, [], "z", "w", F.col("sigma")).withColumnRenamed("cdf", "pit").drop("survival", "mean_distance")
    at = lambda q: F.col("mu") + F.col("sigma") * model.quantiles[q]
    rows = rows.withColumn("median", at(0.5)).withColumn("median_error", F.abs(F.col(target) - F.col("median")))
    for level in LEVELS:
        name, (low, high) = int(level * 100), ends(level)
        rows = rows.withColumns({f"low_{name}": at(low), f"high_{name}": at(high)})
        rows = rows.withColumns({f"in_{name}": F.col(target).between(F.col(f"low_{name}"), F.col(f"high_{name}")), f"width_{name}": F.col(f"high_{name}") - F.col(f"low_{name}")})
    return rows


def metric_summary(rows: DataFrame, date: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, dates, states, and means over scored rows in which every date of the group weighs the same).

    crps, median_error, PIT mean, variance, ks and decile masses (an array), and
    each interval's coverage and mean width.
    """
    keys = keys or []
    counts = rows.groupBy(*keys, date).agg(F.count("*").alias("_n"))
    weighed = aggregates.join_groups(rows, counts, [*keys, date]).withColumn("w", F.lit(1.0) / F.col("_n"))
    mean = lambda c: F.sum(c * F.col("w")) / F.sum("w")
    decile = F.least(F.floor(F.col("pit") * 10), F.lit(9))
    means = weighed.groupBy(*keys).agg(
        F.countDistinct(date).alias("dates"), F.count("*").alias("states"), mean(F.col("crps")).alias("crps"), mean(F.col("median_error")).alias("median_error"),
        F.array(*[mean(F.when(decile == k, 1.0).otherwise(0.0)) for k in range(10)]).alias("pit_deciles"),
        *[c for x in (int(level * 100) for level in LEVELS) for c in (mean(F.col(f"in_{x}").cast("double")).alias(f"coverage_{x}"), mean(F.col(f"width_{x}")).alias(f"width_{x}"))],
    )
    pit = aggregates.pit_summary(weighed, "pit", "w", keys).withColumnsRenamed({"mean": "pit_mean", "variance": "pit_variance", "ks": "pit_ks"})
    return aggregates.join_groups(means, pit, keys)


def probability_above(states: DataFrame, model: LocationScale, threshold: str, running_max: str) -> DataFrame:
    """states with mu, sigma, delta and q, the probability that the final maximum is above the threshold.

    delta is the threshold over the running maximum; q is P(rise > delta) of the
    calibration's distribution, strictly above.
    """
    mu, sigma = model.columns()
    rows = states.withColumns({"mu": mu, "sigma": sigma, "delta": F.col(threshold) - F.col(running_max)})
    rows = rows.withColumn("_cut", (F.col("delta") - F.col("mu")) / F.col("sigma"))
    found = distributions.looked_up(rows, "_cut", model.z, [], "z", "w")
    return found.withColumn("q", distributions.survival()).drop("_cut", "upto_w", "upto_wz", "total_w", "total_wz")


def q_bin(q: Column, low: float = 0.05, high: float = 0.95, width: float = 0.05) -> Column:
    """The bin of a probability, such as 0.10-0.15; the last is closed; null outside."""
    last = round((high - low) / width) - 1
    k = F.when(F.abs(q - high) <= 1e-9 * high, last).otherwise(F.floor((q - low) / width))
    edge = lambda i: F.format_number(F.round(low + i * width, 10), 2)
    return F.when(q.between(low, high), F.concat(edge(k), F.lit("-"), edge(k + 1)))


def model_features(states: DataFrame, date: str, minute: str) -> DataFrame:
    """states of versions.state_at with the model's features: clock and season on circles, the state, and the change with a flag where it is missing."""
    circles = dict(zip(("sin_clock", "cos_clock", "sin_day", "cos_day"), clocks.season(F.col(minute), F.col(date)), strict=True))
    named = circles | {"change_filled": F.coalesce("change", F.lit(0.0)), "change_missing": F.col("change").isNull().cast("double")}
    return states.withColumns(named)


#: The features of model_features, in the model's order.
FEATURES = ["sin_clock", "cos_clock", "sin_day", "cos_day", "running_max", "below_max", "age_minutes", "change_filled", "change_missing"]
#: Those that have support ranges, and the names that reasons give them (fixed values).
RANGED = {"running_max": "running_max_f", "below_max": "temp_minus_running_max_f", "age_minutes": "observation_age_minutes", "change": "temp_change_60m_f"}
#: The frozen limits of support.
POLICY = {"age": 90.0, "dates": 45, "delta": (-10.0, 20.0), "q": (0.05, 0.95)}


def support_problems(cell: Column, calibration: Column, policy: dict | None = None) -> Column:
    """Why a state with q and delta is outside the frozen support, in order; an empty array if it is inside.

    cell: the struct of the state's month and block (aggregates.support_cells
    over RANGED with trend="change"), calibration: that of its block and q_bin;
    null if there is none. A missing change needs a cell that has seen enough
    dates without one.
    """
    p = POLICY | (policy or {})
    failed = lambda c: ~F.coalesce(c["supported"], F.lit(False))
    outside = lambda c: (F.col(c) < cell[f"{c}_q01"]) | (F.col(c) > cell[f"{c}_q99"])
    rules = [
        ("state_support_cell_missing_or_failed", failed(cell)),
        ("observation_age_exceeds_frozen_limit", F.col("age_minutes") > p["age"]),
        ("temp_change_missing_without_frozen_support", cell.isNotNull() & F.col("change").isNull() & (F.coalesce(cell["missing_trend_dates"], F.lit(0)) < p["dates"])),
        *[(f"{name}_outside_frozen_q01_q99", outside(c)) for c, name in RANGED.items()],
        ("threshold_delta_outside_frozen_range", ~F.col("delta").between(*p["delta"])),
        ("q_hat_outside_frozen_range", ~F.col("q").between(*p["q"])),
        ("calibration_cell_missing_or_failed", failed(calibration)),
    ]
    return markets.reasons(rules)


def threshold_rows(rows: DataFrame, model: LocationScale, target: str, deltas: range = range(-10, 21)) -> DataFrame:
    """Scored rows once for each whole delta, with q, its bin and hit (whether the target is above delta); bins outside go."""
    each = rows.withColumn("delta", F.explode(F.array(*[F.lit(float(d)) for d in deltas]))).withColumn("_cut", (F.col("delta") - F.col("mu")) / F.col("sigma"))
    found = distributions.looked_up(each, "_cut", model.z, [], "z", "w").withColumn("q", distributions.survival())
    found = found.withColumns({"q_bin": q_bin(F.col("q")), "hit": (F.col(target) > F.col("delta")).cast("double")})
    return found.where("q_bin is not null").drop("_cut", "upto_w", "upto_wz", "total_w", "total_wz")


#: What the screen says of a quote.
STATUSES = ["NO_VALID_EXECUTABLE_ASK", "MODEL_DATA_INSUFFICIENT", "APPARENT_POSITIVE_CONSERVATIVE_MARGIN_GATE3_REQUIRED", "NONPOSITIVE_CONSERVATIVE_MARGIN"]
NO_STATE = "no_point_in_time_weather_state_received_by_quote_time"


def screen(quotes: DataFrame, observations: DataFrame, model: LocationScale, state_cells: DataFrame, calibration: DataFrame, cost: float, zone: str, policy: dict | None = None) -> DataFrame:
    """Each quote with its quality, the state known at it, q, its support, slack, bounds, margin and status.

    quotes: station, event_date, received_at (UTC), threshold, side, delivery,
    ask_present, size_present, ask, ask_size; observations: station, event_date,
    issue, received, temperature; state_cells by (month, block), calibration by
    (block, q_bin) with slack. The first fault decides: no executable ask, then no
    state or no support, then the sign of the margin: the side's least
    probability less the ask and the cost.
    """
    local = F.from_utc_timestamp("received_at", zone)
    judged = quotes.withColumn("quote_problems", markets.quote_problems(*[F.col(c) for c in ("delivery", "ask_present", "size_present", "ask", "ask_size")]))
    judged = judged.withColumns({"ask": markets.displayed_number(F.col("ask")), "ask_size": markets.displayed_number(F.col("ask_size"), grouped=True)})
    known = versions.state_at(judged, observations, ["station", "event_date"], "received_at", "issue", "received", "temperature", F.col("event_date"), F.to_date(local))
    if known.where("clash").head(1):
        raise ExpectationError("several temperatures of one issue and receipt")
    known = known.drop("clash").withColumns({"minute": F.when(F.col("known") > 0, F.hour(local) * 60 + F.minute(local)), "month": F.month("event_date")})
    rows = probability_above(model_features(known, "event_date", "minute"), model, "threshold", "running_max")
    rows = rows.withColumns({"block": clocks.day_block(F.col("minute")), "q_bin": q_bin(F.col("q"))})
    cells = state_cells.select("month", "block", F.struct(*[c for c in state_cells.columns if c not in ("month", "block")]).alias("_cell"))
    slacks = calibration.select("block", "q_bin", F.struct("supported", "slack").alias("_calibration"))
    rows = rows.join(cells, ["month", "block"], "left").join(slacks, ["block", "q_bin"], "left")
    rows = rows.withColumn("support_problems", F.when(F.col("known") == 0, F.array(F.lit(NO_STATE))).otherwise(support_problems(F.col("_cell"), F.col("_calibration"), policy)))
    fine = F.when(F.size("quote_problems") > 0, STATUSES[0]).when(F.size("support_problems") > 0, STATUSES[1])
    rows = rows.withColumn("status", fine).withColumn("slack", F.when(F.coalesce(F.col("_calibration.supported"), F.lit(False)), F.col("_calibration.slack"))).drop("_cell", "_calibration")
    rows = rows.withColumns({"q_low": F.when(F.col("status").isNull(), F.greatest(F.col("q") - F.col("slack"), F.lit(0.0))), "q_high": F.when(F.col("status").isNull(), F.least(F.col("q") + F.col("slack"), F.lit(1.0)))})
    sure = F.when(F.upper("side") == "Y", F.col("q_low")).when(F.upper("side") == "N", 1 - F.col("q_high"))
    rows = rows.withColumn("margin", sure - F.col("ask") - F.lit(cost))
    return rows.withColumn("status", F.coalesce("status", F.when(F.col("margin") > 0, STATUSES[2]).otherwise(STATUSES[3])))


def screen_summary(screened: DataFrame) -> DataFrame:
    """One row: quotes, the counts of STATUSES, supported ones and their least and greatest margin by side."""
    side, margin = F.upper("side"), F.col("margin")
    return screened.agg(
        F.count("*").alias("quotes"), *[F.count_if(F.col("status") == s).alias(n) for n, s in zip(("invalid", "insufficient", "positive", "nonpositive"), STATUSES, strict=True)],
        F.min("margin").alias("least_margin"), F.max("margin").alias("greatest_margin"),
        *[c for x in "YN" for c in (F.count(F.when(side == x, margin)).alias(f"{x}_supported"), F.count_if((side == x) & (margin > 0)).alias(f"{x}_positive"), F.max(F.when(side == x, margin)).alias(f"{x}_greatest"))],
    )
