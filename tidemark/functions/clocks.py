"""Clocks: zones, grids, observation labels, schedules, seasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: Column) -> Column:
    """ISO text or epoch seconds as a UTC timestamp; unreadable is null. A text without a zone is UTC."""
    trimmed = F.trim(text.cast("string"))
    return F.when(F.rlike(trimmed, F.lit(r"^\d{9,11}(\.\d+)?$")), F.timestamp_seconds(trimmed.try_cast("double"))).otherwise(trimmed.try_cast("timestamp"))


def local_to_utc(date: Column, hour: int, zone: Column) -> Column:
    """The UTC instant of a wall-clock hour on a local date."""
    return F.to_utc_timestamp(F.to_timestamp(date) + F.make_dt_interval(F.lit(0), F.lit(hour)), zone)


def day_grid(date: Column, zone: Column, minutes: int = 30) -> Column:
    """UTC instants of a local day, ``minutes`` apart: 48 half-hours, 46 or 50 when clocks change."""
    start, end = F.to_utc_timestamp(F.to_timestamp(date), zone), F.to_utc_timestamp(F.to_timestamp(F.date_add(date, 1)), zone)
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    return F.sequence(start, end - step, step)


def metar_candidates(label: Column, day: Column) -> Column:
    """UTC instants that a DDHHMM label can mean in the months around a date."""
    digits = F.regexp_extract(label, r"(\d{6})Z", 1)
    months = F.array(*[F.add_months(F.trunc(day, "month"), k) for k in (-1, 0, 1)])
    times = F.transform(months, lambda m: F.try_to_timestamp(F.concat(F.date_format(m, "yyyy-MM-"), F.substring(digits, 1, 2), F.lit(" "), F.substring(digits, 3, 2), F.lit(":"), F.substring(digits, 5, 2)), F.lit("yyyy-MM-dd HH:mm")))
    return F.filter(times, lambda t: t.isNotNull())


def metar_issue(label: Column, local_time: Column, zone: Column) -> Column:
    """The one candidate whose local time is the stated one; null if none or several are."""
    found = F.filter(metar_candidates(label, F.to_date(local_time)), lambda t: F.from_utc_timestamp(t, zone) == local_time)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def metar_nearest(label: Column, reference: Column, days: int = 45) -> Column:
    """The candidate nearest to a reference time, at most ``days`` away."""
    gap = lambda t: F.abs(F.unix_micros(t) - F.unix_micros(reference))
    ranked = F.array_sort(F.transform(metar_candidates(label, F.to_date(reference)), lambda t: F.struct(gap(t).alias("gap"), t.alias("t"))))
    best = F.get(ranked, F.lit(0))
    return F.when(best["gap"] <= days * 86_400_000_000, best["t"])


def schedule_open(intervals: Column, minute: Column) -> Column:
    """Whether a minute of the day lies in one of array<struct<open, close>> of "h:mm AM" texts, closing excluded; an interval may cross midnight."""
    as_minute = lambda c: F.hour(F.try_to_timestamp(c, F.lit("h:mm a"))) * 60 + F.minute(F.try_to_timestamp(c, F.lit("h:mm a")))

    def inside(x: Column) -> Column:
        a, b = as_minute(x["open"]), as_minute(x["close"])
        return F.when(a < b, (minute >= a) & (minute < b)).otherwise((minute >= a) | (minute < b))

    return F.coalesce(F.exists(intervals, inside), F.lit(False))


def schedule_status(timezone: Column, entries: Column, now: Column) -> Column:
    """struct(open, problem) of a venue at a UTC instant; problem says why it does not count as open.

    entries: array<struct<day_of_week, trading_times: array<struct<open, close>>>>
    with times such as "8:30 AM". Exactly one entry must name the local weekday.
    An interval holds its opening and not its closing; one that closes before it
    opens ends the day after. A day's entry says nothing of the hours after its
    midnight, which the next day's does.
    """
    local = F.from_utc_timestamp(now, timezone)
    rows = F.filter(entries, lambda e: e["day_of_week"] == F.date_format(local, "EEEE"))
    times = F.get(rows, F.lit(0))["trading_times"]
    minute = lambda text: F.hour(F.try_to_timestamp(F.trim(text), F.lit("h:mm a"))) * 60 + F.minute(F.try_to_timestamp(F.trim(text), F.lit("h:mm a")))
    blank = lambda text: text.isNull() | (text == "")
    at = F.hour(local) * 60 + F.minute(local)
    inside = lambda x: (minute(x["open"]) <= at) & ((at < minute(x["close"])) | (minute(x["close"]) < minute(x["open"])))
    # The texts of the problems.
    problem = (
        F.when(blank(timezone) | entries.isNull(), "schedule missing timezone/trading_schedules")
        .when(F.size(rows) != 1, "schedule missing/ambiguous weekday row")
        .when(F.coalesce(F.size(times), F.lit(0)) <= 0, "no trading intervals")
        .when(F.exists(times, lambda x: blank(x["open"]) | blank(x["close"])), "malformed trading interval")
        .when(F.exists(times, lambda x: minute(x["open"]).isNull() | minute(x["close"]).isNull()), "unparseable trading interval")
        .when(~F.exists(times, inside), "market schedule closed")
    )
    return F.struct(problem.isNull().alias("open"), problem.alias("problem"))


def season(minute: Column, date: Column) -> list[Column]:
    """Sine and cosine of the time of day and of the day of the year (leap years have their own length)."""
    year = F.datediff(F.make_date(F.year(date) + 1, F.lit(1), F.lit(1)), F.make_date(F.year(date), F.lit(1), F.lit(1)))
    day, turn = 2 * F.pi() * (F.dayofyear(date) - 1) / year, 2 * F.pi() * minute / 1440
    return [F.sin(turn).alias("sin_minute"), F.cos(turn).alias("cos_minute"), F.sin(day).alias("sin_day"), F.cos(day).alias("cos_day")]


def day_block(minute: Column) -> Column:
    """The six-hour block of a minute of the day: 00-06, 06-12, 12-18 or 18-24."""
    block = F.floor(minute / 360)
    return F.format_string("%02d-%02d", (block * 6).cast("int"), (block * 6 + 6).cast("int"))


def q_bin(q: Column) -> Column:
    """Label of the bin of width 0.05 in [0.05, 0.95], the top one closed; null outside."""
    k = F.least(F.floor((q - 0.05) / 0.05 + 1e-9), F.lit(17))
    return F.when((q >= 0.05) & (q <= 0.95), F.format_string("[%.2f,%.2f)", 0.05 + 0.05 * k, 0.10 + 0.05 * k))


def latest_cycle(decision: Column, hours: list[int], lag_hours: float, back_days: int = 1) -> Column:
    """The latest forecast cycle whose time plus lag is not after the decision."""
    days = F.sequence(F.lit(0), F.lit(back_days))
    cycles = F.flatten(F.transform(days, lambda d: F.transform(F.array(*[F.lit(h) for h in hours]), lambda h: F.date_trunc("day", decision) - F.make_dt_interval(d) + F.make_dt_interval(F.lit(0), h))))
    lag = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(lag_hours * 60)))
    return F.array_max(F.filter(cycles, lambda c: c + lag <= decision))
