"""Column expressions over captured records: strict numbers, codes, nested values, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clocks import local_to_utc


def strict_decimal(text: Column) -> Column:
    """An unsigned plain decimal as decimal(18,6); null for anything else (signs, exponents, blanks inside)."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"^\d{1,12}(\.\d{1,6})?$"), trimmed.cast("decimal(18,6)"))


def on_tick_ask(text: Column, tick: str = "0.01") -> Column:
    """An ask strictly between 0 and 1 on the tick; 0 and 1 say that there is none."""
    price = strict_decimal(text)
    return F.when((price > 0) & (price < 1) & (price % F.lit(tick).cast("decimal(18,6)") == 0), price)


def positive_size(text: Column) -> Column:
    """A whole size above 0, or null."""
    trimmed = F.trim(text)
    size = F.when(trimmed.rlike(r"^\d{1,18}$"), trimmed.cast("long"))
    return F.when(size > 0, size)


def unwrapped(payload: Column) -> Column:
    """The object under ``success.value`` of a JSON text, or the text where it has none."""
    inner = F.get_json_object(payload, "$.success.value")
    return F.when(inner.startswith("{"), inner).otherwise(payload)


def labels(text: Column) -> Column:
    """A JSON array of labels as strings; null if it is none."""
    return F.from_json(text, "array<string>")


def best_price(levels: Column, field: str = "price") -> Column:
    """The highest price of an array of levels; null if it has none."""
    return F.array_max(F.transform(levels, lambda x: x[field]))


def time_window(stamps: list[Column]) -> Column:
    """struct(first, last) over those of the times that are there."""
    found = F.array_compact(F.array(*stamps))
    return F.struct(F.array_min(found).alias("first"), F.array_max(found).alias("last"))


def next_midnight(day: Column) -> Column:
    """00:00 UTC of the next day, in a session in UTC."""
    return F.date_add(day, 1).cast("timestamp")


def session_bounds(day: Column, zone: Column, unlock_hours: int = 12) -> Column:
    """struct(opens, closes, unlocks): the local day's UTC bounds, and when its results may be read."""
    closes = local_to_utc(F.date_add(day, 1), 0, zone)
    return F.struct(local_to_utc(day, 0, zone).alias("opens"), closes.alias("closes"), (closes + F.expr(f"interval {unlock_hours} hours")).alias("unlocks"))


def cycle_name(stamp: Column) -> Column:
    """A model run's file key, as 20240131_06."""
    return F.date_format(stamp, "yyyyMMdd_HH")


def middle(values: Column) -> Column:
    """The element in the middle of an array; of an even number the later one."""
    return F.when(F.size(values) > 0, F.get(values, F.floor(F.size(values) / 2).cast("int")))


def split_of(day: Column, ranges: list[tuple[str, str, str]]) -> Column:
    """The name of the closed range (name, first, last) that holds the day; a day in none is an error."""
    out = F.raise_error(F.concat(F.lit("day outside of all splits: "), F.coalesce(day.cast("string"), F.lit("null")))).cast("string")
    for name, first, last in reversed(ranges):
        out = F.when(day.between(F.to_date(F.lit(first)), F.to_date(F.lit(last))), F.lit(name)).otherwise(out)
    return out


def order_chain(events: Column, time: str, label: str) -> Column:
    """Labels of an array of structs in order of a time, then label: ``a>b>c``."""
    ordered = F.array_sort(F.transform(events, lambda e: F.struct(e[time].alias("t"), e[label].cast("string").alias("l"))))
    return F.array_join(F.transform(ordered, lambda e: e["l"]), ">")


def allowed(value: Column, kind: T.DataType, names: set[str]) -> Column:
    """A nested value with only the fields named, at every depth."""
    if isinstance(kind, T.StructType):
        fields = [f for f in kind.fields if f.name in names]
        return F.when(value.isNotNull(), F.struct(*[allowed(value[f.name], f.dataType, names).alias(f.name) for f in fields])) if fields else F.lit(None).cast("string")
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: allowed(x, kind.elementType, names))
    return value
