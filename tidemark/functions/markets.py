"""Prices, fees, costs and labels of event contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean "no value" in captured feeds (fixed values).
SENTINELS = ["", "M", "NA", "N/A", "None", "null", "--", "-"]


def midpoint(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def spread(bid: Column, ask: Column) -> Column:
    return ask - bid


def outcome(result: Column) -> Column:
    """yes/no in any case and spacing as 1/0; anything else is null."""
    text = F.lower(F.trim(result))
    return F.when(text == "yes", 1).when(text == "no", 0)


def parsed_bool(text: Column) -> Column:
    """true and 1 are true; everything else, null included, is false."""
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("true", "1"), F.lit(False))


def parsed_number(text: Column) -> Column:
    """A number, thousands separators allowed; sentinels and other texts are null."""
    trimmed = F.trim(text)
    plain = F.regexp_replace(trimmed, ",", "")
    return F.when(~trimmed.isin(SENTINELS) & F.rlike(plain, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), plain.try_cast("double"))


#: Captured texts that hold nothing.
ABSENT = ["", "-", "--", "None", "null"]


def present(value: Column) -> Column:
    """Whether a captured field holds anything."""
    return F.coalesce(~F.trim(value.cast("string")).isin(ABSENT), F.lit(False))


def field_presence(names: list[str]) -> Column:
    return F.create_map(*[x for n in names for x in (F.lit(n), present(F.col(n)))])


def first_non_empty(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def bucket(label: Column) -> Column:
    """struct(lower, upper) of a temperature range label: "<=a", "a to b", ">=b" in words; both null if unreadable."""
    text = F.regexp_replace(F.lower(label), r"°\s*f?", "")
    low = F.regexp_extract(text, r"^\s*(-?\d+)\s*(?:or below|or less|or lower)", 1)
    high = F.regexp_extract(text, r"^\s*(-?\d+)\s*(?:or above|or more|or higher)", 1)
    a, b = (F.regexp_extract(text, r"^\s*(-?\d+)\s*(?:to|-|–)\s*(-?\d+)\s*$", k) for k in (1, 2))
    number = lambda c: F.nullif(c, F.lit("")).cast("double")
    return F.struct(F.coalesce(number(high), number(a)).alias("lower"), F.coalesce(number(low), number(b)).alias("upper"))


def event_date(ticker: Column) -> Column:
    """The date in a ticker's ``-yyMMMdd`` ending, or null."""
    part = F.regexp_extract(ticker, r"-(\d{2}[A-Z]{3}\d{2})$", 1)
    named = F.concat(F.substring(part, 1, 2), F.initcap(F.substring(part, 3, 3)), F.substring(part, 6, 2))
    return F.when(part != "", F.try_to_date(named, "yyMMMdd"))


def taker_fee(price: Column) -> Column:
    """Fee of one contract: 7 % of p(1 - p), rounded up to a cent (a hair below counts as the cent)."""
    return F.ceil(0.07 * price * (1 - price) * 100 - 1e-12) / 100


def yes_value(q: Column, ask: Column) -> Column:
    """Expected net value of buying YES at the ask."""
    return q - ask - taker_fee(ask)


def no_value(q: Column, bid: Column) -> Column:
    """Expected net value of buying NO at one minus the bid."""
    price = 1 - bid
    return (1 - q) - price - taker_fee(price)


def stressed_pnl(payoff: Column, price: Column, adverse: float) -> Column:
    """Profit when the price is worse by ``adverse``, at most 1, with its own fee."""
    worse = F.least(price + adverse, F.lit(1.0))
    return payoff - worse - taker_fee(worse)


def conservative_cost(first_asks: list[Column], second_asks: list[Column], fee: str, ticks: str, funding: str, years: Column) -> Column:
    """Decimal cost of a two-legged position, rounded up to a cent: the dearer ask of each leg, fees, ticks, funding."""
    dec = lambda x: (F.lit(x) if isinstance(x, str) else x).cast("decimal(18,9)")
    legs = F.greatest(*map(dec, first_asks)) + F.greatest(*map(dec, second_asks))
    total = legs + dec(fee) + dec(ticks) + dec(funding) * dec(years)
    return (F.ceil(total * 100) / F.lit(100)).cast("decimal(18,2)")


#: The first two characters of a market-data code.
DELIVERY = {"R": "real_time", "D": "delayed", "Z": "frozen", "Y": "frozen_delayed", "N": "not_subscribed", "i": "incomplete", "v": "vdr_exempt"}
MODE = {"P": "snapshot", "p": "consolidated"}


def availability(code: Column) -> Column:
    """struct(delivery, mode, book) of a market-data code such as RPB; other characters are unknown, missing ones null."""

    def meaning(place: int, known: dict[str, str]) -> Column:
        char = F.nullif(F.substring(code, place, 1), F.lit(""))
        named = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
        return F.coalesce(F.try_element_at(named, char), F.concat(F.lit("unknown:"), char))

    return F.struct(meaning(1, DELIVERY).alias("delivery"), meaning(2, MODE).alias("mode"), (F.substring(code, 3, 1) == "B").alias("book"))


def rule_source(*texts: Column) -> Column:
    """Which weather service a contract's rules name."""
    text = F.lower(F.concat_ws(" ", *texts))
    return (
        F.when(F.contains(text, F.lit("weather company")) | F.contains(text, F.lit("weather.com")) | F.contains(text, F.lit("wunderground")), "TWC")
        .when(F.contains(text, F.lit("national weather service")) | F.contains(text, F.lit("weather.gov")), "NWS")
        .otherwise("UNKNOWN")
    )


def reasons(rules: list[tuple[str, Column]]) -> Column:
    """The names of the rules that are true, in order; null counts as not true."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))


def first_reason(rules: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The name of the first rule that is true."""
    return reduce(lambda rest, r: F.when(r[1], F.lit(r[0])).otherwise(rest), reversed(rules), F.lit(otherwise).cast("string"))


def displayed_number(text: Column, grouped: bool = False) -> Column:
    """A number as a broker displays it; null if it is absent (empty, - or --), no number or not finite. grouped: commas part its digits."""
    plain = F.trim(text.cast("string"))
    number = (F.replace(plain, F.lit(","), F.lit("")) if grouped else plain).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


#: Why a quote is no executable ask.
QUOTE_REASONS = ["not_real_time", "ask_field_not_present", "ask_size_field_not_present", "invalid_or_missing_ask", "invalid_or_missing_ask_size"]


def quote_problems(delivery: Column, ask_present: Column, size_present: Column, ask: Column, size: Column) -> Column:
    """Which of QUOTE_REASONS hold, in order; an empty array if the ask can be taken.

    The presence flags say whether the broker sent the field; the number itself
    is judged beside that, so an absent ask has two reasons.
    """
    unless = lambda c: F.coalesce(~c, F.lit(True))
    price, count = displayed_number(ask), displayed_number(size, grouped=True)
    rules = [unless(delivery == "real_time"), unless(ask_present), unless(size_present), unless((price > 0) & (price < 1)), unless(count > 0)]
    return reasons(list(zip(QUOTE_REASONS, rules, strict=True)))


def margin_status(side: Column, q_low: Column, q_high: Column, ask: Column, cost: Column) -> Column:
    """struct(margin, status) of a screened quote with bounds on its probability."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    margin = F.when(side == "Y", clip(q_low) - ask - cost).otherwise((1 - clip(q_high)) - ask - cost)
    status = F.when(margin.isNull(), "INSUFFICIENT").when(margin > 0, "POSITIVE").otherwise("NOT_POSITIVE")
    return F.struct(margin.alias("margin"), status.alias("status"))


def pair_id(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def close_to(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def canonical_hash(value: Column) -> Column:
    """SHA-256 of a struct's compact JSON; the caller orders the fields by name."""
    return F.sha2(F.to_json(value, {"ignoreNullFields": "false"}), 256)
