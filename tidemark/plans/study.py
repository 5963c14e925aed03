"""Threshold study: ladders, sealed days, health, endpoint; and point-in-time audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markets
from ..operators import ladder, sets, windows

#: Limits of a healthy day of 960 slots (fixed values).
SLOTS, LEAST_NORMAL, MOST_INVALID, MOST_CONSECUTIVE = 960, 951, 9, 2


def question(text: Column) -> Column:
    """struct(date, threshold) of a question such as "… on June 5, 2026 exceed 71 °F …"; null unless both are there."""
    date = F.try_to_date(F.regexp_extract(text, r"on ([A-Z][a-z]+ \d{1,2}, \d{4})", 1), "MMMM d, yyyy")
    threshold = F.nullif(F.regexp_extract(text, r"(?:exceed|above|over) (-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("decimal(18,9)")
    return F.when(date.isNotNull() & threshold.isNotNull(), F.struct(date.alias("date"), threshold.alias("threshold")))


def event_question(text: Column, station: Column) -> Column:
    """struct(date, threshold, problem) of a contract's question about a station's daily high; closed unless all of it is there."""
    found = question(text)
    lower = F.lower(F.trim(text))
    # The texts of the problems.
    problem = (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", "missing contract question")
        .when(~(F.contains(lower, F.lit("highest temperature")) & F.contains(lower, F.lit("exceed"))), "unexpected question predicate")
        .when(~F.coalesce(F.contains(lower, F.lower(station)), F.lit(False)), "question does not identify expected station")
        .when(found.isNull(), "question date/threshold could not be parsed")
    )
    return F.struct(F.when(problem.isNull(), found["date"]).alias("date"), F.when(problem.isNull(), found["threshold"]).alias("threshold"), problem.alias("problem"))


#: The bounds of a pair snapshot in seconds, and the first moment that a broker's clock can name (milliseconds).
MOST_ELAPSED, OLD_AGE, MOST_FUTURE, OLD_SKEW, FIRST_BROKER_MS = 5.0, 60.0, 1.0, 5.0, 946_684_800_000


def pair_snapshot(payload: Column, first: Column, second: Column, elapsed: Column, received: Column) -> Column:
    """struct(failure_class, reason, rows, skew, skew_is_old) of one request for both legs of a pair.

    payload: array<struct<conid, availability, updated, ask, ask_size>>; received:
    epoch seconds. What is wrong with the response itself comes first, on either
    leg, and is a structural_failure; an ask or a size that can't be taken is
    quote_unavailable. Age and skew are reported, not judged.
    """
    expected = F.array(first, second)
    leg = lambda conid: F.get(F.filter(payload, lambda x: x["conid"] == conid), F.lit(0))
    legs = [(first, leg(first)), (second, leg(second))]
    seconds = lambda x: x["updated"].cast("double") / 1000
    bad = lambda c: F.coalesce(c, F.lit(True))
    # The texts of the reasons.
    rules = [
        ("request elapsed outside frozen bound", bad(~elapsed.between(0, MOST_ELAPSED))), ("invalid response received epoch", bad(~((received > 0) & (received < float("inf"))))),
        ("pair response must contain exactly two rows", bad(F.size(payload) != 2)), ("invalid quote row/conid", bad(F.exists(payload, lambda x: x["conid"].isNull()))),
        ("duplicate conid in pair response", F.size(F.array_distinct(F.transform(payload, lambda x: x["conid"]))) < F.size(payload)), ("unexpected conid in pair response", F.exists(payload, lambda x: ~F.array_contains(expected, x["conid"]))),
    ]
    for _, x in legs:
        rules += [("non-real-time delivery", bad(markets.availability(x["availability"])["delivery"] != "real_time")), ("missing/invalid broker _updated", x["updated"].isNull()), ("broker _updated epoch is invalid", bad(x["updated"] < FIRST_BROKER_MS)), ("broker _updated timestamp is implausibly future", bad(received - seconds(x) < -MOST_FUTURE))]
    structural = markets.first_reason(rules)
    ask, size = (lambda x: markets.displayed_number(x["ask"])), (lambda x: markets.displayed_number(x["ask_size"], grouped=True))
    whole = lambda x: (size(x) > 0) & (size(x) == F.floor(size(x)))
    faults = [(conid, F.when(bad(~((ask(x) > 0) & (ask(x) < 1))), "ask").when(bad(~whole(x)), "ask_size")) for conid, x in legs]
    unavailable = F.array_join(F.array_compact(F.array(*[F.when(f.isNotNull(), F.concat(conid.cast("string"), F.lit(":"), f)) for conid, f in faults])), "; ")
    failure = F.when(structural.isNotNull(), "structural_failure").when(unavailable != "", "quote_unavailable")
    skew = F.abs(seconds(legs[0][1]) - seconds(legs[1][1]))
    rows = F.array(*[F.struct(conid.alias("conid"), ask(x).alias("ask"), size(x).cast("long").alias("ask_size"), (received - seconds(x)).alias("age"), (received - seconds(x) > OLD_AGE).alias("is_old")) for conid, x in legs])
    fine = lambda c: F.when(failure.isNull(), c)
    return F.struct(failure.alias("failure_class"), F.coalesce(structural, F.nullif(unavailable, F.lit(""))).alias("reason"), fine(rows).alias("rows"), fine(skew).alias("skew"), fine(skew > OLD_SKEW).alias("skew_is_old"))


def adjacent_pairs(contracts: DataFrame) -> DataFrame:
    """Adjacent thresholds of each city and date whose rules are all the same: contracts(city, date, threshold, side, conid, rules_hash)."""
    keys = ["city", "date"]
    same = ladder.uniform(contracts, keys, "rules_hash")
    strikes = ladder.complements(contracts.join(same, keys, "left_semi"), [*keys, "threshold"], "side", "conid")
    out = ladder.adjacent(strikes, keys, "threshold", ["y_conid", "n_conid"])
    return out.withColumn("pair_id", F.concat_ws("|", "city", F.col("threshold").cast("string"), F.col("y_conid").cast("string"), F.col("next_n_conid").cast("string")))


def pair_problems(structure_ok: Column, first_ask: Column, second_ask: Column) -> Column:
    """A pair's first problem: its structure comes before the quotes."""
    return F.when(~F.coalesce(structure_ok, F.lit(False)), "STRUCTURE").when(first_ask.isNull(), "FIRST_ASK_MISSING").when(second_ask.isNull(), "SECOND_ASK_MISSING")


def day_health(slots: DataFrame) -> DataFrame:
    """(date, normal, invalid, longest_invalid, healthy) of slot_health(date, slot, valid); slots that are absent are invalid."""
    dates = slots.select("date").distinct()
    grid = dates.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    filled = grid.join(slots.dropDuplicates(["date", "slot"]), ["date", "slot"], "left").withColumn("bad", ~F.coalesce("valid", F.lit(False)))
    counts = filled.groupBy("date").agg(F.count_if(~F.col("bad")).alias("normal"), F.count_if("bad").alias("invalid"))
    runs = windows.longest_true_run(filled, ["date"], ["slot"], "bad").withColumnRenamed("longest", "longest_invalid")
    ok = (F.col("normal") >= LEAST_NORMAL) & (F.col("invalid") <= MOST_INVALID) & (F.col("longest_invalid") <= MOST_CONSECUTIVE)
    return counts.join(runs, "date").withColumn("healthy", ok)


def date_ledger(first: str, count: int, spark) -> DataFrame:
    """Every planned date, pending; it stays in the denominator."""
    days = F.sequence(F.lit(first).cast("date"), F.date_add(F.lit(first).cast("date"), count - 1))
    return spark.range(1).select(F.explode(days).alias("date"), F.lit("PENDING").alias("status"))


def first_candidates(observations: DataFrame) -> DataFrame:
    """Each city-day's first confirmed pair with a positive margin: slot, then threshold, then conid."""
    confirmed = ladder.confirmed(observations, ["city", "date", "pair_id"], "slot", "received_at", F.col("valid") & (F.col("margin") > 0))
    return windows.first_qualifying(confirmed, ["city", "date"], F.lit(True), [F.col("slot"), F.col("threshold"), F.col("y_conid")])


def endpoint(ledger: DataFrame, candidates: DataFrame, aborted: DataFrame) -> DataFrame:
    """(date, hit): 1 where any city has a candidate; aborted and empty dates are 0 and count."""
    hits = candidates.select("date").distinct().join(aborted.select("date"), "date", "left_anti").withColumn("hit", F.lit(1))
    return ledger.select("date").join(hits, "date", "left").na.fill(0, ["hit"])


def coverage(slots: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(problem, rows): expected keys that are missing, unknown keys, repeated keys of a sealed day."""
    lost, odd = sets.missing(expected, slots, keys), sets.missing(slots.select(*keys).distinct(), expected, keys)
    twice = slots.groupBy(*keys).count().where("count > 1").select(*keys)
    tagged = [d.agg(F.count("*").alias("rows")).select(F.lit(n).alias("problem"), "rows") for d, n in ((lost, "MISSING"), (odd, "UNKNOWN"), (twice, "REPEATED"))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def point_in_time_audit(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: how many rows break each rule (null breaks it), and whether none does.

    Typical rules: snapshot at or before the decision, cycle published by the
    decision, probabilities that sum to 1, six contiguous buckets.
    """
    counts = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    total = sum((F.col(n) for n in rules), F.lit(0))
    return counts.withColumn("passed", total == 0)


def label_ready(effective: Column, received: Column, ready: Column, cutoff: Column) -> Column:
    """Whether a label may be used: effective, received and ready by the cutoff."""
    return F.coalesce((effective <= cutoff) & (received <= cutoff) & (ready <= cutoff), F.lit(False))


def publication_census(days: DataFrame, heads: DataFrame) -> DataFrame:
    """(keys, margin_minutes, violation): whether each day's cycle was public by its decision: heads(cycle, last_modified)."""
    margin = (F.unix_micros("decision_time_utc") - F.unix_micros("last_modified")) / 60e6
    return days.join(heads, "cycle", "left").withColumns({"margin_minutes": margin, "violation": F.coalesce(margin < 0, F.lit(True))})


#: What a day's health may say.
DATE_STATUSES = ["VALID", "ABORTED_RETAIN_IN_DENOMINATOR", "STUDY_BLOCKER"]


def health_record(text: Column, event_date: Column, protocol: Column) -> Column:
    """struct(value struct(date_status, study_blocker, body), reason) of a day-health file's text: one of the two is null.

    A record that can't be read does not fail the scan but says why: missing,
    malformed, not an object, of another protocol or date, or with a status of
    the wrong type or unknown. A readable blocker of the right protocol and date
    counts before faults of the status.
    """
    body = F.try_parse_json(text)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(body, path, "variant"))
    field = lambda name: F.when(kind(f"$.{name}") == "STRING", F.try_variant_get(body, f"$.{name}", "string"))
    blocker, status = field("study_blocker"), field("date_status")
    absent = F.coalesce(kind("$.study_blocker"), F.lit("VOID")) == "VOID"
    # The texts of the reasons.
    reason = (
        F.when(text.isNull(), "missing day_health_summary.json")
        .when(body.isNull(), "malformed JSON")
        .when(~F.startswith(F.schema_of_variant(body), F.lit("OBJECT")), "day_health_summary.json must contain a JSON object")
        .when(~F.coalesce(field("protocol_id") == protocol, F.lit(False)), "day health protocol_id mismatch")
        .when(~F.coalesce(field("event_date") == event_date.cast("string"), F.lit(False)), "day health event_date mismatch")
        .when(~absent & blocker.isNull(), "day health study_blocker must be a string when present")
        .when(~absent & (blocker != ""), None)
        .when(status.isNull(), "day health date_status must be a string")
        .when(~status.isin(DATE_STATUSES), F.concat(F.lit("unknown day health date_status: "), status))
    )
    value = F.when(reason.isNull(), F.struct(status.alias("date_status"), F.nullif(blocker, F.lit("")).alias("study_blocker"), F.to_json(body).alias("body")))
    return F.struct(value.alias("value"), reason.alias("reason"))
