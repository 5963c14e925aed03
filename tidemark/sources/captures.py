"""Readers and writers of captured files: JSON folders, JSON lines, CSV, archives."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import schemas
from ..expect import ExpectationError
from ..functions import clocks, markets


def json_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a file of a folder tree; an empty folder is an error of the reader."""
    return spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)


def json_lines(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """One row a line; blank lines are skipped. Tolerant: malformed lines are left out, else they fail the read."""
    if not tolerant:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header, typed as declared; only the named columns are parsed."""
    rows = spark.read.schema(schema).option("header", "true").option("nanValue", "").option("mode", "FAILFAST").csv(path)
    return rows.select(*columns) if columns else rows


def latest_file(spark: SparkSession, path: str, pattern: str) -> str:
    """The greatest name of the files that match, as timestamped names sort by time."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).agg(F.max("path")).first()[0]
    if found is None:
        raise FileNotFoundError(f"no {pattern} in {path}")
    return found


def latest_value(rows: DataFrame, value: str, order: str) -> DataFrame:
    """One row: the last non-empty value in the order."""
    return rows.where(F.length(F.trim(value)) > 0).agg(F.max_by(value, order).alias(value))


def candles(files: DataFrame) -> DataFrame:
    """Candle files (schemas.CANDLE_FILE) as one typed row for each market and candle.

    Markets without candles give none; metadata joins by ticker. Numbers that
    can't be read are null; bid and ask make midpoint and spread only together.
    """
    number = lambda path: F.col(path).try_cast("double")
    meta = files.select("event_ticker", F.inline("market_metadata")).withColumnsRenamed({"ticker": "market_ticker"}).dropDuplicates(["event_ticker", "market_ticker"])
    rows = files.select("city", "series_ticker", "event_ticker", F.inline("candlestick_response.markets")).select("city", "series_ticker", "event_ticker", "market_ticker", F.explode("candlesticks").alias("c"))
    prices = [number(f"c.{side}.{k}_dollars").alias(f"{side}_{k}") for side in ("yes_bid", "yes_ask") for k in ("open", "high", "low", "close")]
    trades = [number(f"c.price.{k}_dollars").alias(f"trade_price_{k}") for k in ("open", "high", "low", "mean", "close", "previous")]
    typed = rows.select("city", "series_ticker", "event_ticker", "market_ticker", F.col("c.end_period_ts").alias("candle_end_ts"), *prices, *trades, number("c.volume_fp").alias("volume"), number("c.open_interest_fp").alias("open_interest"))
    joined = typed.join(meta, ["event_ticker", "market_ticker"], "left")
    close = clocks.parse_time(F.col("close_time"))
    return joined.withColumns(
        {
            "event_date_local": markets.event_date(F.col("event_ticker")),
            "timestamp_utc": F.timestamp_seconds("candle_end_ts"),
            "market_close_utc": close,
            "hours_to_close": (F.unix_micros(close) - F.col("candle_end_ts") * 1_000_000) / 3.6e9,
            "is_pre_close": F.timestamp_seconds("candle_end_ts") <= close,
            "outcome_yes": markets.outcome(F.col("result")),
            "midpoint_close": markets.midpoint(F.col("yes_bid_close"), F.col("yes_ask_close")),
            "spread_close": markets.spread(F.col("yes_bid_close"), F.col("yes_ask_close")),
        }
    )


def forecasts(files: DataFrame) -> DataFrame:
    """Forecast files (schemas.FORECAST_FILE) as one row for each valid time."""
    return files.select("retrieved_at", "station", "cycle", F.inline("data")).withColumns({"runtime": clocks.parse_time(F.col("runtime")), "ftime_utc": clocks.parse_time(F.col("ftime_utc"))})


def category_rows(tree: DataFrame, pattern: str) -> DataFrame:
    """Markets of a category tree (categories map<string,struct<name,parent_id,markets>>) whose names match, sorted."""
    rows = tree.select(F.explode("categories").alias("category_id", "c")).select("category_id", F.col("c.name").alias("category"), F.explode("c.markets").alias("m")).select("category_id", "category", "m.*")
    text = F.concat_ws("|", "name", "symbol", "category")
    return rows.where(F.rlike(text, F.lit(f"(?i){pattern}"))).orderBy("name", "symbol", "category_id")


def write_new(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write Parquet where nothing is yet; existing output is an error, not a target."""
    writer = rows.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def export_csv(rows: DataFrame, path: str) -> None:
    """A report of few rows as one CSV file."""
    rows.coalesce(1).write.mode("errorifexists").option("header", "true").csv(path)


def fingerprints(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of every file of a folder, contents archived as they are."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def archive_names(raw: DataFrame, content: str, suffix: str) -> DataFrame:
    """Payloads with their content-addressed name; equal payloads keep one row."""
    digest = F.sha2(F.col(content), 256)
    named = raw.withColumns({"sha256": digest, "name": F.concat(F.substring(digest, 1, 16), F.lit(suffix))})
    return named.dropDuplicates(["sha256"])


def check_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """manifest(name, sha256) with status OK, CHANGED or MISSING against files(path, sha256)."""
    here = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("_found"))
    return manifest.join(here, "name", "left").select("name", F.when(F.col("_found").isNull(), "MISSING").when(F.col("_found") == F.col("sha256"), "OK").otherwise("CHANGED").alias("status"))


def check_frozen(files: DataFrame, manifest: DataFrame, folder: str) -> DataFrame:
    """manifest(name, length, sha256) with status OK, UNSAFE, MISSING, SIZE or CHANGED against files(path, length, sha256) below a folder.

    Names are relative paths; one that is absolute, climbs out of the folder or
    is not in its plain form is UNSAFE and not looked up.
    """
    root = "/" + re.sub(r"^(?:\w+:/*|/+)", "", folder.rstrip("/"))
    here = files.select(F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), F.lit(f"^{re.escape(root)}/"), F.lit("")).alias("name"), F.col("length").alias("_length"), F.col("sha256").alias("_found"))
    parts = F.split("name", "/")
    unsafe = F.col("name").isNull() | F.exists(parts, lambda p: p.isin("", ".", "..")) | F.contains("name", F.lit("\\")) | F.rlike("name", F.lit(r"^\w+:"))
    status = F.when(unsafe, "UNSAFE").when(F.col("_found").isNull(), "MISSING").when(F.col("_length") != F.col("length"), "SIZE").when(F.col("_found") != F.col("sha256"), "CHANGED").otherwise("OK")
    return manifest.join(here, "name", "left").select("name", status.alias("status"))


def check_pdf(files: DataFrame, sha256: Column) -> DataFrame:
    """binaryFile rows(path, content) with status OK, NOT_PDF or CHANGED against the frozen hash."""
    digest = F.sha2("content", 256)
    status = F.when(F.substring("content", 1, 4) != F.lit(b"%PDF"), "NOT_PDF").when(digest != sha256, "CHANGED").otherwise("OK")
    return files.select("path", digest.alias("sha256"), status.alias("status"))


def require_unchanged(files: DataFrame, manifest: DataFrame) -> None:
    """Fail unless every file of the manifest is there as it was."""
    bad = check_manifest(files, manifest).where("status <> 'OK'").limit(5).collect()
    if bad:
        raise ExpectationError(f"frozen inputs differ: {[tuple(r) for r in bad]}")


def station_csv(rows: DataFrame, text: str, station: str, date: str) -> DataFrame:
    """Station reports from CSV text (station,valid,tmpf,metar), one row each, with the running maximum.

    A header without one of the columns, a wrong station or date, or a report
    whose METAR names another station anywhere fails the batch; sentinels are null.
    """
    header = F.split(F.trim(F.get(F.split(F.col(text), "\n"), F.lit(0))), ",")
    named = F.forall(F.array(*[F.lit(c) for c in ("station", "valid", "tmpf", "metar")]), lambda c: F.array_contains(header, c))
    rows = rows.where(F.when(F.coalesce(named, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("a required column is missing")).cast("boolean")))
    lines = rows.select("received_at", F.posexplode(F.split(F.col(text), "\n")).alias("line", "raw")).where("line > 0 and length(trim(raw)) > 0")
    parsed = lines.select("received_at", "line", F.from_csv("raw", F.lit("station string, valid string, tmpf string, metar string")).alias("r")).select("received_at", "line", "r.*")
    # The report's own station is its first token that is no word of the report's kind.
    token = F.regexp_extract("metar", r"^\s*(?:(?:METAR|SPECI|COR)\s+)*([A-Z0-9]{3,4})\b", 1)
    own = F.col("metar").isNull() | (token == "") | token.endswith(station)
    right = (F.col("station") == station) & F.startswith("valid", F.lit(date)) & own
    checked = parsed.where(F.when(F.coalesce(right, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("wrong station or date")).cast("boolean")))
    order = W.partitionBy("received_at").orderBy("valid", "line").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = checked.withColumns({"valid": F.to_timestamp("valid", "yyyy-MM-dd HH:mm"), "tmpf": markets.parsed_number(F.col("tmpf"))})
    return out.withColumn("running_max", F.max("tmpf").over(order))


def redacted(payload: DataFrame, column: str, pattern: str) -> DataFrame:
    """JSON text without keys that match, at any depth.

    Keys of unknown nesting have no schema; an Arrow-batched function walks each
    payload once.
    """
    drop = re.compile(pattern, re.I)

    def clean(x):
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if not drop.search(k)}
        return [clean(v) for v in x] if isinstance(x, list) else x

    @F.pandas_udf(StringType())
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else json.dumps(clean(json.loads(t)), sort_keys=True, separators=(",", ":"), ensure_ascii=False))

    return payload.withColumn(column, redact(column))
