"""Batch data sources over REST resources: ``spark.read.format("rest_pages")`` and ``"keyed_records"``.

A partition is one resource, or one request for keys and a day, and follows its
cursor to the end. The transport is a dotted name of ``get(path, params) -> (status, headers, body)``, so that
fixtures stand in for a network.
"""

from __future__ import annotations

import datetime as dt
import importlib
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Tries of one request, and the longest wait between them in seconds.
TRIES, LONGEST_WAIT = 8, 60


def transport(name: str):
    module, _, attribute = name.rpartition(".")
    return getattr(importlib.import_module(module), attribute)


def get_json(get, path: str, params: dict, sleep=time.sleep) -> dict:
    """A JSON body; a 429 waits for Retry-After or twice as long each time, any other error is final."""
    for attempt in range(TRIES):
        status, headers, body = get(path, params)
        if status == 200:
            return json.loads(body)
        if status != 429:
            raise OSError(f"{path}: HTTP {status}")
        sleep(float(headers.get("Retry-After") or min(2**attempt, LONGEST_WAIT)))
    raise OSError(f"{path}: still limited after {TRIES} tries")


def pages(get, path: str, params: dict, cursor: str = "cursor"):
    """Bodies of all pages, in order."""
    following = None
    while True:
        body = get_json(get, path, params | ({cursor: following} if following else {}))
        yield body
        following = body.get(cursor)
        if not following:
            return


class _Resource(InputPartition):
    def __init__(self, path: str, params: dict):
        super().__init__(path)
        self.path, self.params = path, params


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.get = options["transport"]
        self.resources = json.loads(options["resources"])

    def partitions(self):
        return [_Resource(r["path"], r.get("params", {})) for r in self.resources]

    def read(self, partition):
        for number, body in enumerate(pages(transport(self.get), partition.path, partition.params)):
            yield partition.path, number, json.dumps(body, sort_keys=True, separators=(",", ":"))


class RestPages(DataSource):
    """Options: transport, resources (JSON list of {path, params}). Rows: path, page, body."""

    @classmethod
    def name(cls):
        return "rest_pages"

    def schema(self):
        return "path string, page int, body string"

    def reader(self, schema):
        return _Reader(dict(self.options))


class _Request(InputPartition):
    def __init__(self, keys: list[str], day: dt.date | None):
        super().__init__((tuple(keys), day))
        self.keys, self.day = keys, day


class _KeyedReader(DataSourceReader):
    """Requests planned from the filters on key and day that reach the source; those stay no filters of Spark's."""

    def __init__(self, options: dict):
        self.options = options
        self.keys = json.loads(options["keys"]) if "keys" in options else None
        self.days = [dt.date.fromisoformat(options[n]) if n in options else None for n in ("first_day", "last_day")]

    def pushFilters(self, filters):
        for f in filters:
            column, value = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None, getattr(f, "value", None)
            if column == "key" and isinstance(f, (EqualTo, In)):
                asked = [value] if isinstance(f, EqualTo) else list(value)
                self.keys = [k for k in dict.fromkeys(asked) if k is not None and (self.keys is None or k in self.keys)]
            elif column == "day" and isinstance(value, dt.date) and isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan, LessThanOrEqual, LessThan)):
                first, last = self.days
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    least = value + dt.timedelta(days=isinstance(f, GreaterThan))
                    first = least if first is None else max(first, least)
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    most = value - dt.timedelta(days=isinstance(f, LessThan))
                    last = most if last is None else min(last, most)
                self.days = [first, last]
            else:
                yield f

    def partitions(self):
        if self.keys is None:
            raise ValueError("keys: an option, or a filter on key")
        daily, days = self.options.get("daily") == "true", [None]
        if daily:
            if None in self.days:
                raise ValueError("first and last day: options, or filters on day")
            days = [self.days[0] + dt.timedelta(days=i) for i in range((self.days[1] - self.days[0]).days + 1)]
        return [_Request(keys, day) for day in days for keys in batched(self.keys, int(self.options.get("size", 100)))] or [_Request([], None)]

    def read(self, partition):
        if not partition.keys:
            return
        params = json.loads(self.options.get("params", "{}")) | {self.options.get("key_param", "keys"): partition.keys}
        if partition.day is not None:
            params |= {"from": partition.day.isoformat(), "until": (partition.day + dt.timedelta(days=1)).isoformat()}
        wanted, found = set(partition.keys), {}
        for body in pages(transport(self.options["transport"]), self.options["path"], params):
            for record in body.get(self.options.get("records", "records"), []):
                if record.get(self.options.get("key_field", "key")) in wanted:
                    found.setdefault(record[self.options.get("key_field", "key")], []).append(record)
        for key in partition.keys:
            for number, record in enumerate(found.get(key, [])):
                yield key, partition.day, number, json.dumps(record, sort_keys=True, separators=(",", ":"))


class KeyedRecords(DataSource):
    """Records of a resource that is asked for keys, many a request, and for one local day (from, until, half-open) if ``daily``.

    Options: transport, path, keys (JSON list), size (keys a request), daily,
    first_day, last_day, params, key_param, records and key_field (names in the
    request and the body). Rows: key, day, number, body. Filters on key (=, in)
    and day (=, <, <=, >, >=) decide which requests are made, if the session
    pushes filters to Python sources (``spark.sql.python.filterPushdown.enabled``).
    """

    @classmethod
    def name(cls):
        return "keyed_records"

    def schema(self):
        return "key string, day date, number int, body string"

    def reader(self, schema):
        return _KeyedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (RestPages, KeyedRecords):
        spark.dataSource.register(source)


def batched(keys: list[str], size: int = 100) -> list[list[str]]:
    """Keys in groups of a request."""
    return [keys[i : i + size] for i in range(0, len(keys), size)]
