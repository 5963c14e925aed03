"""Sources on small files, and the streams on files that arrive in turn."""

import datetime as dt
import json
from html.parser import HTMLParser
import os

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.sources import captures, html_table, rest
from tidemark.operators import census
from tidemark.streaming import jobs


def test_candles(spark, tmp_path):
    candle = {"end_period_ts": 1_780_300_800, "yes_bid": {"close_dollars": "0.40"}, "yes_ask": {"close_dollars": "0.44"}, "price": {"close_dollars": "bad"}, "volume_fp": "7"}
    event = {
        "event_ticker": "KXHIGHNY-26JUN01", "series_ticker": "KXHIGHNY", "city": "NY",
        "market_metadata": [{"ticker": "A", "yes_sub_title": "70° or below", "close_time": "2026-06-01T09:00:00Z", "result": "yes"}],
        "candlestick_response": {"markets": [{"market_ticker": "A", "candlesticks": [candle]}, {"market_ticker": "B"}]},
    }
    (tmp_path / "ny").mkdir()
    (tmp_path / "ny" / "e.json").write_text(json.dumps(event, indent=1))
    rows = captures.candles(captures.json_folder(spark, str(tmp_path), schemas.CANDLE_FILE)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (round(r["midpoint_close"], 9), round(r["spread_close"], 9), r["trade_price_close"], r["outcome_yes"], r["is_pre_close"], r["event_date_local"]) == (0.42, 0.04, None, 1, True, dt.date(2026, 6, 1))
    assert r["hours_to_close"] == 1.0


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1, "v": "x"}\n\n{"k": 2\n{"k": 3, "v": "z"}\n')
    assert captures.latest_value(captures.json_lines(spark, str(tmp_path), "k long, v string", tolerant=True), "v", "k").first()[0] == "z"
    with pytest.raises(Exception, match="(?i)malformed|corrupt|failfast"):
        captures.json_lines(spark, str(tmp_path), "k long, v string").collect()


def test_manifests_and_output_guard(spark, tmp_path):
    (tmp_path / "f-1.txt").write_text("one")
    (tmp_path / "f-2.txt").write_text("two")
    files = captures.fingerprints(spark, str(tmp_path), "*.txt")
    frozen = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256").collect()
    manifest = spark.createDataFrame([*map(tuple, frozen), ("gone.txt", "0")], "name string, sha256 string")
    captures.require_unchanged(files, manifest.where("name <> 'gone.txt'"))
    with pytest.raises(ValueError, match="MISSING"):
        captures.require_unchanged(files, manifest)
    assert captures.latest_file(spark, str(tmp_path), "f-*.txt").endswith("f-2.txt")
    captures.write_new(spark.range(3), f"{tmp_path}/out")
    with pytest.raises(Exception, match="(?i)exists"):
        captures.write_new(spark.range(3), f"{tmp_path}/out")


def test_station_csv(spark):
    good = "station,valid,tmpf,metar\nNYC,2026-06-01 10:00,70,x\nNYC,2026-06-01 11:00,M,y\nNYC,2026-06-01 12:00,68,z\n"
    rows = spark.createDataFrame([(1, good)], "received_at int, body string")
    assert [(r["tmpf"], r["running_max"]) for r in captures.station_csv(rows, "body", "NYC", "2026-06-01").orderBy("line").collect()] == [(70.0, 70.0), (None, 70.0), (68.0, 70.0)]
    bad = spark.createDataFrame([(1, good + "BOS,2026-06-01 13:00,60,w\n")], "received_at int, body string")
    with pytest.raises(Exception, match="wrong station or date"):
        captures.station_csv(bad, "body", "NYC", "2026-06-01").collect()


def test_redaction_and_archive(spark):
    rows = spark.createDataFrame([('{"a": 1, "token": 2, "n": [{"accountId": 3, "b": null}]}',), (None,)], "body string")
    assert [r[0] for r in captures.redacted(rows, "body", "token|account").collect()] == ['{"a":1,"n":[{"b":null}]}', None]
    twice = spark.createDataFrame([("x",), ("x",), ("y",)], "content string")
    assert captures.archive_names(twice, "content", ".json").count() == 2


PAGE = '<section data-results="observations"><h2>Daily Observations</h2><table><tr><th>Time</th><th>Temperature</th></tr><tr><td>1:00 AM</td><td>72 °F</td></tr></table></section>'


def test_observation_table(spark):
    assert html_table.observations(PAGE) == [{"time": "1:00 AM", "temperature": "72 °F"}]
    for bad in (PAGE.replace("°F", "°C"), PAGE.replace("</section>", "<table></table></section>"), "<p></p>"):
        with pytest.raises(ValueError):
            html_table.observations(bad)
    cells = html_table.cells(spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string"), "page_id", "html")
    assert [r["value"] for r in cells.orderBy("row_number", "cell_number").collect()] == ["Time", "Temperature", "1:00 AM", "72 °F"]


def fixture_get(path, params):
    """Two pages of one resource."""
    body = {"rows": [2]} if params.get("cursor") else {"rows": [1], "cursor": "next"}
    return 200, {}, json.dumps(body)


def test_rest_pages(spark):
    waits = []
    answers = iter([(429, {"Retry-After": "3"}, ""), (429, {}, ""), (200, {}, '{"ok": 1}')])
    assert rest.get_json(lambda p, q: next(answers), "/x", {}, waits.append) == {"ok": 1} and waits == [3.0, 2.0]
    with pytest.raises(OSError):
        rest.get_json(lambda p, q: (500, {}, ""), "/x", {})
    assert [b["rows"] for b in rest.pages(fixture_get, "/x", {})] == [[1], [2]]
    assert rest.batched(list("abcde"), 2) == [["a", "b"], ["c", "d"], ["e"]]


def stream_of(spark, path, schema, parts):
    path.mkdir()
    for k, rows in enumerate(parts):
        (path / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(path / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # the order of arrival
    return jobs.capture(spark, str(path), schema, files_per_trigger=1)


def drained(stream, name, spark, checkpoint):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def poll(slot, seconds, valid=True):
    return {"pair_id": "p", "slot": slot, "received_at": f"2026-06-01T10:{seconds // 60:02d}:{seconds % 60:02d}Z", "valid": valid}


def test_two_poll_confirmation(spark, tmp_path):
    parts = [[poll(1, 0)], [poll(2, 30)], [poll(3, 60, False), poll(4, 90)], [poll(6, 150)], [poll(7, 200)]]
    stream = stream_of(spark, tmp_path / "in", "pair_id string, slot long, received_at timestamp, valid boolean", parts)
    found = drained(jobs.two_poll_confirmation(stream), "polls", spark, tmp_path / "ck")
    assert sorted(found) == [("p", 1, "PENDING_FIRST"), ("p", 2, "CONFIRMED_TWO_POLL"), ("p", 3, "INVALID_RESET"), ("p", 4, "PENDING_FIRST"), ("p", 6, "RESET_NEW_FIRST"), ("p", 7, "RESET_NEW_FIRST")]


def test_deduplication_changes_and_gaps(spark, tmp_path):
    rows = [[{"source": "a", "received_at": f"2026-06-01T10:0{m}:00Z", "digest": d} for m, d in part] for part in ([(0, "x"), (1, "x")], [(2, "y")], [(3, "y"), (9, "x")])]
    schema = "source string, received_at timestamp, digest string"
    changed = drained(jobs.changed(stream_of(spark, tmp_path / "c", schema, rows)), "changed", spark, tmp_path / "k1")
    assert sorted(r[2] for r in changed) == ["x", "x", "y"]
    unique = drained(jobs.deduplicated(stream_of(spark, tmp_path / "d", schema, rows), ["source", "digest"], "received_at"), "once", spark, tmp_path / "k2")
    assert sorted(r[2] for r in unique) == ["x", "y"]
    starts = [[{"session_id": "s", "started_at": r["received_at"]} for r in part] for part in rows]
    gaps = drained(jobs.cadence_gaps(stream_of(spark, tmp_path / "g", "session_id string, started_at timestamp", starts), 60), "gaps", spark, tmp_path / "k3")
    assert [r[2] for r in gaps] == [360.0]


def test_raw_batches_are_stored_before_they_are_parsed(spark, tmp_path):
    stream = stream_of(spark, tmp_path / "in", "k long, v string", [[{"k": 1, "v": "2"}], [{"k": 2, "v": "bad"}]])
    parse = lambda b: b.select("k", F.col("v").try_cast("int").alias("v")).where("v is not null")
    jobs.raw_first(stream, f"{tmp_path}/raw", f"{tmp_path}/parsed", f"{tmp_path}/ck", parse).awaitTermination(120)
    assert spark.read.json(f"{tmp_path}/raw").count() == 2 and spark.read.parquet(f"{tmp_path}/parsed").count() == 1


def test_missing_and_pending(spark):
    seen = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (4, "c")], "cycle int, conid string").withColumn("s", F.lit("x"))
    cycles = spark.createDataFrame([("x", c) for c in (1, 2, 3)] + [("y", 1)], "s string, cycle int")
    expected = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "a")], "s string, conid string")
    lost = census.missing_keys(cycles, expected, seen, ["s"], ["cycle"], ["conid"])
    assert sorted(tuple(r) for r in lost.collect()) == [("x", 2, "b"), ("x", 3, "a"), ("x", 3, "b")]
    assert jobs.pending(seen.select("cycle").distinct(), spark.createDataFrame([(1, "PASS"), (2, "FAIL")], "cycle int, status string"), "cycle").count() == 2


class Rows(HTMLParser):
    """Rows and list items of a page with their cells, by the events of a parser."""

    def __init__(self, page):
        super().__init__()
        self.rows, self.row, self.cell = [], None, False
        self.feed(page)
        self.close()
        self._end()

    def _end(self):
        if self.row is not None:
            self.rows.append([" ".join("".join(c).split()) for c in self.row["cells"]] or [" ".join("".join(self.row["text"]).split())])
        self.row, self.cell = None, False

    def _tag(self, tag, start):
        self.handle_data(" ")
        if tag in ("tr", "li", "table", "ul", "ol"):
            self._end()
        if start and tag in ("tr", "li"):
            self.row = {"text": [], "cells": []}
        if tag in ("td", "th"):
            self.cell = start
            if start and self.row is not None:
                self.row["cells"].append([])

    def handle_starttag(self, tag, attrs):
        self._tag(tag, True)

    def handle_endtag(self, tag):
        self._tag(tag, False)

    def handle_data(self, data):
        if self.row is not None:
            self.row["text"].append(data)
            if self.cell and self.row["cells"]:
                self.row["cells"][-1].append(data)


def test_cells_of_all_pages_equal_those_of_a_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    odd = "<table><tr><th>a<th>b &amp; c</tr><tr><td>1<td><b>2</b> 3</table><ul><li>one<li>two <i>x</i><ul><li>in</ul></ul><table><tr><td>&lt;p&gt;</td><td></td></tr></table>"
    pages = pages.unionByName(spark.createDataFrame([(-1, odd), (-2, ""), (-3, "no rows")], "page_id long, html string"))
    want = sorted((r["page_id"], i, k, v) for r in pages.collect() for i, row in enumerate(Rows(r["html"] or "").rows) for k, v in enumerate(row))
    assert sorted(map(tuple, html_table.cells(pages, "page_id", "html").collect())) == want and len(want) > 100
