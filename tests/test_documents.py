"""Files that appear whole, contracts of roots, archives, keyed requests, tolerant records, audits of snapshots."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.expect import ExpectationError
from tidemark.plans import revisions, study
from tidemark.sources import documents, rest

DAY = dt.date(2026, 6, 1)


def test_documents_appear_whole_or_not_at_all(spark, tmp_path):
    folder = tmp_path / "out"
    # What readers see: a task that still runs when its job has failed may leave its part below _pending.
    seen = lambda: sorted(p.name for p in folder.iterdir() if not p.name.startswith("_"))
    rows = spark.createDataFrame([(i, "x", None) for i in range(20)], "b int, a string, c double").repartition(4)
    documents.write_documents(documents.json_objects(rows, F.format_string("r%d.json", F.col("b"))), f"file://{folder}")
    assert seen() == sorted(f"r{i}.json" for i in range(20))
    assert json.loads((folder / "r3.json").read_text()) == {"a": "x", "b": 3, "c": None} and list(json.loads((folder / "r3.json").read_text())) == ["a", "b", "c"]
    # A task that fails leaves nothing to be seen, nor does a name that is there, or one that comes twice.
    bad = spark.range(40, numPartitions=4).select(F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") == 39, F.raise_error(F.lit("broken")).cast("string")).otherwise("y").alias("body"))
    for failing in (bad, spark.createDataFrame([("new", "1"), ("r3.json", "2")], "name string, body string"), spark.createDataFrame([("twice", "1"), ("twice", "2")], "name string, body string"), spark.createDataFrame([("../up", "1")], "name string, body string")):
        with pytest.raises(Exception):
            documents.write_documents(failing, f"file://{folder}")
        assert seen() == sorted(f"r{i}.json" for i in range(20))
    documents.write_documents(spark.createDataFrame([("r3.json", "new")], "name string, body string"), f"file://{folder}", overwrite=True)
    assert (folder / "r3.json").read_text() == "new" and len(seen()) == 20


def test_report(spark, tmp_path):
    one = spark.createDataFrame([("b", 2), ("a", 1)], "k string, n int")
    text = documents.report([("Counts", one, "- %s: %d"), ("Total", one.agg(F.sum("n")), "%d in all")], "report.md", "A study").first()["body"]
    assert text == "# A study\n\n## Counts\n\n- a: 1\n- b: 2\n\n## Total\n\n3 in all\n"


def test_content_hash(spark):
    rows = [(1, "a", None), (2, None, 2.0), (2, None, 2.0)]
    make = lambda r: spark.createDataFrame(r, "i int, s string, x double")
    base = documents.content_hash(make(rows))
    assert base["rows"] == 3 and base == documents.content_hash(make(rows[::-1]).repartition(3))
    for other in ([(1, "a", None), (2, None, 2.0), (2, None, 2.5)], rows[:2], [(1, None, None), (2, "a", 2.0), (2, None, 2.0)], [*rows[:2], rows[0]]):
        assert documents.content_hash(make(other)) != base
    assert documents.content_hash(make(rows).withColumnRenamed("x", "y")) != base
    assert documents.content_hash(make([]))["rows"] == 0


def test_root_contract(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    days = spark.createDataFrame([(DAY + dt.timedelta(days=i),) for i in range(5)], "day date")
    first = documents.open_root(days, root, {"version": "1", "sources": ["a", "b"]})
    assert documents.open_root(days.orderBy(F.desc("day")), root, {"version": "1", "sources": ["a", "b"]}) == first
    for census, terms in ((days.where("day <> '2026-06-03'"), {"version": "1", "sources": ["a", "b"]}), (days, {"version": "2", "sources": ["a", "b"]})):
        with pytest.raises(ExpectationError):
            documents.open_root(census, root, terms)
    (tmp_path / "empty").mkdir()
    with pytest.raises(ExpectationError):
        documents.open_root(days, f"file://{tmp_path}/empty", {})


def test_no_change_without_an_archive(spark, tmp_path):
    table, kept = f"file://{tmp_path}/table", f"file://{tmp_path}/archive"
    spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string").write.parquet(table)
    change = lambda: spark.read.parquet(table).withColumn("i", F.col("i") + 1)
    with pytest.raises(ExpectationError):
        documents.replace_archived(change(), table, kept)
    documents.archive(spark, table, kept)
    with pytest.raises(ExpectationError):
        documents.archive(spark, table, kept)
    documents.replace_archived(change(), table, kept)
    assert sorted(r["i"] for r in spark.read.parquet(table).collect()) == [2, 3]
    with pytest.raises(ExpectationError):  # the archive holds the state before the first change
        documents.replace_archived(change(), table, kept)
    assert sorted(r["i"] for r in spark.read.parquet(f"{kept}/rows").collect()) == [1, 2]
    documents.archive(spark, table, f"{kept}-2")
    documents.replace_archived(change(), table, f"{kept}-2")
    assert sorted(r["i"] for r in spark.read.parquet(table).collect()) == [3, 4]


LOG = "requests.jsonl"


def fixture_books(path, params):
    """Two pages of records for the keys that are asked for; each request is noted in the folder that the path names."""
    with open(f"{path}/{LOG}", "a") as f:
        f.write(json.dumps(params) + "\n")
    page = int(params.get("cursor", 0))
    half = params["keys"][page::2]
    return 200, {}, json.dumps({"records": [{"key": k, "n": len(k)} for k in half] + [{"key": "other"}], "cursor": None if page else "1"})


def asked(folder):
    log = folder / LOG
    found = [json.loads(line) for line in log.read_text().splitlines()] if log.exists() else []
    log.unlink(missing_ok=True)
    return [r for r in found if "cursor" not in r]


def test_keyed_requests_follow_the_filters(spark, tmp_path):
    rest.register(spark)
    source = lambda **options: spark.read.format("keyed_records").options(transport="tests.test_documents.fixture_books", path=str(tmp_path), **options).load()
    keys = [f"k{i}" for i in range(250)]
    rows = source(keys=json.dumps(keys)).collect()
    assert sorted(r["key"] for r in rows) == sorted(keys) and all(json.loads(r["body"])["key"] == r["key"] for r in rows)
    assert sorted(len(r["keys"]) for r in asked(tmp_path)) == [50, 100, 100]
    some = source(keys=json.dumps(keys)).where(F.col("key").isin("k1", "k7", "none"))
    assert sorted(r["key"] for r in some.collect()) == ["k1", "k7"] and [r["keys"] for r in asked(tmp_path)] == [["k1", "k7"]]
    daily = source(daily="true").where("key = 'k5' and day >= date'2026-06-01' and day < date'2026-06-04'")
    assert sorted((r["key"], r["day"]) for r in daily.collect()) == [("k5", DAY + dt.timedelta(days=i)) for i in range(3)]
    assert sorted((r["from"], r["until"]) for r in asked(tmp_path)) == [("2026-06-01", "2026-06-02"), ("2026-06-02", "2026-06-03"), ("2026-06-03", "2026-06-04")]
    with pytest.raises(Exception):
        source(daily="true", keys='["a"]').collect()


def test_health_records(spark):
    good = {"protocol_id": "p", "event_date": "2026-06-01", "date_status": "VALID"}
    cases = [
        (json.dumps(good), None), (None, "missing day_health_summary.json"), ("{not json", "malformed JSON"), ("[1, 2]", "day_health_summary.json must contain a JSON object"),
        (json.dumps(good | {"protocol_id": "q"}), "day health protocol_id mismatch"), (json.dumps(good | {"protocol_id": 7}), "day health protocol_id mismatch"), (json.dumps(good | {"event_date": "2026-06-02"}), "day health event_date mismatch"),
        (json.dumps(good | {"date_status": ["VALID"]}), "day health date_status must be a string"), (json.dumps(good | {"date_status": "odd"}), "unknown day health date_status: odd"),
        (json.dumps({"protocol_id": "p", "event_date": "2026-06-01", "study_blocker": "terms changed", "date_status": 3}), None), (json.dumps(good | {"study_blocker": 5}), "day health study_blocker must be a string when present"),
        (json.dumps(good | {"study_blocker": None}), None), (json.dumps(good | {"study_blocker": ""}), None),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = rows.select("i", study.health_record(F.col("t"), F.lit(DAY), F.lit("p")).alias("h")).orderBy("i").collect()
    assert [r["h"]["reason"] for r in got] == [w for _, w in cases]
    assert all((r["h"]["value"] is None) == (r["h"]["reason"] is not None) for r in got)
    assert got[9]["h"]["value"]["study_blocker"] == "terms changed" and got[0]["h"]["value"]["date_status"] == "VALID"


def test_snapshot_audit_finds_each_fault(spark):
    at = lambda m: dt.datetime(2026, 6, 1, 10) + dt.timedelta(minutes=m)
    good = {"city": "c", "old_publication": at(0), "new_publication": at(60), "next_publication": at(400), "pre": at(50), "post1": at(121), "post2": at(182), "post1_target": at(120), "post2_target": at(180), "pre_staleness": 10.0, "post1_lateness": 1.0, "post2_lateness": 2.0}
    quotes = [("c", f"m{k}", f"l{k}", good[s], 0.5, True) for s in revisions.SNAPSHOTS for k in range(3)]
    event_schema = "city string, old_publication timestamp, new_publication timestamp, next_publication timestamp, pre timestamp, post1 timestamp, post2 timestamp, post1_target timestamp, post2_target timestamp, pre_staleness double, post1_lateness double, post2_lateness double"

    def audit(event=good, rows=quotes):
        quoted = spark.createDataFrame(rows, "city string, ticker string, label string, t timestamp, midpoint_close double, is_pre_close boolean")
        found = revisions.snapshot_audit(spark.createDataFrame([tuple(event.values())], event_schema), quoted, ["city"], "ticker", "label", "t", size=3).first().asDict()
        return {k for k, v in found.items() if k not in ("events", "passed") and v}, found["passed"]

    assert audit() == (set(), True) and audit(good | {"next_publication": None}) == (set(), True)
    times = {
        "pre_not_before_old": {"old_publication": at(55)}, "post1_before_next": {"next_publication": at(121)}, "pre_staleness_matches": {"pre_staleness": 10.01}, "post1_lateness_matches": {"post1_lateness": None}, "post2_lateness_matches": {"post2_target": at(181)},
        "post1_after_publication": {"new_publication": at(121), "pre_staleness": 71.0}, "pre_not_after_publication": {"new_publication": at(49), "pre_staleness": -1.0},
    }
    for rule, change in times.items():
        broken, passed = audit(good | change)
        assert rule in broken and not passed and len(broken) <= 2
    swap = lambda i, **c: [tuple(c.get(n, v) for n, v in zip(("city", "ticker", "label", "t", "mid", "open"), q, strict=True)) if k == i else q for k, q in enumerate(quotes)]
    assert audit(rows=quotes[1:])[0] == {"whole_snapshots", "same_members", "same_labels"} and audit(rows=swap(1, mid=None))[0] == {"whole_snapshots"}
    assert audit(rows=swap(4, ticker="other"))[0] == {"same_members", "same_labels"} and audit(rows=swap(8, label="l9"))[0] == {"same_labels"} and audit(rows=swap(8, open=False))[0] == {"before_close"}
    assert audit(rows=[*quotes, quotes[0]])[0] >= {"whole_snapshots"}
