"""Record functions and operators beyond what the registered queries cover."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import markets, records
from tidemark.operators import records as ops


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_strict_numbers(spark):
    texts = ["0.35", " 0.35 ", "0.355", "-0.35", "1e-2", "0", "1", "1.00", "", None, "0.1.2"]
    asks = one(spark, *[records.on_tick_ask(F.lit(t).cast("string")) for t in texts])
    assert [None if a is None else float(a) for a in asks] == [0.35, 0.35] + [None] * 9
    assert one(spark, *[records.positive_size(F.lit(t).cast("string")) for t in ("3", "0", "-1", "2.5", None)]) == (3, None, None, None, None)


def test_nested_values(spark):
    payloads = ['{"success":{"value":{"a":1}}}', '{"success":true,"a":2}', '{"a":3}', "no json", None]
    assert one(spark, *[F.get_json_object(records.unwrapped(F.lit(p).cast("string")), "$.a") for p in payloads]) == ("1", "2", "3", None, None)
    assert one(spark, records.labels(F.lit('["x","y"]')), records.labels(F.lit("?"))) == (["x", "y"], None)
    rows = spark.createDataFrame([(1, ("k", "secret", [("p", "s")])), (2, None)], "id int, a struct<keep:string,drop:string,keep_list:array<struct<keep:string,other:string>>>")
    kept = ops.only_allowed(rows, {"id", "a", "keep", "keep_list"})
    assert [r.asDict(True) for r in kept.orderBy("id").collect()] == [{"id": 1, "a": {"keep": "k", "keep_list": [{"keep": "p"}]}}, {"id": 2, "a": None}]


def test_splits_and_middles(spark):
    ranges = [("a", "2024-01-01", "2024-01-31"), ("b", "2024-02-01", "2024-02-29")]
    days = spark.sql("select explode(sequence(date'2024-01-31', date'2024-02-01')) as d")
    assert [r[0] for r in days.select(records.split_of(F.col("d"), ranges)).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="outside of all splits"):
        spark.sql("select date'2024-03-01' as d").select(records.split_of(F.col("d"), ranges)).collect()
    assert one(spark, records.middle(F.array(*map(F.lit, (1, 2, 3, 4)))), records.middle(F.array(F.lit(7))), records.middle(F.array().cast("array<int>"))) == (3, 7, None)


def test_attempts_and_books(spark):
    status = spark.createDataFrame([("d1", 2), ("d2", 9)], "day string, latest int")
    attempts = spark.createDataFrame([("d1", 1, "old"), ("d1", 2, "new")], "day string, attempt int, state string")
    assert {r["day"]: r["state"] for r in ops.latest_attempts(status, attempts, "day", "latest", "attempt").collect()} == {"d1": "new", "d2": None}
    books = spark.createDataFrame([("t", [(0.2,), (0.3,)], [])], "ticker string, yes array<struct<price:double>>, no array<struct<price:double>>")
    found = ops.with_books(spark.createDataFrame([("t",), ("u",)], "ticker string"), books).orderBy("ticker").collect()
    assert [(r["best_yes"], r["best_no"]) for r in found] == [(0.3, None), (None, None)]


def test_ticker_dates(spark):
    assert [str(x) for x in one(spark, *[markets.event_date(F.lit(t)) for t in ("KX-24OCT05", "KX-24FEB30", "KX-24ABC05", "KX", "KX-31DEC99")])] == ["2024-10-05", "None", "None", "None", "None"]
    assert str(one(spark, markets.event_date(F.lit("KXHIGH-31DEC09")))[0]) == "2031-12-09"
