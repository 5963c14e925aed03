"""Every registered query against its SQL on the smallest tables."""

import decimal
import os

import pytest

import __spark_entry__ as entry
from tidemark.plans import catalog

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return f"{float(value):.5f}".replace("-0.00000", "0.00000")
    return str(value).removesuffix(" 00:00:00")


def lines(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([plain(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, oracle, name):
    found = catalog.QUERIES[name](spark, FOLDER)
    want = oracle.execute(catalog.SQL[name])
    columns = [d[0] for d in want.description]
    a, b = lines(found.columns, [tuple(r) for r in found.collect()]), lines(columns, want.fetchall())
    assert a[0] == b[0] and len(a[1]) == len(b[1])
    # Sums differ between engines in their last rounded digit.
    for x, y in zip(a[1], b[1], strict=True):
        assert all(p == q or abs(float(p) - float(q)) <= 2e-5 for p, q in zip(x, y, strict=True))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
