"""Registered queries: names, oracles and a few results on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from postmill.plans import catalog

SMALL = ("ded1_keep_first", "sta1_upsert_and_evict", "mat5_near", "nrm6_workday", "rnk1_priority_order")


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 100
    # Of this library's own queries; those of optional modules have tests of their own.
    free = set(catalog.QUERIES) - set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(queries)
    assert all(n.startswith(("mod", "lop")) for n in free)


def test_entry(spark, sf, monkeypatch):
    monkeypatch.setattr(entry, "ENTRY_DIR", sf)
    df = entry.entry(spark)
    assert df.columns[0] == "hash" and 0 < df.count() <= 100


@pytest.mark.parametrize("name", SMALL)
def test_small_tables_equal_sql(spark, sf, name):
    db = duckdb.connect()
    for table in ("documents", "labels", "part", "supplier"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    ours = entry.queries()[name](spark, sf)
    columns = sorted(ours.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in ours.collect())
    relation = db.sql(entry.oracle_sql()[name])
    want = sorted(
        tuple(str(dict(zip(relation.columns, r))[c]) for c in columns) for r in relation.fetchall()
    )
    assert got == want
