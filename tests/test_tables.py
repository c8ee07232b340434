"""Versioned tables: what a version shows, what a change rewrites, what a broken run leaves."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.operators import retained, state
from postmill.schema import POSTING
from postmill.sources.tables import Conflict, KeyedTable, Version
from tests.rows import posting, postings

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
DAYS = [f"2026-04-{d:02d}T00:00:00" for d in range(10, 30)]


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def shown(table):
    return {r.k: r.v for r in table.read().collect()}


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k", 4, indexes=("v",))


def test_absent_and_empty(spark, table):
    assert shown(table) == {} and table.version().number == -1 and table.numbers() == []
    assert table.merge(frame(spark)).number == -1
    assert table.vacuum() == 0


def test_merge_replaces_adds_and_deletes(spark, table):
    table.merge(frame(spark, ("a", 1), ("b", 2), ("c", 3)))
    table.merge(frame(spark, ("b", 20), ("d", 4)))
    table.merge(frame(spark, ("a", 0), ("e", 5)), dead=F.col("v") == 0)
    assert shown(table) == {"b": 20, "c": 3, "d": 4, "e": 5}
    assert {r.k: r.v for r in table.read(table.version(0)).collect()} == {"a": 1, "b": 2, "c": 3}


def test_only_touched_buckets_are_written(spark, table):
    table.merge(frame(spark, *[(f"k{n}", n) for n in range(40)]))
    before = table.version()
    after = table.merge(frame(spark, ("k7", 70)))
    changed = {b for b in set(before.parts) | set(after.parts) if before.parts.get(b) != after.parts.get(b)}
    assert len(changed) == 1 and len(before.parts) == 4
    assert shown(table)["k7"] == 70 and len(shown(table)) == 40


def test_a_table_is_written_over_the_path_it_is_read_from(spark, table):
    table.merge(frame(spark, ("a", 1), ("b", 2)))
    table.overwrite(table.read().withColumn("v", F.col("v") + 1).filter("k <> 'a'"))
    assert shown(table) == {"b": 3}
    assert table.vacuum(keep=1) > 0 and table.numbers() == [1] and shown(table) == {"b": 3}
    assert table.vacuum(keep=1) == 0


def test_a_run_that_ends_before_its_manifest_leaves_the_old_version(spark, table, monkeypatch):
    table.merge(frame(spark, ("a", 1)))

    def broken(version):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(table, "commit", broken)
        with pytest.raises(KeyboardInterrupt):
            table.merge(frame(spark, ("a", 2), ("b", 2)))
    assert shown(table) == {"a": 1}
    table.merge(frame(spark, ("b", 3)))
    assert shown(table) == {"a": 1, "b": 3}
    table.vacuum(keep=1)
    assert shown(table) == {"a": 1, "b": 3}


def test_two_writers_cannot_make_the_same_version(spark, table):
    table.merge(frame(spark, ("a", 1)))
    stale = table.version()
    table.merge(frame(spark, ("b", 2)))
    with pytest.raises(Conflict):
        table.replace(stale, [], frame(spark))
    assert shown(table) == {"a": 1, "b": 2}


def test_writers_are_counted_apart(spark, table):
    table.merge(frame(spark, ("a", 1)), writer="x", number=3)
    table.merge(frame(spark, ("a", 9)), writer="x", number=3)
    table.merge(frame(spark, ("b", 1)), writer="y", number=0)
    assert shown(table) == {"a": 1, "b": 1} and table.version().writers == {"x": 3, "y": 0}


def test_an_index_finds_keys_and_is_written_anew_when_loose(spark, table, monkeypatch):
    monkeypatch.setattr("postmill.sources.tables.LOOSE", 2)
    for n in range(5):
        table.merge(frame(spark, (f"k{n}", 7)))
    version = table.version()
    assert {r.k for r in table.keys_with(frame(spark, (None, 7)), "v", version).collect()} == {f"k{n}" for n in range(5)}
    assert table.keys_with(frame(spark, (None, 8)), "v", version).collect() == []
    assert all(len(f) <= 3 for f in version.indexes["v"].values())


def test_rows_of_other_buckets_are_refused(spark, table):
    with pytest.raises(ValueError):
        table.replace(Version(notes={"buckets": 4}), [], frame(spark, ("a", 1)))


def test_store_equals_upsert_and_evict(spark, tmp_path):
    store, want = retained.posting_store(spark, str(tmp_path / "s"), 8), spark.createDataFrame([], POSTING)
    runs = [
        [posting("a", url="u"), posting("b"), posting("c", url=""), posting("b", title="again")],
        [posting("d", url="u"), posting("e", url="v"), posting("f", url="v")],
        [posting("a", url="w")],
        [posting("g", url="u"), posting("h", url="")],
        [],
    ]
    for k, run in enumerate(runs):
        fresh = postings(spark, *run) if run else spark.createDataFrame([], POSTING)
        day = DAYS[4 * k]
        retained.upsert(store, fresh, day, 9 * 86_400)
        want = spark.createDataFrame(state.upsert_and_evict(want, fresh, day, 9 * 86_400).select(*POSTING.names).collect(), POSTING)
        assert sorted(map(str, retained.stored_postings(store).collect())) == sorted(map(str, want.collect()))


def test_one_edited_posting_rewrites_two_buckets(spark, tmp_path):
    store = retained.posting_store(spark, str(tmp_path / "s"), 16)
    retained.upsert(store, postings(spark, *[posting(f"h{n}") for n in range(60)]), DAYS[0])
    before = store.version()
    after = retained.upsert(store, postings(spark, posting("edited", url="https://jobs.test/h9")), DAYS[1])
    changed = [b for b in set(before.parts) | set(after.parts) if before.parts.get(b) != after.parts.get(b)]
    assert len(before.parts) > 10 and len(changed) <= 2
    assert {r.hash for r in retained.stored_postings(store).collect()} == {f"h{n}" for n in range(60) if n != 9} | {"edited"}
    with pytest.raises(ValueError):
        retained.upsert(store, postings(spark, posting("x")), DAYS[0])


def test_a_cache_is_compacted_in_place(spark, tmp_path):
    schema = T.StructType.fromDDL("_key string, _ts double, _ttl double, value string, line_no bigint")
    log = spark.createDataFrame([("a", 1.0, None, "a0", 0), ("b", 9.0, None, "b0", 1), ("b", 1.0, 100.0, "b1", 2), ("c", 9.0, 0.5, "c0", 3)], schema)
    cache = KeyedTable(spark, str(tmp_path / "c"), schema, "_key", 4)
    cache.overwrite(log)
    retained.compact_cache(cache, 10.0, 5.0)
    assert {(r["_key"], r.value) for r in cache.read().collect()} == {("b", "b1")}


def test_every_url_observed_supersedes_also_that_of_a_replaced_row(spark, tmp_path):
    store = retained.posting_store(spark, str(tmp_path / "s"), 8)
    retained.upsert(store, postings(spark, posting("old", url="u"), posting("other")), DAYS[0])
    retained.upsert(store, postings(spark, posting("new", url="u"), posting("new", url="v")), DAYS[1])
    assert {(r.hash, r.url) for r in retained.stored_postings(store).collect()} == {("new", "v"), ("other", "https://jobs.test/other")}
