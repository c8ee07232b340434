import time

import pytest

from postmill.operators import retained, state
from postmill.schema import POSTING
from postmill.streaming import streams
from tests.rows import posting, postings

STAMPS = ("2026-04-17T00:00:00", "2026-04-18T00:00:00", "2026-04-30T00:00:00")


def rows(df):
    return sorted(map(str, df.collect()))


def feed(spark, tmp_path, tables, start, checkpoint="ck"):
    inbox = str(tmp_path / "inbox")
    for table in tables:
        table.coalesce(1).write.mode("append").parquet(inbox)
        start(spark.readStream.schema(table.schema).parquet(inbox), str(tmp_path / "out"), str(tmp_path / checkpoint)).awaitTermination()
    return str(tmp_path / "out")


def test_upsert_stream_equals_batches(spark, tmp_path):
    runs = [
        postings(spark, posting("a", url="u"), posting("b")),
        postings(spark, posting("c", url="u"), posting("d", url="v")),
        postings(spark, posting("e", url="v")),
    ]
    out = feed(spark, tmp_path, runs, lambda s, path, ck: streams.stream_upsert(s, path, ck, lambda n: STAMPS[n], buckets=4))
    want = spark.createDataFrame([], POSTING)
    for run, stamp in zip(runs, STAMPS):
        want = state.upsert_and_evict(want, run, stamp)
    assert rows(streams.read_store(spark, out)) == rows(want.select(*POSTING.names))
    assert retained.posting_store(spark, out).numbers() == [0, 1, 2]


def test_a_new_checkpoint_goes_on_from_the_table(spark, tmp_path):
    out = feed(spark, tmp_path, [postings(spark, posting("a"))],
               lambda s, path, ck: streams.stream_upsert(s, path, ck, lambda n: STAMPS[0], buckets=4))
    later = tmp_path / "later"
    inbox = str(later / "inbox")
    postings(spark, posting("b")).write.parquet(inbox)
    stream = spark.readStream.schema(POSTING).parquet(inbox)
    streams.stream_upsert(stream, out, str(later / "ck"), lambda n: STAMPS[1], buckets=4).awaitTermination()
    assert {r.hash for r in streams.read_store(spark, out).collect()} == {"a", "b"}


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    store = retained.posting_store(spark, str(tmp_path / "t"), 4)
    retained.upsert(store, postings(spark, posting("a")), STAMPS[0], writer="w", number=0)
    for _ in range(2):
        retained.upsert(store, postings(spark, posting("b", url="u")), STAMPS[1], writer="w", number=1)
    assert store.numbers() == [0, 1]
    retained.upsert(store, postings(spark, posting("c", url="u")), STAMPS[1], writer="x", number=0)
    assert {r.hash for r in retained.stored_postings(store).collect()} == {"a", "c"}


LOG = "_key string, _ts double, _ttl double, value string, line_no bigint"
RECORDS = [
    ("a", 10.0, None, "a0", 0), ("b", 10.0, 500.0, "b0", 1), ("c", 90.0, None, "c0", 2), ("b", 95.0, 1.0, "b1", 3),
    ("d", None, 1000.0, "d0", 4), (None, 99.0, None, "no key", 5), ("c", 91.0, 2.0, "c1", 6), ("e", 50.0, 10.0, "e0", 7),
    ("b", 96.0, 40.0, "b2", 8), ("a", 99.0, 5.0, "a1", 9), ("a", 99.0, 1.0, "a2", 10),
]


@pytest.mark.parametrize("cuts", [(11,), (4, 11), (1, 2, 6, 9, 11)])
def test_live_stream_equals_the_whole_log_at_any_moment(spark, tmp_path, cuts):
    log = spark.createDataFrame(RECORDS, LOG)
    runs = [log.filter(f"line_no >= {lo} AND line_no < {hi}") for lo, hi in zip((0, *cuts), cuts)]
    out = feed(spark, tmp_path, runs, lambda s, path, ck: streams.stream_latest_live(s, path, ck, 50.0, skew=-time.time(), buckets=4))
    for moment in (100.0, 101.5, 120.0, 137.0, 300.0, 2000.0):
        want = state.latest_live(log, moment, 50.0).select(*log.columns)
        assert rows(streams.read_live(spark, out, log.schema, moment, 50.0)) == rows(want)


def test_state_that_is_over_is_dropped_by_its_timer(spark, tmp_path):
    now = time.time()
    first = spark.createDataFrame([("a", now, 3.0, "a0", 0), ("b", now, None, "b0", 1)], LOG)
    later = spark.createDataFrame([("c", now, None, "c0", 2)], LOG)

    def start(s, path, ck):
        return streams.stream_latest_live(s, path, ck, None, buckets=4)

    out = feed(spark, tmp_path, [first], start)
    held = streams._live_table(spark, out, first.schema, "_key")
    assert {r["_key"] for r in held.read().collect()} == {"a", "b"}
    time.sleep(max(0.0, now + 4 - time.time()))
    feed(spark, tmp_path, [later], start)
    assert {r["_key"] for r in held.read().collect()} == {"b", "c"}


@pytest.mark.parametrize("cuts", [("9",), ("2", "9"), ("1", "2", "9")])
def test_status_stream_equals_batch(spark, tmp_path, cuts):
    schema = "source string, run_at string, ok boolean, jobs bigint, error string"
    log = spark.createDataFrame([
        ("a", "1", True, 5, None), ("b", "1", False, 0, "x"), ("a", "2", False, 0, "y"), ("b", "3", True, 2, None),
        ("c", "0", False, 7, None), ("d", "3", None, 1, "z")], schema)
    runs = [log.filter(f"run_at >= '{lo}' AND run_at < '{hi}'") for lo, hi in zip(("0", *cuts), cuts)]
    out = feed(spark, tmp_path, runs, lambda s, path, ck: streams.stream_status(s, path, ck, buckets=4))
    want = state.fold_status(state.empty_status(spark), log)
    assert rows(streams.read_status(spark, out)) == rows(want)
