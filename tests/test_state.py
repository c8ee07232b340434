from pyspark.sql import functions as F

from postmill.functions.dates import is_stale
from postmill.operators import dedup, state
from postmill.schema import POSTING
from postmill.sources.tables import in_buckets
from tests.rows import NOW, column, posting, postings

DAY = 86_400


def upsert(spark, old, new, retain=7 * DAY, **kw):
    out = state.upsert_and_evict(postings(spark, *old), postings(spark, *new), NOW, retain, **kw)
    return [r.hash for r in out.orderBy(*state.store_order()).collect()], out


def test_fresh_rows_are_stamped(spark):
    _, out = upsert(spark, [], [posting("a", last_seen_at="2020-01-01T00:00:00")])
    assert column(out, "last_seen_at") == [NOW]


def test_carried_rows_keep_their_stamp_within_retention(spark):
    rows = [posting("old", last_seen_at="2026-04-11T12:00:00"), posting("new", last_seen_at="2026-04-18T12:00:00"),
            posting("edge", last_seen_at="2026-04-12T12:00:00+00:00"), posting("over", last_seen_at="2026-04-12T11:59:59")]
    names, out = upsert(spark, rows, [])
    assert set(names) == {"new", "edge"}
    assert {r.hash: r.last_seen_at for r in out.collect()}["new"] == "2026-04-18T12:00:00"


def test_zero_retention(spark):
    names, _ = upsert(spark, [posting("a", last_seen_at="2026-04-19T11:59:59"),
                              posting("b", last_seen_at="2026-04-19T12:00:00")], [], 0)
    assert names == ["b"]


def test_same_hash_takes_all_fresh_fields(spark):
    _, out = upsert(spark, [posting("a", team="Old", last_seen_at="2026-04-18T00:00:00")],
                    [posting("a", team="New", url="https://other")])
    row = out.head()
    assert (out.count(), row.team, row.url) == (1, "New", "https://other")


def test_same_url_supersedes(spark):
    old = [posting("a", url="u", last_seen_at="2026-04-18T00:00:00"), posting("b", url="v", last_seen_at="2026-04-18T00:00:00"),
           posting("c", url="", last_seen_at="2026-04-18T00:00:00")]
    assert upsert(spark, old, [posting("n", url="u")])[0] == ["n", "b", "c"]
    assert set(upsert(spark, old, [posting("n", url="")])[0]) == {"n", "a", "b"}


def test_fresh_rows_of_one_url_stay(spark):
    assert set(upsert(spark, [], [posting("a", url="u"), posting("b", url="u")])[0]) == {"a", "b"}


def test_fresh_first_then_carried_in_order(spark):
    old = [posting("x", last_seen_at="2026-04-17T00:00:00"), posting("y", last_seen_at="2026-04-17T00:00:00"),
           posting("z", last_seen_at="2026-04-18T00:00:00")]
    assert upsert(spark, old, [posting("b"), posting("a")])[0] == ["b", "a", "z", "x", "y"]


def test_duplicate_fresh_hash_last_value_first_place(spark):
    names, out = upsert(spark, [], [posting("a", team="1"), posting("b"), posting("a", team="2")])
    assert names == ["a", "b"]
    assert {r.hash: r.team for r in out.collect()}["a"] == "2"


def test_upsert_is_idempotent(spark):
    old = postings(spark, posting("a", last_seen_at="2026-04-18T00:00:00"))
    new = postings(spark, posting("b"))
    once = state.upsert_and_evict(old, new, NOW)
    twice = state.upsert_and_evict(once, new, NOW)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_rows_without_details_may_be_ignored(spark):
    old = [posting("a", url="u", last_seen_at="2026-04-18T00:00:00")]
    new = [posting("n", url="u", description=""), posting("m", url="w", description="")]
    assert set(upsert(spark, old, new)[0]) == {"n", "m"}
    assert set(upsert(spark, old, new, ignore_missing_details=True)[0]) == {"a", "m"}


def test_counts_and_invalid_stamps(spark):
    old = postings(spark, posting("a", last_seen_at="2026-04-18T00:00:00"), posting("z", last_seen_at=""))
    new = postings(spark, posting("b"), posting("b"), posting("c"))
    store = state.upsert_and_evict(old, new, NOW)
    assert tuple(state.store_counts(store, new).head()) == (2, 2, 4)  # the row without a stamp is carried
    assert column(state.invalid_stamps(old)) == ["z"]


def test_stale(spark):
    rows = [("2026-04-17T12:00:00",), ("2026-04-17T11:59:59",), ("2026-04-17T12:00:01",), ("",), (None,)]
    df = spark.createDataFrame(rows, "x string")
    got = [r.s for r in df.select(is_stale("x", NOW, 2 * DAY).alias("s")).collect()]
    assert got == [False, True, False, False, False]


# --- dedup -----------------------------------------------------------------

def test_dedup_first(spark):
    df = postings(spark, posting("a", title="T"), posting("b", title="T"), posting("c", title="T", team=""),
                  posting("d", title="U", description="other"))
    assert sorted(column(dedup.dedup_first(df))) == ["a", "c", "d"]
    assert sorted(column(dedup.dedup_first(df, ["company"]))) == ["a"]
    assert dedup.dedup_first(df, []).count() == 4
    try:
        dedup.dedup_first(df, ["nope"])
    except ValueError as error:
        assert "nope" in str(error)
    else:
        raise AssertionError("expected a ValueError")


def test_dedup_prefers_fresh_rows(spark):
    old = postings(spark, posting("old", title="T", url="1", last_seen_at="2026-04-18T00:00:00"))
    new = postings(spark, posting("new", title="T", url="2", ord=50))
    store = state.upsert_and_evict(old, new, NOW)
    assert column(dedup.dedup_first(store, ["title"], state.store_order())) == ["new"]


def test_hot_key_is_limited_before_the_shuffle(spark):
    plan = dedup.dedup_first(postings(spark, posting("a")))._jdf.queryExecution().executedPlan().toString()
    partial, shuffle = plan.rfind("WindowGroupLimit"), plan.find("Exchange hashpartitioning")
    assert 0 <= shuffle < partial


def test_universe(spark):
    df = postings(spark, posting("a", title="spark"), posting("b", title="flink"), posting("c", title="beam"),
                  posting("a", title="spark", description="second"), posting("b", title="flink", description="second"))
    keep, force = F.col("title") == "spark", F.col("title").isin("spark", "flink")
    universe, forced = dedup.select_universe(df, keep, force)
    rows = universe.orderBy("only_forced", "ord").collect()
    assert [(r.hash, r.description, r.only_forced) for r in rows] == [("a", "second", False), ("b", "text", True)]
    assert sorted(column(forced)) == ["a", "a", "b", "b"]
    universe, forced = dedup.select_universe(df, keep)
    assert (sorted(column(universe)), forced.count()) == (["a", "a"], 0)
    assert dedup.select_universe(df)[0].count() == 5


def test_unscored(spark):
    df = postings(spark, posting("a"), posting("b"))
    scored = spark.createDataFrame([("a",), ("a",)], "hash string")
    assert column(dedup.unscored(df, scored)) == ["b"]


# --- cache and status ------------------------------------------------------

LOG = "line_no bigint, _key string, _ts double, _ttl double, value string"


def test_latest_live(spark):
    log = spark.createDataFrame([
        (0, "a", 90.0, None, "a0"), (1, "b", 95.0, None, "b1"), (2, "a", 10.0, None, "expired"),
        (3, None, 99.0, None, "no key"), (4, "c", 10.0, 1000.0, "own ttl"), (5, "d", 99.0, 0.5, "own expired"),
        (6, "b", 96.0, None, "b6"), (7, "e", 50.0, None, "at the limit"), (8, "f", None, None, "no time"),
    ], LOG)
    got = {r._key: (r.value, r.position) for r in state.latest_live(log, 100.0, 50.0).collect()}
    assert got == {"a": ("a0", 0), "b": ("b6", 1), "c": ("own ttl", 4), "e": ("at the limit", 7)}
    forever = {r._key for r in state.latest_live(log, 100.0, None).collect()}
    assert forever == {"a", "b", "c", "e", "f"}


RUNS = "source string, run_at string, ok boolean, jobs bigint, error string"


def test_fold_status(spark):
    runs = spark.createDataFrame([
        ("a", "1", True, 5, None), ("a", "2", False, 9, "boom"), ("a", "3", True, 7, "stale text"),
        ("b", "1", False, 0, "down"), ("c", "1", True, 4, None), ("c", "2", False, 0, "late"),
    ], RUNS)
    got = {r.source: tuple(r)[1:] for r in state.fold_status(state.empty_status(spark), runs).collect()}
    assert got == {
        "a": ("3", True, None, 7, "3", 7),
        "b": ("1", False, "down", 0, None, None),
        "c": ("2", False, "late", 0, "1", 4),
    }


def test_fold_status_carries_earlier_rows(spark):
    first = state.fold_status(state.empty_status(spark), spark.createDataFrame(
        [("a", "1", True, 5, None), ("z", "1", True, 2, None)], RUNS))
    second = state.fold_status(first, spark.createDataFrame([("a", "2", False, 0, "x")], RUNS))
    got = {r.source: tuple(r)[1:] for r in second.collect()}
    assert got == {"a": ("2", False, "x", 0, "1", 5), "z": ("1", True, None, 2, "1", 2)}
    assert tuple(state.status_summary(second).head()) == (2, 1, 2)


def test_status_summary_of_nothing(spark):
    assert tuple(state.status_summary(state.empty_status(spark)).head()) == (0, 0, 0)


def test_run_outcomes(spark):
    rows = postings(spark, posting("a", source="s"), posting("b", source="s"))
    errors = spark.createDataFrame([("bad", "no")], "source string, error string")
    seen = spark.createDataFrame([("s",), ("bad",), ("empty",)], "source string")
    got = {r.source: (r.ok, r.jobs, r.error) for r in state.run_outcomes(rows, errors, seen, "t").collect()}
    assert got == {"s": (True, 2, None), "bad": (False, 0, "no"), "empty": (True, 0, None)}


def test_schema_is_kept(spark):
    df = postings(spark, posting("a"))
    assert dedup.last_value_first_position(df).columns == POSTING.names


def test_rows_without_a_stamp_are_carried(spark):
    old = postings(spark, posting("a", last_seen_at=""), posting("b", last_seen_at="junk"),
                   posting("c", last_seen_at="2020-01-01T00:00:00"), posting("d", last_seen_at=""))
    fresh = postings(spark, posting("d"))
    assert sorted(column(state.upsert_and_evict(old, fresh, NOW))) == ["a", "b", "d"]


def test_of_equal_postings_the_one_seen_last_is_taken(spark):
    old = posting("old", title="T", url="u1", description="d", last_seen_at="2026-04-18T12:00:00", ord=1)
    new = posting("new", title="T", url="u2", description="d", last_seen_at="2026-04-19T12:00:00", ord=9)
    store = postings(spark, old, new, posting("blank", title="T", description="d", ord=3))
    for force in (None, F.lit(False)):
        universe, _ = dedup.select_universe(store, F.lit(True), force, order=state.store_place())
        assert column(universe) == ["new"]


# --- plans -----------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_winners_are_chosen_without_sorting_aggregates(spark):
    a, b = postings(spark, posting("a")), postings(spark, posting("b"))
    log = spark.createDataFrame([(0, "a", 1.0, None, "v")], LOG)
    for df in (
        dedup.last_value_first_position(a), state.upsert_and_evict(a, b, NOW), state.latest_live(log, 5.0),
        dedup.select_universe(a, F.col("title") == "x", F.col("title") == "y")[0],
    ):
        assert "SortAggregate" not in plan_of(df)


def test_a_store_in_buckets_is_not_moved(spark):
    many = postings(spark, *[posting(f"h{n}", last_seen_at="2026-04-18T00:00:00") for n in range(50)])
    store, fresh = in_buckets(many, "hash", 8), postings(spark, posting("h3"), posting("new", url="https://jobs.test/h9"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = state.upsert_and_evict(store, fresh, NOW)
        lines = plan_of(new).splitlines()
        got = {r.hash for r in new.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {f"h{n}" for n in range(50) if n != 9} | {"new"}
    whole = next(k for k, line in enumerate(lines) if "FileScan" in line and "description" in line)
    join = next(k for k in range(whole, -1, -1) if "LeftAnti" in lines[k])
    assert "Bucketed: true" in lines[whole] and not any("Exchange" in line for line in lines[join:whole])


def test_counts_are_taken_while_rows_are_written(spark, tmp_path):
    df = postings(spark, posting("a", title="spark"), posting("b", title="spark"), posting("c", title="beam"))
    chosen, counted = dedup.counted_stages(df, F.col("title") == "spark", ["title"])
    chosen.write.parquet(str(tmp_path / "out"))
    assert counted.counts() == {"total": 3, "unique_rows": 2, "matched": 1}
    assert counted.counts() == dedup.stage_counts(df, F.col("title") == "spark", ["title"]).first().asDict()
    marked = dedup.Counted()
    marked.through(df, "spark", F.col("title") == "spark").write.parquet(str(tmp_path / "again"))
    assert marked.counts() == {"spark": 2}
