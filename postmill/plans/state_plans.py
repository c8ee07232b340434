"""Queries on identity, deduplication, the retained store, caches and status."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions.dates import is_stale
from postmill.functions.text import fingerprint
from postmill.operators import dedup, retained, state
from postmill.plans import views as v
from postmill.plans.registry import query
from postmill.schema import DEDUP_FIELDS
from postmill.sources import readers, sinks
from postmill.session import fresh_path
from postmill.sources.tables import KeyedTable, in_buckets

POSTING_COLUMNS = """hash, title, company, url, source, last_seen_at, posted, location, ord,
    length(description) AS n_chars"""


def brief(df):
    return df.select(
        "hash", "title", "company", "url", "source", "last_seen_at", "posted", "location", "ord",
        F.length("description").cast("bigint").alias("n_chars"),
    )


@query("sca1_posting_hash", "SELECT ord, hash FROM v_postings", ("v_postings",))
def posting_hash(spark, sf):
    return v.postings(spark, sf).select("ord", "hash")


@query("ded1_keep_first", f"""
    SELECT {POSTING_COLUMNS} FROM (
      SELECT *, row_number() OVER (PARTITION BY title, company, team, description ORDER BY ord) AS rn
      FROM v_postings) WHERE rn = 1""", ("v_postings",))
def keep_first(spark, sf):
    return brief(dedup.dedup_first(v.postings(spark, sf), DEDUP_FIELDS))


@query("ded1_keep_first_fresh_wins", f"""
    SELECT {POSTING_COLUMNS} FROM (
      SELECT *, row_number() OVER (PARTITION BY url, team ORDER BY last_seen_at DESC, ord) AS rn
      FROM v_store) WHERE rn = 1""", ("v_store",))
def keep_first_fresh_wins(spark, sf):
    return brief(dedup.dedup_first(v.store(spark, sf), ("url", "team"), state.store_order()))


@query("ded2_last_value_first_position", f"SELECT {POSTING_COLUMNS} FROM v_store", ("v_store",))
def last_value(spark, sf):
    return brief(v.store(spark, sf))


STA1_SQL = f"""
    , observed AS (SELECT hash, url FROM v_fresh),
    stamped AS (
      SELECT f.* REPLACE (k.first AS ord), '{v.AS_OF}' AS last_seen_at FROM v_fresh f
      JOIN (SELECT hash, min(ord) AS first, max(ord) AS last FROM v_fresh GROUP BY hash) k ON f.ord = k.last)
    SELECT {POSTING_COLUMNS}, TRUE AS is_fresh FROM stamped
    UNION ALL
    SELECT {POSTING_COLUMNS}, FALSE AS is_fresh FROM v_store
    WHERE hash NOT IN (SELECT hash FROM observed) AND url NOT IN (SELECT url FROM observed)
      AND epoch(TIMESTAMP '2026-04-19 12:00:00') - epoch(CAST(last_seen_at AS TIMESTAMP)) <= 604800"""


@query("sta1_upsert_and_evict", STA1_SQL, ("v_store", "v_fresh"))
def upsert(spark, sf):
    new = state.upsert_and_evict(v.store(spark, sf), v.fresh(spark, sf), v.AS_OF)
    return brief(new).withColumn("is_fresh", F.col("last_seen_at") == v.AS_OF)


@query("jon1_jon2_bucketed_store", STA1_SQL, ("v_store", "v_fresh"))
def upsert_in_buckets(spark, sf):
    """`sta1_upsert_and_evict` on a store in buckets by hash, whose rows stay where they are."""
    new = state.upsert_and_evict(in_buckets(v.store(spark, sf), "hash"), v.fresh(spark, sf), v.AS_OF)
    return brief(new).withColumn("is_fresh", F.col("last_seen_at") == v.AS_OF)


@query("agg1_store_counts", """
    , observed AS (SELECT hash, url FROM v_fresh)
    SELECT fresh, carried, fresh + carried AS total FROM (
      SELECT (SELECT count(DISTINCT hash) FROM v_fresh) AS fresh, count(*) AS carried FROM v_store
      WHERE hash NOT IN (SELECT hash FROM observed) AND url NOT IN (SELECT url FROM observed)
        AND epoch(TIMESTAMP '2026-04-19 12:00:00') - epoch(CAST(last_seen_at AS TIMESTAMP)) <= 604800)""",
       ("v_store", "v_fresh"))
def store_counts(spark, sf):
    fresh = v.fresh(spark, sf)
    return state.store_counts(state.upsert_and_evict(v.store(spark, sf), fresh, v.AS_OF), fresh)


@query("agg1_observed_counts", """
    , observed AS (SELECT hash, url FROM v_fresh)
    SELECT fresh, carried, fresh + carried AS total FROM (
      SELECT (SELECT count(DISTINCT hash) FROM v_fresh) AS fresh, count(*) AS carried FROM v_store
      WHERE hash NOT IN (SELECT hash FROM observed) AND url NOT IN (SELECT url FROM observed)
        AND epoch(TIMESTAMP '2026-04-19 12:00:00') - epoch(CAST(last_seen_at AS TIMESTAMP)) <= 604800)""",
       ("v_store", "v_fresh"))
def observed_store_counts(spark, sf):
    """The counts of `agg1_store_counts`, taken while the new store is written."""
    counted = dedup.Counted()
    new = state.upsert_and_evict(v.store(spark, sf), v.fresh(spark, sf), v.AS_OF)
    marked = counted.through(counted.through(new, "total"), "fresh", F.col("last_seen_at") == v.AS_OF)
    marked.write.parquet(fresh_path(spark, "store"))
    n = counted.counts()
    return spark.range(1).select(
        F.lit(n["fresh"]).cast("long").alias("fresh"), F.lit(n["total"] - n["fresh"]).cast("long").alias("carried"),
        F.lit(n["total"]).cast("long").alias("total"),
    )


@query("jon2_edited_posting_superseded", """
    SELECT s.hash, s.url FROM v_store s WHERE s.url IN (SELECT url FROM v_fresh)
      AND s.hash NOT IN (SELECT hash FROM v_fresh)""", ("v_store", "v_fresh"))
def superseded(spark, sf):
    return state.superseded(v.store(spark, sf), v.fresh(spark, sf)).select("hash", "url")


@query("flt3_retention", """
    SELECT ord FROM v_postings
    WHERE epoch(TIMESTAMP '2026-04-19 12:00:00') - epoch(CAST(last_seen_at AS TIMESTAMP)) <= 604800""",
       ("v_postings",))
def retention(spark, sf):
    keep = state.within_retention("last_seen_at", v.AS_OF, 604800)
    return v.postings(spark, sf).filter(keep).select("ord")


@query("flt4_stale_flag", """
    SELECT ord, epoch(TIMESTAMP '2026-04-19 12:00:00') - epoch(CAST(last_seen_at AS TIMESTAMP)) > 172800 AS stale
    FROM v_postings""", ("v_postings",))
def stale(spark, sf):
    return v.postings(spark, sf).select("ord", is_stale("last_seen_at", v.AS_OF, 172800).alias("stale"))


LIVE = f"""SELECT * FROM v_cache WHERE _key IS NOT NULL
      AND NOT coalesce({v.EVENTS_AS_OF} - _ts > coalesce(_ttl, 1000000), FALSE)"""


@query("sta2_latest_live", f"""
    , live AS ({LIVE})
    SELECT _key AS cache_key, arg_max(value, line_no) AS value, max(line_no) AS line_no,
           min(line_no) AS position FROM live GROUP BY _key""", ("v_cache",))
def latest_live(spark, sf):
    live = state.latest_live(v.cache_log(spark, sf), v.EVENTS_AS_OF, 1_000_000.0)
    return live.select(F.col("_key").alias("cache_key"), "value", "line_no", "position")


@query("sta3_compaction", f"""
    , live AS ({LIVE})
    SELECT _key AS cache_key, arg_max(value, line_no) AS value, max(line_no) AS line_no
    FROM live GROUP BY _key""", ("v_cache",))
def compaction(spark, sf):
    path = fresh_path(spark, "compacted")
    live = state.latest_live(v.cache_log(spark, sf), v.EVENTS_AS_OF, 1_000_000.0)
    live.write.parquet(path)
    again = spark.read.parquet(path).drop("position")
    return state.latest_live(again, v.EVENTS_AS_OF, 1_000_000.0).select(
        F.col("_key").alias("cache_key"), "value", "line_no"
    )


@query("sta3_compaction_in_place", f"""
    , live AS ({LIVE})
    SELECT _key AS cache_key, arg_max(value, line_no) AS value, max(line_no) AS line_no
    FROM live GROUP BY _key""", ("v_cache",))
def compaction_in_place(spark, sf):
    """The log as a versioned table, compacted over the path it is read from."""
    log = v.cache_log(spark, sf)
    cache = KeyedTable(spark, fresh_path(spark, "cache"), log.schema, "_key", 8)
    cache.overwrite(log)
    retained.compact_cache(cache, v.EVENTS_AS_OF, 1_000_000.0)
    cache.vacuum(keep=1)
    return cache.read().select(F.col("_key").alias("cache_key"), "value", "line_no")


STATUS_SQL = """
    SELECT source, arg_max(run_at, n) AS last_run_at, arg_max(ok, n) AS last_run_ok,
           arg_max(coalesce(error, ''), n) AS last_run_error,
           arg_max(CASE WHEN ok THEN jobs ELSE 0 END, n) AS last_run_jobs,
           arg_max(run_at, n) FILTER (WHERE ok) AS last_success_at,
           arg_max(jobs, n) FILTER (WHERE ok) AS last_success_jobs
    FROM v_runs GROUP BY source"""


def _status(spark, sf):
    return state.fold_status(state.empty_status(spark), v.runs(spark, sf), F.col("n"))


@query("sta4_run_status", STATUS_SQL, ("v_runs",))
def run_status(spark, sf):
    return _status(spark, sf).withColumn("last_run_error", F.coalesce("last_run_error", F.lit("")))


@query("sta4_run_status_in_two_steps", STATUS_SQL, ("v_runs",))
def run_status_two_steps(spark, sf):
    runs = v.runs(spark, sf)
    early = F.col("run_at") < "2024-01-15"
    first = state.fold_status(state.empty_status(spark), runs.filter(early), F.col("n"))
    both = state.fold_status(first, runs.filter(~early), F.col("n"))
    return both.withColumn("last_run_error", F.coalesce("last_run_error", F.lit("")))


@query("agg2_status_summary", f"""
    , status AS ({STATUS_SQL})
    SELECT count(*) AS sources, count(*) FILTER (WHERE NOT last_run_ok) AS failing,
           CAST(sum(last_run_jobs) AS BIGINT) AS total_jobs FROM status""", ("v_runs",))
def status_summary(spark, sf):
    return state.status_summary(_status(spark, sf))


@query("agg3_outcome_per_source", """
    SELECT source, count(*) AS jobs FROM v_postings GROUP BY source""", ("v_postings",))
def outcome_per_source(spark, sf):
    p = v.postings(spark, sf)
    no_errors = p.select("source", F.lit("").alias("error")).filter(F.lit(False))
    return state.run_outcomes(p, no_errors, p, v.AS_OF).select("source", "jobs")


@query("sta5_fingerprint_gate", """
    SELECT ord FROM v_postings
    WHERE sha256(source || chr(10) || location)[1:16] = sha256('src1' || chr(10) || 'en')[1:16]""",
       ("v_postings",))
def fingerprint_gate(spark, sf):
    marked = v.postings(spark, sf).withColumn("fingerprint", fingerprint("source", "location"))
    return readers.gated(marked, fingerprint(F.lit("src1"), F.lit("en"))).select("ord")


@query("src7_training_scan", """
    SELECT s.hash, interest_score, fit_score FROM v_scores s""", ("v_scores",))
def training_scan(spark, sf):
    path = fresh_path(spark, "training")
    rows = v.scores(spark, sf)
    sinks.append_training(rows, path, "current")
    sinks.append_training(rows.withColumn("fit_score", F.lit(0)), path, "outdated")
    return readers.read_training(spark, path, "current", rows.schema)


@query("src8_status_scan", STATUS_SQL, ("v_runs",))
def status_scan(spark, sf):
    path = fresh_path(spark, "status")
    sinks.write_status(_status(spark, sf), path)
    return readers.read_status(spark, path).withColumn(
        "last_run_error", F.coalesce("last_run_error", F.lit(""))
    )


PAY_COLUMNS = """coalesce(compensation.min_amount, -1) AS min_amount,
    coalesce(compensation.max_amount, -1) AS max_amount,
    coalesce(compensation.currency, '') AS currency, coalesce(compensation.interval, '') AS pay_interval,
    coalesce(compensation.equity, FALSE) AS equity, coalesce(compensation.bonus, FALSE) AS bonus,
    coalesce(compensation_raw, '') AS compensation_raw"""


def pay_columns():
    """Flat pay columns, nulls made visible as -1, '' and false."""
    c, blank, none, no = F.col("compensation"), F.lit(""), F.lit(-1), F.lit(False)
    return [
        F.coalesce(c["min_amount"], none).alias("min_amount"),
        F.coalesce(c["max_amount"], none).alias("max_amount"),
        F.coalesce(c["currency"], blank).alias("currency"),
        F.coalesce(c["interval"], blank).alias("pay_interval"),
        F.coalesce(c["equity"], no).alias("equity"), F.coalesce(c["bonus"], no).alias("bonus"),
        F.coalesce("compensation_raw", blank).alias("compensation_raw"),
    ]


@query("src1_posting_scan", f"""
    SELECT hash, title, url, ord, {PAY_COLUMNS} FROM v_postings""", ("v_postings",))
def posting_scan(spark, sf):
    path = fresh_path(spark, "postings")
    sinks.write_postings(v.postings(spark, sf), path, key="ord")
    return readers.read_postings(spark, path).select("hash", "title", "url", "ord", *pay_columns())


@query("src2_store_scan", f"""
    SELECT hash, title, url, ord, {PAY_COLUMNS} FROM v_store""", ("v_store",))
def store_scan(spark, sf):
    path = fresh_path(spark, "store")
    sinks.write_postings(v.postings(spark, sf), path, key="ord")
    return readers.read_store(spark, path).select("hash", "title", "url", "ord", *pay_columns())


@query("src3_capture_scan", """
    SELECT _key AS cache_key, _ts AS ts, value FROM v_cache WHERE line_no % 10 <> 3""", ("v_cache",))
def capture_scan(spark, sf):
    path = fresh_path(spark, "captures")
    log = v.cache_log(spark, sf)
    line = F.to_json(F.struct("_key", "_ts", "_ttl", "value"))
    cut = F.when(F.col("line_no") % 10 == 3, F.substring(line, 1, 9)).otherwise(line)
    log.select(cut.alias("value")).write.text(path)
    read = readers.read_log(spark, path, "_key string, _ts double, _ttl double, value string")
    return read.select(F.col("_key").alias("cache_key"), F.col("_ts").alias("ts"), "value")


@query("snk1_ordered_rows", """
    SELECT hash, row_number() OVER (ORDER BY location, ord) - 1 AS place FROM v_postings""", ("v_postings",))
def ordered_rows(spark, sf):
    path = fresh_path(spark, "ordered")
    sinks.write_postings(v.postings(spark, sf), path, ("location", "ord"), key="ord")
    return readers.read_postings(spark, path).select("hash", F.col("ord").alias("place"))


@query("snk4_error_log", """
    SELECT source, error, CAST(run_at AS VARCHAR) AS run_at FROM v_runs WHERE NOT ok""", ("v_runs",))
def error_log(spark, sf):
    path = fresh_path(spark, "errors")
    failed = v.runs(spark, sf).filter(~F.col("ok")).select("source", "error", "run_at")
    sinks.write_errors(failed, path, v.AS_OF)
    return spark.read.schema("source string, error string, run_at string").json(path)
