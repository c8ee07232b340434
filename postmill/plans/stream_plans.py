"""Streaming forms over the given tables, each in two runs of one query.

The first run meets the first half of the rows, the second run resumes from its
checkpoint and meets the rest.
"""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from postmill.plans import views as v
from postmill.plans.registry import query
from postmill.plans.state_plans import LIVE, POSTING_COLUMNS, STATUS_SQL, brief
from postmill.session import fresh_path
from postmill.streaming import streams


def in_two_runs(spark, halves, start):
    """Feed both halves into one inbox, running the stream after each."""
    inbox, table, checkpoint = (fresh_path(spark, n) for n in ("inbox", "stream", "progress"))
    for half in halves:
        half.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(half.schema).parquet(inbox)
        start(stream, table, checkpoint).awaitTermination()
    return table


@query("str1_stream_upsert", f"""
    , observed AS (SELECT hash, url FROM v_fresh),
    stamped AS (
      SELECT f.* REPLACE (k.first AS ord), '{v.AS_OF}' AS last_seen_at FROM v_fresh f
      JOIN (SELECT hash, min(ord) AS first, max(ord) AS last FROM v_fresh GROUP BY hash) k ON f.ord = k.last)
    SELECT {POSTING_COLUMNS} FROM stamped
    UNION ALL
    SELECT {POSTING_COLUMNS} FROM (SELECT * REPLACE ('2026-04-14T12:00:00' AS last_seen_at) FROM v_store)
    WHERE hash NOT IN (SELECT hash FROM observed) AND url NOT IN (SELECT url FROM observed)""",
       ("v_store", "v_fresh"))
def stream_upsert(spark, sf):
    stamps = ("2026-04-14T12:00:00", v.AS_OF)
    table = in_two_runs(
        spark, [v.postings(spark, sf), v.fresh(spark, sf)],
        lambda s, path, progress: streams.stream_upsert(s, path, progress, lambda n: stamps[n]),
    )
    return brief(streams.read_store(spark, table))


HALF = "2024-01-15"
HALF_EPOCH = 1705276800.0


@query("str2_stream_latest_live", f"""
    , live AS ({LIVE})
    SELECT _key AS cache_key, arg_max(value, line_no) AS value, max(line_no) AS line_no FROM live GROUP BY _key""",
       ("v_cache",))
def stream_latest_live(spark, sf):
    log = v.cache_log(spark, sf)
    early = F.col("_ts") < HALF_EPOCH
    # The log is of another time than this run: state is dropped by a clock a day before its last one.
    skew = v.EVENTS_AS_OF - 86_400 - time.time()
    table = in_two_runs(
        spark, [log.filter(early), log.filter(~early)],
        lambda s, path, progress: streams.stream_latest_live(s, path, progress, 1_000_000.0, skew=skew),
    )
    live = streams.read_live(spark, table, log.schema, v.EVENTS_AS_OF, 1_000_000.0)
    return live.select(F.col("_key").alias("cache_key"), "value", "line_no")


@query("str3_stream_status", STATUS_SQL, ("v_runs",))
def stream_status(spark, sf):
    runs = v.runs(spark, sf)
    early = F.col("run_at") < HALF
    table = in_two_runs(
        spark, [runs.filter(early), runs.filter(~early)],
        lambda s, path, progress: streams.stream_status(s, path, progress, F.col("n")),
    )
    return streams.read_status(spark, table).withColumn("last_run_error", F.coalesce("last_run_error", F.lit("")))
