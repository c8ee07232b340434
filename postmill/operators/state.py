"""Retained tables: posting store, live cache entries, source status."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.dates import age_micros, parse_iso
from postmill.operators.dedup import first_per_key, last_value_first_position
from postmill.schema import RETAIN_SECONDS, STATUS



def store_order() -> list[Column]:
    """Order of the store: latest observed first, then input order."""
    return [parse_iso("last_seen_at").desc(), F.col("ord").asc()]


def store_place() -> Column:
    """The store's order as one value: it rises in that order, rows without a stamp last."""
    last = F.lit((1 << 63) - 1)
    return F.struct(F.coalesce(-F.unix_micros(parse_iso("last_seen_at").cast("timestamp")), last), F.col("ord"))


def within_retention(ts: Column | str, as_of, retain_seconds: int) -> Column:
    return age_micros(ts, as_of) <= retain_seconds * 1_000_000


def upsert_and_evict(
    store: DataFrame,
    fresh: DataFrame,
    as_of: datetime | str,
    retain_seconds: int = RETAIN_SECONDS,
    *,
    ignore_missing_details: bool = False,
) -> DataFrame:
    """The next store: fresh rows stamped ``as_of`` plus surviving carried rows.

    A carried row goes when its hash or its url was observed again, or when it
    is past retention. A stamp that is missing or cannot be read has no age: its
    row is carried on (``invalid_stamps`` lists such rows). Fresh rows sharing a url do not replace each other.
    ``ignore_missing_details`` treats a fresh row without description whose url
    is already stored as not observed, so the stored row survives.
    """
    stamp = as_of.isoformat() if isinstance(as_of, datetime) else as_of
    if ignore_missing_details:
        known = store.select("url").distinct()
        missing = fresh.filter("description = ''").join(known, "url", "left_anti")
        fresh = fresh.filter("description <> ''").unionByName(missing)
    stamped = last_value_first_position(fresh).withColumn("last_seen_at", F.lit(stamp))
    # Stored rows that go, by hash alone or by hash and url. Only hashes and urls are moved to
    # find them; the rows themselves move once, or not at all if the store is in buckets by hash.
    seen = fresh.select("hash", F.lit(None).cast("string").alias("url"))
    edited = store.select("hash", "url").join(fresh.select("url").distinct(), "url", "left_semi").select("hash", "url")
    gone = seen.unionByName(edited).distinct().select(F.col("hash").alias("_hash"), F.col("url").alias("_url"))
    survivors = store.filter(
        F.coalesce(within_retention("last_seen_at", as_of, retain_seconds), F.lit(True))
    ).join(gone, (F.col("hash") == F.col("_hash")) & (F.col("_url").isNull() | (F.col("url") == F.col("_url"))), "left_anti")
    return stamped.unionByName(survivors)


def superseded(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows whose url was observed again under another hash: edited postings."""
    return store.join(fresh.select("url").distinct(), "url", "left_semi").join(
        fresh.select("hash").distinct(), "hash", "left_anti"
    )


def invalid_stamps(store: DataFrame) -> DataFrame:
    """Stored rows whose stamp cannot be aged; a store must have none."""
    return store.filter(parse_iso("last_seen_at").isNull())


def store_counts(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """Distinct fresh, carried and total rows of a new store."""
    stored = store.select(F.lit(None).cast("string").alias("hash"), F.lit(1).alias("one"))
    seen = fresh.select("hash", F.lit(0).alias("one"))
    both = stored.unionByName(seen).agg(
        F.countDistinct("hash").alias("fresh"), F.sum("one").alias("total")
    )
    return both.select("fresh", (F.col("total") - F.col("fresh")).alias("carried"), "total")


def latest_live(
    log: DataFrame, as_of: float, ttl: float | None = None,
    key: str = "_key", order: str = "line_no",
) -> DataFrame:
    """Latest unexpired record per key of an append log.

    Expired records go first, so an expired newer record never hides a live
    older one. A record's own ``_ttl`` beats the general one; no ttl at all
    means the record never expires. ``position`` is the first live line.
    """
    limit = F.coalesce(F.col("_ttl"), F.lit(ttl).cast("double"))
    age = F.lit(float(as_of)) - F.coalesce(F.col("_ts"), F.lit(0.0))
    live = log.filter(F.col(key).isNotNull() & ~F.coalesce(age > limit, F.lit(False)))
    first = live.groupBy(key).agg(F.min(order).alias("position"))
    last = first_per_key(live, [F.col(key)], [F.col(order).desc()])
    return last.join(first, key).select(key, *[c for c in log.columns if c != key], "position")


def empty_status(spark) -> DataFrame:
    return spark.createDataFrame([], STATUS)


def _status_entries(runs: DataFrame, order: Column | None) -> DataFrame:
    """Runs as (source, seq, last, success): what each would leave as its source's status."""
    seq = order if order is not None else F.struct(F.col("run_at"))
    last = F.struct(
        F.col("run_at").alias("at"), F.col("ok"),
        F.when(~F.col("ok"), F.col("error")).alias("error"),
        F.when(F.col("ok"), F.col("jobs")).otherwise(F.lit(0)).cast("bigint").alias("jobs"),
    )
    success = F.when(
        F.col("ok"),
        F.struct(F.col("run_at").alias("at"), F.col("jobs").cast("bigint").alias("jobs")),
    )
    return runs.select("source", seq.alias("seq"), last.alias("last"), success.alias("success"))


def _folded(entries: DataFrame, when: Column) -> DataFrame:
    """Status per source: the last entry, and the last one that succeeded."""
    return (
        entries.groupBy("source")
        .agg(
            F.max_by("last", when).alias("last"),
            F.max_by("success", F.when(F.col("success").isNotNull(), when)).alias("success"),
        )
        .select(
            "source",
            F.col("last.at").alias("last_run_at"),
            F.col("last.ok").alias("last_run_ok"),
            F.col("last.error").alias("last_run_error"),
            F.col("last.jobs").alias("last_run_jobs"),
            F.col("success.at").alias("last_success_at"),
            F.col("success.jobs").alias("last_success_jobs"),
        )
    )


def status_of(runs: DataFrame, order: Column | None = None) -> DataFrame:
    """Status per source of a log of runs (source, run_at, ok, jobs, error), which may be a stream."""
    return _folded(_status_entries(runs, order), F.col("seq"))


def fold_status(prev: DataFrame, runs: DataFrame, order: Column | None = None) -> DataFrame:
    """Status per source after a log of runs (source, run_at, ok, jobs, error).

    The previous status joins the fold as the earliest entry of its source, so
    one aggregation replaces a join; sources not run keep their row.
    """
    now = _status_entries(runs, order).withColumn("era", F.lit(1))
    no_seq = F.lit(None).cast(now.schema["seq"].dataType)
    before = prev.select(
        "source", F.lit(0).alias("era"), no_seq.alias("seq"),
        F.struct(
            F.col("last_run_at").alias("at"), F.col("last_run_ok").alias("ok"),
            F.col("last_run_error").alias("error"), F.col("last_run_jobs").alias("jobs"),
        ).alias("last"),
        F.when(
            F.col("last_success_at").isNotNull(),
            F.struct(F.col("last_success_at").alias("at"), F.col("last_success_jobs").alias("jobs")),
        ).alias("success"),
    )
    return _folded(before.unionByName(now), F.struct("era", "seq"))


def status_summary(status: DataFrame) -> DataFrame:
    """Number of sources, failing sources and jobs of the last runs."""
    return status.agg(
        F.count("*").alias("sources"),
        F.count_if(F.coalesce(~F.col("last_run_ok"), F.lit(False))).alias("failing"),
        F.coalesce(F.sum("last_run_jobs"), F.lit(0)).alias("total_jobs"),
    )


def run_outcomes(
    postings: DataFrame, errors: DataFrame, observed: DataFrame, run_at: str
) -> DataFrame:
    """Run log entries of one collection, one per observed source."""
    jobs = postings.groupBy("source").agg(F.count("*").alias("jobs"))
    failed = errors.select("source", "error")
    return (
        observed.select("source").distinct()
        .join(jobs, "source", "left")
        .join(failed, "source", "left")
        .select(
            "source", F.lit(run_at).alias("run_at"), F.col("error").isNull().alias("ok"),
            F.coalesce("jobs", F.lit(0)).alias("jobs"), "error",
        )
    )
