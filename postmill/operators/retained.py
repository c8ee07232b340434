"""The posting store and the cache as versioned tables in buckets.

A run touches the buckets of the hashes it observed and of those that its urls stood
under; all others go on as they are. Retention is kept as a floor: a row last seen before
it is gone, at once for every reader and in the files when its bucket is written anew.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.dates import parse_iso
from postmill.operators.dedup import last_value_first_position
from postmill.operators.state import latest_live
from postmill.schema import POSTING, RETAIN_SECONDS
from postmill.session import materialise
from postmill.sources.tables import BUCKETS, KeyedTable, Version


def posting_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeyedTable:
    """The store at ``path``, made by its first upsert."""
    return KeyedTable(spark, path, POSTING, "hash", buckets, indexes=("url",))


def _micros(as_of: datetime | str) -> int:
    when = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    return round((when.replace(tzinfo=None) - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def _retained(version: Version) -> Column:
    """Whether a stored row is past no run's retention; one whose stamp has no age is not."""
    floor = version.notes.get("floor")
    if floor is None:
        return F.lit(True)
    seen = F.unix_micros(parse_iso("last_seen_at").cast("timestamp"))
    return F.coalesce(seen >= floor, F.lit(True))


def stored_postings(table: KeyedTable, version: Version | None = None) -> DataFrame:
    version = version or table.version()
    return table.read(version).filter(_retained(version))


def upsert(
    table: KeyedTable, fresh: DataFrame, as_of: datetime | str, retain_seconds: int = RETAIN_SECONDS,
    writer: str | None = None, number: int = 0,
) -> Version:
    """`upsert_and_evict` on a store that is a table: its next version.

    Runs must come in the order of their clocks. Of the stored rows only those in touched
    buckets are read; which those are comes from the fresh hashes and, through the index,
    from the fresh urls.
    """
    stamp, now = as_of.isoformat() if isinstance(as_of, datetime) else as_of, _micros(as_of)
    version = table.version()
    if table.applied(writer, number, version):
        return version
    if now < version.notes.get("now", now):
        raise ValueError(f"a run of {stamp} after a later one")
    stamped = materialise(last_value_first_position(fresh.select(*POSTING.names)).withColumn("last_seen_at", F.lit(stamp)), "fresh")
    # Every url observed, also those of rows that a later one of their hash replaced.
    urls = materialise(fresh.select("url").distinct(), "urls")
    former = table.keys_with(urls, "url", version)
    buckets = sorted({*table.touched(stamped, "hash", version), *table.touched(former, "hash", version)})
    floor = max(now - retain_seconds * 1_000_000, version.notes.get("floor", -(1 << 62)))
    notes = {"now": now, "floor": floor}
    after = Version(version.number, version.parts, version.indexes, version.writers, version.notes | notes)
    kept = (
        table.read(version, buckets).filter(_retained(after))
        .join(stamped.select("hash"), "hash", "left_anti")
        .join(urls, "url", "left_anti")
    )
    return table.replace(version, buckets, stamped.unionByName(kept), stamped, writer, number, notes)


def compact_cache(table: KeyedTable, as_of: float, ttl: float | None = None, order: str = "line_no") -> Version:
    """Leave the live records of a cache table, over the path they are read from."""
    live = latest_live(table.read(), as_of, ttl, table.key, order)
    return table.overwrite(live.select(*table.schema.names))
