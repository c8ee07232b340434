"""Structured Streaming forms of the retained tables.

Each keeps its result in a versioned table in buckets (`sources.tables`), of which a
micro-batch rewrites the buckets of its own keys. The version notes the last batch of the
stream, named by the id in its checkpoint, so a batch that is run again is left out, and
a new checkpoint goes on from the table as it is.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from postmill.operators.retained import posting_store, stored_postings, upsert
from postmill.operators.state import latest_live, status_of
from postmill.schema import RETAIN_SECONDS, STATUS
from postmill.session import materialise
from postmill.sources.tables import BUCKETS, KeyedTable

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps for as long as its checkpoint lives."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def into_table(
    stream: DataFrame, table: KeyedTable, checkpoint: str, take: Callable[[DataFrame, str, int], object],
    mode: str = "append", **trigger,
) -> StreamingQuery:
    """Start a stream whose batches are taken in by ``take(rows, writer, number)``."""

    def step(batch: DataFrame, number: int) -> None:
        writer = stream_id(table.spark, checkpoint)
        if not table.applied(writer, number):
            take(batch, writer, number)

    return (
        stream.writeStream.outputMode(mode).foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


# The posting store.


def stream_upsert(
    stream: DataFrame, path: str, checkpoint: str, as_of: Callable[[int], str],
    retain_seconds: int = RETAIN_SECONDS, buckets: int = BUCKETS, **trigger,
) -> StreamingQuery:
    """The posting store over a stream of observed postings; a batch is a run."""
    table = posting_store(stream.sparkSession, path, buckets)
    return into_table(
        stream, table, checkpoint,
        lambda fresh, writer, n: upsert(table, fresh, as_of(n), retain_seconds, writer, n), **trigger,
    )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return stored_postings(posting_store(spark, path))


# Live records.


class LiveRecords(StatefulProcessor):
    """Records of a key that can yet be its latest live one.

    A record is passed over for good when a newer one lives at least as long, so what is
    kept lives the longer the older it is. A timer at the first expiry drops what is over
    on the stream's clock, processing time plus ``skew`` seconds.
    """

    def __init__(self, schema: T.StructType, key: str, order: str, ttl: float | None, skew: float) -> None:
        self.schema, self.key, self.order, self.ttl, self.skew = schema, key, order, ttl, skew
        self.at = schema.names.index(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.records = handle, handle.getListState("records", self.schema)

    def _expiry(self, record: tuple) -> float:
        named = dict(zip(self.schema.names, record))
        limit = self.ttl if named["_ttl"] is None else named["_ttl"]
        return float("inf") if limit is None else (named["_ts"] or 0.0) + limit

    def _settled(self, key: tuple, records: list[tuple]) -> Row:
        kept, longest = [], float("-inf")
        for record in sorted(records, key=lambda r: r[self.at], reverse=True):
            if self._expiry(record) > longest:
                kept.append(record)
                longest = self._expiry(record)
        kept.reverse()
        if kept:
            self.records.put(kept)
            first = min(map(self._expiry, kept))
            if first != float("inf"):
                self.handle.registerTimer(int((first - self.skew) * 1000) + 1)
        else:
            self.records.clear()
        return Row(**{self.key: key[0], "records": [tuple(r) for r in kept]})

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = [tuple(r) for r in self.records.get()] if self.records.exists() else []
        yield self._settled(key, known + [tuple(r[c] for c in self.schema.names) for r in rows])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs() / 1000 + self.skew
        known = [tuple(r) for r in self.records.get()] if self.records.exists() else []
        live = [r for r in known if self._expiry(r) >= now]
        if len(live) < len(known):
            yield self._settled(key, live)


def _live_table(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = BUCKETS) -> KeyedTable:
    held = T.StructType([schema[key], T.StructField("records", T.ArrayType(_record(schema, key)))])
    return KeyedTable(spark, path, held, key, buckets)


def _record(schema: T.StructType, key: str) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != key])


def stream_latest_live(
    stream: DataFrame, path: str, checkpoint: str, ttl: float | None = None, key: str = "_key",
    order: str = "line_no", skew: float = 0.0, buckets: int = BUCKETS, **trigger,
) -> StreamingQuery:
    """Live cache entries over a stream of log records, as `latest_live` has them of the whole log.

    Spark's state holds, for each key, the records that can still be its latest live one;
    a batch reads and writes its own keys only. ``skew`` sets the clock by which state is
    dropped apart from processing time, for logs of another time; results are read for
    any moment not before that clock by ``read_live``.
    """
    spark = stream.sparkSession
    table = _live_table(spark, path, stream.schema, key, buckets)
    processor = LiveRecords(_record(stream.schema, key), key, order, ttl, skew)
    changed = stream.filter(F.col(key).isNotNull()).groupBy(key).transformWithState(
        processor, table.schema, "Update", "ProcessingTime"
    )
    # A query keeps the settings that it was started with. Where it is to end with its data,
    # timers are looked at in batches with data only: there is always one that is still due.
    settings = {PROVIDER: ROCKS, EMPTY_BATCHES: str("processingTime" in trigger).lower()}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        return into_table(
            changed, table, checkpoint,
            lambda rows, writer, n: table.merge(materialise(rows, "batch"), F.size("records") == 0, writer, n),
            mode="update", **trigger,
        )
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def read_live(
    spark: SparkSession, path: str, schema: T.StructType, as_of: float, ttl: float | None = None,
    key: str = "_key", order: str = "line_no",
) -> DataFrame:
    """Live entries at a moment, in the log's columns."""
    held = _live_table(spark, path, schema, key).read()
    log = held.select(key, F.explode("records").alias("r")).select(key, "r.*").select(*schema.names)
    return latest_live(log, as_of, ttl, key, order).select(*schema.names)


# Source status.


def _status_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeyedTable:
    return KeyedTable(spark, path, STATUS, "source", buckets)


def stream_status(
    stream: DataFrame, path: str, checkpoint: str, order=None, buckets: int = BUCKETS, **trigger,
) -> StreamingQuery:
    """Source status over a stream of run outcomes: an aggregation in Spark's own state.

    A batch hands on the status of the sources that ran in it, and only these are written.
    """
    table = _status_table(stream.sparkSession, path, buckets)
    return into_table(
        status_of(stream, order), table, checkpoint,
        lambda rows, writer, n: table.merge(materialise(rows, "batch"), None, writer, n), mode="update", **trigger,
    )


def read_status(spark: SparkSession, path: str) -> DataFrame:
    return _status_table(spark, path).read()
