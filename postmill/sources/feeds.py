"""Custom sources as Spark data sources: posting feeds in numbered parts.

A feed knows how many parts it has by now and yields the postings of one part. Under a
registered name it is read as a batch (`spark.read.format(name)`), each part by a task of
its own, and as a stream (`spark.readStream.format(name)`), whose offset is the number of
parts taken in. A feed travels to the tasks, so it must be picklable.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from postmill.functions.text import job_hash
from postmill.schema import POSTING, REQUIRED

#: Postings that one part can hold before the numbers of the next begin.
PART_ROWS = 1 << 32


class Feed(ABC):
    @abstractmethod
    def parts(self) -> int:
        """How many parts there are; it never falls, and a part never changes."""

    @abstractmethod
    def rows(self, part: int) -> Iterator[Mapping[str, object]]:
        """Postings of a part by field name; the fields required are title, company, url, description, source."""


class LinesFeed(Feed):
    """Files of JSON lines in a folder, taken in the order of their names."""

    def __init__(self, path: str, suffix: str = ".json") -> None:
        self.path, self.suffix = path, suffix

    def _files(self) -> tuple[object, list[str]]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (
            fs.LocalFileSystem(), self.path)
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return files, sorted(f.path for f in found if f.is_file and f.path.endswith(self.suffix))

    def parts(self) -> int:
        return len(self._files()[1])

    def rows(self, part: int) -> Iterator[Mapping[str, object]]:
        files, names = self._files()
        with files.open_input_stream(names[part]) as lines:
            rest = b""
            while block := lines.read(1 << 20):
                *whole, rest = (rest + block).split(b"\n")
                yield from (json.loads(line) for line in whole if line.strip())
            if rest.strip():
                yield json.loads(rest)


def as_posting(row: Mapping[str, object], number: int) -> tuple:
    """A row's fields in the order of the schema; other fields are ignored, missing ones null."""
    missing = [f for f in REQUIRED if f != "hash" and row.get(f) is None]
    if missing:
        raise ValueError(f"posting lacks {', '.join(missing)}")
    values = dict(row)
    pay = values.get("compensation")
    if isinstance(pay, str):
        values["compensation"], values["compensation_raw"] = None, pay
    elif isinstance(pay, Mapping):
        values["compensation"] = tuple(pay.get(f.name) for f in POSTING["compensation"].dataType)
    values.setdefault("last_seen_at", "")
    values["ord"] = number
    return tuple(values.get(f.name) for f in POSTING)


class _Part(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class _Reading:
    def __init__(self, feed: Feed) -> None:
        self.feed = feed

    def read(self, partition: _Part | None) -> Iterator[tuple]:
        if partition is None:  # what a reader without partitions is asked for
            return
        for k, row in enumerate(self.feed.rows(partition.number)):
            yield as_posting(row, partition.number * PART_ROWS + k)


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[_Part]:
        return [_Part(k) for k in range(self.feed.parts())]


class _Stream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"parts": 0}

    def latestOffset(self) -> dict:
        return {"parts": self.feed.parts()}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        return [_Part(k) for k in range(start["parts"], end["parts"])]


def register_feed(spark: SparkSession, name: str, feed: Feed) -> None:
    """Make ``feed`` readable under ``name`` in this session."""

    class Postings(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> T.StructType:
            return POSTING

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return _Batch(feed)

        def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
            return _Stream(feed)

    spark.dataSource.register(Postings)


def with_hash(postings: DataFrame) -> DataFrame:
    """Postings of a feed, those without a hash given theirs."""
    return postings.withColumn("hash", F.coalesce("hash", job_hash("title", "company", "description")))


def read_feed(spark: SparkSession, name: str) -> DataFrame:
    return with_hash(spark.read.format(name).load())


def stream_feed(spark: SparkSession, name: str) -> DataFrame:
    return with_hash(spark.readStream.format(name).load())
