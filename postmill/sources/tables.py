"""Tables whose versions are files that never change and a manifest that names them.

A table is a folder. Data is written under names of its own; a version comes into being
when its manifest is renamed to the next number, which fails if that number is taken. A
reader takes the newest manifest, so it sees the version before or the one after, and a
run that ends before the rename leaves the old one as it was. Rows lie in buckets by a
hash of their key, and a change rewrites only the buckets that it touches; the others go
on into the next manifest. `vacuum` deletes what no kept manifest names.

A writer that may be run again for the same change (a micro-batch) gives its name and a
number that rises; a version notes the last number of every writer, and a change that was
taken in before is left out.

All paths are reached through Spark's own file systems, so a table may lie in any store
that has an exclusive rename.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.session import fresh_path

#: Buckets of a new table. Take about one for each 100 MB that it will hold.
BUCKETS = 32
#: Files of a bucket of an index from which appending writes it anew.
LOOSE = 16


class Conflict(RuntimeError):
    """Somebody else made the next version first."""


class Folder:
    """Names, renames and deletes in the file system of a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.files = self.hadoop.Path(self.path).getFileSystem(self.conf)

    def _at(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self.files.listStatus(at)) if self.files.exists(at) else []

    def read(self, name: str) -> str:
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]

    def publish(self, name: str, text: str) -> None:
        """Write a file whole or not at all; raise ``Conflict`` if there is one."""
        draft = f"_draft-{uuid.uuid4().hex}"
        out = self.files.create(self._at(draft))
        out.write(bytearray(text.encode()))
        out.close()
        try:
            self.rename(draft, name)
        except Conflict:
            self.delete(draft)
            raise

    def rename(self, name: str, new: str) -> None:
        """Move a file to a name that is free; raise ``Conflict`` if it is not."""
        self.files.mkdirs(self._at(new).getParent())
        options = self.spark._sc._gateway.new_array(self.hadoop.Options.Rename, 0)
        try:
            self.hadoop.FileContext.getFileContext(self.files.getUri(), self.conf).rename(self._at(name), self._at(new), options)
        except Exception as error:
            if self.files.exists(self._at(new)):
                raise Conflict(f"{self.path}/{new}") from error
            raise

    def delete(self, name: str) -> None:
        self.files.delete(self._at(name), True)


@dataclass(frozen=True)
class Version:
    """What a manifest says; ``parts`` names the data folders of each bucket."""

    number: int = -1
    parts: dict[str, list[str]] = field(default_factory=dict)
    indexes: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    writers: dict[str, int] = field(default_factory=dict)
    notes: dict[str, object] = field(default_factory=dict)

    def folders(self) -> set[str]:
        tables = [self.parts, *self.indexes.values()]
        return {f for table in tables for listed in table.values() for f in listed}


class KeyedTable:
    """Rows with a key in a versioned table.

    ``indexes`` names columns by which keys are looked up without reading the rows: for
    each an index of (column, key) lies in buckets by the column. It is only added to; an
    entry whose row is gone leads nowhere, and a bucket with many files is written anew.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = BUCKETS,
        indexes: Iterable[str] = (),
    ) -> None:
        self.spark, self.schema, self.key, self.buckets = spark, schema, key, buckets
        self.indexes, self.folder = tuple(indexes), Folder(spark, path)

    # Versions.

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.folder.names("versions") if n.endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        """A version, by default the newest; one without rows if there is none."""
        numbers = self.numbers()
        if number is None:
            number = numbers[-1] if numbers else -1
        if number < 0:
            return Version(notes={"buckets": self.buckets})
        return Version(**json.loads(self.folder.read(f"versions/{number:012d}.json")))

    def commit(self, version: Version) -> Version:
        self.folder.publish(f"versions/{version.number:012d}.json", json.dumps(version.__dict__))
        return version

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the ``keep`` newest versions and what only they name; returns how many folders went.

        Not to be run while a writer is at work: its data has no manifest yet.
        """
        numbers = self.numbers()
        live = set().union(*(self.version(n).folders() for n in numbers[-keep:])) if numbers else set()
        for n in numbers[:-keep]:
            self.folder.delete(f"versions/{n:012d}.json")
        gone = 0
        for run in self.folder.names("data"):
            parts = [f"data/{run}/{p}" for p in self.folder.names(f"data/{run}") if p.startswith("_bucket=")]
            dead = [p for p in parts if p not in live]
            gone += len(dead)
            for name in [f"data/{run}"] if len(dead) == len(parts) else dead:
                self.folder.delete(name)
        return gone

    # Reading.

    def bucket(self, column: Column | str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")

    def _load(self, folders: Iterable[str], schema: T.StructType) -> DataFrame:
        paths = sorted(f"{self.folder.path}/{f}" for f in set(folders))
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self, version: Version | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version, of some buckets or of all."""
        parts = (version or self.version()).parts
        wanted = parts if buckets is None else {str(b) for b in buckets} & set(parts)
        return self._load((f for b in wanted for f in parts[b]), self.schema)

    def touched(self, rows: DataFrame, column: str, version: Version) -> list[int]:
        """Buckets that the values of a column fall in; at most as many as there are."""
        found = rows.select(self.bucket(column, version.notes["buckets"]).alias("b")).distinct()
        return sorted(r["b"] for r in found.collect())

    def _index_schema(self, name: str) -> T.StructType:
        return T.StructType([self.schema[name], self.schema[self.key]])

    def keys_with(self, values: DataFrame, name: str, version: Version) -> DataFrame:
        """Keys that rows with one of ``values`` have, or had once, from the index of ``name``."""
        index = version.indexes.get(name, {})
        met = [f for b in self.touched(values, name, version) for f in index.get(str(b), [])]
        entries = self._load(met, self._index_schema(name))
        return entries.join(values.select(name).distinct(), name, "left_semi").select(self.key).distinct()

    # Writing.

    def _write(self, rows: DataFrame, column: str, version: Version) -> dict[str, list[str]]:
        """Rows written in buckets by ``column``: the folder of each bucket that has rows."""
        run = f"data/{uuid.uuid4().hex}"
        (
            rows.withColumn("_bucket", self.bucket(column, version.notes["buckets"]))
            .repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder.path}/{run}")
        )
        names = [n for n in self.folder.names(run) if n.startswith("_bucket=")]
        return {n.removeprefix("_bucket="): [f"{run}/{n}"] for n in names}

    def applied(self, writer: str | None, number: int, version: Version | None = None) -> bool:
        """Whether a writer's change was taken in before."""
        return writer is not None and (version or self.version()).writers.get(writer, -1) >= number

    def replace(
        self, version: Version, buckets: Iterable[int], rows: DataFrame, added: DataFrame | None = None,
        writer: str | None = None, number: int = 0, notes: dict | None = None,
    ) -> Version:
        """The next version: ``rows`` are all rows of ``buckets``. ``added`` are those new to the indexes."""
        parts = {b: f for b, f in version.parts.items() if int(b) not in set(buckets)}
        written = self._write(rows.select(*self.schema.names), self.key, version)
        strange = set(written) - {str(b) for b in buckets}
        if strange:
            raise ValueError(f"rows of other buckets: {sorted(strange)}")
        indexes = {name: {b: list(f) for b, f in version.indexes.get(name, {}).items()} for name in self.indexes}
        for name in self.indexes if added is not None else ():
            new = self._write(added.select(name, self.key).distinct(), name, version)
            for b, folders in new.items():
                indexes[name].setdefault(b, []).extend(folders)
            full = {b: f for b, f in indexes[name].items() if len(f) > LOOSE}
            if full:
                merged = self._load((f for fs in full.values() for f in fs), self._index_schema(name)).distinct()
                indexes[name].update(self._write(merged, name, version))
        writers = version.writers | ({writer: number} if writer is not None else {})
        return self.commit(Version(version.number + 1, parts | written, indexes, writers, version.notes | (notes or {})))

    def overwrite(self, rows: DataFrame, notes: dict | None = None) -> Version:
        """A version of ``rows`` alone, which may be made from the version before."""
        version = self.version()
        every = range(version.notes["buckets"])
        return self.replace(version, every, rows, rows if self.indexes else None, notes=notes)

    def merge(
        self, changes: DataFrame, dead: Column | None = None, writer: str | None = None, number: int = 0,
    ) -> Version:
        """Rows of ``changes`` take the place of those with their key; keys must be unique in it.

        Changes for which ``dead`` holds only take their key's row away.
        """
        version = self.version()
        if self.applied(writer, number, version):
            return version
        buckets = self.touched(changes, self.key, version)
        if not buckets:
            return version
        kept = self.read(version, buckets).join(changes.select(self.key), self.key, "left_anti")
        new = changes if dead is None else changes.filter(~dead)
        new = new.select(*self.schema.names)
        return self.replace(version, buckets, new.unionByName(kept), new if self.indexes else None, writer, number)



def in_buckets(df: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """``df`` written in buckets by ``key``, so that joins on the key leave its rows where they are.

    The rows are sorted by the key in each bucket and lie in the shared folder; the name
    in the catalog is only needed while the table is looked up.
    """
    spark, name = df.sparkSession, f"buckets_{uuid.uuid4().hex}"
    (
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        .option("path", fresh_path(spark, "buckets")).saveAsTable(name)
    )
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
