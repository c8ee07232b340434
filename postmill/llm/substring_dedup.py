"""Substring dedup: word runs met elsewhere, by compressed FM-indexes of shards.

A window is `WINDOW` consecutive words (`[^\\x20\\x09-\\x0D]+`, unchanged) of one text. Every
word goes that is covered by a window whose words also start anywhere else, in the same
text or another. Windows are judged on the input.

1. Every window is anchored at its least hashed run of `ANCHOR` words, the first of equals;
   equal windows have equal anchors. Neighbouring windows with one anchor are a passage.
   Anchors met once in the corpus end here: none of their windows is met elsewhere.
2. Passages are collapsed by anchor and digest, and of each one place is cut from its
   text; how often it was met is kept as one or more. Shards are hashes of anchors, about
   `SHARD` words each, so all passages that can share a window are in one shard.
3. A task indexes its shard (`fm_index`), each passage once and those met more than once
   marked as two places, and streams the passages against it: backward search over the
   wavelet matrix gives their matching statistics, and runs of `WINDOW` words or more met
   in two places are reported.
4. Reported runs go back to every place of their passage and are joined to the texts.

An anchor with more than `HOT` different passages (a common passage in different
surroundings) would make a shard too large. Its passages are cut into single windows,
which are their own anchors and collapse until each is there once.

Words are compared as 64-bit hashes, passages by anchor and digest, 128 bits.

Defined cases: a null text has no words and stays null; an empty one stays empty. A text
of fewer than `WINDOW` words keeps them all. Rows with the same id and text are different
places, so a text that two rows share goes from both, but for what has no window. A null
id is an id. Words that stay are joined by one space where something went; a text that
loses nothing is unchanged. Other columns are kept, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.buffers import WordHasher, column_bytes, mix, runs
from postmill.llm.fm_index import FMIndex
from postmill.session import materialise

WINDOW = 35
ANCHOR = 10
#: Words of a shard, on average.
SHARD = 1 << 20
#: Most different passages of an anchor that are indexed as they are.
HOT = 4096

_PLACES = "array<struct<anchor: long, digest: long, at: int, n: int, copies: int>>"
_PASSAGES = "anchor long, digest long, copies int, words array<long>, of_anchor long, of_digest long, skip int"


class Ranges:
    """64-bit digests of word ranges of one array, from running sums."""

    def __init__(self, words: np.ndarray) -> None:
        base = np.uint64(0x9E3779B97F4A7C15)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.r_[np.uint64(1), np.full(len(words), base)])
            self.inverses = np.cumprod(np.r_[np.uint64(1), np.full(len(words), inverse)])
            self.sums = np.r_[np.uint64(0), np.cumsum(words * powers[:-1])]

    def digest(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[begin]) * self.inverses[begin] + (end - begin).astype(np.uint64))


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """For every range of ``width`` neighbours the place of its least value, the first of equals."""
    at, reach = np.arange(len(values)), 1

    def less(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(values[right] < values[left], right, left)

    while 2 * reach <= width:
        at, reach = less(at[: len(at) - reach], at[reach:]), 2 * reach
    rest = width - reach
    return less(at[: len(at) - rest], at[rest:]) if rest else at


def passages(doc: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """(begin, end, anchor, digest) of the passages of a run of texts, as places in ``words``."""
    if len(words) < WINDOW:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    ranges, starts = Ranges(words), np.arange(len(words) - ANCHOR + 1)
    grams = ranges.digest(starts, starts + ANCHOR)
    least = first_least(grams, WINDOW - ANCHOR + 1)
    window = np.flatnonzero(doc[: len(least)] == doc[WINDOW - 1 :])
    least = least[window]
    new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (window[1:] != window[:-1] + 1)][: len(window)])
    last = np.r_[new[1:], len(window)][: len(new)] - 1
    begin, end = window[new], window[last] + WINDOW
    return begin, end, grams[least[new]].view(np.int64), ranges.digest(begin, end).view(np.int64)


def _places(docs: DataFrame) -> DataFrame:
    """(id, hash, anchor, digest, at, n) of every passage of ``docs`` (id, hash, text)."""
    id_type = docs.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(fold=False)
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for lo, hi in runs(offsets):
                doc, words = hasher.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                begin, end, anchor, digest = passages(doc, words)
                own = doc[begin]
                at = begin - np.searchsorted(doc, own)
                row = pa.array(own + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(row), batch.column("hash").take(row), pa.array(anchor), pa.array(digest),
                     pa.array(at.astype(np.int32)), pa.array((end - begin).astype(np.int32))],
                    names=["id", "hash", "anchor", "digest", "at", "n"],
                )

    return docs.mapInArrow(work, f"id {id_type}, hash long, anchor long, digest long, at int, n int")


def _cut(texts: DataFrame) -> DataFrame:
    """The passages of ``texts`` (id, hash, text, places, hot) with their words, those of hot anchors as windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(fold=False), set()
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            columns = [batch.column(c).to_pylist() for c in ("id", "hash", "places")]
            rows: list[tuple] = []
            held = 0
            for k, (name, digest, places) in enumerate(zip(*columns)):
                # Rows that are alike are cut once a task.
                if (name, digest) in seen:
                    continue
                seen.add((name, digest))
                part = data[offsets[k] : offsets[k + 1]]
                words = hasher.words(part, np.array([0, len(part)]))[1]
                ranges = Ranges(words) if any(p["hot"] for p in places) else None
                for p in places:
                    own = words[p["at"] : p["at"] + p["n"]].view(np.int64)
                    if not p["hot"]:
                        rows.append((p["anchor"], p["digest"], p["copies"], own, None, None, 0))
                        held += len(own)
                        continue
                    starts = np.arange(len(own) - WINDOW + 1)
                    keys = ranges.digest(starts + p["at"], starts + p["at"] + WINDOW).view(np.int64).tolist()
                    for skip, key in enumerate(keys):
                        rows.append((key, key, p["copies"], own[skip : skip + WINDOW], p["anchor"], p["digest"], skip))
                    held += WINDOW * len(keys)
                if held > 1 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        anchor, digest, copies, words, of_anchor, of_digest, skip = zip(*rows)
        offsets = np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(words)))
        longs = [pa.array(c, pa.int64()) for c in (anchor, digest, of_anchor, of_digest)]
        return pa.RecordBatch.from_arrays(
            [longs[0], longs[1], pa.array(copies, pa.int32()), lists, longs[2], longs[3], pa.array(skip, pa.int32())],
            names=["anchor", "digest", "copies", "words", "of_anchor", "of_digest", "skip"],
        )

    return texts.mapInArrow(work, _PASSAGES)


def indexed(table: pa.Table) -> pa.Table:
    """(anchor, digest, runs): what an index of one shard reports of its passages."""
    keys = np.stack([table.column(c).to_numpy() for c in ("anchor", "digest")])
    # A passage may have been cut by several tasks.
    _, first = np.unique(keys, axis=1, return_index=True)
    own = table.take(pa.array(first)).combine_chunks()
    copies, lists = own.column("copies").to_numpy(), own.column("words").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    sizes = np.diff(lists.offsets.to_numpy())
    words, bounds = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.r_[0, np.cumsum(sizes)]
    index = FMIndex(words, bounds.astype(np.int64), copies > 1)
    text, lo, hi = index.repeats(words, bounds, WINDOW)
    order = np.lexsort((lo, text))
    text, lo, hi = text[order], lo[order], hi[order]
    met, begin = np.unique(text, return_index=True)
    pairs = pa.StructArray.from_arrays([pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["lo", "hi"])
    runs_of = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(text)].astype(np.int32)), pairs)
    chosen = own.take(pa.array(met))
    return pa.table({"anchor": chosen.column("anchor"), "digest": chosen.column("digest"), "runs": runs_of})


def _same(frame: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """``frame`` joined to ``other`` by id, which may be null, and hash."""
    named = other.withColumnsRenamed({"id": "__i", "hash": "__h"})
    on = F.col("id").eqNullSafe(F.col("__i")) & (F.col("hash") == F.col("__h"))
    return frame.join(named, on, how).drop("__i", "__h")


def repeats(docs: DataFrame) -> DataFrame:
    """(id, hash, runs): word ranges of each text of ``docs`` (id, hash, text) that are met elsewhere."""
    placed = materialise(_places(docs.select("id", "hash", "text").filter("text IS NOT NULL")), "places")
    # Stored, so that the join below deals both sides anew and Spark can split a hot anchor.
    again = materialise(placed.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1").select("anchor"), "anchors")
    live = materialise(placed.join(again, "anchor", "left_semi"), "live")
    kinds = materialise(
        live.groupBy("anchor", "digest").agg(
            F.min(F.struct("id", "hash", "at", "n")).alias("place"), F.least(F.count("*"), F.lit(2)).cast("int").alias("copies")
        ),
        "passages",
    )
    hot = kinds.groupBy("anchor").agg(F.count("*").alias("k")).filter(F.col("k") > HOT).select("anchor", F.lit(True).alias("hot"))
    wanted = (
        kinds.join(hot, "anchor", "left")
        .withColumn("hot", F.coalesce("hot", F.lit(False)))
        .groupBy(F.col("place.id").alias("id"), F.col("place.hash").alias("hash"))
        .agg(F.collect_list(F.struct("anchor", "digest", "place.at", "place.n", "copies", "hot")).alias("places"))
    )
    cut = materialise(_cut(_same(docs.select("id", "hash", "text"), wanted)), "cut")
    windows = cut.filter("of_anchor IS NOT NULL")
    units = cut.filter("of_anchor IS NULL").select("anchor", "digest", "copies", "words").unionByName(
        windows.groupBy("anchor", "digest").agg(
            F.least(F.sum("copies"), F.lit(2)).cast("int").alias("copies"), F.first("words").alias("words"))
    )
    total = kinds.agg(F.sum(F.col("place.n") * F.col("copies"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("anchor"), F.lit(-(-total // SHARD) or 1)).alias("shard")
    found = materialise(
        units.select(shard, "anchor", "digest", "copies", "words").groupBy("shard").applyInArrow(
            indexed, "anchor long, digest long, runs array<struct<lo: int, hi: int>>"
        ),
        "found",
    )
    lifted = windows.join(found.select("anchor", "digest"), ["anchor", "digest"], "left_semi").select(
        F.col("of_anchor").alias("anchor"), F.col("of_digest").alias("digest"),
        F.array(F.struct(F.col("skip").alias("lo"), (F.col("skip") + WINDOW).cast("int").alias("hi"))).alias("runs"),
    )
    own = live.join(found.unionByName(lifted), ["anchor", "digest"])
    moved = own.select("id", "hash", "at", F.explode("runs").alias("run")).select(
        "id", "hash", F.struct((F.col("at") + F.col("run.lo")).alias("lo"), (F.col("at") + F.col("run.hi")).alias("hi")).alias("run")
    )
    return moved.groupBy("id", "hash").agg(F.collect_set("run").alias("runs"))


def _kept(data: np.ndarray, starts: np.ndarray, hasher: WordHasher, cuts: list) -> Iterator[tuple[int, int, bytes]]:
    """(words, removed words, kept words joined by one space) of every text of a run."""
    data = np.insert(data, starts[1:], 0x20)
    starts = starts + np.arange(len(starts))
    begin, end = hasher.spans(data, starts)
    first = np.searchsorted(begin, starts)
    gone = np.zeros(len(begin) + 1, np.int64)
    for k, ranges in enumerate(cuts):
        for r in ranges or ():
            gone[first[k] + r["lo"]] += 1
            gone[first[k] + r["hi"]] -= 1
    stays = np.cumsum(gone[:-1]) == 0
    edge = np.zeros(len(data) + 1, np.int8)
    edge[begin[stays]] = 1
    edge[end[stays] + 1] -= 1
    kept = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    stream = np.where(hasher.space[data], np.uint8(0x20), data)[kept]
    sizes = np.r_[0, np.cumsum(np.where(stays, end - begin + 1, 0))]
    left = np.r_[0, np.cumsum(stays)]
    for k in range(len(starts) - 1):
        lo, hi = sizes[first[k]], sizes[first[k + 1]]
        words = int(first[k + 1] - first[k])
        yield words, words - int(left[first[k + 1]] - left[first[k]]), stream[lo : max(hi - 1, lo)].tobytes()


def _kept_column(whole: bool) -> Column:
    """A struct (n_words, n_removed, kept) of a text and its runs; `kept` is the words, or else their hash."""
    kind = "string"

    @F.arrow_udf(f"struct<n_words: long, n_removed: long, kept: {kind}>")
    def kept(text: pa.Array, cuts: pa.Array) -> pa.Array:
        hasher, rows = WordHasher(fold=False), []
        data, offsets = column_bytes(text)
        lists = cuts.to_pylist()
        for lo, hi in runs(offsets):
            part = data[offsets[lo] : offsets[hi]]
            for n, removed, words in _kept(part, offsets[lo : hi + 1] - offsets[lo], hasher, lists[lo:hi]):
                rows.append((n, removed, words.decode() if whole else hashlib.sha256(words).hexdigest()))
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.StructArray.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))],
            names=["n_words", "n_removed", "kept"],
        )

    return kept("__text", "__runs")


def _with_runs(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``docs`` with `__text` and `__runs`, null where nothing goes."""
    own = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("hash"), F.col(text_column).alias("text"))
    found = repeats(own).select(F.col("id").alias("__i"), F.col("hash").alias("__h"), F.col("runs").alias("__runs"))
    keyed = docs.withColumns({"__id": F.col(id_column), "__hash": F.xxhash64(text_column), "__text": F.col(text_column)})
    return keyed.join(found, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h")), "left")


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the text, and its length if there is such a column, without runs met elsewhere."""
    found = _with_runs(docs, id_column, text_column)
    text = F.when(F.col("__runs").isNull(), F.col(text_column)).otherwise(F.col("__kept.kept"))
    new = {text_column: F.col("__new"), "n_chars": F.length("__new").cast("long")}
    return found.withColumn("__kept", _kept_column(True)).withColumn("__new", text).select(
        *[new[c].alias(c) if c in new else F.col(c) for c in docs.columns]
    )


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row: its words, those that go, a hash of those left."""
    found = _with_runs(docs.select(id_column, text_column), id_column, text_column)
    return found.withColumn("kept", _kept_column(False)).select(
        F.col("__id").alias("id"), "kept.n_words", "kept.n_removed", F.col("kept.kept").alias("kept_sha256")
    )
