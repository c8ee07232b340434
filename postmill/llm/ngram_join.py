"""N-gram Jaccard join: prefix filters under several token orders, intersected, then exact sets.

A text's set is its distinct n-word shingles (`[^\\x20\\x09-\\x0D]+` words, A-Z folded).
A pair that reaches the wanted similarity shares at least `need(size)` tokens of either
set. So under *any* order of all tokens the first `size - need + k` tokens of both share
at least k. Three orders are used, and a pair must pass all of them:

1. a hash order: the first `wide` tokens of both must share several;
2. among those, rare tokens first, by their exact counts in all such lists: the first
   `rare` must share one. Most tokens are met in one class only, which leaves few pairs;
3. another hash order over the whole sets, tried on pairs before they are compared.

Defined cases: a null or empty text, or one without words, has an empty set and no
link. A text of fewer than n words has one shingle, its whole sequence. Equal sets are
one class and linked at once, however many rows share it; identical rows get identical
results. A null id takes no part in the smallest id of its component. Other columns are
ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from postmill.llm.buffers import WordHasher, mix, shingle_sets
from postmill.llm.components import components
from postmill.session import materialise

#: Length of the first list over the shortest possible one.
WIDE = 2
#: Classes sharing a token from which they are compared in blocks, not as pairs.
LARGE = 64
#: Classes, and tokens of theirs, that a block holds on average at most.
BLOCK_CLASSES = 1024
BLOCK_TOKENS = 1 << 20

# Salts of the two hash orders.
ORDER_SALTS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that a set of n shares at least with a similar one."""
    return -(-n * percent // 100)


def wide_length(n: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(n, WIDE * (n - _need(n, percent) + 1))


def rare_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of the rare-first order: enough for the smallest set a partner can have."""
    low = _need(n, percent)
    shared = wide_length(low, percent) - low + _need(low, percent)
    return wide_length(n, percent) - shared + 1


def _digests(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set: the sum of mixed tokens, mixed with its size."""
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(mix(sets ^ np.uint64(0xD6E8FEB86659FD93)))]
        size = np.diff(bounds).astype(np.uint64)
        return mix(sums[bounds[1:]] - sums[bounds[:-1]] + size).view(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64)))


def _first_by_hash(sets: np.ndarray, size: np.ndarray, take: np.ndarray, salt: int) -> pa.Array:
    """Of each set the first ``take`` tokens under the hash order of ``salt``."""
    doc = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(sets)) - np.repeat(np.cumsum(size) - size, size)
    order = np.lexsort((mix(sets ^ np.uint64(salt)), doc))
    return _lists(sets[order][place < take[doc]], take)


def class_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, text_hash, n, cls, wide, rare, tokens): a row per text.

    The first list is given once by each task for a class, and empty otherwise.
    """
    id_type = docs.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), set()
        for batch in batches:
            for lo, hi, bounds, sets in shingle_sets(batch.column("text"), hasher, words):
                size, cls = np.diff(bounds).astype(np.int64), _digests(sets, bounds)
                new = np.zeros(hi - lo, bool)
                for k, c in enumerate(cls.tolist()):
                    if c not in seen:
                        seen.add(c)
                        new[k] = True
                wide = wide_length(size, percent)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(lo, hi - lo), batch.column("text_hash").slice(lo, hi - lo),
                    pa.array(size), pa.array(cls), pa.array(wide), pa.array(rare_length(size, percent)),
                    _first_by_hash(sets, size, np.where(new, wide, 0), ORDER_SALTS[0]),
                ], names=["id", "text_hash", "n", "cls", "wide", "rare", "tokens"])

    return docs.mapInArrow(
        work, f"id {id_type}, text_hash long, n long, cls long, wide long, rare long, tokens array<long>"
    )


def _sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(cls, tokens, second): whole sets, and their prefix under the last order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for _, _, bounds, sets in shingle_sets(batch.column("text"), hasher, words):
                size = np.diff(bounds).astype(np.int64)
                take = np.where(size > 0, size - _need(size, percent) + 1, 0)
                yield pa.RecordBatch.from_arrays([
                    pa.array(_digests(sets, bounds)), _lists(sets, size),
                    _first_by_hash(sets, size, take, ORDER_SALTS[1]),
                ], names=["cls", "tokens", "second"])

    return docs.select("text").mapInArrow(work, "cls long, tokens array<long>, second array<long>")


def _near(a: Column, b: Column, percent: int) -> Column:
    """Sizes that leave the wanted similarity possible."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the last order, then the exact comparison."""

    def side(key: str, name: str) -> DataFrame:
        return sets.select(F.col("cls").alias(key), F.col(name).alias(f"{name}_{key}"))

    met = (
        pairs.join(side("a", "second"), "a").join(side("b", "second"), "b")
        .filter(F.arrays_overlap("second_a", "second_b")).select("a", "b")
    )
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    union = F.size("tokens_a") + F.size("tokens_b") - shared
    return (
        met.join(side("a", "tokens"), "a").join(side("b", "tokens"), "b")
        .filter(shared.cast("long") * 100 >= union.cast("long") * percent).select("a", "b")
    )


def _groups(found: DataFrame) -> DataFrame:
    """(token, cls, n, k): the k classes that share a token of the rare-first order."""
    posts = found.select("cls", "n", "wide", "rare", F.explode("tokens").alias("token"))
    counts = posts.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1")
    # Tokens met once come first in the order; only their number matters.
    within = Window.partitionBy("cls")
    met = posts.join(counts, "token").repartition("cls").distinct()
    rare = (
        met.withColumns({
            "single": F.col("wide") - F.count("*").over(within),
            "at": F.row_number().over(within.orderBy("k", "token")),
        })
        .filter("single + at <= rare").select("token", "cls", "n")
    )
    rare = materialise(rare, "rare")
    shared = rare.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1")
    return materialise(rare.join(shared, "token").select("token", "cls", "n", "k"), "groups")


def _overlaps(rows: list[np.ndarray]) -> np.ndarray:
    """Common tokens of every two sets of a block."""
    size = np.array([len(r) for r in rows])
    tokens, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), size)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    times = np.diff(np.r_[first, len(tokens)])
    common = np.zeros((len(rows), len(rows)), np.int32)
    for k in range(2, 16):  # tokens of few sets: their pairs one by one
        members = owner[first[times == k][:, None] + np.arange(k)]
        for i in range(k):
            for j in range(k):
                if i != j:
                    np.add.at(common, (members[:, i], members[:, j]), 1)
    many = first[times >= 16]
    for lo in range(0, len(many), 1024):
        held = np.zeros((len(rows), min(1024, len(many) - lo)), np.float32)
        for k, at in enumerate(many[lo : lo + 1024]):
            end = at + times[np.searchsorted(first, at)]
            held[owner[at:end], k] = 1
        common += (held @ held.T).astype(np.int32)
    return common


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what the matrix of links joins, one less than nodes for each tree."""
    waiting, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not waiting[root]:
            continue
        waiting[root], front = False, [root]
        while front:
            node = front.pop()
            near = np.flatnonzero(linked[node] & waiting)
            waiting[near] = False
            out += [(node, int(k)) for k in near]
            front += near.tolist()
    return out


def _block_links(piles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join all similar classes of each pile (cls, pile).

    Every two classes of a pile are compared, block against block, by products of
    matrices; only a forest of links leaves a task.
    """
    sizes = piles.join(sets.select("cls", F.size("tokens").alias("size")), "cls").groupBy("pile").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("size") / BLOCK_TOKENS)).alias("blocks")
    )
    placed = piles.join(sizes, "pile").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    )
    dealt = placed.select(
        "cls", "pile", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    ).join(sets.select("cls", "tokens"), "cls")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        cls, size = pdf["cls"].to_numpy(), np.array([len(t) for t in pdf["tokens"]], np.int64)
        common = _overlaps([np.asarray(t) for t in pdf["tokens"]]).astype(np.int64)
        linked = common * 100 >= percent * (size[:, None] + size[None, :] - common)
        np.fill_diagonal(linked, False)
        links = _forest(linked)
        return pd.DataFrame({"a": cls[[u for u, _ in links]], "b": cls[[v for _, v in links]]}, dtype="int64")

    return dealt.groupBy("pile", "i", "j").applyInPandas(compare, "a long, b long")


def similar_texts(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    words: int = 5, percent: int = 80,
) -> DataFrame:
    """(id, text_hash, n, cls, component, group) of every row; sets link from ``percent`` on.

    ``component`` is the smallest id of the rows reachable by links, the row's own
    included; a row with an empty set is its own component. ``group`` tells components
    apart where ids repeat; it is null for an empty set.

    Classes that share a frequent token are compared in blocks, which return links that
    join them, not all pairs. The others form pairs, fewer than ``LARGE`` for each token
    of theirs, and only across what is not joined yet. Every pair whose link could still
    matter is compared.
    """
    texts = docs.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"),
        F.xxhash64(text_column).alias("text_hash"),
    )
    found = materialise(class_rows(texts, words, percent), "classes")
    rows = found.select("id", "text_hash", "n", "cls")
    groups = _groups(found)
    # The sets of classes that are in a group, each from one of its rows.
    involved = groups.select("cls").distinct()
    chosen = (
        rows.join(involved, "cls", "left_semi").groupBy("cls")
        .agg(F.min(F.struct("text_hash", "id")).alias("row"))
        .select(F.col("row.text_hash").alias("hash_one"), F.col("row.id").alias("id_one"))
    )
    own = texts.join(
        chosen, (F.col("text_hash") == F.col("hash_one")) & F.col("id").eqNullSafe(F.col("id_one")), "left_semi"
    )
    sets = materialise(_sets(own, words, percent).dropDuplicates(["cls"]), "sets")

    # Piles: classes that frequent tokens tie together.
    large = groups.filter(F.col("k") >= LARGE)
    ties = large.join(large.groupBy("token").agg(F.min("cls").alias("low")), "token").select("cls", "low").distinct()
    piles = materialise(components(ties, "cls", "low").select(
        F.col("node").alias("cls"), F.col("component").alias("pile")), "piles")
    early = materialise(_block_links(piles, sets, percent), "links")
    joined = components(early, "a", "b")
    placed = groups.filter(F.col("k") < LARGE).join(joined.withColumnRenamed("node", "cls"), "cls", "left").select(
        "token", "cls", "n", F.coalesce("component", "cls").alias("component")
    )
    mixed = placed.groupBy("token").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi")
    ).filter("lo != hi").select("token")
    open_rows = materialise(placed.join(mixed, "token", "left_semi"), "open")

    def end(key: str) -> DataFrame:
        return open_rows.select(
            "token", F.col("cls").alias(key), F.col("n").alias(f"n_{key}"),
            F.col("component").alias(f"component_{key}"),
        )

    left, right = end("a"), end("b")
    rest = left.join(right, (left["token"] == right["token"]) & (F.col("a") < F.col("b"))
                     & (F.col("component_a") != F.col("component_b"))
                     & _near(F.col("n_a"), F.col("n_b"), percent)).select("a", "b").distinct()
    late = _linked(rest, sets, percent)
    links = materialise(early.select("a", "b").union(late), "links")

    whole = components(links, "a", "b").withColumnRenamed("node", "cls")
    classes = rows.filter("n > 0").groupBy("cls").agg(F.min("id").alias("low")).join(whole, "cls", "left")
    classes = classes.select("cls", "low", F.coalesce("component", "cls").alias("component"))
    lowest = classes.groupBy("component").agg(F.min("low").alias("lowest"))
    named = classes.join(lowest, "component").select("cls", "lowest", F.col("component").alias("group"))
    filled = rows.filter("n > 0").join(named, "cls", "left").select(
        *rows.columns, F.col("lowest").alias("component"), "group"
    )
    bare = rows.filter("n = 0").select(
        *rows.columns, F.col("id").alias("component"), F.lit(None).cast("long").alias("group")
    )
    return filled.union(bare)


def one_of_each(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    words: int = 5, percent: int = 80,
) -> DataFrame:
    """The rows of ``docs`` without near copies: one row of each component stays.

    That is the row with the smallest id (a null id last), then the smallest digest of
    its text. Of identical rows one stays; rows with an empty set all stay. The columns
    are those of ``docs``.
    """
    similar = similar_texts(docs, id_column, text_column, words, percent)
    best = similar.filter("n > 0").groupBy("group").agg(
        F.min(F.struct(F.col("id").isNull(), "id", "text_hash")).alias("best")
    )
    stay = best.select(F.col("best.id").alias("__id"), F.col("best.text_hash").alias("__hash"), F.lit(True).alias("__one"))
    bare = similar.filter("n = 0").select(
        F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.lit(False).alias("__one")
    ).distinct()
    own = docs.withColumns({"__key": F.col(id_column), "__hash": F.xxhash64(text_column)})
    kept = own.join(stay.union(bare).withColumnRenamed("__hash", "__h"),
                    F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h")))
    first = Window.partitionBy("__id", "__h").orderBy(F.xxhash64(*docs.columns))
    return (
        kept.withColumn("__at", F.row_number().over(first))
        .filter("NOT __one OR __at = 1").select(*docs.columns)
    )
