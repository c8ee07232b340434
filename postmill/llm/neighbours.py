"""Approximate nearest neighbours: shifted space-filling curves.

Vectors are reduced to distance: a coordinate that lifts all to the length of the longest
makes the largest inner product the smallest distance. Each of `CURVES` curves projects
the lifted vectors to `PLANES` random directions, scales each by its spread, shifts the
grid by a random amount and orders the vectors by their Hilbert key. Spark sorts all
curves' keys by range and numbers them; a query meets the vectors up to `SHARE` of the
table before and after it on each curve. Windows are cut into blocks, joined by block, scored with exact inner products, and merged.

Copies of a vector beyond the first `k + 1` by id can be in no list of k, as ties go to
the smaller id, and are left out of the curves; their lists are found like all others.

`SHARE` is a share, not a number: neighbours of vectors without structure are spread
over the curve, and only a window that grows with the table keeps the recall. The
README has the figures.

Defined cases: vectors that are null, empty, all zero, of another length than the table's
most frequent one or with a null or non-finite component take no part. A repeated id is
one candidate for each different vector, and is not a neighbour of itself. Fewer than k
candidates give a shorter list. Other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.operators.ranking import with_position
from postmill.session import materialise

CURVES = 6
PLANES = 3
BITS = 12
SHARE = 0.14
#: Least and most vectors of a block; in between half the reach of a window, so that a
#: query meets as many blocks at any size.
BLOCK = 1024
LARGEST_BLOCK = 65_536
#: Queries of a part, and products held at a time.
QUERIES = 4096
PRODUCTS = 1 << 21
NEAREST = 20


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert curve positions of grid cells (rows, axes), all rows at once.

    Works the standard transform from the highest bit down: inverts or exchanges the low
    bits of an axis, then applies the Gray code, then interleaves.
    """
    x = [c.copy() for c in cells.T.astype(np.uint64)]
    one = np.uint64(1)
    for bit in range(bits - 1, 0, -1):
        high, low = one << np.uint64(bit), (one << np.uint64(bit)) - one
        for k in range(len(x)):
            set_ = (x[k] & high) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[k]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[k] = x[k] ^ swap
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    flips = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        high = one << np.uint64(bit)
        flips = np.where((x[-1] & high) != 0, flips ^ (high - one), flips)
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << one) | (((axis ^ flips) >> np.uint64(bit)) & one)
    return key


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v) of the vectors that take part, in double precision."""
    v = F.col("v")
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull() & fine & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (size["n"] if size else 0)).dropDuplicates(["id", "v"])


def _keyed(rows: DataFrame, size: int, longest: float, seed: int) -> DataFrame:
    """(curve, key, id, v, asks, stays): each vector's place on every curve."""
    names = ["id", "v", "asks", "stays"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        frames = [np.linalg.qr(rng.standard_normal((size + 1, PLANES)))[0] for _ in range(CURVES)]
        shifts = rng.random((CURVES, PLANES))
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            lift = np.sqrt(np.maximum(longest**2 - (v * v).sum(axis=1), 0))
            full = np.hstack([v, lift[:, None]]) / longest
            for curve in range(CURVES):
                # Components of a direction of unit vectors spread by about 1 / sqrt(size).
                place = full @ frames[curve] * np.sqrt(size)
                share = 1 / (1 + np.exp(-1.7 * place))
                cells = (share + shifts[curve]) / 2 * (2**BITS - 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(v), curve, np.int32)), pa.array(hilbert_keys(cells, BITS).astype(np.int64)),
                    *[batch.column(c) for c in names],
                ], names=["curve", "key", *names])

    return rows.select(*names).mapInArrow(
        work, "curve int, key long, id long, v array<double>, asks boolean, stays boolean"
    )


def nearest(
    vectors: DataFrame, asks: Column, id_column: str = "vec_id", vector_column: str = "embedding",
    k: int = NEAREST, share: float = SHARE, seed: int = 11,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each query.

    ``asks`` is a condition on `id` that picks the queries.
    """
    rows = materialise(usable(vectors, id_column, vector_column).withColumn("asks", F.coalesce(asks, F.lit(False))), "vectors")
    shape = rows.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    size, longest = shape[0] or 1, float(np.sqrt(shape[1] or 1.0))
    copy = Window.partitionBy("v").orderBy("id")
    kept = rows.withColumn("copy", F.row_number().over(copy)).filter(F.col("copy") <= k + 1).drop("copy")
    kept = materialise(kept.withColumn("stays", F.lit(True)).union(
        # Further copies only ask; they have the place of their vector.
        rows.filter("asks").join(kept.select(F.col("id").alias("i"), F.col("v").alias("w")),
                                 (F.col("id") == F.col("i")) & (F.col("v") == F.col("w")), "left_anti")
        .withColumn("stays", F.lit(False))
    ), "kept")
    total, n_asked = kept.agg(F.count("*"), F.sum(F.col("asks").cast("long"))).first()
    placed = materialise(
        with_position(_keyed(kept, size, longest, seed), ["curve", "key", "id"], "at", start=0)
        .withColumn("at", F.col("at") - F.col("curve").cast("long") * total),
        "curves",
    )
    reach = max(int(np.ceil(share * total)), 2 * k)
    block = min(max(BLOCK, reach // 2), LARGEST_BLOCK)
    low, high = F.greatest(F.col("at") - reach, F.lit(0)), F.least(F.col("at") + reach, F.lit(max(total - 1, 0)))
    # A block's queries are dealt to parts of bounded size; each part gets the block.
    parts = max(1, -(-(n_asked or 0) * (2 * reach + 2 * block) // (max(total, 1) * QUERIES)))
    asked = placed.filter("asks").select(
        "curve", F.explode(F.sequence(F.floor(low / block), F.floor(high / block))).alias("block"),
        F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), "id", "v",
    )
    held = placed.filter("stays").select(
        "curve", F.floor(F.col("at") / block).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "id", "v",
    )

    def score(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if not len(queries) or not len(found):
            return out[0]
        table, names = np.stack(found["v"].to_numpy()), found["id"].to_numpy()
        some_of = max(1, PRODUCTS // len(table))
        for lo in range(0, len(queries), some_of):
            some = queries.iloc[lo : lo + some_of]
            who, ask = some["id"].to_numpy(), np.stack(some["v"].to_numpy())
            # Equal vectors must tie: the last digits of a product of matrices may differ.
            rough = np.round(ask @ table.T, 12)
            rough[who[:, None] == names[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(names, rough.shape), -rough))[:, :k]
            keep = (np.take_along_axis(rough, order, axis=1) > -np.inf).ravel()
            exact = (ask[:, None, :] * table[order]).sum(axis=2)
            out.append(pd.DataFrame({
                "query_id": np.repeat(who, order.shape[1])[keep], "vec_id": names[order].ravel()[keep],
                "score": exact.ravel()[keep],
            }))
        return pd.concat(out)

    keys = ["curve", "block", "part"]
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(
        score, "query_id long, vec_id long, score double"
    )
    met = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
