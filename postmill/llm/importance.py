"""Importance resampling towards a target text: hashed n-gram counts, weights, a keyed draw.

Features of a text are its runs of one to three consecutive words (A-Z folded; digits,
letters and everything beyond ASCII make words), each hashed to a bucket by the CRC-32 of
its words joined by one space. The CRCs come from prefixes: `prefix_crc` scans the joined
words once and derives every run's CRC from two running ones.

Corpus and target are counted by bucket. A bucket's gain is the logarithm of its smoothed
share in the target over its share in the corpus, in whole thousandths rounded down. A
text's weight is the sum of gains over its features; a Gumbel variate from a keyed hash of
its id is added, so that taking the highest scores draws without replacement in proportion
to the weights. Drawn are a whole percentage of all texts that have words enough.

Only the bucket tables, whose size is a parameter, reach the driver and the tasks. Ranks
come from a range sort of narrow rows.

Defined cases: a null or empty text has no feature and weight 0. A null id counts as the
empty text in the draw. Ties in the score go to the smaller id (null first), then to fewer
features; rows with the same id and text are drawn as separate rows. An empty target or
corpus counts 0 in each bucket. Other columns are ignored, whatever their names; an empty
table gives an empty result. A text of any length is read whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.buffers import RUN, column_bytes, runs
from postmill.llm.prefix_crc import Words, pieces
from postmill.operators.ranking import with_position
from postmill.session import materialise

BUCKETS = 10_000
#: Most words of a feature.
MOST = 3
#: Fewest words of a text that can be drawn.
LEAST_WORDS = 20
#: Gains and variates are whole thousandths.
SCALE = 1000


def _buckets(column: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, bucket, words of the feature less one) of all features, in runs of bounded size."""
    data, offsets = column_bytes(column)
    for lo, hi in runs(offsets):
        part, starts = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if hi - lo == 1 and len(part) > 2 * RUN:
            parts = ((Words(piece, np.array([0, len(piece)])), led) for piece, led in pieces(part, RUN, MOST - 1))
        else:
            parts = iter([(Words(part, starts), 0)])
        for words, led in parts:
            docs, crcs, more = [], [], []
            for n, (doc, crc) in enumerate(words.runs(MOST, led)):
                docs.append(doc + lo)
                crcs.append(crc % np.uint32(buckets))
                more.append(np.full(len(doc), n, np.int8))
            if docs:
                yield np.concatenate(docs), np.concatenate(crcs), np.concatenate(more)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket, _ in _buckets(batch.column(0), buckets):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    counted = texts.select(F.col(text).alias("text")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of every bucket in thousandths."""
    buckets = len(corpus)
    share = (target + 1.0) * float(corpus.sum() + buckets) / ((corpus + 1.0) * float(target.sum() + buckets))
    return np.floor(SCALE * np.log(share)).astype(np.int64)


def weighed(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """``texts`` with n_words, n_features and weight instead of the column text."""
    rest = texts.drop("text")
    names, kept = rest.columns, ", ".join(f"{c} {t}" for c, t in rest.dtypes)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = len(batch)
            words, features, weight = (np.zeros(rows, np.int64) for _ in range(3))
            for doc, bucket, more in _buckets(batch.column("text"), len(gain)):
                words += np.bincount(doc[more == 0], minlength=rows)
                features += np.bincount(doc, minlength=rows)
                # Sums of whole numbers far below 2 ** 53 are exact in doubles.
                weight += np.bincount(doc, weights=gain[bucket], minlength=rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(words), pa.array(features), pa.array(weight)],
                names=[*names, "n_words", "n_features", "weight"],
            )

    return texts.select(*names, "text").mapInArrow(weigh, f"{kept}, n_words long, n_features long, weight long")


def variate(id_column: str, seed: int) -> Column:
    """A Gumbel variate in thousandths from the keyed hash of an id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _ranked(texts: DataFrame, target: DataFrame, percent: int, seed: int, target_text: str) -> DataFrame:
    """``texts`` (id, text and maybe more) with n_features, weight, score and rank instead of the text."""
    gain = gains(bucket_counts(texts), bucket_counts(target, target_text))
    known = materialise(
        weighed(texts, gain).withColumns({
            "score": F.col("weight") + variate("id", seed), "able": F.col("n_words") >= LEAST_WORDS,
        }).drop("n_words"),
        "weights",
    )
    drawn = known.filter("able").count() * percent // 100
    order = [F.col("able").desc(), F.col("score").desc(), F.col("id").asc(), F.col("n_features").asc()]
    rank = F.when(F.col("able") & (F.col("rank") <= drawn), F.col("rank").cast("long"))
    return with_position(known, order, "rank").withColumn("rank", rank).drop("able")


def scored(
    docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42,
    id_column: str = "doc_id", text_column: str = "text", target_text: str = "text",
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row; ``rank`` is null where it is not drawn."""
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return _ranked(texts, target, percent, seed, target_text)


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42,
    id_column: str = "doc_id", text_column: str = "text", target_text: str = "text",
) -> DataFrame:
    """The drawn rows of ``docs``, columns unchanged."""
    # Stored, as numbers of rows hold for one reading only.
    own = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    texts = own.select(F.col(id_column).alias("id"), F.col("__row").alias("row"), F.col(text_column).alias("text"))
    drawn = _ranked(texts, target, percent, seed, target_text).filter("rank IS NOT NULL").select("row")
    return own.join(drawn, F.col("__row") == F.col("row"), "left_semi").select(*docs.columns)
