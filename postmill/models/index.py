"""A forward index of postings: their tokens, made once and scored many times.

Texts are cut to their tokens once, which lie in the shared folder and take less room than
the texts. A model is a vocabulary and weights over it; scoring looks the tokens' terms up
in the vocabulary, so no round of learning reads a text again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postmill.models.features import ROWS, STOP_WORDS, TOKENS, Features, known_terms, stored_tokens, terms_met


def term_index(texts: DataFrame, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(hash, tokens of both blocks) of (hash, meta, body), stored."""
    return stored_tokens(texts.select("hash", "meta", "body"), stop_words)


def scored(index: DataFrame, features: Features, weights: Sequence[Sequence[float]], intercepts: Sequence[float]) -> DataFrame:
    """(hash, p): for each posting the prediction of every linear model over ``features``."""
    blocks, start = [], 0
    for vocabulary, idf in ((features.meta_vocabulary, features.meta_idf), (features.body_vocabulary, features.body_idf)):
        matrix = np.array(weights, float).reshape(len(intercepts), -1)[:, start : start + len(vocabulary)].T
        blocks.append((known_terms(vocabulary), np.array(idf, float), matrix))
        start += len(vocabulary)
    shared = index.sparkSession.sparkContext.broadcast(blocks)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(pa.array(words, pa.string()), codes, order) for (words, codes, order), _, _ in shared.value]
        for batch in batches:
            for first in range(0, len(batch), ROWS):
                part = batch.slice(first, ROWS)
                n = len(part)
                total = np.tile(np.array(intercepts, float), (n, 1))
                for name, slots, (_, idf, matrix) in zip(TOKENS, known, shared.value):
                    row, at, counts = terms_met(part.column(name), *slots)
                    raw = (np.log(counts) + 1) * idf[at]
                    length = np.sqrt(np.bincount(row, weights=raw * raw, minlength=n))
                    share = raw / length[row]
                    for k in range(matrix.shape[1]):
                        total[:, k] += np.bincount(row, weights=share * matrix[at, k], minlength=n)
                offsets = pa.array((np.arange(n + 1) * total.shape[1]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("hash"), pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))], names=["hash", "p"]
                )

    return index.select("hash", *TOKENS).mapInArrow(predict, "hash string, p array<double>")
