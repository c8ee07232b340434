"""Ridge regression from weighted Gram matrices.

A design row is (features, 1, targets...). Every model here - the full fit, the
cross-validation fits and the bootstrap members - is one weighting of the same
rows, so each needs only its weighted Gram matrix, whose size depends on the
vocabulary (at most a few thousand columns) and not on the rows.

The rows of a model are spread over tasks of at least about ``PART_ROWS`` rows, each emits
the upper half of its partial Gram matrix, and Spark sums them. Where the rows are stored
with the weights of all models, each model's tasks read them where they lie: no row is
copied or shuffled for a model, and the number of partial matrices follows the cores.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_ROWS = 10_000
#: Design rows made dense at once, so a task's memory does not follow its batches.
DENSE_ROWS = 1_000
ALPHAS = np.logspace(-2, 2, 50)

MODEL_SCHEMA = "model int, target int, alpha double, intercept double, weights array<double>"


def dense_rows(indices: pd.Series, weights: pd.Series, width: int) -> np.ndarray:
    x = np.zeros((len(indices), width))
    row = np.repeat(np.arange(len(indices)), [len(i) for i in indices])
    if len(row):
        x[row, np.concatenate([np.asarray(i, np.int64) for i in indices])] = np.concatenate(list(weights))
    return x


def solve(gram: np.ndarray, width: int, targets: list[int], alpha: float) -> list[tuple]:
    """(target, intercept, weights) from an augmented Gram matrix."""
    n = gram[width, width]
    mean = gram[width, :width] / n
    a = gram[:width, :width] - n * np.outer(mean, mean)
    a[np.diag_indices(width)] += alpha
    centres = [gram[width, width + 1 + t] / n for t in targets]
    b = np.stack(
        [gram[:width, width + 1 + t] - n * mean * c for t, c in zip(targets, centres)], axis=1
    )
    w = np.linalg.solve(a, b)
    return [(t, c - mean @ w[:, k], w[:, k]) for k, (t, c) in enumerate(zip(targets, centres))]


def augmented(pdf: pd.DataFrame, width: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Runs of rows, each with its dense design rows."""
    for start in range(0, len(pdf), DENSE_ROWS):
        part = pdf.iloc[start : start + DENSE_ROWS]
        x = dense_rows(part["idx"], part["val"], width)
        y = np.stack(part["ys"].to_numpy())
        yield part, np.hstack([x, np.ones((len(x), 1)), y])


def _partial_grams(width: int):
    """Per task: rows of the weighted Gram matrix of each model met, from the diagonal on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, total = None, None

        def emit():
            keep = np.flatnonzero(total.diagonal())
            return pd.DataFrame({"model": model, "i": keep, "row": [total[i, i:] for i in keep]})

        for pdf in batches:
            for m, rows in pdf.groupby("model", sort=True):
                for part, a in augmented(rows, width):
                    weight = part["weight"].to_numpy()
                    if (weight != 1).any():
                        a = a * np.sqrt(weight)[:, None]
                    g = a.T @ a  # of a matrix and itself: half the work
                    if m != model:
                        if model is not None:
                            yield emit()
                        model, total = m, g
                    else:
                        total += g
        if model is not None:
            yield emit()

    return run


def _summed(partial: DataFrame) -> DataFrame:
    summed = partial.groupBy("model", "i").agg(Summarizer.sum(array_to_vector("row")).alias("_v"))
    return summed.select("model", "i", vector_to_array("_v").alias("row"))


def _grams(rows: DataFrame, width: int) -> DataFrame:
    partial = rows.select("model", "weight", "idx", "val", "ys").mapInPandas(
        _partial_grams(width), "model int, i int, row array<double>")
    return _summed(partial)


def weighted_grams(rows: DataFrame, width: int, salts: int) -> DataFrame:
    """(model, i, row): summed Gram rows of (model, weight, idx, val, ys, ordinal)."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("ordinal"), F.lit(salts)))
    return _grams(salted.repartition("model", "_salt").sortWithinPartitions("model"), width)


def member_grams(rows: DataFrame, n: int, models: int, width: int) -> DataFrame:
    """(model, i, row): summed Gram rows of stored (idx, val, ys, weights), one weight for each model.

    A task has one model's matrix and reads the rows that weigh in it.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    # Two at least: Spark reads a union of single partitions in one task.
    parts = max(2, min(-(-n // PART_ROWS), -(-2 * cores // models)))
    each = [
        rows.select(F.lit(m).alias("model"), F.col("weights")[m].alias("weight"), "idx", "val", "ys")
        .filter("weight <> 0").coalesce(parts)
        for m in range(models)
    ]
    return _grams(reduce(DataFrame.unionAll, each), width)


def all_but(grams: DataFrame, models: int) -> DataFrame:
    """Gram rows of each model's complement: the sums of the others."""
    others = F.filter(F.sequence(F.lit(0), F.lit(models - 1)), lambda m: m != F.col("model"))
    return _summed(grams.select(F.explode(others).alias("model"), "i", "row"))


def stack_gram(pdf: pd.DataFrame, width: int, n_targets: int) -> np.ndarray:
    gram = np.zeros((width + 1 + n_targets,) * 2)
    for i, row in zip(pdf["i"], pdf["row"]):
        gram[i, i:] = gram[i:, i] = row
    return gram


def fit_weighted(
    rows: DataFrame, n: int, width: int, n_targets: int, targets: list[int], alpha: float,
) -> DataFrame:
    """Ridge fits per model id, one per listed target: MODEL_SCHEMA rows."""
    return solved(weighted_grams(rows, width, -(-n // PART_ROWS)), width, n_targets, targets, alpha)


def solved(grams: DataFrame, width: int, n_targets: int, targets: list[int], alpha: float) -> DataFrame:
    """The ridge fits of summed Gram rows."""

    def table(model: int, fitted: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "model": model, "target": [t for t, _, _ in fitted], "alpha": alpha,
                "intercept": [c for _, c, _ in fitted], "weights": [w for _, _, w in fitted],
            }
        )

    def from_gram(pdf: pd.DataFrame) -> pd.DataFrame:
        fitted = solve(stack_gram(pdf, width, n_targets), width, targets, alpha)
        return table(int(pdf["model"].iloc[0]), fitted)

    return grams.groupBy("model").applyInPandas(from_gram, MODEL_SCHEMA)


# --- alpha by leave-one-out ------------------------------------------------


def _basis(gram: np.ndarray, width: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Count, feature means, eigenvectors and positive eigenvalues of the centred Gram."""
    n = gram[width, width]
    mean = gram[width, :width] / n
    s, v = np.linalg.eigh(gram[:width, :width] - n * np.outer(mean, mean))
    keep = s > max(s.max(initial=0.0), 0.0) * width * np.finfo(float).eps
    return n, mean, v[:, keep], s[keep]


def loo_errors(
    x: np.ndarray, y: np.ndarray, n: float, mean: np.ndarray, v: np.ndarray,
    s: np.ndarray, projected: np.ndarray, centres: np.ndarray,
) -> np.ndarray:
    """Summed squared leave-one-out errors, alphas by targets, of some rows.

    The leverage includes 1/n for the intercept.
    """
    z = (x - mean) @ v
    shrink = 1.0 / (s[:, None] + ALPHAS[None, :])
    leverage = 1.0 / n + (z * z) @ shrink
    out = np.empty((len(ALPHAS), y.shape[1]))
    for t in range(y.shape[1]):
        residual = (y[:, t] - centres[t])[:, None] - z @ (shrink * projected[:, t][:, None])
        out[:, t] = np.sum((residual / (1.0 - leverage)) ** 2, axis=0)
    return out


def _chosen(
    errors: np.ndarray, mean: np.ndarray, v: np.ndarray, s: np.ndarray,
    projected: np.ndarray, centres: np.ndarray,
) -> list[tuple]:
    """(target, alpha, intercept, weights); equal errors give the smallest alpha."""
    out = []
    for t in range(errors.shape[1]):
        alpha = float(ALPHAS[int(np.argmin(errors[:, t]))])
        w = v @ (projected[:, t] / (s + alpha))
        out.append((t, alpha, float(centres[t] - mean @ w), w))
    return out


def _models(fitted: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "model": 0, "target": [f[0] for f in fitted], "alpha": [f[1] for f in fitted],
            "intercept": [f[2] for f in fitted], "weights": [f[3] for f in fitted],
        }
    )


def fit_by_loo(rows: DataFrame, n: int, width: int, n_targets: int, heads: int) -> pd.DataFrame:
    """One ridge per head (the first ``heads`` targets), alpha by leave-one-out.

    ``rows``: (ordinal, idx, val, ys). Returns MODEL_SCHEMA rows, bounded by the
    vocabulary.
    """

    # One Gram matrix, its size fixed by the vocabulary, is decomposed once.
    weighted = rows.withColumn("weights", F.array(F.lit(1.0)))
    gram = stack_gram(member_grams(weighted, n, 1, width).toPandas(), width, n_targets)
    count, mean, v, s = _basis(gram, width)
    centres = np.array([gram[width, width + 1 + t] / count for t in range(heads)])
    xty = np.stack(
        [gram[:width, width + 1 + t] - count * mean * centres[t] for t in range(heads)], axis=1
    )
    projected = v.T @ xty
    shared = rows.sparkSession.sparkContext.broadcast((count, mean, v, s, projected, centres))

    def errors_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(ALPHAS), heads))
        for pdf in batches:
            for _, a in augmented(pdf, width):
                total += loo_errors(a[:, :width], a[:, width + 1 : width + 1 + heads], *shared.value)
        grid = [(k, t, total[k, t]) for k in range(len(ALPHAS)) for t in range(heads)]
        yield pd.DataFrame(grid, columns=["k", "t", "error"])

    summed = (
        rows.select("idx", "val", "ys").mapInPandas(errors_of, "k int, t int, error double")
        .groupBy("k", "t").agg(F.sum("error").alias("error")).collect()
    )
    errors = np.zeros((len(ALPHAS), heads))
    for r in summed:
        errors[r.k, r.t] = r.error
    return _models(_chosen(errors, mean, v, s, projected, centres))
