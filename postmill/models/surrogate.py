"""Dual-head ridge surrogate with a bootstrap ensemble.

Training happens on the labelled examples; prediction is a per-row projection
with constant coefficients, so scoring a table needs no shuffle and no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.models.features import TOKENS, Features, dot, example_texts, fit_with_counts, posting_texts
from postmill.models.index import scored
from postmill.models.ridge import all_but, fit_by_loo, member_grams, solved
from postmill.operators.ranking import spearman, top_n, with_position
from postmill.session import materialise

MODELS = 10
ENSEMBLE_ALPHA = 1.0
FOLDS = 5


def combined_target(interest: Column | str, fit: Column | str) -> Column:
    """Geometric mean of both scores as fractions."""
    i = F.col(interest) if isinstance(interest, str) else interest
    f = F.col(fit) if isinstance(fit, str) else fit
    return F.sqrt((i / F.lit(100.0)) * (f / F.lit(100.0)))


def fold_of(ordinal: Column, n: int, folds: int) -> Column:
    """Contiguous fold of a zero-based row; the first folds take the remainder."""
    small, extra = divmod(n, folds)
    cut = extra * (small + 1)
    late = F.floor((ordinal - cut) / F.lit(max(small, 1))) + extra
    return F.when(ordinal < cut, F.floor(ordinal / F.lit(small + 1))).otherwise(late).cast("int")


Draw = Callable[[Column, Column], Column]


def bootstrap_weights(rows: DataFrame, n: int, models: int, seed: int, draw: Draw | None = None) -> DataFrame:
    """(model, ordinal, weight): n draws with replacement per member.

    Every row also stands for one draw of each member and names, by a hash of
    seed, member and row, the row it draws. So there are exactly n draws, the
    result repeats with the seed, and nothing is gathered. ``draw`` gives, for a
    member and a row, another whole number to draw by.
    """
    drawn = _drawn(rows, n, models, seed, draw)
    return drawn.groupBy("model", "ordinal").agg(F.count("*").cast("double").alias("weight"))


def _drawn(rows: DataFrame, n: int, models: int, seed: int, draw: Draw | None) -> DataFrame:
    """(model, ordinal) of every draw."""
    number = F.xxhash64(F.lit(seed), "model", "ordinal") if draw is None else draw(F.col("model"), F.col("ordinal"))
    members = F.explode(F.sequence(F.lit(0), F.lit(models - 1))).alias("model")
    return rows.select("ordinal", members).select("model", F.pmod(number, F.lit(n)).alias("ordinal"))


def with_draws(rows: DataFrame, n: int, models: int, seed: int, draw: Draw | None = None) -> DataFrame:
    """Rows that any member draws, with ``weights``: how often each does, see ``bootstrap_weights``.

    A row stays one row, however many members draw it.
    """
    times = F.array(*[F.count_if(F.col("model") == m).cast("double") for m in range(models)])
    drawn = _drawn(rows, n, models, seed, draw).groupBy("ordinal").agg(times.alias("weights"))
    return rows.join(drawn, "ordinal")


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


@dataclass(frozen=True)
class Linear:
    alpha: float
    intercept: float
    weights: tuple[float, ...]

    def predict(self, features: Column | str = "features") -> Column:
        return dot(features, self.weights) + F.lit(self.intercept)


def _linear(row) -> Linear:
    return Linear(float(row.alpha), float(row.intercept), tuple(float(w) for w in row.weights))


@dataclass(frozen=True)
class Surrogate:
    """Features and the stored training rows; models are fitted when first asked for."""

    features: Features
    rows: DataFrame
    n: int
    n_models: int
    seed: int
    max_chars: int | None
    draw: Draw | None = None

    @cached_property
    def heads(self) -> tuple[Linear, Linear]:
        found = fit_by_loo(self.rows, self.n, self.features.size, 3, 2).sort_values("target")
        interest, fit = (_linear(r) for r in found.itertuples())
        return interest, fit

    @property
    def interest(self) -> Linear:
        return self.heads[0]

    @property
    def fit(self) -> Linear:
        return self.heads[1]

    # --- prediction ---------------------------------------------------------

    def _featured(self, postings: DataFrame) -> DataFrame:
        return self.features.transform(posting_texts(postings, self.max_chars))

    def score(self, features: Column | str = "features") -> Column:
        return F.sqrt(_clamp(self.interest.predict(features)) * _clamp(self.fit.predict(features)))

    def predict(self, postings: DataFrame) -> DataFrame:
        """(hash, surrogate_score) of every posting."""
        return self._featured(postings).select("hash", self.score().alias("surrogate_score"))

    def disagreement(self, postings: DataFrame) -> DataFrame:
        """(hash, variance): population variance of the ensemble's predictions."""
        predictions = F.array(*[m.predict() for m in self.ensemble])
        return self._variance(self._featured(postings).select("hash", predictions.alias("p")))

    def _variance(self, predicted: DataFrame) -> DataFrame:
        size = F.lit(float(self.n_models))
        mean = F.aggregate("p", F.lit(0.0), lambda a, p: a + p) / size
        centred = predicted.withColumn("m", mean)
        spread = F.aggregate("p", F.lit(0.0), lambda a, p: a + (p - F.col("m")) * (p - F.col("m")))
        return centred.select("hash", (spread / size).alias("variance"))

    def predict_indexed(self, index: DataFrame) -> DataFrame:
        """``predict`` of postings from their term index."""
        p = scored(index, self.features, [h.weights for h in self.heads], [h.intercept for h in self.heads])
        return p.select("hash", F.sqrt(_clamp(F.col("p")[0]) * _clamp(F.col("p")[1])).alias("surrogate_score"))

    def disagreement_indexed(self, index: DataFrame) -> DataFrame:
        """``disagreement`` of postings from their term index."""
        members = self.ensemble
        return self._variance(scored(index, self.features, [m.weights for m in members], [m.intercept for m in members]))

    def by_score(self, postings: DataFrame, n: int) -> DataFrame:
        return top_n(self.predict(postings), "surrogate_score", n)

    def by_disagreement(self, postings: DataFrame, n: int) -> DataFrame:
        return top_n(self.disagreement(postings), "variance", n)

    # --- ensemble and metrics -----------------------------------------------

    @cached_property
    def ensemble(self) -> tuple[Linear, ...]:
        drawn = with_draws(self.rows, self.n, self.n_models, self.seed, self.draw)
        weighted = materialise(drawn.select("idx", "val", "ys", "weights"), "weighted")
        grams = member_grams(weighted, self.n, self.n_models, self.features.size)
        fitted = solved(grams, self.features.size, 3, [2], ENSEMBLE_ALPHA).collect()
        return tuple(_linear(r) for r in sorted(fitted, key=lambda r: r.model))

    @cached_property
    def cv_predictions(self) -> DataFrame:
        """(ordinal, target, prediction) with every row predicted by the other folds."""
        folds = min(FOLDS, self.n)
        rows = self.rows.withColumn("fold", fold_of(F.col("ordinal"), self.n, folds))
        # One matrix a fold; each model's is the sum of the other folds'.
        own = F.array(*[(F.col("fold") == m).cast("double") for m in range(folds)])
        grams = member_grams(rows.withColumn("weights", own), self.n, folds, self.features.size)
        fitted = solved(all_but(grams, folds), self.features.size, 3, [2], ENSEMBLE_ALPHA).collect()
        features = F.arrays_zip(F.col("idx").alias("i"), F.col("val").alias("w"))
        prediction = F.lit(None).cast("double")
        for row in fitted:
            prediction = F.when(F.col("fold") == row.model, _linear(row).predict(features)).otherwise(prediction)
        return rows.select("ordinal", F.col("ys")[2].alias("target"), prediction.alias("prediction"))

    def cv_metrics(self) -> DataFrame:
        """One row (n_examples, cv_r2, cv_mae, cv_spearman), rounded to 4 digits."""
        if self.n < 2:
            zero = F.lit(0.0)
            return self.rows.sparkSession.range(1).select(
                F.lit(self.n).cast("bigint").alias("n_examples"), zero.alias("cv_r2"),
                zero.alias("cv_mae"), zero.alias("cv_spearman"),
            )
        return regression_metrics(materialise(self.cv_predictions, "cv"))


def regression_metrics(predictions: DataFrame) -> DataFrame:
    """R2, mean absolute error and rank correlation of (target, prediction) rows."""
    y, p = F.col("target"), F.col("prediction")
    total = F.var_pop(y) * F.count(y)
    r2 = F.when(total > 0, 1 - F.sum((y - p) * (y - p)) / total).otherwise(0.0)
    fit = predictions.agg(
        F.count("*").alias("n_examples"), F.round(r2, 4).alias("cv_r2"),
        F.round(F.avg(F.abs(y - p)), 4).alias("cv_mae"),
    )
    rank = spearman(predictions, "target", "prediction").select(
        F.col("n").alias("n_examples"), F.col("rho").alias("cv_spearman")
    )
    return fit.join(rank, "n_examples")


def fit_surrogate(
    examples: DataFrame, order_by, n_models: int = MODELS, seed: int = 0,
    max_chars: int | None = None, draw: Draw | None = None, **features,
) -> Surrogate:
    """Features and rows of EXAMPLE rows taken in the order ``order_by``; for ``draw`` see ``bootstrap_weights``.

    Examples can also be given as their stored tokens with ``ordinal`` and both scores.
    """
    stored = set(TOKENS) <= set(examples.columns)
    placed = examples if stored else with_position(examples, order_by, "ordinal", start=0)
    n = placed.count()
    if n == 0:
        raise ValueError("no training examples")
    ys = F.array(
        F.col("interest_score") / F.lit(100.0), F.col("fit_score") / F.lit(100.0),
        combined_target("interest_score", "fit_score"),
    )
    placed = placed.withColumn("ys", ys)
    texts = placed.select("ordinal", "ys", *TOKENS) if stored else example_texts(placed, max_chars, ("ordinal", "ys"))
    fitted, counts = fit_with_counts(texts, **features)
    rows = materialise(
        fitted.transform(counts).select(
            "ordinal", "ys",
            F.col("features")["i"].alias("idx"), F.col("features")["w"].alias("val"),
        ),
        "training",
    )
    return Surrogate(fitted, rows, n, n_models, seed, max_chars, draw)


def agreement(examples: DataFrame, predicted: DataFrame) -> DataFrame:
    """(agreement_spearman, agreement_n): labels against surrogate scores.

    Examples without a prediction are skipped; null below three pairs.
    """
    actual = (F.col("interest_score") / F.lit(100.0)) * (F.col("fit_score") / F.lit(100.0))
    pairs = examples.join(predicted, "hash").select(actual.alias("actual"), "surrogate_score")
    return spearman(pairs, "actual", "surrogate_score", minimum=3).select(
        F.col("rho").alias("agreement_spearman"), F.col("n").alias("agreement_n")
    )
