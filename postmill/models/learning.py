"""Training table and the label-train-select loop.

The driver holds only counters and bounded selections; every round appends its
examples to a stored table, which also cuts the lineage of the loop.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.pay import format_pay
from postmill.models.features import STOP_WORDS, example_texts, posting_texts, seed_indexed, stored_tokens
from postmill.models.index import term_index
from postmill.models.surrogate import MODELS, Surrogate, agreement, fit_surrogate
from postmill.operators.dedup import unscored
from postmill.operators.ranking import numbered, stored_in_order, top_n
from postmill.operators.report import parse_score, scored_postings
from postmill.schema import EXAMPLE_FIELDS
from postmill.session import materialise, sparing_disk

LabelFn = Callable[[DataFrame], DataFrame]

TRAINING_ORDER = ("round", "place")


def to_examples(postings: DataFrame, scores: DataFrame) -> DataFrame:
    """Example rows of postings that have a score; others are skipped."""
    return postings.join(scores.select("hash", "interest_score", "fit_score"), "hash").withColumn(
        "comp", format_pay("compensation", "compensation_raw")
    )


def labels_from_documents(documents: DataFrame) -> DataFrame:
    """(hash, interest_score, fit_score) of (hash, document); invalid ones drop out."""
    parsed = documents.select("hash", parse_score("document").alias("s")).filter("s is not null")
    return parsed.select(
        "hash", F.col("s.interest.score").alias("interest_score"),
        F.col("s.fit.score").alias("fit_score"),
    )


def label_from_table(scores: DataFrame) -> LabelFn:
    """Label provider that looks scores up by hash; unknown rows stay unscored."""

    def label(rows: DataFrame) -> DataFrame:
        return scores.join(rows.select("hash").distinct(), "hash", "left_semi")

    return label


def empty_training(spark) -> DataFrame:
    return spark.createDataFrame(
        [],
        "hash string, title string, description string, company string, location string, "
        "team string, comp string, interest_score int, fit_score int, round int, place bigint",
    )


@dataclass(frozen=True)
class Outcome:
    """What a loop has learnt. The last model is fitted, and scores all, when it is asked for."""

    training: DataFrame
    universe: DataFrame
    rounds: int
    train: Callable[[], Surrogate]
    indexed: Callable[[], DataFrame]

    @cached_property
    def final(self) -> Surrogate:
        return self.train()

    @cached_property
    def predictions(self) -> DataFrame:
        with sparing_disk(self.universe.sparkSession):
            return materialise(self.final.predict_indexed(self.indexed()), "predictions")

    @cached_property
    def scored(self) -> DataFrame:
        return scored_postings(self.universe, self.training)

    @cached_property
    def metrics(self) -> DataFrame:
        with sparing_disk(self.universe.sparkSession):
            return with_agreement(self.final.cv_metrics(), agreement(self.training, self.predictions))


def with_agreement(metrics: DataFrame, agreed: DataFrame) -> DataFrame:
    """Both one-row tables side by side."""
    both = metrics.unionByName(agreed, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def _train(training: DataFrame, n_models: int, seed: int, options: dict) -> Surrogate:
    return fit_surrogate(training, TRAINING_ORDER, n_models, seed, **options)


def active_learning(
    universe: DataFrame, forced: DataFrame, training: DataFrame, label_fn: LabelFn,
    reference_text: str = "", *, init_num_exploit: int = 100, num_explore: int = 10,
    num_exploit: int = 10, init_learning_iters: int = 20, learning_iters: int = 1,
    n_models: int = MODELS, seed: int = 0, **options,
) -> Outcome:
    """Label what teaches most and what looks best, then score everything.

    A cold start is one without training rows before the forced ones. Rows the
    provider does not label stay unscored and may be picked again.

    Texts are tokenised once, to an index that every round scores. Each file of the
    universe is stored in the order of hashes, so the few rows that are picked are found
    by the bounds of its pages. Examples are written once, with their tokens and their
    place in the order, as those of a round come after those before.
    """
    with sparing_disk(universe.sparkSession):
        return _learned(
            universe, forced, training, label_fn, reference_text, init_num_exploit, num_explore, num_exploit,
            init_learning_iters, learning_iters, n_models, seed, options)


def _learned(
    universe: DataFrame, forced: DataFrame, training: DataFrame, label_fn: LabelFn, reference_text: str,
    init_num_exploit: int, num_explore: int, num_exploit: int, init_learning_iters: int, learning_iters: int,
    n_models: int, seed: int, options: dict,
) -> Outcome:
    universe = materialise(universe.sortWithinPartitions("hash"), "universe")
    max_chars, stop_words = options.get("max_chars"), options.get("stop_words", STOP_WORDS)
    state: dict = {"training": None, "tokens": None, "n": 0}

    def append(new: DataFrame) -> DataFrame:
        """Store examples in their order, and their tokens with their ordinal."""
        stored = materialise(stored_in_order(new, TRAINING_ORDER), "training")
        rows = stored.drop("_part", "_at")
        state["training"] = rows if state["training"] is None else state["training"].unionByName(rows)
        n = rows.count()
        if n:
            placed = numbered(stored, "ordinal", state["n"])
            kept = ("ordinal", "interest_score", "fit_score")
            tokens = stored_tokens(example_texts(placed, max_chars, kept), stop_words)
            state["tokens"] = tokens if state["tokens"] is None else state["tokens"].unionByName(tokens)
            state["n"] += n
        return rows

    before = append(training)
    cold = state["n"] == 0
    last = before.agg(F.max("round")).head()[0]
    step = {"round": 0 if last is None else last + 1}

    @cache
    def indexed() -> DataFrame:
        return term_index(posting_texts(universe, max_chars), stop_words)

    def label(rows: DataFrame) -> None:
        """Label stored rows, which carry their ``place``, and append them."""
        scores = materialise(label_fn(rows), "labels")
        new = to_examples(rows, scores).withColumn("round", F.lit(step["round"]))
        append(new.select(*EXAMPLE_FIELDS, "round", "place"))
        step["round"] += 1

    def choose(selection: DataFrame, score: str) -> None:
        """Label a selection; its size is bounded by the n it was made with."""
        place = F.row_number().over(Window.orderBy(F.col(score).desc(), F.col("hash").asc()))
        chosen = materialise(selection.select("hash", place.cast("bigint").alias("place")), "chosen")
        picked = [r.hash for r in chosen.select("hash").collect()]
        # Longer lists reach the files as their bounds only.
        some = [F.col("hash").isin(picked[k : k + 10]) for k in range(0, len(picked), 10)]
        met = universe.filter(reduce(Column.__or__, some, F.lit(False)))
        label(materialise(met.join(F.broadcast(chosen), "hash"), "rows"))

    waiting = materialise(unscored(forced, state["training"]).withColumn("place", F.col("ord")), "rows")
    if not waiting.isEmpty():
        label(waiting)
    if cold:
        # The index is stored in two parts, as the seeds are sought among what is left.
        met = state["training"].select("hash").distinct()
        left, rest = (
            term_index(posting_texts(universe.join(met, "hash", how), max_chars), stop_words)
            for how in ("left_anti", "left_semi")
        )
        both = left.unionByName(rest)
        indexed = lambda: both
        choose(seed_indexed(left, reference_text, init_num_exploit, **options), "similarity")

    def train() -> Surrogate:
        if state["tokens"] is None:
            raise ValueError("no training examples")
        return _train(state["tokens"], n_models, seed + done, options)

    done = 0
    for _ in range(init_learning_iters if cold else learning_iters):
        if unscored(indexed().select("hash"), state["training"]).isEmpty():
            break
        spread = unscored(train().disagreement_indexed(indexed()), state["training"])
        choose(top_n(spread, "variance", num_explore), "variance")
        if unscored(indexed().select("hash"), state["training"]).isEmpty():
            break
        guesses = unscored(train().predict_indexed(indexed()), state["training"])
        choose(top_n(guesses, "surrogate_score", num_exploit), "surrogate_score")
        done += 1

    return Outcome(state["training"], universe, done, train, indexed)
