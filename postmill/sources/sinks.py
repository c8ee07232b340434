"""Writers of postings, scores, metrics, errors, status and training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.ranking import with_position


def pay_union() -> Column:
    """The stored pay field: object text, raw text or null."""
    return F.coalesce(F.to_json("compensation"), F.col("compensation_raw"))


def _as_lines(df: DataFrame) -> DataFrame:
    return df.withColumn("compensation", pay_union()).drop("compensation_raw")


def write_postings(df: DataFrame, path: str, order_by=("ord",), key: str | None = None) -> None:
    """Postings as JSON lines, their order kept as the ``ord`` they are read by.

    With a ``key`` (a unique column) the keys alone are sorted and numbered.
    """
    placed = with_position(df, list(order_by), "_place", start=0, key=key)
    _as_lines(placed.withColumn("ord", F.col("_place")).drop("_place")).write.mode(
        "overwrite"
    ).json(path)


def write_ranked(df: DataFrame, path: str, order_by, rank: str = "rank", key: str | None = None) -> None:
    """Any ordered table with its order materialised as a column; for ``key`` see ``write_postings``."""
    with_position(df, order_by, rank, key=key).write.mode("overwrite").parquet(path)


def with_rounded_score(postings: DataFrame, predictions: DataFrame) -> DataFrame:
    """Postings with ``surrogate_score`` rounded to six digits."""
    return postings.join(predictions, "hash").withColumn(
        "surrogate_score", F.round("surrogate_score", 6)
    )


def write_surrogate(postings: DataFrame, predictions: DataFrame, path: str, key: str | None = None) -> None:
    write_ranked(with_rounded_score(postings, predictions), path, ["ord"], key=key)


def append_metrics(metrics: DataFrame, path: str, as_of: str) -> None:
    metrics.select(F.lit(as_of).alias("timestamp"), "*").write.mode("append").json(path)


def write_errors(errors: DataFrame, path: str, as_of: str) -> bool:
    """Error log of failed sources; nothing is written without a failure."""
    if errors.isEmpty():
        return False
    errors.withColumn("timestamp", F.lit(as_of)).write.mode("overwrite").json(path)
    return True


def write_status(status: DataFrame, path: str) -> None:
    status.write.mode("overwrite").json(path)


def append_training(examples: DataFrame, path: str, fingerprint: str) -> None:
    examples.withColumn("fingerprint", F.lit(fingerprint)).write.mode("append").partitionBy(
        "fingerprint"
    ).parquet(path)
