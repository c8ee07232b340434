"""Orders, positions, top-n, pages and rank correlation without a global window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import fresh_path, materialise

PAGE_SIZE = 50
PART_BYTES = 128 << 20  # long rows that one task sorts
ROW_BYTES = 128  # what a sort holds of a row beside its long column


def _cols(order_by: Sequence[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order_by]


def _ordered_parts(df: DataFrame, order_by: Sequence[Column | str], kept: Sequence[str] | None = None) -> DataFrame:
    """Rows range-partitioned by the order and stored with their part number.

    Storing fixes the parts: a range partitioning sampled a second time might
    cut elsewhere. Of ``kept`` columns alone nothing else is moved but the order's.
    """
    return materialise(
        df.orderBy(*_cols(order_by)).select(
            *(df.columns if kept is None else kept),
            F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"),
        ),
        "ordered",
    )


def _offsets(parts: DataFrame, amount: Column) -> DataFrame:
    """Sum of ``amount`` before each part. One row per part, whatever the data size."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.groupBy("_part").agg(amount.alias("_sum"), F.min("_at").alias("_start"))
        .select("_part", "_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    )


def stored_in_order(df: DataFrame, order_by: Sequence[Column | str]) -> DataFrame:
    """Rows sorted by range with what ``numbered`` needs; to be stored as they are."""
    return df.orderBy(*_cols(order_by)).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))


def numbered(stored: DataFrame, name: str, start: int) -> DataFrame:
    """The global row number of rows that were stored by ``stored_in_order``."""
    offsets = F.broadcast(materialise(_offsets(stored, F.count("*")), "offsets"))
    number = (F.col("_before") + F.col("_at") - F.col("_start") + start).cast("bigint").alias(name)
    return stored.join(offsets, "_part").select(*[c for c in stored.columns if c not in ("_part", "_at")], number)


def with_position(
    df: DataFrame, order_by: Sequence[Column | str], name: str = "position", start: int = 1,
    key: str | None = None,
) -> DataFrame:
    """Global row number: a range sort, then the sizes of the parts before.

    ``key`` names a column that is unique and never null. The key alone is then sorted
    and stored, and joined back to the rows, whose other columns are moved once.
    """
    parts = _ordered_parts(df, order_by, None if key is None else [key])
    offsets = F.broadcast(_offsets(parts, F.count("*")))
    number = (F.col("_before") + F.col("_at") - F.col("_start") + start).alias(name)
    placed = parts.join(offsets, "_part")
    if key is None:
        return placed.select(*df.columns, number)
    return df.join(placed.select(key, number), key).select(*df.columns, name)


def positions_in_folders(
    df: DataFrame, order_by: Sequence[str], folders: Sequence[str], long: str, name: str = "position", start: int = 1,
) -> DataFrame:
    """Rows stored in folders by some of their columns, with their global row number.

    For rows with a ``long`` column of text. They are dealt by the order to as many parts
    as hold ``PART_BYTES`` each, so what a task sorts does not grow with the table; left to
    the number of cores or files it would. The same task numbers its rows and writes them to
    the folders, and the rows of the parts before are added when the folders are read.
    """
    spark = df.sparkSession
    rows = materialise(df, "rows")
    size = rows.agg(F.sum(F.coalesce(F.octet_length(long), F.lit(0)) + F.lit(ROW_BYTES).cast("bigint"))).first()[0] or 0
    placed = rows.repartitionByRange(max(1, -(-size // PART_BYTES)), *order_by).sortWithinPartitions(*order_by).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")
    )
    path = fresh_path(spark, "placed")
    placed.write.partitionBy(*folders).parquet(path)
    stored = spark.read.schema(placed.schema).parquet(path)
    offsets = F.broadcast(materialise(_offsets(stored, F.count("*")), "offsets"))
    number = (F.col("_before") + F.col("_at") - F.col("_start") + start).cast("bigint").alias(name)
    return stored.join(offsets, "_part").select(*df.columns, number)


def with_page(
    df: DataFrame, order_by: Sequence[Column | str], size: int = PAGE_SIZE, key: str | None = None
) -> DataFrame:
    """Every row with its zero-based page."""
    placed = with_position(df, order_by, key=key)
    return placed.withColumn("page", F.floor((F.col("position") - 1) / size))


def page(
    df: DataFrame, number: int, order_by: Sequence[Column | str], size: int = PAGE_SIZE, key: str | None = None
) -> DataFrame:
    """One page; the page number is clamped to the existing pages.

    It is cut from the positions of a range sort, as no task could keep all rows
    before a late page. The order should end with a unique key: rows that tie
    have no fixed place among each other. With a ``key`` (see ``with_position``)
    the page's keys are cut first and looked up.
    """
    pages = max(1, -(-df.count() // size))
    start = min(max(number, 0), pages - 1) * size
    here = F.col("_place").between(start, start + size - 1)
    placed = with_position(df, order_by, "_place", start=0, key=key)
    return placed.filter(here).orderBy("_place").drop("_place")


def top_n(df: DataFrame, score: Column | str, n: int, key: str = "hash") -> DataFrame:
    """The n highest scores; ties go to the smaller key."""
    value = F.col(score) if isinstance(score, str) else score
    return df.orderBy(value.desc(), F.col(key).asc()).limit(n)


def best_and_cutoff(selected: DataFrame, score: str) -> DataFrame:
    return selected.agg(
        F.coalesce(F.max(score), F.lit(0.0)).alias("best"),
        F.coalesce(F.min(score), F.lit(0.0)).alias("cutoff"),
    )


def average_ranks(df: DataFrame, value: str, weight: Column | None = None) -> DataFrame:
    """(value, rank): mean rank of every distinct value; rows may carry a count.

    Ties are counted before anything is ordered, so a value that a third of the
    rows share is one row here.
    """
    total = F.count("*") if weight is None else F.sum(weight)
    counted = df.groupBy(value).agg(total.alias("_n"))
    parts = _ordered_parts(counted, [value])
    offsets = F.broadcast(_offsets(parts, F.sum("_n")))
    running = F.sum("_n").over(Window.partitionBy("_part").orderBy("_at"))
    rank = F.col("_before") + F.col("_run") - F.col("_n") + (F.col("_n") + 1) / F.lit(2.0)
    return parts.withColumn("_run", running).join(offsets, "_part").select(value, rank.alias("rank"))


def spearman(df: DataFrame, left: str, right: str, minimum: int = 2, digits: int = 4) -> DataFrame:
    """One row (n, rho): rank correlation of two columns over complete pairs.

    ``rho`` is null below ``minimum`` pairs and for constant input.
    """
    pairs = (
        df.select(F.col(left).cast("double").alias("_x"), F.col(right).cast("double").alias("_y"))
        .dropna().groupBy("_x", "_y").agg(F.count("*").alias("_w"))
    )
    pairs = materialise(pairs, "pairs")
    x = average_ranks(pairs, "_x", F.col("_w")).withColumnRenamed("rank", "_rx")
    y = average_ranks(pairs, "_y", F.col("_w")).withColumnRenamed("rank", "_ry")
    w, rx, ry = F.col("_w"), F.col("_rx"), F.col("_ry")
    n, sx, sy = F.col("_n"), F.col("_sx"), F.col("_sy")
    spread = (n * F.col("_sxx") - sx * sx) * (n * F.col("_syy") - sy * sy)
    rho = F.when((n >= minimum) & (spread > 0), (n * F.col("_sxy") - sx * sy) / F.sqrt(spread))
    return (
        pairs.join(x, "_x").join(y, "_y")
        .agg(
            F.coalesce(F.sum(w), F.lit(0)).alias("_n"),
            F.sum(w * rx).alias("_sx"), F.sum(w * ry).alias("_sy"),
            F.sum(w * rx * rx).alias("_sxx"), F.sum(w * ry * ry).alias("_syy"),
            F.sum(w * rx * ry).alias("_sxy"),
        )
        .select(n.alias("n"), F.round(rho, digits).alias("rho"))
    )
