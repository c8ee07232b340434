"""Keep-first deduplication, keyed replacement and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from postmill.schema import DEDUP_FIELDS, POSTING_FIELDS

LONG_TEXT = frozenset({"description"})


def _key(field: str) -> Column:
    """Long text is compared by digest so the shuffle carries 64 characters."""
    return F.sha2(F.col(field), 256) if field in LONG_TEXT else F.col(field)


def first_per_key(df: DataFrame, keys: Sequence[Column], order_by: Sequence[Column]) -> DataFrame:
    """The first row of every key.

    The rank-one filter lets Spark limit every key to one row before the
    shuffle, so a key that holds a third of the table reaches the reducer as one
    row per map task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def dedup_first(
    df: DataFrame,
    fields: Sequence[str] = DEDUP_FIELDS,
    order_by: Sequence[Column | str] = ("ord",),
) -> DataFrame:
    """First posting of each combination of ``fields``; null equals null."""
    if not fields:
        return df
    unknown = [f for f in fields if f not in POSTING_FIELDS]
    if unknown:
        raise ValueError(f"unknown posting fields: {', '.join(unknown)}")
    order = [F.col(o) if isinstance(o, str) else o for o in order_by]
    return first_per_key(df, [_key(f) for f in fields], order)


def last_value_first_position(df: DataFrame, key: str = "hash", order: str = "ord") -> DataFrame:
    """One row per key: the values of its last row at the place of its first.

    Rows are chosen by a rank-one window, so few of a key are moved; the first places
    are an aggregate of two narrow columns. A key is never null.
    """
    first = df.groupBy(key).agg(F.min(order).alias("_first"))
    last = first_per_key(df, [F.col(key)], [F.col(order).desc()])
    return last.drop(order).join(first.withColumnRenamed("_first", order), key).select(*df.columns)


def select_universe(
    df: DataFrame,
    keep: Column | None = None,
    force: Column | None = None,
    fields: Sequence[str] = DEDUP_FIELDS,
    order: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(universe, forced): deduplicated rows that match or are forced.

    ``order`` is a value that rises in the order of the rows, by default their
    ``ord``. A store's ``ord`` begins anew with every run: give ``store_place()``
    there, so that of equal postings the one seen last is taken. Matched rows
    keep their place and come before rows that are only forced. Rows are unique
    by hash only when a force predicate is given; the order is ``only_forced``,
    then ``order``.
    """
    place = F.col("ord") if order is None else order
    kept = F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(True)
    if force is None:
        unique = dedup_first(df, fields, [place])
        return unique.filter(kept).withColumn("only_forced", F.lit(False)), unique.filter(F.lit(False))
    forced = F.coalesce(force, F.lit(False))
    # What matches is known before rows are moved, and a text is moved as its digest only
    # where it is not returned.
    unique = dedup_first(df.withColumns({"_kept": kept, "_forced": forced}), fields, [place])
    candidates = unique.filter("_kept or _forced")
    # Of one hash the last matched row at the place of the first matched one, or else the
    # first forced row. Places are found among narrow rows.
    first = first_per_key(
        candidates.select("hash", "_kept", F.col("ord").alias("_first"), place.alias("_place")),
        [F.col("hash")], [F.col("_kept").desc(), F.col("_place").asc(), F.col("_first").asc()],
    ).select("hash", "_first")
    chosen = first_per_key(
        candidates, [F.col("hash")],
        [F.col("_kept").desc(), F.when(F.col("_kept"), place).desc(), place.asc()],
    )
    universe = chosen.join(first, "hash").withColumns({"ord": F.col("_first"), "only_forced": ~F.col("_kept")})
    return universe.select(*df.columns, "only_forced"), unique.filter("_forced").select(*df.columns)


def stage_counts(
    df: DataFrame, keep: Column | None = None, fields: Sequence[str] = DEDUP_FIELDS,
    order_by: Sequence[Column | str] = ("ord",),
) -> DataFrame:
    """One row (total, unique_rows, matched): rows before, after deduplication, after matching."""
    matched = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    unique, both = F.lit("unique_rows"), F.array(F.lit("unique_rows"), F.lit("matched"))
    met = dedup_first(df, fields, order_by).select(
        F.explode(F.when(matched, both).otherwise(F.array(unique))).alias("stage")
    )
    stages = df.select(F.lit("total").alias("stage")).unionAll(met)
    return stages.agg(*[F.count_if(F.col("stage") == s).alias(s) for s in ("total", "unique_rows", "matched")])


class Counted:
    """Row counts taken while a table is written anyway.

    ``through`` marks a place in a plan; once an action has run the plan, ``counts`` has
    the rows that passed each place. Nothing is read a second time.
    """

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def through(self, df: DataFrame, stage: str, *conditions: Column) -> DataFrame:
        """``df``, its rows counted, or those for which a condition holds."""
        observation = self._seen[stage] = Observation(f"{stage}-{id(self)}")
        rows = F.count_if(conditions[0]) if conditions else F.count(F.lit(1))
        return df.observe(observation, rows.alias("rows"))

    def counts(self) -> dict[str, int]:
        """Rows by stage; waits for the first action on the plan."""
        return {stage: observation.get["rows"] for stage, observation in self._seen.items()}


def counted_stages(
    df: DataFrame, keep: Column | None = None, fields: Sequence[str] = DEDUP_FIELDS,
    order_by: Sequence[Column | str] = ("ord",),
) -> tuple[DataFrame, Counted]:
    """The deduplicated and matched rows, and what counts them while they are written."""
    counted = Counted()
    unique = counted.through(dedup_first(counted.through(df, "total"), fields, order_by), "unique_rows")
    kept = unique if keep is None else unique.filter(F.coalesce(keep, F.lit(False)))
    return counted.through(kept, "matched"), counted


def unscored(df: DataFrame, scored: DataFrame) -> DataFrame:
    """Rows whose hash has no score yet."""
    return df.join(scored.select("hash").distinct(), "hash", "left_anti")
