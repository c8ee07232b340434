"""Bounded samples of labelled rows, and the folds the queries fix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most labels that are told apart, the most frequent ones.
MOST_LABELS = 1000


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % modulus


def by_label(rows: DataFrame, label: str, key: Column, bound: int) -> DataFrame:
    """At most ``bound`` rows in all, as many of each label, chosen by a hash of ``key``.

    Labels are counted over all rows. A filter by the hash leaves about twice a label's
    share, of which the least hashed stay, so the bound holds however many rows are
    alike. Of a label rarer than its share every row stays.
    """
    counted = rows.groupBy(label).count().orderBy(F.col("count").desc(), label).limit(min(MOST_LABELS, bound))
    counts = {r[0]: r[1] for r in counted.collect()}
    if not counts:
        return rows
    each = bound // len(counts)
    wanted = F.lit(False)
    draw = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    for value, count in counts.items():
        wanted = wanted | ((F.col(label) == F.lit(value)) & (draw < min(1.0, 2 * each / count)))
    place = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(key, F.lit(17)), key))
    return rows.filter(wanted).withColumn("_place", place).filter(F.col("_place") <= each).drop("_place")
