"""Custom sources: named functions that yield posting tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.schema import POSTING, REQUIRED

CustomSource = Callable[[SparkSession], DataFrame]
_registry: dict[str, CustomSource] = {}


def register_source(name: str, source: CustomSource) -> None:
    if name in _registry:
        raise ValueError(f"source already registered: {name}")
    _registry[name] = source


def registered_sources() -> tuple[str, ...]:
    return tuple(sorted(_registry))


def conform(df: DataFrame) -> DataFrame:
    """A custom table in the posting schema; optional columns may be absent."""
    missing = [c for c in (*REQUIRED, "ord") if c not in df.columns]
    if missing:
        raise ValueError(f"custom source lacks columns: {', '.join(missing)}")
    columns = []
    for f in POSTING:
        if f.name in df.columns:
            columns.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            default = F.lit("") if f.name == "last_seen_at" else F.lit(None)
            columns.append(default.cast(f.dataType).alias(f.name))
    return df.select(*columns)


def custom_postings(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """Union of the registered sources, in name order."""
    out = spark.createDataFrame([], POSTING)
    for name in sorted(names if names is not None else _registry):
        if name not in _registry:
            raise ValueError(f"unknown sources: {name}")
        out = out.unionByName(conform(_registry[name](spark)))
    return out
