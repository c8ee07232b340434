"""Connected components of links held in a DataFrame, without gathering them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from u to a smaller v; each u passes its smallest v on to the others."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.select("u", F.col("m").alias("v")).union(others)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)),
    ).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every linked node; the component is its smallest node.

    Alternates two steps that hang each node's neighbours below its smallest one
    until nothing moves, in a number of rounds that grows with the logarithm of the
    longest path. Each round is a stored table. A node that has no link, or only
    one to itself, has no row; links with a null end are left out.
    """
    edges = materialise(
        links.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "links",
    )
    before = _state(edges)
    while before[0]:
        edges = materialise(_small_star(_large_star(edges).distinct()).distinct(), "links")
        now = _state(edges)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return nodes.union(roots)
