"""Mixing sources to target weights by entropy balancing.

Rates of documents are chosen as close to 1 as the entropy allows, subject to each
source's words reaching their target and no rate above `LIMIT`. The convex dual has one
multiplier a source, and the rate of a document is `min(LIMIT, exp(multiplier * size /
mean size of its source))`: an exponential tilt. Newton steps on the dual sum gradient
and curvature over the whole corpus, kept as a table of (source, size) with counts, all
sources at once; a step that leaves the bracket of the root is halved into it.

Targets: sources in order of code points, null last, get `WEIGHTS` in turn and share
`SHARE` of all words. A target stops at `LIMIT` times its source; the excess is shared
again by weight until none is above. Only sums are brought to the driver.

Rates become copies by systematic rounding: documents of a source in order of falling
size take the whole numbers that their running sum of rates passes. Of `STARTS` starting
points each source takes the one whose words come nearest to its target; then, a few
times, the one copy is added or left out that brings it nearer still.

Defined cases: a null or empty text has size 0 and is taken without adding words. A null
source is a source of its own, the last. With no words at all every target is 0.
Identical rows are told apart by their rank only and so may get different copies; reruns
give the same rows. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.operators.ranking import with_position
from postmill.session import materialise

# What the mix is to be.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0

STEPS = 25
GAP = 1e-4
STARTS = 32
REPAIRS = 4
#: Parts of a cell of equal source and size, which bound what one rank is taken over.
SALTS = 1024


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(has_source, source, source_size, target) of sources (has_source, source, source_size)."""
    placed = with_position(sources, [F.col("has_source").desc(), "source"], "__place", start=0)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("__place") % len(weights) + 1).cast("int"))
    placed = materialise(placed.withColumn("weight", weight).drop("__place"), "sources")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    cap, level = LIMIT * F.col("source_size"), 0.0
    while total:  # each round stops more sources at their limit, or is the last
        stopped = F.col("weight") * level >= cap
        sums = placed.agg(
            F.sum(F.when(stopped, cap).otherwise(0.0)), F.sum(F.when(stopped, 0.0).otherwise(F.col("weight")))
        ).first()
        if not sums[1]:
            break
        raised = max(level, (share * total - sums[0]) / sums[1])
        if raised == level:
            break
        level = raised
    return placed.select(
        "has_source", "source", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target")
    )


def multipliers(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """(has_source, source, mean, multiplier) that bring each source's words to its target.

    ``cells`` has (has_source, source, size, k): the corpus, counted. A source whose
    target is its limit, or none, has an infinite multiplier.
    """
    keys = ["has_source", "source"]
    known = cells.filter("size > 0").groupBy(*keys).agg(
        (F.sum(F.col("size") * F.col("k")) / F.sum("k")).alias("mean"), F.min("size").alias("least")
    )
    full = F.col("target") >= LIMIT * F.col("source_size") * (1 - 1e-12)
    state = _joined(wanted, known).select(
        *keys, "mean", "source_size", "target",
        F.when(F.col("target") <= 0, float("-inf")).when(full, float("inf")).otherwise(0.0).alias("multiplier"),
        F.lit(float("-inf")).alias("low"),
        (F.log(F.lit(LIMIT)) * F.col("mean") / F.col("least")).alias("high"),
        F.lit(None).cast("double").alias("gap"),
    )
    state = materialise(state, "multipliers")
    open_ = F.abs("multiplier") < float("inf")
    # Cells of sources that are settled take no part.
    active = materialise(
        _joined(cells.filter("size > 0"), state.filter(open_).select(*keys, "mean"))
        .select(*keys, (F.col("size") / F.col("mean")).alias("x"), (F.col("size") * F.col("k")).alias("words")),
        "cells",
    )
    for _ in range(STEPS):
        tilt = F.exp(F.col("multiplier") * F.col("x"))
        sums = _joined(active, state.select(*keys, "multiplier")).groupBy(*keys).agg(
            F.sum(F.col("words") * F.least(F.lit(LIMIT), tilt)).alias("reached"),
            F.sum(F.when(tilt < LIMIT, F.col("words") * F.col("x") * tilt).otherwise(0.0)).alias("curve"),
        )
        over = F.col("reached") - F.col("target")
        moved = _joined(state.filter(open_).drop("gap"), sums).withColumns({
            "gap": F.abs(over) / F.col("target"),
            "low": F.when(over < 0, F.col("multiplier")).otherwise(F.col("low")),
            "high": F.when(over > 0, F.col("multiplier")).otherwise(F.col("high")),
            "step": F.col("multiplier") - over / F.col("curve"),
        })
        inside = (F.col("curve") > 0) & (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        halved = F.when(F.col("low") == float("-inf"), 2 * F.col("high") - 1).otherwise((F.col("low") + F.col("high")) / 2)
        moved = moved.withColumn(
            "multiplier",
            F.when(F.col("gap") <= GAP, F.col("multiplier")).when(inside, F.col("step")).otherwise(halved),
        ).select(state.columns)
        state = materialise(moved.union(state.filter(~open_)), "multipliers")
        if (state.agg(F.max("gap")).first()[0] or 0.0) <= GAP:
            break
    # Sums of parts are added in any order: the last digits may differ between runs.
    return state.select(*keys, "mean", F.round("multiplier", 9).alias("multiplier"))


def _joined(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
    """An inner join on the source, a null one included; null sources are '' with has_source false."""
    return left.join(right, ["has_source", "source", *more])


def _copies(sized: DataFrame) -> DataFrame:
    """(row, has_source, source, size) rows with source_size, target and copies.

    ``row`` orders rows of equal source and size.
    """
    keys = ["has_source", "source"]
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("row", F.lit(29)), F.lit(SALTS)).cast("int"))
    small = materialise(salted.groupBy(*keys, "size", "salt").agg(F.count("*").alias("k")), "counts")
    cells = materialise(small.groupBy(*keys, "size").agg(F.sum("k").alias("k")), "cells")
    wanted = targets(cells.groupBy(*keys).agg(F.sum(F.col("size") * F.col("k")).alias("source_size")))
    tilted = multipliers(cells, wanted)

    rate = (
        F.when(F.col("size") == 0, 1.0).when(F.col("multiplier") == float("inf"), LIMIT)
        .when(F.col("multiplier") == float("-inf"), 0.0)
        .otherwise(F.least(F.lit(LIMIT), F.exp(F.col("multiplier") * F.col("size") / F.col("mean"))))
    )
    # A source with no words at all has no multiplier; its documents are taken once.
    rated = _joined(cells, wanted).join(tilted, keys, "left").withColumn("rate", F.coalesce(rate, F.lit(1.0)))
    larger = Window.partitionBy(*keys).orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rated = materialise(rated.withColumn("before", F.coalesce(F.sum(F.col("k") * F.col("rate")).over(larger), F.lit(0.0))), "rates")

    def passed(start: Column) -> Column:
        """Copies of a whole cell when the running sum begins at ``start``."""
        return F.floor(F.col("before") + F.col("k") * F.col("rate") + start) - F.floor(F.col("before") + start)

    everywhere = Window.partitionBy(*keys)
    misses = F.array(*[
        F.struct(
            F.abs(F.sum(F.col("size") * passed(F.lit(s / STARTS))).over(everywhere) - F.col("target")).alias("miss"),
            F.lit(s / STARTS).alias("start"),
        ) for s in range(STARTS)
    ])
    cell = rated.withColumn("start", F.array_min(misses)["start"]).withColumn(
        "copies", passed(F.col("start")).cast("long")
    )
    for _ in range(REPAIRS):
        short = F.col("target") - F.sum(F.col("size") * F.col("copies")).over(everywhere)
        cell = cell.withColumn("short", short)
        free = F.when(F.col("short") > 0, F.col("copies") < LIMIT * F.col("k")).otherwise(F.col("copies") > 0)
        choice = F.when(free & (F.col("size") > 0), F.struct(F.abs(F.abs("short") - F.col("size")).alias("miss"), "size"))
        cell = cell.withColumn("best", F.min(choice).over(everywhere))
        better = (F.col("size") == F.col("best.size")) & (F.col("best.miss") < F.abs("short"))
        cell = cell.withColumn("copies", F.when(better, F.col("copies") + F.signum("short").cast("long")).otherwise(F.col("copies")))
    cell = cell.select(*keys, "size", "source_size", "target", F.col("k").alias("all"), "copies")
    below = Window.partitionBy(*keys, "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = small.withColumn("ahead", F.coalesce(F.sum("k").over(below), F.lit(0))).drop("k")
    parts = _joined(parts, cell, "size")
    within = Window.partitionBy(*keys, "size", "salt").orderBy("row")
    placed = _joined(salted.withColumn("at", F.row_number().over(within)), parts, "size", "salt")
    return placed.select(
        "row", *keys, "size", "source_size", "target",
        F.expr("(ahead + at) * copies div all - (ahead + at - 1) * copies div all").alias("copies"),
    )


def mix(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """(id, text_hash, source, size, source_size, target, copies) of every row of ``docs``."""
    sized = materialise(docs.select(
        F.struct(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_hash")).alias("row"),
        F.col(source_column).isNotNull().alias("has_source"),
        F.coalesce(F.col(source_column).cast("string"), F.lit("")).alias("source"),
        word_count(F.col(text_column)).alias("size"),
    ), "sizes")
    return _copies(sized).select(
        "row.id", "row.text_hash", F.when(F.col("has_source"), F.col("source")).alias("source"),
        "size", "source_size", "target", "copies",
    )


def mixed(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns unchanged."""
    found = mix(docs, id_column, source_column, text_column).groupBy(
        F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("source").alias("__source")
    ).agg(F.sort_array(F.collect_list("copies"), asc=False).alias("__copies"))
    own = docs.withColumns({
        "__a": F.col(id_column), "__b": F.xxhash64(text_column), "__c": F.col(source_column).cast("string")
    })
    met = own.join(found, F.col("__a").eqNullSafe(F.col("__id")) & (F.col("__b") == F.col("__hash"))
                   & F.col("__c").eqNullSafe(F.col("__source")))
    # Identical rows share out the copies that the mix gave to them.
    same = Window.partitionBy("__id", "__hash", "__source").orderBy(F.xxhash64(*docs.columns))
    times = F.element_at("__copies", F.row_number().over(same)).cast("int")
    return (
        met.withColumn("__times", times)
        .withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__times"))))
        .select(*docs.columns)
    )
