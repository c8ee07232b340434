"""Line dedup: content-defined chunks of lines, those met before in the corpus removed.

A text's lines are cut into chunks where the hash of the last two line hashes is a
multiple of `EVERY`. A cut depends on those two lines only, so lines put in or taken out
elsewhere leave it where it was. A line of `LONG` characters or more is passage enough
to be a chunk of its own. Chunks shorter than `LEAST` characters are never removed.

Chunk hashes are counted over the corpus; chunks with a hash met twice are then compared
byte by byte by grouping on the chunk itself. Of equal chunks the first is kept, in order
of document id, text hash and place; the others are removed from their texts.

Defined cases: a null text stays null, an empty one empty. Rows with the same id and text
are one document and get the same result. A null id comes first. Texts keep every
character outside removed chunks; the line feed after a removed chunk goes with it.
Other columns are kept as they are, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.session import materialise

#: Mean number of short lines of a chunk.
EVERY = 4
LONG = 120
LEAST = 120

# Line feeds inside a chunk are written as this mark and "b", the mark as itself and "a".
_MARK = "\x01"


def _chunks(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with `__chunks`, the escaped chunks of a text, null for a null text."""
    lines = F.split(F.replace(F.col(text), F.lit(_MARK), F.lit(_MARK + "a")), "\n", -1)
    known = rows.withColumn("__lines", F.transform(lines, lambda x: F.struct(
        x.alias("line"), F.xxhash64(x).alias("hash"), (F.length(x) >= LONG).alias("long")
    )))
    before = F.concat(F.array(F.lit(0).cast("long")), F.transform("__lines", lambda x: x["hash"]))
    after = F.concat(F.expr("slice(transform(__lines, x -> x.long), 2, size(__lines))"), F.array(F.lit(True)))
    known = known.withColumn("__cuts", F.zip_with(
        F.zip_with("__lines", F.slice(before, F.lit(1), F.size("__lines")), lambda x, b: F.struct(
            x["line"].alias("line"),
            (x["long"] | (F.pmod(F.xxhash64(b, x["hash"]), F.lit(EVERY)) == 0)).alias("cut"),
        )),
        after, lambda x, n: F.concat(x["line"], F.when(x["cut"] | n, F.lit("\n")).otherwise(F.lit(_MARK + "b"))),
    ))
    joined = known.withColumn("__joined", F.array_join("__cuts", ""))
    # The last line's cut is no line feed of the text.
    whole = F.left("__joined", F.length("__joined") - 1)
    return joined.withColumn("__chunks", F.split(whole, "\n", -1)).drop("__lines", "__cuts", "__joined")


def _plain(escaped: Column) -> Column:
    return F.replace(F.replace(escaped, F.lit(_MARK + "b"), F.lit("\n")), F.lit(_MARK + "a"), F.lit(_MARK))


def _flags(rows: DataFrame, name: str) -> DataFrame:
    """(id, hash, name): for each document with a true ``flag`` the flags of its chunks in order."""
    listed = F.sort_array(F.collect_list(F.struct("at", "flag")))
    return (
        rows.groupBy("id", "hash").agg(listed.alias("all"), F.max("flag").alias("any")).filter("any")
        .select("id", "hash", F.transform("all", lambda x: x["flag"]).alias(name))
    )


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with `__text`, the text without repeated chunks, and `__removed`, how many went."""
    own = docs.select(
        F.col(id_column).alias("id"), F.xxhash64(text_column).alias("hash"), F.col(text_column).alias("text")
    )
    hashes = F.transform("__chunks", lambda c: F.when(F.length(c) >= LEAST, F.xxhash64(c)))
    narrow = materialise(
        _chunks(own, "text").select("id", "hash", hashes.alias("chunks")).filter("chunks IS NOT NULL")
        .dropDuplicates(["id", "hash"]),
        "chunks",
    )
    placed = narrow.select("id", "hash", F.posexplode("chunks").alias("at", "chunk"))
    repeated = placed.filter("chunk IS NOT NULL").groupBy("chunk").agg(F.count("*").alias("k")).filter("k > 1")
    marked = materialise(
        placed.join(repeated, "chunk", "left").select("id", "hash", "at", F.col("k").isNotNull().alias("flag")), "marked"
    )

    # Byte comparison: equal chunks are equal texts; of each the first place is kept.
    def key(left: DataFrame, right: DataFrame) -> Column:
        return left["id"].eqNullSafe(right["id"]) & (left["hash"] == right["hash"])

    suspect = _flags(marked, "flags").withColumnsRenamed({"id": "i", "hash": "h"})
    met = own.join(suspect, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h"))).drop("i", "h")
    paired = _chunks(met, "text").select(
        "id", "hash", F.posexplode(F.zip_with("__chunks", "flags", lambda c, f: F.when(f, c))).alias("at", "chunk")
    ).filter("chunk IS NOT NULL")
    firsts = paired.groupBy("chunk").agg(F.min(F.struct("id", "hash", "at")).alias("first")).select("first.*")
    kept = firsts.withColumnsRenamed({"id": "i", "hash": "h", "at": "a"})
    gone = marked.filter("flag").join(
        kept, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")) & (F.col("at") == F.col("a")), "left_anti"
    ).withColumn("gone", F.lit(True)).withColumnsRenamed({"id": "i", "hash": "h", "at": "a"})
    decided = marked.join(
        gone.select("i", "h", "a", "gone"),
        F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")) & (F.col("at") == F.col("a")), "left",
    ).select("id", "hash", "at", F.col("gone").isNotNull().alias("flag"))
    removed = _flags(decided, "__gone").withColumnsRenamed({"id": "__i", "hash": "__h"})

    keyed = docs.withColumns({"__id": F.col(id_column), "__hash": F.xxhash64(text_column)})
    joined = keyed.join(removed, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h")), "left")
    # Only texts that lose something are cut again.
    joined = joined.withColumn("__cut", F.when(F.col("__gone").isNotNull(), F.col(text_column)))
    rest = F.filter(F.zip_with("__chunks", "__gone", lambda c, g: F.when(~g, c)), lambda c: c.isNotNull())
    return (
        _chunks(joined, "__cut")
        .withColumns({
            "__text": F.when(F.col("__gone").isNull(), F.col(text_column)).otherwise(_plain(F.array_join(rest, "\n"))),
            "__removed": F.coalesce(F.size(F.filter("__gone", lambda g: g)), F.lit(0)),
        })
        .select(*docs.columns, "__text", "__removed")
    )


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the text, and its length if there is such a column, without repeated chunks."""
    found = deduplicated(docs, id_column, text_column)
    new = {text_column: F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
