"""Document fingerprints: SimHash, and all pairs of fingerprints within a Hamming radius.

A text's terms are its five-word runs (`[^\\x20\\x09-\\x0D]+` words as they stand; a text
of fewer words has its whole sequence as one term), weighted by how often they occur.
Each term's hash of `BITS` bits votes with its weight for or against every bit. The votes
are summed by Spark's own aggregation: two counters of 32 bits share one long, so a text
of up to two thousand million terms is counted without overflow.

`near_fingerprints` splits the bits into `radius + 2` blocks. Two fingerprints within
the radius differ in at most `radius` blocks, so they agree on two whole blocks: one
table for each pair of blocks, keyed by a hash of the blocks' bits, meets them all. Equal
fingerprints are one class and meet once, however many rows have it.

Defined cases: a null text is empty; a text without words has the fingerprint of no
terms, all zero. The next document is that with the next smaller id (after the last the
first); rows with the same id follow each other by their text's hash, a null id comes
last. Identical rows get identical fingerprints. Other columns are ignored, an empty
table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import materialise

BITS = 128
WORDS = 5
#: The widest that two equal blocks hold: their bits still tell millions of fingerprints apart.
RADIUS = 8
#: Ranges of ids, each sorted by one task, for every shuffle partition.
RANGES = 4

_LANES = 0x0000000100000001


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _halves(mask: int) -> tuple[int, int]:
    """A mask of BITS bits as two signed longs, high and low."""
    return _signed(mask >> 64), _signed(mask & ((1 << 64) - 1))


def _counters() -> list[Column]:
    """One sum for every two bits: how often each is set, 32 bits apart."""
    return [
        F.sum(F.shiftright(F.col(half), k).bitwiseAND(F.lit(_LANES))).alias(f"{half}_{k}")
        for half in ("high", "low") for k in range(32)
    ]


def _voted(half: str) -> Column:
    """The bits with more votes for than against, as a long."""
    bits = F.lit(0).cast("long")
    for k in range(32):
        both = F.col(f"{half}_{k}")
        for lane, count in ((0, both.bitwiseAND(F.lit(0xFFFFFFFF))), (32, F.shiftrightunsigned(both, 32))):
            bit = F.lit(_signed(1 << (k + lane)))
            bits = bits.bitwiseOR(F.when(2 * count > F.col("n_terms"), bit).otherwise(F.lit(0).cast("long")))
    return bits


def fingerprints(texts: DataFrame, keys: list[str], column: str, kept: list[str]) -> DataFrame:
    """(keys, kept, high, low): the fingerprint of each row's text; keys tell rows apart.

    ``kept`` are long columns, carried along. Where rows of a key are already in one
    partition nothing is shuffled.
    """
    words = F.array_remove(F.split(F.coalesce(F.col(column), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    # Words are hashed once; a term's hash is made of its words' hashes in order.
    hashed = texts.select(*keys, *kept, F.transform(words, lambda w: F.xxhash64(w)).alias("w"))
    shifted = [F.expr(f"slice(w, {k + 1}, greatest(size(w) - {WORDS - 1}, 1))").alias(f"w{k}") for k in range(WORDS)]
    spread = hashed.select(*keys, *kept, F.explode_outer(F.arrays_zip(*shifted)).alias("term"))
    met, parts = F.col("term").isNotNull(), [F.col(f"term.w{k}") for k in range(WORDS)]
    votes = spread.select(
        *keys, *kept, met.alias("met"),
        F.when(met, F.xxhash64(*parts)).alias("high"), F.when(met, F.xxhash64(F.lit(1), *parts)).alias("low"),
    )
    return (
        votes.groupBy(*keys)
        .agg(F.sum(F.col("met").cast("long")).alias("n_terms"), *[F.first(k).alias(k) for k in kept], *_counters())
        .select(*keys, *kept, _voted("high").alias("high"), _voted("low").alias("low"))
    )


def likeness(high_a: Column, low_a: Column, high_b: Column, low_b: Column) -> Column:
    """Share of equal bits."""
    return 1 - (F.bit_count(high_a.bitwiseXOR(high_b)) + F.bit_count(low_a.bitwiseXOR(low_b))) / float(BITS)


def as_text(high: Column, low: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def near_fingerprints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(high_a, low_a, high_b, low_b): all pairs of different fingerprints within the radius.

    Each pair is returned once, the smaller fingerprint first. Both sides are shuffled and
    merged, never broadcast: Spark sizes a table of keys like the classes before the explode,
    some forty times too low.
    """
    blocks = radius + 2
    cuts = [k * BITS // blocks for k in range(blocks + 1)]
    masks = [_halves(sum(1 << b for b in range(*ends))) for ends in zip(cuts, cuts[1:])]
    tables = list(combinations(range(blocks), 2))
    classes = prints.select("high", "low").distinct()

    def key(i: int, j: int) -> Column:
        high, low = masks[i][0] | masks[j][0], masks[i][1] | masks[j][1]
        bits = F.xxhash64(F.col("high").bitwiseAND(F.lit(high)), F.col("low").bitwiseAND(F.lit(low)))
        # One long: the table in the upper 16 bits, a hash of the blocks' bits below.
        return bits.bitwiseAND(F.lit((1 << 48) - 1)).bitwiseOR(F.lit(_signed(i << 56 | j << 48)))

    rows = classes.select("high", "low", F.explode(F.array(*[key(i, j) for i, j in tables])).alias("key"))

    def side(name: str) -> DataFrame:
        return rows.select(*[F.col(c).alias(f"{c}_{name}") for c in rows.columns])

    high, low = F.col("high_a").bitwiseXOR(F.col("high_b")), F.col("low_a").bitwiseXOR(F.col("low_b"))
    equal = [(high.bitwiseAND(F.lit(h)).bitwiseOR(low.bitwiseAND(F.lit(m))) == 0) for h, m in masks]
    # A pair meets in several tables; it counts in that of its first two equal blocks.
    first, second = F.shiftrightunsigned("key_a", 56), F.shiftrightunsigned("key_a", 48).bitwiseAND(F.lit(255))
    met_first = F.lit(True)
    for k in range(blocks):
        own = (F.lit(k) == first) | (F.lit(k) == second)
        met_first = met_first & F.when(own, equal[k]).otherwise((F.lit(k) > second) | ~equal[k])
    return side("a").hint("merge").join(
        side("b").hint("merge"),
        (F.col("key_a") == F.col("key_b"))
        & ((F.col("high_a") < F.col("high_b")) | ((F.col("high_a") == F.col("high_b")) & (F.col("low_a") < F.col("low_b"))))
        & (F.bit_count(high) + F.bit_count(low) <= radius) & met_first,
    ).select("high_a", "low_a", "high_b", "low_b")


def followed(docs: DataFrame) -> DataFrame:
    """(part, at, id, text, next_text, next_part, next_at) of docs (id, text), a null text empty.

    Rows are numbered within ranges of ids, each put in falling order by one task; the
    row after a range's last is added to it, so that the text is shuffled once.
    """
    spark = docs.sparkSession
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(
        F.percentile_approx("id", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("cuts")
    ).first()["cuts"]
    # Parts count downwards with the id; rows without an id come last.
    bounds = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts or []))])
    part = F.when(F.col("id").isNull(), F.lit(ranges + 1)).otherwise(
        F.lit(ranges) - F.size(F.filter(bounds, lambda b: b < F.col("id")))
    )
    placed = docs.select(
        "id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("hash"), part.alias("part")
    )
    order = [F.col("id").desc_nulls_last(), F.col("hash")]
    # One row a range: its first. Ranges are bounded by the number of partitions.
    first = placed.groupBy("part").agg(F.min(F.struct(F.col("id").isNull(), -F.col("id"), "hash")).alias("k")).select(
        "part", (-F.col("k.col2")).alias("id_first"), F.col("k.hash").alias("hash_first")
    )
    around = Window.orderBy("part")
    everyone = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = first.withColumn("before", F.coalesce(F.lag("part").over(around), F.last("part").over(everyone)))
    heads = (
        placed.join(
            F.broadcast(first.withColumnRenamed("part", "p")),
            (F.col("part") == F.col("p")) & F.col("id").eqNullSafe(F.col("id_first")) & (F.col("hash") == F.col("hash_first")),
        )
        .dropDuplicates(["part"])
        .select(F.col("before").alias("part"), "id", "text", "hash", F.col("part").alias("from"))
    )
    rows = placed.withColumn("from", F.lit(None).cast("int")).select("part", "id", "text", "hash", "from").union(heads)
    within = Window.partitionBy("part").orderBy(F.col("from").isNotNull(), *order)
    numbered = rows.withColumn("n", F.row_number().over(within)).withColumns({
        "own": F.coalesce("from", "part"), "at": F.when(F.col("from").isNull(), F.col("n")).otherwise(1)
    })
    return numbered.select(
        F.col("part").cast("long"), F.col("at").cast("long"), "id", "text", "from",
        F.lead("text").over(within).alias("next_text"), F.lead("own").over(within).cast("long").alias("next_part"),
        F.lead("at").over(within).cast("long").alias("next_at"),
    ).filter("from IS NULL").drop("from")


def compared(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of texts, of the same with a half replaced, and how alike they are."""
    rows = followed(docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half),
                      F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumns({
        "n_chars": F.length("text").cast("long"), "sha": F.sha2(F.encode("edited", "UTF-8"), 256),
    })
    sha = {f"sha{k}": F.conv(F.substring("sha", 16 * k + 1, 16), 16, -10).cast("long") for k in range(4)}
    kept = ["id", "n_chars", "next_part", "next_at", *sha]
    rows = rows.withColumns(sha).select(
        "part", "at", *kept,
        F.explode(F.array(F.struct(F.lit(0).alias("edit"), "text"), F.struct(F.lit(1).alias("edit"), F.col("edited").alias("text")))).alias("v"),
    ).select("part", "at", *kept, "v.*")
    prints = fingerprints(rows, ["part", "at", "edit"], "text", kept)
    one = {c: F.max(F.when(F.col("edit") == e, F.col(v))) for e, v, c in (
        (0, "high", "high"), (0, "low", "low"), (1, "high", "edited_high"), (1, "low", "edited_low"))}
    return prints.groupBy("part", "at").agg(
        *[F.max(k).alias(k) for k in kept], *[v.alias(k) for k, v in one.items()]
    ).withColumn(
        "edited_sha256", F.lower(F.concat(*[F.lpad(F.hex(k), 16, "0") for k in sha]))
    ).drop(*sha)


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: both fingerprints, their likeness, that to the next document's
    fingerprint, and how many other fingerprints lie within the radius."""
    found = materialise(compared(docs, id_column, text_column), "fingerprints")
    pairs = near_fingerprints(found, radius)
    ends = pairs.select(F.col("high_a").alias("h"), F.col("low_a").alias("l")).union(pairs.select("high_b", "low_b"))
    near = ends.groupBy("h", "l").agg(F.count("*").alias("n_near"))
    after = found.select(
        F.col("part").alias("p"), F.col("at").alias("q"), F.col("high").alias("after_high"), F.col("low").alias("after_low")
    )
    joined = found.join(after, (F.col("next_part") == F.col("p")) & (F.col("next_at") == F.col("q"))).join(
        near, (F.col("high") == F.col("h")) & (F.col("low") == F.col("l")), "left"
    )
    return joined.select(
        "id", "n_chars", "edited_sha256",
        as_text(F.col("high"), F.col("low")).alias("fingerprint"),
        as_text(F.col("edited_high"), F.col("edited_low")).alias("edited_fingerprint"),
        likeness(F.col("high"), F.col("low"), F.col("edited_high"), F.col("edited_low")).alias("near_edited"),
        likeness(F.col("high"), F.col("low"), F.col("after_high"), F.col("after_low")).alias("near_next"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )
