"""The registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import (
    conversation_repair, fingerprints, html_content, importance, language, line_dedup, mixing, neighbours, ngram_join, oracles, packing,
    quality, substring_dedup, surrogates,
)
from postmill.llm.samples import remainder


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two of three folds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn(
        "held_out", remainder("doc_id", 3) == 1
    )
    model = language.train(docs.filter("NOT held_out"))
    found = language.with_language(docs.select("doc_id", "held_out", "text"), model)
    return found.select(
        "doc_id", "held_out", F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the chunks of lines that an earlier one has."""
    found = line_dedup.deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"),
        F.col("__removed").cast("long").alias("chunks_removed"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.report(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights of their sources."""
    found = mixing.mix(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def vocabulary() -> tuple[str, str]:
    """The ranks of the public byte-level vocabulary, installed on every machine, and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised and packed into sequences of 1024 tokens."""
    packed = packing.pack(read(spark, sf_dir, "documents"), *vocabulary())
    return packed.withColumnRenamed("id", "doc_id")


def op7_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    text = html_content.content(F.col("html"), html_content.train())
    found = pages.select("page_id", "url", text.alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data and secrets replaced."""
    key = spark.conf.get("postmill.surrogate.key", "example key")
    found = surrogates.replaced(read(spark, sf_dir, "documents").select("doc_id", "text"), key)
    return found.select(
        "doc_id", F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"),
        F.col("__entities").cast("long").alias("entities"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of four of five folds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn(
        "held_out", remainder("doc_id", 5) == 0
    )
    labels = read(spark, sf_dir, "labels").filter("quality IS NOT NULL").groupBy("doc_id").agg(
        F.max("quality").alias("quality")
    )
    model = quality.train(docs.filter("NOT held_out").join(labels, "doc_id"))
    scored = quality.with_quality(docs, model, name="score")
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= quality.GOOD).cast("int").alias("predicted")
    )


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles are 90 % alike."""
    found = ngram_join.similar_texts(read(spark, sf_dir, "documents"), words=3, percent=90)
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's texts, and the 5 % that are drawn."""
    found = importance.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), percent=5, seed=42)
    return found.withColumnRenamed("id", "doc_id")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows, some dropped, emptied, cut, repeated or given to the user, by their keys."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return (
        rows.withColumn("kind", F.crc32(key) % 20).filter("kind <> 0")
        .withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))))
        .select(
            "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(role).alias("role"),
            F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        )
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired by its cheapest edits."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversation_repair.report(damaged(rows))
    every = rows.select("conv_id").distinct()
    none = F.sha2(F.lit(""), 256)
    defaults = {"audit": F.lit(""), "repaired_sha256": none}
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").select(
        "conv_id", *[F.coalesce(c, defaults.get(c, F.lit(0).cast("long"))).alias(c) for c in found.columns if c != "id"]
    )


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, how many are in runs of 35 that are met elsewhere, and what is left."""
    return substring_dedup.report(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_fingerprints": op3_fingerprints,
    "op4_source_mixing": op4_source_mixing,
    "op5_neighbours": op5_neighbours,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_html_content": op7_html_content,
    "op8_pii_surrogates": op8_pii_surrogates,
    "op9_quality": op9_quality,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_substring_dedup": op13_substring_dedup,
}

ORACLES: dict[str, str] = {
    "op10_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
            END AS g FROM w),
        n AS (SELECT doc_id, len(g) AS n FROM s),
        e AS (SELECT doc_id, unnest(g) AS g FROM s),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
            FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
            WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
        u AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id)
        SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id
        FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY ALL""",
    "op11_importance_resampling": oracles.IMPORTANCE,
    "op12_conversation_repair": oracles.CONVERSATIONS,
    "op13_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        s AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
        h AS (SELECT r, i, array_to_string(list_slice(w, i, i + 34), ' ') AS g FROM s),
        m AS (SELECT g FROM h GROUP BY g HAVING count(*) > 1),
        g AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM h SEMI JOIN m ON h.g = m.g),
        k AS (SELECT r, list(j) AS gone FROM g GROUP BY r),
        x AS (SELECT d.r, doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN k ON k.r = d.r),
        u AS (SELECT r, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS j FROM d),
        o AS (SELECT u.r, string_agg(t, ' ' ORDER BY u.j) AS kept FROM u ANTI JOIN g ON g.r = u.r AND g.j = u.j GROUP BY u.r)
        SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM x LEFT JOIN o ON o.r = x.r""",
}
