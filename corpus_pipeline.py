"""The corpus pipeline: stages over documents, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame of all that its decisions
leave of ``docs``; all but the last return the columns of documents. A stage handles
nulls, empty texts, repeated rows, other columns and empty tables as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postmill.llm import language, line_dedup, mixing, ngram_join, packing
from postmill.llm.queries import vocabulary
from postmill.session import materialise

#: Training and the search for a plan cannot be written in SQL; tests compare with
#: brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go."""
    return language.accepted(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that an earlier document has go from the texts."""
    return line_dedup.without_repeats(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays."""
    return ngram_join.one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as the mix of sources has them."""
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, laid into sequences."""
    return packing.pack(docs, *vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialise(docs, f"stage{number}")
    return docs
