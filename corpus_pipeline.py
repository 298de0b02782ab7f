"""The corpus pipeline: documents through quality rules, toxicity, near-duplicate removal and packing.

Each stage works on all that the one before kept; all but the last give back documents with every column they came with, whatever further
columns these have and whatever they are called. Defined results: a document with a null or empty text, or without words, passes the
filters and is in no window; a null language is a language of its own; a document with a null doc_id is judged like others, has no near
duplicates, and comes before the others in the windows; repeated rows are judged each for itself until near-duplicate removal, which
leaves one of them; of equal documents that of least doc_id stays; without labels of both classes nothing is toxic; texts of any length
are worked on whole, and one of more words than a window goes on over several; an empty table gives no window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm import jaccard_join, packing, quality_rules, storage, toxicity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose n-gram perplexity lies outside their language's band."""
    return quality_rules.filter_documents(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without toxic documents."""
    return toxicity.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.remove_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("toxicity", clean), ("n-gram Jaccard join", dedup), ("packing", pack)]

#: SQL can't express the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every other stage's are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
