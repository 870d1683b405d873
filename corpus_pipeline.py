"""A training corpus from the table of documents: filter, deduplicate, mix, pack.

Each stage gets all rows that the one before it kept, as a table read from storage, and all but
the last return the columns of documents. Rows with null or shared ids, null and empty texts and
repeated rows are handled as the operators' docstrings say; a row is judged by itself in the first
stage, and of equal texts one stays in the second. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import exact_dedup, mixing, near_dedup, packing, quality
from foliant.llm.common import cut, documents
from foliant.llm.queries import tokenizer_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the co-trained classifier doesn't refuse, be it for quality or for toxicity."""
    return quality.drop_refused(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def distinct_classes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.drop_near(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's share of words; a document comes as often as the mix repeats it."""
    return mixing.mixed_rows(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in training sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_texts),
    ("near dedup", distinct_classes),
    ("source mixing", mixed_sources),
    ("best-fit packing", packed_sequences),
]

#: A trained classifier, hashed sketches and a tokenizer aren't SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
