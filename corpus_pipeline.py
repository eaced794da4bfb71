"""The corpus pipeline: raw documents to packed batches, in stages of one operator of framelode.llm each.

Every stage takes the documents that the one before has written and returns the columns of documents; the last
returns pieces of texts with their places in batches. Other columns than those of documents pass through all stages
but the last. Empty tables, null columns and repeated rows are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelode.llm import mixing, packing, quality, simhash, suffix_dedup
from framelode.llm.common import settle


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.good_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    return simhash.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur at another place too leave the texts; n_chars is counted anew, and no document goes."""
    return suffix_dedup.cut_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, in its order; a document occurs as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed texts with their bucket, batch and place."""
    return packing.pack(docs, with_text=True)


STAGES = [
    ("quality classifier", classify_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("source mixing", mix_sources),
    ("packing", pack_batches),
]

#: Stages of fingerprints, suffix arrays and a fitted scorer have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row on the documents of sf_dir, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, f"stage-{k}")
    return docs
