"""The corpus pipeline: rejects poor documents, removes exact and near copies, mixes the sources and packs what is left.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. The mixing stage repeats documents of rarer sources (twice at most) and leaves none out; the packing
stage returns one row for each placed piece: doc_id, piece, shard, bin, offset, tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave.llm import exact_dedup, minhash_dedup, mixing, packing, quality_classifier
from factweave.llm.tables import documents, keep, labels


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, labels(spark, sf_dir))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.keep_one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(docs, max_repeat=2.0, cover=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs).select("doc_id", "piece", "shard", "bin", "offset", "tokens")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Trees, signatures and packing are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = keep(docs)  # the next stage reads it more than once
    return docs
