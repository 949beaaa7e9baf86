"""The training-data pipeline: five stages over ``documents``, each written and read by the next one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import bpe, decontam, minhash, quality, simhash, substrings
from corpusflow.llm.common import checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer accepts."""
    return quality.good_documents(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: by SimHash, and by five-word Jaccard of 0.8 or more.

    Fingerprints of texts that are 0.8 alike differ in about 10 bits, and balls that reach so far take over 1,000
    variants a document; so these texts meet by the sketches of ``minhash`` and are verified on their whole sets.
    Rows without a doc_id cannot be named and stay; the smallest doc_id of a group stays.
    """
    once = simhash.keep_one(docs)
    return once.join(minhash.copies(docs, similarity=80), "doc_id", "left_anti").select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the word windows that an earlier document has."""
    return substrings.without_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of the ids and of the decoded text."""
    return bpe.encode_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding", encoding_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; every intermediate result is Parquet in the session's shared folder."""
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs
