"""Registered queries of this folder; each applies its operator to the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import (bpe, budget, decontam, fingerprints, langid, lattice, minhash, negatives, quality, shards,
                            simhash, spelling, substrings)
from corpusflow.llm.oracles import HARD_NEGATIVES, NEAR_DUPLICATES, SPELLING

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_bpe_encoding")
def _bpe(spark, sf_dir):
    return bpe.encode_documents(table(spark, sf_dir), keep_ids=False)


@query("op2_simhash_near_dedup")
def _simhash(spark, sf_dir):
    return simhash.digest(table(spark, sf_dir))


@query("op3_lm_scoring")
def _lm(spark, sf_dir):
    return lattice.scores(table(spark, sf_dir))


@query("op4_quality_classifier")
def _quality(spark, sf_dir):
    return quality.judged(table(spark, sf_dir))


@query("op5_language_id")
def _language(spark, sf_dir):
    return langid.languages(table(spark, sf_dir))


@query("op6_document_fingerprints")
def _fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir))


@query("op7_decontamination")
def _decontamination(spark, sf_dir):
    return decontam.passages(table(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("op8_sharding")
def _sharding(spark, sf_dir):
    return shards.shards(table(spark, sf_dir))


@query("op9_substring_dedup")
def _substrings(spark, sf_dir):
    return substrings.repeated_words(table(spark, sf_dir))


@query("op10_token_counts")
def _counts(spark, sf_dir):
    return budget.token_counts(table(spark, sf_dir))


@query("op11_spelling_variants", SPELLING)
def _spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir))


@query("op12_hard_negatives", HARD_NEGATIVES)
def _negatives(spark, sf_dir):
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


@query("op13_minhash_near_dedup", NEAR_DUPLICATES)
def _minhash(spark, sf_dir):
    return minhash.digest(table(spark, sf_dir))
