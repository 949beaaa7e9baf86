"""Corpus build: snapshots to articles, chunks and vectors as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.articles import article_rows, clean_documents
from corpusflow.operators.chunks import chunk_articles
from corpusflow.operators.embed import add_hash_vector, embed
from corpusflow.operators.markup import LAW_PAGE, MarkupRules
from corpusflow.operators.snapshots import attach_targets
from corpusflow.settings import EMBEDDING_DIM, MAX_TOKENS, OVERLAP_TOKENS


@dataclass
class Corpus:
    documents: DataFrame
    articles: DataFrame
    chunks: DataFrame


def build_corpus(snapshots: DataFrame, targets: DataFrame, rules: MarkupRules = LAW_PAGE,
                 max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> Corpus:
    """snapshots(id, content) x targets(id, law_name, url) -> documents, articles, chunks.

    Parsing and chunking stay inside a document's own row; the only exchange is the join
    with the targets, and that one moves nothing when the target side is small.
    """
    docs = clean_documents(attach_targets(snapshots, targets.select("id", "law_name", "url")), "id", "content", rules)
    articles = article_rows(docs, "law_name")
    documents = docs.select("id", "law_name", F.col("url").alias("source_url"), "article_count", "preamble", "parse_mode")
    return Corpus(documents, articles, chunk_articles(articles, max_tokens, overlap_tokens))


def embed_chunks(chunks: DataFrame, make_predict_fn: Callable | None = None, dim: int = EMBEDDING_DIM) -> DataFrame:
    """Chunks with ``embedding_vector`` from the caller's model, or from the hashing embedder."""
    if make_predict_fn is not None:
        return embed(chunks, "text", make_predict_fn, dim)
    hashed = add_hash_vector(chunks, "text", dim, "embedding_vector")
    return hashed.withColumn("embedding_vector", F.col("embedding_vector").cast("array<float>"))
