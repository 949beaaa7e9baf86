"""DOC-5 and FIND-1: articles or documents to chunk rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.functions.rows import explode_rows
from corpusflow.functions.windows import add_article_pieces, add_packed_windows
from corpusflow.settings import CONTEXT_TOKENS, MAX_TOKENS, OVERLAP_TOKENS, analysis_budget


def chunk_articles(articles: DataFrame, max_tokens: int = MAX_TOKENS,
                   overlap_tokens: int = OVERLAP_TOKENS) -> DataFrame:
    """DOC-5, WIN-4: (id, chunk_key, text, law_name, article_number, chapter, section_title,
    source_id, token_estimate, part_index, part_count) from (id, ord, law_name, …, text).

    ``id`` follows the published form and may repeat inside a document with equal headings;
    ``chunk_key`` is always unique.
    """
    def clean(name):
        return F.trim(F.coalesce(F.col(name), F.lit("")))

    pieces = (add_article_pieces(articles, "text", "_pieces", max_tokens, overlap_tokens)
              .withColumn("part_count", F.size("_pieces")))
    keep = [c for c in pieces.columns if c not in ("text", "_pieces")]
    rows = explode_rows(pieces, "_pieces", "part_index", "text", *keep)
    cid = tx.chunk_id(F.col("id"), clean("article_number"), F.col("article_title"),
                      F.col("part_index"), F.col("part_count"))
    return rows.select(
        cid.alias("id"),
        F.sha2(F.concat_ws("|", "id", F.col("ord").cast("string"), F.col("part_index").cast("string")), 256)
        .alias("chunk_key"),
        "text", "law_name", clean("article_number").alias("article_number"),
        clean("chapter").alias("chapter"), clean("section_title").alias("section_title"),
        F.col("id").alias("source_id"), tx.estimate_tokens("text").alias("token_estimate"),
        "part_index", "part_count")


def chunk_stats(chunks: DataFrame, key: str = "source_id") -> DataFrame:
    """AGG-1, AGG-2."""
    return chunks.groupBy(key).agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.count_if(F.col("part_count") > 1).alias("split_chunks"))


def analysis_chunks(docs: DataFrame, doc_col: str, text_col: str, n_ctx: int = CONTEXT_TOKENS,
                    max_chars: int | None = None, overlap: int | None = None) -> DataFrame:
    """FIND-1: (doc_id, chunk_idx, chunk, chunk_count, single_chunk); empty documents give no row."""
    default_max, default_overlap = analysis_budget(n_ctx)
    size = max_chars or default_max
    packed = add_packed_windows(docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("_body")),
                                "_body", "_arr", size, default_overlap if overlap is None else overlap)
    rows = explode_rows(packed, "_arr", "chunk_idx", "chunk", "doc_id", F.size("_arr").alias("chunk_count"))
    return rows.withColumn("single_chunk", F.col("chunk_count") == 1)
