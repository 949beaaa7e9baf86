"""Round trips through stored tables, the model port, and the chunks of an analysis."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusflow.catalog.articles import CHUNKS_SQL, document_articles
from corpusflow.catalog.base import estimate, query, table
from corpusflow.catalog.text import packed_sql
from corpusflow.functions.rows import explode_rows
from corpusflow.operators.chatlog import session_messages
from corpusflow.operators.chunks import analysis_chunks, chunk_articles
from corpusflow.operators.embed import embed
from corpusflow.schemas import CHUNKS, TARGETS
from corpusflow.settings import CONTEXT_TOKENS, analysis_budget, shared_folder
from corpusflow.sources.stages import read_stage, write_stage
from corpusflow.sources.targets import read_targets


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("stored_targets", """
    SELECT page_id::VARCHAR AS id, 'law ' || page_id AS law_name, NULL::VARCHAR AS title, 'uz' AS language, url FROM pages""")
def stored_targets(spark, sf_dir):
    """SRC-1: the target list as JSON lines; a title is missing in all of them."""
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("id"), F.concat(F.lit("law "), "page_id").alias("law_name"), F.lit("uz").alias("language"), "url")
    path = _folder(spark, "targets")
    pages.write.json(path)
    return read_targets(spark, path).select(*TARGETS.names)


@query("stored_chunks", f"""
    WITH {CHUNKS_SQL}, n AS (SELECT count(*) AS rows, count(*) FILTER (part_count > 1) AS split FROM chunks)
    SELECT c.*, {estimate('text')} AS token_estimate, n.rows AS written, n.split FROM chunks c, n""")
def stored_chunks(spark, sf_dir):
    """SNK-4, SRC-4, SET-1, AGG-5: all documents' chunks in one stage table, read with its declared schema; its counts
    are observed while it is written."""
    path = _folder(spark, "chunks")
    seen = write_stage(chunk_articles(document_articles(spark, sf_dir)), path, counted={"split": F.count_if(F.col("part_count") > 1)})
    return read_stage(spark, path, CHUNKS).withColumn("written", F.lit(seen["rows"])).withColumn("split", F.lit(seen["split"]))


def _counts():
    """A model that counts: characters, letters a, and blanks."""
    import numpy as np

    def predict(texts):
        return np.array([[len(t), t.count("a"), t.count(" ")] for t in texts], np.float32)
    return predict


@query("model_vectors", f"""
    WITH {CHUNKS_SQL},
    t AS (SELECT chunk_key, 'passage: ' || text AS t FROM chunks),
    v AS (SELECT chunk_key, [length(t)::DOUBLE, length(t) - length(replace(t, 'a', '')), length(t) - length(replace(t, ' ', ''))] AS v FROM t),
    n AS (SELECT chunk_key, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v)
    SELECT chunk_key, unnest(range(3))::INT AS dim, round(unnest(v) / n, 5) AS x FROM n""")
def model_vectors(spark, sf_dir):
    """VEC-1: every chunk through the port of the embedding model."""
    rows = embed(chunk_articles(document_articles(spark, sf_dir)), "text", _counts, dim=3)
    return explode_rows(rows, "embedding_vector", "dim", "x", "chunk_key").withColumn("x", F.round(F.col("x").cast("double"), 5))


@query("analysis_chunk_rows", f"""
    WITH RECURSIVE {packed_sql(*analysis_budget(CONTEXT_TOKENS))}
    SELECT doc_id, chunk_idx, chunk_count, text AS chunk, chunk_count = 1 AS single_chunk FROM packed""")
def analysis_chunk_rows(spark, sf_dir):
    """FIND-1, NUM-5."""
    rows = analysis_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", "chunk_idx", F.col("chunk_count").cast("bigint").alias("chunk_count"), "chunk", "single_chunk")


@query("migrated_log", "SELECT conv_id, turn, role, text AS content, 0 AS \"references\" FROM conversations")
def migrated_log(spark, sf_dir):
    """CHAT-4: a log from before references were kept."""
    old = table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")
    return session_messages(old).withColumn("references", F.size("references"))
