"""Question answering over a corpus, many messages at once (RAG-1..3)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import prompts as pr
from corpusflow.operators.answers import build_prompts, citations
from corpusflow.operators.embed import embed, hash_embed
from corpusflow.operators.intent import Assistant, route, static_answers
from corpusflow.operators.knn import attach_chunks, knn_exact, knn_ivf, knn_stored
from corpusflow.schemas import REFERENCES
from corpusflow.settings import CONTEXT_TOKENS, EMBEDDING_DIM, QUERY_PREFIX, TOP_K, checkpointed

CHUNK_COLUMNS = ("law_name", "article_number", "chapter", "section_title", "text")


def retrieve(questions: DataFrame, corpus: DataFrame, k: int = TOP_K, make_predict_fn: Callable | None = None,
             dim: int = EMBEDDING_DIM, cells: DataFrame | None = None) -> DataFrame:
    """RAG-1: questions(qid, question) -> hits with chunk columns.

    corpus(id, vector, law_name, …).  Search reads only id and vector; texts join the hits.
    """
    if make_predict_fn is None:
        asked = hash_embed(questions, "qid", "question", dim).withColumnRenamed("id", "qid")
    else:
        asked = embed(questions, "question", make_predict_fn, dim, prefix=QUERY_PREFIX, out="vector")
    asked, searched = checkpointed(asked.select("qid", "vector")), corpus.select("id", "vector")  # the model runs once
    if cells is None:
        hits = knn_exact(asked, searched, k)
    elif "cell" in corpus.columns:
        hits = knn_stored(asked, corpus.select("id", "vector", "cell"), cells, k)
    else:
        hits = knn_ivf(asked, searched, cells, k)
    return attach_chunks(hits, corpus, *CHUNK_COLUMNS)


def generated(prompt: Column, generate_fn: Callable[[list[str]], list[str]]) -> Column:
    """Port of the text generator: fn(prompts) -> answers on Arrow batches, in the prompt's own
    row.  Declared non-deterministic, so the optimizer never runs it twice for a row."""
    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series(generate_fn(prompts.tolist()), dtype=object)

    return run.asNondeterministic()(prompt)


def answer(messages: DataFrame, corpus: DataFrame, generate_fn: Callable[[list[str]], list[str]],
           assistant: Assistant = Assistant(), preference: str = "auto", n_ctx: int = CONTEXT_TOKENS,
           k: int = TOP_K, make_predict_fn: Callable | None = None, dim: int = EMBEDDING_DIM,
           cells: DataFrame | None = None) -> DataFrame:
    """RAG-3: messages(qid, question) -> (qid, answer, references, stop_reason).

    Fixed replies skip retrieval; prompts over the budget are refused, not cut.
    """
    routed = route(messages, "question", assistant)
    none = F.array().cast(REFERENCES)
    fixed = static_answers(routed, assistant).select("qid", "answer", none.alias("references"), "stop_reason")
    asked = routed.where(F.col("intent").isNull()).select("qid", "question")
    hits = retrieve(asked, corpus, k, make_predict_fn, dim, cells)
    prompts = build_prompts(asked, hits, preference, assistant.name, n_ctx)
    # Context and citations come from the same k hits, so both are gathered in one pass over them.
    told = prompts.join(citations(hits), "qid", "left").withColumn(
        "references", F.coalesce(F.col("references").cast(REFERENCES), none))
    fits = (told.where(~F.col("over_budget"))
            .withColumn("answer", generated(pr.chat_prompt(F.col("system"), F.col("user")), generate_fn))
            .select("qid", "answer", "references", F.lit("eog").alias("stop_reason")))
    refused = told.where("over_budget").select(
        "qid", F.lit(None).cast("string").alias("answer"), "references", F.lit("prompt_too_long").alias("stop_reason"))
    return fixed.unionByName(fits).unionByName(refused)
