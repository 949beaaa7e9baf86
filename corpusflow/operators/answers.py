"""RAG-1..4: prompts, citations and review reports from search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import prompts as pr
from corpusflow.functions import text as tx
from corpusflow.settings import CONTEXT_TOKENS


def contexts(hits: DataFrame) -> DataFrame:
    """AGG-6: (qid, context): the k blocks of a question in rank order."""
    block = pr.context_block(*[F.col(c) for c in ("law_name", "article_number", "chapter", "section_title", "text")])
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return hits.groupBy("qid").agg(
        F.array_join(F.transform(ordered, lambda b: b["block"]), pr.BLOCK_SEPARATOR).alias("context"))


def build_prompts(queries: DataFrame, hits: DataFrame, preference: str = "auto", assistant: str = "corpusflow",
                  n_ctx: int = CONTEXT_TOKENS) -> DataFrame:
    """RAG-2, REL-14: (qid, language, system, user, token_estimate, over_budget)."""
    df = queries.join(contexts(hits), "qid", "left")
    question = F.col("question")
    df = df.select(
        "qid", tx.detect_language(question).alias("language"),
        pr.answer_system_prompt(F.col("context"), pr.language_instruction(question, preference), assistant)
        .alias("system"),
        F.regexp_replace(question, r"(?U)^\s+|\s+$", "").alias("user"))
    df = df.withColumn("token_estimate", tx.estimate_tokens(F.concat_ws(" ", "system", "user")))
    return df.withColumn("over_budget", over_budget(F.col("token_estimate"), n_ctx))


def over_budget(estimate: Column, n_ctx: int = CONTEXT_TOKENS) -> Column:
    """REL-14: such a prompt is refused, never cut."""
    return estimate > n_ctx


def citation() -> Column:
    """REL-17: one hit as a reference."""
    return F.struct(F.col("id"), F.col("law_name").alias("code"), F.col("article_number").alias("article"),
                    F.col("section_title").alias("title"), tx.excerpt("text", 400).alias("excerpt"), F.col("score"))


def citations(hits: DataFrame) -> DataFrame:
    """AGG-7: (qid, references) in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", citation().alias("ref"))))
    return hits.groupBy("qid").agg(F.transform(ordered, lambda r: r["ref"]).alias("references"))


def retrieval_report(hits: DataFrame) -> DataFrame:
    """RAG-4: review rows per question and rank."""
    return hits.select("qid", "rank", "id", "law_name", "article_number", "chapter", "section_title",
                       F.round("score", 4).alias("score"), F.round("distance", 4).alias("distance"),
                       tx.preview("text").alias("preview"))
