"""Internal-consistency analysis of many documents (FIND-1..9)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions import prompts as pr
from corpusflow.functions import text as tx
from corpusflow.functions.model_json import parse_analysis
from corpusflow.functions.rows import explode_rows
from corpusflow.operators.answers import over_budget
from corpusflow.operators.chunks import analysis_chunks
from corpusflow.operators.conflicts import conflict_candidates
from corpusflow.operators.dedupe import dedupe_claims, dedupe_findings
from corpusflow.operators.findings import (
    claim_rows, filter_grounded, finding_rows, parse_outputs, parse_rows, report)
from corpusflow.operators.topics import claim_packs, known_findings
from corpusflow.plans.answering import generated
from corpusflow.settings import CONTEXT_TOKENS, checkpointed

_COLUMNS = ("doc_id", "ord", "statement_a", "statement_b", "explanation")
_LATE = 1 << 61   # reconciliation findings come after all chunk findings


@dataclass
class Analysis:
    findings: DataFrame
    claims: DataFrame
    reports: DataFrame


def chunk_prompt(assistant: str = "corpusflow") -> Column:
    """STR-17, STR-19: the prompt of a chunk row."""
    idx, n = F.col("chunk_idx"), F.col("chunk_count")
    return pr.chat_prompt(pr.check_system_prompt(idx, n, assistant), pr.check_user_prompt(F.col("chunk"), idx, n))


def prompts_between(claims: DataFrame, findings: DataFrame, n_ctx: int = CONTEXT_TOKENS, assistant: str = "corpusflow",
                    sizes: DataFrame | None = None) -> DataFrame:
    """FIND-7, STR-18, REL-14: (doc_id, ords, prompt, token_estimate, over_budget): the prompts of the cross-chunk pass.

    Half of the context is for claims, a quarter for known findings. A prompt that is over the budget all the same, or
    a claim that leaves no room for another, is a row that says so and is not sent. ``sizes`` as for claim_packs.
    """
    packs = known_findings(claim_packs(claims, n_ctx // 2, sizes), findings, n_ctx // 4)
    system, user = pr.reconcile_prompts(F.col("claims"), F.col("known"), assistant)
    estimate = tx.estimate_tokens(F.concat_ws(" ", system, user))
    return packs.select("doc_id", "ords", pr.chat_prompt(system, user).alias("prompt"), estimate.alias("token_estimate"),
                        (F.col("refused") | over_budget(estimate, n_ctx)).alias("over_budget"))


def reconcile(claims: DataFrame, findings: DataFrame, docs: DataFrame, chunked: DataFrame,
              generate_fn: Callable[[list[str]], list[str]] | None = None,
              assistant: str = "corpusflow", n_ctx: int = CONTEXT_TOKENS) -> DataFrame:
    """FIND-7: extra findings between chunks of chunked documents with two or more claims.

    With a generator the claims meet in prompts of bounded size; without one, conflict_candidates looks at the claims
    directly. Findings are numbered after all chunk findings, by the places of what they were found in.
    """
    multi = claims.join(chunked, "doc_id", "left_semi")
    if generate_fn is None:
        found = conflict_candidates(multi)
        late = Window.partitionBy("doc_id").orderBy("ord_b", "ord_a", "explanation")
        ordered = found.withColumn("ord", F.lit(_LATE) + F.row_number().over(late))
        return filter_grounded(ordered.select(*_COLUMNS), docs)
    sent = prompts_between(multi, findings, n_ctx, assistant).where(~F.col("over_budget"))
    said = sent.select("doc_id", "ords", generated(F.col("prompt"), generate_fn).alias("answer"))
    parsed = said.select("doc_id", "ords", parse_analysis(F.col("answer")).alias("p"))
    late = Window.partitionBy("doc_id").orderBy("ords", "item")
    rows = (explode_rows(parsed, "p.contradictions", "item", "c", "doc_id", "ords")
            .select("doc_id", (F.lit(_LATE) + F.row_number().over(late)).alias("ord"), "c.*"))
    return filter_grounded(rows.select(*_COLUMNS), docs)


def answered(generate_fn: Callable[[list[str]], list[str]]) -> Callable[[list[str | None]], list[str | None]]:
    """The generator on the prompts that are not null."""
    def run(prompts: list[str | None]) -> list[str | None]:
        said = iter(generate_fn([p for p in prompts if p is not None]))
        return [None if p is None else next(said) for p in prompts]
    return run


def analyze(docs: DataFrame, outputs: DataFrame | None = None,
            generate_fn: Callable[[list[str]], list[str]] | None = None, chunks: DataFrame | None = None,
            n_ctx: int = CONTEXT_TOKENS, assistant: str = "corpusflow") -> Analysis:
    """docs(doc_id, text) -> findings, claims and one report row per document.

    Model outputs come as a table, or from the generator port.  Each stage is cut off with a
    reliable checkpoint, because the de-duplication rounds read it several times.
    """
    if chunks is None:
        chunks = analysis_chunks(docs, "doc_id", "text", n_ctx)
    if outputs is None:
        # The answer is made in the chunk's own row: nothing to join.
        prompt = chunk_prompt(assistant)
        # A prompt over the budget is refused, not cut: its chunk counts as not parsed.
        fits = ~over_budget(tx.estimate_tokens(prompt), n_ctx)
        said = chunks.withColumn("raw", generated(F.when(fits, prompt), answered(generate_fn)))
        parsed = checkpointed(parse_rows(said))
    else:
        parsed = checkpointed(parse_outputs(outputs, chunks))
    rows = finding_rows(parsed).select(*_COLUMNS)
    # Both are read several times from here on.
    claims = checkpointed(dedupe_claims(claim_rows(parsed, rows)))
    first = checkpointed(dedupe_findings(rows))
    chunked = parsed.where(F.col("chunk_count") > 1).select("doc_id").distinct()
    extra = reconcile(claims, first, docs, chunked, generate_fn, assistant, n_ctx)
    whole = dedupe_findings(first.unionByName(extra))
    # Chunked documents are grounded once more against their full text.
    again = filter_grounded(whole.join(chunked, "doc_id", "left_semi"), docs)
    findings = whole.join(chunked, "doc_id", "left_anti").unionByName(again.select(*whole.columns))
    return Analysis(findings, claims, report(docs, parsed, findings))
