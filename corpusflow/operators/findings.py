"""REL-10..13, FIND-2/3/8/9: model findings to grounded, distinct, reported findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.functions.rows import bind, explode_rows
from corpusflow.functions.model_json import parse_analysis
from corpusflow.functions.prompts import NOTHING_FOUND
from corpusflow.operators.dedupe import is_meaningful
from corpusflow.settings import MIN_QUOTE_CHARS

# Report texts.
ANALYSIS_FAILED = "Tahlil aniq bo‘lmadi, qayta urinib ko‘ring."
FINDINGS_PRESENT = "Hujjatda ichki ziddiyatlar aniqlandi."
MERGED = " bo‘lim tahlil qilindi; natijalar birlashtirildi va takrorlar olib tashlandi."
CHUNK_NOTE = (
    " Eslatma: hujjat uzunligi sababli bo‘limlarga bo‘lib tahlil qilindi; bo‘limlar oralig‘ini qisman qoplash va "
    "yakuniy moslashtirish qo‘llanildi, ammo uzoq joylashgan ziddiyatlar hali ham qisman qolib ketishi mumkin.")


def quote_in(quote: Column, source: Column) -> Column:
    """REL-10 on normalised texts."""
    return (F.length(quote) >= MIN_QUOTE_CHARS) & F.contains(source, quote)


def summary_grounded(summary: Column, source: Column) -> Column:
    """REL-12 on normalised texts: a quarter of the words of four or more characters occur."""
    long_words = F.filter(F.split(summary, " ", -1), lambda w: F.length(w) >= 4)

    def enough(found: Column) -> Column:
        return (F.size(found) < 4) | (F.size(F.filter(found, lambda w: F.contains(source, w))) * 4 >= F.size(found))

    return F.when(summary == "", F.lit(False)).otherwise(bind(long_words, enough))


def _grounded_items(items: Column, source: Column) -> Column:
    """FIND-3 inside one chunk: the items with both quotes in the source."""
    sided = F.transform(items, lambda i: F.struct(
        i.alias("i"), tx.normalize_for_match(i["statement_a"]).alias("a"),
        tx.normalize_for_match(i["statement_b"]).alias("b")))
    kept = F.filter(sided, lambda s: is_meaningful(s["a"], s["b"], s["i"]["explanation"])
                    & quote_in(s["a"], source) & quote_in(s["b"], source))
    return F.transform(kept, lambda s: s["i"])


def parse_outputs(outputs: DataFrame, chunks: DataFrame) -> DataFrame:
    """FIND-2, FIND-3, FIND-8, REL-13: one row per chunk with grounded results and flags.

    outputs(doc_id, chunk_idx, raw) meet chunks(doc_id, chunk_idx, chunk, chunk_count) once;
    grounding happens in the joined row.
    """
    return parse_rows(chunks.join(outputs, ["doc_id", "chunk_idx"]))


def parse_rows(df: DataFrame) -> DataFrame:
    """As parse_outputs, on chunk rows that already hold ``raw``.

    Columns: summary (null when unparsed), contradictions, key_claims, parse_failed, ungrounded.
    """
    df = df.withColumn("_p", parse_analysis(F.col("raw"))).withColumn("_src", tx.normalize_for_match("chunk"))
    df = (df.withColumn("_found", F.size(F.coalesce("_p.contradictions", F.array().cast(
        "array<struct<statement_a:string,statement_b:string,explanation:string>>"))))
        .withColumn("contradictions", _grounded_items(F.col("_p.contradictions"), F.col("_src")))
        .withColumn("_sum", tx.normalize_for_match("_p.summary")))
    df = df.withColumn("_ok", summary_grounded(F.col("_sum"), F.col("_src")))
    claims = F.filter(F.transform(F.col("_p.key_claims"), lambda c: F.struct(
        c.alias("c"), tx.normalize_for_match(c).alias("n"))),
        lambda c: quote_in(c["n"], F.col("_src")) & (F.length(c["c"]) >= MIN_QUOTE_CHARS))
    parsed = F.col("_p").isNotNull()
    none_left = F.coalesce(F.size("contradictions"), F.lit(0)) == 0
    return df.select(
        "doc_id", "chunk_idx", "chunk_count",
        F.when(parsed & ~F.col("_ok") & ~none_left, F.lit(FINDINGS_PRESENT)).otherwise(F.col("_p.summary"))
        .alias("summary"),
        "contradictions", F.transform(claims, lambda c: c["c"]).alias("key_claims"),
        (~parsed | (~F.col("_ok") & none_left)).alias("parse_failed"),
        (parsed & (((F.col("_found") > 0) & none_left) | ~F.col("_ok"))).alias("ungrounded"))


# Room for the items of one chunk inside the order column of a document.
ITEMS_PER_CHUNK = 1_000_000


def finding_rows(parsed: DataFrame) -> DataFrame:
    """(doc_id, ord, chunk_idx, statement_a, statement_b, explanation); ord follows chunk and item order."""
    rows = explode_rows(parsed, "contradictions", "item", "c", "doc_id", "chunk_idx")
    return rows.select("doc_id", _order("item").alias("ord"), "chunk_idx", "c.*")


def _order(item: str) -> Column:
    return F.col("chunk_idx").cast("long") * ITEMS_PER_CHUNK + F.col(item)


def claim_rows(parsed: DataFrame, findings: DataFrame) -> DataFrame:
    """SET-4: (doc_id, ord, claim): key claims in order, then the quotes of the findings."""
    claims = (explode_rows(parsed, "key_claims", "item", "claim", "doc_id", "chunk_idx")
              .select("doc_id", _order("item").alias("ord"), "claim"))
    after = F.lit(1 << 60)
    quotes = (findings.select("doc_id", "ord", F.posexplode(F.array("statement_a", "statement_b"))
                              .alias("side", "claim"))
              .select("doc_id", (after + F.col("ord") * 2 + F.col("side")).alias("ord"), "claim"))
    return claims.unionByName(quotes)


def filter_grounded(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """REL-11/FIND-3 against whole texts: sources(doc_id, text), normalised once per document."""
    src = sources.select("doc_id", tx.normalize_for_match("text").alias("_src"))
    a, b = tx.normalize_for_match("statement_a"), tx.normalize_for_match("statement_b")
    joined = findings.join(src, "doc_id").withColumn("_a", a).withColumn("_b", b)
    return joined.where(is_meaningful(F.col("_a"), F.col("_b"), F.col("explanation"))
                        & quote_in(F.col("_a"), F.col("_src")) & quote_in(F.col("_b"), F.col("_src"))
                        ).drop("_src", "_a", "_b")


def report(docs: DataFrame, parsed: DataFrame, findings: DataFrame) -> DataFrame:
    """FIND-9, AGG-9, AGG-10: one row per document.

    docs(doc_id, text), parsed chunks and the final findings; columns doc_id, summary,
    finding_count, claim_count, chunk_count, document_length_chars, was_chunked, analysis_failed.
    A document without chunks (no text) is rejected: its row says failed and counts nothing.
    """
    said = F.col("summary").isNotNull()
    chunks = parsed.groupBy("doc_id").agg(
        F.max("chunk_count").alias("chunk_count"), F.count_if(said).alias("summaries"),
        F.min_by("summary", F.when(said, F.col("chunk_idx"))).alias("only_summary"),
        F.sum(F.coalesce(F.size("key_claims"), F.lit(0))).alias("claim_count"),
        F.sum(F.coalesce(F.size("contradictions"), F.lit(0))).alias("chunk_findings"),
        F.bool_or("parse_failed").alias("parse_failed"), F.bool_or("ungrounded").alias("ungrounded"))
    found = findings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("finding_count"))
    df = (docs.select("doc_id", F.length("text").cast("long").alias("document_length_chars"))
          .join(chunks, "doc_id", "left").join(found, "doc_id", "left"))
    rejected = F.col("chunk_count").isNull()
    df = (df.withColumn("rejected", rejected).na.fill(
        0, ["finding_count", "claim_count", "chunk_count", "document_length_chars", "summaries", "chunk_findings"]))
    chunked = F.col("chunk_count") > 1
    failed = (F.col("rejected") | (~chunked & (F.col("chunk_findings") == 0) & (F.col("parse_failed") | F.col("ungrounded")))
              | ((F.col("finding_count") == 0) & F.col("parse_failed") & (F.col("summaries") == 0)))
    base = (F.when((F.col("summaries") == 0) & (F.col("finding_count") == 0), F.lit(NOTHING_FOUND))
            .when(F.col("summaries") == 0, F.lit(FINDINGS_PRESENT))
            .when(F.col("summaries") == 1, F.col("only_summary"))
            .otherwise(F.concat(F.col("chunk_count").cast("string"), F.lit(MERGED))))
    noted = F.concat(base, F.when(chunked, F.lit(CHUNK_NOTE)).otherwise(F.lit("")))
    return df.select(
        "doc_id", F.when(failed, F.lit(ANALYSIS_FAILED)).otherwise(noted).alias("summary"),
        F.when(failed, F.lit(0).cast("long")).otherwise(F.col("finding_count")).alias("finding_count"),
        "claim_count", F.col("chunk_count").cast("long").alias("chunk_count"), "document_length_chars",
        chunked.alias("was_chunked"), failed.alias("analysis_failed"))
