"""Scalar functions and array windows over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.catalog.base import (
    collapse, estimate, intent_norm, match_norm, q, query, slug, table, trim_ws, units, words)
from corpusflow.functions import text as tx
from corpusflow.functions.rows import explode_rows
from corpusflow.functions.windows import add_packed_windows, char_windows
from corpusflow.operators.answers import over_budget
from corpusflow.sources.files import classify_uploads, docx_text

# Every document gets one of these before its text, so that rare characters and cue words occur.
OPENINGS = (
    "“Quoted” ‘text’ `here` ʻaʼ İSTANBUL ΣΑΣ", "что это за договор", "what the rights and the contract",
    "nima uchun shartnoma", "plain", "&lt;b&gt; &amp;quot; &amp;lt; &apos;x&apos;",
    "a b c\td", "Про права")


def opened(doc="doc_id", text="text"):
    cues = F.array(*[F.lit(o) for o in OPENINGS])
    return F.concat(F.get(cues, (F.col(doc) % len(OPENINGS)).cast("int")), F.lit(" "), F.col(text))


OPENED = ("([" + ", ".join(q(o) for o in OPENINGS) + f"][(doc_id % {len(OPENINGS)})::INT + 1] || ' ' || text)")


@query("token_estimate", f"""
    SELECT doc_id, {estimate('text')} AS token_estimate, {estimate('text')} > 4096 AS over_budget FROM documents""")
def token_estimate(spark, sf_dir):
    df = table(spark, sf_dir, "documents").withColumn("token_estimate", tx.estimate_tokens("text"))
    return df.select("doc_id", "token_estimate", over_budget(F.col("token_estimate")).alias("over_budget"))


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.sha256_hex("text").alias("content_hash"))


@query("normalize_match", f"SELECT doc_id, md5({match_norm(OPENED)}) AS normalized FROM documents")
def normalize_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(tx.normalize_for_match(opened())).alias("normalized"))


@query("normalize_intent", f"SELECT doc_id, md5({intent_norm(OPENED)}) AS normalized FROM documents")
def normalize_intent(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(tx.normalize_for_intent(opened())).alias("normalized"))


# DuckDB's lower() knows no final sigma, so the slug check leaves capital sigma out.
@query("slugs", f"SELECT doc_id, md5({slug(f"replace({OPENED}, 'Σ', 'S')")}) AS slug FROM documents")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(tx.slugify(F.translate(opened(), "Σ", "S"))).alias("slug"))


def _entities(x):
    for a, b in tx.XML_ENTITIES:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


@query("entities", f"SELECT page_id, md5({_entities('html')}) AS decoded, length({_entities('html')}) AS chars FROM pages")
def entities(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.decode_entities("html").alias("d")).select(
        "page_id", F.md5("d").alias("decoded"), F.length("d").cast("bigint").alias("chars"))


@query("excerpts", f"""
    SELECT doc_id, left(text, 400) AS excerpt,
           CASE WHEN length(text) > 240 THEN left(replace(text, chr(10), ' '), 240) || '…'
                ELSE replace(text, chr(10), ' ') END AS preview,
           'passage: ' || left(text, 80) AS passage
    FROM documents""")
def excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.excerpt("text", 400).alias("excerpt"), tx.preview("text").alias("preview"),
        tx.with_prefix(tx.excerpt("text", 80), "passage: ").alias("passage"))


def _hit_sum(x, cues):
    return "(" + " + ".join(f"contains({x}, {q(c)})::INT" for c in cues) + ")"


@query("detect_language", f"""
    WITH d AS (SELECT doc_id, lower({OPENED}) AS t FROM documents),
    h AS (SELECT doc_id, length(regexp_replace(t, '[^\\x{{400}}-\\x{{4ff}}]', '', 'g')) AS cyr,
                 length(regexp_replace(t, '[^a-z]', '', 'g')) AS lat,
                 {_hit_sum('t', tx.RU_CUES)} AS ru, {_hit_sum('t', tx.UZ_CUES)} AS uz,
                 len(list_intersect({words('t')}, [{', '.join(q(c) for c in tx.EN_CUES)}])) AS en
          FROM d)
    SELECT doc_id, CASE WHEN cyr > lat OR ru >= 2 THEN 'ru' WHEN en >= 2 AND en > uz THEN 'en' ELSE 'uz' END AS language
    FROM h""")
def detect_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.detect_language(opened()).alias("language"))


# A third of the documents (by length) get their last 70 characters written three times.
_LOOPED = "(CASE WHEN length(text) % 3 = 0 THEN text || repeat(right(text, 70), 3) ELSE text END)"


@query("tail_repeats", f"""
    WITH d AS (SELECT doc_id, {_LOOPED} AS t FROM documents)
    SELECT doc_id, length(t) >= 120 AND len(list_filter(range(40, least(240, length(t) // 3) + 1),
           lambda u: right(t, (3 * u)::INT) = repeat(right(t, u::INT), 3))) > 0 AS repeats FROM d""")
def tail_repeats(spark, sf_dir):
    text = F.col("text")
    looped = F.when(F.length(text) % 3 == 0, F.concat(text, F.repeat(F.right(text, F.lit(70)), F.lit(3)))).otherwise(text)
    return (table(spark, sf_dir, "documents").select("doc_id", looped.alias("t"))
            .select("doc_id", tx.tail_repeats("t").alias("repeats")))


@query("sentence_units", f"""
    WITH u AS (SELECT doc_id, {units(trim_ws('text'))} AS u FROM documents)
    SELECT doc_id, unnest(range(len(u))) AS unit, unnest(u) AS text FROM u""")
def sentence_units(spark, sf_dir):
    units = tx.units(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    return explode_rows(table(spark, sf_dir, "documents"), units, "unit", "text", "doc_id")


def _sql_char_windows(step):
    return f"""
    WITH d AS (SELECT doc_id, text, greatest(0, ceil((length(text) - 3072) / {step}.0))::INT AS n FROM documents),
    w AS (SELECT doc_id, text, unnest(range(n + 1))::INT AS part FROM d)
    SELECT doc_id, part, substring(text, part * {step} + 1, 3072) AS text FROM w"""


@query("char_windows", _sql_char_windows(3072 - 1024))
def char_window_rows(spark, sf_dir):
    return explode_rows(table(spark, sf_dir, "documents"), char_windows("text", 3072, 1024), "part", "text", "doc_id")


@query("char_windows_quarter", _sql_char_windows(3072 - 768))
def char_windows_quarter(spark, sf_dir):
    return explode_rows(table(spark, sf_dir, "documents"), char_windows("text", 3072, 1024, 4), "part", "text", "doc_id")


def packed_sql(max_chars: int, overlap: int) -> str:
    """CTE ``packed(doc_id, chunk_idx, chunk_count, text)``: a recursive walk over unit offsets."""
    overlap = min(overlap, max_chars // 2, max_chars - 64)
    step = max_chars - overlap
    return f"""
    trimmed AS (SELECT doc_id, {trim_ws('text')} AS t FROM documents),
    doc_units AS MATERIALIZED (SELECT doc_id, {units('t')} AS u FROM trimmed WHERE length(t) > {max_chars}),
    flat AS (SELECT doc_id, unnest(u) AS s, generate_subscripts(u, 1) AS i FROM doc_units),
    sums AS (SELECT doc_id, i, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS c FROM flat),
    ends AS MATERIALIZED (
        SELECT doc_id, u, [0::BIGINT] || c AS c, len(u) AS n
        FROM doc_units JOIN (SELECT doc_id, list(c ORDER BY i) AS c FROM sums GROUP BY doc_id) USING (doc_id)),
    -- state: units before position s are done; c[s + 1] is the joined length of the first s units plus s
    walk AS (
        SELECT doc_id, 0 AS s, 0 AS seq FROM ends
        UNION ALL
        SELECT doc_id, CASE WHEN over THEN s + 1 ELSE least(e, greatest(s + 1, back)) END, seq + 1
        FROM (SELECT doc_id, s, seq, n, over, e,
                     len(list_filter(c, lambda x: x <= c[e + 1] - {overlap})) - 1 AS back
              FROM (SELECT w.doc_id, w.s, w.seq, x.n, x.c, length(x.u[w.s + 1]) > {max_chars} AS over,
                           len(list_filter(x.c, lambda y: y <= x.c[w.s + 1] + {max_chars} + 1)) - 1 AS e
                    FROM walk w JOIN ends x USING (doc_id)))
        WHERE (over AND s + 1 < n) OR (NOT over AND e < n)),
    spans AS (
        SELECT w.doc_id, w.seq, x.u[w.s + 1] AS unit, length(x.u[w.s + 1]) > {max_chars} AS over,
               array_to_string(x.u[w.s + 1 : len(list_filter(x.c, lambda y: y <= x.c[w.s + 1] + {max_chars} + 1)) - 1], ' ') AS joined
        FROM walk w JOIN ends x USING (doc_id)),
    pieces AS (
        SELECT doc_id, seq, 0 AS part, trim(joined) AS text FROM spans WHERE NOT over
        UNION ALL
        SELECT doc_id, seq, part, trim(substring(unit, part * {step} + 1, {max_chars}))
        FROM (SELECT *, unnest(range(greatest(0, ceil((length(unit) - {max_chars}) / {step}.0))::INT + 1))::INT AS part
              FROM spans WHERE over)
        UNION ALL
        SELECT doc_id, 0, 0, t FROM trimmed WHERE length(t) <= {max_chars} AND t <> ''),
    fresh AS (
        SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY seq, part) AS before FROM pieces WHERE text <> ''),
    packed AS (
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seq, part) - 1)::INT AS chunk_idx,
               count(*) OVER (PARTITION BY doc_id) AS chunk_count, text
        FROM fresh WHERE before IS DISTINCT FROM text)"""


@query("packed_chunks", f"""
    WITH RECURSIVE {packed_sql(900, 600)}
    SELECT doc_id, chunk_idx, chunk_count, text FROM packed""")
def packed_chunks(spark, sf_dir):
    df = add_packed_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "_p", 900, 600)
    return explode_rows(df, "_p", "chunk_idx", "text", "doc_id", F.size("_p").cast("bigint").alias("chunk_count"))


_UPLOAD_EXT = "CASE lang WHEN 'en' THEN 'TXT' WHEN 'fr' THEN 'docx' WHEN 'de' THEN 'pdf' ELSE 'odt' END"


@query("upload_filter", f"""
    WITH f AS (SELECT doc_id, lower({_UPLOAD_EXT}) AS extension, octet_length(encode(text)) * 2000 AS length FROM documents)
    SELECT doc_id, extension,
           CASE WHEN extension NOT IN ('pdf', 'docx', 'txt', 'md') THEN 'unsupported type'
                WHEN length > 20971520 THEN 'too large' END AS reason FROM f""")
def upload_filter(spark, sf_dir):
    ext = F.expr(_UPLOAD_EXT)
    files = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("/in/v1.2/"), "source", F.lit("."), ext).alias("path"),
        (F.octet_length("text").cast("bigint") * 2000).alias("length"))
    return classify_uploads(files).select("doc_id", "extension", "reason")


@query("docx_runs", f"""
    WITH r AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: '{{' || l || '}}') AS l FROM documents)
    SELECT doc_id, md5({collapse("array_to_string(l, ' ')")}) AS text FROM r""")
def docx_runs(spark, sf_dir):
    # A document.xml with one escaped run per line of the document.
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")),
                                  F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    runs = F.transform(F.split(escaped, "\n", -1), lambda line: F.concat(
        F.lit('<w:r><w:t xml:space="preserve">{'), line, F.lit("}</w:t></w:r>")))
    xml = F.concat(F.lit("<w:body>"), F.array_join(runs, ""), F.lit("</w:body>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(docx_text(xml)).alias("text"))
