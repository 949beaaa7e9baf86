"""Vector search, prompts and citations."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from corpusflow.catalog.articles import CHUNKS_SQL, DIM, document_articles, embedded_sql
from corpusflow.catalog.base import any_of, chat_prompt_sql, estimate, intent_norm, q, query, table, trim_ws, words
from corpusflow.catalog.chat import CUES
from corpusflow.functions import prompts as pr
from corpusflow.functions import text as tx
from corpusflow.functions.rows import explode_rows
from corpusflow.operators.answers import build_prompts, citations, retrieval_report
from corpusflow.operators.chunks import chunk_articles
from corpusflow.operators.embed import add_hash_vector, mean_pool
from corpusflow.operators.knn import (
    knn_exact, knn_ivf, knn_stored, recall_at_k, retrieval_metrics, retrieval_summary, train_cells)
from corpusflow.operators.intent import ABOUT, LEGAL, OFF_TOPIC, OUT_OF_SCOPE, SOFT_ABOUT, Assistant
from corpusflow.plans.answering import answer, retrieve
from corpusflow.settings import checkpointed, shared_folder
from corpusflow.sources.vectors import read_vectors, write_vectors


def _corpus(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _questions(spark, sf_dir):
    """One question per label: the normalised mean of its vectors."""
    return mean_pool(_corpus(spark, sf_dir), "label", "vector").withColumnRenamed("id", "qid")


_MEANS = """
    comps AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i, vec_id FROM embeddings),
    mean1 AS (SELECT label AS qid, i, avg(x) AS x FROM comps GROUP BY label, i),
    means AS (SELECT qid, list(x ORDER BY i) AS v FROM mean1 GROUP BY qid)"""
_HITS = f"""
    {_MEANS},
    scored AS (SELECT qid, vec_id AS id, label, round(1 - list_cosine_similarity(v, embedding::DOUBLE[]), 9) AS distance
               FROM means, embeddings),
    hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM scored QUALIFY rank <= 5)"""


@query("mean_pool", """
    WITH comps AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i,
                          CASE WHEN vec_id % 3 <> 0 AND label <> 7 THEN 1 ELSE 0 END AS mask FROM embeddings),
    m AS (SELECT label AS id, i, coalesce(sum(x * mask) / nullif(sum(mask), 0), 0) AS x FROM comps GROUP BY label, i),
    n AS (SELECT id, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM m GROUP BY id)
    SELECT id, (i - 1)::INT AS dim, round(x / n, 6) + 0.0 AS x FROM m JOIN n USING (id)""")
def mean_pool_rows(spark, sf_dir):
    # Two of three vectors are unmasked, and label 7 has none.
    mask = (F.col("id") % 3 != 0) & (F.col("label") != 7)
    pooled = mean_pool(_corpus(spark, sf_dir), "label", "vector", mask)
    return (explode_rows(pooled, "vector", "dim", "x", "id")
            .withColumn("x", F.round("x", 6) + F.lit(0.0)))


@query("knn_exact", f"""
    WITH {_HITS} SELECT qid, id, rank, distance, round(1 - distance, 9) AS score FROM hits""")
def knn_exact_rows(spark, sf_dir):
    return knn_exact(_questions(spark, sf_dir), _corpus(spark, sf_dir))


@query("retrieval_metrics", f"""
    WITH {_HITS}
    SELECT qid, round(count(*) FILTER (label = qid) / 5.0, 6) AS precision_at_k,
           round(coalesce(1.0 / min(rank) FILTER (label = qid), 0), 6) AS reciprocal_rank FROM hits GROUP BY qid""")
def retrieval_metric_rows(spark, sf_dir):
    corpus, questions = _corpus(spark, sf_dir), _questions(spark, sf_dir)
    hits = knn_exact(questions, corpus)
    return retrieval_metrics(hits, questions.select("qid", F.col("qid").alias("label")), corpus.select("id", "label"))


@query("retrieval_summary", f"""
    WITH {_HITS},
    per AS (SELECT qid, count(*) FILTER (label = qid) AS good, coalesce(1.0 / min(rank) FILTER (label = qid), 0) AS rr FROM hits GROUP BY qid),
    n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
    SELECT count(*) AS questions, round(avg(good / 5.0), 6) AS mean_precision, round(avg(good / n.n), 6) AS mean_recall,
           round(avg(round(rr, 6)), 6) AS mean_reciprocal_rank FROM per JOIN n ON n.label = qid""")
def retrieval_summary_row(spark, sf_dir):
    corpus, questions = _corpus(spark, sf_dir), _questions(spark, sf_dir)
    labels = questions.select("qid", F.col("qid").alias("label"))
    return retrieval_summary(knn_exact(questions, corpus), labels, corpus.select("id", "label"))


@query("knn_exact_all", """
    WITH scored AS (SELECT a.vec_id AS qid, b.vec_id AS id,
                           round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS distance
                    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
    SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank, distance,
           round(1 - distance, 9) AS score FROM scored QUALIFY rank <= 5""")
def knn_exact_all(spark, sf_dir):
    corpus = _corpus(spark, sf_dir).select("id", "vector")
    return knn_exact(corpus.withColumnRenamed("id", "qid"), corpus, skip_same=True)


_NEAR = f"""
    {_MEANS},
    near AS (SELECT vec_id, embedding, m.qid AS cell,
                    row_number() OVER (PARTITION BY vec_id ORDER BY round(1 - list_cosine_similarity(m.v, embedding::DOUBLE[]), 9), m.qid) AS r
             FROM embeddings, means m QUALIFY r <= 2),
    scored AS (SELECT a.vec_id AS qid, b.vec_id AS id,
                      round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS distance
               FROM near a JOIN near b ON a.cell = b.cell AND b.r = 1 AND a.vec_id <> b.vec_id)"""


@query("knn_ivf", f"""
    WITH {_NEAR} SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank, distance,
           round(1 - distance, 9) AS score FROM scored QUALIFY rank <= 5""")
def knn_ivf_rows(spark, sf_dir):
    # Every vector asks for its neighbours; the label means serve as coarse cells.
    corpus = _corpus(spark, sf_dir).select("id", "vector")
    cells = _questions(spark, sf_dir).select(F.col("qid").alias("cell"), F.col("vector").alias("centroid"))
    return knn_ivf(corpus.withColumnRenamed("id", "qid"), corpus, cells, nprobe=2, skip_same=True)


@query("ivf_recall_by_label_cells", f"""
    WITH {_NEAR},
    found AS (SELECT qid, id FROM scored QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, id) <= 5),
    every_pair AS (SELECT a.vec_id AS qid, b.vec_id AS id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS distance
                   FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    exact AS (SELECT qid, id FROM every_pair QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, id) <= 5)
    SELECT count(*) AS exact_hits, count(f.qid) AS found_hits, round(count(f.qid) / count(*), 4) AS recall
    FROM exact e LEFT JOIN found f ON f.qid = e.qid AND f.id = e.id""")
def ivf_recall_by_label_cells(spark, sf_dir):
    return recall_at_k(knn_ivf_rows(spark, sf_dir), knn_exact_all(spark, sf_dir))


# --- the vectors stored by cell; the label means ask ---
def _stored_by_cell(spark, sf_dir, cells):
    empty = F.lit("")
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), *[empty.alias(c) for c in ("text", "law_name", "article_number", "chapter", "section_title")],
        F.col("embedding").alias("embedding_vector"), F.col("label").cast("string").alias("source_id"))
    path = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    write_vectors(rows, path, dim=DIM, cells=cells, buckets=2)
    return read_vectors(spark, path, by_cell=True).withColumnRenamed("embedding_vector", "vector")


@query("knn_stored_cells", f"""
    WITH {_MEANS},
    near AS (SELECT vec_id, embedding, m.qid AS cell,
                    row_number() OVER (PARTITION BY vec_id ORDER BY round(1 - list_cosine_similarity(m.v, embedding::DOUBLE[]), 9), m.qid) AS r
             FROM embeddings, means m QUALIFY r = 1),
    asked AS (SELECT a.qid, a.v, m.qid AS cell,
                     row_number() OVER (PARTITION BY a.qid ORDER BY round(1 - list_cosine_similarity(m.v, a.v), 9), m.qid) AS r
              FROM means a, means m QUALIFY r <= 2),
    scored AS (SELECT a.qid, b.vec_id::VARCHAR AS id, round(1 - list_cosine_similarity(a.v, b.embedding::DOUBLE[]), 9) AS distance
               FROM asked a JOIN near b ON a.cell = b.cell)
    SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank, distance,
           round(1 - distance, 9) AS score FROM scored QUALIFY rank <= 5""")
def knn_stored_cells(spark, sf_dir):
    questions = _questions(spark, sf_dir)
    cells = questions.select(F.col("qid").cast("int").alias("cell"), F.col("vector").alias("centroid"))
    return knn_stored(questions, _stored_by_cell(spark, sf_dir, cells), cells)


@query("knn_ivf_recall", """
    WITH n AS (SELECT count(DISTINCT label) AS questions, count(*) AS vectors FROM embeddings)
    SELECT questions * least(5, vectors) AS exact_hits, true AS enough FROM n""")
def knn_ivf_recall(spark, sf_dir):
    """Fitted cells, a table stored by them, and whether nine in ten of the exact hits are found."""
    corpus, questions = checkpointed(_corpus(spark, sf_dir).select("id", "vector")), _questions(spark, sf_dir)
    cells = checkpointed(train_cells(corpus, 8))
    found = knn_stored(questions, _stored_by_cell(spark, sf_dir, cells), cells, nprobe=6)
    exact = knn_exact(questions, corpus).withColumn("id", F.col("id").cast("string"))
    return recall_at_k(found, exact).select("exact_hits", (F.col("recall") >= 0.9).alias("enough"))


# --- retrieval over document chunks; every benchmark item is a question ---
def _chunk_corpus(spark, sf_dir):
    chunks = chunk_articles(document_articles(spark, sf_dir))
    return add_hash_vector(chunks, "text", DIM).drop("id").withColumnRenamed("chunk_key", "id")


# The table is written with older texts first; then the English sources are written again, and all others stay.
@query("vector_table", f"""
    WITH {CHUNKS_SQL}
    SELECT id, CASE WHEN chapter = 'en' THEN text ELSE 'eski ' || text END AS text, law_name, article_number, chapter,
           section_title, source_id, {DIM} AS dim FROM chunks""")
def vector_table(spark, sf_dir):
    rows = add_hash_vector(chunk_articles(document_articles(spark, sf_dir)), "text", DIM).withColumnRenamed("vector", "embedding_vector")
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    write_vectors(rows.withColumn("text", F.concat(F.lit("eski "), "text")), path, dim=DIM)
    write_vectors(rows.where(F.col("chapter") == "en"), path, overwrite=True, dim=DIM)
    return read_vectors(spark, path).withColumn("dim", F.size("embedding_vector")).drop("embedding_vector")


def _items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def _found(spark, sf_dir):
    return retrieve(_items(spark, sf_dir), _chunk_corpus(spark, sf_dir), dim=DIM)


_SEARCHED = f"""
    {CHUNKS_SQL}, passages AS (SELECT chunk_key AS id, text FROM chunks),
    {embedded_sql('passages', 'pv')}, {embedded_sql('asked', 'qv')},
    scored AS (SELECT a.id AS qid, p.id, round(1 - coalesce(list_cosine_similarity(a.v, p.v), 0), 9) AS distance FROM qv a, pv p),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM scored QUALIFY rank <= 5),
    hits AS (SELECT r.qid, r.id, r.rank, r.distance, round(1 - r.distance, 9) AS score, c.law_name, c.article_number,
                    c.chapter, c.section_title, c.text
             FROM ranked r JOIN chunks c ON c.chunk_key = r.id)"""
_RETRIEVED = f"asked AS (SELECT item_id AS id, text FROM benchmark), {_SEARCHED}"


@query("retrieval_report", f"""
    WITH {_RETRIEVED}
    SELECT qid, rank, id, law_name, article_number, chapter, section_title, round(score, 4) AS score, round(distance, 4) AS distance,
           left(replace(text, chr(10), ' '), 240) || CASE WHEN length(text) > 240 THEN '…' ELSE '' END AS preview FROM hits""")
def retrieval_report_rows(spark, sf_dir):
    return retrieval_report(_found(spark, sf_dir))


def _detected(x):
    en = ", ".join(q(c) for c in tx.EN_CUES)
    uz = " + ".join(f"contains(lower({x}), {q(c)})::INT" for c in tx.UZ_CUES)
    hits = f"len(list_intersect({words(f'lower({x})')}, [{en}]))"
    return f"(CASE WHEN {hits} >= 2 AND {hits} > {uz} THEN 'en' ELSE 'uz' END)"


def _system_prompt_sql():
    # The prompt text around language rule and context is the template's own.
    head, middle = pr.answer_frame("corpusflow")
    return (f"{q(head + 'Write in the language of the question (')} || lang || {q(').' + middle)} || context")


_ASKED_LANG = f"{_detected('b.text')}"


@query("prompts", f"""
    WITH {_RETRIEVED},
    ctx AS (SELECT qid, string_agg('[' || law_name || ' — Art. ' || article_number || ']' || chr(10) || 'Chapter: ' || chapter
                   || chr(10) || 'Section: ' || section_title || chr(10) || text, {q(pr.BLOCK_SEPARATOR)} ORDER BY rank) AS context
            FROM hits GROUP BY qid),
    p AS (SELECT b.item_id AS qid, {_ASKED_LANG} AS lang, context, {trim_ws('b.text')} AS "user"
          FROM benchmark b JOIN ctx ON ctx.qid = b.item_id),
    s AS (SELECT qid, lang AS language, {_system_prompt_sql()} AS system, "user" FROM p)
    SELECT qid, language, system, "user", {estimate('system || chr(32) || "user"')} AS token_estimate,
           {estimate('system || chr(32) || "user"')} > 4096 AS over_budget FROM s""")
def prompt_rows(spark, sf_dir):
    return build_prompts(_items(spark, sf_dir), _found(spark, sf_dir))


# --- whole answers: every item as it is, and once more behind an opening that may route it to a fixed reply; the
# generator answers with the digest of its prompt ---
def _digests(prompts):
    return [hashlib.md5(p.encode()).hexdigest() for p in prompts]


@query("answers", f"""
    WITH messages AS (
        SELECT item_id AS qid, text AS question FROM benchmark
        UNION ALL SELECT -1 - item_id, [{', '.join(q(c) for c in CUES)}][(item_id % {len(CUES)})::INT + 1] || ' ' || text FROM benchmark),
    n AS (SELECT *, {intent_norm('question')} AS n FROM messages),
    routed AS (SELECT *, CASE WHEN {any_of('n', Assistant().about_cues())} THEN '{ABOUT}' WHEN {any_of('n', LEGAL)} THEN NULL
                      WHEN {any_of('n', SOFT_ABOUT)} THEN '{ABOUT}' WHEN {any_of('n', OFF_TOPIC)} THEN '{OUT_OF_SCOPE}' END AS intent FROM n),
    asked AS (SELECT qid AS id, question AS text FROM routed WHERE intent IS NULL),
    {_SEARCHED},
    ctx AS (SELECT qid, string_agg('[' || law_name || ' — Art. ' || article_number || ']' || chr(10) || 'Chapter: ' || chapter
                   || chr(10) || 'Section: ' || section_title || chr(10) || text, {q(pr.BLOCK_SEPARATOR)} ORDER BY rank) AS context,
                   string_agg(id || '|' || law_name || '|' || left(text, 400) || '|' || round(score, 4)::DECIMAL(9, 4)::VARCHAR, chr(10) ORDER BY rank) AS "references"
            FROM hits GROUP BY qid),
    p AS (SELECT a.id AS qid, {_detected('a.text')} AS lang, context, "references", {trim_ws('a.text')} AS u FROM asked a JOIN ctx ON ctx.qid = a.id),
    s AS (SELECT qid, {_system_prompt_sql()} AS system, u, "references" FROM p),
    e AS (SELECT *, {estimate('system || chr(32) || u')} > 2048 AS over FROM s)
    SELECT qid, CASE WHEN NOT over THEN md5({chat_prompt_sql('system', 'u')}) END AS answer, "references",
           CASE WHEN over THEN 'prompt_too_long' ELSE 'eog' END AS stop_reason FROM e
    UNION ALL SELECT qid, CASE intent WHEN '{ABOUT}' THEN {q(Assistant().replies()[ABOUT])} ELSE {q(Assistant().replies()[OUT_OF_SCOPE])} END, '', 'static'
    FROM routed WHERE intent IS NOT NULL""")
def answers(spark, sf_dir):
    items = _items(spark, sf_dir)
    cue = F.get(F.array(*[F.lit(c) for c in CUES]), (F.col("qid") % len(CUES)).cast("int"))
    opened = items.select((-1 - F.col("qid")).alias("qid"), F.concat(cue, F.lit(" "), "question").alias("question"))
    found = answer(items.unionByName(opened), _chunk_corpus(spark, sf_dir), _digests, n_ctx=2048, dim=DIM)
    lines = F.transform("references", lambda r: F.concat_ws("|", r["id"], r["code"], r["excerpt"], F.round(r["score"], 4).cast("decimal(9,4)").cast("string")))
    return found.select("qid", "answer", F.array_join(lines, "\n").alias("references"), "stop_reason")


@query("citations", f"""
    WITH {_RETRIEVED}
    SELECT qid, string_agg(id || '|' || law_name || '|' || article_number || '|' || section_title || '|' || left(text, 400)
                           || '|' || round(score, 4)::DECIMAL(9, 4)::VARCHAR, chr(10) ORDER BY rank) AS "references" FROM hits GROUP BY qid""")
def citation_rows(spark, sf_dir):
    refs = citations(_found(spark, sf_dir))
    lines = F.transform("references", lambda r: F.concat_ws(
        "|", r["id"], r["code"], r["article"], r["title"], r["excerpt"],
        F.round(r["score"], 4).cast("decimal(9,4)").cast("string")))
    return refs.select("qid", F.array_join(lines, "\n").alias("references"))
