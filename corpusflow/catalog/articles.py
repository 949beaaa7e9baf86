"""Pages, lines and chat turns as articles; articles as chunks; chunk vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.catalog.base import collapse, estimate, q, query, slug, table, tokens, trim_ws, words
from corpusflow.functions import text as tx
from corpusflow.functions.rows import explode_rows
from corpusflow.operators.articles import article_rows, clean_documents, fallback_articles
from corpusflow.operators.carry import island_articles, preambles
from corpusflow.operators.chunks import chunk_articles, chunk_stats
from corpusflow.operators.embed import hash_embed
from corpusflow.operators.markup import LAW_PAGE, WEB_PAGE, html_elements
from corpusflow.sources.vectors import attach_vectors, bad_dimension, to_vector_rows

# --- pages ---
_NOISE = "|".join(rf"<{t}[^a-zA-Z][^>]*>.*?</{t}\s*>|<{t}>.*?</{t}\s*>"
                  for t in ("script", "style", "noscript", "nav", "footer"))
_AD = r"""<div[^>]*class="ad"[^>]*>.*?</div\s*>"""
_OPEN = r"<(h1|p|li)( [^>]*)?>"


# References that the pages may hold.
_NAMED = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))


def _decode(x):
    for a, b in _NAMED:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return f"replace({x}, '&amp;', '&')"


# A block runs from its opening tag to the next opening or closing tag of h1, p or li: mark
# every such tag, split at the marks, keep the parts that start with an opening tag.
_ELEMENTS = rf"""
    body AS (SELECT page_id AS id, regexp_extract(html, '(?s)<body.*') AS b FROM pages),
    bare AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(b, '(?s)<!--.*?-->', '', 'g'),
                    '(?s){_NOISE}', ' ', 'g'), '(?s){_AD}', ' ', 'g') AS b FROM body),
    cut AS (SELECT id, string_split(regexp_replace(b, '(</?(h1|p|li)( [^>]*)?>)', chr(1) || '\1', 'g'), chr(1)) AS parts FROM bare),
    blocks AS (SELECT id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM cut),
    texts AS (SELECT id, i, CASE WHEN part LIKE '<h1%' THEN 'clause' ELSE 'text' END AS role,
                     {collapse(_decode("regexp_replace(part, '(?s)<[^>]*>', ' ', 'g')"))} AS text
              FROM blocks WHERE regexp_matches(part, '^{_OPEN}')),
    elements AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY i) - 1)::INT AS pos, role, text
                 FROM texts WHERE text <> '')"""


@query("html_elements", f"WITH {_ELEMENTS} SELECT id, pos, role, NULL AS header_kind, text FROM elements")
def elements_of_pages(spark, sf_dir):
    return html_elements(table(spark, sf_dir, "pages"), "page_id", "html", WEB_PAGE)


_PAGE_ARTICLES = f"""
    {_ELEMENTS},
    placed AS (SELECT *, max(CASE WHEN role = 'clause' THEN pos END) OVER (PARTITION BY id ORDER BY pos) AS opener FROM elements),
    grouped AS (SELECT id, opener, max(CASE WHEN role = 'clause' THEN text END) AS title,
                       coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (role = 'text'), '') AS body
                FROM placed GROUP BY id, opener),
    page_articles AS (
        SELECT id, (row_number() OVER (PARTITION BY id ORDER BY opener) - 1)::INT AS ord, title AS article_title,
               CASE WHEN body = '' THEN title || '.' WHEN starts_with(body, title) THEN body
                    ELSE title || '. ' || body END AS text
        FROM grouped WHERE opener IS NOT NULL)"""


@query("page_articles", f"""
    WITH {_PAGE_ARTICLES}
    SELECT id, ord, '' AS article_number, article_title, '' AS chapter, '' AS section_title, text FROM page_articles""")
def page_articles(spark, sf_dir):
    return article_rows(clean_documents(table(spark, sf_dir, "pages"), "page_id", "html", WEB_PAGE))


@query("page_documents", f"""
    WITH {_PAGE_ARTICLES},
    n AS (SELECT id, count(*) AS n FROM page_articles GROUP BY id),
    p AS (SELECT id, body AS preamble FROM grouped WHERE opener IS NULL)
    SELECT page_id AS id, coalesce(n.n, 0) AS article_count, coalesce(p.preamble, '') AS preamble,
           'structured' AS parse_mode
    FROM pages LEFT JOIN n ON n.id = page_id LEFT JOIN p ON p.id = page_id""")
def page_documents(spark, sf_dir):
    docs = clean_documents(table(spark, sf_dir, "pages"), "page_id", "html", WEB_PAGE)
    return docs.select("id", F.col("article_count").cast("bigint").alias("article_count"), "preamble", "parse_mode")


# --- plain text with headings: each document line is numbered, some become headers ---
_NUMBERED = f"""
    lines AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line,
                     generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    marked AS (SELECT id, i, CASE WHEN i % 7 = 3 THEN i || '-bob. ' || line WHEN i % 7 = 5 THEN i || '-§. ' || line
                      WHEN i % 2 = 0 THEN i || '-modda. ' || line ELSE line END AS l FROM lines),
    flat AS (SELECT id, i, {collapse('l')} AS l FROM marked)"""
_HEAD = "[0-9]+-modda\\.? ?(.*)$"


def _numbered_text():
    lines = F.transform(F.split("text", "\n", -1), lambda line, j: F.when(
        (j + 1) % 7 == 3, F.concat((j + 1).cast("string"), F.lit("-bob. "), line))
        .when((j + 1) % 7 == 5, F.concat((j + 1).cast("string"), F.lit("-§. "), line))
        .when((j + 1) % 2 == 0, F.concat((j + 1).cast("string"), F.lit("-modda. "), line)).otherwise(line))
    return F.array_join(lines, "\n")


@query("line_articles", f"""
    WITH {_NUMBERED},
    kinds AS (SELECT id, i, l, CASE WHEN regexp_matches(l, '^[0-9]+-bob') THEN 'chapter'
                     WHEN regexp_matches(l, '^[0-9]+-§') THEN 'section'
                     WHEN regexp_matches(l, '^[0-9]+-modda\\.') THEN 'clause' ELSE 'text' END AS kind
              FROM flat WHERE l <> ''),
    events AS (SELECT *, max(CASE WHEN kind = 'clause' THEN i END) OVER w AS opener,
                      max(CASE WHEN kind = 'chapter' THEN i END) OVER w AS chapter_at,
                      max(CASE WHEN kind IN ('chapter', 'section') THEN i END) OVER w AS section_at
               FROM kinds WINDOW w AS (PARTITION BY id ORDER BY i)),
    bodies AS (SELECT id, opener, coalesce(string_agg(l, ' ' ORDER BY i) FILTER (kind = 'text'), '') AS body
               FROM events GROUP BY id, opener),
    titled AS (SELECT b.*, k.l AS head, coalesce(c.l, '') AS chapter,
                      CASE WHEN s.kind = 'section' THEN s.l ELSE '' END AS section_title
               FROM bodies b LEFT JOIN events k ON k.id = b.id AND k.i = b.opener
               LEFT JOIN kinds c ON c.id = k.id AND c.i = k.chapter_at
               LEFT JOIN kinds s ON s.id = k.id AND s.i = k.section_at),
    clauses AS (SELECT id, opener, regexp_extract(head, '^([0-9]+)-', 1) AS article_number,
                       trim(regexp_extract(head, '^{_HEAD}', 1)) AS article_title, chapter, section_title, body
                FROM titled WHERE opener IS NOT NULL),
    -- an untitled article holds the text before the first article line
    loose AS (SELECT id, body FROM titled WHERE opener IS NULL AND body <> '')
    SELECT id, article_number, article_title, chapter, section_title,
           concat_ws('. ', nullif(article_title, ''), nullif(body, '')) AS text
    FROM clauses WHERE article_title <> '' OR body <> ''
    UNION ALL SELECT id, '', '', '', '', body FROM loose""")
def line_articles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), _numbered_text().alias("lines"))
    return article_rows(fallback_articles(docs, "lines", LAW_PAGE)).drop("ord")


# --- law pages: the numbered lines in nested markup, inside a container with a menu before and a footer after it.
# Every fifth line has noise three levels deep before it, a rule's element around it and another one after it, and
# phrases of the interface. ---
_NOISE_IN_NOISE = ('<div class="ACT_TEXT lx_elem"><div><div class="lx_no_select">bir<div class="lx_no_select">ikki<div '
                   'class="INDEXES_ON_REF">uch</div> ikki</div><br> bir</div>Audioni TINGLASH <span class=lx_elem>')
_NESTED = '</span> lexuz sharhi davomi<div class="ACT_TEXT">ichki band</div></div>'


def _law_page():
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    def element(line, j):
        n = (j + 1).cast("string")
        return (F.when((j + 1) % 7 == 3, F.concat(F.lit('<div class="TEXT_HEADER_DEFAULT lx_elem"><b>'), n, F.lit("-bob.</b> "), line))
                .when((j + 1) % 2 == 0, F.concat(F.lit('<div class="CLAUSE_DEFAULT lx_elem"><a>'), n, F.lit("-modda. "), line, F.lit("</a>")))
                .when((j + 1) % 5 == 1, F.concat(F.lit(_NOISE_IN_NOISE), line, F.lit(_NESTED)))
                .otherwise(F.concat(F.lit('<div class="ACT_TEXT lx_elem"><div><span class="lx_no_select">qator</span>'), line,
                                    F.lit("</div>"))))

    body = F.array_join(F.transform(F.split(escaped, "\n", -1), lambda x, j: F.concat(element(x, j), F.lit("</div>"))), "\n")
    return F.concat(F.lit('<html><body><div>menyu</div><div id="divCont">'), body,
                    F.lit('</div><div class="ACT_TEXT">quyi qism &copy;</div></body></html>'))


@query("law_articles", f"""
    WITH lines AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line,
                          generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    kinds AS (SELECT id, i, CASE WHEN i % 7 = 3 THEN 'chapter' WHEN i % 2 = 0 THEN 'clause' ELSE 'text' END AS kind,
                     {collapse("CASE WHEN i % 7 = 3 THEN i || '-bob. ' || line WHEN i % 2 = 1 AND i % 5 = 1 THEN line || ' davomi ichki band' ELSE line END")} AS l,
                     -- the inner element's text once more, as an element of its own
                     CASE WHEN i % 7 <> 3 AND i % 2 = 1 AND i % 5 = 1 THEN ' ichki band' ELSE '' END AS again FROM lines),
    events AS (SELECT *, max(CASE WHEN kind <> 'text' THEN i END) OVER w AS opener,
                      max(CASE WHEN kind = 'chapter' THEN i END) OVER w AS chapter_at
               FROM kinds WINDOW w AS (PARTITION BY id ORDER BY i)),
    bodies AS (SELECT id, opener, coalesce(string_agg(l || again, ' ' ORDER BY i) FILTER (kind = 'text' AND l <> ''), '') AS body
               FROM events GROUP BY id, opener),
    clauses AS (SELECT k.id, k.i::VARCHAR AS article_number, k.l AS title, coalesce(c.l, '') AS chapter, b.body
                FROM events k JOIN bodies b ON b.id = k.id AND b.opener = k.i LEFT JOIN kinds c ON c.id = k.id AND c.i = k.chapter_at
                WHERE k.kind = 'clause' AND (k.l <> '' OR b.body <> '')),
    -- a page without articles is read as plain text
    plain AS (SELECT id, string_agg(l, ' ' ORDER BY i) FILTER (kind = 'text' AND l <> '') AS body
              FROM kinds WHERE id NOT IN (SELECT id FROM clauses) GROUP BY id)
    SELECT id, article_number, title AS article_title, chapter, '' AS section_title,
           CASE WHEN title = '' THEN body WHEN body = '' THEN title || '.'
                WHEN starts_with(body, title) THEN body ELSE title || '. ' || body END AS text FROM clauses
    UNION ALL SELECT id, '', '', '', '', body FROM plain WHERE body <> ''""")
def law_articles(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select("doc_id", _law_page().alias("html"))
    return article_rows(clean_documents(pages, "doc_id", "html", LAW_PAGE)).drop("ord")


# --- chat turns as elements: one role opens headers, one opens clauses, the rest is text ---
def _turns_sql(header: str, clause: str) -> str:
    return f"""
    turns AS (SELECT conv_id, turn AS pos, CASE role WHEN '{header}' THEN 'header' WHEN '{clause}' THEN 'clause' ELSE 'text' END AS role,
                     {collapse('text')} AS text FROM conversations),
    seen AS (SELECT *, max(CASE WHEN role <> 'text' THEN pos END) OVER w AS opener,
                    min(CASE WHEN role = 'header' THEN pos END) OVER w AS chapter_at,
                    max(CASE WHEN role = 'header' THEN pos END) OVER w AS header_at
             FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY pos))"""


def _turns(spark, sf_dir, header, clause):
    role = F.when(F.col("role") == header, "header").when(F.col("role") == clause, "clause").otherwise("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("pos"), role.alias("role"),
        F.when(F.col("role") == header, "generic").alias("header_kind"), tx.collapse_ws("text").alias("text"))


@query("carry_forward", f"""
    WITH {_turns_sql('system', 'user')},
    grouped AS (SELECT conv_id, opener AS pos, min(chapter_at) AS chapter_at, min(header_at) AS header_at,
                       coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (role = 'text'), '') AS body
                FROM seen WHERE opener IS NOT NULL GROUP BY conv_id, opener)
    SELECT g.conv_id, g.pos, t.text AS article_title, coalesce(c.text, '') AS chapter,
           CASE WHEN g.header_at > g.chapter_at THEN h.text ELSE '' END AS section_title,
           CASE WHEN body = '' THEN t.text || '.' WHEN starts_with(body, t.text) THEN body ELSE t.text || '. ' || body END AS text
    FROM grouped g JOIN turns t ON t.conv_id = g.conv_id AND t.pos = g.pos AND t.role = 'clause'
    LEFT JOIN turns c ON c.conv_id = g.conv_id AND c.pos = g.chapter_at
    LEFT JOIN turns h ON h.conv_id = g.conv_id AND h.pos = g.header_at""")
def carry_forward(spark, sf_dir):
    return island_articles(_turns(spark, sf_dir, "system", "user"), "conv_id")


@query("turn_preambles", f"""
    WITH {_turns_sql('user', 'system')}
    SELECT s.conv_id, string_agg(s.text, ' ' ORDER BY s.pos) AS preamble
    FROM seen s LEFT JOIN turns o ON o.conv_id = s.conv_id AND o.pos = s.opener
    WHERE s.role = 'text' AND (s.opener IS NULL OR o.role = 'header') GROUP BY s.conv_id""")
def turn_preambles(spark, sf_dir):
    return preambles(_turns(spark, sf_dir, "user", "system"), "conv_id")


# --- documents as articles, cut into chunks ---
def document_articles(spark, sf_dir):
    title = F.concat_ws(" ", "lang", F.translate("source", "0123456789", ""))
    number = F.when(F.col("n_chars") % 2 == 0, F.col("doc_id").cast("string")).otherwise("")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.lit(0).alias("ord"),
        F.col("source").alias("law_name"), number.alias("article_number"), title.alias("article_title"),
        F.col("lang").alias("chapter"), F.lit(None).cast("string").alias("section_title"), "text")


_TITLE = "lang || ' ' || translate(source, '0123456789', '')"
CHUNKS_SQL = f"""
    doc_words AS (SELECT doc_id, lang, source, n_chars, {trim_ws('text')} AS t, {words('text')} AS w FROM documents),
    est AS (SELECT *, len(w) AS n, {tokens('len(w)')} AS e FROM doc_words WHERE len(w) > 0),
    parts AS (SELECT *, CASE WHEN e <= 500 THEN 1 ELSE 1 + greatest(0, ceil((n - 384) / 346.0))::INT END AS part_count FROM est),
    rows AS (SELECT *, unnest(range(part_count))::INT AS part_index FROM parts),
    chunks AS (
        SELECT 'd' || doc_id || '__art-' || CASE WHEN n_chars % 2 = 0 THEN doc_id::VARCHAR ELSE {slug(_TITLE)} END
                   || CASE WHEN part_count > 1 THEN '__p' || (part_index + 1) ELSE '' END AS id,
               sha256('d' || doc_id || '|0|' || part_index) AS chunk_key,
               CASE WHEN e <= 500 THEN t ELSE array_to_string(w[part_index * 346 + 1 : part_index * 346 + 384], ' ') END AS text,
               source AS law_name, CASE WHEN n_chars % 2 = 0 THEN doc_id::VARCHAR ELSE '' END AS article_number,
               lang AS chapter, '' AS section_title, 'd' || doc_id AS source_id, part_index, part_count
        FROM rows)"""


@query("chunk_rows", f"WITH {CHUNKS_SQL} SELECT *, {estimate('text')} AS token_estimate FROM chunks")
def chunk_rows(spark, sf_dir):
    return chunk_articles(document_articles(spark, sf_dir))


@query("chunk_stats", f"""
    WITH {CHUNKS_SQL}
    SELECT law_name, count(*) AS chunk_count, count(*) FILTER (part_count > 1) AS split_chunks FROM chunks GROUP BY law_name""")
def chunk_statistics(spark, sf_dir):
    return chunk_stats(chunk_articles(document_articles(spark, sf_dir)), "law_name")


DIM = 64


def embedded_sql(texts: str, out: str, dim: int = DIM) -> str:
    """CTE ``out(id, v)``: hashed word counts of the CTE ``texts(id, text)``."""
    lowered = words("lower(text)")
    return f"""
    {out}_w AS (SELECT id, md5(unnest({lowered})) AS h FROM {texts}),
    {out}_s AS (SELECT id, ('0x' || substr(h, 1, 7))::INT % {dim} AS b,
                       CASE WHEN substr(h, 8, 1) < '8' THEN 1 ELSE -1 END AS s FROM {out}_w),
    {out}_b AS (SELECT id, b, sum(s)::DOUBLE AS x FROM {out}_s GROUP BY id, b),
    {out}_g AS (SELECT t.id, i.b, coalesce(x.x, 0.0) AS x
                FROM (SELECT DISTINCT id FROM {texts}) t CROSS JOIN (SELECT unnest(range({dim})) AS b) i
                LEFT JOIN {out}_b x ON x.id = t.id AND x.b = i.b),
    {out} AS (SELECT id, list(x ORDER BY b) AS v FROM {out}_g GROUP BY id)"""


@query("hash_embedding", f"""
    WITH {CHUNKS_SQL}, texts AS (SELECT chunk_key AS id, text FROM chunks), {embedded_sql('texts', 'emb')},
    normed AS (SELECT id, v, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12) AS n FROM emb),
    flat AS (SELECT id, unnest(range({DIM}))::INT AS dim, unnest(v) / n AS x FROM normed)
    SELECT id, dim, round(x, 6) AS x FROM flat WHERE x <> 0""")
def hash_embedding(spark, sf_dir):
    chunks = chunk_articles(document_articles(spark, sf_dir))
    vectors = hash_embed(chunks, "chunk_key", "text", DIM)
    return (explode_rows(vectors, "vector", "dim", "x", "id")
            .where(F.col("x") != 0).withColumn("x", F.round("x", 6)))


@query("vector_rows", f"""
    WITH {CHUNKS_SQL}, texts AS (SELECT chunk_key AS id, text FROM chunks), {embedded_sql('texts', 'emb')}
    SELECT c.id, c.text, c.law_name, c.article_number, c.chapter, c.section_title,
           CASE WHEN e.v IS NULL OR len(e.v) <> {DIM} THEN 1 ELSE 0 END AS bad
    FROM chunks c LEFT JOIN emb e ON e.id = c.chunk_key""")
def vector_rows(spark, sf_dir):
    chunks = chunk_articles(document_articles(spark, sf_dir))
    vectors = hash_embed(chunks, "chunk_key", "text", DIM).select(
        F.col("id").alias("chunk_key"), F.col("vector").alias("embedding_vector"))
    rows = to_vector_rows(attach_vectors(chunks, vectors))
    return rows.withColumn("bad", bad_dimension("embedding_vector", DIM).cast("int")).drop("embedding_vector")


@query("bad_vectors", "SELECT count(*) AS bad FROM embeddings WHERE embedding IS NULL OR len(embedding) <> 64 OR label % 2 = 1")
def bad_vectors(spark, sf_dir):
    # Vectors of odd labels lose one component, so that there is something to find.
    cut = F.when(F.col("label") % 2 == 1, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select(cut.alias("v")).agg(F.count_if(bad_dimension("v", 64)).alias("bad"))
