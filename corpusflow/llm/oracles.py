"""SQL over the whole tables that the queries of this folder are compared with."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc_steps(i: int) -> int:
    for _ in range(4):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i


# CRC-32 half a byte at a time, over the bytes of code points up to U+00FF.
_HALVES = "[" + ", ".join(f"{_crc_steps(i)}::BIGINT" for i in range(16)) + "]"
_CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(flatten(list_transform(string_split(%s, ''),
        lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [192 + (unicode(ch) >> 6)::BIGINT, 128 + (unicode(ch) & 63)::BIGINT] END)),
        lambda b: [b & 15, b >> 4]))), lambda c, half: xor(c >> 4, {_HALVES}[(xor(c, half) & 15) + 1])), 4294967295::BIGINT)"""

SPELLING = f"""
WITH RECURSIVE runs AS MATERIALIZED (
    SELECT run, h, sum(times) AS times FROM (
        SELECT doc_id, run, count(*) AS times, {_CRC % "coalesce(doc_id::VARCHAR, '') || ':' || run"} AS h
        FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents)
        WHERE length(run) >= 6 GROUP BY doc_id, run) GROUP BY ALL),
words AS MATERIALIZED (
    SELECT word, sum(times)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, times FROM runs)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
shorter AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS part FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
    SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b USING (i, part) WHERE a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM shorter a JOIN words b ON a.part = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM shorter a JOIN words b ON a.part = b.word),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, max(near_n) AS most FROM near GROUP BY word),
forms AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near,
        CASE WHEN b.most >= 5 * w.n THEN (SELECT min(x.near) FROM near x WHERE x.word = w.word AND x.near_n = b.most) END AS form,
        CASE WHEN b.most >= 5 * w.n THEN b.most END AS form_n
    FROM words w LEFT JOIN best b ON w.word = b.word),
steps AS (SELECT word, word AS at_ FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.at_ WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.at_ AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN steps s ON s.word = f.word JOIN forms e ON e.word = s.at_ WHERE e.form IS NULL
"""

HARD_NEGATIVES = """
WITH base AS MATERIALIZED (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM base a JOIN base b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT anchor_id, id, score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
    (row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id))::INTEGER AS rank,
    n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id
WHERE NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
sets AS MATERIALIZED (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
tokens AS MATERIALIZED (SELECT doc_id, unnest(s) AS t FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
    SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * c >= 85 * (len(x.s) + len(y.s) - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS v, doc_id AS r FROM sets UNION SELECT e.b, x.r FROM reached x JOIN both_ways e ON e.a = x.v)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(x.r) AS component_id, s.doc_id = min(x.r) AS kept
FROM sets s JOIN reached x ON x.v = s.doc_id GROUP BY s.doc_id, s.s
"""
