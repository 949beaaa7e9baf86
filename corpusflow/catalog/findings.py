"""Model answers to grounded, distinct findings and reports.

Every non-blank line of a document stands for one analysed chunk.  Its model answer is made
from its own sentences: real, swapped, shortened, altered and invented pairs, in five shapes
(snake keys, fenced camel keys, a numeric summary, an invented summary, no JSON at all).
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from corpusflow.catalog.base import WS, chat_prompt_sql, estimate, match_norm, q, query, sentences, table
from corpusflow.functions import text as tx
from corpusflow.functions.rows import explode_rows
from corpusflow.functions.prompts import NOTHING_FOUND, WORDING, reconcile_system
from corpusflow.operators.conflicts import conflict_candidates
from corpusflow.operators.dedupe import (
    dedupe_claims, dedupe_findings, distinct_findings, near_duplicate_pairs, pair_key)
from corpusflow.operators.findings import (
    ANALYSIS_FAILED, CHUNK_NOTE, FINDINGS_PRESENT, MERGED, claim_rows, filter_grounded, finding_rows, parse_outputs, report)
from corpusflow.plans.analysis import analyze, prompts_between
from corpusflow.settings import checkpointed

_INVENTED = "The document describes ticket prices for a concert venue."


def _chunks(spark, sf_dir):
    lines = F.filter(F.split("text", "\n", -1), lambda p: p.rlike(r"(?U)\S"))
    docs = table(spark, sf_dir, "documents").select("doc_id", lines.alias("l"))
    return explode_rows(docs, "l", "chunk_idx", "chunk", "doc_id", F.size("l").alias("chunk_count"))


def _sizes(spark, sf_dir):
    """What the claims of a document are taken from has so many characters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars"))


def _outputs(chunks):
    rows = chunks.withColumn("s", tx.sentences("chunk"))
    a = F.coalesce(F.get("s", F.lit(0)), F.lit(""))
    b = F.coalesce(F.get("s", F.lit(1)), F.lit(""))
    pairs = [(a, b, F.lit("differs")), (b, a, F.lit("swapped")), (F.left(a, F.lit(20)), b, F.lit("shorter")),
             (F.concat(a, F.lit(" etc")), b, F.lit("altered")), (F.lit("Concert starts at 8pm"), F.lit("Tickets cost $50"), F.lit("invented")),
             (a, b, F.lit("These are identical."))]

    def shaped(keys, claims, summary):
        items = F.array(*[F.struct(*[v.alias(k) for k, v in zip(keys, p)]) for p in pairs])
        return F.to_json(F.struct(summary.alias("summary"), items.alias("contradictions"), F.col("s").alias(claims)))

    snake, camel = ("statement_a", "statement_b", "explanation"), ("statementA", "statementB", "explanation")
    head = F.left("chunk", F.lit(120))
    kind = F.col("chunk_idx") % 5
    raw = (F.when(kind == 0, shaped(snake, "key_claims", head))
           .when(kind == 1, F.concat(F.lit("```json\n"), shaped(camel, "keyClaims", head), F.lit("\n```")))
           .when(kind == 2, F.lit('{"summary":5,"contradictions":[]}'))
           .when(kind == 3, shaped(snake, "key_claims", F.lit(_INVENTED)))
           .otherwise(F.concat(F.lit("no json here "), F.col("chunk"))))
    return rows.select("doc_id", "chunk_idx", raw.alias("raw"))


def _parsed(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    return parse_outputs(_outputs(chunks), chunks)


# --- the same in SQL: build the answers, parse them, ground them ---
_JSON_PAIRS = """
    [struct_pack(x := a, y := b, e := 'differs'), struct_pack(x := b, y := a, e := 'swapped'),
     struct_pack(x := left(a, 20), y := b, e := 'shorter'), struct_pack(x := a || ' etc', y := b, e := 'altered'),
     struct_pack(x := 'Concert starts at 8pm', y := 'Tickets cost $50', e := 'invented'),
     struct_pack(x := a, y := b, e := 'These are identical.')]"""


def _json(a, b, claims, summary):
    return (f"json_object('summary', {summary}, 'contradictions', list_transform(p, lambda z: json_object('{a}', z.x, '{b}', z.y, "
            f"'explanation', z.e)), '{claims}', s)::VARCHAR")


_RAW = f"""
    lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^{WS}]')) AS l FROM documents),
    chunks AS (SELECT doc_id, len(l) AS chunk_count, unnest(l) AS chunk, generate_subscripts(l, 1) - 1 AS chunk_idx FROM lines),
    sents AS (SELECT *, {sentences('chunk')} AS s FROM chunks),
    ab AS (SELECT *, coalesce(s[1], '') AS a, coalesce(s[2], '') AS b FROM sents),
    pairs AS (SELECT *, {_JSON_PAIRS} AS p FROM ab),
    outputs AS (SELECT doc_id, chunk_idx, chunk_count, chunk, CASE chunk_idx % 5
        WHEN 0 THEN {_json('statement_a', 'statement_b', 'key_claims', 'left(chunk, 120)')}
        WHEN 1 THEN '```json' || chr(10) || {_json('statementA', 'statementB', 'keyClaims', 'left(chunk, 120)')} || chr(10) || '```'
        WHEN 2 THEN '{{"summary":5,"contradictions":[]}}'
        WHEN 3 THEN {_json('statement_a', 'statement_b', 'key_claims', q(_INVENTED))}
        ELSE 'no json here ' || chunk END AS raw FROM pairs)"""
_AFTER = rf"""
    objects AS (SELECT *, regexp_extract(raw, '(?s)\{{.*\}}') AS o FROM outputs),
    typed AS (SELECT *, CASE WHEN json_valid(o) AND o <> '' AND json_type(o, '$.summary') = 'VARCHAR'
                             AND json_type(o, '$.contradictions') = 'ARRAY' THEN o::JSON END AS j FROM objects),
    fields AS MATERIALIZED (
        SELECT doc_id, chunk_idx, chunk_count, {match_norm('chunk')} AS src, j IS NOT NULL AS parsed, j->>'$.summary' AS summary,
               list_transform(coalesce((j->'$.contradictions')::JSON[], []), lambda c: struct_pack(
                   a := coalesce(c->>'$.statement_a', c->>'$.statementA', ''), b := coalesce(c->>'$.statement_b', c->>'$.statementB', ''),
                   e := coalesce(c->>'$.explanation', ''))) AS items,
               list_transform(coalesce((coalesce(j->'$.key_claims', j->'$.keyClaims'))::VARCHAR[], []), lambda c: trim(c)) AS claims
        FROM typed),
    normed AS (SELECT *, list_transform(list_filter(items, lambda i: trim(i.a) <> '' AND trim(i.b) <> ''), lambda i: struct_pack(
                   a := i.a, b := i.b, e := i.e, na := {match_norm('i.a')}, nb := {match_norm('i.b')})) AS ns,
                   {match_norm('summary')} AS nsum FROM fields),
    grounded AS (SELECT *, list_filter(ns, lambda i: i.na <> '' AND i.nb <> '' AND i.na <> i.nb AND NOT contains(lower(i.e), 'identical')
                   AND length(i.na) >= 12 AND length(i.nb) >= 12 AND contains(src, i.na) AND contains(src, i.nb)) AS kept,
                   list_filter(claims, lambda c: length(c) >= 12 AND length({match_norm('c')}) >= 12 AND contains(src, {match_norm('c')})) AS kept_claims,
                   list_filter(string_split(nsum, ' '), lambda w: length(w) >= 4) AS sw FROM normed),
    checked AS (SELECT *, CASE WHEN NOT parsed THEN NULL WHEN nsum = '' THEN false WHEN len(sw) < 4 THEN true
                   ELSE len(list_filter(sw, lambda w: contains(src, w))) * 4 >= len(sw) END AS ok FROM grounded),
    parsed AS MATERIALIZED (
        SELECT doc_id, chunk_idx, chunk_count, CASE WHEN parsed AND NOT ok AND len(kept) > 0 THEN {q(FINDINGS_PRESENT)} ELSE summary END AS summary,
               CASE WHEN parsed THEN kept END AS kept, CASE WHEN parsed THEN kept_claims END AS kept_claims,
               NOT parsed OR (NOT ok AND len(kept) = 0) AS parse_failed,
               parsed AND ((len(ns) > 0 AND len(kept) = 0) OR NOT ok) AS ungrounded FROM checked),
    finding_rows AS MATERIALIZED (
        SELECT doc_id, chunk_idx * 1000000 + i - 1 AS ord, k.a AS statement_a, k.b AS statement_b, k.e AS explanation, k.na, k.nb
        FROM (SELECT doc_id, chunk_idx, unnest(kept) AS k, generate_subscripts(kept, 1) AS i FROM parsed))"""
_PARSED = f"{_RAW}, {_AFTER}"


@query("parsed_outputs", f"""
    WITH {_PARSED}
    SELECT doc_id, chunk_idx, summary, coalesce(len(kept), -1) AS findings, coalesce(len(kept_claims), -1) AS claims,
           md5(array_to_string(kept_claims, '|')) AS claim_hash, parse_failed, ungrounded FROM parsed""")
def parsed_outputs(spark, sf_dir):
    return _parsed(spark, sf_dir).select(
        "doc_id", "chunk_idx", "summary", F.coalesce(F.size("contradictions"), F.lit(-1)).alias("findings"),
        F.coalesce(F.size("key_claims"), F.lit(-1)).alias("claims"),
        F.md5(F.array_join("key_claims", "|")).alias("claim_hash"), "parse_failed", "ungrounded")


@query("grounded_findings", f"WITH {_PARSED} SELECT doc_id, ord, statement_a, statement_b, explanation FROM finding_rows")
def grounded_findings(spark, sf_dir):
    return finding_rows(_parsed(spark, sf_dir)).drop("chunk_idx")


# All reported pairs, grounded or not, against the whole document instead of the line.
_ALL_ITEMS = """
    all_items AS (SELECT doc_id, chunk_idx * 1000000 + i - 1 AS ord, k.a AS statement_a, k.b AS statement_b, k.e AS explanation, k.na, k.nb
                  FROM (SELECT doc_id, chunk_idx, unnest(ns) AS k, generate_subscripts(ns, 1) AS i FROM normed))"""


def _all_items(spark, sf_dir):
    from corpusflow.functions.model_json import parse_analysis
    raw = _outputs(_chunks(spark, sf_dir)).withColumn("p", parse_analysis(F.col("raw")))
    rows = explode_rows(raw, "p.contradictions", "i", "c", "doc_id", "chunk_idx")
    return rows.select("doc_id", (F.col("chunk_idx").cast("long") * 1_000_000 + F.col("i")).alias("ord"), "c.*")


@query("document_grounding", f"""
    WITH {_PARSED}, {_ALL_ITEMS}, whole AS (SELECT doc_id, {match_norm('text')} AS src FROM documents)
    SELECT doc_id, ord, statement_a, statement_b, explanation FROM all_items JOIN whole USING (doc_id)
    WHERE na <> '' AND nb <> '' AND na <> nb AND NOT contains(lower(explanation), 'identical')
      AND length(na) >= 12 AND length(nb) >= 12 AND contains(src, na) AND contains(src, nb)""")
def document_grounding(spark, sf_dir):
    return filter_grounded(_all_items(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("pair_keys", f"""
    WITH {_PARSED}
    SELECT doc_id, md5(least(na, nb) || '||' || greatest(na, nb)) AS pair, min(ord) AS ord, count(*) AS n FROM finding_rows GROUP BY ALL""")
def pair_keys(spark, sf_dir):
    rows = finding_rows(_parsed(spark, sf_dir))
    key = pair_key(tx.normalize_for_match("statement_a"), tx.normalize_for_match("statement_b"))
    return rows.groupBy("doc_id", F.md5(key).alias("pair")).agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"))


def _near(p, r):
    def m(x, y):
        return f"(contains({x}, {y}) OR contains({y}, {x}))"
    return (f"(({m(f'{p}.na', f'{r}.na')} AND {m(f'{p}.nb', f'{r}.nb')}) OR ({m(f'{p}.na', f'{r}.nb')} AND {m(f'{p}.nb', f'{r}.na')}))")


@query("near_duplicate_pairs", f"""
    WITH {_PARSED}, exact AS (SELECT DISTINCT ON (doc_id, least(na, nb), greatest(na, nb)) * FROM finding_rows
                              ORDER BY doc_id, least(na, nb), greatest(na, nb), ord)
    SELECT p.doc_id, p.ord AS first, r.ord AS second FROM exact p JOIN exact r ON p.doc_id = r.doc_id AND p.ord < r.ord WHERE {_near('p', 'r')}""")
def near_duplicates(spark, sf_dir):
    exact = checkpointed(distinct_findings(finding_rows(_parsed(spark, sf_dir)).drop("chunk_idx")))
    return near_duplicate_pairs(exact)


_FOLDED = f"""
    folded AS MATERIALIZED (
        SELECT doc_id, list_reduce(list([struct_pack(ord := ord, na := na, nb := nb)] ORDER BY ord), lambda acc, x:
            CASE WHEN len(list_filter(acc, lambda k: {_near('k', 'x[1]')})) > 0 THEN acc ELSE acc || x END) AS kept
        FROM finding_rows GROUP BY doc_id),
    distinct_findings AS (SELECT doc_id, unnest(kept).ord AS ord FROM folded)"""


@query("distinct_findings", f"""
    WITH {_PARSED}, {_FOLDED}
    SELECT f.doc_id, f.ord, statement_a, statement_b, explanation FROM finding_rows f JOIN distinct_findings USING (doc_id, ord)""")
def distinct_finding_rows(spark, sf_dir):
    return dedupe_findings(finding_rows(_parsed(spark, sf_dir)).drop("chunk_idx"))


@query("distinct_claims", f"""
    WITH {_PARSED},
    claims AS (SELECT doc_id, chunk_idx * 1000000 + i - 1 AS ord, claim
               FROM (SELECT doc_id, chunk_idx, unnest(kept_claims) AS claim, generate_subscripts(kept_claims, 1) AS i FROM parsed)
               UNION ALL SELECT doc_id, 1152921504606846976 + ord * 2, statement_a FROM finding_rows
               UNION ALL SELECT doc_id, 1152921504606846976 + ord * 2 + 1, statement_b FROM finding_rows),
    n AS (SELECT doc_id, ord, claim, {match_norm('claim')} AS n FROM claims),
    f AS (SELECT doc_id, list_reduce(list([struct_pack(ord := ord, claim := claim, n := n)] ORDER BY ord), lambda acc, x:
            CASE WHEN len(list_filter(acc, lambda k: contains(k.n, x[1].n) OR contains(x[1].n, k.n))) > 0
                 THEN acc ELSE acc || x END) AS kept FROM n WHERE length(n) >= 12 GROUP BY doc_id)
    SELECT doc_id, unnest(kept).ord AS ord, unnest(kept).claim AS claim FROM f""")
def distinct_claims(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    return dedupe_claims(claim_rows(parsed, finding_rows(parsed)), _sizes(spark, sf_dir))


_REPORTS = f"""
    c AS (SELECT doc_id, max(chunk_count) AS chunk_count, count(summary) AS summaries, min_by(summary, chunk_idx) FILTER (summary IS NOT NULL) AS only_summary,
                 sum(coalesce(len(kept_claims), 0))::BIGINT AS claim_count, sum(coalesce(len(kept), 0))::BIGINT AS chunk_findings,
                 bool_or(parse_failed) AS parse_failed, bool_or(ungrounded) AS ungrounded FROM parsed GROUP BY doc_id),
    f AS (SELECT doc_id, count(*) AS n FROM distinct_findings GROUP BY doc_id),
    j AS (SELECT d.doc_id, coalesce(c.chunk_count, 0) AS chunk_count, coalesce(summaries, 0) AS summaries, only_summary,
                 coalesce(c.claim_count, 0) AS claim_count, coalesce(chunk_findings, 0) AS chunk_findings, parse_failed, ungrounded,
                 coalesce(f.n, 0) AS n, coalesce(length(d.text), 0) AS document_length_chars
          FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN f ON f.doc_id = d.doc_id),
    r AS (SELECT *, chunk_count = 0 OR (chunk_count <= 1 AND chunk_findings = 0 AND (parse_failed OR ungrounded)) OR (n = 0 AND parse_failed AND summaries = 0) AS failed FROM j)
    SELECT doc_id, CASE WHEN failed THEN {q(ANALYSIS_FAILED)} ELSE
             CASE WHEN summaries = 0 AND n = 0 THEN {q(NOTHING_FOUND)} WHEN summaries = 0 THEN {q(FINDINGS_PRESENT)}
                  WHEN summaries = 1 THEN only_summary ELSE chunk_count || {q(MERGED)} END
             || CASE WHEN chunk_count > 1 THEN {q(CHUNK_NOTE)} ELSE '' END END AS summary,
           CASE WHEN failed THEN 0 ELSE n END AS finding_count, claim_count, chunk_count, document_length_chars,
           chunk_count > 1 AS was_chunked, failed AS analysis_failed FROM r"""


@query("document_reports", f"WITH {_PARSED}, {_FOLDED}, {_REPORTS}")
def document_reports(spark, sf_dir):
    parsed = checkpointed(_parsed(spark, sf_dir))
    found = dedupe_findings(finding_rows(parsed).drop("chunk_idx"))
    return report(table(spark, sf_dir, "documents").select("doc_id", "text"), parsed, found)


# --- the whole analysis with a generator that reads its prompt: its answer follows the length of the chunk in it ---
def _reader(prompts):
    from corpusflow.functions.prompts import WORDING
    out = []
    for prompt in prompts:
        if WORDING.text_from not in prompt:  # the pass between chunks finds nothing new
            out.append('{"summary":"","contradictions":[],"key_claims":[]}')
            continue
        chunk = prompt.rsplit(WORDING.text_from, 1)[1].rsplit(WORDING.text_to, 1)[0]
        found = {"summary": chunk[:120], "contradictions": [{"statement_a": chunk[:40], "statement_b": chunk[-40:], "explanation": "differs"}],
                 "key_claims": [chunk[:60]]}
        if len(chunk) % 3 == 1:
            found = {"summary": _INVENTED, "contradictions": [], "key_claims": []}
        out.append("no answer" if len(chunk) % 3 == 0 else json.dumps(found))
    return out


_READ = f"""
    lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^{WS}]')) AS l FROM documents),
    chunks AS (SELECT doc_id, len(l) AS chunk_count, unnest(l) AS chunk, generate_subscripts(l, 1) - 1 AS chunk_idx FROM lines),
    outputs AS (SELECT *, CASE length(chunk) % 3 WHEN 0 THEN 'no answer'
        WHEN 1 THEN json_object('summary', {q(_INVENTED)}, 'contradictions', [], 'key_claims', [])::VARCHAR
        ELSE json_object('summary', left(chunk, 120), 'contradictions', [json_object('statement_a', left(chunk, 40), 'statement_b', right(chunk, 40),
             'explanation', 'differs')], 'key_claims', [left(chunk, 60)])::VARCHAR END AS raw FROM chunks)"""


@query("analysis_reports", f"WITH {_READ}, {_AFTER}, {_FOLDED}, {_REPORTS}")
def analysis_reports(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return analyze(docs, generate_fn=_reader, chunks=_chunks(spark, sf_dir), n_ctx=1 << 20).reports


# --- prompts between the chunks: every sentence is a claim, in a context of 1,024 tokens ---
_NO_KNOWN = f"{q(WORDING.known_title)} || {q(WORDING.none_known)}"


@query("analysis_prompts", rf"""
    WITH lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^{WS}]')) AS l FROM documents),
    s AS (SELECT doc_id, flatten(list_transform(l, lambda p: {sentences('p')})) AS ss FROM lines),
    claims AS (SELECT doc_id, unnest(ss) AS claim, generate_subscripts(ss, 1) - 1 AS ord FROM s),
    sized AS (SELECT *, {estimate('claim')} + 1 AS tokens, sum({estimate('claim')} + 1) OVER (PARTITION BY doc_id) AS total FROM claims),
    rest AS MATERIALIZED (SELECT * FROM sized WHERE total > 512 AND tokens <= 256),
    named AS (SELECT doc_id, ord, unnest(list_distinct(regexp_extract_all({match_norm('claim')}, '\p{{L}}[\p{{L}}'']+'))) AS word FROM rest),
    common AS (SELECT doc_id, word, count(*) AS df FROM named GROUP BY ALL HAVING count(*) > 1),
    topics AS (SELECT doc_id, ord, word AS topic FROM named JOIN common USING (doc_id, word)
               QUALIFY row_number() OVER (PARTITION BY doc_id, ord ORDER BY df, word) <= 2),
    placed AS (SELECT doc_id, ord, claim, topic, coalesce(sum(tokens) OVER (PARTITION BY doc_id, topic ORDER BY ord
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 256 AS pack FROM rest JOIN topics USING (doc_id, ord)
               UNION ALL SELECT doc_id, ord, claim, '', 0 FROM sized WHERE total <= 512),
    lined AS (SELECT *, row_number() OVER (PARTITION BY doc_id, topic, pack ORDER BY ord) AS i FROM placed),
    packs AS (SELECT DISTINCT doc_id, string_agg(ord::VARCHAR, ',' ORDER BY ord) AS ords, string_agg(i || '. ' || claim, chr(10) ORDER BY ord) AS block, false AS refused
              FROM lined GROUP BY doc_id, topic, pack HAVING count(*) > 1),
    every AS (SELECT * FROM packs UNION ALL SELECT doc_id, ord::VARCHAR, '1. ' || claim, true FROM sized WHERE total > 512 AND tokens > 256),
    told AS (SELECT *, {q(reconcile_system('corpusflow'))} AS system, {q(WORDING.claims_title)} || block || {_NO_KNOWN} AS u FROM every),
    counted AS (SELECT *, {estimate("system || ' ' || u")} AS token_estimate FROM told)
    SELECT doc_id, ords, md5({chat_prompt_sql('system', 'u')}) AS prompt, token_estimate, refused OR token_estimate > 1024 AS over_budget FROM counted""")
def analysis_prompts(spark, sf_dir):
    lines = F.filter(F.split("text", "\n", -1), lambda p: p.rlike(r"(?U)\S"))
    claims = explode_rows(table(spark, sf_dir, "documents"), F.flatten(F.transform(lines, tx.sentences)), "ord", "claim", "doc_id")
    none = spark.createDataFrame([], "doc_id long, ord long, statement_a string, statement_b string, explanation string")
    return prompts_between(claims.withColumn("ord", F.col("ord").cast("long")), none, n_ctx=1024, sizes=_sizes(spark, sf_dir)).select(
        "doc_id", F.array_join(F.transform("ords", lambda o: o.cast("string")), ",").alias("ords"), F.md5("prompt").alias("prompt"),
        "token_estimate", "over_budget")


# Claims: every whole sentence, which states its own length after its last word. So sentences of one document that
# share enough of their words disagree; numbers that stand in the texts take part as they are.
_SENTENCES = f"""
    lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^{WS}]')) AS l FROM documents),
    s AS (SELECT doc_id, flatten(list_transform(l, lambda p: {sentences('p')})) AS ss FROM lines),
    claims AS (SELECT doc_id, ord, s || ' ' || length(s) || ' belgi' AS claim
               FROM (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS ord FROM s))"""
_NUMBER = r"([0-9]{1,3}(?: [0-9]{3})+\b|[0-9](?:[0-9.,:]*[0-9])?)(?:[ -]?(\p{L}[\p{L}'']*))?"
_CONFLICTS = rf"""
    {_SENTENCES},
    plain AS (SELECT *, regexp_replace({match_norm('claim')}, '^[0-9]+[.)] ', '') AS t FROM claims),
    read AS (SELECT doc_id, ord, claim, list_sort(list_distinct(regexp_extract_all(t, '\p{{L}}[\p{{L}}'']+'))) AS words,
                    regexp_extract_all(t, '{_NUMBER}', 1) AS vs, regexp_extract_all(t, '{_NUMBER}', 2) AS us FROM plain),
    listed AS MATERIALIZED (SELECT doc_id, ord, claim, words, list_sort(list_transform(range(1, len(vs) + 1), lambda i:
                    struct_pack(unit := us[i], pos := i, value := replace(vs[i], ' ', '')))) AS nums FROM read WHERE len(vs) > 0 AND len(words) > 0),
    keyed AS (SELECT *, list_transform(nums, lambda n: n.unit) AS us, list_transform(nums, lambda n: n.value) AS vs FROM listed),
    said AS MATERIALIZED (SELECT doc_id, words, us, vs, min(ord) AS ord, min_by(claim, ord) AS claim FROM keyed GROUP BY doc_id, words, us, vs),
    first AS MATERIALIZED (SELECT doc_id, words, us, min(ord) AS ord, min_by(claim, ord) AS claim, min_by(vs, ord) AS vs FROM said GROUP BY doc_id, words, us),
    each_word AS (SELECT doc_id, ord, unnest(words) AS word FROM first),
    weights AS MATERIALIZED (SELECT doc_id, word, length(bin((n + 16) // df)) AS weight
        FROM (SELECT doc_id, word, count(*) AS df FROM each_word GROUP BY ALL) JOIN (SELECT doc_id, count(*) AS n FROM first GROUP BY ALL) USING (doc_id)),
    heavy AS MATERIALIZED (SELECT doc_id, ord, sum(weight) AS total FROM each_word JOIN weights USING (doc_id, word) GROUP BY ALL),
    shared AS (SELECT a.doc_id, a.ord AS o1, b.ord AS o2, sum(weight) AS w FROM each_word a
               JOIN each_word b ON a.doc_id = b.doc_id AND a.word = b.word AND a.ord < b.ord
               JOIN weights x ON x.doc_id = a.doc_id AND x.word = a.word GROUP BY ALL),
    alike AS (SELECT s.doc_id, o1, o2 FROM shared s JOIN heavy p ON p.doc_id = s.doc_id AND p.ord = o1
              JOIN heavy r ON r.doc_id = s.doc_id AND r.ord = o2 WHERE 100 * w >= 35 * least(p.total, r.total)),
    numbers AS (SELECT doc_id, ord, unit, value, row_number() OVER (PARTITION BY doc_id, ord, unit ORDER BY j) AS k
                FROM (SELECT doc_id, ord, unnest(us) AS unit, unnest(vs) AS value, generate_subscripts(us, 1) AS j FROM first)),
    between_ AS (SELECT doc_id, o1, o2, arg_min(v, (unit, k)) AS explanation FROM (
                     SELECT l.doc_id, o1, o2, a.unit, a.k, trim(a.value || ' / ' || b.value || ' ' || a.unit) AS v FROM alike l
                     JOIN numbers a ON a.doc_id = l.doc_id AND a.ord = o1
                     JOIN numbers b ON b.doc_id = l.doc_id AND b.ord = o2 AND b.unit = a.unit AND b.k = a.k WHERE a.value <> b.value)
                 GROUP BY doc_id, o1, o2),
    within_ AS (SELECT s.doc_id, f.ord AS o1, s.ord AS o2, f.vs AS v1, s.vs AS v2, s.us,
                       list_filter(range(1, len(s.vs) + 1), lambda i: f.vs[i] <> s.vs[i])[1] AS i
                FROM said s JOIN first f ON f.doc_id = s.doc_id AND f.words = s.words AND f.us = s.us AND f.ord <> s.ord),
    found AS (SELECT * FROM between_ UNION ALL SELECT doc_id, o1, o2, trim(v1[i] || ' / ' || v2[i] || ' ' || us[i]) FROM within_)"""


@query("conflict_candidates", f"""
    WITH {_CONFLICTS}
    SELECT f.doc_id, o1 AS ord_a, o2 AS ord_b, a.claim AS statement_a, b.claim AS statement_b, explanation
    FROM found f JOIN claims a ON a.doc_id = f.doc_id AND a.ord = o1 JOIN claims b ON b.doc_id = f.doc_id AND b.ord = o2""")
def conflicts(spark, sf_dir):
    lines = F.filter(F.split("text", "\n", -1), lambda p: p.rlike(r"(?U)\S"))
    sents = explode_rows(table(spark, sf_dir, "documents"), F.flatten(F.transform(lines, tx.sentences)), "ord", "s", "doc_id")
    claim = F.concat("s", F.lit(" "), F.length("s").cast("string"), F.lit(" belgi"))
    return conflict_candidates(sents.select("doc_id", "ord", claim.alias("claim")), sizes=_sizes(spark, sf_dir))
