"""Chat log, routing and event streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusflow.catalog.base import any_of, intent_norm, q, query, table
from corpusflow.functions.rows import explode_rows
from corpusflow.functions.model_json import decode_references, encode_references
from corpusflow.operators.chatlog import (
    append_messages, assign_sessions, exchange_messages, histories, history, latest_sources, list_sessions, messages_of,
    role_counts, session_messages, session_rollup, store_log)
from corpusflow.operators.intent import ABOUT, LEGAL, OFF_TOPIC, OUT_OF_SCOPE, SOFT_ABOUT, Assistant, route, static_answers
from corpusflow.settings import shared_folder
from corpusflow.streaming.sessions import session_activity
from corpusflow.streaming.tokens import fold_tokens

# Every turn gets one of these openings, so that all routes occur.
CUES = (
    "Dastur haqida", "Sen kimsan?", "Kim yaratdi?", "Bugun OB‑HAVO va ob-havo qanday?", "2+2 necha?",
    "Mehnat kodeksi bo‘yicha", "Shartnomani kim yaratdi va imzolashi shartmi?", "Xodimning ta’til huquqi",
    "Who are you and the labor code", "Salom", "she’r yoz", "oʻzing haqida")
_CUED = "([" + ", ".join(q(c) for c in CUES) + f"][((conv_id * 7 + turn) % {len(CUES)})::INT + 1] || ' ' || text)"


def _messages(spark, sf_dir):
    cues = F.array(*[F.lit(c) for c in CUES])
    cue = F.get(cues, ((F.col("conv_id") * 7 + F.col("turn")) % len(CUES)).cast("int"))
    return table(spark, sf_dir, "conversations").withColumn("content", F.concat(cue, F.lit(" "), F.col("text")))


_BOT = Assistant()
_ROUTED = f"""
    n AS (SELECT conv_id, turn, {intent_norm(_CUED)} AS n FROM conversations),
    routed AS (SELECT conv_id, turn, CASE WHEN {any_of('n', _BOT.about_cues())} THEN '{ABOUT}' WHEN {any_of('n', LEGAL)} THEN NULL
                      WHEN {any_of('n', SOFT_ABOUT)} THEN '{ABOUT}' WHEN {any_of('n', OFF_TOPIC)} THEN '{OUT_OF_SCOPE}' END AS intent FROM n)"""


@query("intent_routes", f"WITH {_ROUTED} SELECT conv_id, turn, intent FROM routed")
def intent_routes(spark, sf_dir):
    return route(_messages(spark, sf_dir), "content").select("conv_id", "turn", "intent")


@query("static_replies", f"""
    WITH {_ROUTED}
    SELECT conv_id, turn, CASE intent WHEN '{ABOUT}' THEN {q(_BOT.replies()[ABOUT])} ELSE {q(_BOT.replies()[OUT_OF_SCOPE])} END AS answer,
           'static' AS stop_reason FROM routed WHERE intent IS NOT NULL
    UNION ALL SELECT conv_id, turn, NULL, NULL FROM routed WHERE intent IS NULL""")
def static_replies(spark, sf_dir):
    routed = route(_messages(spark, sf_dir), "content")
    fixed = static_answers(routed).select("conv_id", "turn", "answer", "stop_reason")
    open_ = routed.where(F.col("intent").isNull()).select("conv_id", "turn")
    return fixed.unionByName(open_, allowMissingColumns=True)


def _log(spark, sf_dir):
    """Turns as a message log: one minute per turn; every second assistant turn carries references."""
    refs = F.array(F.struct(F.col("conv_id").cast("string").alias("id"), F.col("role").alias("code"),
                            F.col("turn").cast("string").alias("article"), F.lit("t").alias("title"),
                            F.left("text", F.lit(20)).alias("excerpt"), F.lit(None).cast("double").alias("score")))
    cited = (F.col("role") == "assistant") & (F.col("turn") % 4 < 2)
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").alias("session_id"), "role",
        F.col("text").alias("content"),
        (F.lit("2023-11-14 22:13:20").cast("timestamp_ntz") + F.make_dt_interval(
            secs=(F.col("conv_id") * 3600 + F.col("turn") * 60).cast("decimal(18,6)"))).alias("created_at"),
        F.when(cited, encode_references(refs)).when(F.col("role") == "system", "not json").otherwise("[]")
        .alias("references_json"), "turn")


_AT = "(TIMESTAMP '2023-11-14 22:13:20' + (conv_id * 3600 + turn * 60) * INTERVAL 1 SECOND)"
_SESSIONS = f"""
    sessions AS (SELECT conv_id AS session_id,
        CASE WHEN trim(coalesce(left(min_by(text, turn) FILTER (role = 'user'), 80), '')) = '' THEN 'New chat'
             ELSE left(min_by(text, turn) FILTER (role = 'user'), 80) END AS title,
        min({_AT}) AS created_at, max({_AT}) AS updated_at, count(*) AS messages FROM conversations GROUP BY conv_id)"""


@query("sessions", f"WITH {_SESSIONS} SELECT * FROM sessions ORDER BY updated_at DESC, session_id")
def sessions(spark, sf_dir):
    return list_sessions(session_rollup(_log(spark, sf_dir)))


@query("history", f"""
    SELECT conv_id || '-' || turn AS id, conv_id AS session_id, role, text AS content, {_AT} AS created_at,
           CASE WHEN role = 'assistant' AND turn % 4 < 2 THEN 1 ELSE 0 END AS references,
           CASE WHEN role = 'assistant' AND turn % 4 < 2 THEN left(text, 20) END AS first_excerpt FROM conversations""")
def history_rows(spark, sf_dir):
    rows = session_messages(_log(spark, sf_dir).drop("turn"))
    return rows.withColumn("first_excerpt", F.get("references", F.lit(0))["excerpt"]).withColumn("references", F.size("references"))


@query("session_transcripts", f"""
    WITH {_SESSIONS}
    SELECT session_id, title, conv_id || '-' || turn AS id, role, text AS content, {_AT} AS created_at
    FROM conversations JOIN sessions ON session_id = conv_id""")
def session_transcripts(spark, sf_dir):
    log = _log(spark, sf_dir)
    return messages_of(session_rollup(log), log).select("session_id", "title", "id", "role", "content", "created_at")


# The log stored by session: both tables join and are ordered as they lie; every reference field is compared.
_REFERENCE = "'[' || conv_id || '|' || role || '|' || turn || '|t|' || left(text, 20) || '|]'"


@query("stored_histories", f"""
    WITH {_SESSIONS}
    SELECT session_id, title, (row_number() OVER (PARTITION BY conv_id ORDER BY {_AT}, conv_id || '-' || turn) - 1)::INT AS seq,
           conv_id || '-' || turn AS id, role, text AS content, {_AT} AS created_at,
           CASE WHEN role = 'assistant' AND turn % 4 < 2 THEN {_REFERENCE} ELSE '' END AS "references"
    FROM conversations JOIN sessions ON session_id = conv_id""")
def stored_histories(spark, sf_dir):
    log, mark = _log(spark, sf_dir).drop("turn"), uuid.uuid4().hex
    kept = store_log(log, f"log_{mark}", f"{shared_folder(spark)}/log-{mark}", buckets=8)
    listed = store_log(session_rollup(log), f"sessions_{mark}", f"{shared_folder(spark)}/sessions-{mark}", buckets=8)
    shown = F.transform("references", lambda r: F.concat(F.lit("["), F.concat_ws(
        "|", r["id"], r["code"], r["article"], r["title"], r["excerpt"], F.coalesce(r["score"].cast("string"), F.lit(""))), F.lit("]")))
    rows = messages_of(listed, histories(kept))
    return rows.select("session_id", "title", "seq", "id", "role", "content", "created_at", F.array_join(shown, "").alias("references"))


@query("longest_history", f"""
    WITH n AS (SELECT conv_id FROM conversations GROUP BY conv_id ORDER BY count(*) DESC, conv_id LIMIT 1)
    SELECT conv_id || '-' || turn AS id, conv_id AS session_id, role, text AS content, {_AT} AS created_at,
           CASE WHEN role = 'assistant' AND turn % 4 < 2 THEN 1 ELSE 0 END AS "references"
    FROM conversations JOIN n USING (conv_id) ORDER BY created_at, id""")
def longest_history(spark, sf_dir):
    log = _log(spark, sf_dir).drop("turn")
    first = log.groupBy("session_id").count().orderBy(F.desc("count"), "session_id").first()
    rows = history(log, first["session_id"] if first else None)
    return rows.withColumn("references", F.size("references"))


# Every turn is asked again a day later; each fifth one stays without an answer.
_DAY = f"({_AT} + INTERVAL 1 DAY)"


@query("appended_messages", f"""
    WITH said AS (SELECT conv_id, turn, role, text AS content, {_AT} AS created_at, conv_id || '-' || turn AS id FROM conversations
                  UNION ALL SELECT conv_id, turn, 'user', text, {_DAY}, 'm-' || left(sha256('user|' || conv_id || '-' || turn), 32)
                  FROM conversations
                  UNION ALL SELECT conv_id, turn, 'assistant', 'Javob: ' || text, {_DAY} + INTERVAL 1 MICROSECOND,
                                   'm-' || left(sha256('assistant|' || conv_id || '-' || turn), 32)
                  FROM conversations WHERE turn % 5 <> 4)
    SELECT id, conv_id AS session_id, role, content, created_at, count(*) OVER w AS messages, max(created_at) OVER w AS updated_at
    FROM said WINDOW w AS (PARTITION BY conv_id)""")
def appended_messages(spark, sf_dir):
    log = _log(spark, sf_dir)
    answer = F.when(F.col("turn") % 5 != 4, F.concat(F.lit("Javob: "), "content"))
    answered = log.select(F.col("id").alias("message_id"), "session_id", F.col("content").alias("question"), answer.alias("answer"),
                          decode_references(F.col("references_json")).alias("references"),
                          (F.col("created_at") + F.expr("interval 1 day")).alias("created_at"))
    new = exchange_messages(answered)
    log = append_messages(append_messages(log.drop("turn"), new), new)
    state = session_rollup(log).select("session_id", "messages", "updated_at")
    return log.join(state, "session_id").drop("references_json")


@query("role_counts", """
    SELECT conv_id AS session_id, count(*) FILTER (role = 'system') AS system_messages, count(*) FILTER (role = 'user') AS user_messages,
           count(*) FILTER (role = 'assistant') AS assistant_messages FROM conversations GROUP BY conv_id""")
def role_count_rows(spark, sf_dir):
    return role_counts(_log(spark, sf_dir))


@query("latest_sources", """
    SELECT conv_id AS session_id, conv_id || '-' || max(turn) AS id, 1 AS references,
           max_by(left(text, 20), turn) AS excerpt FROM conversations
    WHERE role = 'assistant' AND turn % 4 < 2 GROUP BY conv_id""")
def latest_source_rows(spark, sf_dir):
    log = _log(spark, sf_dir)
    rows = latest_sources(log.withColumn("references", decode_references(F.col("references_json"))))
    return rows.withColumn("excerpt", F.get("references", F.lit(0))["excerpt"]).withColumn("references", F.size("references"))


# Turns whose conversation opened with a system text arrive with a session id nobody knows.
@query("session_assignment", f"""
    WITH known AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user' AND turn = 0),
    m AS (SELECT c.*, c.conv_id || '-' || c.turn AS message_id, k.conv_id IS NULL AS is_new
          FROM conversations c LEFT JOIN known k USING (conv_id))
    SELECT message_id, is_new, CASE WHEN is_new THEN 's-' || left(sha256(message_id), 32) ELSE conv_id::VARCHAR END AS session_id,
           CASE WHEN is_new THEN left(text, 80) END AS new_title FROM m""")
def session_assignment(spark, sf_dir):
    log = _log(spark, sf_dir)
    known = log.where((F.col("role") == "user") & (F.col("turn") == 0)).select("session_id").distinct()
    got = assign_sessions(log.withColumnRenamed("id", "message_id"), known)
    return got.select("message_id", "is_new", "session_id", "new_title")


@query("session_activity", """
    SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS events FROM events GROUP BY user_id""")
def session_activity_rows(spark, sf_dir):
    return session_activity(table(spark, sf_dir, "events"), "user_id", "ts")


@query("session_windows", """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS opens
               FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS events FROM s GROUP BY user_id, n""")
def session_windows(spark, sf_dir):
    return session_activity(table(spark, sf_dir, "events"), "user_id", "ts", gap_seconds=1800)


# Each turn is streamed word by word and closed by an end event.
@query("token_fold", """
    SELECT conv_id || '-' || turn AS session_id, text AS content, 'eog' AS stop_reason, true AS closed,
           len(string_split(text, ' ')) AS tokens FROM conversations""")
def token_fold(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("session_id"), "text")
    split = F.split("text", " ", -1)
    pieces = F.transform(split, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.lit(" "), w)))
    tokens = explode_rows(turns, pieces, "seq", "token", "session_id").withColumn("stop_reason", F.lit(None).cast("string"))
    ends = turns.select("session_id", F.lit(1 << 30).alias("seq"), F.lit(None).cast("string").alias("token"), F.lit("eog").alias("stop_reason"))
    return fold_tokens(tokens.unionByName(ends))
