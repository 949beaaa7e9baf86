"""Chat log as tables: sessions, history, message append (CHAT-1..4, AGG-8, AGG-12, SNK-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.functions.model_json import decode_references, encode_references

NEW_CHAT = "New chat"


TITLE_CHARS = 80


def session_title(first_text: Column) -> Column:
    """First 80 characters of the opening message, or a fixed title when it is blank."""
    cut = tx.excerpt(first_text, TITLE_CHARS)
    return F.when(tx.is_blank(cut), F.lit(NEW_CHAT)).otherwise(cut)


def session_rollup(messages: DataFrame) -> DataFrame:
    """AGG-8: (session_id, title, created_at, updated_at, messages) from the message log.

    A session with very many messages is combined before the shuffle; texts are cut to the
    title's length before they reach the aggregate.
    """
    heads = messages.select("session_id", "created_at",
                            F.when(F.col("role") == "user", tx.excerpt("content", TITLE_CHARS)).alias("head"))
    first = F.min_by("head", F.when(F.col("head").isNotNull(), F.struct("created_at", "head")))
    return heads.groupBy("session_id").agg(
        session_title(first).alias("title"), F.min("created_at").alias("created_at"),
        F.max("created_at").alias("updated_at"), F.count(F.lit(1)).alias("messages"))


def list_sessions(sessions: DataFrame) -> DataFrame:
    """CHAT-2, SORT-2."""
    return sessions.orderBy(F.desc("updated_at"), "session_id")


def assign_sessions(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """CHAT-1: messages(message_id, session_id, content, …) gain the session they belong to.

    A known session id is kept; an unknown or missing one gives a new session.  New ids
    derive from the message id, so a retried task produces the same id.
    """
    known = sessions.select(F.col("session_id"), F.lit(True).alias("_known"))
    joined = messages.join(known, "session_id", "left")
    fresh = F.concat(F.lit("s-"), F.left(F.sha2(F.col("message_id").cast("string"), 256), F.lit(32)))
    is_new = F.col("_known").isNull()
    return (joined.withColumn("is_new", is_new)
            .withColumn("new_title", F.when(is_new, session_title(F.col("content"))))
            .withColumn("session_id", F.when(is_new, fresh).otherwise(F.col("session_id").cast("string")))
            .drop("_known"))


def new_sessions(assigned: DataFrame, as_of: Column) -> DataFrame:
    return (assigned.where("is_new")
            .select(F.col("session_id").alias("id"), F.col("new_title").alias("title"),
                    as_of.alias("created_at"), as_of.alias("updated_at")))


def history(messages: DataFrame, session_id) -> DataFrame:
    """CHAT-3, SORT-3, JSON-3: one session in time order with decoded references."""
    return session_messages(messages.where(F.col("session_id") == session_id)).orderBy("created_at", "id")


def session_messages(messages: DataFrame) -> DataFrame:
    return (ensure_column(messages, "references_json", "[]")
            .withColumn("references", decode_references(F.col("references_json"))).drop("references_json"))


LOG_BUCKETS = 64


def store_log(rows: DataFrame, name: str, path: str, key: str = "session_id", order: tuple[str, ...] = ("created_at", "id"),
              buckets: int = LOG_BUCKETS) -> DataFrame:
    """JOIN-5, SORT-3: a log or its sessions as a table in buckets by session, each in one file sorted by session and time.

    Tables of as many buckets join, and order a session's messages, without an exchange. A bucket is read by one task,
    also if one session fills it; for such a log join the plain tables.
    """
    if buckets < 1:
        raise ValueError("a log needs a bucket")
    columns = [key, *[c for c in order if c in rows.columns and c != key]]
    (rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(*columns).option("path", path)
     .mode("errorifexists").saveAsTable(name))
    return rows.sparkSession.table(name)


def histories(messages: DataFrame) -> DataFrame:
    """CHAT-3, SORT-3 for all sessions: ``history`` of each, its messages numbered from 0 in time order."""
    place = Window.partitionBy("session_id").orderBy("created_at", "id")
    return session_messages(messages).withColumn("seq", F.row_number().over(place) - 1)


def messages_of(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """JOIN-5: messages with the title of their session; both sides may be bucketed by session_id."""
    return messages.join(sessions.select("session_id", "title"), "session_id")


def exchange_messages(answered: DataFrame) -> DataFrame:
    """SNK-8: the log rows of answered(message_id, session_id, question, answer, references, created_at).

    The question is one row, the answer another a microsecond later, with its references encoded; a message
    without an answer has its first row only.  Ids derive from the message id, so a retried task makes the same.
    """
    def row(role: str, content: str, later: int, refs: Column) -> Column:
        key = F.concat_ws("|", F.lit(role), F.col("message_id").cast("string"))
        return F.struct(F.concat(F.lit("m-"), F.left(F.sha2(key, 256), F.lit(32))).alias("id"), F.lit(role).alias("role"),
                        F.col(content).alias("content"), (F.col("created_at") + F.make_dt_interval(
                            secs=F.lit(later / 1e6).cast("decimal(18,6)"))).alias("created_at"), refs.alias("references_json"))

    rows = F.array(row("user", "question", 0, F.lit("[]")), row("assistant", "answer", 1, encode_references(F.col("references"))))
    said = F.filter(rows, lambda m: (m["role"] == "user") | m["content"].isNotNull())
    return answered.select("session_id", F.explode_outer(said).alias("m")).select(
        "m.id", "session_id", "m.role", "m.content", "m.created_at", "m.references_json")


def append_messages(log: DataFrame, new: DataFrame) -> DataFrame:
    """SNK-8: the log with new rows behind it; session times follow from it (session_rollup).

    A row whose id is in the log already, from a repeated append, is not added again.
    """
    fresh = new.join(log.select("id"), "id", "left_anti")
    return log.unionByName(fresh.select(*log.columns))


def ensure_column(df: DataFrame, name: str, default) -> DataFrame:
    """CHAT-4: a column that older files lack gets its default."""
    return df if name in df.columns else df.withColumn(name, F.lit(default))


def role_counts(messages: DataFrame) -> DataFrame:
    """AGG-12: messages per role in each session."""
    return messages.groupBy("session_id").agg(*[
        F.count_if(F.col("role") == r).alias(f"{r}_messages") for r in ("system", "user", "assistant")])


def latest_sources(messages: DataFrame) -> DataFrame:
    """AGG-12: per session the references of the newest assistant message that has any."""
    shown = (F.col("role") == "assistant") & (F.size("references") > 0)
    return (messages.where(shown).groupBy("session_id")
            .agg(F.max_by(F.struct("id", "references"), F.struct("created_at", "id")).alias("m"))
            .select("session_id", "m.id", "m.references"))
