"""Change tracking: what is stored (labelled documents) against what is delivered now.

The stored state are the documents with a label row; where the quality is 0 the stored text
was another one, where toxic is 1 its file is gone.  The Spanish feed was not delivered.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusflow.catalog.base import query, table
from corpusflow.operators.snapshots import (
    archive_rows, attach_targets, change_log, diff_snapshots, fingerprint, missing_ids, run_counts, select_ids,
    upsert_manifest)
from corpusflow.operators.markup import WEB_PAGE
from corpusflow.settings import shared_folder
from corpusflow.streaming.ingest import IngestTables, apply_batch, current_chunks

_AS_OF = "2026-01-02 03:04:05"


def _incoming(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("lang") != "es")
    return fingerprint(docs, "doc_id", "text")


def _stored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    old = F.when(F.col("quality") == 0, F.concat(F.lit("Old. "), "text")).otherwise(F.col("text"))
    return docs.select(F.col("doc_id").alias("id"), old.alias("content"), F.sha2(old, 256).alias("content_hash"),
                       (F.col("toxic") == 0).alias("raw_present"))


_DIFF = """
    incoming AS (SELECT doc_id AS id, sha256(text) AS new_hash FROM documents WHERE lang <> 'es'),
    stored AS (SELECT doc_id AS id, CASE WHEN quality = 0 THEN 'Old. ' || text ELSE text END AS content, toxic = 0 AS raw_present
               FROM documents JOIN labels USING (doc_id)),
    diff AS (SELECT id, CASE WHEN new_hash IS NULL THEN 'removed' WHEN content IS NULL THEN 'initial'
                             WHEN NOT raw_present THEN 'restored' WHEN sha256(content) <> new_hash THEN 'changed'
                             ELSE 'unchanged' END AS status,
                    sha256(content) AS old_hash, new_hash
             FROM incoming FULL JOIN stored USING (id))"""


def _diff(spark, sf_dir, force=False):
    return diff_snapshots(_incoming(spark, sf_dir), _stored(spark, sf_dir), force)


@query("snapshot_diff", f"WITH {_DIFF} SELECT * FROM diff")
def snapshot_diff(spark, sf_dir):
    return _diff(spark, sf_dir)


@query("snapshot_diff_forced", f"""
    WITH {_DIFF} SELECT id, CASE WHEN status = 'unchanged' THEN 'rewritten' ELSE status END AS status, old_hash, new_hash FROM diff""")
def snapshot_diff_forced(spark, sf_dir):
    return _diff(spark, sf_dir, force=True)


_NAMES = ("initial", "changed", "restored", "rewritten", "unchanged", "removed")


@query("run_summary", f"""
    WITH {_DIFF}
    SELECT count(*) FILTER (status IN ('initial', 'changed', 'restored') AND old_hash IS DISTINCT FROM new_hash) AS updated,
           {', '.join(f"count(*) FILTER (status = '{n}') AS {n}" for n in _NAMES)} FROM diff""")
def run_summary(spark, sf_dir):
    return run_counts(_diff(spark, sf_dir))


@query("change_log", f"""
    WITH {_DIFF} SELECT TIMESTAMP '{_AS_OF}' AS as_of, id, status, old_hash, new_hash FROM diff
    WHERE status IN ('initial', 'changed', 'restored')""")
def change_log_rows(spark, sf_dir):
    return change_log(_diff(spark, sf_dir), F.lit(_AS_OF).cast("timestamp_ntz"))


@query("archived_versions", f"""
    WITH {_DIFF} SELECT id, '20260102T030405Z' AS stamp, sha256(content) AS content_hash, content
    FROM stored JOIN diff USING (id) WHERE status = 'changed'""")
def archived_versions(spark, sf_dir):
    rows = archive_rows(_stored(spark, sf_dir), _diff(spark, sf_dir), F.lit(_AS_OF).cast("timestamp_ntz"))
    return rows.select("id", "stamp", "content_hash", "content")


# Every event of a user is a version of that user's state; the newest wins.
@query("manifest_latest", """
    WITH versions AS (SELECT user_id AS id, ts AS fetched_at, event_type AS title, sha256(event_id::VARCHAR) AS content_hash FROM events)
    SELECT id, fetched_at, title, content_hash FROM versions
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC, content_hash DESC) = 1""")
def manifest_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.col("ts").alias("fetched_at"), F.col("event_type").alias("title"),
        F.sha2(F.col("event_id").cast("string"), 256).alias("content_hash"))
    early = F.col("title").isin("view", "click")
    return upsert_manifest(rows.where(early), rows.where(~early))


@query("targets_attached", """
    SELECT doc_id AS id, source, quality, toxic, sha256(text) AS content_hash,
           octet_length(encode(text)) AS bytes FROM documents JOIN labels USING (doc_id)""")
def targets_attached(spark, sf_dir):
    targets = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    return attach_targets(fingerprint(table(spark, sf_dir, "documents"), "doc_id", "text", "source"), targets)


@query("wanted_documents", "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def wanted_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return select_ids(docs, table(spark, sf_dir, "labels"), "doc_id")


@query("unlabelled_documents", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels ORDER BY doc_id")
def unlabelled_documents(spark, sf_dir):
    return missing_ids(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), "doc_id").orderBy("doc_id")


# Two landed batches: first the labelled documents (older texts where the quality is 0), then all documents.
_FIRST, _SECOND = 1_767_225_600, 1_767_312_000


def _page_sql(text):
    return f"'<html><body><h1>' || source || '</h1><p>' || {text} || '</p></body></html>'"


@query("ingest_batches", f"""
    WITH old AS (SELECT doc_id, sha256({_page_sql("CASE WHEN quality = 0 THEN 'Old. ' || text ELSE text END")}) AS old_hash
                 FROM documents JOIN labels USING (doc_id)),
    new AS (SELECT doc_id, sha256({_page_sql('text')}) AS new_hash FROM documents),
    both_days AS (SELECT * FROM new LEFT JOIN old USING (doc_id))
    SELECT 'd' || doc_id AS id, 0 AS batch, 'initial' AS status, NULL AS old_hash, old_hash AS new_hash, {_FIRST}000000 AS at FROM old
    UNION ALL SELECT 'd' || doc_id, 1, CASE WHEN old_hash IS NULL THEN 'initial' ELSE 'changed' END, old_hash, new_hash, {_SECOND}000000
    FROM both_days WHERE old_hash IS DISTINCT FROM new_hash
    UNION ALL SELECT 'd' || doc_id, 1, 'archived', old_hash, NULL, {_FIRST}000000 FROM both_days WHERE old_hash <> new_hash
    UNION ALL SELECT 'd' || doc_id, NULL, 'current', NULL, NULL, NULL FROM documents""")
def ingest_batches(spark, sf_dir):
    tables = IngestTables(f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    key = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id")
    targets = docs.select(key, F.col("source").alias("law_name"), F.col("lang").alias("title"), F.col("lang").alias("language"),
                          F.concat(F.lit("http://x/"), "doc_id").alias("url"))

    def landed(rows, text, at):
        page = F.concat(F.lit("<html><body><h1>"), "source", F.lit("</h1><p>"), text, F.lit("</p></body></html>"))
        return rows.select(key, page.alias("content"), F.timestamp_seconds(F.lit(at)).alias("fetched_at"))

    old = F.when(F.col("quality") == 0, F.concat(F.lit("Old. "), "text")).otherwise(F.col("text"))
    apply_batch(landed(docs.join(table(spark, sf_dir, "labels"), "doc_id"), old, _FIRST), 0, targets, tables, WEB_PAGE)
    apply_batch(landed(docs, F.col("text"), _SECOND), 1, targets, tables, WEB_PAGE)
    log = spark.read.parquet(tables.change_log).select(
        "id", "batch", "status", "old_hash", "new_hash", F.unix_micros("as_of").alias("at"))
    gone = spark.read.parquet(tables.archive).select(
        "id", "batch", F.lit("archived").alias("status"), F.col("content_hash").alias("old_hash"), F.unix_micros("fetched_at").alias("at"))
    now = current_chunks(spark, tables).select(F.col("source_id").alias("id"), F.lit("current").alias("status")).distinct()
    return log.unionByName(gone, allowMissingColumns=True).unionByName(now, allowMissingColumns=True)
