"""STRM-2: incremental snapshot ingest; only new or changed documents are parsed again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from corpusflow.operators.markup import LAW_PAGE, MarkupRules
from corpusflow.operators.snapshots import (
    archive_rows, change_log, diff_snapshots, fingerprint, latest, to_write)
from corpusflow.plans.corpus_build import build_corpus
from corpusflow.schemas import MANIFEST, SNAPSHOTS


ID_BUCKETS = 256   # folders of stored pages within a batch, by a hash of the id


@dataclass(frozen=True)
class IngestTables:
    """Folders of the tables that the ingest keeps, below one root."""

    root: str

    def __getattr__(self, name: str) -> str:
        if name.startswith("_"):
            raise AttributeError(name)
        return f"{self.root}/{name}"


def _read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField("batch", T.LongType())])


def _bucket() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(ID_BUCKETS)).cast("int")


_STATE = T.StructType([*MANIFEST.fields, T.StructField("batch", T.LongType())])
_POINTER = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("written", T.LongType()), T.StructField("batch", T.LongType())])


def _pointers(spark: SparkSession, tables: IngestTables, before: int | None = None) -> dict[int, int]:
    """Bucket -> the batch whose folder holds its current state: the newest pointer set, a row a bucket."""
    rows = _read_or_empty(spark, tables.current_versions, _POINTER)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    newest = rows.agg(F.max("batch").alias("b")).first()["b"]  # of partition values
    return {r["bucket"]: r["written"] for r in rows.where(F.col("batch") == newest).collect()} if newest is not None else {}


def _state(spark: SparkSession, tables: IngestTables, pointers: dict[int, int]) -> DataFrame:
    """The state rows in the folders that the pointers name; batch is the one that wrote a document's newest version."""
    folders = [f"{tables.current}/written={w}/bucket={b}" for b, w in sorted(pointers.items())]
    if not folders:
        return spark.createDataFrame([], _STATE)
    return spark.read.schema(_STATE).option("basePath", tables.current).parquet(*folders).drop("written", "bucket")


def current_manifest(spark: SparkSession, tables: IngestTables) -> DataFrame:
    """SNK-5: the latest state of every id."""
    return _state(spark, tables, _pointers(spark, tables)).drop("batch")


def current_chunks(spark: SparkSession, tables: IngestTables) -> DataFrame:
    """Chunks of the newest version of each document; a version without any article leaves no older chunks behind."""
    newest = _state(spark, tables, _pointers(spark, tables)).select(F.col("id").alias("source_id"), "batch")
    return spark.read.parquet(tables.chunks).join(newest, ["source_id", "batch"], "left_semi").drop("batch")


def apply_batch(batch: DataFrame, batch_id: int, targets: DataFrame, tables: IngestTables,
                rules: MarkupRules = LAW_PAGE, as_of: Column | None = None) -> None:
    """One micro-batch: diff against the manifest, then write chunks, log, archive and state.

    ``as_of`` stamps log and archive; without it the newest ``fetched_at`` of the batch does, so
    that a repeated batch has the same stamps.

    The state lies in buckets of ids. A batch reads the buckets its ids fall into and writes them anew in a folder of
    its own; pointers to all buckets' folders go last, so what a batch reads follows the batch and not the history.
    Every table is partitioned by batch id, a batch overwrites its own partition and looks at earlier pointers only, so
    one that runs again after a failure between any two writes leaves the same tables.
    """
    spark = batch.sparkSession
    # The source is read once; the writes below share what it gave.
    stamped = fingerprint(latest(batch, "id", "fetched_at", "content"), "id", "content", "content", "fetched_at").persist()
    try:
        _apply(spark, stamped, batch_id, targets, tables, rules, as_of)
    finally:
        stamped.unpersist()


def _apply(spark: SparkSession, stamped: DataFrame, batch_id: int, targets: DataFrame, tables: IngestTables,
           rules: MarkupRules, as_of: Column | None) -> None:
    if as_of is None:
        newest = stamped.agg(F.unix_micros(F.max("fetched_at")).alias("at")).first()["at"]
        as_of = F.timestamp_micros(F.lit(newest).cast("long"))
    pointers = _pointers(spark, tables, batch_id)
    touched = {r["bucket"] for r in stamped.select(_bucket().alias("bucket")).distinct().collect()}  # ID_BUCKETS at most
    state = _state(spark, tables, {b: w for b, w in pointers.items() if b in touched}).persist()
    manifest = state.drop("batch")
    # A stream delivers only what arrived: ids it does not mention are not removed.
    diff = diff_snapshots(stamped, manifest).where(F.col("status") != "removed")
    todo = stamped.join(to_write(diff).select("id"), "id", "left_semi")

    def put(df: DataFrame, path: str, *folders: str) -> None:
        # A folder's rows go to as few tasks as their size asks for; else every task writes a file in every folder.
        dealt = df.hint("rebalance", *folders) if folders else df
        (dealt.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch", *folders).parquet(path))

    put(build_corpus(todo.select("id", "content"), targets, rules).chunks, tables.chunks)
    put(change_log(diff, as_of), tables.change_log)
    # Only the folders that the changed ids' newest versions lie in are read.
    changed = (diff.where(F.col("status") == "changed").join(state.select("id", "batch"), "id")
               .select(_bucket().alias("bucket"), "batch").distinct().collect())
    kept = T.StructType(_with_batch(SNAPSHOTS).fields + [T.StructField("bucket", T.IntegerType())])
    stored = _read_or_empty(spark, tables.raw, kept).where(
        F.col("batch").isin(sorted({r["batch"] for r in changed})) & F.col("bucket").isin(sorted({r["bucket"] for r in changed})))
    replaced = archive_rows(stored.drop("batch", "bucket"), diff, as_of)
    put(latest(replaced, "id", "fetched_at", "content_hash"), tables.archive)
    raw = todo.join(targets.select("id", "url"), "id").select("id", "url", "content", "content_hash", "bytes", "fetched_at")
    put(raw.withColumn("bucket", _bucket()), tables.raw, "bucket")
    written = todo.join(targets.select("id", "law_name", "title", "url"), "id").select(*MANIFEST.names)
    put(written, tables.manifest)
    # The touched buckets anew, then the pointers.
    now = latest(state.unionByName(written.withColumn("batch", F.lit(batch_id).cast("long"))), "id", "batch", "fetched_at")
    (now.select(*_STATE.names, _bucket().alias("bucket"), F.lit(batch_id).cast("long").alias("written"))
     .hint("rebalance", "bucket").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("written", "bucket").parquet(tables.current))
    held = {r["bucket"] for r in now.select(_bucket().alias("bucket")).distinct().collect()}
    _point(spark, tables, batch_id, {**pointers, **dict.fromkeys(held, batch_id)})
    state.unpersist()


def _point(spark: SparkSession, tables: IngestTables, batch_id: int, pointers: dict[int, int]) -> None:
    rows = spark.createDataFrame([(b, w, batch_id) for b, w in sorted(pointers.items())], _POINTER).coalesce(1)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(tables.current_versions)


def ingest_stream(spark: SparkSession, landing: str, targets: DataFrame, tables: IngestTables, checkpoint: str,
                  rules: MarkupRules = LAW_PAGE, available_now: bool = True) -> StreamingQuery:
    """Watch a landing folder of Parquet snapshots (id, content, fetched_at)."""
    stream = spark.readStream.schema("id STRING, content STRING, fetched_at TIMESTAMP").parquet(landing)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: apply_batch(batch, batch_id, targets, tables, rules))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
