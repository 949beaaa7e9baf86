import shutil
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusflow.operators.markup import WEB_PAGE
from corpusflow.streaming import ingest
from corpusflow.streaming.ingest import IngestTables, current_chunks, current_manifest, ingest_stream
from corpusflow.streaming.sessions import session_activity
from corpusflow.streaming.tokens import close_early, fold_closed, fold_tokens

EVENTS = "session_id string, seq long, token string, stop_reason string, ts timestamp"


def _run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_token_stream_equals_batch(spark, tmp_path):
    first = [("a", 1, "Sa", None), ("b", 1, "X", None), ("a", 3, "!", None)]
    second = [("a", 2, "lom", None), ("a", 4, None, "eog"), ("b", 2, "Y", None)]
    for i, part in enumerate((first, second)):
        rows = spark.createDataFrame(part, "session_id string, seq long, token string, stop_reason string")
        rows.withColumn("ts", F.lit("2026-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev"))
    got = {tuple(r) for r in _run(fold_tokens(stream), "folded", "complete").collect()}
    want = {tuple(r) for r in fold_tokens(spark.read.schema(EVENTS).parquet(str(tmp_path / "ev"))).collect()}
    assert got == want == {("a", "Salom!", "eog", True, 3), ("b", "XY", None, False, 2)}


def test_closed_messages_drop_state(spark, tmp_path):
    rows = [("a", 1, "Sa", None, 0), ("a", 2, "lom", "eog", 10), ("b", 1, "keyin", None, 9000)]
    df = spark.createDataFrame(rows, "session_id string, seq long, token string, stop_reason string, s int")
    df.select("session_id", "seq", "token", "stop_reason", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).alias("ts")
              ).coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "ev"))
    got = [(r["session_id"], r["content"], r["stop_reason"]) for r in _run(fold_closed(stream), "closed", "append").collect()]
    assert got == [("a", "Salom", "eog")]


def test_messages_close_at_their_end_event(spark, tmp_path):
    """Out of order, repeated and late events; the message leaves with the batch that completes it, silent sessions at a timeout."""
    start = 1_700_000_000
    batches = [[("a", 1, "Sa", None, 0), ("a", 3, "!", None, 1), ("b", 1, "X", None, 1), ("c", 1, "yarim", None, 2)],
               [("a", 4, None, "eog", 3), ("b", 2, "Y", None, 3), ("b", 2, "Z", None, 3), ("a", 3, "?", None, 4)],
               [("a", 2, "lom", None, 5), ("b", 3, None, "max", 5), ("b", 1, "X", None, 6)],
               [("a", 2, "kech", None, 7), ("a", 4, None, "eog", 7), ("b", 4, "kech", None, 8)],
               [("z", 1, None, "eog", 9000)], [("z", 1, None, "eog", 9001)]]
    for n, part in enumerate(batches):
        rows = spark.createDataFrame(part, "session_id string, seq long, token string, stop_reason string, s int")
        rows.select("session_id", "seq", "token", "stop_reason", F.timestamp_seconds(F.lit(start) + F.col("s")).alias("ts")
                    ).coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
        time.sleep(0.05)  # files are taken in the order of their times
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    seen = []
    q = (close_early(stream, "1 second", 60).writeStream.outputMode("append").trigger(availableNow=True)
         .foreachBatch(lambda df, n: seen.append((n, sorted(map(tuple, df.collect()))))).start())
    q.awaitTermination(200)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = [(n, *r) for n, found in seen for r in found]
    assert (2, "a", "Salom!", "eog") in rows and (2, "b", "XY", "max") in rows
    assert sorted(r[1:] for r in rows) == [("a", "Salom!", "eog"), ("b", "XY", "max"), ("c", "yarim", "idle"), ("z", "", "eog")]


def test_activity_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev"))
    got = {tuple(r) for r in _run(session_activity(stream, "user_id", "ts"), "activity", "complete").collect()}
    assert got == {tuple(r) for r in session_activity(events, "user_id", "ts").collect()}


def _page(n, text):
    return f'<div id="divCont"><div class="CLAUSE_DEFAULT">{n}-modda. Sarlavha</div><div class="ACT_TEXT">{text}</div></div>'


def test_incremental_ingest(spark, tmp_path):
    targets = spark.createDataFrame([(i, "Kodeks", "T", "uz", "http://x/" + i) for i in "abc"],
                                    "id string, law_name string, title string, language string, url string")
    tables, landing = IngestTables(str(tmp_path / "t")), str(tmp_path / "in")

    def land(day, *pages):
        rows = spark.createDataFrame([(i, _page(1, t)) for i, t in pages], "id string, content string")
        rows.withColumn("fetched_at", F.lit(f"2026-01-0{day}").cast("timestamp")).coalesce(1).write.mode("append").parquet(landing)
        ingest_stream(spark, landing, targets, tables, str(tmp_path / "cp")).awaitTermination(120)

    land(1, ("a", "bir"), ("b", "ikki"))
    land(2, ("a", "bir"), ("b", "ikki yangi"), ("c", "uch"))
    texts = {(r["source_id"], r["text"]) for r in current_chunks(spark, tables).collect()}
    assert texts == {("a", "Sarlavha. bir"), ("b", "Sarlavha. ikki yangi"), ("c", "Sarlavha. uch")}
    # The unchanged page was not parsed again, and only the replaced version went to the archive.
    assert spark.read.parquet(tables.chunks).where("batch = 1").count() == 2
    assert [(r["id"], "ikki" in r["content"]) for r in spark.read.parquet(tables.archive).collect()] == [("b", True)]
    log = {(r["id"], r["status"], r["batch"]) for r in spark.read.parquet(tables.change_log).collect()}
    assert log == {("a", "initial", 0), ("b", "initial", 0), ("b", "changed", 1), ("c", "initial", 1)}
    assert current_manifest(spark, tables).count() == 3
    # A batch that breaks off before its pointers leaves the state as it was, and does the same when it runs again.
    before = sorted(map(tuple, current_manifest(spark, tables).collect()))
    late = spark.createDataFrame([("a", _page(1, "bir keyin"))], "id string, content string").withColumn(
        "fetched_at", F.lit("2026-01-09").cast("timestamp"))
    point = ingest._point
    ingest._point = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        with pytest.raises(RuntimeError, match="lost"):
            ingest.apply_batch(late, 99, targets, tables)
    finally:
        ingest._point = point
    assert sorted(map(tuple, current_manifest(spark, tables).collect())) == before
    copy = IngestTables(str(tmp_path / "again"))
    shutil.copytree(tables.root, copy.root)
    for _ in range(2):
        ingest.apply_batch(late, 99, targets, copy)
        assert {r["source_id"]: r["text"] for r in current_chunks(spark, copy).collect()}["a"] == "Sarlavha. bir keyin"
        assert spark.read.parquet(copy.archive).where("batch = 99").count() == 1 and current_manifest(spark, copy).count() == 3
    # Only the folders of the batch's own buckets are read.
    assert all("written=99" in f for f in ingest._state(spark, copy, {b: w for b, w in ingest._pointers(spark, copy).items() if w == 99}).inputFiles())
    # A version without any text leaves nothing of the older ones.
    spark.createDataFrame([("c", "<body></body>")], "id string, content string").withColumn(
        "fetched_at", F.lit("2026-01-03").cast("timestamp")).coalesce(1).write.mode("append").parquet(landing)
    ingest_stream(spark, landing, targets, tables, str(tmp_path / "cp")).awaitTermination(120)
    assert {r["source_id"] for r in current_chunks(spark, tables).collect()} == {"a", "b"}


def test_a_folder_is_written_by_one_task(spark, tmp_path):
    """Tasks do not each write a file in every folder of ids."""
    rows = spark.range(600).select(F.concat(F.lit("d"), "id").alias("id"), F.lit("<html><body><h1>a</h1><p>b</p></body></html>").alias("content"),
                                   F.lit("2026-01-01").cast("timestamp").alias("fetched_at"))
    targets = rows.select("id", F.lit("n").alias("law_name"), F.lit("t").alias("title"), F.lit("u").alias("url"))
    tables, merged = IngestTables(str(tmp_path)), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merged, "false")  # as with tables too large for it
    try:
        ingest.apply_batch(rows, 0, targets, tables, WEB_PAGE)
    finally:
        spark.conf.unset(merged)
    for table in (tables.raw, tables.current):
        files = [f.parent for f in Path(table).rglob("*.parquet")]
        assert len(files) == len(set(files)) > 200
    assert current_chunks(spark, tables).count() == 600
