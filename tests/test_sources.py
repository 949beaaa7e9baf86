import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusflow.functions.vectors import cosine_distance, l2_normalize, similarity
from corpusflow.operators.chatlog import ensure_column, histories, history, messages_of, store_log
from corpusflow.operators.snapshots import diff_snapshots
from corpusflow.schemas import ARTICLES
from corpusflow.sources.files import extract_text, read_snapshots, read_uploads
from corpusflow.sources.stages import append, read_stage, write_stage
from corpusflow.sources.targets import read_targets, select_targets
from corpusflow.sources.vectors import attach_vectors, read_vectors, validate_dim, write_vectors


def test_targets(spark, tmp_path):
    (tmp_path / "t.json").write_text("\n".join(json.dumps({"id": i, "law_name": "L", "url": "u"}) for i in ("a", "b")))
    targets = read_targets(spark, str(tmp_path / "t.json"))
    wanted, unknown = select_targets(targets, ["b", "z", "y"])
    assert [r["id"] for r in wanted.collect()] == ["b"] and [r["id"] for r in unknown.collect()] == ["y", "z"]
    (tmp_path / "empty.json").write_text("")
    with pytest.raises(ValueError):
        read_targets(spark, str(tmp_path / "empty.json"))


def test_snapshots_are_decoded_with_replacement(spark, tmp_path):
    (tmp_path / "x.html").write_bytes("salom ".encode() + b"\xff")
    (tmp_path / "x.txt").write_bytes(b"no")
    rows = read_snapshots(spark, str(tmp_path)).collect()
    assert [(r["id"], r["content"], r["bytes"]) for r in rows] == [("x", "salom �", 7)]


def test_uploads(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:p><w:t>Bir  &amp;</w:t><w:t xml:space="preserve"> ikki &lt;uch&gt;</w:t></w:p>')
    (tmp_path / "a.docx").write_bytes(buf.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"PK nothing")
    (tmp_path / "b.TXT").write_text("Salom\ndunyo")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.exe").write_bytes(b"x")
    rows = {r["path"].split("/")[-1]: r for r in extract_text(read_uploads(spark, str(tmp_path))).collect()}
    assert rows["a.docx"]["text"] == "Bir & ikki <uch>" and rows["b.TXT"]["text"] == "Salom\ndunyo"
    assert rows["bad.docx"]["error"] == "missing word/document.xml" and rows["d.exe"]["error"] == "unsupported type"
    assert rows["c.pdf"]["text"] is None and len(rows) == 5


def _vectors(spark, *rows):
    return spark.createDataFrame([(i, "t", "L", "1", None, None, [float(x), 1.0], s) for i, x, s in rows],
                                 "id string, text string, law_name string, article_number string, chapter string, "
                                 "section_title string, embedding_vector array<double>, source_id string")


def test_vector_table(spark, tmp_path):
    path = str(tmp_path / "vectors")
    with pytest.raises(FileNotFoundError):
        read_vectors(spark, path)
    write_vectors(_vectors(spark, ("a", 1, "s1"), ("b", 2, "s2")), path, dim=2)
    with pytest.raises(Exception, match="(?i)already exists"):
        write_vectors(_vectors(spark, ("c", 3, "s1")), path, dim=2)
    write_vectors(_vectors(spark, ("c", 3, "s1")), path, overwrite=True, dim=2)
    rows = read_vectors(spark, path).orderBy("id").collect()
    assert [(r["id"], r["source_id"], r["chapter"]) for r in rows] == [("b", "s2", ""), ("c", "s1", "")]
    with pytest.raises(ValueError):
        write_vectors(_vectors(spark, ("a", 1, "s1")).limit(0), path, overwrite=True, dim=2)
    write_vectors(_vectors(spark, ("n", 4, None)), path, overwrite=True, dim=2)
    write_vectors(_vectors(spark, ("m", 5, None)), path, overwrite=True, dim=2)
    assert {r["id"] for r in read_vectors(spark, path).collect()} == {"b", "c", "m"}
    with pytest.raises(Exception, match="bad vector on a"):
        validate_dim(_vectors(spark, ("a", 1, "s1")), dim=3).collect()


def test_vector_table_overwrite_is_staged(spark, tmp_path):
    """A table that is not there is made; a failed write leaves the table as it was; the rows are computed once."""
    path = str(tmp_path / "new")
    ran = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def model(v):
        ran.add(1)
        return v
    rows = _vectors(spark, *((f"k{i}", i, f"s{i % 7}") for i in range(50)))
    write_vectors(rows.withColumn("embedding_vector", model.asNondeterministic()("embedding_vector")), path, overwrite=True, dim=2)
    assert ran.value == 50
    before = sorted(map(tuple, read_vectors(spark, path).collect()))
    with pytest.raises(Exception, match="bad vector on x"):
        write_vectors(_vectors(spark, ("x", 1, "s1")), path, overwrite=True, dim=3)
    assert sorted(map(tuple, read_vectors(spark, path).collect())) == before and len(before) == 50
    write_vectors(_vectors(spark, ("y", 1, "s1"), ("z", 1, "s3")), path, overwrite=True, dim=2)
    assert {r["id"] for r in read_vectors(spark, path).collect()} == {"y", "z", *(f"k{i}" for i in range(50) if i % 7 not in (1, 3))}


def test_vector_table_by_cell(spark, tmp_path):
    path = str(tmp_path / "cells")
    cells = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cell int, centroid array<double>")
    write_vectors(_vectors(spark, ("a", 9, "s1"), ("b", 0, "s2")), path, dim=2, cells=cells)
    assert {(r["id"], r["cell"]) for r in read_vectors(spark, path, by_cell=True).collect()} == {("a", 0), ("b", 1)}
    write_vectors(_vectors(spark, ("c", 1, "s1")), path, overwrite=True, dim=2, cells=cells)
    assert {(r["id"], r["source_id"]) for r in read_vectors(spark, path, by_cell=True).collect()} == {("b", "s2"), ("c", "s1")}


def test_attach_vectors_is_strict(spark):
    chunks = spark.createDataFrame([("k1",), ("k2",)], "chunk_key string")
    vecs = spark.createDataFrame([("k1", [1.0]), ("k2", [2.0]), ("k2", [3.0])], "chunk_key string, embedding_vector array<double>")
    assert attach_vectors(chunks.where("chunk_key = 'k1'"), vecs.where("chunk_key = 'k1'")).count() == 1
    with pytest.raises(Exception, match="chunk without exactly one vector"):
        attach_vectors(chunks, vecs).collect()
    with pytest.raises(Exception, match="vector without a chunk"):
        attach_vectors(chunks.where("chunk_key = 'k1'"), vecs.where("chunk_key = 'k1'").union(
            spark.createDataFrame([("k9", [1.0])], vecs.schema))).collect()


def test_stage_write_counts(spark, tmp_path):
    df = spark.createDataFrame([("a", "L", 0, "1", "t", "", "", "x")], ARTICLES)
    seen = write_stage(df, str(tmp_path / "art"), counted={"laws": F.count_if(F.col("law_name") == "L")})
    append(df, str(tmp_path / "art"))
    assert seen == {"rows": 1, "laws": 1} and read_stage(spark, str(tmp_path / "art"), ARTICLES).count() == 2


def test_diff_statuses(spark):
    old = spark.createDataFrame([("a", "1", True), ("b", "1", True), ("c", "1", False), ("d", "1", True)], "id string, content_hash string, raw_present boolean")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("e", "9")], "id string, content_hash string")
    got = {r["id"]: r["status"] for r in diff_snapshots(new, old).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "restored", "d": "removed", "e": "initial"}
    assert {r["id"]: r["status"] for r in diff_snapshots(new, old, force=True).collect()}["a"] == "rewritten"


def test_history_and_migration(spark):
    df = spark.createDataFrame([("m2", "s", "assistant", "b", 2), ("m1", "s", "user", "a", 1), ("m3", "x", "user", "c", 3)],
                               "id string, session_id string, role string, content string, created_at int")
    rows = history(df, "s").collect()
    assert [(r["id"], r["references"]) for r in rows] == [("m1", []), ("m2", [])]
    assert ensure_column(df, "role", "x").columns == df.columns


def test_vector_expressions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>").select(
        l2_normalize("a").alias("n"), l2_normalize("z").alias("z"), cosine_distance("a", "b").alias("d"),
        similarity(F.lit(None).cast("double")).alias("s")).head()
    assert row["n"] == [0.6, 0.8] and row["z"] == [0.0, 0.0] and abs(row["d"] - 0.04) < 1e-12 and row["s"] == 0.0


def test_stored_log_joins_without_an_exchange(spark, tmp_path, capsys):
    rows = spark.range(300).select((F.col("id") % 20).alias("session_id"), F.concat(F.lit("m"), F.lpad("id", 4, "0")).alias("id"), F.lit("user").alias("role"),
                                   F.lit("x").alias("content"), F.timestamp_seconds(1000 - F.col("id")).alias("created_at"))
    log = store_log(rows, "kept_log", str(tmp_path / "log"), buckets=4)
    listed = store_log(rows.groupBy("session_id").agg(F.min("id").alias("title")), "kept_sessions", str(tmp_path / "sessions"), buckets=4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = messages_of(listed, histories(log))
        joined.explain()
        assert "Exchange" not in capsys.readouterr().out
        got = [(r.session_id, r.seq, r.id) for r in joined.orderBy("session_id", "seq").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == [(s, k, f"m{i:04}") for s in range(20) for k, i in enumerate(sorted(range(s, 300, 20), reverse=True))]
