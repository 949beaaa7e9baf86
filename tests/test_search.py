import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from corpusflow.operators import knn
from corpusflow.operators.embed import embed, hash_embed
from corpusflow.operators.knn import assign_cells, knn_exact, knn_ivf, recall_at_k, train_cells

SF = "/root/testdata/sf0.001"


def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def brute(rows, k):
    ids = np.array([r["id"] for r in rows])
    m = np.vstack([r["vector"] for r in rows]).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    d = np.round(1 - m @ m.T, 9)
    np.fill_diagonal(d, np.inf)
    return {(int(ids[i]), int(j)) for i in range(len(ids)) for j in ids[np.lexsort((ids, d[i]))[:k]]}


def pairs(hits):
    return {(r["qid"], r["id"]) for r in hits.collect()}


def test_broadcast_and_block_paths_equal_brute_force(spark):
    corpus = vectors(spark)
    asked = corpus.withColumnRenamed("id", "qid")
    want = brute(corpus.collect(), 5)
    assert pairs(knn_exact(asked, corpus, 5, skip_same=True)) == want
    for limits in ({"max_broadcast_bytes": 1000}, {"max_broadcast_rows": 10, "query_block_rows": 70}):
        assert pairs(knn_exact(asked, corpus, 5, skip_same=True, block_rows=100, **limits)) == want
    small = knn._blocked(asked.withColumn("cell", F.lit(0)), corpus.withColumn("cell", F.lit(0)), 5, True, 64, 50)
    assert pairs(knn.rank_hits(small, 5)) == want


def test_copies_are_ranked_by_id(spark):
    corpus = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(300)] + [(1000, [0.0, 1.0]), (1001, [0.0, 0.0])],
                                   "id int, vector array<double>")
    hits = knn_exact(spark.createDataFrame([(7, [2.0, 0.0])], "qid int, vector array<double>"), corpus, 3)
    assert [(r["id"], r["rank"], r["distance"]) for r in hits.orderBy("rank").collect()] == [(0, 1, 0.0), (1, 2, 0.0), (2, 3, 0.0)]
    everything = knn_exact(spark.createDataFrame([(7, [2.0, 0.0])], "qid int, vector array<double>"), corpus, 1000)
    assert everything.count() == 302
    assert everything.where("id = 1001").head()["score"] == 0.0


def test_no_questions(spark):
    empty = spark.createDataFrame([], "qid int, vector array<double>")
    assert knn_exact(empty, vectors(spark)).count() == 0


def test_ivf_recall(spark):
    corpus = vectors(spark)
    asked = corpus.withColumnRenamed("id", "qid")
    exact = knn_exact(asked, corpus, 5, skip_same=True)
    cells = train_cells(corpus, 6).cache()
    all_cells = knn_ivf(asked, corpus, cells, 5, nprobe=6, skip_same=True)
    assert recall_at_k(all_cells, exact).head()["recall"] == 1.0
    placed = assign_cells(corpus, cells)
    some = recall_at_k(knn_ivf(asked, placed, cells, 5, nprobe=2, skip_same=True), exact).head()["recall"]
    assert 0.3 < some <= 1.0


def test_embed_port(spark):
    def make():
        def predict(texts):
            return np.array([[len(t), 1.0, 0.0] for t in texts])
        return predict
    df = spark.createDataFrame([(1, "ab"), (2, "abcd")], "id int, t string")
    rows = embed(df, "t", make, dim=3, batch_size=2).orderBy("id").collect()
    assert np.isclose(rows[0]["embedding_vector"][0], 11 / np.sqrt(122)) and len(rows[1]["embedding_vector"]) == 3


def test_embed_port_checks_dimension(spark):
    import pytest
    def make():
        return lambda texts: np.zeros((len(texts), 2))
    df = spark.createDataFrame([(1, "ab")], "id int, t string")
    with pytest.raises(Exception, match="expected dimension 3"):
        embed(df, "t", make, dim=3).collect()


def test_hash_embed_of_blank_text_is_zero(spark):
    df = spark.createDataFrame([(1, "  "), (2, "So'z so'z SO'Z")], "id int, t string")
    rows = {r["id"]: r["vector"] for r in hash_embed(df, "id", "t", 8).collect()}
    assert rows[1] == [0.0] * 8 and sorted(map(abs, rows[2]))[-1] == 1.0


def test_stored_cells_read_what_is_asked(spark, tmp_path, capsys):
    """A literal filter on the cell folders, no exchange of vectors for few questions, blocks for many."""
    from corpusflow.sources.vectors import read_vectors, write_vectors
    cells = spark.createDataFrame([(c, [float(c == i) for i in range(4)]) for c in range(4)], "cell int, centroid array<double>")
    rng = np.random.default_rng(3)
    rows = [(f"k{i:03}", "t", "L", "1", "", "", (np.eye(4)[i % 4] + 0.1 * rng.random(4)).tolist(), "s") for i in range(200)]
    write_vectors(spark.createDataFrame(rows, "id string, text string, law_name string, article_number string, chapter string, "
                                              "section_title string, embedding_vector array<double>, source_id string"),
                  str(tmp_path / "t"), dim=4, cells=cells)
    corpus = read_vectors(spark, str(tmp_path / "t"), by_cell=True).withColumnRenamed("embedding_vector", "vector")
    asked = spark.createDataFrame([(1, [1.0, 0.1, 0.0, 0.0]), (2, [0.2, 1.0, 0.0, 0.0])], "qid int, vector array<double>")
    hits = knn.knn_stored(asked, corpus, cells, 5, nprobe=1)
    want = pairs(knn_ivf(asked, corpus.select("id", "vector"), cells, 5, nprobe=1))
    assert pairs(hits) == want and len(want) == 10
    hits.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [cell" in plan.replace("isnotnull", "") and " IN (0,1)" in plan
    assert plan.count("hashpartitioning") <= plan.count("hashpartitioning(qid")
    assert pairs(knn.knn_stored(asked, corpus, cells, 5, nprobe=1, max_broadcast_rows=1, block_rows=20)) == want
    assert knn.knn_stored(asked.limit(0), corpus, cells, 5).count() == 0


def test_search_holds_small_matrices():
    """The distances of a full Arrow batch and their copies do not grow with the questions."""
    unit, best = knn._scorer(5, False)
    rng = np.random.default_rng(3)
    q, c = unit(rng.normal(size=(400, 8))), unit(rng.normal(size=(10_000, 8)))
    tracemalloc.start()
    found = best(np.arange(400), q, np.arange(10_000), c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 2000 and peak < 24e6
