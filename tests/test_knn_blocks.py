"""Exact search in blocks: what is scored in double precision, and how often vectors travel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import knn


def brute(q_ids, q, c_ids, c, k, skip_same):
    d = np.round(1.0 - q @ c.T, 9)
    out = set()
    for i in range(len(q)):
        hits = [(d[i, j], c_ids[j]) for j in range(len(c)) if np.isfinite(d[i, j]) and not (skip_same and q_ids[i] == c_ids[j])]
        out |= {(q_ids[i], n, dist) for dist, n in sorted(hits)[:k]}
    return out


def cases():
    rng = np.random.default_rng(5)
    spread = rng.normal(size=(3_000, 8))
    close = rng.normal(size=(1, 8)) + 1e-6 * rng.normal(size=(3_000, 8))  # under what single precision tells apart
    copies = np.repeat(rng.normal(size=(3, 8)), 1_000, axis=0)
    odd = spread.copy()
    odd[::7], odd[3::50], odd[5::91] = 0.0, np.nan, np.inf
    ids = rng.permutation(3_000)
    return [("spread", ids, spread), ("close", ids, close), ("copies", ids, copies), ("odd", ids, odd), ("repeated ids", ids // 3, spread),
            ("texts", np.array([f"k{i}" for i in ids], dtype=object), spread), ("few", ids[:4], spread[:4])]


@pytest.mark.parametrize("name,ids,rows", cases(), ids=[c[0] for c in cases()])
@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_hits_equal_all_distances(name, ids, rows):
    for k, skip_same in ((5, True), (1, False), (700, True)):
        unit, best = knn._scorer(k, skip_same)
        asked = slice(0, 60)
        u = unit(rows)
        found = best(ids[asked], u[asked], ids, u)
        got = list(zip(found["qid"], found["id"], found["distance"].round(8)))
        want = {(q, c, round(d, 8)) for q, c, d in brute(ids[asked], u[asked], ids, u, k, skip_same)}
        assert set(got) == want, (name, k)
        assert found.groupby("qid").size().max() <= k * (3 if name == "repeated ids" else 1)


def test_few_distances_are_ordered(monkeypatch):
    """The k best of a question are not looked for among all its distances."""
    ordered, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *args, **kw: ordered.append(a.size) or partition(a, *args, **kw))
    rng = np.random.default_rng(3)
    unit, best = knn._scorer(5, False)
    q, c = unit(rng.normal(size=(100, 16))), unit(rng.normal(size=(20_000, 16)))
    assert len(best(np.arange(100), q, np.arange(20_000), c)) == 500
    assert sum(ordered) <= 0.05 * 100 * 20_000


def test_blocks_travel_few_times():
    """Many questions are cut into as large blocks as vectors, wide vectors into smaller ones, and all cores get some."""
    many = {0: (700_000, 64)}
    assert knn._block_sizes(many, many, knn.QUERY_BLOCK_ROWS, knn.BLOCK_ROWS, 8) == (65_536, 65_536)
    wide = {0: (700_000, 1_024)}
    assert knn._block_sizes(wide, wide, knn.QUERY_BLOCK_ROWS, knn.BLOCK_ROWS, 8) == (4_096, 4_096)
    some = {0: (50_000, 64)}
    query_rows, rows = knn._block_sizes(some, some, knn.QUERY_BLOCK_ROWS, knn.BLOCK_ROWS, 8)
    assert (50_000 / query_rows) * (50_000 / rows) > 8 and min(query_rows, rows) >= knn.LEAST_ROWS
    assert knn._block_sizes(some, some, 50, 100, 8) == (50, 100)


def test_blocks_join_their_counts_in_place(spark):
    """A cell is told its blocks without an exchange; each row goes to a block of its own side once per block of the other."""
    rows = spark.range(1_000).select(F.col("id"), F.array(F.lit(1.0)).alias("vector"), F.lit(0).alias("cell"))
    dealt = knn._blocks(rows, [(0, 4, 3)], "cb", "qb", "id")
    assert dealt.count() == 3_000 and dealt.select("cb").distinct().count() == 4
    assert "Cartesian" not in dealt._jdf.queryExecution().executedPlan().toString()


def test_vectors_without_one_length_are_refused(spark):
    for odd in ([1.0], None):
        rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, odd)], "id int, vector array<double>")
        with pytest.raises(Exception, match="one length"):
            knn.knn_exact(rows.withColumnRenamed("id", "qid"), rows, 1, max_broadcast_rows=1).collect()


def test_cells_are_made_once(spark):
    """They may be means of all vectors."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for part in batches:
            made.add(part.num_rows)
            yield part
    cells = spark.createDataFrame([(c, [float(c == i) for i in range(3)]) for c in range(3)], "cell int, centroid array<double>")
    rows = spark.createDataFrame([(i, [float(i % 3 == 0), float(i % 3 == 1), 0.5 + i / 50]) for i in range(30)], "id int, vector array<double>")
    hits = knn.knn_ivf(rows.withColumnRenamed("id", "qid"), rows, cells.mapInArrow(count, cells.schema), 2, skip_same=True)
    assert hits.count() > 30 and made.value == 3
