"""Cosine nearest neighbours of many questions (JOIN-6, JOIN-7, SORT-1, WIN-3, REL-18).

No question x corpus pair is ever a row.  A task scores a block of vectors as matrix
products and hands on only its k best per question; a rank over those partial results
finishes.  Products are taken in single precision and compared with what the k best so far
leave open; only pairs that may be among the k best are scored in double precision.
Distances are kept at nine decimals and ties go to the smaller id, so results
do not depend on block layout or summation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusflow.settings import TOP_K, checkpointed

MAX_BROADCAST_BYTES = 64 * 1024 * 1024
MAX_BROADCAST_ROWS = 8_192   # questions sent to all tasks; with more of them both sides are cut into blocks
MAX_CELLS = 65_536
# Blocks of vectors and of questions have so many rows and bytes (in double precision) at most, and fewer where there
# would not be a few pairs of blocks for every core; but not under LEAST_ROWS for that.
BLOCK_ROWS = 65_536
QUERY_BLOCK_ROWS = 65_536
BLOCK_BYTES = 32 * 1024 * 1024
LEAST_ROWS = 2_048
PAIRS_PER_CORE = 4
MAX_PARTITIONS = 4_000
# A step scores so many questions against so many vectors; the first one, which sets the bounds, against fewer.
STEP_QUERIES, STEP_ROWS, FIRST_ROWS = 512, 2_048, 512


def _scorer(k: int, skip_same: bool):
    """Function (q_ids, q_vectors, c_ids, c_vectors) -> (qid, id, distance) of the k best per question."""

    def unit(v):
        import numpy as np
        m = (v if isinstance(v, np.ndarray) and v.ndim == 2 else np.vstack(v)).astype(np.float64)
        return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)

    def scored(q, c, qi, ci):
        """Distances of pairs, a few at a time."""
        import numpy as np
        step = max(1, 250_000 // max(1, q.shape[1]))
        return np.concatenate([np.round(1.0 - np.einsum("ij,ij->i", q[qi[s:s + step]], c[ci[s:s + step]]), 9)
                               for s in range(0, len(qi), step)]) if len(qi) else np.empty(0)

    def dense(q, c, at, same, limit):
        """Pairs of all questions and vectors whose distance is under the question's limit; for where there are many."""
        import numpy as np
        d = np.round(1.0 - q @ c.T, 9)
        d[same] = np.inf
        keep = d < limit[:, None]
        if d.shape[1] > k:
            keep &= d <= np.partition(d, k - 1, axis=1)[:, k - 1:k]
        qi, ci = np.nonzero(keep)
        return qi, ci + at, d[qi, ci]

    def nearest(q, q32, c, c32, low, high):
        """(question, vector, distance) of the k best; vectors are in the order of their ids, and a question leaves out
        those from its ``low`` to its ``high``."""
        import numpy as np
        rows, error = len(q), np.float32((q.shape[1] + 8) * 2.0 ** -24 + 2e-9)  # of a product in single precision
        limit, bound = np.full(rows, np.inf), np.full(rows, -np.inf, dtype=np.float32)
        held = [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)]
        at = 0
        while at < len(c):
            end = min(len(c), at + (STEP_ROWS if at else FIRST_ROWS))
            s = q32 @ c32[at:end].T
            some = np.nonzero((low < end) & (high > at))[0]
            width = np.minimum(high[some], end) - np.maximum(low[some], at)
            of = np.repeat(some, width)
            same = of, np.repeat(np.maximum(low[some], at) - at, width) + np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width)
            s[same] = -np.inf
            if at == 0 and s.shape[1] > k:
                bound = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 2 * error
            flat = np.flatnonzero(s >= bound[:, None])
            if len(flat) > 0.02 * s.size + 2 * k * rows:  # copies, or bounds that leave much open
                new = dense(q, c[at:end], at, same, limit)
            else:
                qi, ci = np.divmod(flat, s.shape[1])
                ok = s.ravel()[flat] > -np.inf
                qi, ci = qi[ok], ci[ok] + at
                new = qi, ci, scored(q, c, qi, ci)
                ok = new[2] < limit[qi]
                new = [x[ok] for x in new]
            at = end
            if len(new[0]) == 0:
                continue
            held = [np.concatenate(x) for x in zip(held, new)]
            order = np.lexsort((held[1], held[2], held[0]))
            held = [x[order] for x in held]
            begin = np.searchsorted(held[0], np.arange(rows))
            place = np.arange(len(order)) - begin[held[0]]
            last = place == k - 1
            limit[held[0][last]] = held[2][last]
            bound = np.maximum(bound, (1.0 - limit).astype(np.float32) - error)
            held = [x[place < k] for x in held]
        return held

    def best(q_ids, q_unit, c_ids, c_unit):
        import numpy as np
        import pandas as pd
        q_ids, c_ids = np.asarray(q_ids), np.asarray(c_ids)
        order = pd.Series(c_ids).sort_values(kind="stable").index.to_numpy()
        order = order[np.isfinite(c_unit[order]).all(axis=1)]
        c_ids, c = c_ids[order], c_unit[order]
        asked = np.nonzero(np.isfinite(q_unit).all(axis=1) & ~pd.isna(q_ids))[0]
        low = high = np.zeros(len(q_ids), dtype=np.int64)
        if skip_same and len(c):
            codes, ids = pd.factorize(c_ids)
            own = pd.Index(ids).get_indexer(pd.Index(q_ids))
            low, high = (np.where(own < 0, 0, np.searchsorted(codes, own, side)) for side in ("left", "right"))
        c32, found = c.astype(np.float32), []
        for s in range(0, len(asked), STEP_QUERIES):
            some = asked[s:s + STEP_QUERIES]
            q = q_unit[some]
            qi, ci, d = nearest(q, q.astype(np.float32), c, c32, low[some], high[some])
            found.append((some[qi], ci, d))
        qi, ci, d = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0),)
        return pd.DataFrame({"qid": q_ids[qi], "id": c_ids[ci], "distance": d})

    return unit, best


def _schema(queries: DataFrame, corpus: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("qid", queries.schema["qid"].dataType),
        T.StructField("id", corpus.schema["id"].dataType),
        T.StructField("distance", T.DoubleType())])


def rank_hits(partial: DataFrame, k: int) -> DataFrame:
    """SORT-1, WIN-3: (qid, id, rank, distance, score) of the k best."""
    w = Window.partitionBy("qid").orderBy("distance", "id")
    return (partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("qid", "id", "rank", "distance", F.round(1.0 - F.col("distance"), 9).alias("score")))


def _small(df: DataFrame, max_bytes: int, max_rows: int):
    """Rows of df if there are at most max_rows and their vectors fit max_bytes, else None.

    One pass, so a model behind the vectors runs once, and never more than max_rows + 1 rows are fetched.
    """
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows and sum(8 * len(r["vector"]) for r in rows) <= max_bytes else None


def knn_exact(queries: DataFrame, corpus: DataFrame, k: int = TOP_K, skip_same: bool = False,
              max_broadcast_bytes: int = MAX_BROADCAST_BYTES, block_rows: int = BLOCK_ROWS,
              query_block_rows: int = QUERY_BLOCK_ROWS, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """JOIN-6: exact cosine kNN of queries(qid, vector) in corpus(id, vector).

    Questions within ``max_broadcast_rows`` and ``max_broadcast_bytes`` are broadcast and the corpus is
    scanned once with no shuffle of vectors.  More questions go through equal blocks of both sides, of
    up to ``block_rows`` vectors and ``query_block_rows`` questions; each side travels once per block of
    the other.
    """
    k = max(1, k)
    rows = _small(queries.select("qid", "vector"), max_broadcast_bytes, max_broadcast_rows)
    if rows is None:
        return rank_hits(_blocked(queries.withColumn("cell", F.lit(0)), corpus.withColumn("cell", F.lit(0)),
                                  k, skip_same, block_rows, query_block_rows), k)
    schema = _schema(queries, corpus)
    held = queries.sparkSession.sparkContext.broadcast(([r["qid"] for r in rows], [r["vector"] for r in rows]))
    unit, best = _scorer(k, skip_same)

    def scan(batches):
        import pandas as pd
        q_ids, q_vec = held.value
        if not q_ids:
            return
        q_unit, found = unit(q_vec), None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            part = best(q_ids, q_unit, pdf["id"].to_numpy(), unit(pdf["vector"]))
            both = part if found is None else pd.concat([found, part])
            found = both.sort_values(["qid", "distance", "id"]).groupby("qid", sort=False).head(k)
        if found is not None:
            yield found

    return rank_hits(corpus.select("id", "vector").mapInPandas(scan, schema), k)


def _cell_rows(df: DataFrame) -> dict:
    """Rows and longest vector per cell; one number per coarse cell, so the table is as small as the quantiser."""
    rows = df.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).collect()
    return {r["cell"]: (r["n"], max(r["dim"] or 1, 1)) for r in rows}


def _block_sizes(queries: dict, corpus: dict, query_rows: int, rows: int, cores: int) -> tuple[int, int]:
    """Rows of a block of questions and of one of vectors, so that a task can hold both and all cores have some."""
    fit = BLOCK_BYTES // (8 * max([1, *(dim for _, dim in [*queries.values(), *corpus.values()])]))
    query_rows, rows = max(1, min(query_rows, fit)), max(1, min(rows, fit))
    while max(query_rows, rows) >= 2 * LEAST_ROWS and sum(
            -(-queries[c][0] // query_rows) * -(-corpus[c][0] // rows) for c in queries) < PAIRS_PER_CORE * cores:
        if query_rows >= rows:
            query_rows //= 2
        else:
            rows //= 2
    return query_rows, rows


def _blocks(df: DataFrame, cells: list[tuple], own: str, other: str, own_id: str) -> DataFrame:
    """Give each row one block of its own side and a copy for every block of the other side."""
    kind = df.schema["cell"].dataType.simpleString()
    counts = df.sparkSession.createDataFrame(cells, f"cell {kind}, _own int, _other int")
    return (df.join(F.broadcast(counts), "cell").withColumn(own, F.pmod(F.xxhash64(own_id), F.col("_own")))
            .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_other") - 1).cast("long"))))
            .drop("_own", "_other"))


def _matrix(vectors):
    """The rows of a column of lists, without a Python object for each."""
    import numpy as np
    import pyarrow.compute as pc
    vectors = vectors.combine_chunks()
    lengths = pc.unique(pc.list_value_length(vectors))
    if vectors.null_count or len(lengths) > 1:
        raise ValueError("vectors of one length are needed, and none that is null")
    return np.asarray(vectors.flatten().to_numpy(zero_copy_only=False)).reshape(len(vectors), lengths[0].as_py())


def _blocked(queries: DataFrame, corpus: DataFrame, k: int, skip_same: bool,
             block_rows: int = BLOCK_ROWS, query_block_rows: int = QUERY_BLOCK_ROWS) -> DataFrame:
    """Block nested loop inside each cell: a cell of any size is split into blocks of
    bounded rows on both sides, so no group grows with the data."""
    nc, nq = _cell_rows(corpus), _cell_rows(queries)
    shared = sorted(set(nc) & set(nq))
    nc, nq = {c: nc[c] for c in shared}, {c: nq[c] for c in shared}
    query_rows, rows = _block_sizes(nq, nc, query_block_rows, block_rows, queries.sparkSession.sparkContext.defaultParallelism)
    counts = [(c, -(-nq[c][0] // query_rows), -(-nc[c][0] // rows)) for c in shared]
    keys = ["cell", "qb", "cb"]
    # As many partitions as pairs of blocks: a pair is little to move and much to score.
    parts = max(1, min(MAX_PARTITIONS, sum(a * b for _, a, b in counts)))
    q = _blocks(queries.select("cell", "qid", F.col("vector").alias("q_vector")), counts, "qb", "cb", "qid").repartition(parts, *keys)
    c = _blocks(corpus.select("cell", "id", "vector"), [(c, b, a) for c, a, b in counts], "cb", "qb", "id").repartition(parts, *keys)
    unit, best = _scorer(k, skip_same)
    schema = _schema(queries, corpus)
    arrow = to_arrow_schema(schema)

    def score(left, right):
        import pyarrow as pa
        if len(left) == 0 or len(right) == 0:
            return arrow.empty_table()
        found = best(left["qid"].to_pandas().to_numpy(), unit(_matrix(left["q_vector"])), right["id"].to_pandas().to_numpy(), unit(_matrix(right["vector"])))
        return pa.Table.from_arrays([pa.array(found[f.name], f.type, from_pandas=True) for f in arrow], schema=arrow)

    return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(score, schema)


def train_cells(corpus: DataFrame, n_cells: int, seed: int = 42) -> DataFrame:
    """Coarse cells (cell, centroid) by k-means on unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    feats = corpus.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=n_cells, seed=seed, distanceMeasure="cosine", initSteps=2).fit(feats)
    rows = [(i, [float(x) for x in center]) for i, center in enumerate(model.clusterCenters())]
    return corpus.sparkSession.createDataFrame(rows, "cell int, centroid array<double>")


def assign_cells(vectors: DataFrame, cells: DataFrame, nprobe: int = 1) -> DataFrame:
    """Add ``cell``: one row per vector and nearest cell.  The cell table is the coarse
    quantiser, read on the driver with a size check."""
    rows = _small(cells.select("cell", F.col("centroid").alias("vector")), 8 * MAX_BROADCAST_BYTES, MAX_CELLS)
    if rows is None:
        raise ValueError(f"more than {MAX_CELLS} cells or {8 * MAX_BROADCAST_BYTES} bytes of them; train fewer cells")
    held = vectors.sparkSession.sparkContext.broadcast(([r["cell"] for r in rows], [r["vector"] for r in rows]))
    unit, _ = _scorer(1, False)
    schema = T.StructType(vectors.schema.fields + [T.StructField("_cells", T.ArrayType(cells.schema["cell"].dataType))])

    def place(batches):
        import numpy as np
        ids, centroids = held.value
        order = np.argsort(np.asarray(ids))
        ids, centers = np.asarray(ids)[order], unit(centroids)[order]
        for pdf in batches:
            if len(pdf) == 0:
                continue
            d = np.round(1.0 - unit(pdf["vector"]) @ centers.T, 9)
            near = np.argsort(d, axis=1, kind="stable")[:, :nprobe]
            yield pdf.assign(_cells=[ids[row].tolist() for row in near])

    placed = vectors.mapInPandas(place, schema)
    return placed.withColumn("cell", F.explode("_cells")).drop("_cells")


def knn_ivf(queries: DataFrame, corpus: DataFrame, cells: DataFrame, k: int = TOP_K, nprobe: int = 2,
            skip_same: bool = False, block_rows: int = BLOCK_ROWS,
            query_block_rows: int = QUERY_BLOCK_ROWS) -> DataFrame:
    """JOIN-7: kNN among the vectors of the nprobe cells nearest to each question.

    ``corpus`` may already carry its ``cell``; for a table stored by cell ``knn_stored`` reads the asked cells only.
    """
    k = max(1, k)
    if "cell" not in corpus.columns:
        cells = checkpointed(cells)  # read for both sides, and perhaps a mean of all vectors
        corpus = assign_cells(corpus.select("id", "vector"), cells)
    asked = assign_cells(queries.select("qid", "vector"), cells, nprobe)
    return rank_hits(_blocked(asked, corpus, k, skip_same, block_rows, query_block_rows), k)


def knn_stored(queries: DataFrame, corpus: DataFrame, cells: DataFrame, k: int = TOP_K, nprobe: int = 2,
               skip_same: bool = False, max_broadcast_rows: int = MAX_BROADCAST_ROWS, max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
               block_rows: int = BLOCK_ROWS, query_block_rows: int = QUERY_BLOCK_ROWS) -> DataFrame:
    """JOIN-7 over a table stored by cell: corpus(id, vector, cell), as ``sources.vectors`` reads it.

    The questions are placed and stored once, so a model behind them runs once. Cells that no question asks for are not
    read (a literal filter on the partition column). Questions within the limits are sent to the cells' rows, which
    stay where they are read; more of them meet the cells in blocks.
    """
    k = max(1, k)
    asked = checkpointed(assign_cells(queries.select("qid", "vector"), cells, nprobe))
    counts = asked.groupBy("cell").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).collect()  # a row a cell
    near = corpus.select("id", "vector", "cell").where(F.col("cell").isin([r["cell"] for r in counts]))
    rows = sum(r["n"] for r in counts)
    if rows > max_broadcast_rows or sum(8 * r["n"] * r["dim"] for r in counts) > max_broadcast_bytes:
        return rank_hits(_blocked(asked, near, k, skip_same, block_rows, query_block_rows), k)
    unit, best = _scorer(k, skip_same)
    sent: dict = {}
    for r in asked.collect():
        ids, vecs = sent.setdefault(r["cell"], ([], []))
        ids.append(r["qid"])
        vecs.append(r["vector"])
    held = queries.sparkSession.sparkContext.broadcast(sent)

    def scan(batches):
        import pandas as pd
        found = None
        units = {cell: (ids, unit(vecs)) for cell, (ids, vecs) in held.value.items()}
        for pdf in batches:
            for cell, part in pdf.groupby("cell"):
                ids, q_unit = units[cell]
                new = best(ids, q_unit, part["id"].to_numpy(), unit(part["vector"]))
                both = new if found is None else pd.concat([found, new])
                found = both.sort_values(["qid", "distance", "id"]).groupby("qid", sort=False).head(k)
        if found is not None:
            yield found
    return rank_hits(near.mapInPandas(scan, _schema(queries, corpus)), k)


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search returned."""
    hit = found.select("qid", "id", F.lit(1).alias("_hit"))
    return exact.join(hit, ["qid", "id"], "left").agg(
        F.count(F.lit(1)).alias("exact_hits"), F.count("_hit").alias("found_hits"),
        F.round(F.count("_hit") / F.count(F.lit(1)), 4).alias("recall"))


def attach_chunks(hits: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """Late materialisation: texts join the k hits after the search."""
    return hits.join(chunks.select("id", *columns), "id")


def retrieval_summary(hits: DataFrame, query_labels: DataFrame, corpus_labels: DataFrame, k: int = TOP_K) -> DataFrame:
    """RAG-4: one row: questions, mean precision at k, mean recall at k, mean reciprocal rank.

    A question without hits counts with zeros, one whose label no vector has is left out of the recall.
    """
    relevant = corpus_labels.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    per = (query_labels.join(relevant, "label", "left")
           .join(retrieval_metrics(hits, query_labels, corpus_labels, k), "qid", "left")
           .na.fill(0.0, ["precision_at_k", "reciprocal_rank"]))
    return per.agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg("precision_at_k"), 6).alias("mean_precision"),
                   F.round(F.avg(F.col("precision_at_k") * k / F.col("_n")), 6).alias("mean_recall"),
                   F.round(F.avg("reciprocal_rank"), 6).alias("mean_reciprocal_rank"))


def retrieval_metrics(hits: DataFrame, query_labels: DataFrame, corpus_labels: DataFrame, k: int = TOP_K) -> DataFrame:
    """RAG-4 with labels: per question the precision at k and the reciprocal rank."""
    judged = (hits.join(query_labels.select("qid", F.col("label").alias("_want")), "qid")
              .join(corpus_labels.select("id", F.col("label").alias("_got")), "id"))
    good: Column = F.col("_want") == F.col("_got")
    first = F.min(F.when(good, F.col("rank")))
    return judged.groupBy("qid").agg(
        F.round(F.count_if(good) / F.lit(k), 6).alias("precision_at_k"),
        F.round(F.coalesce(F.lit(1.0) / first, F.lit(0.0)), 6).alias("reciprocal_rank"))
