"""SRC-7, SNK-1..3, JOIN-3: the vector table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from corpusflow.operators.knn import assign_cells
from corpusflow.schemas import VECTORS
from corpusflow.settings import EMBEDDING_DIM, checkpointed

SOURCE_BUCKETS = 64
TEXT_COLUMNS = ("id", "text", "law_name", "article_number", "chapter", "section_title")


def bad_dimension(vector: str, dim: int):
    return F.col(vector).isNull() | (F.size(vector) != dim)


def validate_dim(df: DataFrame, vector: str = "embedding_vector", dim: int = EMBEDDING_DIM) -> DataFrame:
    """SNK-3: fail the job on the first null or wrongly sized vector, naming its row."""
    message = F.concat(F.lit("bad vector on "), F.col("id").cast("string"), F.lit(f" (expected dimension {dim})"))
    checked = F.when(bad_dimension(vector, dim), F.raise_error(message)).otherwise(F.col(vector))
    return df.withColumn(vector, checked)


def to_vector_rows(df: DataFrame, *keep: str, vector: str = "embedding_vector") -> DataFrame:
    """SNK-2: the seven stored columns (and those to keep); missing text is the empty string."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in TEXT_COLUMNS],
                     F.col(vector).cast("array<float>").alias("embedding_vector"), *keep)


def attach_vectors(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_key") -> DataFrame:
    """JOIN-3: one vector per chunk; a chunk without one or with two, and a vector without a chunk, fail the job."""
    once = vectors.groupBy(key).agg(F.any_value("embedding_vector").alias("_v"), F.count(F.lit(1)).alias("_n"))
    joined = chunks.withColumn("_chunk", F.lit(True)).join(once, key, "full")
    bad = F.concat(F.when(F.col("_chunk").isNull(), F.lit("vector without a chunk: "))
                   .otherwise(F.lit("chunk without exactly one vector: ")), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    ok = F.coalesce(F.col("_chunk") & (F.col("_n") == 1), F.lit(False))
    return (joined.withColumn("embedding_vector", F.when(ok, F.col("_v")).otherwise(F.raise_error(bad)))
            .drop("_v", "_n", "_chunk"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("source_id"), F.lit(buckets)).cast("int")


_MANIFEST = "seq long, bucket int, buckets int, folder string"


def _current(spark: SparkSession, path: str) -> DataFrame | None:
    """(bucket, seq, buckets, folder): the newest folder of each bucket; None where there is no table."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{path}/_manifest")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    newest = rows.groupBy("bucket").agg(F.max(F.struct("seq", "buckets", "folder")).alias("r"))
    return newest.select("bucket", "r.*")


def _read(spark: SparkSession, path: str, folders: list[str], by_cell: bool) -> DataFrame:
    extra = [T.StructField("source_id", T.StringType())] + [T.StructField("cell", T.IntegerType())] * by_cell
    reader = spark.read.schema(T.StructType(VECTORS.fields + extra)).option("basePath", f"{path}/data")
    return reader.parquet(*folders)


def write_vectors(df: DataFrame, path: str, overwrite: bool = False, dim: int = EMBEDDING_DIM,
                  cells: DataFrame | None = None, buckets: int = SOURCE_BUCKETS) -> None:
    """SNK-1: store validated rows in folders by a hash of ``source_id``; with ``cells`` each of them is
    divided by the cell of the vector, so that a search reads the cells it asks for (``knn_stored``).

    Without ``overwrite`` an existing table is an error.  With it, all rows of the sources in ``df`` are replaced, and
    a table that is not there is made: the buckets these sources fall into are written anew, from the new rows and
    the other sources' rows.  New folders are complete before the manifest names them, so a reader, or a writer that
    fails, leaves the table as it was.  ``df`` is computed once; without rows it is an error.  Empty ``buckets`` of a
    table that exists follow the table, not the argument.
    """
    spark = df.sparkSession
    current = _current(spark, path)
    if current is not None:
        if not overwrite:
            raise FileExistsError(f"a vector table at {path} already exists")
        current = current.collect()  # a row a bucket
        buckets = current[0]["buckets"]
    rows = validate_dim(to_vector_rows(df, "source_id"), dim=dim)
    if cells is not None:
        placed = assign_cells(rows.withColumnRenamed("embedding_vector", "vector"), cells)
        rows = placed.withColumnRenamed("vector", "embedding_vector").withColumn("cell", F.col("cell").cast("int"))
    folder, by = f"{path}/data/write={uuid.uuid4().hex}", ["bucket", "cell"][:1 + (cells is not None)]
    seen = Observation()
    rows = rows.withColumn("bucket", _bucket(buckets)).observe(seen, F.count(F.lit(1)).alias("rows"))

    def add(part: DataFrame, mode: str) -> None:
        # Partitions of even size, whatever share of the rows a bucket or a cell has.
        part.hint("rebalance", *by).write.partitionBy(*by).option("maxRecordsPerFile", 1_000_000).mode(mode).parquet(folder)
    add(rows, "errorifexists")
    if not seen.get["rows"]:
        raise ValueError("no rows to write")
    staged = _read(spark, path, [folder], cells is not None)
    if current:
        sources = checkpointed(staged.select(F.col("source_id").alias("_s"), F.col("bucket").alias("_b")).distinct())
        stored = _read(spark, path, [f"{r['folder']}/bucket={r['bucket']}" for r in current], cells is not None)
        touched = stored.join(sources.select("_b").distinct(), F.col("bucket") == F.col("_b"), "left_semi")
        others = touched.join(sources, F.col("source_id").eqNullSafe(F.col("_s")), "left_anti").drop("write")
        add(others.select(*rows.columns), "append")
    seq = 1 + max((r["seq"] for r in current or []), default=0)
    named = staged.select(F.lit(seq).cast("long").alias("seq"), F.col("bucket").cast("int").alias("bucket"),
                          F.lit(buckets).cast("int").alias("buckets"), F.lit(folder).alias("folder")).distinct()
    named.coalesce(1).write.mode("append").parquet(f"{path}/_manifest")


def read_vectors(spark: SparkSession, path: str, by_cell: bool = False) -> DataFrame:
    """SRC-7: the stored table with its declared schema; a missing table is an error."""
    current = _current(spark, path)
    if current is None:
        raise FileNotFoundError(f"no vector table at {path}")
    return _read(spark, path, [f"{r['folder']}/bucket={r['bucket']}" for r in current.collect()], by_cell).drop(
        "write", "bucket", *([] if by_cell else ["cell"]))
