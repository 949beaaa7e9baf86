"""SRC-1/2: the list of documents to ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusflow.operators.snapshots import missing_ids, select_ids
from corpusflow.schemas import TARGETS


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Targets from JSON lines; an empty list is an error."""
    df = spark.read.schema(TARGETS).json(path)
    if df.isEmpty():
        raise ValueError(f"no targets found in {path}")
    return df


def select_targets(targets: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """(wanted targets, unknown ids sorted); the caller decides whether unknown ids are an error."""
    wanted = targets.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    return select_ids(targets, wanted), missing_ids(targets, wanted).orderBy("id")
