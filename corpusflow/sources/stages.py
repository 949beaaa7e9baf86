"""SRC-4, SNK-4..8: Parquet hand-offs between stages and the change-tracking tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_stage(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_stage(df: DataFrame, path: str, mode: str = "overwrite", counted: dict | None = None) -> dict:
    """SNK-4: write and return counts observed during the write itself (no second pass).

    ``counted`` maps names to aggregate expressions; ``rows`` is always there.
    """
    seen = Observation()
    metrics = {"rows": F.count(F.lit(1)), **(counted or {})}
    df.observe(seen, *[expr.alias(name) for name, expr in metrics.items()]).write.mode(mode).parquet(path)
    return dict(seen.get)


def append(df: DataFrame, path: str, *partition: str) -> None:
    """SNK-6/7/8: append log, archive or message rows."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
