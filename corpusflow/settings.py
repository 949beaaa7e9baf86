"""Numeric defaults shared by the operators, and the reliable checkpoint helper."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Sizes the data contract depends on.
EMBEDDING_DIM = 384
EMBED_BATCH = 32
PASSAGE_PREFIX = "passage: "
QUERY_PREFIX = "query: "
MAX_TOKENS = 500
OVERLAP_TOKENS = 50
TOKENS_PER_WORD = 1.3
TOP_K = 5
CONTEXT_TOKENS = 4096
MIN_QUOTE_CHARS = 12
MIN_CLAIM_CHARS = 8
MAX_UPLOAD_BYTES = 20 * 1024 * 1024
UPLOAD_EXTENSIONS = ("pdf", "docx", "txt", "md")


def analysis_budget(n_ctx: int = CONTEXT_TOKENS) -> tuple[int, int]:
    """NUM-5: (characters per analysis chunk, overlap) for a model context of n_ctx tokens."""
    max_chars = min(max(n_ctx * 3 // 4, 2000), 12000)
    return max_chars, recommended_overlap(max_chars)


def recommended_overlap(max_chars: int) -> int:
    return min(max(max_chars // 3, 600), 2500)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names.

    It must be shared storage on a cluster; only a local session without one gets a folder
    of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="corpusflow-ckpt-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
