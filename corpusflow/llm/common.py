"""Helpers shared by the operators: text batches, stored intermediate tables, word hashes."""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_BYTES = 4 << 20    # text of a packed run
SLICE_BYTES = 2 << 20  # text turned into Python objects at a time elsewhere


def give_back() -> None:
    """Return freed memory to the system, which neither Arrow's pool nor the C library does by itself."""
    pa.default_memory_pool().release_unused()
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):  # not the GNU library
        return
    trim(0)


_task: int | None = None


def begin_task() -> None:
    """``give_back`` at a task's first call: Python workers outlive their tasks, and what an earlier one (of any stage)
    has freed but not returned would add to what this one needs."""
    global _task
    context = TaskContext.get()
    if context is not None and context.taskAttemptId() != _task:
        _task = context.taskAttemptId()
        give_back()


def parts(batches: Iterator[pa.RecordBatch], by: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows, each of about ``most`` bytes of text and one row at least."""
    begin_task()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(by)), 0).to_numpy(zero_copy_only=False)
        runs = (np.cumsum(sizes, dtype=np.int64) + 64 * np.arange(len(sizes))) // most
        cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), batch.num_rows]
        for at, end in zip(cuts, cuts[1:]):
            if end > at:
                yield batch.slice(at, end - at)


def slices(batches: Iterator[pa.RecordBatch], by: str = "text", most: int = SLICE_BYTES) -> Iterator[dict[str, list]]:
    """``parts`` as Python lists."""
    for part in parts(batches, by, most):
        yield part.to_pydict()


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names; a local session without one (tests) gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="llm-"))


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder: computed once, and kept if executors are lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8; bytes.split() cuts at exactly these six characters."""
    return text.encode().split() if text else []


def lowered(text: str | None) -> list[bytes]:
    """The same with A-Z in lower case; bytes.lower() changes no other character."""
    return text.encode().lower().split() if text else []


def held(bucket: int, of: int):
    """Whether crc32(doc_id as text) mod ``of`` is ``bucket``; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of == bucket


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def tokenizer_path(name: str) -> str:
    """Where the named public vocabulary lies on the machine that asks; every executor has the package."""
    folder = os.environ.get("PUBLIC_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def places_below(borders: list[int], key):
    """How many of the sorted borders are at or below a key: a binary search over a constant array."""
    if not borders:
        return F.lit(0)
    fixed = F.lit(borders).cast("array<long>")
    steps = F.lit([1 << b for b in reversed(range(len(borders).bit_length()))]).cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(fixed, at + step - 1) <= key, at + step).otherwise(at))
