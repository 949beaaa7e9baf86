"""Runs of documents that ask the whole corpus about what they contain, and are answered run by run.

Where every document needs a fact about each of its words or windows (how often it occurs, which document has
it first), one shuffled row per occurrence costs more than the text itself. Here documents are packed into
runs of a few megabytes. A run asks about each distinct value once, its questions are dealt to buckets by the
value's hash, a bucket answers from all questions that reached it, and answers go back by run. A value that
occurs in a third of all documents is asked once a run, so no bucket gets more of it than there are runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from zstandard import compress, decompress

from corpusflow.llm.common import RUN_BYTES, begin_task, slices, stored

BUCKETS_A_PARTITION = 8  # several, so that partitions get even shares


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pack(docs: DataFrame, schema: pa.Schema) -> DataFrame:
    """(run, blob): the schema's columns of about RUN_BYTES of text in one compressed value.

    Stored, and dealt by run, so that later joins by run move the answers and not the texts.
    """
    def blobs(batches):
        first = TaskContext.get().partitionId() << 32
        for n, part in enumerate(slices(batches, most=RUN_BYTES)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(pa.RecordBatch.from_arrays([pa.array(part[f.name], f.type) for f in schema], schema=schema))
            yield pa.RecordBatch.from_arrays([pa.array([first + n], pa.int64()), pa.array([sink.getvalue().to_pybytes()])],
                                             names=["run", "blob"])
    packed = docs.select(*schema.names).mapInArrow(blobs, "run long, blob binary")
    return stored(packed)


def unpack(blob: bytes) -> dict[str, list]:
    begin_task()
    return pa.ipc.open_stream(blob).read_all().to_pydict()


def dealt(hashes: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) of sorted hash values; a bucket holds a range of them."""
    edges = np.array([(b << 64) // n for b in range(1, n)], np.uint64)
    cuts = [0, *np.searchsorted(hashes, edges).tolist(), len(hashes)]
    for b, (at, end) in enumerate(zip(cuts, cuts[1:])):
        if end > at:
            yield b, np.arange(at, end)


ASK = "run long, bucket int, keys binary, facts binary"
ASKED = pa.schema([("run", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("facts", pa.binary())])
ANSWER = "run long, bucket int, keys binary, facts binary"
ANSWERED = ASKED


def ask(blobs: DataFrame, questions: Callable[[dict[str, list], pa.Table | None], tuple],
        answers: DataFrame | None = None, each: int = BUCKETS_A_PARTITION, send_keys: bool = True) -> DataFrame:
    """Rows of ASK. ``questions(documents, answers)`` gives sorted distinct hashes, and their facts: an array,
    or a function from places to bytes. Without ``send_keys`` the facts tell all, and the hashes only deal them."""
    n = each * partitions(blobs)

    def rows(run: int, blob: bytes, known: pa.Table | None) -> list[tuple]:
        keys, facts = questions(unpack(blob), known)
        told = facts if callable(facts) else lambda at: b"" if facts is None else facts[at].tobytes()
        return [(run, b, keys[at].tobytes() if send_keys else b"", compress(told(at), 1)) for b, at in dealt(keys, n)]

    def table(found: list[tuple]) -> pa.Table:
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), ASKED)] if found
                                    else [pa.array([], f.type) for f in ASKED], schema=ASKED)
    if answers is None:
        def alone(batches):
            for batch in batches:
                for run, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield from table(rows(run, blob.as_py(), None)).to_batches()
        return blobs.mapInArrow(alone, ASK)

    def both(left, right):
        return table([r for run, blob in zip(left["run"].to_pylist(), left["blob"]) for r in rows(run, blob.as_py(), right)])
    return blobs.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(both, ASK)


def answer(asked: DataFrame, reply: Callable[[list[int], list[np.ndarray], list[bytes]], Iterator[tuple]]) -> DataFrame:
    """Rows of ANSWER. ``reply(runs, keys, facts)`` sees all questions of one bucket, one entry for each run,
    and yields (run, keys, facts)."""
    def one(group: pa.Table) -> pa.Table:
        begin_task()
        bucket = group["bucket"][0].as_py()
        keys = [np.frombuffer(k.as_py(), np.uint64) for k in group["keys"]]
        found = [(run, bucket, key, compress(fact, 1))
                 for run, key, fact in reply(group["run"].to_pylist(), keys, facts_of(group))]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), ANSWERED)] if found
                                    else [pa.array([], f.type) for f in ANSWERED], schema=ANSWERED)
    return asked.groupBy("bucket").applyInArrow(one, ANSWER)


def finish(blobs: DataFrame, answers: DataFrame, result: Callable[[dict[str, list], pa.Table], dict[str, list]],
           schema: pa.Schema, ddl: str) -> DataFrame:
    """Result rows of every run's documents, from the answers to its questions."""
    def both(left, right):
        parts = [result(unpack(blob.as_py()), right) for blob in left["blob"]]
        return pa.concat_tables([pa.Table.from_pydict(p, schema=schema) for p in parts] or [schema.empty_table()])
    return blobs.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(both, ddl)


def facts_of(table: pa.Table) -> list[bytes]:
    return [decompress(f.as_py()) for f in table["facts"]]


def keys_of(known: pa.Table) -> np.ndarray:
    """The keys of all answers to one run, in one array."""
    return np.concatenate([np.frombuffer(k.as_py(), np.uint64) for k in known["keys"]] or [np.empty(0, np.uint64)])


def values_of(known: pa.Table, kind) -> np.ndarray:
    """The facts of all answers to one run, in the order of ``keys_of``."""
    return np.concatenate([np.frombuffer(f, kind) for f in facts_of(known)] or [np.empty(0, kind)])
