"""Documents folded one after the other: their rows are exchanged once, and a task holds one document at a time.

Joins between the items of a document exchange them again for every step, and stored rows in between are not compressed.
A document that a task can hold needs neither: its rows come together in the order of ``ord`` and are worked on there.
Documents with more text than that, and rows without a document, are left to the joins of the operator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusflow.settings import checkpointed

# Characters of a document that a task holds.
FOLD_CHARS = 4_000_000
# Rows, and characters of text, that a task gives back at once.
BATCH_ROWS, BATCH_CHARS = 2_000, 2_000_000


def dealt(rows: DataFrame, text: str, sizes: DataFrame | None = None, most: int = FOLD_CHARS) -> tuple[DataFrame, DataFrame | None]:
    """Rows (doc_id, …) of documents of up to ``most`` characters, and all others, or None if there are none.

    The lengths are those of the column ``text``, which takes a pass over the rows; where that is dear, ``sizes`` is
    (doc_id, chars), the length of what the rows were taken from.
    """
    if sizes is None:
        sizes = rows.select("doc_id", F.length(text).alias("chars"))
    per = sizes.groupBy("doc_id").agg(F.sum(F.col("chars").cast("long")).alias("chars"))
    large = checkpointed(per.where((F.col("chars") > most) | F.col("doc_id").isNull()).select("doc_id"))
    if large.isEmpty():
        return rows, None
    large = F.broadcast(large.where(F.col("doc_id").isNotNull()))  # ids of documents that are long, so they are few
    named = rows.where(F.col("doc_id").isNotNull())
    many = named.join(large, "doc_id", "left_semi").unionByName(rows.where(F.col("doc_id").isNull()))
    return named.join(large, "doc_id", "left_anti"), many


def together(rows: DataFrame, *then: str) -> DataFrame:
    """Rows (doc_id, ord, …) document by document, in the order of ord and of the columns ``then``."""
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "ord", *then)


def folded(rows: DataFrame, fold: Callable[[list[tuple]], Iterator[tuple]], schema: T.StructType, cost: Callable[[tuple], int]) -> DataFrame:
    """``fold`` of the rows of each document; rows come from ``together``, doc_id is their first column and that of the result.

    ``fold`` takes the other columns of all rows of a document and yields the other columns of the result; ``cost`` is
    the characters of a row of the result.
    """
    arrow = to_arrow_schema(schema)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, held = None, []
        for part in batches:
            for doc, *row in zip(*(c.to_pylist() for c in part.columns)):
                if doc != at:
                    yield at, held
                    at, held = doc, []
                held.append(row)
        yield at, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars = [], 0
        for doc, held in documents(batches):
            for row in fold(held) if held else ():
                out.append((doc, *row))
                chars += cost(row)
                if len(out) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield batch(out)
                    out, chars = [], 0
        if out:
            yield batch(out)

    return rows.mapInArrow(run, schema)


def joined(words: Column) -> Column:
    """Words without blanks in one text: cheaper to hand over than an array of them."""
    return F.array_join(words, " ")
