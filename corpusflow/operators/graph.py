"""Pair graphs inside documents: the keep-first rule, and connected components for documents of very many pairs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.settings import checkpointed

# A document of more pairs than this is dealt to tasks by its connected components.
FOLD_PAIRS = 500_000


def _ends(edges: DataFrame, part: list[str]) -> DataFrame:
    return edges.select(*part, F.explode(F.array(F.struct(F.col("first").alias("v"), F.col("second").alias("n")),
                                                 F.struct(F.col("second").alias("v"), F.col("first").alias("n")))).alias("e")).select(*part, "e.*")


def connected(edges: DataFrame, part: list[str]) -> DataFrame:
    """(…part, v, component): the least node reachable; edges are (…part, first, second), first < second.

    Every round links all neighbours of a node to its least one, the larger ones first and then the smaller ones; the
    depth of the trees so formed is halved at least, so the rounds follow the logarithm of the longest chain.
    """
    now, seen = checkpointed(edges.select(*part, "first", "second").distinct()), None
    while True:
        for larger in (True, False):
            around = _ends(now, part)
            near = around if larger else around.where("n < v")
            least = checkpointed(near.groupBy(*part, "v").agg(F.min("n").alias("m")).withColumn("m", F.least("v", "m")))
            linked = near.join(least, [*part, "v"])
            out = linked.where("n > v" if larger else "n <> m").select(*part, F.col("m").alias("first"), F.col("n").alias("second"))
            if not larger:
                out = out.unionByName(least.select(*part, F.col("m").alias("first"), F.col("v").alias("second")))
            now = out.where("first <> second").distinct()
        now = checkpointed(now)
        digest = now.agg(F.count("*"), F.sum(F.xxhash64(*now.columns).cast("decimal(38,0)"))).first()
        if digest == seen:
            stars = now.select(*part, F.col("first").alias("component"), F.col("second").alias("v"))
            return stars.unionByName(now.select(*part, F.col("first").alias("component"), F.col("first").alias("v")).distinct())
        seen = digest


def dropped_by_first(edges: DataFrame) -> DataFrame:
    """(doc_id, ord) of the items that go when an item goes for an earlier kept one; edges are (doc_id, first, second).

    One pass: pairs come document by document, in the order of their later item, so that the fate of every earlier
    item is known. A task holds the dropped items of the document it is at, not its pairs. The components of one
    document do not depend on each other, so a document of very many pairs goes to the tasks in components.
    """
    edges = checkpointed(edges.distinct())
    large = checkpointed(edges.groupBy("doc_id").count().where(F.col("count") > FOLD_PAIRS).select("doc_id"))
    dealt = edges.withColumn("component", F.lit(0).cast("long"))
    if not large.isEmpty():
        split = edges.join(large, "doc_id", "left_semi")
        named = connected(split, ["doc_id"]).select("doc_id", F.col("v").alias("first"), "component")
        dealt = edges.join(large, "doc_id", "left_anti").withColumn("component", F.lit(0).cast("long")).unionByName(
            split.join(named, ["doc_id", "first"]).select("doc_id", "first", "second", "component"))
    kind = edges.schema["doc_id"].dataType.simpleString()
    ordered = dealt.repartition("doc_id", "component").sortWithinPartitions("doc_id", "component", "second", "first")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, gone = None, set()
        for batch in batches:
            docs, ords = [], []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "component", "first", "second"))
            for doc, component, first, second in zip(*columns):
                if (doc, component) != at:
                    at, gone = (doc, component), set()
                if first not in gone and second not in gone:
                    gone.add(second)
                    docs.append(doc)
                    ords.append(second)
            yield pa.RecordBatch.from_arrays([pa.array(docs, batch.column("doc_id").type), pa.array(ords, pa.int64())], names=["doc_id", "ord"])
    return ordered.select("doc_id", "component", F.col("first").cast("long").alias("first"), F.col("second").cast("long").alias("second")
                          ).mapInArrow(fold, f"doc_id {kind}, ord long")
