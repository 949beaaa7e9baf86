"""Operator 2: SimHash near-duplicates by meeting in the middle of Hamming balls.

Two fingerprints that differ in at most 2 bits have a value in common within 1 bit of both. So every distinct fingerprint sends all variants within half the radius, variants
are grouped, and what meets there is verified. Among distinct fingerprints a variant is met by 1 + 64 at most,
however many documents share them; a group therefore keeps the flipped bits as one mask.

Defined results: a null, empty or blank text has fingerprint zero and links like any other; repeated rows give
repeated results and count as one document; a null doc_id is never a component's name unless all are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import SLICE_BYTES, lowered, record, slices, stored
from corpusflow.llm.components import components
from corpusflow.llm.runs import partitions

SEED = 42
BITS = 64
RADIUS = 2  # met by flips of one bit on both sides


def fingerprint(found: list[bytes], width: int) -> int:
    """Majority bits of the XXH64 values of all shingles of ``width`` words."""
    if not found:
        return 0
    if len(found) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
        return int(hashes[0])
    joined = memoryview(b" ".join(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = [0, *ends[:-1].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, (ends[width - 1:] - 1).tolist())),
                         np.uint64, len(found) - width + 1)
    set_in = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_in += bits.sum(0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def compute(batches):
        for part in slices(batches, most=SLICE_BYTES // 2):
            found = np.array([fingerprint(lowered(t), width) for t in part["text"]], np.uint64)
            yield record(schema, doc_id=part["doc_id"], fp=found.view(np.int64))
    return docs.select("doc_id", "text").mapInArrow(compute, "doc_id long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that join all fingerprints within RADIUS bits.

    A variant that several fingerprints reach names them by the flipped bits, kept as one mask. All that meet at a
    variant are within RADIUS bits of each other, so a star around their least joins what the single links join;
    every edge is verified by counting its differing bits.
    """
    # A few fingerprints make many variants: dealt to all partitions first, so that no task holds a large share of them.
    dealt = distinct.select("fp").repartition(partitions(distinct), "fp")
    sent = (dealt.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS))).alias("bit"))
            .selectExpr(f"case when bit = {BITS} then fp else fp ^ shiftleft(1L, bit) end as variant",
                        f"case when bit = {BITS} then 0L else shiftleft(1L, bit) end as mask",
                        f"case when bit = {BITS} then 1 else 0 end as own"))
    met = (sent.groupBy("variant").agg(F.bit_or("mask").alias("mask"), F.max("own").alias("own"))
           .where("bit_count(mask) + own > 1"))
    flipped = (f"transform(filter(sequence(0, {BITS - 1}), i -> mask & shiftleft(1L, i) <> 0), "
               "i -> variant ^ shiftleft(1L, i))")
    members = met.selectExpr(f"concat({flipped}, case when own = 1 then array(variant) else array() end) as m")
    stars = members.selectExpr("array_min(m) as a", "explode(m) as b")
    return stars.where("a <> b").distinct().where(f"bit_count(a ^ b) <= {RADIUS}")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    marked = stored(fingerprints(docs, width))
    firsts = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    parts = components(links(firsts.select("fp")), "a", "b")
    linked = stored(firsts.join(parts.withColumnRenamed("v", "fp"), "fp"))
    least = stored(linked.groupBy("component").agg(F.min("first").alias("least")))
    named = stored(firsts.join(linked.join(least, "component").select("fp", "least"), "fp", "left")
                   .select("fp", F.coalesce("least", "first").alias("component_id")))
    return marked.join(named, "fp")


def keep_one(docs: DataFrame, width: int = 3) -> DataFrame:
    """One document of each group: the one with the smallest doc_id. Rows that repeat it are one document.

    Rows without a doc_id cannot be named and stay.
    """
    found = near_duplicates(docs, width)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    # The row travels as one struct, so that no column of it can clash with those of the join.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("of"), F.xxhash64("text").alias("mark"))
    return (rows.join(kept, F.col("of") == F.col("id"), "left").where("id is not null or of is null")
            .dropDuplicates(["of", "mark"]).select("row.*"))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query."""
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
