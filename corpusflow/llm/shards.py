"""Operator 8: shards from sampled splitters, in DataFrame functions alone.

Keys are (hash of the text, doc_id), so equal texts lie side by side. A sample that draws each row with a chance in
proportion to its size gives splitters at its quantiles; rows fall into the ranges between them, and a range that
holds more than twice its share is subdivided by a hash of doc_id. The sizes of all ranges are then counted exactly,
and each row's place in the order of bytes is its range's offset plus the running sum inside the range. Forty equal
stretches of that order are the shards, so sizes differ by about one row.

Windows run inside ranges only, texts are never moved, and what reaches the driver are the splitters (RANGES) and the
forty first places.

Defined results: law ``bytes``; a null text has size 16 and checksum 0; a null doc_id sorts first; repeated rows get
slots of their own; with few or very large rows some shards are empty; an empty table gives an empty one; other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import stored

SHARDS = 40
OVERHEAD = 16
RANGES = 1_024
SAMPLES_A_RANGE = 16
OVERFULL = 2


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are at or below a row's key: a binary search over two constant arrays."""
    if not splitters:
        return F.lit(0)
    a = F.lit([s[0] for s in splitters]).cast("array<long>")
    b = F.lit([s[1] for s in splitters]).cast("array<long>")
    steps = F.lit([1 << i for i in reversed(range(len(splitters).bit_length()))]).cast("array<int>")

    def step(at, width):
        x, y = F.get(a, at + width - 1), F.get(b, at + width - 1)
        below = (x < F.col("k1")) | ((x == F.col("k1")) & (y <= F.col("k2")))
        return F.when(below, at + width).otherwise(at)
    return F.aggregate(steps, F.lit(0), step)


def splitters(rows: DataFrame, total: int, ranges: int) -> list[tuple[int, int]]:
    """Quantile keys of a size-weighted sample of about ranges * SAMPLES_A_RANGE draws."""
    draws = F.floor(F.col("size") * F.lit(ranges * SAMPLES_A_RANGE / max(total, 1))
                    + F.pmod(F.xxhash64("k1", "k2", F.lit(8)), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    sample = rows.select("k1", "k2", draws.alias("draws")).where("draws > 0").orderBy("k1", "k2").collect()
    found, seen, step = [], 0, max(1, sum(r.draws for r in sample) / ranges)
    for r in sample:
        before, seen = seen, seen + r.draws
        if int(before / step) < int(seen / step):
            found.append((r.k1, r.k2))
    return sorted(set(found))


def shards(docs: DataFrame, n: int = SHARDS, ranges: int = RANGES) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = stored(docs.select(
        "doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("k1"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k2")))
    total = rows.agg(F.sum("size").alias("n")).first().n or 0
    placed = rows.withColumn("range", _range_of(splitters(rows, total, ranges)))
    full = F.greatest(F.ceil(F.col("bytes") / F.lit(OVERFULL * max(total, 1) / ranges)), F.lit(1))
    pieces = placed.groupBy("range").agg(F.sum("size").alias("bytes")).select("range", full.alias("pieces"))
    # As many rows as there are ranges, whatever the table's size.
    cut = placed.join(F.broadcast(pieces), "range").withColumn(
        "piece", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).otherwise(0))
    sums = cut.groupBy("range", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("range", "piece", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_offset"),
                          F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_offset"))
    inside = Window.partitionBy("range", "piece").orderBy("k1", "k2", "size", "text_crc32")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("byte_offset") + F.sum("size").over(running) - F.col("size") / 2
    ordered = stored(cut.join(F.broadcast(offsets), ["range", "piece"]).select(
        "doc_id", "size", "text_crc32", (F.col("row_offset") + F.row_number().over(inside) - 1).alias("place"),
        F.least(F.floor(middle * n / F.lit(max(total, 1))), F.lit(n - 1)).cast("int").alias("shard")))
    first = ordered.groupBy("shard").agg(F.min("place").alias("first"))
    return ordered.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
