"""Operator 13: near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has T coordinates. In round i every shingle of a document is hashed to one bin with a value in [i, i + 1);
a bin keeps its least value. From round T on the bin is i - T for all shingles, so 2T rounds fill every coordinate,
and a document stops at the round that fills its last one. One round fills the sketch of a text of some hundred
words, where plain min-hashing hashes each shingle T times, and the estimate is as concentrated as that one's.

Documents are joined in a fixed number of steps, on distinct sets of shingles only:

1. ``BANDS`` keys of ``ROWS`` coordinates a set. Two sets at the threshold itself (0.85) miss each other in all
   bands with probability (1 - 0.85^5)^25 = 4e-7.
2. A set's weight is the number of sets in all its bands, so among edited copies of a text the least edited ones
   weigh most. Each set is verified against the heaviest set of its bands, of several the one that it meets in most
   of them. That joins a group of near copies, however large, with one pair a member: a heavy set is the heaviest of
   every band that it is in.
3. Bands whose members are not all in one component by then are the rest. Two of their sets can only be similar
   enough if they share a shingle among the rarest n - ceil(n * similarity) + 1 of both; the pairs of different
   components that do, at places that still leave room for the overlap, are verified. Two sets that were verified
   against the same one also share at most what neither lacks of it and what both have beside it, which leaves few
   pairs of one group. So no link between sets that met is lost, and sets of one template, which share its common
   shingles only, cost nothing.

Verification counts the intersection of the full sets (64-bit hashes of the shingles; two of n different ones are
equal by chance with probability n^2 / 2^65).

Defined results: a null, empty or blank text has no shingles, is linked with nothing and is its own component; fewer
words than a shingle: the whole sequence is the only one; repeated rows give repeated results; rows that share a
doc_id but not the text are documents of their own; a null doc_id names a component only if all its rows are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import SLICE_BYTES, lowered, mix, slices, stored
from corpusflow.llm.components import components

WIDTH = 5
SIMILARITY = 85  # per cent, Jaccard
BANDS, ROWS = 25, 5
T = BANDS * ROWS
NONE = np.iinfo(np.uint64).max
SALTS = mix(np.arange(1, 2 * T + 1, dtype=np.uint64))
AT_ONCE = 1 << 18  # shingles hashed at a time
TOLD = 32  # rare shingles that a set is known by when pairs are made


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``width`` words; a shorter text is one run."""
    found = lowered(text)
    if not found:
        return np.empty(0, np.uint64)
    joined = memoryview(b" ".join(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    width = min(width, len(found))
    starts = [0, *(ends[:len(found) - width] + 1).tolist()]
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e]) for s, e in zip(starts, ends[width - 1:].tolist())),
                                 np.uint64, len(starts)))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of T coordinates for each of the sets, none of which may be empty."""
    out = np.full(len(sets) * T, NONE, np.uint64)
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for i in range(2 * T):
        if not len(flat):
            break
        for at in range(0, len(flat), AT_ONCE):
            h = mix(flat[at:at + AT_ONCE] ^ SALTS[i])
            bins = (h >> np.uint64(40)) * np.uint64(T) >> np.uint64(24) if i < T else np.uint64(i - T)
            places = own[at:at + AT_ONCE] * T + np.asarray(bins).astype(np.int64)
            np.minimum.at(out, places, np.uint64(i << 40) | h & np.uint64((1 << 40) - 1))
        open_ = (out.reshape(-1, T) == NONE).any(1)[own]
        flat, own = flat[open_], own[open_]
    return out.reshape(-1, T)


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """For each sketch a signed key for each band of ``rows`` coordinates."""
    n = sketch.shape[1] // rows
    bands = sketch[:, :n * rows].reshape(len(sketch), n, rows)
    keys = np.broadcast_to(SALTS[:bands.shape[1]], bands.shape[:2]).copy()
    for r in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, r])
    return keys.view(np.int64)


def sketched(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, mark, n_shingles, whole, keys): mark tells rows of one doc_id apart, whole names the set."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()),
                        ("whole", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def compute(batches):
        for part in slices(batches, most=SLICE_BYTES // 2):
            sets = [shingles(t, width) for t in part["text"]]
            keys = iter(band_keys(sketches([s for s in sets if len(s)])))
            yield pa.RecordBatch.from_pydict({
                "doc_id": part["doc_id"], "mark": part["mark"], "n_shingles": [len(s) for s in sets],
                "whole": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "keys": [next(keys) if len(s) else None for s in sets]}, schema=schema)
    return (docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("mark"))
            .mapInArrow(compute, "doc_id long, mark long, n_shingles long, whole binary, keys array<long>"))


def _hashed(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(v, n, h): the shingle hashes of the wanted sets (v, doc_id, mark), from one text each."""
    schema = pa.schema([("v", pa.int64()), ("n", pa.int64()), ("h", pa.list_(pa.int64()))])

    def compute(batches):
        for part in slices(batches, most=SLICE_BYTES // 2):
            sets = [shingles(t, width).view(np.int64) for t in part["text"]]
            yield pa.RecordBatch.from_pydict({"v": part["v"], "n": [len(s) for s in sets], "h": sets}, schema=schema)
    known = F.coalesce("doc_id", F.lit(-1)).alias("i")  # a null doc_id has a mark of its own
    # Repeated rows are combined before the exchange, and meet their set in the partition they lie in.
    texts = docs.select(known, F.xxhash64("doc_id", "text").alias("mark"), "text").groupBy("i", "mark").agg(F.any_value("text").alias("text"))
    found = texts.join(wanted.select("v", known, "mark"), ["i", "mark"])
    return stored(found.select("v", "text").mapInArrow(compute, "v long, n long, h array<long>"))


def _alike(pairs: DataFrame, hashed: DataFrame, similarity: int) -> DataFrame:
    """(a, b, na, shared, alike): whether the sets of a pair are similar enough. The set that many pairs share, a, is met last."""
    left = hashed.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("h").alias("ha"))
    right = hashed.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("h").alias("hb"))
    return (pairs.join(right, "b").join(left, "a")
            .withColumn("shared", F.size(F.array_intersect("ha", "hb")))
            .select("a", "b", "na", "shared", F.expr(f"100 * shared >= {similarity} * (na + nb - shared)").alias("alike")))


def _rarest(rest: DataFrame, similarity: int) -> DataFrame:
    """(v, component, n, h, at, earlier, centre, nc, lacks, beside): the rarest shingles of each set, of which similar sets share one.

    Shingles that no other set has come first in that order and meet nobody, so only their number counts. ``earlier``
    are the ones before, of the first ``TOLD``. A set lacks so many of its centre's ``nc`` shingles, and has so many
    beside them that other sets have as well: sets of one centre but different components have that centre among the
    rest, so what no other set has is not the centre's.
    """
    each = rest.select("v", F.explode("h").alias("h"))
    common = stored(each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"))
    found = each.join(common, "h").groupBy("v").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("found"))
    sets = (rest.drop("h").join(found, "v").withColumn("alone", F.col("n") - F.size("found"))
            .withColumn("places", F.expr(f"cast(n - (n * {similarity} + 99) div 100 + 1 - alone as int)")).where("places > 0"))
    kept = ["v", "component", "n", "centre", "nc", "lacks", F.expr("greatest(beside - alone, 0)").alias("beside")]
    sets = sets.select(*kept, "alone", F.expr("slice(found, 1, greatest(places, 0)).h").alias("hs"))
    return (sets.select("*", F.posexplode("hs").alias("i", "h"))
            .select("v", "component", "n", "h", (F.col("i") + F.col("alone")).alias("at"),
                    F.slice("hs", F.lit(1), F.least("i", F.lit(TOLD))).alias("earlier"), "centre", "nc", "lacks", "beside"))


def _rest_pairs(rest: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) of sets of different components that may be similar enough, by their rarest shingles."""
    near = stored(_rarest(rest, similarity))
    enough = f"100 * least(x.n, y.n) >= {similarity} * greatest(x.n, y.n)"
    room = f"{100 + similarity} * least(x.n - x.at, y.n - y.at) >= {similarity} * (x.n + y.n)"
    most = "x.nc - greatest(x.lacks, y.lacks) + least(x.beside, y.beside)"
    known = f"(x.centre <> y.centre or {100 + similarity} * ({most}) >= {similarity} * (x.n + y.n))"
    # A pair is made at the first shingle it shares; pairs that share none of the first TOLD may be made more than once.
    first = "not arrays_overlap(x.earlier, y.earlier)"
    return (near.alias("x").join(near.alias("y"), F.expr(
        f"x.h = y.h and x.v < y.v and x.component <> y.component and {enough} and {room} and {known} and {first}"))
        .select(F.col("x.v").alias("a"), F.col("y.v").alias("b")).distinct())


def _met(sets: DataFrame) -> DataFrame:
    """(key, v, n_shingles, a, na): the bands that several sets have, and the heaviest set of each."""
    filed = sets.select("v", "n_shingles", F.explode("keys").alias("key"))
    common = stored(filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    # Sets of one weight have an order as well, the same in all bands.
    weighed = stored(filed.join(common, "key").groupBy("v").agg(
        F.any_value("n_shingles").alias("n_shingles"), F.sum("n").alias("n"), F.collect_list("key").alias("keys"))
        .select("v", "n_shingles", F.expr("shiftleft(n, 20) + (xxhash64(v) & 1048575)").alias("weight"), "keys"))
    filed = weighed.select("v", "n_shingles", "weight", F.explode("keys").alias("key"))
    heaviest = stored(filed.groupBy("key").agg(F.max_by("v", "weight").alias("a"), F.max_by("n_shingles", "weight").alias("na")))
    return filed.select("key", "v", "n_shingles").join(heaviest, "key")


def _centres(met: DataFrame) -> DataFrame:
    """(a, b): for each set b of (a, b) rows the a that it meets in most bands, the least of several."""
    found = met.groupBy("b").agg(F.collect_list("a").alias("all"))
    counted = F.transform(F.array_distinct("all"), lambda a: F.struct(
        F.size(F.filter("all", lambda x: x == a)).alias("bands"), (-a).alias("a")))
    return found.select((-F.array_max(counted)["a"]).alias("a"), "b")


def set_components(docs: DataFrame, sets: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """(v, component) for all sets that have a similar one; ``sets`` is (v, n_shingles, doc_id, mark, keys)."""
    met = stored(_met(sets))
    hashed = _hashed(docs, met.select("v").distinct().join(sets.select("v", "doc_id", "mark"), "v"), width)
    pairs = met.where("v <> a").where(f"100 * least(na, n_shingles) >= {similarity} * greatest(na, n_shingles)")
    tried = stored(_alike(_centres(pairs.select("a", F.col("v").alias("b"))), hashed, similarity))
    first = stored(components(tried.where("alike"), "a", "b"))
    named = met.select("key", "v").join(first, "v", "left").select("key", "v", F.coalesce("component", "v").alias("component"))
    mixed = (named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
             .where("low <> high").select("key"))
    rest = named.join(mixed, "key", "left_semi").select("v", "component").distinct().join(hashed, "v")
    # A set that was not tried against another one is its own centre.
    rest = stored(rest.join(tried.select(F.col("b").alias("v"), "a", "na", "shared"), "v", "left").select(
        "v", "component", "n", "h", F.coalesce("a", "v").alias("centre"), F.coalesce("na", "n").alias("nc"),
        F.expr("coalesce(na - shared, 0)").alias("lacks"), F.expr("coalesce(n - shared, 0)").alias("beside")))
    more = _alike(stored(_rest_pairs(rest, similarity)), hashed, similarity).where("alike").select("a", "b")
    # The stars that are there already, and the links between them.
    return components(first.select(F.col("component").alias("a"), F.col("v").alias("b")).unionByName(more), "a", "b")


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; similarity is in per cent."""
    marked = stored(sketched(docs, width))
    # A set's number is fixed by storing it.
    sets = stored(marked.where("whole is not null").groupBy("whole").agg(
        F.min(F.struct("doc_id", "mark")).alias("r"), F.min("doc_id").alias("least"),
        F.any_value("n_shingles").alias("n_shingles"), F.any_value("keys").alias("keys"))
        .select(F.monotonically_increasing_id().alias("v"), "whole", "n_shingles", "r.doc_id", "r.mark", "least", "keys"))
    linked = stored(set_components(docs, sets, width, similarity))
    least = linked.join(sets.select("v", "least"), "v").groupBy("component").agg(F.min("least").alias("low"))
    named = sets.select("v", "whole", "least").join(linked.join(least, "component").select("v", "low"), "v", "left")
    named = stored(named.select("whole", F.coalesce("low", "least").alias("low")))
    return (marked.select("doc_id", "n_shingles", "whole").join(named, "whole", "left")
            .select("doc_id", "n_shingles", F.when(F.col("whole").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id")))


def copies(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """The doc_ids that have a near copy of a smaller doc_id, over links."""
    return near_duplicates(docs, width, similarity).where("doc_id > component_id").select("doc_id").distinct()


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query. A document without a doc_id is kept if no document of its component has one."""
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id",
                                        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
