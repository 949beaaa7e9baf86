"""Operator 6: document fingerprints from prefix polynomial hashes.

``S[i] = sum over j < i of (c_j + 1) B^j mod p`` is kept for every prefix of a text. The difference of two entries,
shifted by a power of 1/B, is the hash of the span between them, so any two spans are compared at once, and the
longest common extension of two places is found by binary search over its length.

A fingerprint holds the hash of the whole text (two bases) and its 64 least span hashes over all spans of 16 code
points. The likeness of two fingerprints is 2J / (1 + J), the share of spans in common, with J estimated from the
least 64 of both; texts of up to 64 spans are compared exactly.

Defined results: a null text counts as empty; two empty texts are alike (1), an empty and another are not (0); texts
shorter than a span are one span; rows are ordered by doc_id, null last, repeated ids by a hash of the text; of one
row the next row is the row itself; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import places_below, record, slices
from corpusflow.llm.runs import partitions

P = (1 << 31) - 1
BASES = (1_000_003, 998_244_353)
SPAN = 16
KEPT = 64


def _fold(x: np.ndarray) -> np.ndarray:
    """x mod p for x below 2^62."""
    x = (x & np.uint64(P)) + (x >> np.uint64(31))
    x = (x & np.uint64(P)) + (x >> np.uint64(31))
    return np.where(x >= P, x - np.uint64(P), x)


class Powers:
    """Powers of a base and of its inverse, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, P)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.r_[self.up, _fold(self.up * np.uint64(pow(self.base, size, P)))]
            self.down = np.r_[self.down, _fold(self.down * np.uint64(pow(self.inverse, size, P)))]


_powers = [Powers(b) for b in BASES]


class Prefixes:
    """Prefix hashes of one text (code points), for both bases."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.sums = []
        c = points.astype(np.uint64) + np.uint64(1)
        for powers in _powers:
            powers.to(self.n + 1)
            terms = c * powers.up[:self.n]
            terms = (terms & np.uint64(P)) + (terms >> np.uint64(31))
            self.sums.append(np.r_[np.uint64(0), _fold(np.cumsum(terms))])

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """Hash of the code points from start to end, whatever their place."""
        return tuple((int(s[end]) - int(s[start])) % P * int(p.down[start]) % P for s, p in zip(self.sums, _powers))

    def whole(self) -> str:
        return "".join(f"{h:08x}" for h in self.span(0, self.n))

    def spans(self, width: int) -> np.ndarray:
        """Scrambled hashes of all spans of one width (first base)."""
        width = min(width, self.n)
        if not width:
            return np.empty(0, np.uint64)
        s, last = self.sums[0], self.n - width + 1
        h = _fold((s[width:] + np.uint64(P) - s[:last]) * _powers[0].down[:last])
        h = h * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)

    def sketch(self) -> np.ndarray:
        """The KEPT least distinct span hashes in order."""
        h = self.spans(SPAN)
        if len(h) > 8 * KEPT:
            few = h[h < np.uint64((1 << 32) * 3 * KEPT // len(h))]
            found = np.unique(few)
            if len(found) >= KEPT:
                return found[:KEPT]
        return np.unique(h)[:KEPT]

    def text(self) -> str:
        return f"{self.whole()}-{self.sketch().astype('>u4').tobytes().hex()}"


def points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), np.uint32)


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """How many code points from place i of a and place j of b on are equal, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(i, i + middle) == b.span(j, j + middle):
            low = middle
        else:
            high = middle - 1
    return low


def likeness(a: str, b: str) -> float:
    """0 to 1, from the fingerprints alone."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.split("-")[1]), ">u4") for f in (a, b))
    if not len(x) or not len(y):
        return 0.0
    union = np.union1d(x, y)
    if len(x) == KEPT or len(y) == KEPT:
        union = union[:KEPT]
    shared = np.isin(union, x, assume_unique=True) & np.isin(union, y, assume_unique=True)
    j = shared.sum() / len(union)
    return float(2 * j / (1 + j))


def in_order(docs: DataFrame) -> DataFrame:
    """Every row beside the row that follows it by descending doc_id, in one exchange of the texts.

    Ids alone fix quantile borders and the greatest id of each range. That row is also sent, as a copy, to the
    range above, where it ends the order; the very first row ends the lowest range. Borders and heads are as many
    as there are ranges.
    """
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"))
    n = 4 * partitions(docs)
    borders = keyed.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 100 * n).alias("q")).first().q or []
    borders = sorted(set(borders))
    placed = keyed.withColumn("range", places_below(borders, F.col("key")))
    heads = {r["range"]: r.head for r in placed.groupBy("range").agg(F.max("key").alias("head")).collect()}
    held = sorted(heads)
    head = F.lit([heads.get(i) for i in range(len(borders) + 1)]).cast("array<long>")
    above = dict(zip(held, [*held[1:], *held[:1]]))
    target = F.lit([above.get(i) for i in range(len(borders) + 1)]).cast("array<int>")
    own = F.struct(F.col("range"), F.lit(False).alias("copy"))
    sent = F.when(F.col("key") == F.get(head, F.col("range")),
                  F.array(own, F.struct(F.get(target, F.col("range")).alias("range"), F.lit(True).alias("copy")))
                  ).otherwise(F.array(own))
    return (placed.select("doc_id", "text", "key", F.xxhash64("text").alias("tie"), F.explode(sent).alias("to"))
            .select("doc_id", "text", "key", "tie", "to.*")
            .repartition(partitions(docs), "range")
            .sortWithinPartitions("range", "copy", F.desc("key"), "tie")
            .select("doc_id", "text", "range", "copy"))


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ("common_edited", pa.int64()), ("common_next", pa.int64())])
DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double, common_edited long, common_next long")


def _judge(doc_id, text, own: Prefixes, mark: str, after_text, after: Prefixes, after_mark: str) -> tuple:
    half = own.n // 2
    edited = text[:own.n - half] + after_text[:half]
    other = Prefixes(points(edited))
    edited_mark = other.text()
    return (doc_id, own.n, hashlib.sha256(edited.encode()).hexdigest(), mark, edited_mark, likeness(mark, edited_mark),
            likeness(mark, after_mark), common_extension(own, 0, other, 0), common_extension(own, 0, after, 0))


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of the query; ``common_*`` are the longest common beginnings with the edited and the next text."""
    def compute(batches):
        waiting = None  # the last row seen, whose next row is not known yet
        for part in slices(batches):
            out = []
            for doc_id, text, range_, copy in zip(part["doc_id"], part["text"], part["range"], part["copy"]):
                text = text or ""
                if waiting is None and copy:
                    continue  # a further copy after the range's end
                prefixes = Prefixes(points(text))
                row = (range_, doc_id, text, prefixes, prefixes.text())
                if waiting is not None:
                    if waiting[0] != range_:
                        raise ValueError(f"range {waiting[0]} has no end")
                    out.append(_judge(*waiting[1:], *row[2:]))
                waiting = None if copy else row
            if out:
                yield record(SCHEMA, **dict(zip(SCHEMA.names, zip(*out))))
        if waiting is not None:
            raise ValueError(f"range {waiting[0]} has no end")
    return in_order(docs).mapInArrow(compute, DDL)
