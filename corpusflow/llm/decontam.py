"""Operator 7: benchmark decontamination by character grams counted along diagonals.

A passage within an item's allowed edit distance k lies on k + 1 neighbouring diagonals (place in the text less place in
the item), and each edit breaks at most q of the item's q-grams. So the grams that text and item share are counted in
bins of k + 1 diagonals; where two neighbouring bins hold enough of them, the exact edit distance decides. There are
no anchors, no windows of words and no fixed slack: a stretch put in or cut out only moves the diagonal within k.

Enough is, for items under SHORT bytes, what any passage must share (nothing is lost). Longer items use 5-grams, of
which the similarity leaves no certain number; their bound is what RECALL of all passages share if exactly the allowed
part of the letters is changed at random places. Grams that many items have are left out, but for the rarest half of
an item's own; an item's bound follows the number that it keeps, and no other item's length plays a part.

Text is compared as words (lower case, outer punctuation off) with one blank between them, in UTF-8 bytes.

Items are a stated query set: they are sent to the tasks in blocks of at most BLOCK_ITEMS items and BLOCK_BYTES,
one pass over the documents for each block; nothing of the documents is shuffled.

Defined results: a null or empty text holds no passage; an item without words is in no document; repeated rows give
repeated hits; of several places the one with the least distance counts, then the first; equal items are all named.
``at_word`` is the word in which the passage begins (of equal distance, the shortest passage with the first end).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusflow.llm.common import lowered, parts, record, slices

SIMILARITY = 0.8       # of characters: 1 - distance / item length
RECALL = 0.95          # of passages at the similarity itself, letters changed at random places
SHORT = 40             # bytes; shorter items lose nothing
GRAM = 5
COMMON = 8             # grams with more places in the items than this are left out
BINS = 1 << 18         # counted at a time
BLOCK_ITEMS = 2_000
BLOCK_BYTES = 4 << 20
OUTER = b".,;:!?()[]{}<>\"'*#$%&|-_/"


def tokens(text: str | None) -> list[bytes]:
    return [w.strip(OUTER) or w for w in lowered(text)]


def fit(pattern: bytes, text: bytes, begins: bool = False) -> tuple[int, int]:
    """(least edit distance in bytes between the pattern and any part of the text, first end of such a part).

    By bit-parallel columns. With ``begins`` only parts at the text's begin count.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    full, top, first = (1 << m) - 1, 1 << (m - 1), int(begins)
    masks: dict[int, int] = {}
    for i, b in enumerate(pattern):
        masks[b] = masks.get(b, 0) | 1 << i
    plus, minus, score = full, 0, m
    best, end = score, 0
    for at, b in enumerate(text, 1):
        equal = masks.get(b, 0)
        x = equal | minus
        d = (((equal & plus) + plus) ^ plus) | x
        up = minus | (full & ~(d | plus))
        down = plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, at
        up, down = (up << 1) & full | first, (down << 1) & full
        plus = down | (full & ~(d | up))
        minus = up & d
    return best, end


def fit_distance(pattern: bytes, text: bytes) -> int:
    """Least edit distance (bytes) between the pattern and any part of the text."""
    return fit(pattern, text)[0]


def grams(text: bytes, q: int, bits: int) -> np.ndarray:
    """Hashes of ``bits`` bits of all ``q``-grams (at most 8 bytes)."""
    if len(text) < q:
        return np.empty(0, np.int64)
    eight = np.ndarray((len(text) - q + 1,), "<u8", text + bytes(8), 0, (1,))
    return ((eight << np.uint64(64 - 8 * q)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


class Seeds:
    """The grams of one length of some items, and how many of them a passage shares."""

    def __init__(self, which: list[int], items: list[bytes], allowed: list[int], q: int, similarity: float, recall: float):
        self.q, self.which = q, np.array(which, np.int64)
        self.length = np.array([len(items[i]) for i in which], np.int64)
        self.width = np.array([allowed[i] + 1 for i in which], np.int64)
        places = self.length - q + 1
        self.bits = int(16 * places.sum()).bit_length()
        code = np.concatenate([grams(items[i], q, self.bits) for i in which])
        item = np.repeat(np.arange(len(which)), places)
        offset = np.arange(len(code)) - np.repeat(np.cumsum(places) - places, places)
        if q == GRAM:
            many = np.bincount(code)[code]
            order = np.lexsort((many, item))  # rarest first within each item
            rank = np.empty(len(code), np.int64)
            rank[order] = offset
            keep = (many <= COMMON) | (2 * rank < places[item])
            code, item, offset = code[keep], item[keep], offset[keep]
        own = np.bincount(item, minlength=len(which))
        self.least = own - q * (self.width - 1)  # what no number of edits takes away
        if q == GRAM:
            one = similarity ** q
            spread = one * (1 + 2 * sum(similarity ** j for j in range(1, q)) - (2 * q - 1) * one)
            share = own * one - NormalDist().inv_cdf(recall) * np.sqrt(own * max(spread, 0.0))
            self.least = np.maximum(self.least, np.maximum(np.floor(share + 1e-9).astype(np.int64), 1))
        order = np.argsort(code, kind="stable")
        code, self.item, self.offset = code[order], item[order], offset[order]
        found, self.first, self.many = np.unique(code, return_index=True, return_counts=True)
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.table[found] = np.arange(len(found))

    def regions(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """(item, begin, end) of the places that share enough; all of a passage lies in one of them."""
        over = int((self.length + self.width).max()) + self.q
        step = max(int(BINS / (1 / self.width).sum()), 2 * over, 1 << 12)
        for at in range(0, max(len(text) - over, 0) + 1, step):
            yield from self._regions(text[at:at + step + over], at)

    def _regions(self, text: bytes, base: int) -> Iterator[tuple[int, int, int]]:
        slot = self.table[grams(text, self.q, self.bits)]
        place = np.flatnonzero(slot >= 0)
        slot = slot[place]
        many = self.many[slot]
        entry = np.repeat(self.first[slot] - np.cumsum(many) + many, many) + np.arange(many.sum())
        item = self.item[entry]
        # Diagonals from -length on; an empty bin divides the items.
        bins = (len(text) + self.length) // self.width + 2
        begin = np.cumsum(bins) - bins
        diagonal = np.repeat(place, many) - self.offset[entry] + self.length[item]
        held = np.bincount(begin[item] + diagonal // self.width[item], minlength=int(bins.sum()))
        two = held[:-1] + held[1:]
        enough = np.flatnonzero(two >= max(int(self.least.min()), 1))
        item = np.searchsorted(begin, enough, "right") - 1
        some = two[enough] >= self.least[item]
        enough, item = enough[some], item[some]
        if not len(enough):
            return
        # Neighbouring pairs of bins are one region.
        new = np.flatnonzero(np.concatenate([[True], (np.diff(enough) > 1) | (np.diff(item) > 0)]))
        last = np.append(new[1:], len(enough)) - 1
        item = item[new]
        low = (enough[new] - begin[item]) * self.width[item] - self.length[item]
        high = (enough[last] - begin[item] + 2) * self.width[item]  # the item's length is in the diagonal
        for i, a, b in zip(self.which[item].tolist(), (low + base).tolist(), (high + base).tolist()):
            yield i, max(a, base), b


class Items:
    """A block of items, ready for look-up by gram; equal texts are one."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float, recall: float = RECALL):
        named: dict[bytes, list[int]] = {}
        for i, text in rows:
            if found := tokens(text):
                named.setdefault(b" ".join(found), []).append(i)
        self.text, self.ids = list(named), list(named.values())
        self.allowed = [int((1 - similarity) * len(t) + 1e-9) for t in self.text]
        by: dict[int, list[int]] = {}
        for i, (t, k) in enumerate(zip(self.text, self.allowed)):
            q = GRAM if len(t) >= SHORT else next((q for q in (3, 2) if len(t) - q + 1 - q * k > 0), 1)
            by.setdefault(q, []).append(i)
        self.seeds = [Seeds(which, self.text, self.allowed, q, similarity, recall) for q, which in sorted(by.items())]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int64()),
                    ("similarity", pa.float64()), ("at_word", pa.int64())])
DDL = "doc_id long, item_id long, distance long, similarity double, at_word long"


def _search(docs: dict[str, list], items: Items) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, distance, first word) of the passages found in a few documents."""
    split = [b" ".join(tokens(t)) for t in docs["text"]]
    ends = np.cumsum([len(t) + 1 for t in split]).tolist()
    flat = b"\n".join(split)  # no word has a line end
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for seeds in items.seeds:
        for item, low, high in seeds.regions(flat):
            pattern, allowed = items.text[item], items.allowed[item]
            row = bisect_right(ends, low)
            while row < len(split) and (begin := ends[row] - len(split[row]) - 1) < high:
                a, b = max(low, begin), min(high, ends[row] - 1)
                if b - a >= len(pattern) - allowed:
                    distance, end = fit(pattern, flat[a:b])
                    if distance <= min(allowed, best.get((row, item), (allowed, 0))[0]):
                        back = flat[max(a, a + end - len(pattern) - allowed):a + end][::-1]
                        start = a + end - fit(pattern[::-1], back, begins=True)[1]
                        found = (distance, flat.count(b" ", begin, start + 1))
                        best[row, item] = min(found, best.get((row, item), found))
                row += 1
    for (row, item), (distance, at) in sorted(best.items()):
        yield row, item, distance, at


def blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """(item_id, text) in blocks of bounded size; one block at a time is on the driver."""
    block, size = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        block.append((row.item_id, row.text))
        size += len(row.text or "")
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    yield block


def passages(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row for each document and benchmark item whose text it holds within the similarity."""
    def one(block):
        ready = Items(block, similarity, recall)  # as large as the block

        def find(batches):
            for part in slices(batches):
                out = [(part["doc_id"][row], i, distance, 1 - distance / len(ready.text[item]), at)
                       for row, item, distance, at in _search(part, ready) for i in ready.ids[item]]
                if out:
                    yield record(SCHEMA, **dict(zip(SCHEMA.names, zip(*out))))
        return docs.select("doc_id", "text").mapInArrow(find, DDL)
    return reduce(DataFrame.unionByName, [one(b) for b in blocks(items)])


def without_passages(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY,
                     recall: float = RECALL) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns, in one pass and without a shuffle."""
    def one(rest, block):
        ready = Items(block, similarity, recall)

        def drop(batches):
            for part in parts(batches):
                keep = np.ones(part.num_rows, bool)
                for row, *_ in _search(part.select(["text"]).to_pydict(), ready):
                    keep[row] = False
                yield part.filter(pa.array(keep))
        return rest.mapInArrow(drop, rest.schema)
    return reduce(one, blocks(items), docs)
