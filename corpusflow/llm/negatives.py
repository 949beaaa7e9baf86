"""Operator 12: hard negatives, by bounds along a spanning tree of the anchors.

Anchors are linked by a minimum spanning tree of their distances. The score of a row x with an anchor c whose parent
is p lies within |c - p| * |x| of its score with p; a row whose interval stays below the best found so far, or
outside all windows asked for, is not scored, and hands its interval, widened by the next edge, to the anchor's
children. Scored rows hand on their exact score.

Anchors are a fixed share of all rows, so they are a query set against all rows and go in blocks: rows are dealt to
blocks of about ``BLOCK_ROWS``, anchors to blocks of about ``BLOCK_ANCHORS``, and each pair of blocks is one group of
bounded size, with the tree of its anchors. First every block names its best rows of an anchor's own label, which
merge to the positives; then every block names its first negatives in each positive's window, which merge again.

Scores are integers. Products are summed in float64 where no sum can reach 2^53, else in 64-bit integers. Long vectors,
whose sum of (|256 x| + 1)^2 reaches 2^62, are scored pair by pair, modulo 2^64; a pair is left out only where its own
score does not fit the 64 bits of the result.

Defined results: rows with a null vec_id, label, vector or component, or with a component that is not finite (256 times
itself included), take no part; vectors of different lengths are filled up with zeros; exact repeats of a row count
once; rows that share a vec_id but nothing else are rows of their own, though none is another's positive; an anchor
without positives, or a window without rows, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import stored

EVERY = 100        # anchors: ids divisible by it
RELABELLED = 7     # ids divisible by it get the next label
SCALE = 256
LABELS = 10
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # per cent of the positive's score
BLOCK_ROWS, BLOCK_ANCHORS = 8192, 1024
CHUNK = 1024       # exact scores computed at a time, when there are more
EXACT = 2.0 ** 53
LONG = 2.0 ** 62   # squared lengths from here on are scored modulo 2^64


def prepared(rows: DataFrame) -> DataFrame:
    """(key, vec_id, label, v): the rows that take part, with changed labels and whole components, each once."""
    part = rows.select("vec_id", "label", "embedding").where(
        "vec_id is not null and label is not null and embedding is not null "
        f"and forall(embedding, x -> x is not null and not isnan(x) and abs(cast(x as double) * {SCALE}) < double('infinity'))")
    # A double from 2^53 on is whole already, and its floor may not fit 64 bits.
    whole = f"if(abs(x * {SCALE}) < pow(2d, 53), cast(floor(x * {SCALE}) as double), x * {SCALE})"
    return part.selectExpr(
        "vec_id", f"case when vec_id % {RELABELLED} = 0 then (cast(label as long) + 1) % {LABELS} else cast(label as long) end as label",
        f"transform(cast(embedding as array<double>), x -> {whole}) as v"
    ).distinct().select(F.xxhash64("vec_id", "label", "v").alias("key"), "vec_id", "label", "v")


def spanning_tree(anchors: np.ndarray) -> list[tuple[int, int, float]]:
    """(anchor, parent, distance) of a minimum spanning tree, parents first; the first anchor has parent -1.

    Children with the smallest subtrees come first and the last child takes over its parent's place, so that the
    intervals that wait for a child number log2 of the anchors at most.
    """
    n = len(anchors)
    near, gap, inside = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n, bool)
    children: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    order, at = [0], 0
    inside[0] = True
    for _ in range(n - 1):
        to = np.sqrt(((anchors - anchors[at]) ** 2).sum(1))
        closer = to < gap
        near[closer], gap[closer] = at, to[closer]
        at = int(np.argmin(np.where(inside, np.inf, gap)))
        inside[at] = True
        children[near[at]].append((at, float(gap[at])))
        order.append(at)
    size = np.ones(n, np.int64)
    for at in reversed(order[1:]):
        size[near[at]] += size[at]
    out, todo = [], [(0, -1, 0.0)]
    while todo:
        at, parent, far = todo.pop()
        out.append((at, parent, far))
        todo += [(c, at, d) for c, d in sorted(children[at], key=lambda c: -size[c[0]])]
    return out


class Block:
    """The rows of one block, and the intervals in which their scores with an anchor lie."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, anchors: np.ndarray):
        order = np.lexsort((labels, ids))  # by id, so that a stable order by score breaks ties by id
        self.ids, self.labels, whole = ids[order], labels[order], vectors[order]
        norms = np.sqrt((whole.astype(np.float64) ** 2).sum(1))
        most = np.sqrt((anchors.astype(np.float64) ** 2).sum(1)).max(initial=0) * norms.max(initial=0)
        kind = np.float64 if most < EXACT else np.int64
        self.vectors, self.anchors = whole.astype(kind), anchors.astype(kind)
        self.norms = norms * (1 + 1e-9) + 1e-9  # a bound may be too wide, never too narrow
        self.slack = most * 1e-9 + 1e-3
        self.part = np.ones(len(ids), bool)  # rows whose score can be stated

    def score(self, anchor: int, places: np.ndarray) -> np.ndarray:
        q = self.anchors[anchor]
        return np.concatenate([self.vectors[places[i:i + CHUNK]] @ q for i in range(0, len(places), CHUNK)]
                              or [np.empty(0)])

    def walk(self, look: Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, object]]):
        """Visit the anchors down the tree. ``look(anchor, low, high)`` gives the places to score and takes the rest
        of its work as a function of their scores; what that returns is yielded."""
        tree = spanning_tree(self.anchors.astype(np.float64))
        left = np.zeros(len(tree), np.int64)
        for _, parent, _ in tree:
            if parent >= 0:
                left[parent] += 1
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for at, parent, far in tree:
            if parent < 0:
                low = high = (self.vectors @ self.anchors[at]).astype(np.float64)
                low, high = low - self.slack, high + self.slack
            else:
                low, high = held[parent]
                wide = far * (1 + 1e-9) * self.norms
                low, high = low - wide, high + wide
                left[parent] -= 1
                if not left[parent]:
                    del held[parent]
            places, rest = look(at, low, high)
            exact = self.score(at, places)
            low[places], high[places] = exact - self.slack, exact + self.slack
            if left[at]:
                held[at] = low, high
            yield rest(exact.astype(np.int64))


def _modular(whole: np.ndarray) -> np.ndarray:
    """Whole float64 numbers of any size, modulo 2^64."""
    size = np.fmod(np.abs(whole), 2.0 ** 64).astype(np.uint64)
    return np.where(whole < 0, 0 - size, size).view(np.int64)


class LongBlock(Block):
    """Rows and anchors of which either may be long: each pair is scored, and counts where its score fits 64 bits."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, anchors: np.ndarray):
        order = np.lexsort((labels, ids))
        self.ids, self.labels, self.vectors, self.anchors = ids[order], labels[order], vectors[order], anchors
        self.modular = _modular(self.vectors)

    def scored(self, anchor: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and whether they are right. Rounded sums tell which fit; near the limit whole numbers do."""
        q = self.anchors[anchor]
        exact = self.modular @ _modular(q)
        with np.errstate(all="ignore"):
            near = self.vectors @ q
            error = (np.abs(self.vectors) @ np.abs(q)) * (len(q) + 2) * 2.0 ** -52
            fits, beyond = np.abs(near) + error < 2.0 ** 63, np.abs(near) - error > 2.0 ** 63
        whole = [int(x) for x in q]
        for i in np.flatnonzero(~fits & ~beyond):
            score = sum(int(x) * y for x, y in zip(self.vectors[i], whole))
            fits[i] = -2 ** 63 <= score < 2 ** 63
        return exact, fits

    def walk(self, look: Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, object]]):
        for at in range(len(self.anchors)):
            exact, self.part = self.scored(at)
            near = exact.astype(np.float64)
            places, rest = look(at, near - 2048, near + 2048)
            yield rest(exact[places])


def _dense(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _blocks(anchors: pd.DataFrame, rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, Block]]:
    """The pairs of anchors and rows of which neither is long, and then the others; each with its anchors."""
    width = max([0, *map(len, anchors["v"]), *map(len, rows["v"])])
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    one, other = _dense(anchors["v"], width), _dense(rows["v"], width)
    with np.errstate(over="ignore"):
        short, low = (((np.abs(v) + 1) ** 2).sum(1) < LONG for v in (one, other))
    if short.any() and low.any():
        yield anchors[short], Block(ids[low], labels[low], other[low], one[short])
    if short.any() and not low.all():
        yield anchors[short], LongBlock(ids[~low], labels[~low], other[~low], one[short])
    if not short.all():
        yield anchors[~short], LongBlock(ids, labels, other, one[~short])


def positives_of_block(anchors: pd.DataFrame, rows: pd.DataFrame, most: int) -> list[tuple]:
    """(anchor, positive_id, positive_score): an anchor's first rows of its own label in a block."""
    out = []
    for asking, block in _blocks(anchors, rows):
        keys, ids, labels = (asking[c].to_numpy() for c in ("key", "vec_id", "label"))

        def look(at, low, high):
            own = np.flatnonzero(block.part & (block.labels == labels[at]) & (block.ids != ids[at]))
            if len(own) > most:
                least = np.partition(low[own], -most)[-most]
                own = own[high[own] >= least]

            def best(scores):  # ~x falls as x rises, at the ends of 64 bits as well
                return [(keys[at], block.ids[own[i]], scores[i]) for i in np.argsort(~scores, kind="stable")[:most]]
            return own, best
        out += [row for found in block.walk(look) for row in found]
    return out


def negatives_of_block(anchors: pd.DataFrame, rows: pd.DataFrame, most: int) -> list[tuple]:
    """(anchor, place, anchor_id, positive_id, negative_id, positive_score, negative_score): the first rows of other
    labels in the window of each positive, which is named by its place."""
    out = []
    for asking, block in _blocks(anchors, rows):
        keys, ids, labels = (asking[c].to_numpy() for c in ("key", "vec_id", "label"))
        asked = [[(k, p, s, -(-LOW * s // 100), HIGH * s // 100) for k, (p, s) in enumerate(zip(found.tolist(), scores.tolist()))]
                 for found, scores in zip(asking["positive_ids"], asking["positive_scores"])]

        def look(at, low, high):
            windows = [w for w in asked[at] if w[3] <= w[4]]
            other = block.part & (block.labels != labels[at])
            wanted = np.zeros(len(other), bool)
            for *_, least, greatest in windows:
                may = other & (high >= least) & (low <= greatest)
                sure = np.flatnonzero(may & (low >= least) & (high <= greatest))
                if len(sure) >= most:  # the window's first rows are not below these
                    may &= high >= np.partition(low[sure], -most)[-most]
                wanted |= may
            places = np.flatnonzero(wanted)

            def inside(scores):
                order = np.argsort(~scores, kind="stable")
                falling = ~scores[order]
                found = []
                for k, p, s, least, greatest in windows:
                    start, end = np.searchsorted(falling, [~greatest, ~least + 1])
                    found += [(keys[at], k, ids[at], p, block.ids[places[i]], s, scores[i])
                              for i in order[start:min(end, start + most)]]
                return found
            return places, inside
        out += [row for found in block.walk(look) for row in found]
    return out


def _met(rows: DataFrame, anchors: DataFrame, of_block: Callable, most: int, ddl: str, blocks: tuple[int, int]) -> DataFrame:
    """Every block of rows with every block of anchors."""
    n_rows, n_anchors = blocks
    one = rows.select("key", "vec_id", "label", "v", F.pmod("key", F.lit(n_rows)).alias("r"),
                      F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1))).alias("a"))
    other = anchors.select("*", F.pmod(F.shiftright("key", 20), F.lit(n_anchors)).alias("a"),
                           F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("r"))
    names = [c.split()[0] for c in ddl.split(", ")]

    def group(left, right):
        return pd.DataFrame(of_block(left, right, most) if len(left) and len(right) else [], columns=names)
    return other.groupBy("r", "a").cogroup(one.groupBy("r", "a")).applyInPandas(group, ddl)


def _first(found: DataFrame, by: list[str], score: str, other: str, most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(other))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    part = stored(prepared(rows))
    anchors = part.where(F.col("vec_id") % every == 0)
    total, asked = part.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    blocks = (total // block_rows + 1, asked // block_anchors + 1)
    best = _first(_met(part, anchors, positives_of_block, positives, "key long, positive_id long, positive_score long", blocks),
                  ["key"], "positive_score", "positive_id", positives)
    asks = best.groupBy("key").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("p")).select(
        "key", F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("positive_scores"))
    found = _met(part, stored(anchors.join(asks, "key")), negatives_of_block, negatives,
                 "key long, place int, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long", blocks)
    first = _first(found, ["key", "place"], "negative_score", "negative_id", negatives)
    return first.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
