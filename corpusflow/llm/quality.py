"""Operator 4: quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or not at all on every document. Expectation-maximisation over the
counts of vote patterns (all documents; at most 3^labellers patterns reach the driver) estimates how often each
labeller votes what on good and on bad documents, and so a posterior for every pattern. A linear scorer over hashed
features then learns these posteriors from a sample of SAMPLE documents and judges every document.

Defined results: a null, empty or blank text gets votes like any other (it has no words: bad) and no features; rows
that repeat count as often as they occur; with no documents nothing is learned and the result is empty; other columns
pass through ``good_documents`` unchanged.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import parts, record, slices

SAMPLE = 6_000      # documents whose posteriors the scorer is fitted to (about; drawn by a hash of the text)
FEATURES = 2_048    # hashed features
KEEP_FROM = 0.5
GOOD, BAD, NONE = 1, 0, 2
LABELLERS = ("plain_words", "function_words", "capitals", "symbols", "bare_tokens", "stutter", "few_words")

# Frequent function words of four languages.
FUNCTION_WORDS = frozenset(
    b"the of and to in a is that it for on with as was by be are this at from an or not but have he they "
    b"la le les de des du et en un une que qui dans pour sur au par est il elle pas plus "
    b"der die das und ist nicht ein eine zu mit von den dem im auf es sich als auch an "
    b"el los las y del se por con su al lo como para no una".split())


def _classes() -> np.ndarray:
    """Bytes by kind: 0 blank, 1 small letter or part of a longer character, 2 capital, 3 digit, then each symbol."""
    kind = np.zeros(256, np.uint8)
    symbols = iter(range(4, 64))
    for b in range(256):
        c = chr(b)
        kind[b] = (0 if c in "\t\n\v\f\r " else 1 if b >= 128 or c.islower() else 2 if c.isupper()
                   else 3 if c.isdigit() else next(symbols))
    return kind


KIND = _classes()
CLOSING = np.zeros(64, bool)
CLOSING[KIND[np.frombuffer(b".,;:!?", np.uint8)]] = True


class Page:
    """Counts of one text that the labellers and the features look at."""

    def __init__(self, text: str | None):
        raw = (text or "").encode()
        self.kind = KIND[np.frombuffer(raw, np.uint8)]
        found = raw.split()
        self.n = n = len(found)
        if not n:
            return
        blank = self.kind == 0
        starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
        ends = np.flatnonzero(~blank & np.r_[blank[1:], True])
        letter = (self.kind == 1) | (self.kind == 2)
        letters = np.r_[0, np.cumsum(letter)]
        size = ends - starts + 1
        lettered = letters[ends + 1] - letters[starts]
        closed = CLOSING[self.kind[ends]]
        total = max(int(letters[-1]), 1)
        # Running text: a word that only repeats the one before is neither plain nor a function word.
        new = np.fromiter(map(operator.ne, found, [b"", *found[:-1]]), bool, n)
        self.plain = float(((lettered > 0) & (size - lettered == closed) & new).mean())
        self.capitals = float((self.kind == 2).sum() / total)
        last = self.kind[ends]
        self.symbols = float(((last > 3) & ~closed & (lettered > 0)).mean())
        self.bare = float((lettered == 0).mean())
        self.function = float((np.fromiter(map(FUNCTION_WORDS.__contains__, found), bool, n) & new).mean())
        self.stutter = 1 - float(new.mean())
        self.distinct = len(set(found)) / n

    def votes(self) -> list[int]:
        """In the order of LABELLERS."""
        if not self.n:
            return [BAD, BAD, NONE, NONE, NONE, NONE, BAD]
        between = lambda x, bad, good: BAD if x < bad else GOOD if x > good else NONE
        above = lambda x, most: BAD if x > most else NONE
        return [between(self.plain, 0.6, 0.85), between(self.function, 0.05, 0.15), above(self.capitals, 0.35),
                above(self.symbols, 0.2), above(self.bare, 0.25), above(self.stutter, 0.2),
                BAD if self.n >= 40 and self.distinct < 0.12 else NONE]

    def features(self) -> np.ndarray:
        """Hashed: shares of runs of three kinds of bytes, and grades of the counts; of length 1."""
        out = np.zeros(FEATURES, np.float32)
        if not self.n:
            return out
        k = self.kind.astype(np.int64)
        if len(k) > 2:
            grams = (k[:-2] << 12 | k[1:-1] << 6 | k[2:]) * 0x9E3779B1 >> 11 & FEATURES - 1
            out += np.sqrt(np.bincount(grams, minlength=FEATURES) / len(grams)).astype(np.float32)
        for i, x in enumerate((self.plain, self.capitals, self.symbols, self.bare, self.function, self.stutter, self.distinct)):
            out[(i * 16 + int(x * 15.99)) * 0x9E3779B1 >> 11 & FEATURES - 1] += 0.5
        return out / np.linalg.norm(out)


def pattern(votes: list[int]) -> int:
    return int("".join(map(str, votes)), 3)


def unpattern(code: int) -> list[int]:
    return [code // 3 ** i % 3 for i in reversed(range(len(LABELLERS)))]


def patterns(docs: DataFrame) -> dict[int, int]:
    """How many documents have each vote pattern."""
    schema = pa.schema([("pattern", pa.int32()), ("n", pa.int64())])

    def count(batches):
        seen = np.zeros(3 ** len(LABELLERS), np.int64)
        for part in slices(batches):
            for text in part["text"]:
                seen[pattern(Page(text).votes())] += 1
        at = np.flatnonzero(seen)
        yield record(schema, pattern=at, n=seen[at])
    rows = docs.select("text").mapInArrow(count, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return {r.pattern: r.n for r in rows}


def accuracies(counts: dict[int, int], rounds: int = 100) -> tuple[float, np.ndarray, dict[int, float]]:
    """(share of good documents, P(vote | class) by labeller, posterior of good by pattern), by EM.

    Starts from labellers that are right four times of five; votes of one document are independent given its class.
    """
    codes = sorted(counts)
    votes = np.array([unpattern(c) for c in codes], int).reshape(len(codes), len(LABELLERS))
    weight = np.array([counts[c] for c in codes], float)
    score = (votes == GOOD).sum(1) - (votes == BAD).sum(1)
    good = np.where(score > 0, 0.8, np.where(score < 0, 0.2, 0.5))
    share, table = 0.5, np.zeros((2, len(LABELLERS), 3))
    for _ in range(rounds):
        for cls, belief in ((GOOD, good), (BAD, 1 - good)):
            for vote in (BAD, GOOD, NONE):
                table[cls, :, vote] = ((votes == vote) * (weight * belief)[:, None]).sum(0) + 0.5
        table /= table.sum(2, keepdims=True)
        share = ((weight * good).sum() + 1) / (weight.sum() + 2)
        pick = np.arange(len(LABELLERS))
        up = np.log(share) + np.log(table[GOOD][pick, votes]).sum(1)
        down = np.log(1 - share) + np.log(table[BAD][pick, votes]).sum(1)
        good = 1 / (1 + np.exp(np.clip(down - up, -500, 500)))
    return float(share), table, dict(zip(codes, good.tolist()))


def fit(docs: DataFrame, posterior: dict[int, float], total: int, sample: int = SAMPLE) -> np.ndarray:
    """Weights of the linear scorer (the last one is the bias), from about ``sample`` documents."""
    schema = pa.schema([("good", pa.float64()), ("x", pa.binary())])

    def draw(batches):
        for part in slices(batches):
            pages = [Page(t) for t in part["text"]]
            yield record(schema, good=[posterior[pattern(p.votes())] for p in pages],
                         x=[p.features().astype(np.float16).tobytes() for p in pages])
    limit = 1_000_000 if total <= sample else max(1, 1_000_000 * sample // total)
    drawn = docs.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(1_000_000)) < limit).select("text")
    rows = drawn.mapInArrow(draw, "good double, x binary").collect()
    weights = np.zeros(FEATURES + 1)
    if not rows:
        return weights
    x = np.stack([np.frombuffer(r.x, np.float16) for r in rows]).astype(np.float32)
    x = np.c_[x, np.ones(len(x), np.float32)]
    y = np.array([r.good for r in rows], np.float32)
    # Both classes weigh the same; full gradients with momentum.
    rare = np.clip(y.mean(), 0.02, 0.98)
    weigh = (y / rare + (1 - y) / (1 - rare)).astype(np.float32) / 2
    speed = np.zeros_like(weights)
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(x @ weights.astype(np.float32), -30, 30)))
        gradient = x.T @ (weigh * (p - y)) / len(x) + 1e-5 * weights
        speed = 0.9 * speed - 4.0 * gradient
        weights += speed
    return weights


def model(docs: DataFrame, sample: int = SAMPLE) -> tuple[dict[int, float], np.ndarray]:
    counts = patterns(docs)
    _, _, posterior = accuracies(counts)
    return posterior, fit(docs, posterior, sum(counts.values()), sample)


def _score(page: Page, weights: np.ndarray) -> float:
    z = float(page.features() @ weights[:-1].astype(np.float32)) + float(weights[-1])
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, weak_label, score, keep): the labellers' posterior and the scorer's probability of good."""
    posterior, weights = model(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("weak_label", pa.float64()), ("score", pa.float64()), ("keep", pa.bool_())])

    def judge(batches):
        for part in slices(batches):
            pages = [Page(t) for t in part["text"]]
            score = [_score(p, weights) for p in pages]
            yield record(schema, doc_id=part["doc_id"], weak_label=[posterior[pattern(p.votes())] for p in pages],
                         score=score, keep=[s >= KEEP_FROM for s in score])
    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, weak_label double, score double, keep boolean")


def good_documents(docs: DataFrame) -> DataFrame:
    """The documents that the scorer keeps, with all their columns."""
    _, weights = model(docs)

    def keep(batches):
        # Whole rows go back in small batches, which neither side holds long.
        for part in parts(batches):
            yield part.filter(pa.array([_score(Page(t), weights) >= KEEP_FROM for t in part.column("text").to_pylist()], pa.bool_()))
    return docs.mapInArrow(keep, docs.schema)
