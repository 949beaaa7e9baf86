"""Operator 5: language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram's vector binds (multiplies) its
letters' vectors, each permuted (rotated) by its place; a text's vector bundles (adds) those of its n-grams, and a
language's prototype bundles all its training texts. A text gets the language with the largest cosine.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is everything if no language can
be learned; ties go to the first language by name; a cosine below 0 counts as 0; rows with null lang teach nothing;
repeated rows teach as often as they occur; other columns are never looked at. What reaches the driver is one vector
for each language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import held, record, slices

DIMENSIONS = 1024
N = 3
GROUP = 64            # texts whose vectors are made by one matrix product
KNOWN = 16_384        # n-gram vectors a worker keeps
UNKNOWN = "und"


class Space:
    """Letter and n-gram vectors of one worker process."""

    def __init__(self, dimensions: int, n: int):
        self.dimensions, self.n = dimensions, n
        self.letters: dict[int, np.ndarray] = {}
        self.rows = np.empty((0, dimensions), np.float32)
        self.keys = np.empty(0, np.uint64)
        self.alphabetic = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            signs = np.random.Generator(np.random.PCG64(code)).integers(0, 2, self.dimensions)
            self.letters[code] = (2 * signs - 1).astype(np.float32)
        return self.letters[code]

    def codes(self, text: str | None) -> np.ndarray:
        """Letters in lower case; everything else is one gap (0) between words, and one at each end."""
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(self.alphabetic[points], points, 0)
        points = np.r_[np.uint32(0), points, np.uint32(0)]
        return points[np.r_[True, (points[1:] != 0) | (points[:-1] != 0)]].astype(np.uint64)

    def grams(self, text: str | None) -> np.ndarray:
        """The text's n-grams, each packed into one value; none if there is no letter."""
        codes = self.codes(text)
        if not codes.any():
            return np.empty(0, np.uint64)
        if len(codes) < self.n:
            codes = np.r_[codes, np.zeros(self.n - len(codes), np.uint64)]
        packed = np.zeros(len(codes) - self.n + 1, np.uint64)
        for place in range(self.n):
            packed = packed << np.uint64(21) | codes[place:len(codes) - self.n + 1 + place]
        return packed

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """Bound vectors of distinct n-grams (sorted keys)."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if known.all():
            return self.rows[at]
        out = np.empty((len(keys), self.dimensions), np.float32)
        if known.any():
            out[known] = self.rows[at[known]]
        for i in np.flatnonzero(~known).tolist():
            key, bound = int(keys[i]), np.float32(1)
            for place in range(self.n):
                code = key >> 21 * (self.n - 1 - place) & 0x1FFFFF
                bound = bound * np.roll(self.letter(code), self.n - 1 - place)
            out[i] = bound
        if len(self.keys) + np.count_nonzero(~known) > KNOWN:
            self.keys, self.rows = keys[:KNOWN], out[:KNOWN]
        else:
            merged = np.r_[self.keys, keys[~known]]
            order = np.argsort(merged)
            self.keys, self.rows = merged[order], np.concatenate([self.rows, out[~known]])[order]
        return out

    def bundle(self, grams: list[np.ndarray]) -> np.ndarray:
        """One row for each text: the sum of its n-grams' vectors."""
        sizes = [len(g) for g in grams]
        keys, place = np.unique(np.concatenate(grams), return_inverse=True)
        counts = np.zeros((len(grams), len(keys)), np.float32)
        np.add.at(counts, (np.repeat(np.arange(len(grams)), sizes), place), 1)
        return counts @ self.vectors(keys)


_spaces: dict[tuple[int, int], Space] = {}


def space(dimensions: int, n: int) -> Space:
    if (dimensions, n) not in _spaces:
        _spaces[dimensions, n] = Space(dimensions, n)
    return _spaces[dimensions, n]


def learn(docs: DataFrame, dimensions: int = DIMENSIONS, n: int = N) -> tuple[list[str], np.ndarray]:
    """(languages in order of name, their prototypes of length 1) from all rows with a lang."""
    schema = pa.schema([("lang", pa.string()), ("dim", pa.int32()), ("value", pa.float64())])

    def bundles(batches):
        known, sums = space(dimensions, n), {}
        for part in slices(batches):
            grams = [known.grams(t) for t in part["text"]]
            for lang in sorted(set(part["lang"])):
                own = [g for g, other in zip(grams, part["lang"]) if other == lang and len(g)]
                if own:
                    # The sum over texts is the sum over all their n-grams.
                    keys, counts = np.unique(np.concatenate(own), return_counts=True)
                    total = sums.setdefault(lang, np.zeros(dimensions))
                    for at in range(0, len(keys), KNOWN // 4):
                        total += counts[at:at + KNOWN // 4].astype(np.float32) @ known.vectors(keys[at:at + KNOWN // 4])
        for lang, total in sums.items():
            yield record(schema, lang=[lang] * dimensions, dim=np.arange(dimensions), value=total)
    sums = (docs.where("lang is not null").select("text", "lang").mapInArrow(bundles, "lang string, dim int, value double")
            .groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect())
    found: dict[str, np.ndarray] = {}
    for r in sums:
        found.setdefault(r.lang, np.zeros(dimensions))[r.dim] = r.value
    names = sorted(found)
    stacked = np.array([found[x] for x in names]).reshape(len(names), dimensions)
    return names, (stacked / np.maximum(np.linalg.norm(stacked, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray, dimensions: int = DIMENSIONS, n: int = N) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its text alone."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def classify(batches):
        known = space(dimensions, n)
        for part in slices(batches):
            grams = [known.grams(t) for t in part["text"]]
            lang, score = [UNKNOWN] * len(grams), [0.0] * len(grams)
            able = [i for i, g in enumerate(grams) if len(g)] if names else []
            for at in range(0, len(able), GROUP):
                some = able[at:at + GROUP]
                texts = known.bundle([grams[i] for i in some])
                length = np.linalg.norm(texts, axis=1, keepdims=True)
                cosine = texts @ prototypes.T / np.maximum(length, 1e-12)
                for i, best, row in zip(some, cosine.argmax(1).tolist(), cosine):
                    lang[i], score[i] = names[best], float(min(max(row[best], 0.0), 1.0))
            yield record(schema, doc_id=part["doc_id"], lang_pred=lang, score=score)
    return docs.select("doc_id", "text").mapInArrow(classify, "doc_id long, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """The columns of the query: learned from documents whose bucket of 4 is not 2, asked of all."""
    names, prototypes = learn(docs.where(~held(2, 4)).select("text", "lang"))
    return predict(docs, names, prototypes).select("doc_id", held(2, 4).alias("held_out"), "lang_pred", "score")
