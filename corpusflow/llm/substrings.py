"""Operator 9: substring de-duplication by level-wise doubling.

A window of ``window`` words can only be repeated if shorter windows inside it are. The first level looks at
windows of half the length, and of those only at each full window's least one by hash (two equal windows choose
the same place). What no other document shares is alone and drops out; what is left is extended to twice the
length, and so on, until the full length is reached or no candidates survive. The last level also learns the
smallest doc_id that has each window.

A run asks about each distinct window once (see ``runs``), so a passage that a third of all documents hold is
one question a run. Windows are compared by 64-bit hashes; n candidate windows meet by chance with probability
n^2 / 2^65.

Defined results: a null, empty or blank text has no words and is kept as the empty text; fewer words than a
window: nothing is removed; rows that repeat a doc_id are one document and do not remove each other; a null
doc_id counts as larger than all others; other columns pass through ``without_repeats`` unchanged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import mix, words
from corpusflow.llm.runs import answer, ask, finish, keys_of, pack, values_of

WINDOW = 13
LAST = np.iinfo(np.int64).max
DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def levels(window: int, start: int | None = None) -> list[int]:
    """Window lengths from ``start`` (half of the full one, rounded up) by doubling to the full one."""
    found = [min(start or (window + 1) // 2, window)]
    while found[-1] < window:
        found.append(min(2 * found[-1], window))
    return found


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each place on, by doubling; places near the end are not valid."""
    have, out = 1, h
    while have < length:
        step = min(have, length - have)
        out = _joined(out, step)
        have += step
    return out


def _joined(h: np.ndarray, step: int) -> np.ndarray:
    out = h.copy()
    if step < len(h):
        out[:-step] = mix(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:] + np.uint64(step))
    return out


def least_places(h: np.ndarray, among: int) -> np.ndarray:
    """For each place the leftmost of the ``among`` places from there on whose hash is least."""
    key, best = mix(h), np.arange(len(h))
    low = key.copy()
    for step in range(1, min(among, len(h))):
        less = np.flatnonzero(key[step:] < low[:-step])
        low[less] = key[less + step]
        best[less] = less + step
    return best


class Windows:
    """The words of a run's documents, end to end, and their full windows."""

    def __init__(self, docs: dict[str, list], window: int):
        self.ids = np.array([LAST if i is None else i for i in docs["doc_id"]], np.int64)
        self.words = [words(t) for t in docs["text"]]
        self.n = np.array([*map(len, self.words)], np.int64)
        digest = xxhash.xxh3_64_intdigest
        self.h = np.fromiter((digest(w) for doc in self.words for w in doc), np.uint64, int(self.n.sum()))
        self.window = window
        ends = np.repeat(np.cumsum(self.n), self.n)
        self.starts = np.flatnonzero(ends - np.arange(len(self.h)) >= window)  # where full windows begin
        self.doc = np.repeat(self.ids, self.n)[self.starts]

    def keys(self, level: int, first: bool) -> np.ndarray:
        """For each full window, the hash that stands for it at a level."""
        h = window_hashes(self.h, level)
        return h[least_places(h, self.window - level + 1)[self.starts]] if first else h[self.starts]


def _spread(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, with the least and the greatest document of each."""
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    if not len(at):
        return keys, docs, docs
    return keys[at], np.minimum.reduceat(docs, at), np.maximum.reduceat(docs, at)


def _candidates(w: Windows, level: int, first: bool, known: pa.Table) -> np.ndarray:
    """Which full windows may be repeated after a level: other runs share its key, or another document here does."""
    keys = w.keys(level, first)
    distinct, low, high = _spread(keys, w.doc)
    alive = np.unique(np.concatenate([keys_of(known), distinct[low < high]]))
    if not len(alive):
        return np.zeros(len(keys), bool)
    return alive[np.minimum(np.searchsorted(alive, keys), len(alive) - 1)] == keys


def _shared(runs, keys, facts):
    """To each run, those of its keys that other runs ask about as well."""
    distinct, times = np.unique(np.concatenate(keys), return_counts=True)
    twice = distinct[times > 1]
    for run, own in zip(runs, keys):
        found = own[np.isin(own, twice, assume_unique=True)] if len(twice) else own[:0]
        if len(found):
            yield run, found.tobytes(), b""


def _first_owner(runs, keys, facts):
    """To each run, the smallest document of those of its keys that an earlier document elsewhere has."""
    owners = [np.frombuffer(f, np.int64) for f in facts]
    distinct, low, _ = _spread(np.concatenate(keys), np.concatenate(owners))
    for run, own, mine in zip(runs, keys, owners):
        least = low[np.searchsorted(distinct, own)]
        less = least < mine
        if less.any():
            yield run, own[less].tobytes(), least[less].tobytes()


def removed(docs: dict[str, list], known: pa.Table, window: int) -> tuple[Windows, np.ndarray]:
    """Which words of a run are covered by windows that a smaller document has too."""
    w = Windows(docs, window)
    keys = w.keys(window, False)
    distinct, low, _ = _spread(keys, w.doc)
    theirs, owners = keys_of(known), values_of(known, np.int64)
    if len(distinct):
        at = np.searchsorted(distinct, theirs)
        low[at] = np.minimum(low[at], owners)
    gone = w.starts[low[np.searchsorted(distinct, keys)] < w.doc] if len(keys) else w.starts
    edge = np.zeros(len(w.h) + window + 1, np.int32)
    edge[gone] += 1  # the places are distinct
    edge[gone + window] -= 1
    return w, np.cumsum(edge)[:len(w.h)] > 0


def _judged(docs: DataFrame, window: int, start: int | None, schema: pa.Schema):
    blobs = pack(docs, schema)
    lengths = levels(window, start)
    if len(lengths) == 1:
        lengths *= 2  # the full length is asked about at once

    def first_level(d, _):
        return np.unique(Windows(d, window).keys(lengths[0], True)), None
    found = answer(ask(blobs, first_level), _shared)
    for n in range(1, len(lengths)):
        before, level, last = lengths[n - 1], lengths[n], n == len(lengths) - 1

        def extend(d, known, before=before, level=level, first=n == 1, last=last):
            w = Windows(d, window)
            left = _candidates(w, before, first, known)
            keys, low, _ = _spread(w.keys(level, False)[left], w.doc[left])
            return keys, low if last else None
        found = answer(ask(blobs, extend, found), _first_owner if last else _shared)
    return blobs, found


def repeated_words(docs: DataFrame, window: int = WINDOW, start: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): what stays after the repeated windows are cut out."""
    blobs, found = _judged(docs, window, start, DOCS)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("kept_sha256", pa.string())])

    def result(d, known):
        out = {f.name: [] for f in schema}
        for doc_id, n, cut, kept in _kept(d, known, window):
            out["doc_id"].append(doc_id)
            out["n_words"].append(n)
            out["n_removed"].append(cut)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        return out
    return finish(blobs, found, result, schema, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _kept(d, known, window):
    w, gone = removed(d, known, window)
    at = 0
    for doc_id, found in zip(d["doc_id"], w.words):
        cut = gone[at:at + len(found)]
        at += len(found)
        n = int(cut.sum())
        kept = [x for x, c in zip(found, cut.tolist()) if not c] if n else found
        yield doc_id, len(found), n, b" ".join(kept)


def without_repeats(docs: DataFrame, window: int = WINDOW, start: int | None = None) -> DataFrame:
    """The documents with repeated windows cut out of their texts, and ``n_chars`` brought up to date.

    Texts that lose nothing stay as they are, white space included. All other columns are kept.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.schema)
    blobs, found = _judged(docs, window, start, schema)

    def result(d, known):
        out = dict(d)
        out["text"] = [kept.decode() if cut else text
                       for text, (_, _, cut, kept) in zip(d["text"], _kept(d, known, window))]
        return out
    cut = finish(blobs, found, result, schema, docs.schema)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
