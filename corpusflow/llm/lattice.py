"""Operator 3: language-model scores as marginals of a subword lattice.

The pieces of an existing vocabulary are the arcs of a lattice over a word's bytes (single bytes are arcs too, so
every word has a path). A forward recursion in log space sums over all segmentations. The vocabulary's own scores
are rank scores; read as Zipf weights they are the prior of the pieces, and their expected counts over the
distinct training words update it. A training word is an arc over the whole word as well:

    P(word) = max(c - D, 0) / N  +  (D V / N) * sum over segmentations of the product of piece probabilities

with c the word's count, N all training tokens, V distinct ones and D an absolute discount, so that what the
discount takes from known words is what the lattice spreads over all words. Words that a text has had already are
arcs as well: after t words of which n were this one, P(word | text so far) = (n + K P(word)) / (t + K). A text is
its words and one end; its score is the sum over all paths, as log10.

A run of documents asks about each of its distinct words once (see ``runs``). Each distinct word's lattice is
summed once, where its counts meet; nothing but the piece weights (as many as the vocabulary has) and two totals
reach the driver.

Defined results: a null, empty or blank text is the end alone; with no training text all counts are zero and the
lattice alone gives the score; repeated rows count as often as they occur; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import lowered, mix, stored, tokenizer_path
from corpusflow.llm.runs import answer, ask, facts_of, finish, pack

VOCABULARY = "piece_bpe_32k.model"
DISCOUNT = 0.75
OWN = 2000.0     # K: how many words of a text weigh as much as the corpus
PRIOR = 1000.0   # weight of the vocabulary's own scores, in expected pieces
BATCH_BYTES = 1 << 18
DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
MARK = "▁".encode()


class Pieces:
    """The vocabulary's pieces as byte strings, found by hash for many words at once."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found: dict[bytes, float] = {}
        for i in range(model.get_piece_size()):
            score = model.get_score(i)
            if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or score < -1e8:
                continue
            found[model.id_to_piece(i).encode()] = 1.0 / (2.7 - score)
        lowest = min(found.values())
        for b in range(256):
            found.setdefault(bytes([b]), lowest)
        self.pieces = sorted(found)
        weights = np.array([found[p] for p in self.pieces])
        self.prior = weights / weights.sum()
        self.lengths = sorted({len(p) for p in self.pieces})
        size = np.array([*map(len, self.pieces)], np.uint64)
        keys = self._key(np.array([self._poly(p) for p in self.pieces], np.uint64), size)
        self.keys = keys
        self.tables = []
        left = np.arange(len(keys))
        shift = 42
        while len(left):
            table = np.full(1 << 22, -1, np.int32)
            slots = (keys[left] >> np.uint64(shift)).astype(np.int64) & (1 << 22) - 1
            table[slots] = left
            self.tables.append((np.uint64(shift), table))
            left = left[table[slots] != left]
            shift -= 7

    BASE = 0x100000001B3

    @classmethod
    def _poly(cls, piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * cls.BASE + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def _key(poly: np.ndarray, length) -> np.ndarray:
        return mix(poly * np.uint64(64) + length)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        for shift, table in self.tables:
            got = table[(keys >> shift).astype(np.int64) & (1 << 22) - 1]
            hit = (got >= 0) & (self.keys[got] == keys)
            out[hit] = got[hit]
        return out

    def arcs(self, letters: np.ndarray):
        """(start, end, words, pieces) of all arcs of words of one length, given as rows of bytes; by end."""
        n = letters.shape[1]
        prefix = [np.zeros(len(letters), np.uint64)]
        for j in range(n):
            prefix.append(prefix[-1] * np.uint64(self.BASE) + letters[:, j] + np.uint64(1))
        for end in range(1, n + 1):
            for length in self.lengths:
                if length > end:
                    break
                power = np.uint64(pow(self.BASE, length, 1 << 64))
                poly = prefix[end] - prefix[end - length] * power
                piece = self.find(self._key(poly, np.uint64(length)))
                at = np.flatnonzero(piece >= 0)
                if len(at):
                    yield end - length, end, at, piece[at]

    def marginals(self, words: list[bytes], logp: np.ndarray, expected: np.ndarray | None = None) -> np.ndarray:
        """Natural log of each word's probability summed over its segmentations.

        With ``expected``, the pieces' expected counts over these words are added to it (forward-backward).
        """
        out = np.empty(len(words))
        size = np.fromiter(map(len, words), np.int64, len(words)) + len(MARK)
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            # Words of about one length together, as rows of bytes padded to the longest.
            end = int(np.searchsorted(size[order], max(size[order[at]] * 5 // 4, 12), "right"))
            end = min(end, at + max(1, BATCH_BYTES // int(size[order[end - 1]])))
            some = order[at:end]
            longest = int(size[some[-1]])
            rows = b"".join((MARK + words[i]).ljust(longest, b"\0") for i in some.tolist())
            letters = np.frombuffer(rows, np.uint8).reshape(len(some), longest).astype(np.uint64)
            out[some] = self._sum(letters, size[some], logp, expected)
            at = end
        return out

    def _sum(self, letters: np.ndarray, size: np.ndarray, logp: np.ndarray, expected: np.ndarray | None) -> np.ndarray:
        """Forward recursion over all words of a batch; what lies beyond a word's own size is not read."""
        n, each = letters.shape[1], np.arange(len(letters))
        forward = np.full((n + 1, len(letters)), -np.inf)
        forward[0] = 0.0
        arcs = self.arcs(letters)
        if expected is not None:
            arcs = list(arcs)
        for start, end, at, piece in arcs:
            forward[end, at] = np.logaddexp(forward[end, at], forward[start, at] + logp[piece])
        total = forward[size, each]
        if expected is not None:
            backward = np.full_like(forward, -np.inf)
            backward[size, each] = 0.0
            for start, end, at, piece in reversed(arcs):
                tail = backward[end, at] + logp[piece]
                expected += np.bincount(piece, np.exp(forward[start, at] + tail - total[at]), len(expected))
                backward[start, at] = np.logaddexp(backward[start, at], tail)
        return total


@lru_cache(maxsize=2)
def pieces(name: str) -> Pieces:
    return Pieces(tokenizer_path(name))


def is_training(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 != 0


def _in_order(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(order by hash, hashes in that order): how a run's words are asked about."""
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    order = np.argsort(keys)
    return order, keys[order]


def _words_of(docs: dict[str, list], _) -> tuple:
    """A run's distinct words in order of hash, with their counts in its training documents."""
    seen: Counter = Counter()
    other: set[bytes] = set()
    for doc_id, text in zip(docs["doc_id"], docs["text"]):
        if is_training(doc_id):
            seen.update(lowered(text))
        else:
            other.update(lowered(text))
    found = [*seen, *(other - seen.keys())]
    order, keys = _in_order(found)
    counts = np.fromiter((seen[w] for w in found), np.int64, len(found))[order]
    names = [found[i] for i in order.tolist()]

    def facts(at: np.ndarray) -> bytes:
        return b" ".join([counts[at].tobytes().hex().encode(), *names[at[0]:at[-1] + 1]])
    return keys, facts


def _tally(facts: list[bytes]) -> tuple[list[list[bytes]], Counter]:
    """The words of each question, and their training counts over all of them."""
    asked, total = [], Counter()
    for fact in facts:
        counts, *names = fact.split(b" ")
        asked.append(names)
        for name, c in zip(names, np.frombuffer(bytes.fromhex(counts.decode()), np.int64).tolist()):
            total[name] += c
    return asked, total


def word_questions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs of documents, their questions about words); both stored, by run and by bucket."""
    blobs = pack(docs, DOCS)
    return blobs, stored(ask(blobs, _words_of, each=16, send_keys=False))


def fit(docs: DataFrame, asked: DataFrame, name: str = VOCABULARY) -> dict:
    """Totals and piece log-probabilities, after one step of expectation-maximisation over all training words."""
    schema = pa.schema([("piece", pa.int32()), ("n", pa.float64())])

    def expect(group: pa.Table) -> pa.Table:
        table = pieces(name)
        _, total = _tally(facts_of(group))
        known = [w for w, c in total.items() if c]
        expected = np.zeros(len(table.prior))
        table.marginals(known, np.log(table.prior), expected)
        at = np.flatnonzero(expected)
        n, v = float(sum(total.values())), float(len(known))
        return pa.Table.from_arrays([pa.array(np.r_[-1, -2, at], pa.int32()), pa.array(np.r_[n, v, expected[at]])],
                                    schema=schema)
    # Bounded by the vocabulary: one sum for each piece and two totals.
    sums = {r.piece: r.n for r in asked.groupBy("bucket").applyInArrow(expect, "piece int, n double")
            .groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    ends = docs.where(F.crc32(key) % 10 != 0).count()
    prior = pieces(name).prior
    mass = PRIOR * prior
    for piece, n in sums.items():
        if piece >= 0:
            mass[piece] += n
    return {"ends": ends, "tokens": int(sums.get(-1, 0)) + ends, "distinct": int(sums.get(-2, 0)) + (ends > 0),
            "logp": np.log(mass / mass.sum())}


def word_log10(counts: np.ndarray, lattice: np.ndarray, model: dict) -> np.ndarray:
    """log10 P of words with these training counts and lattice log-probabilities (natural)."""
    n, v = model["tokens"], model["distinct"]
    if not n:
        return lattice / np.log(10)
    with np.errstate(divide="ignore"):
        known = np.log(np.maximum(counts - DISCOUNT, 0) / n)
    return np.logaddexp(known, np.log(DISCOUNT * v / n) + lattice) / np.log(10)


def text_log10(words_at: np.ndarray, log10: np.ndarray, end: float) -> float:
    """A text's log10 probability: ``words_at`` numbers its words, ``log10`` their probabilities in the corpus."""
    t = len(words_at)
    order = np.argsort(words_at, kind="stable")
    ranked = words_at[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if t else order
    before = np.empty(t, np.int64)
    before[order] = np.arange(t) - np.repeat(first, np.diff(np.r_[first, t]))
    again = before > 0
    own = log10 + np.log10(OWN)
    own[again] = np.log10(before[again] + OWN * 10.0 ** np.maximum(log10[again], -300))
    return float(own.sum() - np.log10(np.arange(t) + OWN).sum()) + end + float(np.log10(OWN / (t + OWN)))


def base_log10(counts: np.ndarray, model: dict) -> np.ndarray:
    return np.log10((counts + 0.1) / (model["tokens"] + 0.1 * (model["distinct"] + 1)))


def scores(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score, score."""
    blobs, asked = word_questions(docs)
    model = fit(docs, asked, name)

    def reply(runs, keys, facts):
        each, total = _tally(facts)
        names = list(total)
        counts = np.fromiter(total.values(), np.int64, len(names))
        values = word_log10(counts, pieces(name).marginals(names, model["logp"]), model)
        place = {w: i for i, w in enumerate(names)}
        for run, own in zip(runs, each):
            at = np.fromiter(map(place.__getitem__, own), np.int64, len(own))
            yield run, b"", np.concatenate([counts[at], values[at].view(np.int64)]).tobytes()

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                        ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()),
                        ("score", pa.float64())])
    # The end is in every training text, and nothing but a text's end; the lattice gives it no share.
    end_count = np.array([model["ends"]])
    end_base = float(base_log10(end_count, model)[0])
    end_model = float(np.log10(max(model["ends"] - DISCOUNT, 0.1) / max(model["tokens"], 1)))

    def result(d, known):
        texts = [lowered(t) for t in d["text"]]
        found = [*set().union(*texts)]
        order, _ = _in_order(found)
        # Answers in order of bucket are in order of hash; each holds its counts, then its values.
        told = [np.frombuffer(f, np.int64).reshape(2, -1) for f in facts_of(known.sort_by("bucket"))]
        counts = np.concatenate([x[0] for x in told] or [np.empty(0, np.int64)])
        values = np.concatenate([x[1] for x in told] or [np.empty(0, np.int64)]).view(np.float64)
        base = base_log10(counts, model)
        place = {found[i]: n for n, i in enumerate(order.tolist())}
        out = {f.name: [] for f in schema}
        for doc_id, words in zip(d["doc_id"], texts):
            at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            out["doc_id"].append(doc_id)
            out["held_out"].append(not is_training(doc_id))
            out["n_tokens"].append(len(words) + 1)
            out["n_known"].append(int((counts[at] > 0).sum()) + (model["ends"] > 0))
            out["train_tokens"].append(model["tokens"])
            out["base_score"].append(float(base[at].sum()) + end_base)
            out["score"].append(text_log10(at, values[at], end_model))
        return out
    return finish(blobs, answer(asked, reply), result, schema,
                  "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
