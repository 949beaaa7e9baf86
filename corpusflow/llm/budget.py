"""Operator 10: exact token counts at every prefix by dynamic programming.

``inner[i]`` is the last token and the token count of a word's first i bytes inside a word, ``closed[i]`` the
count if the word ended there; each follows from an earlier entry and one vocabulary token. A text's table
holds the running count at the end of each run of non-blank characters, and a position inside a run adds the
closed count of the run's beginning. Length, truncation and budget questions are looked up in the table.

Defined results: a null or empty text has no tokens and no bytes; repeated rows give repeated results; other
columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.bpe import CACHED_WORDS, VOCABULARY, Vocabulary, vocabulary
from corpusflow.llm.common import record, slices

LIMIT = 2048
CACHED_CHARS = 16 << 20   # characters of runs whose counts a worker keeps

# The characters with the Unicode property White_Space.
RUN = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class PrefixCounts:
    """Token counts of words and of all their prefixes, for one worker process."""

    def __init__(self, vocab: Vocabulary, most_words: int = CACHED_WORDS, most_chars: int = CACHED_CHARS):
        self.vocab, self.most_words, self.most_chars = vocab, most_words, most_chars
        self.fresh()

    def fresh(self) -> None:
        self.counts: dict[str, int] = dict.fromkeys(self.vocab.special, 1)
        self.run_counts: dict[str, int] = {}
        self.chars = 0

    def trim(self) -> None:
        """Start the caches anew where they are full. Between texts only: what a text has learned, it looks up."""
        if len(self.counts) > self.most_words or self.chars > self.most_chars:
            self.fresh()

    def word_table(self, word: bytes) -> list[int]:
        """closed[0..len(word)]: tokens of every prefix of a word, as if the word ended there."""
        vocab = self.vocab
        states, inner, closed = [-1], [0], [0]
        for end in range(1, len(word) + 1):
            _, start = vocab.last_token(word, end, vocab.closing, states)
            closed.append(inner[start] + 1)
            token, start = vocab.last_token(word, end, vocab.inner, states)
            states.append(token)
            inner.append(inner[start] + 1)
        return closed

    def learn(self, pieces: Iterable[str]) -> None:
        """Counts of new words. Sorted words keep the table's part for what they share with the one before."""
        vocab, states, inner, before = self.vocab, [-1], [0], b""
        new = {p.encode(): p for p in pieces if p not in self.counts}
        for word in sorted(new):
            same = min(len(word), len(inner)) - 1
            if before[:same] != word[:same]:
                same = next(i for i in range(same) if before[i] != word[i])
            del states[same + 1:], inner[same + 1:]
            for end in range(same + 1, len(word)):
                token, start = vocab.last_token(word, end, vocab.inner, states)
                states.append(token)
                inner.append(inner[start] + 1)
            _, start = vocab.last_token(word, len(word), vocab.closing, states)
            self.counts[new[word]] = inner[start] + 1
            before = word

    def learn_runs(self, found: Iterable[str]) -> None:
        """Counts of new runs of non-blank characters: the sums over their words."""
        new = {run: [p for part in self.vocab.pieces(run) for p in part] for run in found if run not in self.run_counts}
        self.learn({p for pieces in new.values() for p in pieces})
        for run, pieces in new.items():
            self.run_counts[run] = sum(map(self.counts.__getitem__, pieces))
            self.chars += len(run)

    def tables(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """By text: tokens up to the end of each run of non-blanks, after a leading zero."""
        self.trim()
        split = [RUN.findall(t or "") for t in texts]
        self.learn_runs({run for found in split for run in found})
        return [np.cumsum([0, *map(self.run_counts.__getitem__, found)], dtype=np.int64) for found in split]

    @staticmethod
    def ends(text: str | None) -> np.ndarray:
        """The code points up to the end of each run, after a leading zero."""
        return np.array([0, *(m.end() for m in RUN.finditer(text or ""))], np.int64)

    def table(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return self.ends(text), self.tables([text])[0]

    def at(self, text: str, position: int, table: tuple[np.ndarray, np.ndarray] | None = None) -> int:
        """Tokens of ``text[:position]``: the table's entry, and the beginning of the run that is cut."""
        ends, counts = table or self.table(text)
        before = bisect_right(ends, position) - 1
        pieces = [p for run in self.vocab.pieces(text[ends[before]:position]) for p in run]
        if not pieces:
            return int(counts[before])
        self.learn(pieces[:-1])
        last = 1 if pieces[-1] in self.vocab.special else self.word_table(pieces[-1].encode())[-1]
        return int(counts[before]) + sum(map(self.counts.__getitem__, pieces[:-1])) + last


_counters: dict[str, PrefixCounts] = {}


def counter(name: str) -> PrefixCounts:
    if name not in _counters:
        _counters[name] = PrefixCounts(vocabulary(name))
    return _counters[name]


def token_counts(docs: DataFrame, limit: int = LIMIT, name: str = VOCABULARY) -> DataFrame:
    """Per document: bytes, tokens, whether they exceed ``limit``, and the code points of the longest beginning
    in whole runs that keeps within it."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
                        ("over_limit", pa.bool_()), ("chars_in_limit", pa.int64())])

    def count(batches):
        known = counter(name)
        for part in slices(batches):
            out = {f.name: [] for f in schema}
            for doc_id, text, counts in zip(part["doc_id"], part["text"], known.tables(part["text"])):
                total, fit = int(counts[-1]), len(text or "")
                if total > limit:
                    fit = int(known.ends(text)[np.searchsorted(counts, limit, "right") - 1])
                out["doc_id"].append(doc_id)
                out["n_bytes"].append(len((text or "").encode()))
                out["n_tokens"].append(total)
                out["over_limit"].append(total > limit)
                out["chars_in_limit"].append(fit)
            yield record(schema, **out)
    return docs.select("doc_id", "text").mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, chars_in_limit long")


def prefix_tables(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """The table itself, per document: ``ends`` (code points) and ``counts`` (tokens up to there)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ends", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])

    def tables(batches):
        known = counter(name)
        for part in slices(batches):
            yield record(schema, doc_id=part["doc_id"], ends=list(map(known.ends, part["text"])),
                         counts=known.tables(part["text"]))
    return docs.select("doc_id", "text").mapInArrow(tables, "doc_id long, ends array<long>, counts array<long>")


def cut_to_budget(tables: DataFrame, budget: int) -> DataFrame:
    """From stored tables alone: where each text is to be cut to keep within ``budget`` tokens."""
    fits = F.size(F.filter("counts", lambda c: c <= budget))
    return tables.select("doc_id", F.element_at("ends", fits).alias("cut"), F.element_at("counts", fits).alias("n_tokens"))
