"""Operator 1: BPE encoding and decoding over a prefix-sharing trie.

A prefix of a word has one BPE encoding, and the encoding is fixed by its last token: the prefix without
that token is encoded by its own last token, and so on. The last token of a prefix is the only vocabulary
entry that ends there and is *compatible* with the last token before it, which means that no merge crosses
their border. Distinct words are inserted into a trie and visited depth first; a node's state is computed
once from the states on its path, for all words that share the prefix.

Defined results: a null or empty text has no tokens (zero ids, empty decoded text); white space gives no
tokens; repeated rows give repeated results; other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpusflow.llm.common import SLICE_BYTES, give_back, record, slices, tokenizer_path

VOCABULARY = "word_bpe_49k.json"
CACHED_WORDS = 400_000   # encodings a worker keeps; beyond it the cache starts anew
PIECE_CHARS = 1 << 20    # longer texts are read in runs of about this size, cut before white space
NEVER = float("inf")     # rank of a piece that no merge consumes

# The vocabulary's end-of-word mark and its split pattern.
END = "</w>"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _latin_pattern() -> re.Pattern:
    """The split pattern for texts below U+0100, where the standard library's engine is faster."""
    chars = [chr(c) for c in range(256)]
    cls = lambda p: "".join(re.escape(c) for c in chars if regex.fullmatch(p, c))
    letters, numbers, blanks = cls(r"\p{L}"), cls(r"\p{N}"), cls(r"\p{White_Space}")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{blanks}{letters}{numbers}]+")


class Vocabulary:
    """Tokens, merges and the words seen so far, for one worker process."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        to_byte = {self._mapped(b): b for b in range(256)}
        self.inner: dict[bytes, int] = {}   # tokens inside a word
        self.closing: dict[bytes, int] = {}  # tokens that end a word
        for token, i in vocab.items():
            ends = token.endswith(END)
            raw = bytes(to_byte[c] for c in (token[:-len(END)] if ends else token))
            (self.closing if ends else self.inner)[raw] = i
        self.longest = max(map(len, [*self.inner, *self.closing]))
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in merges):
            pair = vocab[a], vocab[b]
            self.rank[pair] = rank
            made.setdefault(vocab[a + b], (rank, *pair))
        self.left = {i: self._spine(i, made, 1) for i in vocab.values()}
        self.right = {i: self._spine(i, made, 2) for i in vocab.values()}
        self.whole = {i for i in vocab.values() if self._is_whole(i, made)}
        self.pairs: dict[int, bool] = {}
        self.split = regex.compile(SPLIT)
        self.latin = _latin_pattern()
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        # Outside these blocks the Unicode tables of two libraries may differ; such texts take the
        # tokenizer's own normaliser and splitter.
        self.other = re.compile("[^\0-\u052f\u1e00-\u1fff\u2000-\u2063\u20a0-\u20bf\u2100-\u2bff"
                                "\u3000-\u30ff\u4e00-\u9fef\uac00-\ud7a3]")
        self.fresh()

    @cached_property
    def library(self):
        """The library's tokenizer; only texts outside the usual blocks need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def fresh(self) -> None:
        self.codes = {t: np.uint32(i).astype("<u4").tobytes() for t, i in self.special.items()}

    @staticmethod
    def _mapped(byte: int) -> str:
        """The printable stand-in of a byte in byte-level vocabularies."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        return chr(byte) if byte in plain else chr(256 + [b for b in range(256) if b not in plain].index(byte))

    @staticmethod
    def _spine(token: int, made: dict, side: int) -> tuple[float, ...]:
        """Pieces at one border of a token, smallest first, each followed by the rank that consumes it.

        In one flat tuple: pairs would take several times the memory of their numbers, which are shared.
        """
        found = [NEVER, token]
        while token in made:
            rank = made[token][0]
            token = made[token][side]
            found += rank, token
        return tuple(found[::-1])

    def _is_whole(self, token: int, made: dict) -> bool:
        """Whether a token's own text is encoded as that token."""
        if token not in made:
            return True
        _, a, b = made[token]
        return self._is_whole(a, made) and self._is_whole(b, made) and self._meets(a, b, stop=made[token][0])

    def _meets(self, a: int, b: int, stop: float = NEVER) -> bool:
        """Whether the pieces at the border of a and b reach a and b before any merge crosses it.

        Merges run in order of rank, of equal ranks from left to right. So a merge across the border comes
        first if its rank is below the next merge of the left piece, and not above that of the right piece.
        """
        xs, ys = self.right[a], self.left[b]
        i = j = 0
        while True:
            ends_x, ends_y = xs[i + 1], ys[j + 1]
            across = self.rank.get((xs[i], ys[j]))
            if across is not None and across < min(ends_x, stop) and across <= ends_y:
                return False
            if ends_x == ends_y == NEVER:
                return True
            if ends_x <= ends_y:
                i += 2
            else:
                j += 2

    def compatible(self, a: int, b: int) -> bool:
        """``b in whole and _meets(a, b)``, remembered by the pair."""
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        known = self.pairs[a << 32 | b] = b in self.whole and self._meets(a, b)
        return known

    def last_token(self, path: bytes, end: int, table: dict[bytes, int], states: list[int]) -> tuple[int, int]:
        """(token, start) of the one entry of ``table`` that ends at ``end`` and goes with the state before it."""
        known, whole = self.pairs.get, self.whole
        for start in range(end - self.longest if end > self.longest else 0, end):
            token = table.get(path[start:end])
            if token is None:
                continue
            if start == 0:
                fits = token in whole
            else:
                fits = known(states[start] << 32 | token)
                if fits is None:
                    fits = self.compatible(states[start], token)
            if fits:
                return token, start
        raise ValueError(f"no token ends at {end} of {path[:80]!r}")

    def walk(self, new: Iterable[bytes]) -> Iterator[tuple[bytes, list[int], list[int], int, int]]:
        """Depth-first over the trie of distinct words.

        Sorted words are the trie's depth-first order; ``states`` and ``starts`` hold the last token of each
        node on the path from the root, and only nodes below the branch from the previous word are computed.
        Yields the word, the two lists (valid up to its last byte), and its closing token with its start.
        """
        states: list[int] = [-1]
        starts: list[int] = [0]
        before = b""
        for word in sorted(new):
            depth = min(len(word), len(states)) - 1
            if before[:depth] != word[:depth]:
                depth = next(i for i in range(depth) if before[i] != word[i])
            del states[depth + 1:], starts[depth + 1:]
            for end in range(depth + 1, len(word)):
                token, start = self.last_token(word, end, self.inner, states)
                states.append(token)
                starts.append(start)
            token, start = self.last_token(word, len(word), self.closing, states)
            yield word, states, starts, token, start
            before = word

    def release(self) -> None:
        """Empty both caches: a worker outlives the stage, and later ones need the memory."""
        self.fresh()
        self.pairs.clear()
        give_back()

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode the words that are not in the cache."""
        if len(self.codes) > CACHED_WORDS:
            self.fresh()
        new = {p.encode(): p for p in pieces if p not in self.codes}
        for word, states, starts, token, at in self.walk(new):
            ids = [token]
            while at:
                ids.append(states[at])
                at = starts[at]
            self.codes[new[word]] = np.array(ids[::-1], "<u4").tobytes()

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Words and special tokens of a text, in runs of bounded size."""
        for run in runs(text):
            if "<|" not in run:
                yield self._plain(run)
                continue
            for part in self.specials.split(run):
                if part:
                    yield [part] if part in self.special else self._plain(part)

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.latin.findall(text.lower())
        if self.other.search(text):
            text = self.library.normalizer.normalize_str(text)
            return [bytes(self._byte(c) for c in p).decode("utf-8", "surrogateescape")
                    for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split.findall(text)
        return self.latin.findall(text)

    def _byte(self, char: str) -> int:
        if not hasattr(self, "_bytes"):
            self._bytes = {self._mapped(b): b for b in range(256)}
        return self._bytes[char]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for run in self.pieces(text or ""):
            self.learn(run)
            out.append(b"".join(map(self.codes.__getitem__, run)))
        return b"".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


def runs(text: str) -> Iterator[str]:
    """The text in runs of about PIECE_CHARS, cut before a blank or line feed, which no token contains."""
    if len(text) <= PIECE_CHARS:
        yield text
        return
    blank, at = re.compile("[ \n]"), 0
    while at < len(text):
        cut = blank.search(text, at + PIECE_CHARS)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


_loaded: dict[str, Vocabulary] = {}


def vocabulary(name: str) -> Vocabulary:
    if name not in _loaded:
        _loaded[name] = Vocabulary(tokenizer_path(name))
        give_back()  # of the parsed file, which is larger than what is kept
    return _loaded[name]


def _encodings(name: str, keep_ids: bool):
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()),
              pa.field("decoded_sha256", pa.string())]
    if keep_ids:
        fields.append(pa.field("ids", pa.list_(pa.int32())))
    schema = pa.schema(fields)

    def encode(batches):
        vocab = vocabulary(name)
        for part in slices(batches, most=SLICE_BYTES // 2):
            out = {f.name: [] for f in schema}
            split = [[*vocab.pieces(t or "")] for t in part["text"]]
            vocab.learn({p for runs_ in split for run in runs_ for p in run})
            for doc_id, runs_ in zip(part["doc_id"], split):
                raw = b"".join(b"".join(map(vocab.codes.__getitem__, run)) for run in runs_)
                ids = np.frombuffer(raw, "<u4")
                out["doc_id"].append(doc_id)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(vocab.decode(ids.tolist()).encode()).hexdigest())
                if keep_ids:
                    out["ids"].append(ids.astype(np.int32))
            yield record(schema, **out)
        vocab.release()
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return encode, ddl


def encode_documents(docs: DataFrame, name: str = VOCABULARY, keep_ids: bool = True) -> DataFrame:
    """One row per document: token count, digests of the ids and of the decoded text, and the ids if asked."""
    encode, ddl = _encodings(name, keep_ids)
    return docs.select("doc_id", "text").mapInArrow(encode, ddl)


def decode_documents(encoded: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """Texts back from an ``ids`` column; null ids give the empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def decode(batches):
        vocab = vocabulary(name)
        for part in (b.to_pydict() for b in batches):
            yield record(schema, doc_id=part["doc_id"], text=[vocab.decode(ids or []) for ids in part["ids"]])
    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")
