"""Array-shaped window functions: word, character and sentence-packed chunks of one text.

Each adds an array to the text's own row, so chunking never shuffles; the caller decides
when to ``posexplode``.  Arrays that a lambda reads are columns of their own: an expression
inside a lambda is evaluated again for every element.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions import text as tx
from corpusflow.settings import MAX_TOKENS, OVERLAP_TOKENS, TOKENS_PER_WORD

TRIM_ENDS = r"(?U)^\s+|\s+$"


def word_budget(max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> tuple[int, int]:
    """(words per window, words from one window start to the next)."""
    size = max(40, int(max_tokens / TOKENS_PER_WORD))
    overlap = max(10, int(overlap_tokens / TOKENS_PER_WORD))
    return size, max(1, size - overlap)


def _last_window(n: Column, size: int, step: int) -> Column:
    """Index of the last window over n items; the window that reaches the end is the last."""
    return F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")


def _split_words(df: DataFrame, out: str, text_col: str, when: Column | None = None) -> DataFrame:
    arr = tx.words(text_col)
    return df.withColumn(out, arr if when is None else F.when(when, arr))


def _slices(words: str, size: int, step: int) -> Column:
    n = F.size(words)
    return F.when(n > 0, F.transform(
        F.sequence(F.lit(0), _last_window(n, size, step)),
        lambda i: F.array_join(F.slice(F.col(words), i * step + 1, size), " "))
    ).otherwise(F.array().cast("array<string>"))


def add_word_windows(df: DataFrame, text_col: str, out: str, max_tokens: int = MAX_TOKENS,
                     overlap_tokens: int = OVERLAP_TOKENS) -> DataFrame:
    """CHK-2: overlapping windows of words joined by one space."""
    size, step = word_budget(max_tokens, overlap_tokens)
    return _split_words(df, "_words", text_col).withColumn(out, _slices("_words", size, step)).drop("_words")


def add_article_pieces(df: DataFrame, text_col: str, out: str, max_tokens: int = MAX_TOKENS,
                       overlap_tokens: int = OVERLAP_TOKENS) -> DataFrame:
    """CHK-1 then CHK-2: the trimmed text itself while it fits, word windows when it does not."""
    size, step = word_budget(max_tokens, overlap_tokens)
    trimmed = F.regexp_replace(F.col(text_col), TRIM_ENDS, "")
    df = df.withColumn("_estimate", tx.estimate_tokens(text_col))
    df = _split_words(df, "_words", text_col, F.col("_estimate") > max_tokens)
    pieces = (F.when(F.col("_estimate") == 0, F.array().cast("array<string>"))
              .when(F.col("_estimate") <= max_tokens, F.array(trimmed))
              .otherwise(_slices("_words", size, step)))
    return df.withColumn(out, pieces).drop("_estimate", "_words")


def char_windows(text_col: str, max_chars: int, overlap: int, cap_divisor: int = 2) -> Column:
    """CHK-3 (cap_divisor 2) and CHK-5 (cap_divisor 4): fixed character windows."""
    step = max(1, max_chars - min(overlap, max_chars // cap_divisor))
    text = F.col(text_col)
    return F.transform(
        F.sequence(F.lit(0), _last_window(F.length(text), max_chars, step)),
        lambda i: F.substring(text, i * step + 1, F.lit(max_chars)))


_SPAN = T.ArrayType(T.StructType([
    T.StructField("first", T.IntegerType()),   # first unit
    T.StructField("last", T.IntegerType()),    # one past the last unit
    T.StructField("start", T.IntegerType()),   # character offset in a hard-split unit, else -1
]))


def _packer(max_chars: int, overlap: int):
    step = max(1, max_chars - overlap)

    @F.pandas_udf(_SPAN)
    def spans(lengths: pd.Series) -> pd.Series:
        import numpy as np

        def pack(lens):
            n = 0 if lens is None else len(lens)
            if n == 0:
                return []
            ends = np.concatenate([[0], np.cumsum(np.asarray(lens, dtype=np.int64) + 1)])
            out, s = [], 0
            while s < n:
                if lens[s] > max_chars:
                    last = max(0, -(-(int(lens[s]) - max_chars) // step))
                    out += [(s, s + 1, i * step) for i in range(last + 1)]
                    s += 1
                    continue
                # joined length of units s..e-1 is ends[e] - ends[s] - 1
                e = int(np.searchsorted(ends, ends[s] + max_chars + 1, side="right")) - 1
                out.append((s, e, -1))
                if e >= n:
                    break
                back = int(np.searchsorted(ends, ends[e] - overlap, side="right")) - 1
                s = min(e, max(s + 1, back))
            return out

        return lengths.map(pack)

    return spans


def add_packed_windows(df: DataFrame, text_col: str, out: str, max_chars: int, overlap: int) -> DataFrame:
    """CHK-4 + WIN-6: whole sentences packed up to max_chars with overlap.

    Only unit lengths go through Arrow (the next start depends on the last one, so the walk
    is sequential inside one text); the texts themselves stay in the JVM.
    """
    max_chars = max(64, max_chars)
    overlap = min(overlap, max_chars // 2, max_chars - 64)
    none = F.array().cast("array<string>")
    df = df.withColumn("_text", F.regexp_replace(F.col(text_col), TRIM_ENDS, ""))
    df = df.withColumn("_units", F.when(F.length("_text") <= max_chars, none).otherwise(tx.units("_text")))
    df = df.withColumn("_spans", _packer(max_chars, overlap)(F.transform("_units", lambda s: F.length(s))))
    unit = F.col("_units")
    pieces = F.transform("_spans", lambda p: F.trim(
        F.when(p["start"] >= 0,
               F.substring(F.get(unit, p["first"]), p["start"] + 1, F.lit(max_chars)))
        .otherwise(F.array_join(F.slice(unit, p["first"] + 1, p["last"] - p["first"]), " "))))
    df = df.withColumn("_pieces", F.filter(pieces, lambda p: p != ""))
    # zip_with pads the shorter side with null, so the first piece has no predecessor.
    follows = F.zip_with(
        "_pieces", F.concat(F.array(F.lit(None).cast("string")), F.col("_pieces")),
        lambda now, before: F.when(~F.coalesce(now == before, F.lit(False)), now))
    distinct = F.filter(follows, lambda p: p.isNotNull())
    return (df.withColumn(out, F.when(F.col("_text") == "", none)
                          .when(F.length("_text") <= max_chars, F.array("_text"))
                          .otherwise(distinct))
            .drop("_text", "_units", "_spans", "_pieces"))
