"""Operator 11: spelling variants, by one-edit neighbourhoods over a reduced alphabet.

Letters are hashed to ``SYMBOLS`` symbols, so a word becomes a short string over a small alphabet whose whole one-edit
neighbourhood is small: L deletions, L * (SYMBOLS - 1) replacements, (L + 1) * SYMBOLS insertions and the string itself
(an edit between two letters of one symbol). An edit of a word is an edit of its reduced string or none, so every near
word's reduced string lies in the neighbourhood. Each distinct reduced string generates its neighbours once, meets the
vocabulary of reduced strings in an equi-join, and only then are the words behind both compared letter by letter.

All of it is DataFrame expressions. Occurrences are counted before they are exchanged; what is joined is the
vocabulary, and a frequent word is one row of it.

Defined results: null, empty and letterless texts add nothing; a null doc_id counts as the empty text in the hash that
picks runs to shorten; repeated rows are counted as often as they occur; ties between near words of one frequency
go to the smallest in code-point order; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import stored

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
SHORTENED = 199  # one run in so many loses a letter
LEAST_CHARS, LEAST_COUNT = 6, 5
TIMES = 5     # how much more frequent a word's form is
SYMBOLS = 8
DOUBLINGS = 5  # a form is TIMES as frequent, so 64-bit counts end a chain within 27 < 2^5 steps


def occurrences(docs: DataFrame, least_chars: int = 1) -> DataFrame:
    """(run): every run of ``least_chars`` letters or more of every text, lower-cased, with the letter left out that
    its hash picks."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_chars).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    hashed = runs.select("run", F.crc32(named.cast("binary")).alias("h"))
    return hashed.selectExpr(
        f"case when h % {SHORTENED} = 0 then concat(left(run, cast(h % length(run) as int)), "
        "substring(run, cast(h % length(run) as int) + 2)) else run end as run")


def vocabulary(runs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words that are long and frequent enough."""
    return (runs.where(F.length("run") >= least_chars).groupBy(F.col("run").alias("word"))
            .agg(F.count("*").alias("n")).where(F.col("n") >= least_count))


def reduced(word: str, symbols: int = SYMBOLS) -> Column:
    """The word with each letter replaced by one of ``symbols`` symbols; neighbours in the alphabet differ."""
    return F.translate(word, LETTERS, "".join(chr(ord("a") + (i * 37 + i // symbols) % symbols) for i in range(len(LETTERS))))


def neighbourhood(r: str, symbols: int = SYMBOLS) -> Column:
    """All strings within one edit of the reduced string in column ``r``, itself included."""
    letters = "array(" + ", ".join(f"'{chr(ord('a') + s)}'" for s in range(symbols)) + ")"
    return F.expr(f"""array_distinct(concat(
        transform(sequence(1, length({r})), i -> concat(left({r}, i - 1), substring({r}, i + 1))),
        flatten(transform(sequence(1, length({r})), i -> transform({letters}, s -> concat(left({r}, i - 1), s, substring({r}, i + 1))))),
        flatten(transform(sequence(0, length({r})), i -> transform({letters}, s -> concat(left({r}, i), s, substring({r}, i + 1)))))))""")


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n): both directions of every pair of words that differ by exactly one edit."""
    filed = stored(words.withColumn("r", reduced("word", symbols)))
    known = filed.select("r").distinct()
    sent = known.select("r", F.explode(neighbourhood("r", symbols)).alias("other"))
    met = sent.join(known.select(F.col("r").alias("other")), "other")
    near = filed.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("r").alias("other"))
    return (filed.join(met, "r").join(near, "other").where("word <> near and levenshtein(word, near, 1) = 1")
            .select("word", "n", "near", "near_n"))


def groups(docs: DataFrame, times: int = TIMES, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of the vocabulary."""
    words = stored(vocabulary(occurrences(docs, LEAST_CHARS)))
    # The code points of a word sort like its UTF-8 bytes; of equal counts the smallest word is to win.
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near"))
    found = near_words(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = F.expr(f"-best.m >= {times} * n")
    forms = stored(words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n")))
    # Pointer doubling over the words that have a form; whoever has none is a root and stays one.
    roots = forms.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        roots = stored(roots)
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return forms.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame) -> DataFrame:
    """The columns of the query."""
    return groups(docs).select("word", "form", "root", "n", "n_near", "form_n")
