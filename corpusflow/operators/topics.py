"""FIND-7, REL-14, STR-18: claims of a document packed into prompts of a bounded number of tokens.

A document whose claims fit one prompt is one pack. Beyond that, claims meet by topic: each goes to the packs of its two
rarest words that another claim of the document has too, and a topic is cut into packs by a running total of tokens. So
a document's prompts grow with its claims and not with their square, and claims without a word in common never meet.
A claim that fills half of a prompt's room alone is refused: it comes as a pack of its own, marked.

Documents that a task can hold are packed in one place each (``operators/fold.py``), all others by joins.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions import text as tx
from corpusflow.functions.rows import explode_rows
from corpusflow.operators.conflicts import WORD
from corpusflow.operators.fold import dealt, folded, joined, together
from corpusflow.settings import checkpointed

TOPICS = 2  # packs a claim may go to


def _in_document(room: int, half: int) -> Callable[[list[tuple]], Iterator[tuple]]:
    """The fold of one document: rows (ord, claim, tokens, words, flat) in the order of ord and claim."""

    def packs(rows: list[tuple]) -> Iterator[list[tuple]]:
        rest = [r for r in rows if r[2] is not None and r[2] <= half]
        if any(words for _, _, _, words, _ in rest):
            named = [words.split(" ") if words else [] for _, _, _, words, _ in rest]
        else:  # no claim of the document has a word of letters
            named = [list(dict.fromkeys(flat.split(" "))) for _, _, _, _, flat in rest]
        df = Counter(w for words in named for w in words)
        common = defaultdict(list)
        for (ord_, *_), words in zip(rest, named):
            common[ord_] += [(df[w], w) for w in words if df[w] > 1]
        rarest = {ord_: sorted(found)[:TOPICS] for ord_, found in common.items()}
        spent, sets = Counter(), defaultdict(list)
        for ord_, claim, tokens, _, _ in rest:
            for _, topic in rarest[ord_]:
                sets[topic, spent[topic] // half].append((ord_, claim))
                spent[topic] += tokens
        yield from sets.values()

    def fold(rows: list[tuple]) -> Iterator[tuple]:
        tokens = [r[2] for r in rows if r[2] is not None]
        fits = sum(tokens) <= room
        once = set()  # claims that share two topics would meet twice
        for pack in ([[r[:2] for r in rows]] if fits else packs(rows)) if tokens else ():
            if len(pack) > 1:
                ords, texts = zip(*pack)
                if (ords, texts) not in once:
                    once.add((ords, texts))
                    yield list(ords), list(texts), False
        for ord_, claim, n, _, _ in () if fits else rows:
            if n is not None and n > half:
                yield [ord_], [claim], True

    return fold


def _by_documents(claims: DataFrame, room: int, half: int) -> DataFrame:
    """Packs of documents that a task can hold."""
    rows = together(claims.select("doc_id", "ord", "claim").where("doc_id is not null"), "claim")
    rows = rows.select("doc_id", "ord", "claim", (tx.estimate_tokens("claim") + 1).cast("long").alias("tokens"),
                       tx.normalize_for_match("claim").alias("flat"))
    rows = rows.select("doc_id", "ord", "claim", "tokens",
                       joined(F.array_distinct(F.regexp_extract_all("flat", F.lit(WORD), F.lit(0)))).alias("words"), "flat")
    rows = rows.select("doc_id", "ord", "claim", "tokens", "words", F.when(F.col("words") == "", F.col("flat")).alias("flat"))
    kind = claims.schema
    schema = T.StructType([
        T.StructField("doc_id", kind["doc_id"].dataType), T.StructField("ords", T.ArrayType(kind["ord"].dataType)),
        T.StructField("claims", T.ArrayType(T.StringType())), T.StructField("refused", T.BooleanType())])
    return folded(rows, _in_document(room, half), schema, lambda row: sum(len(c or "") for c in row[1]))


def claim_packs(claims: DataFrame, room: int, sizes: DataFrame | None = None) -> DataFrame:
    """(doc_id, ords, claims, refused): claims(doc_id, ord, claim) in packs of at most ``room`` tokens.

    Claims are read twice, for their length first, unless ``sizes`` says how long the documents are: (doc_id, chars).
    """
    half = max(room // 2, 1)
    few, many = dealt(claims, "claim", sizes)
    packs = _by_documents(few, room, half)
    return packs if many is None else packs.unionByName(_by_joins(many, room, half))


def _by_joins(claims: DataFrame, room: int, half: int) -> DataFrame:
    """Packs of documents of any length."""
    # The claims are read once, and their words once; all that follows reads what is stored.
    rows = checkpointed(claims.select("doc_id", "ord", "claim", (tx.estimate_tokens("claim") + 1).cast("long").alias("tokens")))
    size = rows.groupBy("doc_id").agg(F.sum("tokens").alias("total"))
    rows = checkpointed(rows.join(size, "doc_id"))
    fits = rows.where(F.col("total") <= room).select("doc_id", "ord", "claim", F.lit("").alias("topic"), F.lit(0).cast("long").alias("pack"))
    rest = rows.where((F.col("total") > room) & (F.col("tokens") <= half))
    flat = tx.normalize_for_match("claim")
    words = F.array_distinct(F.regexp_extract_all(flat, F.lit(WORD), F.lit(0)))
    read = checkpointed(rest.select("doc_id", "ord", words.alias("words")))
    # Where no claim of a document has a word of letters, its claims meet by what stands between blanks.
    worded = read.where(F.size("words") > 0).select("doc_id").distinct()
    plain = rest.join(worded, "doc_id", "left_anti").select("doc_id", "ord", F.array_distinct(F.split(flat, " ", -1)).alias("words"))
    named = explode_rows(read.unionByName(plain), "words", "_at", "word", "doc_id", "ord").drop("_at")
    common = named.groupBy("doc_id", "word").agg(F.count("*").alias("df")).where("df > 1")
    rarest = (named.join(common, ["doc_id", "word"]).groupBy("doc_id", "ord")
              .agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "word"))), 1, TOPICS).alias("t")))
    topics = rest.join(rarest.select("doc_id", "ord", F.explode("t").alias("t")), ["doc_id", "ord"]).withColumn("topic", F.col("t.word"))
    before = F.sum("tokens").over(Window.partitionBy("doc_id", "topic").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    pack = F.floor(F.coalesce(before, F.lit(0)) / half).cast("long")
    packed = topics.select("doc_id", "ord", "claim", "topic", pack.alias("pack"))
    sets = fits.unionByName(packed).groupBy("doc_id", "topic", "pack").agg(F.array_sort(F.collect_list(F.struct("ord", "claim"))).alias("c"))
    # Claims that share two topics would meet twice.
    once = sets.where(F.size("c") > 1).select("doc_id", F.col("c.ord").alias("ords"), F.col("c.claim").alias("claims")).distinct()
    refused = rows.where((F.col("total") > room) & (F.col("tokens") > half)).select(
        "doc_id", F.array("ord").alias("ords"), F.array("claim").alias("claims"))
    return once.withColumn("refused", F.lit(False)).unionByName(refused.withColumn("refused", F.lit(True)))


def known_findings(packs: DataFrame, findings: DataFrame, room: int) -> DataFrame:
    """packs with ``known``: the findings one of whose sides is a claim of the pack, first ones first, within ``room``.

    Whether there are any findings is asked first, so findings that are dear to make should be stored.
    """
    if findings.isEmpty():
        kind = T.ArrayType(T.StructType([findings.schema[c] for c in ("ord", "statement_a", "statement_b", "explanation")]), False)
        return packs.withColumn("known", F.lit(None).cast(kind))
    sides = findings.select("doc_id", F.explode(F.array_distinct(F.array("statement_a", "statement_b"))).alias("claim"),
                            F.struct("ord", "statement_a", "statement_b", "explanation").alias("f"))
    met = (packs.select("doc_id", "ords", F.explode(F.array_distinct("claims")).alias("claim"))
           .join(sides, ["doc_id", "claim"]).select("doc_id", "ords", "f").distinct())
    cost = tx.estimate_tokens(F.concat_ws(" ", "f.statement_a", "f.statement_b", "f.explanation")) + 6
    spent = F.sum(cost).over(Window.partitionBy("doc_id", "ords").orderBy("f.ord").rowsBetween(Window.unboundedPreceding, 0))
    listed = met.withColumn("spent", spent).where(F.col("spent") <= room)
    return packs.join(listed.groupBy("doc_id", "ords").agg(F.array_sort(F.collect_list("f")).alias("known")), ["doc_id", "ords"], "left")
