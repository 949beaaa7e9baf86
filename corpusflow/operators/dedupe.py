"""JOIN-8, FIND-4..6, ARR-1: keep-first removal of near-duplicates inside a document.

The rule is sequential (an item goes when an earlier *kept* item matches it), but only
matching pairs interact.  So exact copies are folded first.  A document of few findings is
compared and folded in a row of its own, and so are the claims of a document that a task can
hold (``operators/fold.py``).  For all others, matching pairs are found by an
equi-join on each text's rarest anchor, and the keep-first rule is one ordered pass over the
pairs (``graph``); no such document's items are gathered in one place.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions import text as tx
from corpusflow.functions.rows import explode_rows
from corpusflow.operators.fold import dealt, folded, together
from corpusflow.operators.graph import dropped_by_first
from corpusflow.settings import MIN_QUOTE_CHARS, checkpointed


def pair_key(a: Column, b: Column) -> Column:
    """FIND-4 on normalised sides."""
    return F.concat_ws("||", F.least(a, b), F.greatest(a, b))


def is_meaningful(a: Column, b: Column, explanation: Column) -> Column:
    """REL-9 on normalised sides."""
    # Explanations that take the finding back.
    denials = ("do not contradict", "identical", "not contradict", "ziddiyat emas", "bir xil")
    expl = F.lower(F.coalesce(explanation, F.lit("")))
    denied = expl.rlike("|".join(denials))
    return (a != "") & (b != "") & (a != b) & ~denied


def _either_contains(x: Column, y: Column) -> Column:
    return F.contains(x, y) | F.contains(y, x)


def _power(n: Column) -> Column:
    """Largest power of two not above n."""
    return F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double")))).cast("int")


# How a text of one or two words is filed: by the longer one of its two words (the second from its start, the first
# from its end), or by the characters of its only word.
SECOND, FIRST, SINGLE = "second", "first", "single"

# A text of three words or more is filed by its rarest inner word, if no more texts of the document have that word.
FEW = 8
EDGE = 32  # characters of a word that may be cut off which are looked at

# Items of a document that are compared in one row, each with each.
ROW_ITEMS = 100
# Characters of the claims of a document that a task looks through for each of them.
TASK_CHARS = 1_000_000


def _word(i: Column | int) -> Column:
    return F.get(F.col("words"), F.lit(i) if isinstance(i, int) else i)


def _key(kind: str, i: Column, n: Column) -> Column:
    """Hash of n characters of the word (or the text) at position i, with the character next to them."""
    before, after, one = F.right(_word(i - 1), F.lit(1)), F.left(_word(i + 1), F.lit(1)), F.lit(1)
    if kind == SECOND:
        return F.when(F.length(_word(i)) >= n, F.xxhash64(n, before, F.left(_word(i), n)))
    if kind == FIRST:
        return F.when(F.length(_word(i)) >= n, F.xxhash64(n, F.right(_word(i), n), after))
    return F.xxhash64(n, F.substring(F.col("text"), i + 1, n))


def _keys(kind: str) -> Column:
    """All keys of a text under which a text inside it may be filed, for the ``sizes`` of its document."""
    words, chars = F.size("words"), F.length("text")
    first = {SECOND: 1, FIRST: 0, SINGLE: 0}[kind]

    def of(n: Column) -> Column:
        last = {SECOND: words - 1, FIRST: words - 2, SINGLE: chars - n}[kind]
        keys = F.transform(F.sequence(F.lit(first), last), lambda i: _key(kind, i, n))
        return F.when(last >= first, keys).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(F.array_compact(F.flatten(F.transform("sizes", of))))


def _own_key(kind: str) -> Column:
    return _key(kind, F.lit({SECOND: 1, FIRST: 0, SINGLE: 0}[kind]), F.col("size"))


def _meet(texts: DataFrame, keys: Column, filed: DataFrame, anchor: Column) -> DataFrame:
    """Items that share an anchor; only ids and hashes are exchanged."""
    looked = explode_rows(texts, keys, "_at", "anchor", "doc_id", F.col("ord").alias("x"))
    stored = filed.select("doc_id", anchor.alias("anchor"), F.col("ord").alias("y"))
    met = looked.join(stored, ["doc_id", "anchor"]).where(F.col("x") != F.col("y"))
    return met.select("doc_id", F.least("x", "y").alias("first"), F.greatest("x", "y").alias("second"))


def _edges_of(words: Column) -> Column:
    """Keys of neighbouring words, of which the first or the second one may be cut off at its outer end."""
    places = F.sequence(F.lit(0), F.size(words) - 2)

    def both(i: Column) -> Column:
        one, other = F.get(words, i), F.get(words, i + 1)
        ends = F.transform(F.sequence(F.lit(1), F.least(F.length(one), F.lit(EDGE))), lambda n: F.xxhash64(F.lit("<"), F.right(one, n), other))
        starts = F.transform(F.sequence(F.lit(1), F.least(F.length(other), F.lit(EDGE))), lambda n: F.xxhash64(F.lit(">"), one, F.left(other, n)))
        return F.concat(ends, starts)
    return F.when(F.size(words) > 1, F.array_distinct(F.flatten(F.transform(places, both)))).otherwise(F.array().cast("array<bigint>"))


def _own_edges(words: Column) -> Column:
    """The keys under which a text of three words or more can be met: all its neighbours but for the outer ends."""
    n = F.size(words)
    inner = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
        F.lit("<"), F.right(F.get(words, i), F.least(F.length(F.get(words, i)), F.lit(EDGE))), F.get(words, i + 1)))
    last = F.get(words, n - 1)
    return F.array_distinct(F.concat(inner, F.array(F.xxhash64(
        F.lit(">"), F.get(words, n - 2), F.left(last, F.least(F.length(last), F.lit(EDGE)))))))


def _rarest(options: DataFrame, looks: DataFrame) -> DataFrame:
    """(doc_id, ord, tid, anchor, df): the option of each text that the fewest texts of its document have."""
    common = looks.groupBy("doc_id", "anchor").agg(F.count("*").alias("df"))
    best = options.join(common, ["doc_id", "anchor"]).groupBy("doc_id", "ord", "tid").agg(F.min(F.struct("df", "anchor")).alias("b"))
    return best.select("doc_id", "ord", "tid", "b.anchor", "b.df")


def _met(anchors: DataFrame, looks: DataFrame) -> DataFrame:
    met = anchors.select("doc_id", "anchor", F.col("ord").alias("y")).join(
        looks.select("doc_id", "anchor", F.col("ord").alias("x")), ["doc_id", "anchor"]).where(F.col("x") != F.col("y"))
    return met.select("doc_id", F.least("x", "y").alias("first"), F.greatest("x", "y").alias("second"))


def _by_rarest_words(texts: DataFrame) -> DataFrame:
    """Pairs of a text of three words or more and the texts that have its rarest anchor.

    Its inner words are whole words of a text that contains it. Where they are all common (lines of one form that differ
    at an end only), two neighbouring words are the anchor, of which the outer one may be cut off. So a text makes
    keys in proportion to its length, and meets about as many texts as share its rarest piece.
    """
    looks = checkpointed(explode_rows(texts, F.transform(F.array_distinct("words"), lambda w: F.xxhash64(w)), "_at", "anchor", "doc_id", "ord"))
    long = texts.where(F.size("words") > 2).withColumn("tid", F.xxhash64("text"))  # an item may have several texts
    inner = F.transform(F.array_distinct(F.slice(F.col("words"), F.lit(2), F.size("words") - 2)), lambda w: F.xxhash64(w))
    filed = checkpointed(_rarest(explode_rows(long, inner, "_at", "anchor", "doc_id", "ord", "tid"), looks))
    rare, common = filed.where(F.col("df") <= FEW), filed.where(F.col("df") > FEW)
    options = checkpointed(explode_rows(long.join(common, ["doc_id", "ord", "tid"], "left_semi"), _own_edges(F.col("words")),
                                        "_at", "anchor", "doc_id", "ord", "tid"))
    edges = explode_rows(texts.join(options.select("doc_id").distinct(), "doc_id", "left_semi"), _edges_of(F.col("words")),
                         "_at", "anchor", "doc_id", "ord")
    seen = checkpointed(edges.join(options.select("doc_id", "anchor").distinct(), ["doc_id", "anchor"], "left_semi"))
    return _met(rare, looks).unionByName(_met(_rarest(options, seen), seen))


def candidate_pairs(texts: DataFrame) -> DataFrame:
    """(doc_id, first, second): every pair of items with one text inside another, and few more.

    ``texts`` is (doc_id, ord, text), texts normalised.  Texts of three words or more meet by
    their rarest anchor; texts of one or two words are filed by half or more of a word, and met
    only in documents that have them.
    """
    count = F.size("words")
    longer = F.length(_word(1)) >= F.length(_word(0))
    texts = texts.select("doc_id", "ord", "text", F.split("text", " ", -1).alias("words")).where("text is not null")
    pairs = _by_rarest_words(texts)
    length = F.when(count == 1, F.length("text")).otherwise(F.greatest(F.length(_word(0)), F.length(_word(1))))
    short = (texts.withColumn("kind", F.when(count == 1, SINGLE).when((count == 2) & longer, SECOND).when(count == 2, FIRST))
             .withColumn("size", _power(F.greatest(length, F.lit(1)))))
    for kind in (SECOND, FIRST, SINGLE):
        filed = short.where(F.col("kind") == kind)
        # One short array per document: the distinct lengths of its texts of this kind.
        near = short.join(filed.groupBy("doc_id").agg(F.collect_set("size").alias("sizes")), "doc_id")
        pairs = pairs.unionByName(_meet(near, _keys(kind), filed, _own_key(kind)))
    return pairs.distinct()


def _both(pairs: DataFrame, items: DataFrame, *columns: str) -> DataFrame:
    """Candidate pairs with the columns of either item, suffixed 1 and 2."""
    for end, tag in (("first", "1"), ("second", "2")):
        side = items.select("doc_id", F.col("ord").alias(end), *[F.col(c).alias(c + tag) for c in columns])
        pairs = pairs.join(side, ["doc_id", end])
    return pairs


def containing_pairs(texts: DataFrame) -> DataFrame:
    """Pairs of items of one document where the text of one contains the text of the other."""
    both = _both(candidate_pairs(texts), texts, "text")
    return both.where(_either_contains(F.col("text1"), F.col("text2"))).select("doc_id", "first", "second")


def keep_first(items: DataFrame, edges: DataFrame) -> DataFrame:
    """ARR-1: items (doc_id, ord, …) that survive the rule; edges are (doc_id, first, second), first < second."""
    return items.join(dropped_by_first(edges), ["doc_id", "ord"], "left_anti")


def _first_of(items: DataFrame, *key: str) -> DataFrame:
    """The item with the smallest ord per key; combined before the shuffle."""
    rest = [c for c in items.columns if c not in key]
    return (items.groupBy(*key).agg(F.min_by(F.struct(*rest), "ord").alias("_r"))
            .select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]))


def _sided(findings: DataFrame) -> DataFrame:
    return (findings.withColumn("_a", tx.normalize_for_match("statement_a"))
            .withColumn("_b", tx.normalize_for_match("statement_b")))


def distinct_findings(findings: DataFrame) -> DataFrame:
    """FIND-5, exact stage: meaningful findings, first per document and unordered pair."""
    sided = _sided(findings).where(is_meaningful(F.col("_a"), F.col("_b"), F.col("explanation")))
    return _first_of(sided.withColumn("_key", pair_key(F.col("_a"), F.col("_b"))), "doc_id", "_key").drop("_key")


def _dealt(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of documents that have few, and all others: those of a document without an id or with an ord that repeats as well."""
    sizes = (items.groupBy("doc_id", "ord").agg(F.count("*").alias("c"))
             .groupBy("doc_id").agg(F.sum("c").alias("n"), F.max("c").alias("most")))
    few = checkpointed(sizes.where(F.col("doc_id").isNotNull() & (F.col("n") <= ROW_ITEMS) & (F.col("most") == 1)).select("doc_id"))
    return items.join(few, "doc_id", "left_semi"), items.join(few, "doc_id", "left_anti")


def _rows(items: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, items): the items of a document in their order."""
    return items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", *columns))).alias("items"))


def _kept(items: DataFrame, near: Callable[[Column, Column], Column]) -> DataFrame:
    """ARR-1 inside rows: items that are near no earlier kept one of their document."""
    rest = [c for c in items.columns if c not in ("doc_id", "ord")]
    kept = F.aggregate("items", F.slice("items", 1, 0), lambda kept, x: F.when(
        F.exists(kept, lambda k: near(k, x)), kept).otherwise(F.concat(kept, F.array(x))))
    return explode_rows(_rows(items, *rest), kept, "_at", "_r", "doc_id").select("doc_id", "_r.*").select(*items.columns)


def _near_sides(x: Column, y: Column) -> Column:
    """JOIN-8: the sides of one contain the sides of the other, straight or crossed."""
    return ((_either_contains(x["_a"], y["_a"]) & _either_contains(x["_b"], y["_b"]))
            | (_either_contains(x["_a"], y["_b"]) & _either_contains(x["_b"], y["_a"])))


def _near_pairs(sided: DataFrame) -> DataFrame:
    sides = sided.select("doc_id", "ord", F.explode(F.array("_a", "_b")).alias("text"))
    both = _both(candidate_pairs(sides), sided, "_a", "_b")
    one, other = (F.struct(F.col("_a" + tag).alias("_a"), F.col("_b" + tag).alias("_b")) for tag in ("1", "2"))
    return both.where(_near_sides(one, other)).select("doc_id", "first", "second")


def near_duplicate_pairs(sided: DataFrame) -> DataFrame:
    """JOIN-8: (doc_id, first, second): findings whose sides contain each other, straight or crossed."""
    few, many = _dealt(sided)
    pairs = F.flatten(F.transform("items", lambda x: F.transform(
        F.filter("items", lambda y: (y["ord"] > x["ord"]) & _near_sides(x, y)),
        lambda y: F.struct(x["ord"].alias("first"), y["ord"].alias("second")))))
    found = explode_rows(_rows(few, "_a", "_b"), pairs, "_at", "_p", "doc_id").select("doc_id", "_p.*")
    return found if many.isEmpty() else found.unionByName(_near_pairs(many))


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """FIND-5: (doc_id, ord, statement_a, statement_b, explanation, …) without near-duplicates."""
    few, many = _dealt(checkpointed(distinct_findings(findings)))
    kept = _kept(few, _near_sides)
    if not many.isEmpty():
        kept = kept.unionByName(keep_first(many, _near_pairs(many)))
    return kept.drop("_a", "_b")


def _first_texts(rows: list[tuple]) -> Iterator[tuple]:
    """ARR-1 in one document: of rows (ord, claim, text) in their order, (ord, claim) of those that no earlier kept one contains
    and that contain none."""
    first = {}
    for ord_, claim, text in rows:
        if text is not None and len(text) >= MIN_QUOTE_CHARS:
            first.setdefault(text, (ord_, claim))
    if len({ord_ for ord_, _ in first.values()}) < len(first):
        yield from _first_by_pairs(first)
        return
    # The kept texts: all of them with a line break between them, as a set, and their lengths by how they begin.
    whole, kept, lengths = "", set(), defaultdict(set)

    def contains_kept(text: str) -> bool:
        return any(text[i:i + n] in kept for i in range(len(text) - MIN_QUOTE_CHARS + 1)
                   for n in lengths.get(text[i:i + MIN_QUOTE_CHARS], ()))

    for text, row in first.items():
        if text not in whole and not contains_kept(text):
            whole = f"{whole}\n{text}"
            kept.add(text)
            lengths[text[:MIN_QUOTE_CHARS]].add(len(text))
            yield row


def _first_by_pairs(first: dict[str, tuple]) -> Iterator[tuple]:
    """As _first_texts where several texts have one ord: they stay or go together, as under ``keep_first``."""
    texts, gone = list(first), set()
    near = sorted({(max(x, y), min(x, y)) for i, a in enumerate(texts) for b in texts[:i]
                   if (x := first[a][0]) != (y := first[b][0]) and (a in b or b in a)})
    for later, earlier in near:
        if earlier not in gone and later not in gone:
            gone.add(later)
    yield from (row for row in first.values() if row[0] not in gone)


def _claims_by_documents(claims: DataFrame) -> DataFrame:
    """Claims that stay, of documents that a task can hold."""
    rows = together(claims.select("doc_id", "ord", "claim").where("doc_id is not null and ord is not null"), "claim")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in (claims.schema[c] for c in ("doc_id", "ord", "claim"))])
    rows = rows.select("doc_id", "ord", "claim", tx.normalize_for_match("claim").alias("text"))
    return folded(rows, _first_texts, schema, lambda row: len(row[1]))


def _claims_by_joins(claims: DataFrame) -> DataFrame:
    """Claims that stay, of documents of any length."""
    ready = (claims.withColumn("_n", tx.normalize_for_match("claim"))
             .where(F.length("_n") >= MIN_QUOTE_CHARS))
    many = checkpointed(_first_of(ready, "doc_id", "_n"))
    return keep_first(many, containing_pairs(many.select("doc_id", "ord", F.col("_n").alias("text")))).select("doc_id", "ord", "claim")


def dedupe_claims(claims: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """FIND-6, SORT-4: (doc_id, ord, claim): claims of 12 or more normalised characters, none
    containing an earlier kept one or contained in it.

    Claims are read twice, for their length first, unless ``sizes`` says how long the documents are: (doc_id, chars).
    """
    few, many = dealt(claims, "claim", sizes, TASK_CHARS)
    kept = _claims_by_documents(few)
    return kept if many is None else kept.unionByName(_claims_by_joins(many))
