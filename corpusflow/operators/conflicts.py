"""JOIN-9: statements of one document that give different numbers for much the same wording.

A set-similarity join with a threshold. A statement is its set of words, its units and its numbers:

* Statements of equal words and units are one wording. Its first statement stands for it; every further value is
  reported once, against the first, so a wording that fills a third of the rows is never paired with itself.
* Two wordings are alike when the words they share weigh at least ``theta`` per cent of the lighter one. A word weighs
  the bits of (wordings + 16) / (wordings of the document that have it), so filler weighs little. Each wording looks
  for partners by its rarest words only: without one of those, what is left of it weighs less than ``theta``. So a
  price list of a thousand lines, which share all but the article's name, makes no pairs.
* Numbers are compared one by one: the k-th number of a unit with the other statement's k-th number of that unit.
  Digits are joined by thousands grouping only; numbers without a common unit are about different things.

Documents that a task can hold are worked on in one place each (``operators/fold.py``), all others by joins.

Statements without a word or without a number take no part; a leading list number is not read as a value. Claims are
(doc_id, ord, claim); of rows that repeat a statement, the one of the smallest ord is reported.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions import text as tx
from corpusflow.operators.fold import dealt, folded, joined, together
from corpusflow.settings import checkpointed

THETA = 35   # per cent of the lighter wording's weight
SMOOTH = 16  # keeps the weights of short documents close together
# Characters of the claims of a document that a task compares alone; pairs may grow with their square.
TASK_CHARS = 400_000

LIST_NUMBER = r"^\d+[.)] "
# A value, then its unit: the word that follows at once, after one space or after one hyphen.
NUMBER = r"(\d{1,3}(?: \d{3})+(?![0-9A-Za-z_])|\d(?:[\d.,:]*\d)?)(?:[ -]?(\p{L}[\p{L}']*))?"
WORD = r"\p{L}[\p{L}']+"


def _read(claims: DataFrame) -> DataFrame:
    """(doc_id, ord, claim, nums, words): what each claim says."""
    plain = F.regexp_replace(tx.normalize_for_match("claim"), LIST_NUMBER, "")
    df = claims.select("doc_id", "ord", "claim", plain.alias("_t"))
    values, units = (F.regexp_extract_all("_t", F.lit(NUMBER), F.lit(i)) for i in (1, 2))
    nums = F.array_sort(F.transform(F.arrays_zip(units.alias("unit"), values.alias("value")), lambda n, i: F.struct(
        n["unit"].alias("unit"), i.alias("pos"), F.translate(n["value"], " ", "").alias("value"))))
    return df.select("doc_id", "ord", "claim", nums.alias("nums"),
                     F.array_sort(F.array_distinct(F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))).alias("words"))


def _statements(claims: DataFrame) -> DataFrame:
    """(doc_id, wid, vid, ord, claim, words, nums): one row for each claim that has words and numbers."""
    df = _read(claims).where((F.size("nums") > 0) & (F.size("words") > 0))
    return df.select("doc_id", F.xxhash64("words", "nums.unit").alias("wid"), F.xxhash64("nums.value").alias("vid"),
                     "ord", "claim", "words", "nums")


def _weighted(first: DataFrame) -> DataFrame:
    """(doc_id, wid, word, weight, below, total): the words of each wording; ``below`` is the weight of the word and
    of all lighter ones."""
    rows = first.select("doc_id", "wid", F.explode("words").alias("word"))
    common = rows.groupBy("doc_id", "word").agg(F.count("*").alias("df"))
    number = first.groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = (rows.join(common, ["doc_id", "word"]).join(number, "doc_id")
            .withColumn("weight", F.expr(f"length(bin((n + {SMOOTH}) div df))")))
    own = Window.partitionBy("doc_id", "wid")
    rising = own.orderBy("weight", "word").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("doc_id", "wid", "word", "weight", F.sum("weight").over(rising).alias("below"),
                       F.sum("weight").over(own).alias("total"))


def alike_wordings(first: DataFrame, theta: int = THETA) -> DataFrame:
    """(doc_id, one, other): ids of wordings of a document that share enough; first is (doc_id, wid, words)."""
    weighted = checkpointed(_weighted(first))
    rare = weighted.where(F.col("below") * 100 >= F.col("total") * theta).alias("s")
    lighter = "s.total < l.total or (s.total = l.total and s.wid < l.wid)"
    met = (rare.join(weighted.alias("l"), F.expr(f"s.doc_id = l.doc_id and s.word = l.word and ({lighter})"))
           .select("s.doc_id", F.col("s.wid").alias("one"), F.col("l.wid").alias("other")).distinct())
    sets = weighted.groupBy("doc_id", "wid").agg(F.collect_list(F.struct("word", "weight")).alias("w"), F.max("total").alias("total"))
    both = (met.join(sets.select("doc_id", F.col("wid").alias("one"), F.col("w").alias("w1"), "total"), ["doc_id", "one"])
            .join(sets.select("doc_id", F.col("wid").alias("other"), F.col("w").alias("w2")), ["doc_id", "other"]))
    shared = F.aggregate(F.array_intersect("w1", "w2"), F.lit(0).cast("long"), lambda s, x: s + x["weight"])
    return both.where(shared * 100 >= F.col("total") * theta).select("doc_id", "one", "other")


def _explanation(a: Column, b: Column, unit: Column) -> Column:
    return F.trim(F.concat_ws(" ", a, F.lit("/"), b, unit))


def _within(said: DataFrame, first: DataFrame) -> DataFrame:
    """Further values of a wording against its first statement; their units are the same, one by one."""
    other = first.select("doc_id", "wid", F.col("vid").alias("v0"), F.col("ord").alias("ord_a"),
                         F.col("claim").alias("statement_a"), F.col("nums").alias("n0"))
    met = said.join(other, ["doc_id", "wid"]).where("vid <> v0")
    differ = F.filter(F.arrays_zip(F.col("n0").alias("a"), F.col("nums").alias("b")), lambda z: z["a"]["value"] != z["b"]["value"])
    return (met.withColumn("d", F.get(differ, F.lit(0))).where("d is not null")
            .select("doc_id", "ord_a", F.col("ord").alias("ord_b"), "statement_a", F.col("claim").alias("statement_b"),
                    _explanation(F.col("d.a.value"), F.col("d.b.value"), F.col("d.a.unit")).alias("explanation")))


def _between(first: DataFrame, pairs: DataFrame) -> DataFrame:
    """First statements of wordings that are alike, where some number differs from its counterpart."""
    place = Window.partitionBy("doc_id", "wid", "n.unit").orderBy("n.pos")
    numbers = (first.select("doc_id", "wid", "ord", F.explode("nums").alias("n"))
               .select("doc_id", "wid", "ord", "n.unit", "n.value", F.row_number().over(place).alias("k")))
    numbers = checkpointed(numbers)
    one = numbers.select("doc_id", F.col("wid").alias("one"), F.col("ord").alias("o1"), "unit", "k", F.col("value").alias("v1"))
    other = numbers.select("doc_id", F.col("wid").alias("other"), F.col("ord").alias("o2"), "unit", "k", F.col("value").alias("v2"))
    met = pairs.join(one, ["doc_id", "one"]).join(other, ["doc_id", "other", "unit", "k"]).where("v1 <> v2")
    swap = F.col("o1") > F.col("o2")
    a, b = F.when(swap, F.col("v2")).otherwise(F.col("v1")), F.when(swap, F.col("v1")).otherwise(F.col("v2"))
    found = met.groupBy("doc_id", F.least("o1", "o2").alias("ord_a"), F.greatest("o1", "o2").alias("ord_b")).agg(
        F.min(F.struct("unit", "k", a.alias("a"), b.alias("b"))).alias("d"))
    for end in ("a", "b"):  # texts join the pairs last
        found = found.join(first.select("doc_id", F.col("ord").alias(f"ord_{end}"), F.col("claim").alias(f"statement_{end}")),
                           ["doc_id", f"ord_{end}"])
    return found.select("doc_id", "ord_a", "ord_b", "statement_a", "statement_b",
                        _explanation(F.col("d.a"), F.col("d.b"), F.col("d.unit")).alias("explanation"))


def _alike(first: list[tuple], theta: int) -> Iterator[tuple[int, int]]:
    """alike_wordings in one document: places in ``first`` (…, words) of a lighter wording and another that is like it.

    ``first`` is sorted by the id of the wording.
    """
    sets = [f[-1].split(" ") for f in first]
    df = Counter(w for words in sets for w in words)
    weight = {w: ((len(first) + SMOOTH) // n).bit_length() for w, n in df.items()}
    total = [sum(map(weight.__getitem__, words)) for words in sets]
    order = sorted(range(len(first)), key=total.__getitem__)  # stable: by the id where totals are equal
    having = defaultdict(list)
    for at, i in enumerate(order):
        for w in sets[i]:
            having[w].append(at)
    sets = [frozenset(words) for words in sets]
    for at, i in enumerate(order):
        met, below = set(), 0
        for w in sorted(sets[i], key=lambda w: (weight[w], w)):
            below += weight[w]
            if below * 100 >= total[i] * theta:
                places = having[w]
                met.update(places[bisect_right(places, at):])
        for j in map(order.__getitem__, met):
            if sum(map(weight.__getitem__, sets[i] & sets[j])) * 100 >= total[i] * theta:
                yield i, j


def _in_document(theta: int) -> Callable[[list[tuple]], Iterator[tuple]]:
    """The fold of one document: rows (ord, claim, words, units, values, wid, vid) in the order of ord and claim."""

    def said_as(a: str, b: str, unit: str) -> str:
        return f"{a} / {b} {unit}".strip(" ")

    def numbered(units: list[str], values: list[str]) -> dict:
        at, out = 0, {}
        for k, (unit, value) in enumerate(zip(units, values)):
            at = k if k == 0 or units[k - 1] != unit else at
            out[unit, k - at] = value
        return out

    def fold(rows: list[tuple]) -> Iterator[tuple]:
        said, first = {}, {}
        for ord_, claim, words, units, values, wid, vid in rows:
            if words and values and (wid, vid) not in said:
                said[wid, vid] = one = (ord_, vid, claim, units.split(" "), values.split(" "), words)
                first[wid] = one if wid not in first else min(first[wid], one, key=lambda s: s[:2])
        for (wid, vid), (ord_, _, claim, _, values, _) in said.items():
            of, v0, statement, units, values0, _ = first[wid]
            differ = next((n for n in zip(values0, values, units) if n[0] != n[1]), None)
            if vid != v0 and differ:
                yield of, ord_, statement, claim, said_as(*differ)
        first = [first[wid] for wid in sorted(first)]
        numbers = [numbered(f[3], f[4]) for f in first]
        texts = defaultdict(list)
        for f in first:
            texts[f[0]].append(f[2])
        best = {}  # only where several statements have one ord
        for i, j in _alike(first, theta):
            if first[i][0] > first[j][0]:
                i, j = j, i
            other = numbers[j]
            differ = next(((key, v, other[key]) for key, v in numbers[i].items() if other.get(key, v) != v), None)
            if differ is None:
                continue
            (unit, k), a, b = differ
            o1, o2 = first[i][0], first[j][0]
            if len(texts) == len(first):
                yield o1, o2, first[i][2], first[j][2], said_as(a, b, unit)
            else:
                best[o1, o2] = min(best.get((o1, o2), (unit, k, a, b)), (unit, k, a, b))
        for (o1, o2), (unit, _, a, b) in best.items():
            for one in texts[o1]:
                for other in texts[o2]:
                    yield o1, o2, one, other, said_as(a, b, unit)

    return fold


def _by_documents(claims: DataFrame, theta: int) -> DataFrame:
    """Conflicts of documents that a task can hold."""
    rows = _read(together(claims.select("doc_id", "ord", "claim").where("doc_id is not null and ord is not null"), "claim"))
    rows = rows.select("doc_id", "ord", "claim", joined(F.col("words")).alias("words"), joined(F.col("nums.unit")).alias("units"),
                       joined(F.col("nums.value")).alias("values"), F.xxhash64("words", "nums.unit").alias("wid"),
                       F.xxhash64("nums.value").alias("vid"))
    kind = claims.schema
    schema = T.StructType([
        T.StructField("doc_id", kind["doc_id"].dataType), T.StructField("ord_a", kind["ord"].dataType), T.StructField("ord_b", kind["ord"].dataType),
        T.StructField("statement_a", T.StringType()), T.StructField("statement_b", T.StringType()), T.StructField("explanation", T.StringType())])
    return folded(rows, _in_document(theta), schema, lambda row: len(row[2]) + len(row[3]))


def _by_joins(claims: DataFrame, theta: int) -> DataFrame:
    """Conflicts of documents of any length."""
    rows = _statements(claims).groupBy("doc_id", "wid", "vid").agg(F.min(F.struct("ord", "claim", "nums", "words")).alias("s"))
    said = checkpointed(rows.select("doc_id", "wid", "vid", "s.*"))
    first = said.groupBy("doc_id", "wid").agg(F.min(F.struct("ord", "vid", "claim", "nums", "words")).alias("s"))
    first = checkpointed(first.select("doc_id", "wid", "s.*"))
    return _within(said, first).unionByName(_between(first, alike_wordings(first, theta)))


def conflict_candidates(claims: DataFrame, theta: int = THETA, sizes: DataFrame | None = None) -> DataFrame:
    """JOIN-9: (doc_id, ord_a, ord_b, statement_a, statement_b, explanation), ord_a < ord_b.

    Claims are read twice, for their length first, unless ``sizes`` says how long the documents are: (doc_id, chars).
    """
    few, many = dealt(claims, "claim", sizes, TASK_CHARS)
    found = _by_documents(few, theta)
    return found if many is None else found.unionByName(_by_joins(many, theta))
