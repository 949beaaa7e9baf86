"""Documents folded in one place: the same rows as the joins, after one exchange and with nothing stored in between."""

import random

from pyspark.sql import functions as F

from corpusflow.operators import conflicts, dedupe, fold, topics


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange" in line for line in plan.split("\n"))


def bag(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


def claims(spark, seed, docs=12, each=40):
    """Statements of few words and numbers, some of them twice; document 3 has several under one ord, some have no id."""
    rng = random.Random(seed)
    units = ["", "kun", "so'm", "soat"]
    rows = []
    for d in range(docs):
        for i in range(rng.randint(1, each)):
            words = [rng.choice("abcdefgh") * 3 for _ in range(rng.randint(0, 5))]
            numbers = [f"{rng.randint(1, 4)} {rng.choice(units)}".strip() for _ in range(rng.randint(0, 3))]
            text = " ".join(rng.sample(words + numbers, len(words + numbers)))
            rows.append((None if d == 1 else d, i // 2 if d == 3 else i, None if rng.random() < 0.02 else text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id int, ord long, claim string")


def test_conflicts_in_documents_equal_the_joins(spark):
    for seed in range(3):
        rows = claims(spark, seed)
        want = bag(conflicts._by_joins(rows, conflicts.THETA))
        assert bag(conflicts.conflict_candidates(rows)) == want and len(want) > 50
        # Some documents are longer than a task holds.
        sizes = rows.select("doc_id", F.when(F.col("doc_id") % 2 == 0, conflicts.TASK_CHARS).otherwise(1).alias("chars"))
        assert bag(conflicts.conflict_candidates(rows, sizes=sizes)) == want


def test_conflicts_exchange_claims_once(spark):
    rows = claims(spark, 5).where("doc_id is not null")
    assert exchanges(conflicts.conflict_candidates(rows)) == 1


def test_documents_are_dealt_by_their_length(spark):
    rows = spark.createDataFrame([(1, 0, "x" * 5), (1, 1, "y" * 6), (2, 0, "z" * 10), (None, 0, "a")], "doc_id int, ord int, t string")
    few, many = fold.dealt(rows, "t", most=10)
    assert bag(few) == ["(2, 0, 'zzzzzzzzzz')"] and many.count() == 3
    assert fold.dealt(rows.where("doc_id = 2"), "t", most=10)[1] is None


def packs_bag(df):
    return bag(df.select("doc_id", "ords", "claims", "refused"))


def test_packs_of_documents_equal_the_joins(spark):
    for seed in range(3):
        rows = claims(spark, seed)
        # Document 5 has no word of letters; document 7 has a claim that is too long for a prompt.
        rows = rows.withColumn("claim", F.when(F.col("doc_id") == 5, F.regexp_replace("claim", r"\p{L}", "7")).when(
            (F.col("doc_id") == 7) & (F.col("ord") == 0), F.repeat(F.lit("aaa "), 50)).otherwise(F.col("claim")))
        for room in (30, 100):
            # Claims of one ord and different texts come in no order of their own.
            some = rows.where("doc_id is null or doc_id <> 3")
            want = packs_bag(topics._by_joins(some, room, room // 2))
            assert packs_bag(topics.claim_packs(some, room)) == want and len(want) > 20
            sizes = some.select("doc_id", F.when(F.col("doc_id") % 2 == 0, fold.FOLD_CHARS).otherwise(1).alias("chars"))
            assert packs_bag(topics.claim_packs(some, room, sizes)) == want


def test_packs_exchange_claims_once(spark):
    none = spark.createDataFrame([], "doc_id int, ord long, statement_a string, statement_b string, explanation string")
    rows = claims(spark, 5).where("doc_id is not null")
    known = topics.known_findings(topics.claim_packs(rows, 100), none, 50)
    assert exchanges(known) == 1 and known.where("known is null").count() == known.count() > 0
    some = spark.createDataFrame([(d, 0, c, "other", "x") for d, c in rows.where("claim is not null").select("doc_id", "claim").limit(5).collect()], none.schema)
    assert topics.known_findings(topics.claim_packs(rows, 100), some, 50).schema["known"].dataType == known.schema["known"].dataType


def quotes(spark, seed):
    """Cuts of a few texts; documents 1 and 4 have no id or several claims under one ord."""
    rng = random.Random(seed)
    rows = []
    for d in range(8):
        text = " ".join("".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(40))
        for i in range(rng.randint(1, 60)):
            at = rng.randint(0, len(text) - 10)
            cut = text[at:at + rng.randint(8, 40)]
            rows.append((None if d == 1 else d, i // 2 if d == 4 else i, None if rng.random() < 0.02 else cut.upper() if rng.random() < 0.3 else cut))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id int, ord long, claim string")


def test_claims_kept_in_documents_equal_the_joins(spark):
    for seed in range(3):
        rows = quotes(spark, seed)
        want = bag(dedupe._claims_by_joins(rows))
        assert bag(dedupe.dedupe_claims(rows)) == want and 40 < len(want) < rows.count() - 20
        sizes = rows.select("doc_id", F.when(F.col("doc_id") % 2 == 0, dedupe.TASK_CHARS + 1).otherwise(1).alias("chars"))
        assert bag(dedupe.dedupe_claims(rows, sizes)) == want


def test_claims_are_exchanged_once(spark):
    rows = quotes(spark, 5).where("doc_id is not null")
    assert exchanges(dedupe.dedupe_claims(rows)) == 1


def test_claims_of_a_long_document_are_folded_in_proportion(spark):
    """Every claim is looked up by its beginnings, not compared with each kept one."""
    rows = [(i, f"claim number {i} of a long document", f"claim number {i} of a long document") for i in range(20_000)]
    rows += [(20_000 + i, "", f"number {i} of a long") for i in range(0, 20_000, 100)]
    assert [r[0] for r in dedupe._first_texts(rows)] == list(range(20_000))
