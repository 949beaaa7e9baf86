import random

from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.functions.model_json import decode_references, encode_references, parse_analysis
from corpusflow.operators.conflicts import alike_wordings, conflict_candidates
from corpusflow.operators import dedupe, graph
from corpusflow.operators.dedupe import (
    candidate_pairs, dedupe_claims, dedupe_findings, distinct_findings, keep_first, near_duplicate_pairs)
from corpusflow.operators.findings import (
    filter_grounded, parse_outputs, report, summary_grounded)

# The sample statements, answers and expected findings below are golden inputs of the data contract.
SCHEMA = "doc_id int, ord long, statement_a string, statement_b string, explanation string"


def parsed(spark, *raws):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    return [r["p"] for r in df.select("i", parse_analysis(F.col("raw")).alias("p")).orderBy("i").collect()]


def test_parse(spark):
    snake = '{"summary":"ok","contradictions":[{"statement_a":"A gap gap","statement_b":"B gap gap","explanation":"x"}],"key_claims":["claim claim claim"," kurz "]}'
    camel = '{"summary":"ok","contradictions":[{"statementA":"A gap gap","statementB":"B gap gap","explanation":"x"}],"keyClaims":["claim claim claim"]}'
    fenced = '```json\n{"summary":"Ichki ziddiyat topilmadi.","contradictions":[],"key_claims":[]}\n```'
    odd = '{"summary":"s","contradictions":[{"statement_a":5,"statementA":"x","statement_b":"y"},{"statement_a":" ","statement_b":"y"},"z"],"key_claims":{"a":1}}'
    got = parsed(spark, snake, camel, fenced, odd, '{"foo":1}', "not json at all", '{"summary":5,"contradictions":[]}',
                 '{"summary":"a","contradictions":{}}', "{'summary':'a','contradictions':[]}", None)
    assert [len(p["contradictions"]) for p in got[:4]] == [1, 1, 0, 0]
    assert got[0]["key_claims"] == ["claim claim claim"] and got[1]["key_claims"] == ["claim claim claim"]
    assert got[0]["contradictions"] == got[1]["contradictions"] and got[3]["key_claims"] == []
    assert got[4:] == [None] * 6


def test_references_round_trip(spark):
    df = spark.createDataFrame([('[{"id":"a","code":"c","article":"1","title":"t","excerpt":"e","score":0.5}]',), ("not json",), ("[]",), (None,)], "t string")
    rows = df.select(decode_references(F.col("t")).alias("r")).withColumn("back", encode_references(F.col("r"))).collect()
    assert rows[0]["r"][0]["score"] == 0.5 and '"id":"a"' in rows[0]["back"]
    assert [r["r"] for r in rows[1:]] == [[], [], []]


def test_salary_pairs_become_one(spark):
    a, b = "Ish haqi 8 000 000 so‘m", "Ish haqi 4 000 000 so‘m"
    rows = [(1, 0, a, b, "maosh ziddiyati"), (1, 1, b, a, "swapped"),
            (1, 2, a + " belgilangan", b + " etib qo‘yilgan", "longer wording"), (2, 0, b, a, "other document"),
            (1, 3, "Ish 09:00 da boshlanadi", "Ish 11:00 da boshlanadi", "vaqt"), (1, 4, a, a, "same"),
            (1, 5, "x y z", "p q r", "These do NOT contradict")]
    kept = dedupe_findings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["doc_id"], r["ord"]) for r in kept} == {(1, 0), (2, 0), (1, 3)}


def _near(p, q):
    def m(x, y):
        return x in y or y in x
    return (m(p[0], q[0]) and m(p[1], q[1])) or (m(p[0], q[1]) and m(p[1], q[0]))


def test_dedupe_equals_sequential_fold(spark):
    rng = random.Random(3)
    words = ["ish", "haqi", "a", "bb", "vaqti", "ishi"]
    rows, claims = [], []
    for doc in range(6):
        for o in range(60):
            a = " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
            b = " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
            rows.append((doc, o, a, b, "e"))
            claims.append((doc, o, a + " " + b))
    want = set()
    for doc in range(6):
        kept = []
        for _, o, a, b, _ in (r for r in rows if r[0] == doc):
            if a != b and not any(_near(k, (a, b)) for k in kept):
                kept.append((a, b))
                want.add((doc, o))
    got = {(r["doc_id"], r["ord"]) for r in dedupe_findings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want
    want = set()
    for doc in range(6):
        kept = []
        for _, o, c in (r for r in claims if r[0] == doc):
            if len(c) >= 12 and not any(c in k or k in c for k in kept):
                kept.append(c)
                want.add((doc, o))
    got = {(r["doc_id"], r["ord"]) for r in dedupe_claims(spark.createDataFrame(claims, "doc_id int, ord long, claim string")).collect()}
    assert got == want


def test_grounding(spark):
    source = "Ish vaqti 09:00. Maosh 7 000 000 so‘m. Boshqa band: ish 11:00 da."
    rows = [(1, 0, "Ish vaqti 09:00", "ish 11:00 da", "vaqt"), (1, 1, "Concert starts at 8pm", "Tickets cost $50", "x"),
            (1, 2, "Ish vaqti 09:00", "Ish vaqti 09:00", "identical")]
    docs = spark.createDataFrame([(1, source)], "doc_id int, text string")
    kept = filter_grounded(spark.createDataFrame(rows, SCHEMA), docs).collect()
    assert [r["ord"] for r in kept] == [0]


def test_summary_grounding(spark):
    source = tx.normalize_for_match(F.lit("Shartnoma loyihasi: ish vaqti 09:00, oylik maosh 7 000 000 so‘m, sinov muddati ikki oy."))
    def check(s):
        return spark.range(1).select(summary_grounded(tx.normalize_for_match(F.lit(s)), source).alias("r")).head()["r"]
    assert not check("The document provides detailed information about the location, schedule, and ticket prices for a concert.")
    assert check("Ichki ziddiyat topilmadi.") and not check("  ") and check("Shartnoma sinov muddati va oylik maosh haqida")


def test_parse_outputs_flags(spark):
    chunk = "Ish kuni 09:00 da boshlanadi. Xodim ishga 11:00 da kelishi shart. Oylik maosh besh million."
    good = ('{"summary":"Ish kuni va oylik maosh haqida shartnoma","contradictions":[{"statement_a":"Ish kuni 09:00 da boshlanadi",'
            '"statement_b":"Xodim ishga 11:00 da kelishi shart","explanation":"vaqt"}],"key_claims":["Oylik maosh besh million","uydirma da\'vo bu yerda"]}')
    fake = '{"summary":"concert tickets schedule prices venue","contradictions":[{"statement_a":"Concert starts at eight","statement_b":"Tickets cost fifty","explanation":"x"}]}'
    mixed = good.replace("Ish kuni va oylik maosh haqida shartnoma", "concert tickets schedule prices venue")
    chunks = spark.createDataFrame([(d, 0, chunk, 1) for d in range(4)], "doc_id int, chunk_idx int, chunk string, chunk_count int")
    outs = spark.createDataFrame([(0, 0, good), (1, 0, fake), (2, 0, "nothing"), (3, 0, mixed)], "doc_id int, chunk_idx int, raw string")
    rows = {r["doc_id"]: r for r in parse_outputs(outs, chunks).collect()}
    assert len(rows[0]["contradictions"]) == 1 and rows[0]["key_claims"] == ["Oylik maosh besh million"]
    assert not rows[0]["parse_failed"] and not rows[0]["ungrounded"]
    assert rows[1]["parse_failed"] and rows[1]["ungrounded"] and rows[1]["contradictions"] == []
    assert rows[2]["summary"] is None and rows[2]["parse_failed"] and not rows[2]["ungrounded"]
    assert rows[3]["ungrounded"] and not rows[3]["parse_failed"] and "ziddiyatlar aniqlandi" in rows[3]["summary"]


def test_conflicts(spark):
    rows = [(1, 0, "Ish haqi: oyiga 8 000 000 so‘m."), (1, 1, "Xodimga oyiga 5 000 000 so‘m to‘lanadi."), (1, 2, "Sinov muddati: 3 oy."),
            (1, 3, "Unga oyiga 8 000 000 so‘m beriladi"), (2, 0, "oyiga 1 so‘m"),
            (3, 0, "oylik ish haqi 8 000 000 som etib belgilanadi"), (3, 1, "xodimga har oyda 4 000 000 som ish haqi to'lanadi"),
            (4, 0, "narx 5 79"), (4, 1, "narx 57 9"), (5, 0, "narx 5 790 som"), (5, 1, "narx 5790 som"), (6, 0, "5. muddat 3 kun"), (6, 1, "6. muddat 3 kun")]
    got = conflict_candidates(spark.createDataFrame(rows, "doc_id int, ord long, claim string")).collect()
    assert sorted((r["doc_id"], r["ord_a"], r["ord_b"]) for r in got) == [(1, 0, 1), (1, 1, 3), (3, 0, 1), (4, 0, 1)]
    assert {r["doc_id"]: r["explanation"] for r in got if r["doc_id"] > 2} == {3: "8000000 / 4000000 som", 4: "5 / 57"}


def test_conflicts_of_units_and_number_tables(spark):
    rows = [(1, 0, "alfa 5 beta 6 gamma"), (1, 1, "beta 7 gamma"), (2, 0, "muddat 3"), (2, 1, "muddat: 4"),
            (3, 0, "jadval " + "12 " * 50_000 + "oxiri"), (3, 1, "jadval 5 oxiri"), (4, 0, "og‘irlik 5kg"), (4, 1, "og‘irlik 6kg"),
            (5, 0, "haftada 5 kun, kuniga 8 soat"), (5, 1, "kuniga 8 soat"), (5, 2, "haftada kuniga 9 soat"),
            (6, 0, "2024-yil 1-mart kuni"), (6, 1, "2025-yil 1-mart kuni"), (7, 0, "narx " + "1.2." * 20_000), (7, 1, "12 13"), (7, 2, None)]
    got = conflict_candidates(spark.createDataFrame(rows, "doc_id int, ord long, claim string")).collect()
    found = {(r["doc_id"], r["ord_a"], r["ord_b"]): r["explanation"] for r in got}
    assert found == {(1, 0, 1): "6 / 7 gamma", (2, 0, 1): "3 / 4", (3, 0, 1): "12 / 5 oxiri", (4, 0, 1): "5 / 6 kg",
                     (5, 0, 2): "8 / 9 soat", (5, 1, 2): "8 / 9 soat", (6, 0, 1): "2024 / 2025 yil"}


def test_conflicts_do_not_pair_a_price_list(spark):
    """Lines that share all but a name are about different things; further values of one wording meet its first only."""
    rows = [(1, n, f"mahsulot nomi{chr(97 + n // 26)}{chr(97 + n % 26)} narxi {n} som") for n in range(400)]
    rows += [(1, 1000 + n, f"yetkazish muddati {n} kun") for n in range(300)]
    first = spark.createDataFrame([(1, n, ["mahsulot", f"nomi{n}", "narxi", "som"]) for n in range(400)], "doc_id int, wid long, words array<string>")
    assert alike_wordings(first).count() == 0
    got = conflict_candidates(spark.createDataFrame(rows, "doc_id int, ord long, claim string")).collect()
    assert sorted((r["ord_a"], r["ord_b"]) for r in got) == [(1000, 1000 + n) for n in range(1, 300)]


def test_alike_wordings_equal_all_pairs(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    rows = [(d, w, sorted(set(rng.choices(vocab, weights=range(1, 41), k=rng.randint(1, 7))))) for d in range(4) for w in range(40)]
    want = set()
    for d in range(4):
        sets = {w: set(x) for doc, w, x in rows if doc == d}
        df = {v: sum(v in s for s in sets.values()) for v in vocab}
        weigh = lambda s: sum(((40 + 16) // df[v]).bit_length() for v in s)
        want |= {(d, a, b) for a in sets for b in sets if a < b
                 and 100 * weigh(sets[a] & sets[b]) >= 35 * min(weigh(sets[a]), weigh(sets[b])) and sets[a] & sets[b]}
    got = alike_wordings(spark.createDataFrame(rows, "doc_id int, wid long, words array<string>")).collect()
    assert {(r.doc_id, *sorted((r.one, r.other))) for r in got} == want and len(got) == len(want)


def test_boilerplate_gives_no_candidates(spark):
    """Lines of one form that differ in the middle, in the first or in the last word; and one long quote."""
    words = [f"soz{i}" for i in range(21)]
    rows = [(1, n, " ".join([*words[:18], f"farq{n}", *words[19:]])) for n in range(300)]
    rows += [(1, 900, " ".join(["oldin", *words[:18], "farq7", *words[19:], "keyin"])), (2, 0, "a"), (2, 1, "a b"), (3, 0, "boshqa")]
    rows += [(4, n, " ".join([f"farq{n}", *words])) for n in range(600)] + [(4, 900, " ".join(["bu", "xfarq7", *words, "son"]))]
    rows += [(5, n, " ".join([*words, f"farq{n}"])) for n in range(600)]
    rows += [(6, 0, " ".join(f"q{i}" for i in range(3000)))] + [(6, n, f"q{n} q{n + 1} q{n + 2} q{n + 3}") for n in range(1, 40)]
    found = [tuple(r) for r in candidate_pairs(spark.createDataFrame(rows, "doc_id int, ord long, text string")).collect()]
    assert {(1, 7, 900), (2, 0, 1), (4, 7, 900), *((6, 0, n) for n in range(1, 40))} <= set(found)
    assert len([p for p in found if p[0] < 4]) < 10 and len([p for p in found if p[0] in (4, 5)]) < 2000 and len([p for p in found if p[0] == 6]) < 200


def test_candidates_hold_every_containment(spark):
    rng = random.Random(8)
    rows = []
    for doc in range(8):
        vocab = ["a", "ab", "b", "ba", "abc", "c" * 40, "c" * 45][:rng.randint(2, 7)]
        for o in range(40):
            t = " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 8)))
            rows.append((doc, o, t[rng.randint(0, 2):len(t) - rng.randint(0, 2)].strip() or "a"))
    found = {tuple(r) for r in candidate_pairs(spark.createDataFrame(rows, "doc_id int, ord long, text string")).collect()}
    want = {(d, min(o, p), max(o, p)) for d, o, t in rows for e, p, u in rows if d == e and o != p and t in u}
    assert want <= found and len(want) > 1000


def test_keep_first_of_a_long_chain_is_one_pass(spark):
    edges = spark.createDataFrame([(1, n, n + 1) for n in range(2000)] + [(2, 5, 9), (2, 5, 9)], "doc_id int, first long, second long")
    items = spark.range(2001).select(F.lit(1).alias("doc_id"), F.col("id").alias("ord"))
    spark.sparkContext.setJobGroup("chain", "")
    assert sorted(r.ord for r in keep_first(items, edges).collect()) == list(range(0, 2001, 2))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) <= 12
    spark.sparkContext.setJobGroup("other", "")


def test_keep_first_of_a_document_of_many_pairs(spark, monkeypatch):
    """Beyond the limit a document is folded component by component, with the same result."""
    monkeypatch.setattr(graph, "FOLD_PAIRS", 10)
    edges = [(1, n, n + 1) for n in range(12)] + [(1, n, n + 2) for n in range(20, 30, 3)] + [(2, 1, 2)]
    items = spark.createDataFrame([(1, n) for n in range(40)] + [(2, 1), (2, 2)], "doc_id int, ord long")
    kept = {(r.doc_id, r.ord) for r in keep_first(items, spark.createDataFrame(edges, "doc_id int, first long, second long")).collect()}
    gone = set()
    for doc, a, b in sorted(edges, key=lambda e: (e[0], e[2], e[1])):
        if (doc, a) not in gone:
            gone.add((doc, b))
    assert kept == {(r[0], r[1]) for r in items.collect()} - gone


def test_components(spark):
    edges = [(1, 1, 2), (1, 2, 7), (1, 4, 5), (2, 1, 5), (2, 5, 6), *((3, n, n + 1) for n in range(20))]
    got = {(r.doc_id, r.v): r.component for r in graph.connected(spark.createDataFrame(edges, "doc_id int, first long, second long"), ["doc_id"]).collect()}
    assert got == {(1, 1): 1, (1, 2): 1, (1, 7): 1, (1, 4): 4, (1, 5): 4, (2, 1): 1, (2, 5): 1, (2, 6): 1, **{(3, n): 0 for n in range(21)}}


def test_document_without_chunks_is_rejected(spark):
    docs = spark.createDataFrame([(1, ""), (2, None)], "doc_id int, text string")
    parsed = spark.createDataFrame([], "doc_id int, chunk_idx int, chunk_count int, summary string, contradictions array<string>, "
                                       "key_claims array<string>, parse_failed boolean, ungrounded boolean")
    found = report(docs, parsed, spark.createDataFrame([], "doc_id int, ord long")).collect()
    assert {(r["doc_id"], r["analysis_failed"], r["finding_count"], r["chunk_count"]) for r in found} == {(1, True, 0, 0), (2, True, 0, 0)}


def test_documents_of_few_items_are_folded_in_their_row(spark, monkeypatch):
    """Few items make no anchors; both ways keep the same rows, with repeated and missing ids as well."""
    rng = random.Random(4)
    words = ["narx", "muddat", "shartnoma", "tomon", "to‘lov", "kun"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 5))) for _ in range(160)]
    claims = [(i % 8, i, t) for i, t in enumerate(texts)] + [(None, 1, texts[0]), (None, 2, texts[0] + " kun"), (7, 7, "boshqa gap bor")]
    found = [(d, i, t, texts[-1 - i % 160], "farq") for d, i, t in claims]
    claims = spark.createDataFrame(claims, "doc_id int, ord long, claim string")
    found = spark.createDataFrame(found, "doc_id int, ord long, statement_a string, statement_b string, explanation string")

    def kept():
        pairs = near_duplicate_pairs(distinct_findings(found)).collect()
        return [sorted(map(str, rows)) for rows in (dedupe_claims(claims).collect(), dedupe_findings(found).collect(), pairs)]
    few = kept()
    monkeypatch.setattr(dedupe, "ROW_ITEMS", 0)
    assert few == kept() and all(few) and len(few[0]) > 20
    monkeypatch.undo()
    monkeypatch.setattr(dedupe, "candidate_pairs", None)
    assert dedupe_claims(claims.where("doc_id < 7")).count() > 20
