import json
import random

from pyspark.sql import functions as F

from corpusflow.plans.analysis import analyze, prompts_between
from corpusflow.plans.answering import answer
from corpusflow.plans.corpus_build import build_corpus, embed_chunks
from corpusflow.operators.chunks import analysis_chunks

LAW = ('<body><div id="divCont"><div class="TEXT_HEADER_DEFAULT">1-bob. Mehnat</div>'
       '<div class="CLAUSE_DEFAULT">1-modda. Ish vaqti</div><div class="ACT_TEXT">Ish vaqti haftasiga qirq soat.</div>'
       '<div class="CLAUSE_DEFAULT">2-modda. Mehnat tatili</div><div class="ACT_TEXT">Har yili mehnat tatili beriladi.</div></div></body>')


def test_build_and_answer(spark):
    snaps = spark.createDataFrame([("labor", LAW)], "id string, content string")
    targets = spark.createDataFrame([("labor", "Mehnat kodeksi", "t", "uz", "u")], "id string, law_name string, title string, language string, url string")
    corpus = build_corpus(snaps, targets)
    assert corpus.documents.head()["article_count"] == 2
    rows = embed_chunks(corpus.chunks, dim=64).withColumnRenamed("embedding_vector", "vector")
    asked = spark.createDataFrame([("q1", "Mehnat tatili har yili beriladi?"), ("q2", "Sen kimsan?"), ("q3", " ")], "qid string, question string")
    got = {r["qid"]: r for r in answer(asked, rows, lambda ps: [f"{len(p)} belgi" for p in ps], k=1, dim=64).collect()}
    assert sorted(got) == ["q1", "q2"] and got["q2"]["stop_reason"] == "static" and got["q2"]["references"] == []
    assert [r["article"] for r in got["q1"]["references"]] == ["2"] and got["q1"]["answer"].endswith("belgi")
    tight = answer(asked, rows, lambda ps: ["x"] * len(ps), k=1, dim=64, n_ctx=50).where("qid = 'q1'").head()
    assert tight["stop_reason"] == "prompt_too_long" and tight["answer"] is None


def _model(prompts):
    """Quotes the first two sentences of the text between the markers as a contradiction."""
    out = []
    for p in prompts:
        if "SENTENCES:\n" in p:
            claims = [line.split(". ", 1)[1] for line in p.split("SENTENCES:\n")[1].split("\n\n")[0].split("\n")]
            pair = {"statement_a": claims[0], "statement_b": claims[-1], "explanation": "uzoq"}
            out.append(json.dumps({"summary": "ok", "contradictions": [pair]}))
            continue
        body = p.split("MATN BOSHI ===\n")[1].split("\n===")[0]
        s = [x.strip() for x in body.split(". ")]
        pair = {"statement_a": s[0], "statement_b": s[1], "explanation": "zid"}
        out.append("```json\n" + json.dumps({"summary": s[0], "contradictions": [pair], "key_claims": [s[0], s[-1]]}) + "\n```")
    return out


def test_analyze_with_generator(spark):
    long = " ".join(f"Tomonlar {i}-bandda boshqa muddatni kelishadi." for i in range(200))
    docs = spark.createDataFrame([(1, "Ish kuni 09:00 da boshlanadi. Xodim ishga 11:00 da keladi. Tamom."), (2, long)], "doc_id int, text string")
    result = analyze(docs, generate_fn=_model)
    reports = {r["doc_id"]: r for r in result.reports.collect()}
    assert reports[1]["finding_count"] == 1 and not reports[1]["was_chunked"] and not reports[1]["analysis_failed"]
    assert reports[2]["was_chunked"] and "Eslatma" in reports[2]["summary"]
    explained = {r["explanation"] for r in result.findings.where("doc_id = 2").collect()}
    assert explained == {"zid", "uzoq"}
    assert result.claims.groupBy("doc_id").count().agg(F.max("count")).head()[0] >= 2


def test_analyze_without_reconciling_model(spark):
    filler = " ".join(f"Oraliq gap {chr(97 + i % 26)}{chr(97 + i // 26)} shu yerda turadi." for i in range(150))
    text = f"Xodimga oyiga 8 000 000 so‘m to‘lanadi. {filler} Ish haqi oyiga 4 000 000 so‘m etib belgilangan."
    docs = spark.createDataFrame([(1, text), (2, "Yolg‘iz matn bor.")], "doc_id int, text string")
    chunks = analysis_chunks(docs, "doc_id", "text")
    said = F.to_json(F.struct(F.lit("Shartnoma").alias("summary"), F.array().cast("array<struct<statement_a:string>>").alias("contradictions"),
                              F.transform(F.split("chunk", r"(?<=\.) "), lambda s: s).alias("key_claims")))
    outputs = chunks.select("doc_id", "chunk_idx", F.when(F.col("doc_id") == 2, "no json").otherwise(said).alias("raw"))
    result = analyze(docs, outputs=outputs, chunks=chunks)
    reports = {r["doc_id"]: r for r in result.reports.collect()}
    assert reports[2]["analysis_failed"] and reports[2]["finding_count"] == 0
    found = result.findings.where("doc_id = 1").collect()
    assert not reports[1]["analysis_failed"]
    assert [("8 000 000" in r["statement_a"], "4 000 000" in r["statement_b"]) for r in found] == [(True, True)]


def _claims(n, words=12):
    rng = random.Random(n)
    return [(1, i, " ".join(f"w{rng.randrange(n)}" for _ in range(words))) for i in range(n)]


def test_prompts_between_chunks_stay_in_budget(spark):
    """Every prompt fits, their number grows with the claims, claims that share a rare word meet, known findings ride along."""
    counts = {}
    for n in (100, 400):
        claims = spark.createDataFrame(_claims(n) + [(2, 0, "birinchi band"), (2, 1, "ikkinchi band"), (3, 0, "yolg‘iz")],
                                       "doc_id int, ord long, claim string")
        known = spark.createDataFrame([(2, 5, "birinchi band", "boshqa", "e"), (1, 6, "yo‘q", "bunday", "e")],
                                      "doc_id int, ord long, statement_a string, statement_b string, explanation string")
        rows = prompts_between(claims, known, n_ctx=512).collect()
        assert all(r.token_estimate <= 512 and not r.over_budget for r in rows)
        two = [r for r in rows if r.doc_id == 2]
        assert len(two) == 1 and "1. birinchi band\n2. ikkinchi band" in two[0].prompt and "A: birinchi band || B: boshqa" in two[0].prompt
        assert not any(r.doc_id == 3 for r in rows)
        counts[n] = sum(r.doc_id == 1 for r in rows)
    assert counts[400] < 6 * counts[100]


def test_overlong_prompts_are_refused(spark):
    claims = spark.createDataFrame([(1, 0, "uzun " * 300), (1, 1, "qisqa band"), (1, 2, "qisqa gap")], "doc_id int, ord long, claim string")
    none = spark.createDataFrame([], "doc_id int, ord long, statement_a string, statement_b string, explanation string")
    rows = {tuple(r.ords): r.over_budget for r in prompts_between(claims, none, n_ctx=512).collect()}
    assert rows == {(0,): True, (1, 2): False}
    asked = []
    docs = spark.createDataFrame([(1, "soz " * 900), (2, "Qisqa matn. Yana bir gap.")], "doc_id int, text string")
    chunks = docs.select("doc_id", F.lit(0).alias("chunk_idx"), F.col("text").alias("chunk"), F.lit(1).alias("chunk_count"))
    answer = '{"summary":"Qisqa matn. Yana bir gap","contradictions":[],"key_claims":[]}'
    reports = {r.doc_id: r for r in analyze(docs, generate_fn=lambda p: asked.extend(p) or [answer] * len(p), chunks=chunks, n_ctx=1024).reports.collect()}
    assert reports[1].analysis_failed and not reports[2].analysis_failed and reports[2].summary.startswith("Qisqa matn")
