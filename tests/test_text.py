import random

from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.functions import windows as w
from corpusflow.functions.prompts import check_system_prompt, check_user_prompt, findings_block, chat_prompt, claims_block
from corpusflow.operators.intent import ABOUT, OUT_OF_SCOPE, Assistant, route
from corpusflow.settings import analysis_budget, recommended_overlap


# The sample texts and expected results below are golden inputs of the data contract.

def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr.alias("r")).head()["r"]


def packed(spark, text, size, overlap):
    df = spark.createDataFrame([(text,)], "t string")
    return w.add_packed_windows(df, "t", "o", size, overlap).head()["o"]


def test_whitespace_and_words(spark):
    assert one(spark, "  a \t\n b c ", tx.collapse_ws("t")) == "a b c"
    assert one(spark, "  \n", tx.word_count("t")) == 0
    assert one(spark, "x xx  x y", tx.word_count("t")) == 4
    assert one(spark, "   ", tx.words("t")) == []


def test_token_estimate_rounds_half_even(spark):
    rows = spark.range(0, 3000).select(F.col("id").cast("int").alias("n"))
    got = rows.select("n", tx.tokens_from_words(F.col("n")).alias("e")).collect()
    assert all(r["e"] == (max(1, round(r["n"] * 1.3)) if r["n"] else 0) for r in got)


def test_entities_decode_in_order(spark):
    assert one(spark, "&amp;quot; &amp;lt; &lt;b&gt;", tx.decode_entities("t")) == '" &lt; <b>'
    assert one(spark, "&#699; &#x2014; &laquo;a&raquo; &amp;lt; &#bad;", tx.decode_html("t")) == "ʻ — «a» &lt; &#bad;"


def test_normalize(spark):
    assert one(spark, "“Ish”  ‘HAQI’ `x` İΣ", tx.normalize_for_match("t")) == "\"ish\" 'haqi' 'x' iσ"
    assert one(spark, "Soʻm “X”", tx.normalize_for_intent("t")) == "so'm “x”"


def test_slug_and_chunk_id(spark):
    assert one(spark, "  Ish haqi — (yangi)_matn! ", tx.slugify("t")) == "ish-haqi-yangi-matn"
    assert one(spark, "!!!", tx.slugify("t")) == "chunk"
    parts = [F.lit("s"), F.lit(""), F.lit("Ish vaqti"), F.lit(1), F.lit(3)]
    assert one(spark, "", tx.chunk_id(*parts)) == "s__art-ish-vaqti__p2"
    assert one(spark, "", tx.chunk_id(F.lit("s"), F.lit("7"), F.lit("x"), F.lit(0), F.lit(1))) == "s__art-7"


def test_sentences(spark):
    text = 'Bir. ikki. Uch! "To‘rt." Besh… (olti) 3.5 yetti? 8 ta.'
    assert one(spark, text, tx.sentences("t")) == [
        'Bir. ikki.', 'Uch!', '"To‘rt."', 'Besh…', '(olti) 3.5 yetti?', '8 ta.']
    assert one(spark, "a b\n\nc d\n \ne", tx.paragraphs("t")) == ["a b", "c d", "e"]
    assert one(spark, "a\nb\n\n  ", tx.units("t")) == ["a", "b"]


def test_language(spark):
    assert one(spark, "Что это за договор", tx.detect_language("t")) == "ru"
    assert one(spark, "what are the rights and duties", tx.detect_language("t")) == "en"
    assert one(spark, "other andthe", tx.detect_language("t")) == "uz"


def test_tail_repeats(spark):
    assert one(spark, "A" * 40 * 3, tx.tail_repeats("t"))
    assert not one(spark, "modda " * 20, tx.tail_repeats("t"))
    unit = "".join(chr(97 + i * 7 % 26) for i in range(50)) + "."
    assert one(spark, "head " + unit * 3, tx.tail_repeats("t"))
    assert not one(spark, "head " + unit * 2, tx.tail_repeats("t"))


def test_budgets():
    assert recommended_overlap(3072) == 1024 and recommended_overlap(2000) >= 600
    assert analysis_budget(4096) == (3072, 1024)
    assert w.word_budget(500, 50) == (384, 346)


def test_packed_windows(spark):
    assert packed(spark, "Qisqa hujjat. Bitta jumla.", 2000, 600) == ["Qisqa hujjat. Bitta jumla."]
    text = "".join(f"Band {i}. Tomonlar majburiyatni bajaradi va muddatni kuzatadi. " for i in range(1, 41))
    chunks = packed(spark, text, 500, 150)
    assert len(chunks) > 1 and all(len(c) <= 500 and c.endswith(".") for c in chunks)
    text = "".join(f"Jumla raqami {i} bu yerda turadi. " for i in range(1, 31))
    first, second = packed(spark, text, 400, 200)[:2]
    assert any(word in second for word in first.split()[-12:] if len(word) > 3)
    assert packed(spark, "  ", 400, 200) == []


def test_packed_windows_cover_every_unit_in_order(spark):
    rng = random.Random(5)
    texts = []
    for n in range(40):
        units = ["W" + "x" * rng.choice([3, 20, 60, 150, 400]) + str(i) + "." for i in range(rng.randint(1, 40))]
        texts.append((n, " ".join(units)))
    df = spark.createDataFrame(texts, "n int, t string")
    rows = w.add_packed_windows(df.withColumn("u", tx.units("t")), "t", "o", 120, 50).collect()
    for r in rows:
        assert all(len(c) <= 120 for c in r["o"])
        joined, at = "\n".join(r["o"]), 0
        for unit in r["u"]:
            if len(unit) <= 120 and len(r["t"]) > 120:
                assert any(unit in c for c in r["o"])
        if len(r["t"]) > 120:
            assert r["o"][0].startswith(r["u"][0][:100]) and r["o"][-1].endswith(r["u"][-1][-10:])


def test_intent_routes(spark):
    bot = Assistant("corpusflow", "acme")
    about = ["Corpusflow AI nima?", "Sen kimsan?", "Bu dastur nima qila oladi?", "Kim yaratdi?", "Dastur haqida",
             "What can you do?", "Who are you?", "ACME nima?", "Nima qila olasan?"]
    out = ["Bugun ob-havo qanday?", "Futbol o‘yini natijasi?", "Menga retsept ayt", "2+2 necha?", "ChatGPT haqida gapir"]
    none = ["Menga yordam kerak", "Salom", "Haydab yuborishdi, nima qilaman?", "Hayot nima?", "Bu qanday ishlaydi",
            "Mehnat shartnomasi qanday tuziladi?", "Shartnomani kim yaratdi va imzolashi shartmi?",
            "Трудовой договор как расторгнуть?", "Xodimning ta’til huquqi qancha?", "Mulk huquqi nima?"]
    strong = ["Corpusflow AI mehnat kodeksi bo‘yicha ishlaydimi?"]
    rows = [(t, ABOUT) for t in about + strong] + [(t, OUT_OF_SCOPE) for t in out] + [(t, None) for t in none]
    df = spark.createDataFrame(rows + [("  ", "blank")], "t string, want string")
    got = route(df, "t", bot).collect()
    assert len(got) == len(rows)
    assert [r["t"] for r in got if r["intent"] != r["want"]] == []


def test_check_prompts(spark):
    df = spark.createDataFrame([("Matn", 0, 1), ("Matn", 0, 3)], "c string, i int, n int").select(
        "n", check_system_prompt(F.col("i"), F.col("n"), "bot").alias("s"),
        check_user_prompt(F.col("c"), F.col("i"), F.col("n")).alias("u"))
    rows = {r["n"]: r for r in df.collect()}
    assert "part 1 of" not in rows[1]["s"] and "to‘liq" in rows[1]["u"] and "qismi" not in rows[1]["u"]
    assert rows[1]["u"].endswith("=== MATN BOSHI ===\nMatn\n=== MATN OXIRI ===")
    assert "part 1 of 3" in rows[3]["s"] and "1-qismi, jami 3" in rows[3]["u"] and "to‘liq" not in rows[3]["u"]


def test_blocks_and_template(spark):
    df = spark.createDataFrame([(["a", "b"], [("x", "y", "z")])],
                               "c array<string>, f array<struct<statement_a:string,statement_b:string,explanation:string>>")
    row = df.select(claims_block(F.col("c")).alias("c"), findings_block(F.col("f")).alias("f"),
                    findings_block(F.slice("f", 1, 0)).alias("none"),
                    chat_prompt(F.lit("S"), F.lit("U")).alias("p")).head()
    assert row["c"] == "1. a\n2. b" and row["f"] == "1. A: x || B: y || why: z" and row["none"] == "(no pairs so far)"
    assert row["p"].startswith("<|im_start|>system\nS<|im_end|>") and row["p"].endswith("<|im_start|>assistant\n")


def test_references_of_any_length_and_name(spark):
    assert one(spark, "&#00000233;&#x00000E9;&eacute;&euro; &nope; &#1114112; a&b", tx.decode_html("t")) == "éé\u00e9€ &nope; &#1114112; a&b"


def test_sentence_end_with_many_quotes(spark):
    text = "Bir." + '"' * 90 + " Ikki. uch"
    assert one(spark, text, tx.sentences("t")) == ["Bir." + '"' * 90, "Ikki. uch"]
