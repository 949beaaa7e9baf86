import random
from dataclasses import replace
from html.parser import HTMLParser

from pyspark.sql import functions as F

from corpusflow.operators.articles import clean_documents, with_articles
from corpusflow.operators.carry import carry_last, island_articles, preambles
from corpusflow.operators.chunks import analysis_chunks, chunk_articles
from corpusflow.operators.markup import LAW_PAGE, html_elements, with_running

PAGE = """<html><body><div>menu</div><div id="divCont"><div class="docContentHeader">top</div>
<div class="ACT_TITLE lx_elem">KODEKS</div><div class="ACT_TEXT lx_elem"><div>Kirish &laquo;so&#699;z&raquo;</div></div>
<div class="TEXT_HEADER_DEFAULT lx_elem">I BOʻLIM. UMUMIY</div><div class="TEXT_HEADER_DEFAULT">1-bob. Asosiy</div>
<div class="TEXT_HEADER_DEFAULT">1-§. Kirish</div>
<div class="CLAUSE_DEFAULT lx_elem"><a>1-modda. Maqsad</a></div>
<div class="ACT_TEXT">Birinchi <span class="lx_no_select">YASHIRIN</span> qism.<script>var a="x";</script></div>
<div class="ACT_TEXT">Ikkinchi Audioni tinglash qism.</div>
<div class="TEXT_HEADER_DEFAULT">Umumiy sarlavha</div><div class="CLAUSE_DEFAULT">Raqamsiz</div>
<div class="TEXT_HEADER_DEFAULT">2-bob. Keyin</div><div class="ACT_TEXT">Oraliq.</div>
<div class="CLAUSE_DEFAULT">2-modda. Yana</div></div></body></html>"""


def test_law_page(spark):
    df = clean_documents(spark.createDataFrame([("a", PAGE)], "id string, html string"), "id", "html", LAW_PAGE)
    doc = df.head()
    assert doc["preamble"] == "Kirish «soʻz» Oraliq." and doc["article_count"] == 3 and doc["parse_mode"] == "structured"
    got = [tuple(a) for a in doc["articles"]]
    assert got == [
        ("1", "Maqsad", "1-bob. Asosiy", "1-§. Kirish", "Maqsad. Birinchi qism. Ikkinchi qism."),
        ("", "Raqamsiz", "1-bob. Asosiy", "Umumiy sarlavha", "Raqamsiz."),
        ("2", "Yana", "2-bob. Keyin", "", "Yana.")]


def test_fallback(spark):
    html = "<body><p>Muqaddima</p><p>1-bob. Bir</p><p>5-modda. Ish vaqti</p><p>Matn bir.</p><p>2-bob. Ikki</p><p>6-modda. Dam</p></body>"
    df = clean_documents(spark.createDataFrame([("a", html), ("b", "<body></body>")], "id string, html string"), "id", "html", LAW_PAGE)
    rows = {r["id"]: r for r in df.collect()}
    assert rows["a"]["parse_mode"] == "fallback_regex" and rows["b"]["article_count"] == 0
    assert [tuple(a) for a in rows["a"]["articles"]] == [
        ("", "", "", "", "Muqaddima"), ("5", "Ish vaqti", "1-bob. Bir", "", "Ish vaqti. Matn bir."),
        ("6", "Dam", "2-bob. Ikki", "", "Dam")]


def test_container_ends_at_its_own_tag(spark):
    html = ('<body><div id="divCont"><div class="CLAUSE_DEFAULT">1-modda. Bir</div><div class="ACT_TEXT"><div>&eacute;&copy;&euro;'
            '</div> matn</div></div><div class="ACT_TEXT">footer</div></body>')
    df = clean_documents(spark.createDataFrame([("a", html), ("b", html.replace("</div>", "")), ("c", None)], "id string, html string"),
                         "id", "html", LAW_PAGE)
    rows = {r["id"]: r["articles"] for r in df.collect()}
    assert [a["text"] for a in rows["a"]] == ["Bir. é©€ matn"]
    # Tags that are never closed hold all that follows.
    assert [a["text"] for a in rows["b"]] == ["Bir é©€ matn footer. é©€ matn footer footer"] and not rows["c"]


VOID = {"br", "img"}


class Tree(HTMLParser):
    """Every element with all text inside it, in the order of the opening tags; noise and its content left out."""

    def __init__(self):
        super().__init__()
        self.open, self.found = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            kind = dict(attrs).get("class") or ""
            item = [tag, kind, "lx_no_select" in kind or tag == "nav" or any(o[2] for o in self.open), []]
            self.open.append(item)
            self.found.append(item)

    def handle_endtag(self, tag):
        if tag in [o[0] for o in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(o[2] for o in self.open):
            for o in self.open:
                o[3].append(data)

    def elements(self):
        text = [(k, " ".join("".join(parts).split())) for _, k, noise, parts in self.found if not noise]
        roles = {"CLAUSE_X": "clause", "ACT_TEXT": "text", "TEXT_HEADER": "header"}
        return [(roles[k], t) for k, t in text if k in roles and t]


def _random_markup(rng, depth=0):
    out = []
    for _ in range(rng.randint(0 if depth else 3, 5)):
        tag, kind = rng.choice(["div", "span", "nav", "p"]), rng.choice(["CLAUSE_X", "ACT_TEXT", "TEXT_HEADER", "lx_no_select", "x", "lx_elem"])
        inner = _random_markup(rng, depth + 1) if depth < 5 and rng.random() < 0.7 else rng.choice(["", f"w{rng.randrange(99)} ", "<br>z "])
        out.append(f'<{tag} id=i{depth} class="{kind}">{inner}</{tag}> t{rng.randrange(99)} ')
    return "".join(out)


def test_nested_elements_equal_a_tree(spark):
    rng = random.Random(11)
    rules = replace(LAW_PAGE, containers=(), noise_tags=("script", "style", "nav"))
    pages = [(i, _random_markup(rng)) for i in range(150)] + [(900, ""), (901, None), (902, "no tags at all"), (903, "</div></span> < 3 <div class='ACT_TEXT'>a</div>")]
    got = {}
    for r in html_elements(spark.createDataFrame(pages, "i int, h string"), "i", "h", rules).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append((r["role"], r["text"]))
    want = {}
    for i, h in pages:
        tree = Tree()
        tree.feed(h or "")
        want[i] = tree.elements()
    assert got == {i: e for i, e in want.items() if e} and sum(len(e) for e in want.values()) > 300


def test_nested_rule_elements_and_deep_noise(spark):
    text = "Bosh qism <span class=lx_elem>havola</span> oxirgi qism."
    deep = '<div class="lx_no_select">' * 40 + "yashirin" + "</div>" * 40
    html = f'<div id="divCont"><div class="CLAUSE_DEFAULT">1-modda. Bir</div><div class="ACT_TEXT">{deep}{text}<div class="ACT_TEXT">ichki</div> son</div></div>'
    wide = f'<div id="divCont">{"".join(f"<div class=ACT_TEXT><b>q{n}</b><i class=lx_no_select>x</i></div>" for n in range(3000))}</div>'
    rows = html_elements(spark.createDataFrame([(1, html), (2, wide)], "i int, h string"), "i", "h", LAW_PAGE).orderBy("id", "pos").collect()
    assert [r["text"] for r in rows if r["id"] == 1] == ["1-modda. Bir", "Bosh qism havola oxirgi qism. ichki son", "ichki"]
    assert [r["text"] for r in rows if r["id"] == 2] == [f"q{n}" for n in range(3000)]


def test_running_totals(spark):
    df = spark.createDataFrame([([],), ([5],), (list(range(1, 200)),)], "v array<int>")
    got = [r.t for r in with_running(df, F.col("v"), "t", lambda a, x: a + x).collect()]
    assert got == [[], [5], [k * (k + 1) // 2 for k in range(1, 200)]]


def test_fallback_keeps_the_order_of_text(spark):
    html = "<body><p>1-modda. Mehnat</p><p>Mehnat shartnomasi tuziladi.</p><p>2-bob. Ikki</p><p>Davomi.</p><p>2-modda. Dam</p></body>"
    df = clean_documents(spark.createDataFrame([("a", html)], "id string, html string"), "id", "html", LAW_PAGE)
    assert [(a["chapter"], a["text"]) for a in df.head()["articles"]] == [
        ("", "Mehnat. Mehnat shartnomasi tuziladi. Davomi."), ("2-bob. Ikki", "Dam")]


def _random_elements(rng):
    kinds = [("header", "chapter"), ("header", "section"), ("header", "part"), ("header", "generic"),
             ("clause", None), ("text", None), ("text", None)]
    return [(i, *rng.choice(kinds), f"t{i}") for i in range(rng.randint(1, 25))]


def _walk(elements):
    """Plain state machine over one document."""
    chapter = section = ""
    out, lead, current = [], [], None
    for _, role, kind, text in elements:
        if role == "header":
            current = None
            if kind == "chapter":
                chapter, section = text, ""
            elif kind == "part":
                chapter = text
            elif kind == "section" or chapter:
                section = text
            else:
                chapter = text
        elif role == "clause":
            current = [text, chapter, section, []]
            out.append(current)
        elif current is None:
            lead.append(text)
        else:
            current[3].append(text)
    arts = [(t, c, s, f"{t}. {' '.join(b)}" if b else f"{t}.") for t, c, s, b in out]
    return arts, " ".join(lead)


def test_row_and_array_forms_equal_the_state_machine(spark):
    rng = random.Random(7)
    docs = {d: _random_elements(rng) for d in range(60)}
    want = {d: _walk(e) for d, e in docs.items()}
    rows = spark.createDataFrame([(d, *e) for d, es in docs.items() for e in es],
                                 "doc int, pos int, role string, header_kind string, text string")
    for block in (3, 100_000):
        got = {}
        for r in island_articles(rows, "doc", block).orderBy("doc", "pos").collect():
            got.setdefault(r["doc"], []).append((r["article_title"], r["chapter"], r["section_title"], r["text"]))
        assert got == {d: a for d, (a, _) in want.items() if a}
        lead = {r["doc"]: r["preamble"] for r in preambles(rows, "doc", block).collect()}
        assert lead == {d: p for d, (_, p) in want.items() if p}
    arrays = rows.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("pos", "role", "header_kind", "text"))), lambda e: F.struct(
            e["role"].alias("role"), e["header_kind"].alias("header_kind"), e["text"].alias("text"))).alias("elements"))
    for r in with_articles(arrays, LAW_PAGE).collect():
        arts = [(a["article_title"], a["chapter"], a["section_title"], a["text"]) for a in r["articles"]]
        assert (arts, r["preamble"]) == want[r["doc"]]


def test_carry_last_crosses_blocks_of_a_hot_key(spark):
    df = spark.range(0, 5000).select(F.when(F.col("id") < 4000, "hot").otherwise("other").alias("k"), F.col("id").alias("pos"),
                                     F.when(F.col("id") % 700 == 5, F.col("id").cast("string")).alias("e"))
    for r in carry_last(df, "k", "pos", ["e"], 64).collect():
        last = [i for i in range(r["pos"] + 1) if i % 700 == 5 and (i < 4000) == (r["pos"] < 4000)]
        assert r["e"] == (str(last[-1]) if last else None)


def test_chunks(spark):
    rows = [("d", 0, "L", "1", "T", "c", None, "so'z " * 900), ("d", 1, "L", "", "Ish haqi", "", "", " qisqa matn "),
            ("d", 2, "L", "", "", "", "", "  ")]
    df = spark.createDataFrame(rows, "id string, ord int, law_name string, article_number string, article_title string, "
                                     "chapter string, section_title string, text string")
    got = {(r["id"]): r for r in chunk_articles(df).collect()}
    assert sorted(got) == ["d__art-1__p1", "d__art-1__p2", "d__art-1__p3", "d__art-ish-haqi"]
    assert len(got["d__art-1__p1"]["text"].split()) == 384 and got["d__art-1__p3"]["part_count"] == 3
    assert got["d__art-ish-haqi"]["text"] == "qisqa matn" and got["d__art-1__p1"]["section_title"] == ""
    assert len({r["chunk_key"] for r in got.values()}) == 4


def test_analysis_chunks(spark):
    early, late = "EARLY: oylik 8 000 000.", "LATE: oylik 4 000 000."
    body = " ".join(f"Oraliq gap {i} shu yerda." for i in range(150))
    docs = spark.createDataFrame([(1, f"{early} {body} {late}"), (2, "Qisqa. Matn."), (3, " ")], "id int, t string")
    rows = analysis_chunks(docs, "id", "t", max_chars=900, overlap=600).collect()
    long = [r["chunk"] for r in rows if r["doc_id"] == 1]
    assert len(long) >= 2 and any(early in c for c in long) and any(late in c for c in long)
    assert [r["single_chunk"] for r in rows if r["doc_id"] == 2] == [True] and not [r for r in rows if r["doc_id"] == 3]
