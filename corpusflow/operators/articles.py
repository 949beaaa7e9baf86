"""DOC-2..4: elements to articles, inside the page's own row (no shuffle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.functions.rows import explode_rows
from corpusflow.operators.markup import CLAUSE, HEADER, TEXT, MarkupRules, with_elements, line_text

_STATE = "struct<chapter:string,section:string>"
_OPENER = "struct<at:int,role:string,text:string,chapter:string,section:string>"
_ARTICLE = ("array<struct<article_number:string,article_title:string,chapter:string,"
            "section_title:string,text:string>>")


def heading_number(text: Column, rules: MarkupRules) -> Column:
    """REL-5: number of an article heading, "" when the text is not one."""
    return F.regexp_extract(text, rules.heading, 1)


def heading_title(text: Column, rules: MarkupRules) -> Column:
    """REL-5: title of an article heading, the whole text when it is not one."""
    title = F.trim(F.regexp_extract(text, rules.heading, 2))
    return F.when(text.rlike(rules.heading), title).otherwise(text)


def article_text(title: Column, body: Column) -> Column:
    """STR-9: ``title. body`` unless the body already starts with the title."""
    return (F.when(title == "", body)
            .when(body == "", F.concat(title, F.lit(".")))
            .when(F.startswith(body, title), body)
            .otherwise(F.concat(title, F.lit(". "), body)))


def _next_state(state: Column, op: Column) -> Column:
    """WIN-1: chapter and section after one header."""
    kind, text = op["header_kind"], op["text"]
    opens_chapter = kind.isin("chapter", "part") | ((kind == "generic") & (state["chapter"] == ""))
    chapter = F.when(opens_chapter, text).otherwise(state["chapter"])
    section = (F.when(kind == "chapter", F.lit(""))
               .when((kind == "section") | ((kind == "generic") & ~opens_chapter), text)
               .otherwise(state["section"]))
    carried = F.struct(chapter.alias("chapter"), section.alias("section"))
    return F.when(op["role"] == HEADER, carried).otherwise(state).cast(_STATE)


def _joined_text(elements: Column, start: Column, stop: Column) -> Column:
    inside = F.slice(elements, start + 1, F.greatest(stop - start, F.lit(0)))
    return F.array_join(F.transform(F.filter(inside, lambda e: e["role"] == TEXT), lambda e: e["text"]), " ")


def _openers(elements: Column) -> Column:
    """Headers and clauses with their position and the chapter and section they stand in."""
    placed = F.transform(elements, lambda e, i: F.struct(
        i.alias("at"), e["role"].alias("role"), e["header_kind"].alias("header_kind"), e["text"].alias("text")))
    ops = F.filter(placed, lambda e: e["role"].isin(HEADER, CLAUSE))
    start = F.struct(F.lit("").alias("chapter"), F.lit("").alias("section")).cast(_STATE)
    init = F.struct(start.alias("now"), F.array().cast(f"array<{_OPENER}>").alias("seen"))

    def step(acc: Column, op: Column) -> Column:
        now = _next_state(acc["now"], op)
        seen = F.struct(op["at"].alias("at"), op["role"].alias("role"), op["text"].alias("text"),
                        now["chapter"].alias("chapter"), now["section"].alias("section")).cast(_OPENER)
        return F.struct(now.alias("now"), F.concat(acc["seen"], F.array(seen)).alias("seen"))

    return F.aggregate(ops, init, step, lambda acc: acc["seen"])


def plain_article_text(title: Column, body: Column) -> Column:
    """STR-9 in the text fallback: a title always leads, and stays bare without a body."""
    return F.when(title == "", body).when(body == "", title).otherwise(F.concat(title, F.lit(". "), body))


def with_articles(df: DataFrame, rules: MarkupRules, headers_cut: bool = True,
                  text_of: Callable[[Column, Column], Column] = article_text) -> DataFrame:
    """From ``elements`` to ``articles`` and ``preamble`` columns (WIN-1, WIN-2, AGG-4).

    ``headers_cut`` says whether a header ends the article before it; if not, text after it stays in that article.
    """
    openers = _openers(F.col("elements"))
    df = df.withColumn("_openers", openers if headers_cut else F.filter(openers, lambda o: o["role"] == CLAUSE))
    df = df.withColumn("_total", F.size("elements"))
    starts = F.transform("_openers", lambda o: o["at"])
    stops = F.when(F.size("_openers") > 0,
                   F.concat(F.slice(starts, F.lit(2), F.size("_openers")), F.array("_total")))
    spans = F.zip_with("_openers", stops, lambda o, stop: F.struct(o.alias("o"), stop.alias("stop")))
    islands = F.transform(spans, lambda s: F.struct(
        s["o"].alias("o"), _joined_text(F.col("elements"), s["o"]["at"] + 1, s["stop"]).alias("body")))
    df = df.withColumn("_islands", F.when(F.size("_openers") > 0, islands))
    lead = _joined_text(F.col("elements"), F.lit(0),
                        F.coalesce(F.get(F.col("_openers"), F.lit(0))["at"], F.col("_total")))
    loose = F.concat(F.array(lead), F.coalesce(F.transform(
        F.filter("_islands", lambda a: a["o"]["role"] == HEADER), lambda a: a["body"]),
        F.array().cast("array<string>")))
    preamble = F.array_join(F.filter(loose, lambda t: t != ""), " ")
    titled = F.transform(
        F.filter("_islands", lambda a: a["o"]["role"] == CLAUSE),
        lambda a: F.struct(a["o"].alias("o"), a["body"].alias("body"),
                           heading_title(a["o"]["text"], rules).alias("title")))
    articles = F.transform(titled, lambda a: F.struct(
        heading_number(a["o"]["text"], rules).alias("article_number"),
        a["title"].alias("article_title"), a["o"]["chapter"].alias("chapter"),
        a["o"]["section"].alias("section_title"), text_of(a["title"], a["body"]).alias("text")))
    filled = F.coalesce(F.filter(articles, lambda a: a["text"] != "").cast(_ARTICLE), F.array().cast(_ARTICLE))
    return (df.withColumn("articles", filled).withColumn("preamble", preamble)
            .drop("_openers", "_total", "_islands"))


def line_elements(text: Column, rules: MarkupRules) -> Column:
    """STR-21: lines of plain text as elements; only chapter, section and article lines open."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), tx.collapse_ws), lambda s: s != "")
    clause = r"(?iu)^\s*\d+\s*-\s*modda\."
    return F.transform(lines, lambda s: F.struct(
        F.when(s.rlike(rules.chapter) | s.rlike(rules.section), HEADER)
        .when(s.rlike(clause), CLAUSE).otherwise(TEXT).alias("role"),
        F.when(s.rlike(rules.chapter), "chapter").when(s.rlike(rules.section), "section").alias("header_kind"),
        s.alias("text")))


def fallback_articles(df: DataFrame, text_col: str, rules: MarkupRules) -> DataFrame:
    """DOC-3: split plain text at article lines; text before the first one is an untitled article.

    Header lines apply to the articles after them and are left out of the text around them, which keeps its place.
    """
    elements = line_elements(F.col(text_col), rules)
    df = with_articles(df.withColumn("elements", elements), rules, headers_cut=False, text_of=plain_article_text)
    headless = F.struct(
        F.lit("").alias("article_number"), F.lit("").alias("article_title"), F.lit("").alias("chapter"),
        F.lit("").alias("section_title"), F.col("preamble").alias("text"))
    head = F.when(F.col("preamble") != "", F.array(headless)).otherwise(F.array().cast(_ARTICLE))
    return (df.withColumn("articles", F.concat(head.cast(_ARTICLE), F.col("articles")))
            .withColumn("preamble", F.lit("")).drop("elements"))


def clean_documents(pages: DataFrame, id_col: str, html_col: str, rules: MarkupRules) -> DataFrame:
    """DOC-1..4: one row per page with ``articles``, ``preamble``, ``article_count``, ``parse_mode``.

    Pages without elements or without articles go through the text fallback.  Both branches
    read the page's own row, so this is one scan: the branch is chosen by the first result.
    """
    df = with_articles(with_elements(pages.withColumn("id", F.col(id_col)), F.col(html_col), rules), rules)
    missing = F.size("articles") == 0
    # The fallback text is null (and its expressions idle) where the markup gave articles.
    df = (df.withColumn("_parsed", F.col("articles")).withColumn("_lead", F.col("preamble"))
          .withColumn("_lines", F.when(missing, line_text(F.col("_bare"), rules)))
          .drop("articles", "preamble", "elements", "_bare"))
    df = fallback_articles(df, "_lines", rules)
    use_text = F.size("_parsed") == 0
    return (df.withColumn("articles", F.when(use_text, F.coalesce("articles", F.array().cast(_ARTICLE)))
                          .otherwise(F.col("_parsed")))
            .withColumn("preamble", F.when(use_text, F.lit("")).otherwise(F.col("_lead")))
            .withColumn("parse_mode", F.when(use_text, "fallback_regex").otherwise("structured"))
            .withColumn("article_count", F.size("articles"))
            .drop("_parsed", "_lead", "_lines"))


def article_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """DOC-2 as rows: (id, ord, article_number, article_title, chapter, section_title, text)."""
    return explode_rows(docs, "articles", "ord", "a", "id", *keep).select("id", *keep, "ord", "a.*")
