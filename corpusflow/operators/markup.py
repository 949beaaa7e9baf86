"""DOC-1: page markup to ordered text elements, one array per page (no shuffle).

Pages are read by a scanner of array expressions. The markup is split before every tag; the tags of one name have a
running depth; sorted by depth and place, an opening tag stands next to the closing tag that ends it. So every element
is a pair of places found by one sort, whatever the nesting, and

* noise elements go with all that is inside them, however deep (their spans are merged where they overlap);
* an element of a rule holds all text between its own tags, and elements inside it are elements too.

An opening tag that is never closed reaches to the end of the page. Rules with ``leaf_tags`` describe flat pages (h1,
p, li) whose tags may be left open: there a block ends at the next tag of a rule, or at a closing leaf tag; give a rule
with role ``None`` for elements to leave out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.functions.rows import bind, explode_rows

HEADER, CLAUSE, TEXT = "header", "clause", "text"


@dataclass(frozen=True)
class ElementRule:
    """Elements with one of the tags, or a class attribute containing the fragment."""

    role: str | None
    tags: tuple[str, ...] = ()
    class_fragment: str = ""

    def opener(self) -> str:
        """Pattern of the opening tag after its ``<``."""
        if self.tags:
            return r"(?:" + "|".join(self.tags) + r")\b[^>]*>"
        return r"\w+\b[^>]*\bclass\s*=\s*(?:[\"'][^\"'>]*|[^\s\"'>]*)" + self.class_fragment + r"[^>]*>"


@dataclass(frozen=True)
class MarkupRules:
    rules: tuple[ElementRule, ...]
    containers: tuple[str, ...] = ()          # element ids, first found wins, else the body
    noise_tags: tuple[str, ...] = ("script", "style", "noscript")
    noise_classes: tuple[str, ...] = ()
    noise_phrases: tuple[str, ...] = ()
    # Heading patterns of the law texts.
    heading: str = r"(?iu)^\s*(\d+)\s*-\s*modda\.?\s*(.*)$"
    chapter: str = r"(?iu)^\s*(\d+)\s*-\s*bob\.?\s*"
    section: str = r"(?iu)^\s*(\d+)\s*-\s*§\.?\s*"
    part: str = r"(?iu)BO[ʻ']LIM|^\s*(?:[IVXLC]+|\d+)\s*BOLIM"
    leaf_tags: tuple[str, ...] = ()


# The class names and phrases of the law pages.
LAW_PAGE = MarkupRules(
    rules=(
        ElementRule(None, class_fragment="ACT_TITLE"),
        ElementRule(None, class_fragment="ACT_FORM"),
        ElementRule(HEADER, class_fragment="TEXT_HEADER"),
        ElementRule(CLAUSE, class_fragment="CLAUSE_"),
        ElementRule(TEXT, class_fragment="ACT_TEXT"),
        ElementRule(None, class_fragment="lx_elem"),
    ),
    containers=("divCont", "doc_main"),
    noise_classes=("INDEXES_ON_REF", "lx_no_select", "lx_revive", "docContentHeader"),
    noise_phrases=(
        "Hujjatga taklif yuborish", "Audioni tinglash", "Hujjat elementidan havola olish",
        "LexUZ sharhi", "OKOZ:", "TSZ:"),
)

# Plain article pages: h1 opens an article, p and li are its text.
WEB_PAGE = MarkupRules(
    rules=(ElementRule(CLAUSE, tags=("h1",)), ElementRule(TEXT, tags=("p", "li"))),
    noise_tags=("script", "style", "noscript", "nav", "footer"),
    noise_classes=("ad",),
    leaf_tags=("h1", "p", "li"),
)


# Elements whose content is no markup, and elements that have no closing tag.
RAW_TAGS = ("script", "style")
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
BLOCK = 64  # values of a running total that are added up at a time


# The steps below are columns, not nested lambdas: the analyzer resolves one level of nesting an iteration. A column that a
# lambda names is named once more outside of it, so that the optimizer computes it once instead of once an element.

def with_running(df: DataFrame, values: Column, out: str, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """Running totals of an array of integers: inside blocks, from the totals of the blocks before."""
    v, zero = F.col("_v"), F.lit(0)
    last = F.greatest(F.floor((F.size(v) - 1) / BLOCK).cast("int"), F.lit(0))
    df = df.withColumn("_v", values)
    df = df.withColumn("_b", F.transform(F.sequence(zero, last), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
    df = df.withColumn("_o", F.transform("_b", lambda block: F.aggregate(block, zero, combine)))
    before = F.transform(F.sequence(zero, F.size("_o") - 1), lambda b: F.aggregate(F.slice(F.col("_o"), F.lit(1), b), zero, combine))
    both = F.arrays_zip(F.col("_b").alias("block"), before.alias("start"))
    return df.withColumn(out, F.flatten(F.transform(both, lambda z: F.transform(
        z["block"], lambda _, i: F.aggregate(F.slice(z["block"], F.lit(1), i + 1), z["start"], combine))))).drop("_v", "_b", "_o")


def _tag(part: Column) -> Column:
    return F.regexp_extract(part, r"^</?[A-Za-z][^>]*>?", 0)


def _parts(html: Column) -> Column:
    """The markup, cut before every tag."""
    return F.split(html, r"(?=</?[A-Za-z])", -1)


def with_spans(df: DataFrame, parts: str, wanted: str, out: str) -> DataFrame:
    """Sorted (start, end) places of the elements whose opening tag matches ``wanted``; end is the place of the
    closing tag, or the number of parts.

    All tags stand in one array by name and place. Their running depth is a constant off from one name to the next;
    by name, depth and place, an opening tag is followed by the closing tag that ends it.
    """
    tags = F.transform(parts, lambda p, i: F.struct(_tag(p).alias("tag"), i.alias("at")))
    named = F.transform(tags, lambda t: F.struct(
        F.lower(F.regexp_extract(t["tag"], r"^</?(\w+)", 1)).alias("name"), t["at"].alias("at"),
        F.startswith(t["tag"], F.lit("</")).alias("closes"), F.endswith(t["tag"], F.lit("/>")).alias("empty"),
        t["tag"].rlike(wanted).alias("wanted")))
    df = df.withColumn("_t", F.filter(named, lambda t: ~t["empty"] & ~t["name"].isin("", *VOID_TAGS)))
    df = df.withColumn("_w", F.array_distinct(F.transform(F.filter("_t", lambda t: t["wanted"]), lambda t: t["name"])))
    df = df.withColumn("_t", F.when(F.size("_w") > 0, F.array_sort(F.filter("_t", lambda t: F.array_contains(F.col("_w"), t["name"]))))
                       .otherwise(F.slice("_t", 1, 0)))
    df = with_running(df, F.transform("_t", lambda t: F.when(t["closes"], -1).otherwise(1)), "_d", lambda a, x: a + x)
    levels = F.zip_with("_t", "_d", lambda t, d: F.struct(
        t["name"].alias("name"), F.when(t["closes"], d + 1).otherwise(d).alias("level"), t["at"].alias("at"),
        t["closes"].alias("closes"), t["wanted"].alias("wanted")))
    df = df.withColumn("_l", F.array_sort(levels))
    after = F.slice(F.col("_l"), F.lit(2), F.size("_l"))
    ended = F.transform(F.arrays_zip(F.col("_l").alias("x"), after.alias("y")), lambda z: F.struct(
        z["x"]["at"].alias("start"),
        F.when((z["y"]["name"] == z["x"]["name"]) & (z["y"]["level"] == z["x"]["level"]) & z["y"]["closes"], z["y"]["at"])
        .otherwise(F.size(parts)).alias("end"),
        (z["x"]["wanted"] & ~z["x"]["closes"]).alias("ok")))
    found = F.transform(F.filter(ended, lambda z: z["ok"]), lambda z: F.struct(z["start"].alias("start"), z["end"].alias("end")))
    return df.withColumn(out, F.array_sort(found)).drop("_t", "_w", "_d", "_l")


def with_markup(df: DataFrame, html: Column, rules: MarkupRules, out: str) -> DataFrame:
    """REL-1: the container's markup without comments, raw content, and noise elements of any depth with all that is
    inside them. Spans of noise that overlap are one gap; what follows its closing tag stays."""
    bare = F.regexp_replace(container(html, rules), r"(?s)<!--.*?-->", "")
    raw = "|".join(t for t in rules.noise_tags if t in RAW_TAGS)
    if raw:
        bare = F.regexp_replace(bare, rf"(?is)<({raw})\b[^>]*>.*?</\1\s*>", " ")
    noise = r"<(?:(?i:" + "|".join(rules.noise_tags) + r"))\b"
    if rules.noise_classes:
        names = "(?:" + "|".join(rules.noise_classes) + ")"
        quoted = rf"[\"'](?:[^\"']*[\s_-])?{names}(?:[\s_-][^\"']*)?[\"']"
        noise += rf"|<\w+\b[^>]*\bclass\s*=\s*(?:{quoted}|{names}(?=[\s/>]))"
    df = df.withColumn("_h", bare)
    # Pages in which nothing is noise are not cut.
    df = df.withColumn("_p", F.when(F.col("_h").rlike(noise), _parts(F.col("_h"))).otherwise(F.array().cast("array<string>")))
    df = with_spans(df, "_p", f"^(?:{noise})", "_n")
    df = with_running(df, F.transform("_n", lambda s: s["end"]), "_r", lambda a, x: F.greatest(a, x))
    # A span opens a gap if all spans before it end before it starts; the gap ends where the last one before the next gap does.
    earlier = F.concat(F.array(F.lit(-1)), F.col("_r"))
    opens = F.filter(F.transform(F.arrays_zip(F.col("_n").alias("s"), earlier.alias("reach")), lambda z, k: F.struct(
        z["s"]["start"].alias("start"), z["reach"].alias("reach"), k.alias("k"))),
        lambda g: g["start"].isNotNull() & (g["reach"] <= g["start"]))
    df = df.withColumn("_g", opens)
    ends = F.concat(F.transform(F.slice(F.col("_g"), F.lit(2), F.size("_g")), lambda g: g["reach"]), F.array(F.array_max("_r")))
    starts = F.concat(F.transform(F.slice(F.col("_g"), F.lit(2), F.size("_g")), lambda g: g["start"]), F.array(F.size("_p")))
    rest = F.transform(F.arrays_zip(ends.alias("end"), starts.alias("stop")), lambda z: F.concat(
        F.regexp_replace(F.coalesce(F.get(F.col("_p"), z["end"]), F.lit("")), r"^</?[A-Za-z][^>]*>?", " "),
        F.array_join(F.slice(F.col("_p"), z["end"] + 2, F.greatest(z["stop"] - z["end"] - 1, F.lit(0))), "")))
    head = F.array_join(F.slice(F.col("_p"), F.lit(1), F.get("_g", F.lit(0))["start"]), "")
    return (df.withColumn(out, F.when(F.size("_g") > 0, F.concat(head, F.array_join(rest, ""))).otherwise(F.col("_h")))
            .drop("_h", "_p", "_n", "_r", "_g"))


def _first_element(rest: Column) -> Column:
    """The element that ``rest`` begins with; all of ``rest`` if it is never closed.

    The text is cut before each tag of the same name, and the depth is counted over the pieces.
    """
    tag = F.lower(F.regexp_extract(rest, r"^<(\w+)", 1))
    pieces = F.split(rest, F.concat(F.lit("(?i)(?=</?"), tag, F.lit(r"\b)")), -1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("end"))

    def step(at: Column, piece: Column) -> Column:
        depth = at["depth"] + F.when(F.startswith(piece, F.lit("</")), -1).otherwise(1)
        closed = (at["end"] == 0) & (depth == 0)
        return F.struct(depth.alias("depth"), (at["seen"] + 1).alias("seen"),
                        F.when(closed, at["seen"]).otherwise(at["end"]).alias("end"))

    def cut(parts: Column) -> Column:
        end = F.aggregate(F.filter(parts, lambda p: p != ""), start, step, lambda at: at["end"])
        return bind(end, lambda n: F.when(n > 0, F.array_join(F.slice(F.filter(parts, lambda p: p != ""), F.lit(1), n), ""))
                    .otherwise(F.array_join(parts, "")))

    return F.when(rest.isNotNull(), bind(pieces, cut))


def container(html: Column, rules: MarkupRules) -> Column:
    """The first listed container (or the body, or the page), up to its own closing tag."""
    found = [F.nullif(F.regexp_extract(
        html, rf"(?is)<\w+\b[^>]*\bid\s*=\s*[\"']{name}[\"'].*", 0), F.lit("")) for name in rules.containers]
    found = [bind(rest, _first_element) for rest in found]
    body = F.nullif(F.regexp_extract(html, r"(?is)<body\b.*", 0), F.lit(""))
    return F.coalesce(*found, body, html)


def visible_text(fragment: Column, rules: MarkupRules) -> Column:
    """STR-3/STR-4: tags become gaps, references are decoded, noise phrases go."""
    plain = tx.decode_html(F.regexp_replace(fragment, r"(?s)<[^>]*>", " "))
    return tx.collapse_ws(tx.drop_phrases(plain, rules.noise_phrases))


def line_text(bare: Column, rules: MarkupRules) -> Column:
    """Text of the markup with block boundaries kept as newlines (input of the text fallback)."""
    broken = F.regexp_replace(bare, r"(?i)</(?:div|p|li|h[1-6]|tr|section|article)\s*>|<br\s*/?>", "\n")
    plain = tx.drop_phrases(tx.decode_html(F.regexp_replace(broken, r"(?s)<[^>]*>", " ")), rules.noise_phrases)
    return F.trim(F.regexp_replace(plain, r"(?U)[^\S\n]+", " "))


def header_kind(text: Column, rules: MarkupRules) -> Column:
    """REL-4."""
    return (F.when(text.rlike(rules.chapter), "chapter")
            .when(text.rlike(rules.section), "section")
            .when(text.rlike(rules.part), "part")
            .otherwise("generic"))


def _role_of(tag: Column, rules: MarkupRules) -> Column:
    role = F.lit(None).cast("string")
    for rule in reversed(rules.rules):
        role = F.when(tag.rlike("^<" + rule.opener()), F.lit(rule.role)).otherwise(role)
    return role


def _read(fragments: Column, rules: MarkupRules) -> Column:
    """Array of (role, header_kind, text) from markup fragments that start with their opening tag."""
    # One transform per step: a lambda argument is evaluated once, an expression each time it is named.
    tagged = F.filter(
        F.transform(fragments, lambda b: F.struct(
            _role_of(F.regexp_extract(b, r"^<[^>]*>", 0), rules).alias("role"),
            F.regexp_replace(b, r"(?s)<[^>]*>", " ").alias("text"))),
        lambda e: e["role"].isNotNull())
    decoded = F.transform(tagged, lambda e: F.struct(
        e["role"].alias("role"),
        tx.collapse_ws(tx.drop_phrases(tx.decode_html(e["text"]), rules.noise_phrases)).alias("text")))
    kept = F.filter(decoded, lambda e: e["text"] != "")
    return F.transform(kept, lambda e: F.struct(
        e["role"].alias("role"),
        F.when(e["role"] == HEADER, header_kind(e["text"], rules)).alias("header_kind"),
        e["text"].alias("text")))


def with_elements(df: DataFrame, html: Column, rules: MarkupRules, out: str = "elements", bare: str = "_bare") -> DataFrame:
    """DOC-1, REL-1..4: array of (role, header_kind, text) in page order, and the markup it was read from.

    Nested elements come in the order of their opening tags, each with all text between its own tags.
    """
    df = with_markup(df, html, rules, bare)
    if rules.leaf_tags:
        opener = "|".join(r.opener() for r in rules.rules)
        stop = opener + r"|/(?:" + "|".join(rules.leaf_tags) + r")\b"
        blocks = F.regexp_extract_all(F.col(bare), F.lit(rf"(?s)<(?:{opener}).*?(?=<(?:{stop})|\z)"), F.lit(0))
        return df.withColumn(out, _read(blocks, rules))
    df = df.withColumn("_p", _parts(F.col(bare)))
    df = with_spans(df, "_p", "|".join("^<" + r.opener() for r in rules.rules if r.role is not None), "_s")
    fragments = F.transform("_s", lambda s: F.array_join(F.slice(F.col("_p"), s["start"] + 1, s["end"] - s["start"]), ""))
    # The parts are named twice, see above.
    return df.withColumn(out, F.when(F.size("_p") > 0, _read(fragments, rules))).drop("_p", "_s")


def html_elements(pages: DataFrame, id_col: str, html_col: str, rules: MarkupRules) -> DataFrame:
    """DOC-1 as rows: (id, pos, role, header_kind, text)."""
    df = with_elements(pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("_html")), F.col("_html"), rules)
    return explode_rows(df, "elements", "pos", "e", "id").select("id", "pos", "e.role", "e.header_kind", "e.text")
