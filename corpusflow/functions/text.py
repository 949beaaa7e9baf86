"""String, token and hash expressions (Column -> Column, all JVM-side)."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.rows import bind
from corpusflow.settings import TOKENS_PER_WORD

# Unicode White_Space, as Java's (?U)\s; nearly all characters are told apart by the first range.
_SPACE = (r"[[^!-~]&&[[ ][\t\n\x0B\f\r\x85\xA0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]")
# Whitespace runs other than a single space, which would be replaced by itself.
WS_RUN = rf"{_SPACE}(?:{_SPACE}++|(?<! ))"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_ws(c: Column | str) -> Column:
    """STR-1: every whitespace run becomes one space, ends trimmed."""
    return F.trim(F.regexp_replace(_col(c), WS_RUN, " "))


def is_blank(c: Column | str) -> Column:
    return ~F.coalesce(_col(c), F.lit("")).rlike(r"(?U)\S")


def words(c: Column | str) -> Column:
    flat = collapse_ws(c)
    return F.filter(F.split(flat, " ", -1), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    """Number of whitespace-separated words."""
    return F.array_size(F.array_remove(F.split(collapse_ws(c), " ", -1), ""))


def tokens_from_words(n: Column) -> Column:
    """NUM-1 on a word count: half-even rounding (one word gives 1, none gives 0)."""
    return F.bround(n * F.lit(TOKENS_PER_WORD), 0).cast("int")


def estimate_tokens(c: Column | str) -> Column:
    """NUM-1: estimated tokens of a text."""
    return tokens_from_words(word_count(c))


def sha256_hex(c: Column | str) -> Column:
    """NUM-2."""
    return F.sha2(_col(c), 256)


# The five XML entities in decoding order (order matters for "&amp;quot;").
XML_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'"))


def decode_entities(c: Column | str) -> Column:
    """STR-2."""
    out = _col(c)
    for entity, char in XML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def _named_references() -> Column:
    """All named character references of HTML as one constant map; a no-break space is read as a space."""
    names = {name: char.replace("\u00a0", " ") for name, char in html5.items() if name.endswith(";")}
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _code_point(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def decode_html(c: Column | str) -> Column:
    """Character references of HTML text, each decoded once; what is no reference stays as it is."""
    src = _col(c)
    named = _named_references()

    def read(p: Column) -> Column:
        return F.struct(p.alias("p"), F.regexp_extract(p, r"^(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", 0).alias("ref"),
                        F.coalesce(F.regexp_extract(p, r"^#0*([0-9]{1,7});", 1).try_cast("long"),
                                   F.conv(F.nullif(F.regexp_extract(p, r"^#[xX]0*([0-9a-fA-F]{1,6});", 1), F.lit("")), 16, 10)
                                   .try_cast("long")).alias("code"))

    def written(r: Column) -> Column:
        code = r["code"]
        ok = code.isNotNull() & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.when(ok, _code_point(code)).otherwise(F.when(r["ref"] != "", F.try_element_at(named, r["ref"])))
        rest = F.substr(r["p"], F.length(r["ref"]) + 1)
        return F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), r["p"]))

    parts = F.split(src, "&", -1)
    decoded = F.transform(F.transform(F.slice(parts, F.lit(2), F.size(parts)), read), written)
    out = F.concat(F.get(parts, F.lit(0)), F.array_join(decoded, ""))
    return F.when(F.contains(src, F.lit("&")), out).otherwise(src)


def drop_phrases(c: Column | str, phrases: tuple[str, ...]) -> Column:
    """STR-4: literal phrases, any case, become a space."""
    if not phrases:
        return _col(c)
    pattern = "(?iu)" + "|".join(r"\Q" + p + r"\E" for p in phrases)
    return F.regexp_replace(_col(c), pattern, " ")


# İ and Σ are the characters whose lower form depends on context or has two characters;
# matching works on one character at a time, so they are mapped first.
_LOWER_FROM, _LOWER_TO = "İΣ", "iσ"


# Whitespace runs of ASCII text other than a single space.
_ASCII_RUN = r"[ \t\n\x0B\f\r](?:[ \t\n\x0B\f\r]++|(?<! ))"


def _normalized(c: Column | str, chars: str, to: str) -> Column:
    """Characters mapped, lower case, whitespace collapsed. ASCII text without a grave accent has nothing to map."""
    text = _col(c)
    plain = (F.length(text) == F.octet_length(text)) & ~F.contains(text, F.lit("`"))
    return F.trim(F.when(plain, F.regexp_replace(F.lower(text), _ASCII_RUN, " "))
                  .otherwise(F.regexp_replace(F.lower(F.translate(text, chars + _LOWER_FROM, to + _LOWER_TO)), WS_RUN, " ")))


def normalize_for_match(c: Column | str) -> Column:
    """STR-5: quotes unified, lower case, whitespace collapsed."""
    return _normalized(c, "‘’`“”", "'''\"\"")


def normalize_for_intent(c: Column | str) -> Column:
    """STR-6: as STR-5 but folds the modifier apostrophes and leaves double quotes."""
    return _normalized(c, "‘’`ʻʼ", "'''''")


def slugify(c: Column | str) -> Column:
    """STR-7."""
    kept = F.regexp_replace(F.lower(_col(c)), r"(?U)[^\p{L}\p{N}_\s-]", "")
    dashed = F.btrim(F.regexp_replace(kept, r"(?U)[\s_]+", "-"), F.lit("-"))
    return F.when(dashed == "", F.lit("chunk")).otherwise(dashed)


def chunk_id(source: Column, number: Column, title: Column, part: Column, parts: Column) -> Column:
    """STR-8: ``source__art-<number or slug>[__pN]``; ``part`` counts from 0."""
    named = F.when(F.coalesce(title, F.lit("")) == "", F.lit("article")).otherwise(title)
    key = F.when(F.coalesce(number, F.lit("")) != "", number).otherwise(slugify(named))
    suffix = F.when(parts > 1, F.concat(F.lit("__p"), (part + 1).cast("string"))).otherwise(F.lit(""))
    return F.concat(source, F.lit("__art-"), key, suffix)


def paragraphs(c: Column | str) -> Column:
    """STR-11: blank-line paragraphs, or single lines when there is only one of them."""
    text = _col(c)

    def non_blank(arr: Column) -> Column:
        return F.filter(arr, lambda p: p.rlike(r"(?U)\S"))

    blocks = non_blank(F.split(text, r"(?U)\n\s*\n+", -1))
    lines = non_blank(F.split(text, "\n", -1))
    has_gap = text.rlike(r"(?U)\n\s*\n")
    return F.when(has_gap & (F.size(blocks) > 1), blocks).otherwise(lines)


# A sentence ends at . ! ? … with optional closing quotes, before a space and a plausible
# opening character.  Collapsed text has no line feed, so one marks each gap.
SENTENCE_GAP = r"(?U)([.!?…][\"'”»]*+) (?=[\p{IsUppercase}\p{N}(\[«\"])"


def sentences(c: Column | str) -> Column:
    """STR-10 on one paragraph; whitespace is collapsed."""
    marked = F.regexp_replace(collapse_ws(c), SENTENCE_GAP, "$1\n")
    return F.filter(F.split(marked, "\n", -1), lambda s: s != "")


def units(c: Column | str) -> Column:
    """STR-12: paragraph -> sentence units, collapsed, never empty."""
    return F.flatten(F.transform(paragraphs(c), sentences))


def with_prefix(c: Column | str, prefix: str) -> Column:
    """STR-13."""
    return F.concat(F.lit(prefix), _col(c))


def excerpt(c: Column | str, n: int) -> Column:
    return F.left(_col(c), F.lit(n))


def preview(c: Column | str, n: int = 240) -> Column:
    """STR-20: newlines to spaces, cut at n characters with an ellipsis."""
    flat = F.translate(F.coalesce(_col(c), F.lit("")), "\n", " ")
    cut = F.left(flat, F.lit(n))
    return F.when(F.length(flat) > n, F.concat(cut, F.lit("…"))).otherwise(cut)


# Language cue words.
RU_CUES = ("что", "это", "как", "или", "для", "при", "права", "договор")
EN_CUES = ("the", "and", "what", "which", "contract", "labor", "rights")
UZ_CUES = ("nima", "qanday", "uchun", "boʻyicha", "boyicha", "modda", "kodeks", "shartnoma", "mehnat")


def _hits(tests: list[Column]) -> Column:
    total = F.lit(0)
    for t in tests:
        total = total + t.cast("int")
    return total


def detect_language(c: Column | str) -> Column:
    """STR-14: 'ru', 'en' or 'uz'."""
    return bind(F.lower(_col(c)), lambda lower: bind(
        F.concat(F.lit(" "), collapse_ws(lower), F.lit(" ")), lambda padded: _language(lower, padded)))


def _language(lower: Column, padded: Column) -> Column:
    cyrillic = F.length(F.regexp_replace(lower, "[^Ѐ-ӿ]+", ""))
    latin = F.length(F.regexp_replace(lower, "[^a-z]+", ""))
    ru = _hits([F.contains(lower, F.lit(w)) for w in RU_CUES])
    uz = _hits([F.contains(lower, F.lit(w)) for w in UZ_CUES])
    en = _hits([F.contains(padded, F.lit(f" {w} ")) for w in EN_CUES])
    return (F.when((cyrillic > latin) | (ru >= 2), F.lit("ru"))
            .when((en >= 2) & (en > uz), F.lit("en"))
            .otherwise(F.lit("uz")))


# Fixed values of the repetition test.
REPEAT_MIN, REPEAT_MAX, REPEAT_TIMES = 40, 240, 3


def tail_repeats(c: Column | str) -> Column:
    """REL-15: the text ends in one unit of 40..240 characters written three times.

    A repeated unit puts the last 40 characters somewhere earlier in the tail; that
    single search settles nearly every text before unit lengths are tried.
    """
    text = _col(c)
    n = F.length(text)
    tail = F.right(text, F.lit(REPEAT_MAX * REPEAT_TIMES))
    last = F.right(text, F.lit(REPEAT_MIN))
    before = F.left(tail, F.length(tail) - REPEAT_MIN)
    longest = F.least(F.lit(REPEAT_MAX), F.floor(n / REPEAT_TIMES)).cast("int")
    found = F.exists(
        F.sequence(F.lit(REPEAT_MIN), longest),
        lambda u: F.right(tail, u * REPEAT_TIMES) == F.repeat(F.right(tail, u), F.lit(REPEAT_TIMES)))
    return (F.when(n < REPEAT_MIN * REPEAT_TIMES, F.lit(False))
            .when(~F.contains(before, last), F.lit(False))
            .otherwise(found))


def snapshot_stamp(ts: Column | str) -> Column:
    """DT-2: compact UTC stamp of a timestamp."""
    return F.date_format(_col(ts), "yyyyMMdd'T'HHmmss'Z'")
