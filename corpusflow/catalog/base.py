"""Registry of queries and SQL fragments shared by the checking statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusflow.functions.prompts import CHAT_TEMPLATE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as its files are split; ``corpusflow.input.partitions``, if the session sets it, deals the rows anew.

    The setting is for tables of one row group (tests, bench); it is never decided by size.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    dealt = spark.conf.get("corpusflow.input.partitions", None)
    return rows.repartition(int(dealt)) if dealt else rows


# --- SQL fragments (DuckDB's regular expressions have ASCII \s only) ---
WS = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split({collapse(x)}, ' '), lambda w: w <> '')"


def tokens(n: str) -> str:
    return f"(CASE WHEN {n} = 0 THEN 0 ELSE greatest(1, round_even({n} * 1.3, 0)::INT) END)"


def estimate(x: str) -> str:
    return tokens(f"len({words(x)})")


def sentences(x: str) -> str:
    """Sentences of one paragraph: a mark is set at each gap, then the text is split there."""
    marked = (f"regexp_replace({collapse(x)}, "
              r"""'([.!?…]["''”»]*) ([\p{Lu}\p{N}(\[«"])', '\1' || chr(1) || '\2', 'g')""")
    return f"list_filter(string_split({marked}, chr(1)), lambda s: s <> '')"


def units(x: str) -> str:
    blocks = (f"list_filter(regexp_split_to_array({x}, '\\n[{WS}]*\\n+'), "
              f"lambda p: regexp_matches(p, '[^{WS}]'))")
    lines = f"list_filter(string_split({x}, chr(10)), lambda p: regexp_matches(p, '[^{WS}]'))"
    paras = f"(CASE WHEN len({blocks}) > 1 THEN {blocks} ELSE {lines} END)"
    return f"flatten(list_transform({paras}, lambda p: {sentences('p')}))"


def match_norm(x: str) -> str:
    return collapse(f"""lower(translate({x}, '‘’`“”İΣ', '''''''""iσ'))""")


def intent_norm(x: str) -> str:
    return collapse(f"""lower(translate({x}, '‘’`ʻʼİΣ', '''''''''''iσ'))""")


def slug(x: str) -> str:
    kept = f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_{WS}-]', '', 'g')"
    dashed = f"trim(regexp_replace({kept}, '[{WS}_]+', '-', 'g'), '-')"
    return f"(CASE WHEN {dashed} = '' THEN 'chunk' ELSE {dashed} END)"


def any_of(x: str, cues) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(c)})" for c in cues) + ")"


def chat_prompt_sql(system, user):
    before, between, after = CHAT_TEMPLATE.split("%s")
    return f"{q(before)} || {system} || {q(between)} || {user} || {q(after)}"
