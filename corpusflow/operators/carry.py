"""WIN-1/WIN-2 for elements that already lie in separate rows (chat turns, exported tables).

A key may own any share of the rows, so nothing is windowed over a whole key: positions are
cut into blocks, each block is summarised by a hash aggregate, the (few) summaries are
carried forward per key, and rows are then windowed inside their block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.operators.articles import article_text
from corpusflow.operators.markup import CLAUSE, HEADER, TEXT


def carry_last(df: DataFrame, key: str, pos: str, events: list[str], block_rows: int = 100_000) -> DataFrame:
    """Each event column becomes its last non-null value up to and including the row."""
    df = df.withColumn("_block", F.floor(F.col(pos) / block_rows))
    ends = df.groupBy(key, "_block").agg(*[
        F.max_by(F.col(e), F.when(F.col(e).isNotNull(), F.col(pos))).alias(e) for e in events])
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, "_block", *[
        F.last(e, ignorenulls=True).over(earlier).alias(f"_in_{e}") for e in events])
    inside = (Window.partitionBy(key, "_block").orderBy(pos)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = df.join(carried, [key, "_block"])
    return joined.select(
        *[c for c in df.columns if c not in events and c != "_block"],
        *[F.coalesce(F.last(e, ignorenulls=True).over(inside), F.col(f"_in_{e}")).alias(e) for e in events])


def islands(elements: DataFrame, key: str, block_rows: int = 100_000) -> DataFrame:
    """Rows (key, pos, role, header_kind, text) gain chapter, section and the opener's position."""
    chapterish = F.col("header_kind").isin("chapter", "part", "generic")
    first = (elements.where((F.col("role") == HEADER) & chapterish)
             .groupBy(key).agg(F.min("pos").alias("_first_chapter")))
    df = elements.join(first, key, "left")
    generic = F.col("header_kind") == "generic"
    opens = F.col("header_kind").isin("chapter", "part") | (generic & (F.col("pos") == F.col("_first_chapter")))
    is_header = F.col("role") == HEADER
    df = (df.withColumn("chapter", F.when(is_header & opens, F.col("text")))
          .withColumn("section_title", F.when(is_header & (F.col("header_kind") == "chapter"), F.lit(""))
                      .when(is_header & ((F.col("header_kind") == "section") | (generic & ~opens)), F.col("text")))
          .withColumn("opener", F.when(F.col("role").isin(HEADER, CLAUSE), F.col("pos")))
          .drop("_first_chapter"))
    return carry_last(df, key, "pos", ["chapter", "section_title", "opener"], block_rows)


def island_articles(elements: DataFrame, key: str, block_rows: int = 100_000) -> DataFrame:
    """Articles of row-form elements: (key, pos, article_title, chapter, section_title, text).

    The body of one article is one text value by definition; it is gathered per article,
    never per key.
    """
    placed = islands(elements, key, block_rows)
    bodies = F.array_sort(F.collect_list(F.when(F.col("role") == TEXT, F.struct("pos", "text"))))
    clause = F.col("role") == CLAUSE
    grouped = (placed.where(F.col("opener").isNotNull()).groupBy(key, F.col("opener").alias("pos")).agg(
        F.max(F.when(clause, F.col("text"))).alias("article_title"),
        F.max(F.when(clause, F.coalesce("chapter", F.lit("")))).alias("chapter"),
        F.max(F.when(clause, F.coalesce("section_title", F.lit("")))).alias("section_title"),
        F.array_join(F.transform(bodies, lambda b: b["text"]), " ").alias("body")))
    return (grouped.where(F.col("article_title").isNotNull())
            .withColumn("text", article_text(F.col("article_title"), F.col("body"))).drop("body"))


def preambles(elements: DataFrame, key: str, block_rows: int = 100_000) -> DataFrame:
    """Text outside any article, joined per key."""
    placed = islands(elements, key, block_rows)
    heads = elements.where(F.col("role") == HEADER).select(key, F.col("pos").alias("opener"), F.lit(True).alias("_h"))
    loose = (placed.where(F.col("role") == TEXT).join(heads, [key, "opener"], "left")
             .where(F.col("opener").isNull() | F.col("_h")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return loose.groupBy(key).agg(F.array_join(F.transform(ordered, lambda b: b["text"]), " ").alias("preamble"))
