"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two hash aggregations and two joins over the edges; a round at least halves the depth of the
trees that the edges form, so the number of rounds follows the logarithm of the longest chain. A vertex that
holds a third of all edges is never gathered: its least neighbour is an aggregate that is combined before the
exchange, and the join of its edges with that minimum can be split by adaptive execution.

A round never adds edges, so their number bounds the rows of every table of the rounds that follow. A few thousand
edges dealt to some hundred partitions are as many files of a few rows, for each of the exchanges and stored tables of
each round; so the tables of a round get no more partitions than their edges fill, and few edges are joined in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import stored
from corpusflow.llm.runs import partitions

EDGES_A_PARTITION = 10_000  # two ids each: 160 kB
EDGES_SENT = 50_000         # of so many the least neighbours go to every task: 100,000 rows of two ids at most, 1.6 MB


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("n")),
                                          F.struct(F.col("b").alias("v"), F.col("a").alias("n")))).alias("e")).select("e.*")


def _filled(table: DataFrame, edges: int) -> DataFrame:
    """In no more partitions than so many edges fill; from where they fill the session's, as they are dealt."""
    most = 1 + edges // EDGES_A_PARTITION
    return table.coalesce(most) if most < partitions(table) else table


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """Large star: link every larger neighbour of v to v's least neighbour (or v). Small star: the smaller ones, and v.

    ``n`` is the number of edges, or more.
    """
    around = _both(edges)
    if not large:
        around = around.where("n < v")
    # Stored, so that the join below is between two exchanges and a hot vertex can be split.
    least = stored(_filled(around.groupBy("v").agg(F.min("n").alias("m")).select("v", F.least("v", "m").alias("m")), n))
    linked = around.join(F.broadcast(least) if n <= EDGES_SENT else least, "v")
    if large:
        out = linked.where("n > v").select(F.col("m").alias("a"), F.col("n").alias("b"))
    else:
        out = linked.where("n <> m").select(F.col("m").alias("a"), F.col("n").alias("b")).unionByName(
            least.select(F.col("m").alias("a"), F.col("v").alias("b")))
    return _filled(_filled(out.where("a <> b"), n).distinct(), n)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(v, component): the least vertex reachable from every vertex that has an edge.

    Repeated edges, loops and null ends are dropped. An empty table gives an empty one.
    """
    now = stored(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
                 .where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`").distinct())
    digest, n = None, now.count()
    now = _filled(now, n)
    while True:
        now = stored(_star(_star(now, True, n), False, n))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == digest:
            break
        digest, n = tuple(seen), seen[0]
    # Nothing changes any more, so every edge goes from a component's least vertex to another vertex.
    return (now.select(F.col("b").alias("v"), F.col("a").alias("component"))
            .unionByName(now.select(F.col("a").alias("v"), F.col("a").alias("component")).distinct()))
