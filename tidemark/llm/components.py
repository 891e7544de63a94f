"""Connected components of an edge table, by alternating stars.

Each round replaces every edge (u, v) by edges to the smallest neighbour: first from the
larger neighbours of each node (large star), then from the smaller ones (small star). The
components are kept and the graph becomes one star for each component, in a number of
rounds that grows with the logarithm of its size. Rounds are joins and minimum aggregates
with partial sums, so a node with very many edges costs no task more than its share; the
edges of a round are a written table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise

#: Edges of a round that a task writes, at least, where there are more than two such tasks a core.
ROWS_A_FILE = 50_000


def _signature(edges: DataFrame) -> tuple[int, int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h"), F.sum(F.pmod(F.col("v"), F.lit(1 << 40))).alias("v")).first()
    return r.n, r.h or 0, r.v or 0


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    rest = down.join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """``edges``: u and v, long. Returns node and root (its component's smallest node) of all but the roots."""
    edges = materialise(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _signature(edges)
    while before[0]:
        # few edges are written by few tasks; each file costs the executor a process of its own
        few = max(2 * edges.sparkSession.sparkContext.defaultParallelism, before[0] // ROWS_A_FILE)
        edges = materialise(_small_star(_large_star(edges).distinct()).distinct().coalesce(few), "edges")
        now = _signature(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
