"""Traces put together: the span each span waited for, and its root, depth and critical path.

A span has a parent or, as a batch of N, links to the spans of its members; both are edges to
spans before it. Of its edges the one to the span that ended last is the one it waited for (ties: the smaller
id). Those make a forest, in which pointers are doubled: each round joins every span that
isn't at its root with the span it points to, so a path of n spans takes log2(n) + 1 rounds.

Cases. An edge to a span that isn't in the table, or to itself, is none; a span without edges is a root. Repeated
edges count once; span ids are unique and not null. Null ends come before all others, null costs are zero. Spans on or
behind a cycle have no root: their root, depth and cost are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise


def waited_for(spans: DataFrame, edges: DataFrame, span: str = "span", end: str = "end") -> DataFrame:
    """``span`` and ``before``, the span that each waited for; spans without one are left out. ``edges``: span and before."""
    ends = spans.select(F.col(span).alias("before"), F.col(end).alias("_end"))
    known = edges.select("span", "before").where("span <> before").join(ends, "before")
    last = F.max_by("before", F.struct(F.col("_end"), -F.col("before")))
    return known.groupBy("span").agg(last.alias("before"))


def paths(spans: DataFrame, before: DataFrame, span: str = "span", cost: str = "cost") -> DataFrame:
    """Per span: ``root``, ``depth`` (edges to it) and ``path_cost``, the costs along the path, its own and the root's included.

    Whole-number costs give exact sums. Each round is a written table.
    """
    first = spans.select(F.col(span).alias("span"), F.coalesce(F.col(cost), F.lit(0)).alias("path_cost"))
    at = first.join(before.select("span", F.col("before").alias("to")), "span", "left")
    at = materialise(at.select("span", "to", F.col("to").isNotNull().cast("long").alias("depth"), "path_cost", F.when(F.col("to").isNull(), F.col("span")).alias("root")), "trace")
    rounds = None
    # a path of n spans is at its root after log2(n) rounds; what isn't by then is on a cycle or leads to one
    while rounds is None or rounds > 0:
        left = at.where("to is not null").count()
        if not left:
            break
        rounds = (at.count().bit_length() + 1 if rounds is None else rounds) - 1
        next_ = at.select(F.col("span").alias("_s"), F.col("to").alias("_to"), F.col("depth").alias("_depth"), F.col("path_cost").alias("_cost"), F.col("root").alias("_root"))
        open_ = at.where("to is not null").join(next_, F.col("to") == F.col("_s"))
        moved = open_.select("span", F.col("_to").alias("to"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("path_cost") + F.col("_cost")).alias("path_cost"), F.col("_root").alias("root"))
        at = materialise(at.where("to is null").unionByName(moved), "trace")
    done = F.col("to").isNull()
    return at.select("span", "root", F.when(done, F.col("depth")).alias("depth"), F.when(done, F.col("path_cost")).alias("path_cost"))
