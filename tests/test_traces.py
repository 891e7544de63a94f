"""Traces against a walk of each span."""

import random

from pyspark.sql import functions as F

from tidemark.operators import traces


def walked(spans, edges):
    end, cost = {s: e for s, e, _ in spans}, {s: c for s, _, c in spans}
    before = {}
    for s, b in edges:
        if b in end and s != b:
            before.setdefault(s, set()).add(b)
    rank = lambda b: (end[b] is not None, end[b] or 0, -b)
    best = {s: max(bs, key=rank) for s, bs in before.items()}
    out = {}
    for s in end:
        at, seen, total = s, {s}, cost[s] or 0
        while at in best and best[at] not in seen:
            at = best[at]
            seen.add(at)
            total += cost[at] or 0
        out[s] = (None, None, None) if at in best else (at, len(seen) - 1, total)
    return out


def found(spark, spans, edges):
    s, e = spark.createDataFrame(spans, "span long, end long, cost long"), spark.createDataFrame(edges, "span long, before long")
    return {r.span: (r.root, r.depth, r.path_cost) for r in traces.paths(s, traces.waited_for(s, e)).collect()}


def test_fan_out_batches_and_cycles(spark):
    r = random.Random(3)
    spans = [(k, r.choice([None, r.randrange(50)]), r.choice([None, r.randrange(9)])) for k in range(300)]
    edges = [(k, r.randrange(k)) for k in range(1, 280) for _ in range(r.choice([0, 1, 1, 4]))]
    edges += [(280, 281), (281, 280), (282, 281), (283, 283), (284, 9999), *edges[:20]]
    assert found(spark, spans, edges) == walked(spans, edges)
    assert found(spark, [], []) == {}


def test_a_long_trace(spark):
    """100,000 spans in one path."""
    s = spark.range(100_000).select(F.col("id").alias("span"), F.col("id").alias("end"), F.lit(2).cast("long").alias("cost"))
    got = traces.paths(s, traces.waited_for(s, s.select("span", (F.col("span") - 1).alias("before"))))
    assert got.where("root = 0 and depth = span and path_cost = 2 * (span + 1)").count() == 100_000
