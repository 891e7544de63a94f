"""Sketched quantiles against exact ranks; merged against whole."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import latency


def off(values, found, q):
    """How far the fraction is from the ranks that the value has."""
    low, high = np.searchsorted(values, found, "left") / len(values), np.searchsorted(values, found, "right") / len(values)
    return max(0.0, low - q, q - high)


def test_rank_error_merged_and_whole(spark):
    r = np.random.default_rng(1)
    rows = [(int(i % 7), ["a", "b", None][i % 3], float(v)) for i, v in enumerate(np.concatenate([r.exponential(3, 15_000), np.full(9000, 2.0)]))]
    df = spark.createDataFrame(rows, "day int, tag string, s double").repartition(6)
    fractions = {"p01": 0.01, "p50": 0.5, "p99": 0.99}
    merged = latency.quantiles(latency.rolled_up(latency.sketches(df, ["tag", "day"], F.col("s")), ["tag"]), **fractions)
    whole = latency.quantiles(latency.sketches(df, ["tag"], F.col("s")), **fractions)
    for got in (merged.collect(), whole.collect()):
        assert len(got) == 3
        for g in got:
            values = np.sort([s for _, tag, s in rows if tag == g.tag])
            assert (g.n, g.max_s) == (len(values), values[-1])
            assert abs(g.sum_s - values.sum()) < 1e-6
            assert all(off(values, g[name], q) <= 2 * latency.rank_error() for name, q in fractions.items())


def test_without_durations(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", 1, 3), ("b", 1, None)], "tag string, x int, y int")
    d = latency.seconds(F.timestamp_seconds("x"), F.timestamp_seconds("y"))
    assert [(r.tag, r.n, r.p50) for r in latency.quantiles(latency.sketches(df, ["tag"], d), p50=0.5).collect()] == [("b", 1, 2.0)]
    assert latency.rolled_up(latency.sketches(df.limit(0), ["tag"], d), ["tag"]).count() == 0
