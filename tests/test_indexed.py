"""Indexed logs and hot keys against plain scans; what a log's range reads is measured on the plan."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import windowing
from tidemark.session import new_dir
from tidemark.sources import log, ranges

ROWS = 6000


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(5)
    rows = [("a" if k % 3 else "b", k % 2, k // 6, 1_700_000_000 + k // 6 * 10 + rng.randint(-400, 400), f"v{k}") for k in range(ROWS) if rng.random() > 0.2]
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, s long, value string")
    return df.withColumn("timestamp", F.timestamp_seconds("s")).drop("s").repartition(4)


@pytest.fixture(scope="module")
def stored(spark, records):
    return log.write(records, new_dir(spark, "log"), segment=100, every=20)


def scans(df):
    """Files and rows of each scan of segments in the plan that ran."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(p.plan())
            continue
        if name.startswith("Scan parquet") or name.startswith("FileScan"):
            m = p.metrics()
            out.append((m.apply("numFiles").value(), m.apply("numOutputRows").value()))
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.length())]
    return out


PROVIDERS = [
    ranges.RangeProvider(ranges.raw(110).to(ranges.raw(240))),
    ranges.RangeProvider(ranges.timestamp(1_700_003_000_000).to(ranges.timestamp(1_700_003_500_000))),
    ranges.RangeProvider(ranges.timestamp(1_800_000_000_000).to(ranges.latest())),
    ranges.RangeProvider(ranges.group().to(ranges.latest())),
    ranges.RangeProvider(ranges.earliest().as_range()),
    ranges.RangeProvider(by_partition={("a", 0): ranges.raw(5).to(ranges.raw(7)), ("b", 1): ranges.latest().as_range()}),
    ranges.RangeProvider(ranges.earliest().to(ranges.latest())).starting_from("a", 1, 950),
]


@pytest.mark.parametrize("provider", PROVIDERS)
def test_log_reads_what_a_scan_reads(spark, records, stored, provider):
    committed = spark.createDataFrame([("a", 0, 900), ("a", 1, 10_000), ("b", 0, None)], "topic string, partition int, committed long")
    pick = lambda df: sorted(map(tuple, df.select("topic", "partition", "offset", "value").collect()))
    want = pick(ranges.read(records, provider, committed))
    assert pick(stored.read(provider, committed)) == want
    assert sorted(map(tuple, stored.lag(committed, "earliest").collect())) == sorted(map(tuple, ranges.lag(records, committed, "earliest").collect()))


def test_log_opens_only_what_the_index_admits(stored):
    day = ranges.RangeProvider(ranges.timestamp(1_700_003_000_000).to(ranges.timestamp(1_700_003_500_000)))
    resolved = stored.resolve(day).collect()
    segments = sum(r.max_offset // 100 - r.min_offset // 100 + 1 for r in resolved)
    (files, rows), = scans(stored.read(day))
    assert files == segments < 12
    assert rows <= 2 * 100 * segments  # two records of an offset
    blocks = [x for x in scans(stored.bounds([1_700_003_000_000])) if x[0] == 4]
    assert blocks, "a block in one segment for each of four partitions"


def test_log_beyond_literals_and_empty(spark, records, stored, monkeypatch):
    want = stored.read(PROVIDERS[0]).count()
    monkeypatch.setattr(log, "LITERALS", 1)
    assert stored.read(PROVIDERS[0]).count() == want > 0
    none = log.write(records.where("false"), new_dir(spark, "log"), segment=100, every=20)
    assert none.read(PROVIDERS[0]).count() == 0
    with pytest.raises(ValueError):
        log.write(records, new_dir(spark, "log"), segment=100, every=30)


@pytest.mark.parametrize(("timeout_s", "max_size", "jitter"), [(40.0, 5, 0), (40.0, 5, 60), (1e9, 7, 5), (3.0, 1000, 0), (10.0, 1, 9)])
def test_pieces_equal_one_pass(spark, timeout_s, max_size, jitter):
    rng = random.Random(max_size)
    rows = [("hot" if k % 10 else f"k{k % 7}", k, 1_700_000_000 + 5 * k + rng.randint(-jitter, jitter), None if k % 9 == 0 else k) for k in range(1500)]
    df = spark.createDataFrame(rows, "key string, n long, s long, v long").withColumn("t", F.timestamp_seconds("s")).repartition(3)
    pick = lambda d: sorted(map(str, d.select("key", "n", "v", windowing.NO, windowing.NTH).collect()))
    whole = windowing.anchored(df, ["key"], "t", ["n"], timeout_s, max_size)
    parts = windowing.anchored(df, ["key"], "t", ["n"], timeout_s, max_size, chunk=F.floor(F.col("n") / 100), piece=21)
    assert pick(parts) == pick(whole)


def test_piece_map_follows_the_fold():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, limit, size = int(rng.integers(1, 40)), int(rng.integers(1, 12)), int(rng.integers(1, 9))
        t = np.cumsum(rng.integers(0, 4, n + size)) + rng.integers(-3, 4, n + size)
        to, opened, last = windowing.piece_map(t, n, limit, size)
        for h in range(min(n, size)):
            i, count, at = h, 0, h
            while i < n:
                at, count = i, count + 1
                i = next((j for j in range(i + 1, len(t)) if t[j] - t[at] >= limit or j - at >= size), len(t))
            assert (to[h], opened[h], last[h]) == (min(i, len(t)) - n, count, at)


def test_pieces_of_an_empty_table(spark):
    df = spark.createDataFrame([], "key string, n long, t timestamp")
    assert windowing.anchored(df, ["key"], "t", ["n"], 5.0, 3, chunk=F.col("n"), piece=2).count() == 0
