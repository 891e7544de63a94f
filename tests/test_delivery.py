"""Commits, Kafka plans, chunked scans and waves."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import acks, scans, windowing
from tidemark.sources import kafka, sinks
from tidemark.streaming.commits import GroupCommitter, RetriableCommit


def committer(outcomes, attempts=100):
    calls, store = [], {}

    def commit(at):
        calls.append(at)
        error = outcomes.pop(0) if outcomes else None
        if error is not None:
            raise error
        store.update(at)

    return GroupCommitter(commit, attempts), calls, store


P = ("t", 0)


def test_commit_retries_and_stale_sequences():
    c, calls, _ = committer([ValueError("boom")])
    with pytest.raises(ValueError, match="boom"):
        c.run(c.plan({P: 1}, c.assigned([P])))
    assert not c.exhausted(P)
    c, calls, store = committer([RetriableCommit()])
    c.run(c.plan({P: 2}, c.assigned([P])))
    assert (len(calls), store, c.states[P].tries) == (2, {P: 2}, 0)
    c, calls, store = committer([RetriableCommit()] * 9, attempts=3)
    with pytest.raises(RuntimeError, match="exhausted"):
        c.run(c.plan({P: 2}, c.assigned([P])))
    assert (len(calls), c.exhausted(P), store) == (3, True, {})
    c, calls, store = committer([])
    epochs = c.assigned([P])
    old = c.plan({P: 1}, epochs)
    new = c.plan({P: 5}, epochs)
    assert c.run(old) == {}
    c.lost([P])
    assert c.run(new) == c.plan({P: 9}, epochs) == {}
    assert store == {}


def test_last_commit_on_revocation():
    c, _, store = committer([])
    c.plan({P: 7}, c.assigned([P]))
    left, now = [2], [0.0]

    def sleep(s):
        now[0] += s
        left[0] -= 1

    assert c.revoked([P], lambda _: max(0, left[0]), 5.0, clock=lambda: now[0], sleep=sleep) == {P: 7}
    assert store == {P: 7}
    c.plan({P: 9}, c.assigned([P]))
    now[0], left[0] = 0.0, 10**9
    assert c.revoked([P], lambda _: left[0], 0.05, clock=lambda: now[0], sleep=sleep) == {P: 9}  # after the grace period
    assert c.revoked([("t", 5)], lambda _: 1, 1.0) == {}


def test_kafka_options():
    assert kafka.subscription("h:1", ["a", "b"], client={"group.id": "g"}) == {"kafka.bootstrap.servers": "h:1", "kafka.group.id": "g", "subscribe": "a,b"}
    assert kafka.subscription("h:1", pattern="a.*")["subscribePattern"] == "a.*"
    assert json.loads(kafka.subscription("h:1", partitions={"a": [0, 2]})["assign"]) == {"a": [0, 2]}
    with pytest.raises(ValueError, match="one of"):
        kafka.subscription("h:1", ["a"], pattern="a")
    o = kafka.range_options([("a", 0, 5, 9), ("a", 2, 0, 0)])
    assert [json.loads(o[k]) for k in ("startingOffsets", "endingOffsets", "assign")] == [{"a": {"0": 5, "2": 0}}, {"a": {"0": 10, "2": 1}}, {"a": [0, 2]}]
    p = kafka.producer_options("h:1", "tx", linger_ms="5")
    assert (p["kafka.transactional.id"], p["kafka.linger.ms"], p["kafka.acks"]) == ("tx", "5", "all")


def test_kafka_plans(spark):
    raw = spark.createDataFrame([(b"k", b"v", "t", 1, 7, None, 0, [("h", b"x")]), (None, None, "t", 1, 8, None, 0, None)], kafka.SCHEMA)
    got = kafka.records(raw).collect()
    assert [(r.key, r.value, r.headers) for r in got] == [("k", "v", {"h": "x"}), (None, None, None)]
    out = kafka.outgoing(kafka.records(raw), F.col("topic"), F.col("value"), F.col("key"), F.col("headers"), F.col("partition"))
    assert [(bytes(r.key), bytes(r.value), r.topic, r.partition, [(h.key, bytes(h.value)) for h in r.headers]) for r in out.where("key is not null").collect()] == [(b"k", b"v", "t", 1, [("h", b"x")])]
    with pytest.raises(Exception, match="kafka"):  # no connector on this class path
        kafka.read_ranges(spark, "h:1", [("a", 0, 0, 1)])
    with pytest.raises(Exception, match="kafka"):
        kafka.write(out, "h:1")


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_scans_over_chunks(spark, size):
    rng = random.Random(size)
    rows = [(rng.choice([None, "a", "b"]), k, rng.choice([None, *range(9)])) for k in rng.sample(range(60), 40)]
    df = spark.createDataFrame(rows, "q string, o long, v int").repartition(4)
    chunk = scans.by_offset("o", size)
    one = scans.running(df, ["q"], ["o"], None, top=("max", F.col("v")), total=("sum", F.col("v")))
    assert sorted(map(repr, scans.running(df, ["q"], ["o"], chunk, top=("max", F.col("v")), total=("sum", F.col("v"))).collect())) == sorted(map(repr, one.collect()))
    for step in (1, -1):
        one = scans.neighbour(df, ["q"], ["o"], None, step, n=F.col("v"))
        assert sorted(map(repr, scans.neighbour(df, ["q"], ["o"], chunk, step, n=F.col("v")).collect())) == sorted(map(repr, one.collect()))
    known: dict = {}
    want = []
    for q, o, v in sorted(rows, key=lambda r: r[1]):
        known[q] = v if v is not None else known.get(q)
        want.append((q, o, v, known[q]))
    assert sorted(map(repr, map(tuple, scans.last_known(df, ["q"], ["o"], chunk, "k", F.col("v")).collect()))) == sorted(map(repr, want))


def test_restart_with_overlapping_ranges(spark):
    rng = random.Random(5)
    records = spark.createDataFrame([(q, o) for q in range(3) for o in range(200)], "q int, o long")
    spans = [(q, a, a + rng.randint(0, 30)) for q in range(2) for a in rng.sample(range(200), 6)]
    done = spark.createDataFrame([(q, 10, a, e) for q, a, e in spans] + [(2, 50, None, None)], "q int, position long, start long, end long")
    want = [(q, o) for q in range(3) for o in range(200) if o >= (50 if q == 2 else 10) and not any(p == q and a <= o <= e for p, a, e in spans)]
    assert sorted(map(tuple, acks.unprocessed(records, done, ["q"], "o").collect())) == want


def test_windows_of_rows_out_of_time_order(spark):
    """The fold takes rows in their order, whatever their times say."""
    rng = random.Random(3)
    rows = [(rng.choice("ab"), k, rng.randint(0, 40)) for k in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, s int").withColumn("t", F.timestamp_seconds("s")).repartition(3)
    got = {r.i: (r.window_no, r.nth) for r in windowing.anchored(df, ["k"], "t", ["i"], 10.0, 5).collect()}
    state: dict = {}
    for k, i, s in rows:
        start, no, nth = state.get(k, (None, -1, 0))
        start, no, nth = (start, no, nth + 1) if start is not None and nth < 5 and s - start < 10 else (s, no + 1, 1)
        state[k] = start, no, nth
        assert got[i] == (no, nth)


def test_offsets_appear_with_rows(spark, tmp_path):
    t = sinks.Transaction(str(tmp_path / "t"))
    rows, at = spark.range(5), spark.createDataFrame([(0, 5)], "partition int, position long")
    assert t.write(rows, 0, at)
    assert not t.write(rows, 0, at)
    with pytest.raises(Exception, match="boom"):
        t.write(rows.where(F.raise_error(F.lit("boom")).isNull()), 1, at)
    assert (t.rows(spark).count(), [tuple(r)[:2] for r in t.offsets(spark).select("partition", "position").collect()]) == (5, [(0, 5)])
