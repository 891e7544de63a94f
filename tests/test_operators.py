from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import acks, context, flow, grouping, stateless, windowing
from tidemark.operators.failure import delegate, delegate_unless, emit, emit_unless, error_delegation, message_has, passing, process_failure, route
from tidemark.sources import ranges, topics

T0 = datetime(2024, 1, 1)


def at(*rows):
    """(key, seconds) rows with an id."""
    return [(i, k, T0 + timedelta(seconds=s)) for i, (k, s) in enumerate(rows)]


def windows(spark, rows, timeout, size, reducer=windowing.FIRST):
    df = spark.createDataFrame(at(*rows), "id long, k string, ts timestamp_ntz")
    got = windowing.deduplicate(df, ["k"], "ts", ["id"], timeout, size, ["id"], reducer)
    return sorted((r.k, r.id, r.n, (r.closed - T0).total_seconds()) for r in got.collect())


def test_dedup_windows(spark):
    assert windows(spark, [("a", 0), ("a", 0.1)], 0.8, 4) == [("a", 0, 2, 0.8)]
    assert windows(spark, [("a", 0), ("a", 0.8)], 0.8, 4) == [("a", 0, 1, 0.8), ("a", 1, 1, 1.6)]
    assert windows(spark, [("a", 0.1 * k) for k in range(5)], 0.8, 4) == [("a", 0, 4, 0.3), ("a", 4, 1, 1.2)]
    # anchored at the first row: neither sliding nor aligned to the clock
    assert windows(spark, [("a", s) for s in (0, 3, 6, 9)], 4, 10) == [("a", 0, 2, 4.0), ("a", 2, 2, 10.0)]
    assert windows(spark, [("ONE", 0), ("TWO", 0.2), ("TWO", 0.2), ("ONE", 0.2)], 0.8, 4, windowing.LAST) == [("ONE", 3, 2, 0.8), ("TWO", 2, 2, 1.0)]
    assert [w[2] for w in windows(spark, [("a", 0), ("a", 0)], 0, 4)] == [1, 1]


def test_dedup_over_batches_of_rows(spark):
    """Keys and windows that span many Arrow batches."""
    rows = [("k%d" % (i % 3), i) for i in range(1000)]
    got = windows(spark, rows, 30, 7)
    assert sum(w[2] for w in got) == 1000
    assert {w[2] for w in got} <= {1, 2, 3, 4, 5, 6, 7}
    assert windows(spark, [], 5, 2) == []


def test_failure_matrix(spark):
    df = spark.createDataFrame([(1, None), (2, "boom"), (3, "minor")], "i int, e string")

    def of(strategy):
        return [r[0] for r in route(df, F.col("e"), strategy).orderBy("i").select("_ack").collect()]

    assert of(delegate()) == ["ok", "nacked", "nacked"]
    assert of(delegate_unless(message_has("minor"))) == ["ok", "nacked", "acked_dropped"]
    assert of(emit_unless(message_has("minor", "boom"))) == ["ok", "acked_dropped", "acked_dropped"]
    for s in (emit(), emit_unless(message_has("minor"))):
        with pytest.raises(Exception, match="boom|minor"):
            of(s)
    assert passing(route(df, F.col("e"), delegate())).count() == 1
    settled, letters = error_delegation(route(df, F.col("e"), delegate()), F.col("_error") == "boom")
    assert [r.i for r in letters.collect()] == [2]
    assert {r.i: (r._ack, r._error) for r in settled.collect()} == {1: ("ok", None), 2: ("ack", None), 3: ("nacked", "minor")}
    settled, letters = error_delegation(route(df, F.col("e"), delegate()), send_error=F.lit("down"))
    assert letters.count() == 0
    assert {(r._error, r._suppressed) for r in settled.where("i = 2").collect()} == {("down", "boom")}


def test_emitted_failures_survive_pruning(spark):
    """An error that is to be emitted fails the query whatever columns it asks for."""
    df = spark.createDataFrame([(1, "1"), (2, None), (3, "x")], "i int, v string").repartition(2)
    mapped = stateless.map_rows(df, y=F.col("v"))
    half = stateless.map_rows(df, F.when(F.col("i") == 3, "boom"), emit_unless(message_has("null result")), y=F.col("v"))
    bad_cast = stateless.cast(df, "v", "int")
    failed = process_failure(df, F.col("i") == 3, F.lit("bad"), emit())
    refused = acks.nacked(df.withColumn("s", F.lit("nack")), "s", "emit")
    for got in (mapped, half, bad_cast, failed, refused):
        for run in (lambda d: d.count(), lambda d: d.select("i").collect(), lambda d: d.groupBy("i").count().collect(), lambda d: d.agg(F.max("i")).collect()):
            with pytest.raises(Exception, match="null result|boom|no int|bad|nacked"):
                run(got)
    kept = stateless.cast(df, "v", "int", delegate())
    assert {(r.i, r.v, r._ack) for r in kept.collect()} == {(1, 1, "ok"), (2, None, "ok"), (3, None, "nacked")}
    assert stateless.map_rows(df, strategy=emit_unless(message_has("null result")), y=F.col("v")).where("_ack = 'ok'").count() == 2


def test_rowwise(spark):
    df = stateless.just(spark, [(1, ["a", "b"]), (2, []), (3, None)], "i int, xs array<string>")
    assert [(r.i, r._place, r.x) for r in stateless.concat_map(df, F.col("xs"), "x").collect()] == [(1, 0, "a"), (1, 1, "b")]
    assert stateless.flat_map(df, F.col("xs"), "x").count() == 2
    with pytest.raises(Exception, match="null result"):
        stateless.map_rows(df, y=F.when(F.col("i") < 3, F.col("i"))).collect()
    assert stateless.map_not_null(df, y=F.when(F.col("i") < 3, F.col("i"))).count() == 2
    seen = []
    assert stateless.consume(df, lambda d: seen.append(d.count())).count() == 0
    assert seen == [3]
    assert stateless.delay_until(df, lambda: seen.append("go")).count() == 3
    with pytest.raises(Exception, match="no int"):
        stateless.cast(spark.createDataFrame([("x",)], "s string"), "s", "int").collect()


def settled(spark, rows):
    return spark.createDataFrame([(0, i, d, s) for i, (d, s) in enumerate(rows)], "q int, o int, t int, s string")


def test_frontier(spark):
    def of(rows, mode):
        got = acks.frontier(settled(spark, rows), ["q"], "o", "t", "s", mode).orderBy("o").collect()
        return [(r.executed, r.collapsed) for r in got]

    rows = [(5, "ack"), (1, "ack"), (2, "ack"), (3, "nack"), (4, "ack")]
    assert of(rows, acks.STRICT) == [(5, False)] * 5
    # two adjacent ones behind the open head collapse into the last; an error stops it
    assert of(rows, acks.COMPACT) == [(5, False), (5, True), (5, False), (5, False), (5, False)]
    assert of([(1, "ack"), (2, "ack")], acks.COMPACT) == [(1, False), (2, False)]
    assert of([(1, "ack"), (None, None), (2, "ack"), (3, "ack")], acks.COMPACT) == [(1, False), (None, False), (None, True), (None, False)]
    eager = acks.frontier(settled(spark, rows), ["q"], "o", "t", "s", acks.COMPACT_EAGER).orderBy("o")
    assert [r.freed for r in eager.collect()] == [5, 1, 2, 3, 4]
    twice = spark.createDataFrame([(1, "nack", 3), (1, "ack", 2)], "r int, s string, t int")
    assert acks.first_signal(twice, ["r"], "s", "t").first().s == "ack"


def test_offsets(spark):
    df = settled(spark, [(1, "ack"), (1, "ack"), (1, None), (1, "ack"), (1, "ack"), (1, "nack"), (1, "ack")])
    assert acks.committable(df, ["q"], "o", "s").first().position == 2
    assert sorted((r.start, r.end) for r in acks.ahead_of_commit(df, ["q"], "o", "s").collect()) == [(3, 4), (6, 6)]
    done = acks.ahead_of_commit(df, ["q"], "o", "s").join(acks.committable(df, ["q"], "o", "s"), "q")
    assert sorted(r.o for r in acks.unprocessed(df, done, ["q"], "o").collect()) == [2, 5]
    with pytest.raises(Exception, match="nacked"):
        acks.nacked(df, "s", "emit").collect()
    assert acks.nacked(df, "s", "discard").count() == 0


def test_parents(spark):
    df = spark.createDataFrame([(1, "ack", 1, None), (1, "ack", 4, None), (2, "nack", 3, "late"), (2, "nack", 2, "first"), (3, None, None, None), (3, "ack", 1, None)], "p int, s string, t int, e string")
    got = {r.p: (r.status, r.settled, r.error) for r in acks.parents(df, ["p"], "s", "t", "e").collect()}
    assert got == {1: ("ack", 4, None), 2: ("nack", 2, "first"), 3: (None, None, None)}


def test_generations(spark):
    rows = [(0, "a", 0, 5), (1, "a", 3, 9), (2, "a", 9, 10), (3, "a", 20, None), (4, "a", 30, 31), (5, "b", 0, 1)]
    df = spark.createDataFrame([(i, k, T0 + timedelta(seconds=a), None if s is None else T0 + timedelta(seconds=s)) for i, k, a, s in rows], "i int, k string, a timestamp_ntz, s timestamp_ntz")
    got = grouping.generations(df, ["k"], "a", "s", ["i"]).orderBy("i").collect()
    assert [r.generation for r in got] == [0, 0, 1, 2, 2, 0]
    eager = grouping.generations(df, ["k"], "a", "s", ["i"], F.col("i") == 0).orderBy("i").collect()
    assert [r.generation for r in eager] == [0, 1, 2, 3, 3, 0]


def test_round_robin(spark):
    df = spark.range(100).withColumn("c", F.floor(F.col("id") / 7))
    got = grouping.by_round_robin(df, ["id"], 4, F.col("c")).collect()
    assert all(r._group == r.id % 4 for r in got)
    assert grouping.in_groups(grouping.group_by(df, F.col("id") % 3), ["id"]).count() == 100
    with pytest.raises(ValueError, match="lost"):
        grouping.inner(grouping.group_by(df, F.col("id")), grouping.ungroup)


def records(spark, times, partition=0):
    return spark.createDataFrame([("t", partition, i, T0 + timedelta(milliseconds=m)) for i, m in enumerate(times)], "topic string, partition int, offset long, timestamp timestamp_ntz")


def offsets(df):
    return sorted((r.partition, r.offset) for r in df.collect())


MS = int((T0 - datetime(1970, 1, 1)).total_seconds() * 1000)


@pytest.mark.parametrize(("low", "high", "expected"), [(0, 1, [0, 1]), (1, 2, [1, 2]), (2, 3, [2, 3]), (3, 4, [3])])
def test_raw_ranges(spark, low, high, expected):
    got = ranges.read(records(spark, [0, 1, 2, 3]), ranges.RangeProvider(ranges.raw(low).to(ranges.raw(high))))
    assert [o for _, o in offsets(got)] == expected


@pytest.mark.parametrize(("low", "high", "expected"), [(0, 4, [0, 1, 2]), (1, 3, [1]), (0, 1, [0]), (2, 2, [1]), (3, 3, []), (-2, -1, []), (5, 6, []), (-1, 0, [0]), (4, 9, [2])])
def test_timestamp_ranges(spark, low, high, expected):
    got = ranges.read(records(spark, [0, 2, 4]), ranges.RangeProvider(ranges.timestamp(MS + low).to(ranges.timestamp(MS + high))))
    assert [o for _, o in offsets(got)] == expected


def test_group_ranges_and_lag(spark):
    r = records(spark, [0, 1, 2, 3])
    c = spark.createDataFrame([("t", 0, 2)], "topic string, partition int, committed long")
    assert offsets(ranges.read(r, ranges.RangeProvider(ranges.earliest().to(ranges.group())), c)) == [(0, 0), (0, 1)]
    assert offsets(ranges.read(r, ranges.RangeProvider(ranges.group().to(ranges.latest())), c)) == [(0, 2), (0, 3)]
    assert offsets(ranges.read(r, ranges.RangeProvider(ranges.latest().as_range()), c)) == [(0, 3)]
    assert offsets(ranges.read(r, ranges.RangeProvider(ranges.earliest().as_range()), c)) == [(0, 0)]
    got, after = ranges.read_up_to(r, ranges.latest(), c)
    assert offsets(got) == [(0, 2), (0, 3)]
    assert after.first().committed == 4
    assert ranges.lag(r, c).first().lag == 2
    assert ranges.lag(r, c.limit(0), "none").count() == 0
    assert ranges.lag(r, c.limit(0), "latest").first().lag == 0
    two = r.unionByName(records(spark, [0, 1, 2], partition=1))
    start = ranges.RangeProvider(ranges.earliest().to(ranges.latest())).starting_from("t", 0, 2)
    assert offsets(ranges.read(two, start)) == [(0, 2), (0, 3), (1, 0), (1, 1), (1, 2)]


def test_rates(spark):
    def of(arrivals, count, duration, weight=None):
        df = spark.createDataFrame([(i, float(a)) for i, a in enumerate(arrivals)], "i int, a double")
        return [round(r.release_s, 6) for r in flow.release_times(df, [], ["i"], F.col("a"), count, duration, None if weight is None else F.lit(weight)).orderBy("i").collect()]

    assert of([0] * 3, 1, 1.0) == [0, 1, 2]
    assert of([0] * 5, 4, 1.0) == [0, 0, 0, 0, 0.25]
    assert of([0, 0], 2, 1.0, 2) == [0, 1]
    assert of([0], 0, 1.0) == []
    same = flow.simulate_rates([(0, 1)] * 5, [(0, 4, 1.0)])
    assert [round(x, 6) for x in same] == [0, 0, 0, 0, 0.25]
    assert flow.simulate_rates([(0, 1), (3, 1)], []) == [0, 3]
    assert flow.simulate_rates([(0, 1), (0, 1)], [(0, 0, 1.0), (2, 1, 1.0)])[0] == 2
    assert flow.simulate_rates([(0, 1), (0, 1)], [(0, 0, 1.0)]) == [None, None]
    assert flow.simulate_rates([(0, 1)] * 3, [(0, None, 1.0)]) == [0, 0, 0]
    assert flow.per_second_rate(0.5) == 0
    assert flow.per_second_rate(-1) is None


def test_signals_and_polls(spark):
    df = spark.createDataFrame(list(enumerate([0, 4, 6, 3, 2])), "i int, lag int")
    assert [(r.i, r.started) for r in flow.lag_signals(df, ["i"], "lag", 4, 2).orderBy("i").collect()] == [(0, True), (2, False), (4, True)]
    assert not flow.lag_signals(df.where("i = 3"), ["i"], "lag", 4, 2).first().started
    lag = {0: 1, 1: 5, 2: 0, 3: 5}
    assert flow.select_polls(list(lag), lag.get, "greatest_batch_lag", max_poll=2) == [1, 3]
    assert flow.select_polls([0, 1, 2, 3], lambda p: p, "priority_cutoff", threshold=2) == [0, 1, 2]
    assert flow.select_polls(list(range(7)), lag.get, "binary_strides", cycle=7) == [1, 3, 5]
    assert flow.select_polls([3, 1], lag.get, "natural") == [3, 1]
    assert flow.admission(10, 10)
    assert not flow.admission(9, 10)


def test_assignment():
    one = {"m1": (1, "x", ["t"]), "m2": (1, "x", ["t"])}
    assert flow.assign_single_machine({"t": 4}, one) == {"m1": [("t", 0), ("t", 2)], "m2": [("t", 1), ("t", 3)]}
    two = {"a": (1, "x", ["t"]), "b": (2, "y", ["t", "u"])}
    assert flow.assign_single_machine({"t": 2, "u": 1}, two) == {"a": [("t", 0), ("t", 1)], "b": [("u", 0)]}
    mutex = flow.ConsumerMutex()
    old = mutex.ticket()
    old()
    new = mutex.ticket()
    new()
    with pytest.raises(RuntimeError):
        old()


def test_context(spark):
    df = spark.createDataFrame([(1, 0), (1, 1)], "b int, i int")
    c = context.put(context.put(F.lit(None), "k", F.col("i")), "k", F.lit("again"))
    got = context.fan_in(df.withColumn(context.CONTEXT, context.put(c, "m", 9 - F.col("i"))), ["b"], "i", single=["k"], smallest=["m"]).first()
    assert (got.k, got.m) == ("0", "8")
    m = context.AuditedMetrics(default=-1.0)
    m.register("a", "k", lambda: 1.0)
    m.register("b", "k", lambda: 2.0)
    assert not m.unregister("a", "k")
    assert m.read("k") == 2.0
    assert m.unregister("b", "k")
    assert m.read("k") == -1.0


def test_topics(spark, sf_dir):
    t = topics.events_topic(spark, sf_dir)
    assert t.count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert topics.subscribe(t, topics=["other"]).count() == 0
    assert topics.subscribe(t, pattern="event").count() == 0
    assert topics.auto_acked(t).where("_ack = 'ack'").count() == t.count()
    positions, calls = {}, []
    listener = topics.PartitionListener().seek_to_beginning_once(positions).on_assigned_once(calls.append)
    listener.assigned([0, 1])
    listener.assigned([1, 2])
    assert positions == {0: 0, 1: 0, 2: 0}
    assert calls == [[0, 1], [2]]
