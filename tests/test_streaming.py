import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark.sources import queues, sinks
from tidemark.streaming import config, running, stateful


def files(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def drain(spark, df, name, tmp, rows):
    """Runs a query until its table has so many rows. With timers it would never end by itself."""
    q = df.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp / f"c-{name}")).start()
    end = time.time() + 90
    try:
        while time.time() < end and q.isActive and spark.table(name).count() < rows:
            time.sleep(0.5)
        if q.exception():
            raise q.exception()
    finally:
        q.stop()
    return spark.table(name).collect()


def test_stream_dedup_and_buffer(spark, tmp_path):
    rows = [("a", str(i)) for i in range(9)] + [("b", "x")]
    s = files(spark, str(tmp_path / "in"), rows, "k string, v string")
    got = drain(spark, stateful.deduplicate_stream(s, "k", "v", 3_600_000, 4, stateful.keep_last), "dd", tmp_path, 2)
    assert sorted((r.key, r.n) for r in got) == [("a", 4), ("a", 4)]  # the ninth and b wait for their timers
    got = drain(spark, stateful.buffer_stream(s, "k", "v", 3_600_000, 3), "bb", tmp_path, 3)
    assert sorted((r.key, len(r["items"])) for r in got) == [("a", 3)] * 3


def test_stream_timer(spark, tmp_path):
    s = files(spark, str(tmp_path / "in"), [("a", "1"), ("a", "2")], "k string, v string")
    got = drain(spark, stateful.buffer_stream(s, "k", "v", 500, 10), "tt", tmp_path, 1)
    assert [sorted(r["items"]) for r in got] == [["1", "2"]]


def test_stream_generations(spark, tmp_path):
    rows = [("a", "arrive", "1"), ("a", "arrive", "2"), ("a", "settle", "1"), ("a", "settle", "2"), ("a", "arrive", "3")]
    s = files(spark, str(tmp_path / "in"), rows, "k string, kind string, item string")
    got = drain(spark, stateful.generation_stream(s, "k"), "gg", tmp_path, 3)
    assert sorted((r["item"], r.generation) for r in got) == [("1", 0), ("2", 0), ("3", 1)]


def test_dead_letters_and_idempotence(spark, tmp_path):
    df = spark.createDataFrame([(1, "ok"), (2, "nacked")], "i int, _ack string")
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    run = running.dead_letter_batches(good, bad)
    run(df, 0)
    run(df, 0)
    assert [r.i for r in spark.read.parquet(good).collect()] == [1]
    assert [r.i for r in spark.read.parquet(bad).collect()] == [2]
    assert sinks.send_transactional([df, df], str(tmp_path / "tx")) == [True, True]
    assert not sinks.Transaction(str(tmp_path / "tx")).write(df, 1)
    with pytest.raises(Exception, match="boom"):
        sinks.Transaction(str(tmp_path / "tx")).write(df.withColumn("x", F.raise_error(F.lit("boom"))), 7)
    assert spark.read.parquet(str(tmp_path / "tx")).count() == 4


def test_resubscribe():
    class Query:
        def __init__(self, fail):
            self.fail = fail

        def awaitTermination(self):
            if self.fail:
                raise RuntimeError("down")

    left, waits = [True, True, False], []
    assert running.resubscribe(lambda: Query(left.pop(0)), sleep=waits.append) == 2
    assert waits == [20.0, 20.0]
    with pytest.raises(RuntimeError):
        running.resubscribe(lambda: Query(True), delay_s=-1, sleep=waits.append)
    stop = threading.Event()
    stop.set()
    with pytest.raises(RuntimeError):
        running.resubscribe(lambda: Query(True), stop=stop, sleep=waits.append)


class Fake:
    def __init__(self):
        self.stopped = False

    def stop(self):
        self.stopped = True

    def awaitTermination(self, timeout=None): ...


def test_lifecycle():
    s = running.Stream("s", Fake)
    s.start()
    with pytest.raises(RuntimeError, match="STARTED"):
        s.start()
    s.stop()
    s.stop()
    running.StarterStopper(s).apply([True, True, False, True])
    assert s.state == running.Stream.STARTED
    many = running.CompositeStream("m", 2, lambda name: Fake())
    assert [x.name for x in many.start().streams] == ["m-c1", "m-c2"]
    status = running.StreamStatus([*many.streams, running.Stream("m-c1", Fake)])
    assert [x["state"] for x in status.list()] == ["STARTED"] * 2
    status.stop("m-c1")
    assert status.get("m-c1")["state"] == "STOPPED"
    assert status.get("none") is None
    q = Fake()
    e = running.ErrorEmitter(q)
    e.emit(ValueError("x"))
    with pytest.raises(ValueError, match="x"):
        e.result()
    now = [0.0]
    a = running.ActivityEnforcer(10, clock=lambda: now[0])
    now[0] = 10
    a.check()
    now[0] = 10.1
    with pytest.raises(TimeoutError):
        a.check()


def test_config(tmp_path):
    base = config.ConfigSource("my-stream", {"id": "x", "id.randomize": "true"}).requiring("id")
    made = base.with_("n", 1).create()
    assert made["id"].startswith("x-")
    assert "id.randomize" not in made
    assert "n" not in base.properties
    with pytest.raises(ValueError, match="lacks"):
        base.requiring("absent").create()
    assert config.environment_overrides("my-stream", {"MY_STREAM_POLL_MAX": "5"})({"poll.max": "1"}) == {"poll.max": "5"}
    (tmp_path / "p").write_text("# c\na=1\nb = 2\n")
    assert config.properties_file(str(tmp_path / "p"))({"a": "own"}) == {"a": "own", "b": "2"}
    assert config.namespaced({"defaults.x": 1, "s.x": 2, "defaults.y": 3}, "s") == {"x": 2, "y": 3}
    assert config.duration("PT1M30.5S").total_seconds() == 90.5
    assert config.duration("P1DT2H").total_seconds() == 93600
    with pytest.raises(ValueError, match="duration"):
        config.duration("soon")
    assert config.names("a, b,") == ["a", "b"]
    assert config.load({"x": "true"}, "x", config.boolean) is True
    assert config.load({}, "x", int, 4) == 4


def test_queue(tmp_path):
    now = [100.0]
    q = queues.FileQueue(str(tmp_path), clock=lambda: now[0])
    for b in "abc":
        q.send(queues.Message(b))
    assert q.send(queues.Message("d", dedup_id="1")) and not q.send(queues.Message("d", dedup_id="1"))
    first = q.receive(limit=2, visibility_s=30)
    assert [m.body for m in first] == ["a", "b"]
    assert [m.body for m in q.receive()] == ["c", "d"]
    assert q.receive() == []
    assert q.ack(first[0])
    assert not q.ack(first[0])
    assert q.nack(first[1])
    again = q.receive()
    assert [(m.body, m.redelivered) for m in again] == [("b", True)]
    assert q.nack(again[0], requeue=False)
    now[0] += 31
    assert sorted(m.body for m in q.receive()) == ["c", "d"]


def test_queue_source(spark, tmp_path):
    queues.register(spark)
    folder = str(tmp_path / "q")
    df = spark.createDataFrame([("one", None, None, {"k": "v"}), ("two", "g", None, None)], "body string, group_id string, dedup_id string, attributes map<string,string>")
    df.write.format("tidemark_queue").mode("append").option("path", folder).save()
    got = spark.read.format("tidemark_queue").option("path", folder).load()
    assert sorted(r.body for r in got.collect()) == ["one", "two"]
    results = sinks.send(spark.createDataFrame([("k", "three"), ("k", None)], "key string, value string"), sinks.folder_sink(folder), "delegate")
    assert sorted((r.value or "", r._ack) for r in sinks.settle(results).collect()) == [("", "nack"), ("three", "ack")]
    bad = spark.createDataFrame([("k", None)], "key string, value string")
    with pytest.raises(Exception, match="null body"):
        sinks.send(bad, sinks.folder_sink(folder))
    with pytest.raises(sinks.SendError, match="null body"):
        sinks.send(bad, sinks.folder_sink(folder), "delay")
    assert len(queues.FileQueue(folder).peek()) == 3
    stream = spark.readStream.format("tidemark_queue").option("path", folder).option("maxInFlight", 2).load()
    q = stream.writeStream.format("memory").queryName("qs").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("qs").count() == 3


def test_queue_keeps_a_late_older_message(tmp_path):
    q = queues.FileQueue(str(tmp_path))
    q.send(queues.Message("b", message_id="0002-b"))
    reader = queues._StreamReader(str(tmp_path), 10)
    start = reader.initialOffset()
    rows, end = reader.read(start)
    assert [r[1] for r in rows] == ["b"]
    q.send(queues.Message("a", message_id="0001-a"))
    held = queues.Message("c", message_id="0003-c")
    q.send(held)
    assert [r[1] for r in reader.readBetweenOffsets(start, end)] == ["b"]
    reader.commit(end)
    assert [m.body for m in q.peek()] == ["a", "c"]
    q.receive(visibility_s=60)  # hides what is there from the stream
    rows, after = reader.read(end)
    assert (list(rows), after) == ([], end)
    reader = queues._StreamReader(str(tmp_path), 1)
    reader.commit({"batch": 9, "names": ["msg-0003-c", "msg-gone"]})
    assert [m.body for m in q.peek()] == ["a", "c"]  # held by a receiver, so not the stream's to delete


def test_receivers_share_no_message(tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    q = queues.FileQueue(str(tmp_path))
    for k in range(200):
        q.send(queues.Message(str(k)))

    def drain(_):
        own, out = queues.FileQueue(str(tmp_path)), []
        while got := own.receive(limit=3):
            out += [m.body for m in got]
            assert all(own.ack(m) for m in got)
        return out

    with ThreadPoolExecutor(4) as pool:
        found = [b for part in pool.map(drain, range(4)) for b in part]
    assert sorted(found, key=int) == [str(k) for k in range(200)]
    now = [0.0]
    q = queues.FileQueue(str(tmp_path), clock=lambda: now[0])
    q.send(queues.Message("lost", message_id="a/b@c"))
    (held,) = q.receive()  # by a receiver that dies here
    now[0] = 31.0
    (again,) = q.receive()
    assert (again.body, again.message_id, again.redelivered) == ("lost", "a/b@c", True)
    assert not q.ack(held)
    assert q.nack(again, delay_s=5)
    assert q.receive() == []
    now[0] = 37.0
    assert q.ack(q.receive()[0])


def test_tasks_that_run_again_send_once(tmp_path):
    folder = str(tmp_path)
    q, writer = queues.FileQueue(folder), queues._Writer(folder)

    class Row(dict):
        asDict = dict.copy

    rows = [Row(body="x", dedup_id=None), Row(body="y", dedup_id="d")]
    failed, speculative, good = (writer.write(iter(rows)) for _ in range(3))
    assert q.peek() == []
    writer.abort([failed, None])
    writer.commit([good, None])
    assert sorted(m.body for m in q.peek()) == ["x", "y"]
    again = queues._Writer(folder)
    again.commit([again.write(iter(rows))])
    assert sorted(m.body for m in q.peek()) == ["x", "x", "y"]
    # a sender that stopped after it took the dedup id
    q._store(queues.Message("z", dedup_id="half", message_id="9-z"), "pending-" + queues.uuid.uuid5(queues.uuid.NAMESPACE_OID, "half").hex)
    open(q._path("dedup-" + queues.uuid.uuid5(queues.uuid.NAMESPACE_OID, "half").hex), "w").close()
    assert q.send(queues.Message("z", dedup_id="half")) == ""
    assert sorted(m.body for m in q.peek()) == ["x", "x", "y", "z"]
    sink = sinks.folder_sink(str(tmp_path / "s"))
    sent = [{"key": "k", "value": "v"}] * 2
    assert list(sink(iter(sent))) == [None, None]
    # the same partition once more, as another attempt would
    sink.__closure__[[c.cell_contents.__class__.__name__ for c in sink.__closure__].index("dict")].cell_contents.clear()
    assert list(sink(iter(sent))) == [None, None]
    assert len(queues.FileQueue(str(tmp_path / "s")).peek()) == 2


def test_routing():
    b = [("q1", "a.*.c"), ("q2", "a.#"), ("q3", "x")]
    assert queues.routed("e", b, "topic", "a.b.c") == ["q1", "q2"]
    assert queues.routed("e", b, "topic", "a") == ["q2"]
    assert queues.routed("e", b, "direct", "x") == ["q3"]
    assert queues.routed("e", b, "fanout", "-") == ["q1", "q2", "q3"]
    assert queues.routed("e", [("q", "k=v")], "headers", "", {"k": "v"}) == ["q"]
