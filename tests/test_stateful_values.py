"""Stateful streams keep types and nulls; acknowledgement as a stream equals that of tables under any batching."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_streaming import drain, files
from tidemark.operators import acks
from tidemark.streaming import stateful


def test_values_keep_type_and_null(spark, tmp_path):
    big = (1 << 60) + 1
    rows = [("a", big), ("a", None), ("a", 3), (None, 4), (None, None), (None, 5)]
    s = files(spark, str(tmp_path / "in"), rows, "k string, v long")
    got = drain(spark, stateful.buffer_stream(s, "k", "v", 3_600_000, 3), "typed", tmp_path, 2)
    assert {r.key: sorted(r["items"], key=repr) for r in got} == {"a": sorted([big, None, 3], key=repr), None: sorted([4, None, 5], key=repr)}
    s = files(spark, str(tmp_path / "in2"), [("a", b"\xff\x00"), ("a", b"\xff\x00")], "k string, v binary")
    got = drain(spark, stateful.deduplicate_stream(s, "k", "v", 3_600_000, 2), "bytes", tmp_path, 1)
    assert [bytes(r["item"]) for r in got] == [b"\xff\x00"]
    s = files(spark, str(tmp_path / "in3"), [("a", 4), ("a", 5), ("a", 6)], "k string, v int")
    got = drain(spark, stateful.deduplicate_stream(s, "k", "v", 3_600_000, 3, lambda a, b: a + b), "sums", tmp_path, 1)
    assert [r["item"] for r in got] == [15]


def events(seed, n=60):
    rng = random.Random(seed)
    out = []
    for key in ("p0", "p1", None):
        for k in range(n):
            offset, arrived = 2 * k + 5, k
            out.append((key, offset, None, arrived))
            if rng.random() > 0.04 or k < 20:
                for _ in range(rng.choice([1, 1, 1, 2])):
                    out.append((key, offset, rng.choice(["ack", "ack", "ack", "ack", "nack"]), arrived + rng.choice([1, 2, 3, 5, 8, 20])))
    return sorted(out, key=lambda x: x[3])


@pytest.mark.parametrize("mode", [acks.STRICT, acks.COMPACT, acks.COMPACT_EAGER])
@pytest.mark.parametrize("batches", [1, 4])
def test_frontier_stream(spark, tmp_path, mode, batches):
    rows = events(batches)
    schema = "key string, offset long, status string, s long"
    signals = spark.createDataFrame([r for r in rows if r[2]], schema).withColumn("settled", F.timestamp_seconds("s"))
    # of two signals of one moment the one that sorts first counts
    first = signals.groupBy("key", "offset").agg(F.min_by("status", F.struct("settled", "status")).alias("status"), F.min("settled").alias("settled"))
    arrived = spark.createDataFrame([r[:2] for r in rows if not r[2]], "key string, offset long")
    first = first.withColumnsRenamed({"key": "k", "offset": "o"})
    table = arrived.join(first, F.col("key").eqNullSafe(F.col("k")) & (F.col("offset") == F.col("o")), "left").select("key", "offset", "status", "settled")
    want = acks.frontier(table, ["key"], "offset", "settled", "status", mode).where("executed is not null or collapsed")
    want = {(r.key, r["offset"]): (r.status, r.settled, None if r.collapsed else r.executed, r.collapsed, r.freed if not r.collapsed or mode == acks.COMPACT_EAGER else None) for r in want.collect()}

    folder = str(tmp_path / "in")
    moments = sorted({r[3] for r in rows})
    cuts = [moments[len(moments) * k // batches] for k in range(1, batches)]
    found = []
    for k in range(batches):  # the query is stopped and goes on from its state
        part = [r for r in rows if sum(r[3] >= c for c in cuts) == k]
        s = files(spark, folder, part, schema).withColumn("at", F.timestamp_seconds("s"))
        out = str(tmp_path / "out")
        q = stateful.frontier_stream(s, "key", mode).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, _: df.write.mode("append").parquet(out)).start()  # noqa: B023
        q.processAllAvailable()
        q.stop()
    found = spark.read.parquet(out).collect()
    assert len(found) == len(want)
    assert {(r.key, r["offset"]): (r.status, r.settled, r.executed, r.collapsed, r.freed) for r in found} == want
    assert mode == acks.STRICT or any(r.collapsed for r in found)


class Held:
    """A state of the store, in memory."""

    def __init__(self):
        self.map, self.calls = {}, 0

    def exists(self):
        return None in self.map

    def get(self):
        return self.map[None]

    def update(self, value):
        self.map[None] = value

    def containsKey(self, key):  # noqa: N802
        self.calls += 1
        return key in self.map

    def getValue(self, key):  # noqa: N802
        return self.map[key]

    def updateValue(self, key, value):  # noqa: N802
        self.map[key] = value

    def removeKey(self, key):  # noqa: N802
        del self.map[key]


class Handle:
    def __init__(self):
        self.states = {}

    def getValueState(self, name, *_):  # noqa: N802
        return self.states.setdefault(name, Held())

    getMapState = getValueState  # noqa: N815


def settled(parts, compact):
    """What a processor gives out for a key's batches, each some frames of signals."""
    processor, handle = stateful.AcknowledgementProcessor(compact), Handle()
    processor.init(handle)
    for frames in parts:
        for frame in processor.handleInputRows(("k",), iter(frames), None):
            yield frame
    assert all(len(handle.states[name].map) < 3000 for name in ("open", "last_of", "settled"))


def signals(n):
    rng = np.random.default_rng(4)
    at = np.concatenate([np.arange(n), np.arange(n) + rng.integers(1, 600, n)])
    status = np.where(rng.integers(0, 50, n) == 0, "nack", "ack").astype(object)
    frame = pd.DataFrame({"at": at, "offset": np.tile(np.arange(n), 2), "status": np.concatenate([np.full(n, None, object), status])})
    return frame.sort_values("at", kind="stable", ignore_index=True)


def test_acknowledgement_holds_what_is_open():
    """A batch's signals are held as numbers, and of its records only the open ones."""
    frame = signals(150_000)
    frames = [frame[k : k + 10_000] for k in range(0, len(frame), 10_000)][::-1]
    tracemalloc.start()
    rows = sum(len(out) for out in settled([frames], True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 150_000
    assert peak < 100 * len(frame)


@pytest.mark.parametrize("compact", [False, True])
def test_acknowledgement_in_pieces(monkeypatch, compact):
    """What goes to the store within a batch, and how many signals are taken together, changes nothing."""
    frame = signals(2000)
    want = pd.concat(settled([[frame]], compact), ignore_index=True)
    assert len(want) == 2000
    monkeypatch.setattr(stateful, "AT_ONCE", 37)
    monkeypatch.setattr(stateful, "HELD", 50)
    got = pd.concat(settled([[frame[k : k + 500]] for k in range(0, len(frame), 500)], compact), ignore_index=True)
    assert got.equals(want)
