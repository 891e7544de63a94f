"""Stateful streaming operators: batching, deduplication and completing groups per key.

They keep one key's open window in the state store (RocksDB) and close it by size at once
or by a processing-time timer. State is checkpointed with the query, so a restart goes on
where it stopped.

Values are held as JSON and come out with their column's type, nulls as nulls. Keys come out as strings, a null key
is a group of its own. A batch only appends to a window's list, which is read when the window closes.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.acks import COMPACT_EAGER, STRICT

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


#: Signals that are settled, and given out, together; entries of maps that a task holds before they go to the state store.
AT_ONCE, HELD = 10_000, 500_000


class _Windowed(StatefulProcessor):
    """An anchored window: opens with a row, closes when full or at its timer."""

    def __init__(self, timeout_ms: int, max_size: int):
        self.timeout_ms, self.max_size = timeout_ms, max_size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", "item string")
        self.opened = handle.getValueState("opened", "due long, n long")

    def close_window(self, key, items: list[str]) -> pd.DataFrame:
        raise NotImplementedError

    def _close(self, key, due: int, more: list[str]) -> pd.DataFrame:
        items = [r[0] for r in self.items.get()] + more
        self.handle.deleteTimer(due)
        self.opened.clear()
        self.items.clear()
        return self.close_window(key, items)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due, n = self.opened.get() if self.opened.exists() else (None, 0)
        new: list[str] = []
        for pdf in rows:
            for v in pdf["item"]:
                if due is None:
                    due = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
                    self.handle.registerTimer(due)
                new.append(v)
                n += 1
                if n == self.max_size:
                    yield self._close(key, due, new)
                    due, n, new = None, 0, []
        if new:
            self.items.appendList([(v,) for v in new])
            self.opened.update((due, n))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.opened.exists():
            yield self._close(key, self.opened.get()[0], [])

    def close(self) -> None: ...


class BufferProcessor(_Windowed):
    """Size-or-time batches: key, items, n."""

    def close_window(self, key, items):
        return pd.DataFrame({"key": [key[0]], "items": [items], "n": [len(items)]})


class DedupProcessor(_Windowed):
    """One reduced item for each window: key, item, n."""

    def __init__(self, timeout_ms: int, max_size: int, reduce: Callable):
        super().__init__(timeout_ms, max_size)
        self.reduce = reduce

    def close_window(self, key, items):
        values = [json.loads(x).get("v") for x in items]
        out = values[0]
        for x in values[1:]:
            out = self.reduce(out, x)
        # an item that was chosen stays as it was stored
        same = next((item for item, v in zip(items, values, strict=True) if v is out), None)
        return pd.DataFrame({"key": [key[0]], "item": [json.dumps({"v": out}) if same is None else same], "n": [len(items)]})


class GenerationProcessor(StatefulProcessor):
    """Numbers a key's groups; a group closes when as many rows are settled as arrived.

    Input rows have ``kind``: ``arrive`` or ``settle``. Arrivals come out with their generation.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("group", "generation long, in_flight long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        generation, in_flight = self.state.get() if self.state.exists() else (0, 0)
        for pdf in rows:
            out = []
            for kind, item in zip(pdf["kind"], pdf["item"], strict=True):
                if kind == "arrive":
                    in_flight += 1
                    out.append((key[0], item, generation))
                elif in_flight:
                    in_flight -= 1
                    generation += in_flight == 0
            if out:
                yield pd.DataFrame(out, columns=["key", "item", "generation"])
        self.state.update((generation, in_flight))

    def close(self) -> None: ...


class AcknowledgementProcessor(StatefulProcessor):
    """Settlements in the order of arrival. Rows have ``offset``, ``status`` (null: it arrives) and ``at`` (microseconds).

    Arrivals get consecutive places. The state holds the offsets that are open, and what is settled behind an open one as a set of
    intervals, each by its first and last place: in the compact modes a run of acknowledged records is one interval, of which only
    the last record is kept.
    """

    def __init__(self, compact: bool):
        self.compact = compact

    def init(self, handle: StatefulProcessorHandle) -> None:
        # head: the first place that hasn't executed; places: how many were given; last: the highest offset that arrived
        self.queue = handle.getValueState("queue", "head long, places long, last long")
        self.open = _Entries(handle.getMapState("open", "offset long", "place long"))
        self.last_of = _Entries(handle.getMapState("last_of", "first long", "last long"))
        self.settled = _Entries(handle.getMapState("settled", "last long", "first long, offset long, status string, at long"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        queue = self.queue.get() if self.queue.exists() else (0, 0, -1)
        self._hold(*queue)
        for events in _in_order(rows):
            queue, out = self._settle(key, events, *queue)
            if sum(len(e.known) for e in (self.open, self.last_of, self.settled)) > HELD:
                self._store(*queue)
            if out:
                frame = pd.DataFrame(out, columns=["key", "offset", "status", "settled", "executed", "collapsed"])
                yield frame.astype({"executed": "Int64"})
        self._store(*queue)

    def _hold(self, head: int, places: int, last: int) -> None:
        self.open.begin(last + 1)
        self.last_of.begin(places)
        self.settled.begin(places)

    def _store(self, head: int, places: int, last: int) -> None:
        for entries in (self.open, self.last_of, self.settled):
            entries.flush()
        self.queue.update((head, places, last))
        self._hold(head, places, last)

    def _settle(self, key, events: Iterator[tuple], head: int, places: int, last: int) -> tuple[tuple[int, int, int], list[tuple]]:
        out: list[tuple] = []
        for at, offset, status in events:
            settles = status is not None
            if not settles:
                if offset > last:  # else it was delivered again
                    self.open.put((offset,), (places,))
                    places, last = places + 1, offset
                continue
            found = self.open.pop((offset,))
            if found is None:
                continue  # settled before, or unknown: the first signal counts
            first = end = found[0]
            entry = (offset, status, at)
            if self.compact and status == "ack" and first > head:
                left = self.settled.get((first - 1,))
                if left is not None and left[2] == "ack":
                    self.settled.pop((first - 1,))
                    self.last_of.pop((left[0],))
                    out.append((key[0], *left[1:], None, True))
                    first = left[0]
                after = self.last_of.get((end + 1,))
                right = self.settled.get(after) if after else None
                if right is not None and right[2] == "ack":
                    self.last_of.pop((end + 1,))
                    out.append((key[0], *entry, None, True))
                    end, entry = after[0], right[1:]
            self.settled.put((end,), (first, *entry))
            self.last_of.put((first,), (end,))
            while (ended := self.last_of.pop((head,))) is not None:
                out.append((key[0], *self.settled.pop(ended)[1:], at, False))
                head = ended[0] + 1
        return (head, places, last), out

    def close(self) -> None: ...


def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator[Iterator[tuple]]:
    """A batch's signals as (at, offset, status), ``AT_ONCE`` together: by time, arrivals first, then offset and status.

    Until then a signal takes 20 bytes: numbers and a status's code.
    """
    codes: dict[str, int] = {}
    parts: list[list[np.ndarray]] = [[], [], []]
    for pdf in rows:
        code = [-1 if pd.isna(s) else codes.setdefault(s, len(codes)) for s in pdf["status"]]
        for part, column in zip(parts, (pdf["at"].to_numpy("int64"), pdf["offset"].to_numpy("int64"), np.array(code, "int32")), strict=True):
            part.append(column.copy())  # not a view of the frame
    joined = []
    while parts:
        joined.append(np.concatenate(parts.pop(0) or [np.empty(0, "int64")]))
    at, offset, code = joined
    names = sorted(codes)
    rank = np.full(len(codes) + 1, -1, "int32")  # the last one is of arrivals
    for k, name in enumerate(names):
        rank[codes[name]] = k
    code = rank[code]
    order = np.lexsort((code, offset, code >= 0, at))
    names.append(None)
    for k in range(0, len(order), AT_ONCE):
        some = order[k : k + AT_ONCE]
        yield zip(at[some].tolist(), offset[some].tolist(), [names[c] for c in code[some].tolist()], strict=True)


class _Entries:
    """A map of the state store; what comes and goes within a batch never gets there and isn't held."""

    def __init__(self, state):
        self.state = state
        self.begin(0)

    def begin(self, fresh: int) -> None:
        """No key from ``fresh`` on is in the store."""
        self.known, self.changed, self.fresh = {}, set(), fresh

    def get(self, key: tuple) -> tuple | None:
        if key not in self.known:
            if key[0] >= self.fresh:
                return None
            self.known[key] = tuple(self.state.getValue(key)) if self.state.containsKey(key) else None
        return self.known[key]

    def put(self, key: tuple, value: tuple | None) -> None:
        self.known[key] = value
        self.changed.add(key)

    def pop(self, key: tuple) -> tuple | None:
        value = self.get(key)
        if value is not None:
            if key[0] >= self.fresh:
                del self.known[key]
                self.changed.discard(key)
            else:
                self.put(key, None)
        return value

    def flush(self) -> None:
        for key in self.changed:
            if self.known[key] is not None:
                self.state.updateValue(key, self.known[key])
            elif self.state.containsKey(key):
                self.state.removeKey(key)


def keep_first(a, _):
    return a


def keep_last(_, b):
    return b


def _run(df: DataFrame, key: str, processor: StatefulProcessor, schema: str, timers: bool = True) -> DataFrame:
    from tidemark.session import ship

    ship(df.sparkSession)
    return df.withColumn(key, F.col(key).cast("string")).groupBy(key).transformWithStateInPandas(processor, schema, "Update", "ProcessingTime" if timers else "None")


def _stored(df: DataFrame, key: str, column: str) -> tuple[DataFrame, str]:
    """(key, item as JSON), and the item's type."""
    kind = df.schema[column].dataType.simpleString()
    value = F.base64(F.col(column)) if kind == "binary" else F.col(column)
    return df.select(F.col(key).alias("key"), F.to_json(F.struct(value.alias("v"))).alias("item")), kind


def _restored(item, kind: str):
    if kind == "binary":
        return F.unbase64(F.from_json(item, "v string")["v"])
    return F.from_json(item, f"v {kind}")["v"]


def buffer_stream(df: DataFrame, key: str, column: str, timeout_ms: int, max_size: int) -> DataFrame:
    rows, kind = _stored(df, key, column)
    got = _run(rows, "key", BufferProcessor(timeout_ms, max_size), "key string, items array<string>, n long")
    return got.withColumn("items", F.transform("items", lambda x: _restored(x, kind)))


def deduplicate_stream(df: DataFrame, key: str, column: str, timeout_ms: int, max_size: int, reduce: Callable = keep_first) -> DataFrame:
    """``reduce`` sees values as JSON has them (numbers, text, lists, objects, None; binary as base64)."""
    rows, kind = _stored(df, key, column)
    got = _run(rows, "key", DedupProcessor(timeout_ms, max_size, reduce), "key string, item string, n long")
    return got.withColumn("item", _restored(F.col("item"), kind))


def generation_stream(df: DataFrame, key: str) -> DataFrame:
    return _run(df, key, GenerationProcessor(), "key string, item string, generation long")


def frontier_stream(df: DataFrame, key: str, mode: str = STRICT) -> DataFrame:
    """Each settlement as it executes or collapses: key, offset, status, settled, executed (null if it collapsed), collapsed, freed.

    ``df``: ``offset``, ``status`` (null: the record arrives) and ``at`` by ``key``. A record settles after those that arrived before it,
    as ``acks.frontier`` has it for tables; within a batch rows count in the order of ``at``, arrivals first, then offset.
    Arrivals that don't ascend in offset are redeliveries and ignored, as are rows without offset or time.
    """
    events = df.where(F.col("offset").isNotNull() & F.col("at").isNotNull())
    rows = events.select(F.col(key).alias("key"), F.col("offset").cast("long").alias("offset"), "status", F.unix_micros(F.col("at").cast("timestamp")).alias("at"))
    got = _run(rows, "key", AcknowledgementProcessor(mode != STRICT), "key string, offset long, status string, settled long, executed long, collapsed boolean", timers=False)
    for c in ("settled", "executed"):
        got = got.withColumn(c, F.timestamp_micros(c))
    return got.withColumn("freed", F.col("settled") if mode == COMPACT_EAGER else F.col("executed"))
