"""Running streams: dead letters, idempotent batches, restarts, lifecycle, activity, copies."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidemark.operators.failure import NACKED, OK
from tidemark.sources.sinks import Transaction

RESUBSCRIBE_S = 20.0
ACTIVITY_DELAY_S = ACTIVITY_INTERVAL_S = 60.0


def dead_letter_batches(good: str, letters: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: ok rows to one table, nacked ones to another, each batch once."""

    def run(df: DataFrame, batch_id: int) -> None:
        held = df.persist()
        try:
            Transaction(letters).write(held.where(f"_ack = '{NACKED}'"), batch_id)
            Transaction(good).write(held.where(f"_ack = '{OK}'"), batch_id)
        finally:
            held.unpersist()

    return run


def idempotent_batches(table: str) -> Callable[[DataFrame, int], None]:
    """Consume, process, produce: a batch that was committed before a crash isn't written again."""
    return lambda df, batch_id: Transaction(table).write(df, batch_id)


def resubscribe(start: Callable[[], StreamingQuery], delay_s: float = RESUBSCRIBE_S, stop: threading.Event | None = None, max_restarts: int | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Runs a query until it ends by itself; after a failure starts it again from its checkpoint.

    A negative delay disables restarts: the failure is raised. Returns the number of restarts.
    """
    restarts = 0
    while True:
        query = start()
        try:
            query.awaitTermination()
            return restarts
        except Exception:
            if delay_s < 0 or (stop and stop.is_set()) or (max_restarts is not None and restarts >= max_restarts):
                raise
            restarts += 1
            sleep(delay_s)


class ErrorEmitter:
    """Ends a query from outside with an error."""

    def __init__(self, query: StreamingQuery):
        self.query = query
        self.error: Exception | None = None

    def emit(self, error: Exception) -> None:
        self.error = self.error or error
        self.query.stop()

    def result(self, timeout_s: float = 10.0) -> None:
        self.query.awaitTermination(timeout_s)
        if self.error:
            raise self.error


class Stream:
    """A stream's lifecycle. Starting what has started is an error; stopping twice isn't."""

    STOPPED, STARTING, STARTED = "STOPPED", "STARTING", "STARTED"

    def __init__(self, name: str, start: Callable[[], StreamingQuery]):
        self.name, self._start = name, start
        self.state, self.query = self.STOPPED, None
        self._lock = threading.Lock()

    def start(self) -> Stream:
        with self._lock:
            if self.state != self.STOPPED:
                raise RuntimeError(f"{self.name} is {self.state}")
            self.state = self.STARTING
        try:
            self.query = self._start()
            self.state = self.STARTED
        except Exception:
            self.state = self.STOPPED
            raise
        return self

    def stop(self) -> None:
        with self._lock:
            if self.query is not None:
                self.query.stop()
            self.query, self.state = None, self.STOPPED


class CompositeStream:
    """Several copies of a stream, named ``-c1``, ``-c2`` and so on."""

    def __init__(self, name: str, copies: int, start: Callable[[str], StreamingQuery]):
        names = [f"{name}-c{k}" for k in range(1, copies + 1)] if copies > 1 else [name]
        self.streams = [Stream(n, lambda n=n: start(n)) for n in names]

    def start(self) -> CompositeStream:
        for s in self.streams:
            s.start()
        return self

    def stop(self) -> None:
        for s in self.streams:
            s.stop()


class StreamStatus:
    """Streams by name, sorted; of streams with one name the first stays."""

    def __init__(self, streams: Iterable[Stream]):
        self.streams: dict[str, Stream] = {}
        for s in streams:
            self.streams.setdefault(s.name, s)

    def list(self) -> list[dict[str, str]]:
        return [{"name": n, "state": self.streams[n].state} for n in sorted(self.streams)]

    def get(self, name: str) -> dict[str, str] | None:
        s = self.streams.get(name)
        return s and {"name": name, "state": s.state}

    def start(self, name: str) -> None:
        self.streams[name].start()

    def stop(self, name: str) -> None:
        self.streams[name].stop()


class StarterStopper:
    """Starts and stops a stream by a sequence of signals; repeated ones do nothing."""

    def __init__(self, stream: Stream):
        self.stream = stream

    def apply(self, signals: Iterable[bool]) -> None:
        for on in signals:
            if on and self.stream.state == Stream.STOPPED:
                self.stream.start()
            elif not on and self.stream.state == Stream.STARTED:
                self.stream.stop()


class ActivityEnforcer(StreamingQueryListener):
    """Remembers when rows last came; ``check`` raises after too long a silence."""

    def __init__(self, max_inactivity_s: float, clock: Callable[[], float] = time.monotonic):
        self.max_inactivity_s, self.clock = max_inactivity_s, clock
        self.last = clock()

    def onQueryStarted(self, event) -> None:
        self.last = self.clock()

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows:
            self.last = self.clock()

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def check(self) -> None:
        silent = self.clock() - self.last
        if self.max_inactivity_s > 0 and silent > self.max_inactivity_s:
            raise TimeoutError(f"no rows for {silent:.0f} s")


class CountingListener(StreamingQueryListener):
    """Signal counters of all queries: started, batches, rows, terminated, failed."""

    def __init__(self):
        self.started = self.batches = self.rows = self.terminated = self.failed = 0

    def onQueryStarted(self, event) -> None:
        self.started += 1

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        self.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None:
        self.terminated += 1
        self.failed += event.exception is not None
