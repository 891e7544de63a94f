"""Senders: write rows, get a result row for each, and settle by it.

A sink is a function from an iterator of row dictionaries to an iterator of error messages
(null for sent). It runs on executors over Arrow batches. Modes: ``immediate`` fails at the
first error; ``delegate`` returns errors as results; ``delay`` sends everything and then
raises the first error. ``transactional`` writes batches that appear whole or not at all.

A sink may have ``buffered``, which gives a task a sink of its own that holds what it is given until ``flush``. A
task flushes before it returns results, so a result still means that its row was sent.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.session import drop_dir, materialise, new_dir, ship

Sink = Callable[[Iterable[dict]], Iterable[str | None]]
ERROR = "send_error"
#: Folder of a batch's positions; readers of its rows pass it over.
OFFSETS = "_offsets"


class SendError(RuntimeError):
    """A row could not be sent."""


def outgoing(df: DataFrame, topic: Column, key: Column, value: Column, *keep: str) -> DataFrame:
    """Rows as records: a topic that is constant or derived, a key, a value, and columns to settle by."""
    return df.select(topic.alias("topic"), key.alias("key"), value.alias("value"), *keep)


def _results(df: DataFrame, sink: Sink, batch: int, stop: bool) -> DataFrame:
    ship(df.sparkSession)
    names = df.columns

    def run(batches):
        buffered = getattr(sink, "buffered", None)
        own = buffered() if buffered else sink
        flush = own.flush if buffered else lambda: None
        for b in batches:
            rows = b.to_pylist()
            errors: list[str | None] = []
            for k in range(0, len(rows), max(1, batch)):
                got = list(own(iter(rows[k : k + max(1, batch)])))
                if stop and (bad := next((e for e in got if e is not None), None)) is not None:
                    flush()
                    raise SendError(bad)
                errors += got
            flush()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(errors, pa.string())], names=[*names, ERROR])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(ERROR, StringType())]))


def send(df: DataFrame, sink: Sink, mode: str = "immediate", batch: int = 1) -> DataFrame:
    """Result rows: the sent columns and ``send_error``. The send has happened when this returns."""
    if mode not in ("immediate", "delegate", "delay"):
        raise ValueError(mode)
    done = materialise(_results(df, sink, batch, mode == "immediate"), "sent")
    if mode == "delay" and (bad := done.where(F.col(ERROR).isNotNull()).select(ERROR).first()):
        raise SendError(bad[0])
    return done


def settle(results: DataFrame) -> DataFrame:
    """Acknowledges sent rows, nacks the others."""
    return results.withColumn("_ack", F.when(F.col(ERROR).isNull(), "ack").otherwise("nack"))


def acknowledge_all(df: DataFrame) -> DataFrame:
    """The default subscriber: everything is acknowledged."""
    return df.withColumn("_ack", F.lit("ack"))


class _FolderSink:
    """A task's rows for a file queue, published as pages."""

    def __init__(self, plan: str, folder: str, body: str, seen: Counter | None = None):
        from pyspark import TaskContext

        from tidemark.sources.queues import FileQueue

        task = TaskContext.get()
        self.part = f"{plan}-{task.partitionId() if task else 0}"
        self.queue, self.body, self.seen = FileQueue(folder), body, Counter() if seen is None else seen
        self.held: list = []

    def __call__(self, rows):
        from tidemark.sources.queues import Message, row_token

        for r in rows:
            if r[self.body] is None:
                yield "null body"
                continue
            text, key = str(r[self.body]), None if r.get("key") is None else str(r["key"])
            token = row_token(self.part, text, key, self.seen[text, key])
            self.seen[text, key] += 1
            self.held.append(Message(text, group_id=key, dedup_id=token))
            yield None

    def flush(self) -> None:
        if self.held:
            self.queue.publish([self.queue.stage(iter(self.held))])
            self.held = []


def folder_sink(folder: str, body: str = "value") -> Sink:
    """Sends each row to a file queue; a null body is an error.

    A message's dedup id comes from the sink, the partition, the row's content and how many such rows came
    before, so a task that runs again sends nothing twice.
    """
    plan = uuid.uuid4().hex
    counted: dict[tuple, Counter] = {}

    def run(rows):
        from pyspark import TaskContext

        task = TaskContext.get()
        # calls of one attempt go on counting
        seen = counted.setdefault((task.partitionId(), task.taskAttemptId()) if task else (0, 0), Counter())
        own = _FolderSink(plan, folder, body, seen)
        errors = list(own(rows))
        own.flush()
        yield from errors

    run.buffered = lambda: _FolderSink(plan, folder, body)
    return run


class Transaction:
    """Batches that appear whole: staged in the shared folder, then renamed into the table.

    ``batch_id`` makes it idempotent: a batch that was committed is not written again.
    """

    def __init__(self, table: str):
        self.table = table.rstrip("/")

    def _fs(self, df: DataFrame):
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path, path(self.table).getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())

    def rows(self, spark) -> DataFrame:
        return spark.read.parquet(self.table)

    def offsets(self, spark) -> DataFrame:
        """Positions that were committed with the rows, of all batches."""
        return spark.read.parquet(f"{self.table}/batch=*/{OFFSETS}")

    def write(self, df: DataFrame, batch_id: int, offsets: DataFrame | None = None) -> bool:
        """Whether it was written now. ``offsets``, the positions that the rows came from, appear with them."""
        path, fs = self._fs(df)
        target = path(f"{self.table}/batch={batch_id}")
        if fs.exists(target):
            return False
        staged = f"{self.table}/.staged-{batch_id}-{os.getpid()}"
        try:
            df.write.mode("overwrite").parquet(staged)
            if offsets is not None:
                offsets.write.parquet(f"{staged}/{OFFSETS}")
            fs.mkdirs(path(self.table))
            if not fs.rename(path(staged), target):
                raise SendError(f"batch {batch_id} could not be committed")
        except Exception:
            fs.delete(path(staged), True)
            raise
        return True


def send_transactional(batches: Iterable[DataFrame], table: str) -> list[bool]:
    t = Transaction(table)
    return [t.write(df, k) for k, df in enumerate(batches)]


__all__ = ["ERROR", "SendError", "Transaction", "acknowledge_all", "drop_dir", "folder_sink", "new_dir", "outgoing", "send", "send_transactional", "settle"]
