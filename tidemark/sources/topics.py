"""Topics: tables of records with topic, partition, offset, timestamp, key and value.

Any table can be read as a topic. On a cluster with the Kafka connector the same columns
come from ``kafka.records``; here tests and queries build them from the ``events`` table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PARTITIONS = 4
#: Ids of the events table that are numbered together.
CHUNK = 50_000


def wrap(df: DataFrame, topic: str, partition: Column, order: list[str], time: Column, key: Column, value: Column, chunk: Column | None = None) -> DataFrame:
    """A plain table as a topic; offsets number a partition's rows from 0.

    ``chunk`` must never decrease along the order (a day, a range of ids). Rows are then numbered inside a
    chunk and chunks by the counts before them, so a topic of few partitions isn't as few tasks.
    """
    rows = df.withColumn("partition", partition.cast("int")).withColumn("_chunk", F.lit(0) if chunk is None else chunk)
    number = F.row_number().over(Window.partitionBy("partition", "_chunk").orderBy(*order)).cast("long") - 1
    named = [F.lit(topic).alias("topic"), "partition", time.alias("timestamp"), key.alias("key"), value.alias("value"), "_chunk", number.alias("_n")]
    if chunk is None:
        return rows.select(*named).select("topic", "partition", F.col("_n").alias("offset"), "timestamp", "key", "value")
    # one row for each chunk of a partition
    before = rows.groupBy("partition", "_chunk").count().select(F.col("partition").alias("_p"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("count").over(Window.partitionBy("partition").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = rows.select(*named).join(before, (F.col("partition") == F.col("_p")) & F.col("_chunk").eqNullSafe(F.col("_c")))
    return placed.select("topic", "partition", (F.col("_before") + F.col("_n")).alias("offset"), "timestamp", "key", "value")


def unwrap(records: DataFrame) -> DataFrame:
    """Back to the values' columns."""
    return records.select("value.*")


def events_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as topic ``events``: partition by user, offsets by event_id."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return wrap(e, "events", F.col("user_id") % PARTITIONS, ["event_id"], F.col("ts"), F.col("user_id"), F.struct("event_id", "user_id", "event_type", F.col("value").alias("amount"), "props"), F.floor(F.col("event_id") / CHUNK))


def subscribe(records: DataFrame, topics: Iterable[str] | None = None, pattern: str | None = None, partitions: Iterable[tuple[str, int]] | None = None) -> DataFrame:
    """Records of the named topics, of those whose whole name matches, or of assigned partitions."""
    if topics is not None:
        return records.where(F.col("topic").isin(*topics))
    if pattern is not None:
        return records.where(F.col("topic").rlike(f"^(?:{pattern})$"))
    out = F.lit(False)
    for t, p in partitions or ():
        out = out | ((F.col("topic") == t) & (F.col("partition") == p))
    return records.where(out)


def values(records: DataFrame) -> DataFrame:
    """Values without the null ones, whose records are acknowledged."""
    return records.where(F.col("value").isNotNull()).select("value")


def auto_acked(records: DataFrame) -> DataFrame:
    """Records that count as acknowledged once emitted."""
    return records.withColumn("_ack", F.lit("ack"))


def stream_topic(spark: SparkSession, folder: str, schema: str, max_files: int | None = None) -> DataFrame:
    """A folder of Parquet files as an unbounded topic; ``max_files`` bounds what a batch admits."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(folder)


def acks(records: DataFrame, delay_s: Column, nacked: Column) -> DataFrame:
    """A settlement table for records: ack_ts and status."""
    return records.withColumn("ack_ts", F.col("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), delay_s)).withColumn("status", F.when(nacked, "nack").otherwise("ack"))


class PartitionListener:
    """Hooks at assignment; each ``once`` hook runs the first time a partition is assigned."""

    def __init__(self):
        self._once: list[tuple[set, Callable]] = []
        self.closed = False

    def on_assigned_once(self, hook: Callable[[list], None]) -> PartitionListener:
        self._once.append((set(), hook))
        return self

    def seek_once(self, seek: Callable[[object], int], positions: dict) -> PartitionListener:
        return self.on_assigned_once(lambda ps: positions.update({p: seek(p) for p in ps}))

    def seek_to_beginning_once(self, positions: dict) -> PartitionListener:
        return self.seek_once(lambda _: 0, positions)

    def assigned(self, partitions: Iterable) -> None:
        for seen, hook in self._once:
            fresh = [p for p in partitions if p not in seen]
            seen.update(fresh)
            if fresh:
                hook(fresh)

    def close(self) -> None:
        self.closed = True
