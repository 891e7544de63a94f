"""Plans over the Kafka connector: bounded and unbounded reads, writes, and the record columns of this package.

The connector (format ``kafka``) has to be on the class path; everything else is column work that any
table with its columns can go through.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

FORMAT = "kafka"
#: Columns of the connector.
SCHEMA = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp, timestampType int, headers array<struct<key:string,value:binary>>"
# Defaults of the receivers and senders.
MAX_IN_FLIGHT = 4096


def subscription(servers: str, topics: Iterable[str] | None = None, pattern: str | None = None, partitions: dict[str, list[int]] | None = None, client: dict[str, str] | None = None) -> dict[str, str]:
    """Options that choose what is read: topics, a pattern or assigned partitions; ``client`` goes to the consumer."""
    if sum(x is not None for x in (topics, pattern, partitions)) != 1:
        raise ValueError("one of topics, pattern and partitions")
    out = {"kafka.bootstrap.servers": servers} | {f"kafka.{k}": v for k, v in (client or {}).items()}
    if topics is not None:
        return out | {"subscribe": ",".join(topics)}
    return out | ({"subscribePattern": pattern} if pattern is not None else {"assign": json.dumps(partitions, sort_keys=True)})


def range_options(ranges: Iterable[tuple[str, int, int, int]]) -> dict[str, str]:
    """Options of a bounded read of (topic, partition, first offset, last offset), both included."""
    start: dict[str, dict[str, int]] = {}
    end: dict[str, dict[str, int]] = {}
    for topic, partition, low, high in ranges:
        start.setdefault(topic, {})[str(partition)] = low
        end.setdefault(topic, {})[str(partition)] = high + 1
    return {"startingOffsets": json.dumps(start, sort_keys=True), "endingOffsets": json.dumps(end, sort_keys=True), "assign": json.dumps({t: sorted(map(int, p)) for t, p in start.items()}, sort_keys=True)}


def read_ranges(spark: SparkSession, servers: str, ranges: Iterable[tuple[str, int, int, int]], **client: str) -> DataFrame:
    """A bounded read; the connector plans one task a range."""
    options = {"kafka.bootstrap.servers": servers} | {f"kafka.{k.replace('_', '.')}": v for k, v in client.items()} | range_options(ranges)
    return records(spark.read.format(FORMAT).options(**options).load())


def read_stream(spark: SparkSession, chosen: dict[str, str], starting: str | dict = "earliest", max_in_flight: int = MAX_IN_FLIGHT, fail_on_loss: bool = True) -> DataFrame:
    """An unbounded read; offsets are kept in the query's checkpoint."""
    options = chosen | {"startingOffsets": starting if isinstance(starting, str) else json.dumps(starting), "maxOffsetsPerTrigger": str(max_in_flight), "failOnDataLoss": str(fail_on_loss).lower(), "includeHeaders": "true"}
    return records(spark.readStream.format(FORMAT).options(**options).load())


def records(raw: DataFrame, key: Column | None = None, value: Column | None = None) -> DataFrame:
    """topic, partition, offset, timestamp, key, value (strings unless decoded otherwise) and headers as a map."""
    headers = F.map_from_entries(F.transform("headers", lambda h: F.struct(h["key"], F.decode(h["value"], "UTF-8")))) if "headers" in raw.columns else F.lit(None).cast("map<string,string>")
    return raw.select(
        "topic", "partition", "offset", "timestamp",
        (F.decode("key", "UTF-8") if key is None else key).alias("key"),
        (F.decode("value", "UTF-8") if value is None else value).alias("value"),
        headers.alias("headers"),
    )


def outgoing(df: DataFrame, topic: Column, value: Column, key: Column | None = None, headers: Column | None = None, partition: Column | None = None) -> DataFrame:
    """Rows as the connector writes them; ``headers`` is a map of strings."""
    out = [topic.cast("string").alias("topic"), (F.lit(None) if key is None else key).cast("string").cast("binary").alias("key"), value.cast("string").cast("binary").alias("value")]
    if partition is not None:
        out.append(partition.cast("int").alias("partition"))
    if headers is not None:
        out.append(F.transform(F.map_entries(headers), lambda h: F.struct(h["key"].alias("key"), h["value"].cast("binary").alias("value"))).alias("headers"))
    return df.select(*out)


def producer_options(servers: str, transactional_id: str | None = None, acks: str = "all", **client: str) -> dict[str, str]:
    out = {"kafka.bootstrap.servers": servers, "kafka.acks": acks, "kafka.enable.idempotence": "true", "includeHeaders": "true"}
    out |= {f"kafka.{k.replace('_', '.')}": v for k, v in client.items()}
    return out | ({"kafka.transactional.id": transactional_id} if transactional_id else {})


def write(df: DataFrame, servers: str, **client: str) -> None:
    """Sends every row of an outgoing table once, or fails; at least once when tasks repeat."""
    df.write.format(FORMAT).options(**producer_options(servers, **client)).save()


def write_stream(df: DataFrame, servers: str, checkpoint: str, **client: str) -> DataStreamWriter:
    return df.writeStream.format(FORMAT).options(**producer_options(servers, **client)).option("checkpointLocation", checkpoint)
