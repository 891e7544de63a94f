"""Bounded reads by position: earliest, latest, timestamp, group and raw offsets.

A range's ends are criteria. They are resolved against a table of bounds, one row for each
(topic, partition), which comes from one aggregate over the topic; the resolved ranges are
as few rows as partitions.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["topic", "partition"]
NEVER = (1 << 63) - 1


@dataclass(frozen=True)
class Position:
    """A criterion; see the constructors below."""

    kind: str
    value: int | None = None

    def to(self, end: Position) -> OffsetRange:
        return OffsetRange(self, end)

    def as_range(self) -> OffsetRange:
        return OffsetRange(self, self)


def earliest() -> Position:
    return Position("earliest")


def latest() -> Position:
    return Position("latest")


def raw(offset: int) -> Position:
    return Position("raw", offset)


def timestamp(millis: int | datetime) -> Position:
    return Position("timestamp", int(millis.timestamp() * 1000) if isinstance(millis, datetime) else millis)


def group() -> Position:
    """The consumer group's committed offset, column ``committed`` of the bounds."""
    return Position("group")


@dataclass(frozen=True)
class OffsetRange:
    """From ``low`` to ``high``, both included."""

    low: Position
    high: Position


@dataclass(frozen=True)
class RangeProvider:
    """A range for all partitions, or by partition; an order of partitions; a start inside one."""

    every: OffsetRange | None = None
    by_partition: dict[tuple[str, int], OffsetRange] | None = None
    start_at: tuple[str, int, int] | None = None
    descending: bool = False
    max_concurrent: int = 1

    def starting_from(self, topic: str, partition: int, offset: int) -> RangeProvider:
        """Partitions before (topic, partition) are skipped, that one begins at the raw offset."""
        return replace(self, start_at=(topic, partition, offset))

    def in_partition_order(self, descending: bool = False, max_concurrent: int = 1) -> RangeProvider:
        return replace(self, descending=descending, max_concurrent=max_concurrent)


def bounds(records: DataFrame, times: list[int] = (), committed: DataFrame | None = None) -> DataFrame:
    """earliest, latest (one past the last), committed, and ts_<millis>: the first offset at or after a time."""
    millis = F.unix_millis(F.col("timestamp").cast("timestamp"))
    aggs = [F.min("offset").alias("earliest"), (F.max("offset") + 1).alias("latest")]
    aggs += [F.min(F.when(millis >= t, F.col("offset"))).alias(f"ts_{t}") for t in sorted(set(times))]
    out = records.groupBy(*KEYS).agg(*aggs)
    if committed is None:
        return out.withColumn("committed", F.lit(None).cast("long"))
    return out.join(committed.select(*KEYS, "committed"), KEYS, "left")


def _times(r: OffsetRange | None) -> list[int]:
    out = []
    if r and r.low.kind == "timestamp":
        out.append(r.low.value)
    if r and r.high.kind == "timestamp":
        out.append(r.high.value + 1)
    return out


def _low(p: Position) -> Column:
    """First offset read."""
    return {
        "raw": lambda: F.lit(p.value),
        "timestamp": lambda: F.coalesce(F.col(f"ts_{p.value}"), F.lit(NEVER)),
        "earliest": lambda: F.col("earliest"),
        "latest": lambda: F.col("latest") - 1,
        "group": lambda: F.col("committed"),
    }[p.kind]().cast("long")


def _high(p: Position) -> Column:
    """One past the last offset read."""
    return {
        "raw": lambda: F.lit(p.value + 1),
        "timestamp": lambda: F.coalesce(F.col(f"ts_{p.value + 1}"), F.lit(NEVER)),
        "earliest": lambda: F.col("earliest") + 1,
        "latest": lambda: F.col("latest"),
        "group": lambda: F.col("committed"),
    }[p.kind]().cast("long")


def times_of(provider: RangeProvider) -> list[int]:
    """The times whose offsets a provider's ranges need."""
    return _times(provider.every) + [t for r in (provider.by_partition or {}).values() for t in _times(r)]


def resolve(records: DataFrame, provider: RangeProvider, committed: DataFrame | None = None) -> DataFrame:
    """The provider's ranges over all of ``records``; ``log.Log.resolve`` finds them by an index instead."""
    return resolve_bounds(bounds(records, times_of(provider), committed), provider)


def resolve_bounds(table: DataFrame, provider: RangeProvider) -> DataFrame:
    """topic, partition, min_offset, max_offset (both included) and wave, when it is its turn; empty ranges are left out."""
    cases = [(k, r) for k, r in (provider.by_partition or {}).items()]
    none = F.lit(None).cast("long")
    low = _low(provider.every.low) if provider.every else none
    high = _high(provider.every.high) if provider.every else none
    for (topic, partition), r in cases:
        here = (F.col("topic") == topic) & (F.col("partition") == partition)
        low, high = F.when(here, _low(r.low)).otherwise(low), F.when(here, _high(r.high)).otherwise(high)
    if provider.start_at:
        topic, partition, offset = provider.start_at
        here = (F.col("topic") == topic) & (F.col("partition") == partition)
        before = (F.col("topic") < topic) | ((F.col("topic") == topic) & (F.col("partition") < partition))
        if provider.descending:
            before = (F.col("topic") > topic) | ((F.col("topic") == topic) & (F.col("partition") > partition))
        low = F.when(before, none).when(here, F.lit(offset).cast("long")).otherwise(low)
    out = table.select(*KEYS, F.greatest(low, F.col("earliest")).alias("min_offset"), (F.least(high, F.col("latest")) - 1).alias("max_offset"), low.alias("_l"), high.alias("_h"))
    found = out.where("_l is not null and _h is not null and min_offset <= max_offset").drop("_l", "_h")
    # one row for each partition of the topic
    place = F.row_number().over(Window.orderBy(*[F.desc(k) if provider.descending else F.asc(k) for k in KEYS])) - 1
    return found.withColumn("wave", F.floor(place / provider.max_concurrent).cast("int"))


def read_ranges(records: DataFrame, ranges: DataFrame) -> DataFrame:
    """Records inside resolved ranges. The ranges are one row for each partition of the topic."""
    return records.join(ranges, KEYS).where(F.col("offset").between(F.col("min_offset"), F.col("max_offset"))).drop("min_offset", "max_offset", "wave")


def read_in_waves(records: DataFrame, ranges: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """(records, positions to commit once they are acknowledged) of ``max_concurrent`` partitions after another, in their order."""
    waves = sorted(r.wave for r in ranges.select("wave").distinct().collect())
    out = []
    for k in waves:
        own = ranges.where(F.col("wave") == k)
        out.append((read_ranges(records, own), own.select(*KEYS, (F.col("max_offset") + 1).alias("committed"))))
    return out


def read(records: DataFrame, provider: RangeProvider, committed: DataFrame | None = None) -> DataFrame:
    return read_ranges(records, resolve(records, provider, committed))


def read_up_to(records: DataFrame, high: Position, committed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records from the group's position up to ``high``, and the positions to commit once they are acked."""
    ranges = resolve(records, RangeProvider(OffsetRange(group(), high)), committed)
    return read_ranges(records, ranges), ranges.select(*KEYS, (F.col("max_offset") + 1).alias("committed"))


def lag(records: DataFrame, committed: DataFrame, reset: str = "none") -> DataFrame:
    """latest, committed and lag of each partition. Uncommitted ones are reset: earliest, latest, or left out."""
    return lag_of(bounds(records, committed=committed), reset)


def lag_of(table: DataFrame, reset: str = "none") -> DataFrame:
    start = {"earliest": F.col("earliest"), "latest": F.col("latest"), "none": F.lit(None).cast("long")}[reset]
    out = table.withColumn("committed", F.coalesce("committed", start))
    return out.where("committed is not null").select(*KEYS, "latest", "committed", (F.col("latest") - F.col("committed")).alias("lag"))


def list_offsets(records: DataFrame) -> DataFrame:
    return bounds(records).select(*KEYS, "earliest", "latest")


def list_partitions(records: DataFrame) -> DataFrame:
    return records.select(*KEYS).distinct()


def alter_group(committed: DataFrame, changes: DataFrame) -> DataFrame:
    """Committed offsets after raw changes."""
    new = changes.select(*KEYS, F.col("committed").alias("_new"))
    return committed.join(new, KEYS, "full_outer").select(*KEYS, F.coalesce("_new", "committed").alias("committed"))
