"""A topic as a log: segments sorted by offset, and a sparse index that says which of them a range needs.

Segments are Parquet folders by topic, partition and a range of ``segment`` offsets, sorted by offset. The index
has a row for every ``every`` offsets: first and last offset, rows, and the latest time of these rows and of all before
them. That running maximum never falls, so the first block in which it reaches a time holds the first record at or
after that time, however records are out of order, and only that block is read to find its offset. Positions of
earliest and latest come from the index alone. Resolved ranges become predicates on the segment folders and on
offsets, so a read opens what the index admits: partition pruning drops segments, and Parquet's statistics drop row groups.

Offsets may have gaps. A topic without records has no ranges. Records without a time count for no time. Repeated offsets
stay in their segment. Other columns of the records are kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.scans import running
from tidemark.sources import ranges
from tidemark.sources.ranges import KEYS, RangeProvider

#: Offsets of a segment, and of a row of the index.
SEGMENT, EVERY = 1_000_000, 4096
#: Ranges that are written into a predicate; more are joined.
LITERALS = 2000
_SEGMENT = "_segment"


def _millis() -> Column:
    return F.unix_millis(F.col("timestamp").cast("timestamp"))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


@dataclass(frozen=True)
class Log:
    """A written topic."""

    spark: SparkSession
    folder: str
    schema: StructType
    segment: int = SEGMENT
    every: int = EVERY

    def _stored(self) -> DataFrame:
        more = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields if f.name not in KEYS)
        return self.spark.read.schema(f"{more}, topic string, partition int, {_SEGMENT} long").parquet(f"{self.folder}/segments")

    def records(self) -> DataFrame:
        """All records."""
        return self._stored().select(*self.schema.names)

    def index(self) -> DataFrame:
        """topic, partition, block, first_offset, last_offset, n, latest_ms, so_far_ms"""
        return self.spark.read.parquet(f"{self.folder}/index")

    def _within(self, spans: DataFrame) -> DataFrame:
        """Stored records of ``spans`` (topic, partition, a, b), both offsets included; spans of a partition don't overlap."""
        found = spans.select(*KEYS, "a", "b").limit(LITERALS + 1).collect()
        if len(found) <= LITERALS:
            segments = lambda r: F.col(_SEGMENT).between(r.a // self.segment, r.b // self.segment)
            here = lambda r: (F.col("topic") == r.topic) & (F.col("partition") == r.partition)
            return self._stored().where(_any([here(r) & segments(r) & F.col("offset").between(r.a, r.b) for r in found]))
        parts = spans.select(*KEYS, "a", "b", F.explode(F.sequence(F.floor(F.col("a") / self.segment), F.floor(F.col("b") / self.segment))).alias(_SEGMENT))
        return self._stored().join(parts, [*KEYS, _SEGMENT]).where(F.col("offset").between(F.col("a"), F.col("b"))).drop("a", "b")

    def bounds(self, times: list[int] = (), committed: DataFrame | None = None) -> DataFrame:
        """What ``ranges.bounds`` says of all records, from the index and at most a block for each partition and time."""
        index, times = self.index(), sorted(set(times))
        out = index.groupBy(*KEYS).agg(F.min("first_offset").alias("earliest"), (F.max("last_offset") + 1).alias("latest"))
        if times:
            first = [F.min(F.when(F.col("so_far_ms") >= t, F.struct("first_offset", "last_offset"))).alias(f"t{k}") for k, t in enumerate(times)]
            blocks = index.groupBy(*KEYS).agg(*first).select(*KEYS, F.explode(F.array_distinct(F.array(*[f"t{k}" for k in range(len(times))]))).alias("e"))
            spans = blocks.where("e is not null").select(*KEYS, F.col("e.first_offset").alias("a"), F.col("e.last_offset").alias("b"))
            # a record of a later block's time in an earlier one would have raised the running maximum there
            at = self._within(spans).groupBy(*KEYS).agg(*[F.min(F.when(_millis() >= t, F.col("offset"))).alias(f"ts_{t}") for t in times])
            out = out.join(at, KEYS, "left")
        if committed is None:
            return out.withColumn("committed", F.lit(None).cast("long"))
        return out.join(committed.select(*KEYS, "committed"), KEYS, "left")

    def resolve(self, provider: RangeProvider, committed: DataFrame | None = None) -> DataFrame:
        return ranges.resolve_bounds(self.bounds(ranges.times_of(provider), committed), provider)

    def read_ranges(self, resolved: DataFrame) -> DataFrame:
        spans = resolved.select(*KEYS, F.col("min_offset").alias("a"), F.col("max_offset").alias("b"))
        return self._within(spans).select(*self.schema.names)

    def read(self, provider: RangeProvider, committed: DataFrame | None = None) -> DataFrame:
        """The records of a provider's ranges."""
        return self.read_ranges(self.resolve(provider, committed))

    def read_up_to(self, high: ranges.Position, committed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Records from the group's position up to ``high``, and the positions to commit once they are acked."""
        resolved = self.resolve(RangeProvider(ranges.OffsetRange(ranges.group(), high)), committed)
        return self.read_ranges(resolved), resolved.select(*KEYS, (F.col("max_offset") + 1).alias("committed"))

    def lag(self, committed: DataFrame, reset: str = "none") -> DataFrame:
        return ranges.lag_of(self.bounds(committed=committed), reset)


def write(records: DataFrame, folder: str, segment: int = SEGMENT, every: int = EVERY) -> Log:
    """Writes records (topic, partition, offset, timestamp, and more) as a log. A segment is one task's, so a partition is many."""
    if segment % every:
        raise ValueError("a segment holds whole blocks of the index")
    spark = records.sparkSession
    log = Log(spark, folder, records.schema, segment, every)
    rows = records.withColumn(_SEGMENT, F.floor(F.col("offset") / segment))
    rows.repartition(*KEYS, _SEGMENT).sortWithinPartitions(*KEYS, _SEGMENT, "offset").write.partitionBy(*KEYS, _SEGMENT).parquet(f"{folder}/segments")
    blocks = log._stored().groupBy(*KEYS, F.floor(F.col("offset") / every).alias("block"))
    sparse = blocks.agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.count("*").alias("n"), F.max(_millis()).alias("latest_ms"))
    running(sparse, KEYS, ["block"], F.floor(F.col("block") / 10_000), so_far_ms=("max", F.col("latest_ms"))).write.parquet(f"{folder}/index")
    return log
