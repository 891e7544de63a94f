"""Acknowledgement as data: frontiers, parents, fan-in, offsets ahead of the commit.

A table of settled records has, for each queue (a partition), an order (offset), the time a
record was settled and how (``ack`` or ``nack``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.scans import CHUNK, by_offset, neighbour, running

STRICT, COMPACT, COMPACT_EAGER = "strict", "compact", "compact_eager"


def first_signal(df: DataFrame, keys: list[str], status: str, time: str) -> DataFrame:
    """A record is settled once: of several signals the first counts."""
    return df.groupBy(*keys).agg(F.min_by(status, time).alias(status), F.min(time).alias(time))


def frontier(df: DataFrame, queue: list[str], offset: str, settled: str, status: str, mode: str = STRICT, size: int = CHUNK) -> DataFrame:
    """When each settlement executes, in order: not before all earlier ones are settled.

    Adds ``executed`` (null while an earlier record is open) and ``collapsed``. In the
    compact modes a record that was settled without error behind an open one collapses into
    its right neighbour if that was, too; only the last of such a run executes. The eager
    mode frees its place at once, so ``freed`` is then the time it was settled.
    """
    chunk = by_offset(offset, size)
    out = running(df, queue, [offset], chunk, _open=("max", F.col(settled).isNull().cast("int")), executed=("max", F.col(settled)))
    out = out.withColumn("executed", F.when(F.col("_open") == 0, F.col("executed"))).drop("_open")
    if mode == STRICT:
        return out.withColumn("collapsed", F.lit(False)).withColumn("freed", F.col("executed"))
    ok = F.col(status) == "ack"
    out = neighbour(out, queue, [offset], chunk, 1, _next=F.col(settled), _next_ok=ok)
    pending = F.col("executed").isNull() | (F.greatest(F.col(settled), F.col("_next")) < F.col("executed"))
    joins = ok & F.col("_next_ok") & F.col(settled).isNotNull() & F.col("_next").isNotNull() & pending
    out = out.withColumn("collapsed", F.coalesce(joins, F.lit(False))).drop("_next", "_next_ok")
    return out.withColumn("freed", F.col(settled) if mode == COMPACT_EAGER else F.col("executed"))


def in_flight(df: DataFrame, queue: list[str], arrived: str, freed: str, chunk: Column | None = None) -> DataFrame:
    """Records in flight at each arrival or release, for a bound on them: a running sum of events.

    ``chunk``: a function of ``at``, the event's time, that never decreases.
    """
    events = df.select(*queue, F.col(arrived).alias("at"), F.lit(1).alias("d")).unionByName(df.where(F.col(freed).isNotNull()).select(*queue, F.col(freed).alias("at"), F.lit(-1).alias("d")))
    per = events.groupBy(*queue, "at").agg(F.sum("d").alias("d"))
    return running(per, queue, ["at"], chunk, in_flight=("sum", F.col("d"))).drop("d")


def parents(children: DataFrame, keys: list[str], status: str, time: str, error: str | None = None) -> DataFrame:
    """1 to N: a parent is acked when all children are, nacked by its first nack, open otherwise."""
    nack = F.col(status) == "nack"
    aggs = [
        F.when(F.bool_or(nack), "nack").when(F.count_if(F.col(status).isNull()) > 0, None).otherwise("ack").alias("status"),
        F.when(F.bool_or(nack), F.min(F.when(nack, F.col(time)))).when(F.count_if(F.col(status).isNull()) > 0, None).otherwise(F.max(time)).alias("settled"),
        F.count(F.lit(1)).alias("children"),
    ]
    if error:
        aggs.append(F.min_by(F.when(nack, F.col(error)), F.when(nack, F.col(time))).alias("error"))
    return children.groupBy(*keys).agg(*aggs)


def members(batches: DataFrame, rows: DataFrame, batch_keys: list[str]) -> DataFrame:
    """N to 1: every member of a batch gets the batch's status and error."""
    return rows.join(batches.select(*batch_keys, "status", "error"), batch_keys)


def committable(df: DataFrame, queue: list[str], offset: str, status: str) -> DataFrame:
    """Per queue the position to commit: one past the run of acked offsets from its first one on.

    That run ends before the first offset that isn't acked, so two aggregates do; nothing is sorted.
    """
    acked = F.coalesce(F.col(status) == "ack", F.lit(False))
    first = df.groupBy(*queue).agg(F.min(F.when(~acked, F.col(offset))).alias("_stop"), F.min(offset).alias("_first"))
    on = [F.col(q).eqNullSafe(F.col(f"_of_{q}")) for q in queue]
    # one row for each queue
    named = first.select(*[F.col(q).alias(f"_of_{q}") for q in queue], "_stop", "_first")
    run = F.max(F.when(F.col("_stop").isNull() | (F.col(offset) < F.col("_stop")), F.col(offset) + 1))
    joined = df.join(named, on[0] if len(on) == 1 else reduce(lambda a, b: a & b, on)) if on else df.crossJoin(named)
    return joined.groupBy(*queue).agg(F.coalesce(run, F.min("_first")).alias("position"))


def ranges(df: DataFrame, queue: list[str], offset: str) -> DataFrame:
    """Inclusive ranges of consecutive offsets; repeated offsets count once."""
    w = Window.partitionBy(*queue).orderBy(offset)
    rows = df.select(*queue, offset).distinct().withColumn("_island", F.col(offset) - F.row_number().over(w))
    return rows.groupBy(*queue, "_island").agg(F.min(offset).alias("start"), F.max(offset).alias("end")).drop("_island")


def ahead_of_commit(df: DataFrame, queue: list[str], offset: str, status: str) -> DataFrame:
    """Ranges of offsets acked past the commit position: not to be read again after a restart."""
    at = committable(df, queue, offset, status)
    return ranges(df.where(F.col(status) == "ack").join(at, queue).where(F.col(offset) >= F.col("position")), queue, offset)


def unprocessed(records: DataFrame, done: DataFrame, queue: list[str], offset: str) -> DataFrame:
    """Records to process after a restart: at or past the position, outside the ranges ahead of it.

    ``done`` has queue, position, start and end; position alone is enough (null range).
    """
    position = done.groupBy(*queue).agg(F.max("position").alias("position"))
    left = records.join(position, queue, "left").where(F.col("position").isNull() | (F.col(offset) >= F.col("position"))).drop("position")
    # ranges take their place among the records; a record is in one if the largest end so far reaches it
    spans = done.where("start is not null").select(*queue, F.col("start").alias(offset), F.col("end").alias("_end"), F.lit(0).alias("_kind"))
    both = left.withColumn("_kind", F.lit(1)).unionByName(spans, allowMissingColumns=True)
    reached = running(both, queue, [offset, "_kind"], by_offset(offset), _upto=("max", F.col("_end")))
    return reached.where((F.col("_kind") == 1) & (F.col("_upto").isNull() | (F.col("_upto") < F.col(offset)))).select(*records.columns)


def minimum_merged(left: DataFrame, right: DataFrame, queue: list[str], offset: str, minimum: Column) -> DataFrame:
    """Union of two offset sets without what lies below the minimum."""
    return left.select(*queue, offset).unionByName(right.select(*queue, offset)).where(F.col(offset) >= minimum).distinct()


def nacked(df: DataFrame, status: str, policy: str) -> DataFrame:
    """What a receiver does with nacked records: ``emit`` fails, ``requeue`` returns them, ``discard`` drops them."""
    bad = df.where(F.col(status) == "nack")
    if policy == "emit":
        return bad.where(F.when(F.col(status) == "nack", F.raise_error(F.lit("record was nacked")).cast("boolean")).otherwise(F.lit(True)))
    if policy == "requeue":
        return bad.withColumn("redelivered", F.lit(True))
    if policy == "discard":
        return bad.limit(0)
    raise ValueError(policy)
