"""Grouping: stable buckets, rails, topic partitions and groups that complete."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.hashing import string_bucket, with_number_bucket, with_uuid_bucket

GROUP = "_group"


def group_by(df: DataFrame, key: Column) -> DataFrame:
    return df.withColumn(GROUP, key)


def by_number_hash(df: DataFrame, number: Column, n: int) -> DataFrame:
    return with_number_bucket(df, GROUP, number, n)


def by_string_hash(df: DataFrame, text: Column, n: int) -> DataFrame:
    return group_by(df, string_bucket(text, n))


def by_uuid_hash(df: DataFrame, uuid: Column, n: int) -> DataFrame:
    return with_uuid_bucket(df, GROUP, uuid, n)


def by_topic_partition(df: DataFrame) -> DataFrame:
    return group_by(df, F.struct("topic", "partition"))


def by_round_robin(df: DataFrame, order: list[str], n: int, chunk: Column) -> DataFrame:
    """Row i in ``order`` goes to rail i mod n.

    ``chunk`` must never decrease along the order (a day, a range of ids). Rows are numbered
    inside a chunk, and chunks by the counts before them, so no task orders the whole table.
    """
    rows = df.withColumn("_chunk", chunk)
    before = rows.groupBy("_chunk").count().select(F.col("_chunk").alias("_c"), F.coalesce(F.sum("count").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_chunk").orderBy(*order)) - 1
    return rows.withColumn("_n", number).join(before, F.col("_chunk").eqNullSafe(F.col("_c"))).withColumn(GROUP, F.pmod(F.col("_n") + F.col("_before"), F.lit(n)).cast("int")).drop("_chunk", "_c", "_n", "_before")


def in_groups(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """Rows of a group in one partition, in order: what runs per group in parallel across groups."""
    spread = df.repartition(parts, GROUP) if parts else df.repartition(GROUP)
    return spread.sortWithinPartitions(GROUP, *order)


def inner(df: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A row-wise operator inside every group: the same expression, the group column kept."""
    out = f(df)
    if GROUP not in out.columns:
        raise ValueError("the operator lost the group")
    return out


def map_groups(df: DataFrame, f, schema: str) -> DataFrame:
    """An arbitrary pandas function per group. It holds a group in memory; prefer ``inner``."""
    return df.groupBy(GROUP).applyInPandas(f, schema)


def ungroup(df: DataFrame) -> DataFrame:
    return df.drop(GROUP)


def generations(df: DataFrame, keys: list[str], arrive: str, settle: str, order: list[str], completes: Column | None = None) -> DataFrame:
    """Groups that close when all their rows are settled; adds ``generation``, from 0, per key.

    A row opens a new group of its key if every earlier row was settled before it arrived, or
    if the row before it closed the group (``completes``).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    closed = F.lit(False) if completes is None else F.coalesce(F.lag(completes).over(w), F.lit(False))
    # open rows (null) settle never
    last = F.max(F.coalesce(F.col(settle), F.lit("9999-12-31").cast(df.schema[settle].dataType))).over(past)
    fresh = (last <= F.col(arrive)) | closed
    return df.withColumn("_fresh", F.coalesce(fresh, F.lit(False)).cast("int")).withColumn("generation", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")
