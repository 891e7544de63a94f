"""Row-wise operators. Functions are Column expressions, so Catalyst sees through them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.failure import FailureStrategy, emit, passing, route


def just(spark: SparkSession, rows: Iterable, schema: str) -> DataFrame:
    """Literal rows."""
    return spark.createDataFrame(list(rows), schema)


def map_rows(df: DataFrame, error: Column | None = None, strategy: FailureStrategy | None = None, **columns: Column) -> DataFrame:
    """1 to 1. A null result or an error takes the failure path of ``strategy``."""
    null = F.lit(None).cast("string")
    for name, c in columns.items():
        null = F.coalesce(null, F.when(c.isNull(), F.lit(f"null result: {name}")))
    routed = route(df, null if error is None else F.coalesce(error, null), strategy or emit())
    return routed.withColumns(columns)


def map_not_null(df: DataFrame, **columns: Column) -> DataFrame:
    """1 to 0 or 1. Rows with a null result are acknowledged and dropped."""
    out = df.withColumns(columns)
    for name in columns:
        out = out.where(F.col(name).isNotNull())
    return out


map_present = map_not_null


def keep(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(predicate)


def discarded(df: DataFrame, predicate: Column) -> DataFrame:
    """What ``keep`` drops, for a discard hook: false and null."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def of_type(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Rows whose value reads as ``kind``; the others are acknowledged and dropped."""
    return df.withColumn(column, F.col(column).try_cast(kind)).where(F.col(column).isNotNull())


def cast(df: DataFrame, column: str, kind: str, strategy: FailureStrategy | None = None) -> DataFrame:
    """A value that can't be cast is its row's failure, routed by ``strategy``; adds ``_error`` and ``_ack``."""
    got = F.col(column).try_cast(kind)
    error = F.when(F.col(column).isNotNull() & got.isNull(), F.concat(F.lit(f"no {kind}: "), F.col(column).cast("string")))
    return route(df, error, strategy or emit()).withColumn(column, got)


def consume(df: DataFrame, effect: Callable[[DataFrame], None]) -> DataFrame:
    """Runs a side effect over all rows and emits none."""
    effect(df)
    return df.limit(0)


def concat_map(df: DataFrame, items: Column, name: str, place: str = "_place") -> DataFrame:
    """1 to N in order; rows with an empty or null list give none and are acknowledged."""
    return df.select("*", F.posexplode(items).alias(place, name))


def flat_map(df: DataFrame, items: Column, name: str) -> DataFrame:
    """1 to N without an order."""
    return df.select("*", F.explode(items).alias(name))


def decorate(df: DataFrame, decorators: Iterable[tuple[int, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Applies (order, function) pairs, the smallest order first."""
    for _, f in sorted(decorators, key=lambda d: d[0]):
        df = df.transform(f)
    return df


def delay_until(df: DataFrame, trigger: Callable[[], None]) -> DataFrame:
    """Holds rows until a trigger returns; a bounded table is the same afterwards."""
    trigger()
    return df


def tap(df: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """Named metrics of the rows that pass; read them from the observation or the query's progress."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *[m.alias(n) for n, m in metrics.items()])


__all__ = ["cast", "concat_map", "consume", "decorate", "delay_until", "discarded", "flat_map", "just", "keep", "map_not_null", "map_present", "map_rows", "of_type", "passing", "tap"]
