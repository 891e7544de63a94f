"""Running aggregates and neighbours along an order, without a task for each queue.

``chunk`` never decreases along the order. Rows are scanned inside a chunk; what a chunk leaves to the
next ones is one row for each chunk, scanned in turn and joined back. So a queue of any
length is many tasks, and only its chunks' totals are one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Offsets that are scanned together.
CHUNK = 100_000
_CHUNK = "_chunk"


def by_offset(offset: str, size: int = CHUNK) -> Column:
    return F.floor(F.col(offset) / size)


def _join(work: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    on = F.col(_CHUNK).eqNullSafe(F.col("_of"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return work.join(carried, on).drop(_CHUNK, "_of", *[f"_of_{k}" for k in keys])


def _named(keys: list[str]) -> list[Column]:
    return [F.col(_CHUNK).alias("_of"), *[F.col(k).alias(f"_of_{k}") for k in keys]]


_KINDS: dict[str, tuple[Callable, Callable]] = {
    "max": (F.max, F.greatest),
    "sum": (F.sum, lambda before, own: F.coalesce(before + own, own, before)),
}


def running(df: DataFrame, keys: list[str], order: list, chunk: Column | None, **columns: tuple[str, Column]) -> DataFrame:
    """Adds each of ``columns``, (``max`` or ``sum``, expression), over the rows up to and with each row. No chunk: one scan."""
    span = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if chunk is None:
        return df.withColumns({n: _KINDS[kind][0](c).over(span) for n, (kind, c) in columns.items()})
    work = df.withColumn(_CHUNK, chunk)
    inner = Window.partitionBy(*keys, _CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    totals = work.groupBy(*keys, _CHUNK).agg(*[_KINDS[kind][0](c).alias(f"_t_{n}") for n, (kind, c) in columns.items()])
    carried = totals.select(*_named(keys), *[_KINDS[kind][0](f"_t_{n}").over(before).alias(f"_b_{n}") for n, (kind, _) in columns.items()])
    scanned = work.withColumns({n: _KINDS[kind][0](c).over(inner) for n, (kind, c) in columns.items()})
    joined = _join(scanned, carried, keys)
    return joined.withColumns({n: _KINDS[kind][1](F.col(f"_b_{n}"), F.col(n)) for n, (kind, _) in columns.items()}).drop(*[f"_b_{n}" for n in columns])


def last_known(df: DataFrame, keys: list[str], order: list[str], chunk: Column | None, name: str, value: Column) -> DataFrame:
    """Adds the last value that isn't null up to and with each row."""
    at = F.when(value.isNotNull(), F.struct(*[F.col(o) for o in order], value.alias("_v")))
    return running(df, keys, order, chunk, **{name: ("max", at)}).withColumn(name, F.col(name)["_v"])


def neighbour(df: DataFrame, keys: list[str], order: list[str], chunk: Column | None, step: int, **columns: Column) -> DataFrame:
    """Adds each of ``columns`` as the next row (``step`` 1) or the one before (-1) has it; null at the end."""
    move = F.lead if step > 0 else F.lag
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({n: move(c).over(w) for n, c in columns.items()})
    work = df.withColumn(_CHUNK, chunk)
    inner = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    place = F.struct(*order)
    edge = (F.min_by if step > 0 else F.max_by)(F.struct(*[c.alias(n) for n, c in columns.items()]), place)
    edges = work.groupBy(*keys, _CHUNK).agg(edge.alias("_e"))
    carried = edges.select(*_named(keys), move("_e").over(Window.partitionBy(*keys).orderBy(_CHUNK)).alias("_e"))
    moved = work.withColumns({n: move(F.struct(c.alias("v"))).over(inner) for n, c in columns.items()})
    joined = _join(moved, carried, keys)
    return joined.withColumns({n: F.when(F.col(n).isNotNull(), F.col(n)["v"]).otherwise(F.col("_e")[n]) for n in columns}).drop("_e")
