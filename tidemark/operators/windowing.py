"""Windows anchored at their first row: batching and deduplication.

A window of a key opens with a row and takes the rows that follow until it is full or
``timeout`` has passed since that row, the boundary excluded. Spark's ``window`` is anchored
at the epoch and ``session_window`` slides, so neither does this. Rows are dealt by key and
sorted; each partition is folded in one pass that holds a batch, whatever a key's size, and takes a
step for each window, not for each row. A hot key is folded in pieces at once, whose first windows are found
by composing what each piece does. The record's timestamp is the clock.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from tidemark.operators.scans import running
from tidemark.session import materialise, ship

NO, NTH = "window_no", "nth"
#: Rows of a hot key that are folded at once.
PIECE = 100_000


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def anchored(df: DataFrame, keys: list[str], time: str, order: list[str], timeout_s: float, max_size: int, chunk: Column | None = None, piece: int = PIECE) -> DataFrame:
    """``df`` with window_no (per key, from 0), nth (place in the window, from 1).

    Without ``chunk`` a key is one task's. ``chunk`` never decreases along the order (a day, a range of ids); with it a
    key of any size is scanned in pieces of ``piece`` rows, see ``_entries``.
    """
    if max_size < 1:
        raise ValueError("a window holds one row at least")
    ship(df.sparkSession)
    own = df.columns
    limit = int(timeout_s * 1_000_000)
    rows = df.withColumn("_k", F.to_json(F.struct(*keys)) if keys else F.lit("")).withColumn("_t", micros(F.col(time)))
    if chunk is None:
        dealt = rows.repartition("_k").sortWithinPartitions("_k", *order).select(*own, "_k", "_t")
    else:
        size = max(piece, 4 * max_size)
        numbered = running(rows, ["_k"], order, chunk, _g=("sum", F.lit(1))).withColumn("_g", F.col("_g") - 1)
        placed = materialise(numbered.withColumn("_p", F.floor(F.col("_g") / size)), "numbered")
        joined = placed.join(_entries(placed, limit, max_size, size), ["_k", "_p"])
        dealt = joined.withColumn("_k", F.concat_ws("#", "_p", "_k")).repartition("_k").sortWithinPartitions("_k", "_g").select(*own, "_k", "_t", "_start", "_no", "_nth")
    out = StructType([*df.schema.fields, StructField(NO, LongType()), StructField(NTH, LongType())])
    return dealt.mapInArrow(_fold(own, limit, max_size, chunk is not None), out)


def _fold(own: list[str], limit: int, max_size: int, entered: bool):
    """Numbers sorted rows by windows. ``entered``: a piece begins in the window that its columns tell."""
    n = len(own)

    def fold(batches):
        key, start, no, nth = None, 0, -1, 0  # the open window: its key, first time, number and rows so far
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            codes = b.column(n).dictionary_encode()
            code = codes.indices.to_numpy(zero_copy_only=False)
            names = codes.dictionary.to_pylist()
            times = b.column(n + 1).to_numpy(zero_copy_only=False)
            nos, nths = np.empty(m, np.int64), np.empty(m, np.int64)
            edges = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), m]
            for a, e in zip(edges, edges[1:], strict=False):
                if names[code[a]] != key:
                    key, no, nth = names[code[a]], -1, max_size
                    if entered:
                        start, no, nth = (b.column(n + 2 + k)[a].as_py() for k in range(3))
                t = times[a:e]
                top = np.maximum.accumulate(t)
                i = 0
                while i < e - a:
                    if nth >= max_size or t[i] - start >= limit:
                        start, no, nth = int(t[i]), no + 1, 0
                    # up to the first row out of time; rows may be out of order, then none before may be late
                    late = int(np.searchsorted(top, start + limit)) if i == 0 or top[i - 1] < start + limit else i + int(np.argmax(np.append(t[i:] - start >= limit, True)))
                    j = min(e - a, late, i + max_size - nth)
                    nos[a + i : a + j] = no
                    nths[a + i : a + j] = np.arange(nth + 1, nth + 1 + j - i)
                    nth += j - i
                    i = j
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(nos), pa.array(nths)], names=[*own, NO, NTH])

    return fold


def successors(t: np.ndarray, limit: int, max_size: int) -> np.ndarray:
    """For each row the row that opens the next window if a window opens here; the length if none does."""
    at = np.arange(len(t))
    top = np.maximum.accumulate(t)
    late = np.searchsorted(top, t + limit)
    for i in np.flatnonzero(late <= at):  # a row before is that late already: look at those behind
        found = np.flatnonzero(t[i + 1 : i + max_size] - t[i] >= limit)
        late[i] = i + 1 + found[0] if len(found) else len(t)
    return np.minimum(np.minimum(late, at + max_size), len(t))


def piece_map(t: np.ndarray, n: int, limit: int, max_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a piece of n rows does with a window that opens at one of its first ``max_size`` rows.

    ``t``: times of its rows and of the ``max_size`` behind them. Successors are followed by pointer jumping. For each
    entry: the row behind the piece that opens the next window, the windows that open inside, and the last one's row.
    """
    after = successors(t, limit, max_size)[:n]
    jump = np.append(np.minimum(after, n), n)
    opened = np.append(np.ones(n, np.int64), 0)
    last = np.arange(n + 1)
    while (jump[:n] < n).any():
        last = np.where(jump < n, last[jump], last)
        opened = opened + opened[jump]
        jump = jump[jump]
    last, opened = last[: min(n, max_size)], opened[: min(n, max_size)]
    return after[last] - n, opened, last


_MAP = "_k string, _p long, n long, to binary, opened binary, last_time binary, last binary"
_ENTRY = "_k string, _p long, _start long, _no long, _nth long"


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _entries(placed: DataFrame, limit: int, max_size: int, size: int) -> DataFrame:
    """The open window at the begin of each piece (_k, _p) of ``size`` rows: its first time, number and rows so far.

    A window that opens in a piece closes within ``max_size`` rows, so what a piece does is a table of ``max_size`` entries,
    made from its rows and the first of the next piece. The tables of a key's pieces are then applied one after
    another: a look-up for each piece, however many rows it has.
    """
    times = placed.select("_k", "_p", "_g", "_t", F.lit(0).alias("_next"))
    heads = times.where((F.col("_p") > 0) & (F.col("_g") % size < max_size)).withColumn("_p", F.col("_p") - 1).withColumn("_next", F.lit(1))
    dealt = times.unionAll(heads).repartition("_k", "_p").sortWithinPartitions("_k", "_p", "_g").select("_k", "_p", "_t", "_next")
    pack = lambda a: a.astype("<i8").tobytes()

    def tables(batches):
        key, held = None, []
        schema = _arrow_schema(_MAP)

        def row():
            t = np.concatenate([x[0] for x in held])
            n = len(t) - int(sum(x[1].sum() for x in held))
            to, opened, last = piece_map(t, n, limit, max_size)
            values = (*key, n, pack(to), pack(opened), pack(t[last]), pack(last))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            k, p = b.column(0).to_pylist(), b.column(1).to_pylist()
            t, nxt = (b.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            edges = [0, *(i for i in range(1, len(k)) if p[i] != p[i - 1] or k[i] != k[i - 1]), len(k)]
            for a, e in zip(edges, edges[1:], strict=False):
                if key is not None and (k[a], p[a]) != key:
                    yield row()
                    held = []
                key = (k[a], p[a])
                held.append((t[a:e], nxt[a:e]))
        if held:
            yield row()

    def scan(batches):
        schema = _arrow_schema(_ENTRY)
        key, at, start, no, first = None, 0, 0, -1, 0
        for b in batches:
            rows = []
            for k, p, n, *packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    key, at, start, no, first = k, 0, 0, -1, p * size - max_size  # a full window, so the first row opens one
                rows.append((k, p, start, no, p * size - first))
                if at < n:
                    to, opened, time, last = (int(np.frombuffer(x, "<i8")[at]) for x in packed)
                    at, start, no, first = to, time, no + opened, p * size + last
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)

    maps = dealt.mapInArrow(tables, _MAP)
    return maps.repartition("_k").sortWithinPartitions("_k", "_p").mapInArrow(scan, _ENTRY)


def sized(df: DataFrame, keys: list[str], order: list[str], max_size: int) -> DataFrame:
    """Windows bounded by size alone; no fold is needed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    n = F.row_number().over(w) - 1
    return df.withColumn("_n", n).withColumn(NO, F.floor(F.col("_n") / max_size)).withColumn(NTH, F.pmod("_n", F.lit(max_size)).cast("long") + 1).drop("_n")


def closing(time: str, timeout_s: float, max_size: int) -> Column:
    """When a window emits: with its last row if that filled it, else ``timeout`` after its first."""
    first, last = F.min(time), F.max(time)
    return F.when(F.count(F.lit(1)) >= max_size, last).otherwise(first + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(timeout_s)))


def batches(df: DataFrame, keys: list[str], time: str, order: list[str], timeout_s: float, max_size: int, value: Column, chunk: Column | None = None, piece: int = PIECE) -> DataFrame:
    """Size-or-time batches: per window its values in order, size and closing time."""
    found = anchored(df, keys, time, order, timeout_s, max_size, chunk, piece)
    return found.groupBy(*keys, NO).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(NTH), value.alias("v")))), lambda x: x["v"]).alias("items"), F.count(F.lit(1)).alias("n"), F.min(time).alias("opened"), closing(time, timeout_s, max_size).alias("closed"))


def sender_batches(df: DataFrame, keys: list[str], time: str, order: list[str], max_size: int, duration_s: float) -> DataFrame:
    """Sender batches by size or time; for sizes up to one every row is one, and no duration is looked at."""
    if max_size <= 1:
        return sized(df, keys, order, 1)
    if duration_s <= 0:
        raise ValueError("a batch's duration must be positive")
    return anchored(df, keys, time, order, duration_s, max_size)


def batch_members(df: DataFrame, max_size: int, keys: list[str], order: list[str]) -> DataFrame:
    """Sender batches: singletons for sizes up to one, else by size."""
    return sized(df, keys, order, max(1, max_size))


@dataclass(frozen=True)
class Reducer:
    """How a window becomes one row: expressions over its rows."""

    name: str

    def of(self, value: str) -> Column:
        c = F.col(value)
        if self.name == "first":
            return F.min_by(c, F.col(NTH))
        if self.name == "last":
            return F.max_by(c, F.col(NTH))
        if self.name == "sum":
            return F.sum(c)
        if self.name == "max":
            return F.max(c)
        if self.name == "min":
            return F.min(c)
        raise ValueError(self.name)


FIRST, LAST, SUM = Reducer("first"), Reducer("last"), Reducer("sum")


def composed(value: str, reduce, start: Column) -> Column:
    """Any binary reduction, applied left to right over a window's values."""
    values = F.transform(F.sort_array(F.collect_list(F.struct(F.col(NTH), F.col(value).alias("v")))), lambda x: x["v"])
    return F.aggregate(values, start, reduce)


def deduplicate(df: DataFrame, keys: list[str], time: str, order: list[str], timeout_s: float, max_size: int, values: list[str], reducer: Reducer = FIRST, chunk: Column | None = None, piece: int = PIECE) -> DataFrame:
    """One reduced row for each window, at its close. A timeout of zero or less leaves every row as it is."""
    if timeout_s <= 0:
        return df.select(*keys, F.lit(0).cast("long").alias(NO), *values, F.lit(1).cast("long").alias("n"), F.col(time).alias("opened"), F.col(time).alias("closed"))
    found = anchored(df, keys, time, order, timeout_s, max_size, chunk, piece)
    return found.groupBy(*keys, NO).agg(*[reducer.of(v).alias(v) for v in values], F.count(F.lit(1)).alias("n"), F.min(time).alias("opened"), closing(time, timeout_s, max_size).alias("closed"))


def commit_windows(df: DataFrame, consumer: list[str], time: str, order: list[str], partition: list[str], offset: str, max_size: int, period_s: float, chunk: Column | None = None, piece: int = PIECE) -> DataFrame:
    """Positions by a consumer's commit windows of size or time; of each partition the last acknowledgement counts."""
    found = anchored(df, consumer, time, order, period_s, max_size, chunk, piece)
    return found.groupBy(*consumer, NO, *partition).agg((F.max_by(offset, NTH) + 1).alias("position"), closing(time, period_s, max_size).alias("_closed")).drop("_closed")


def commits(df: DataFrame, group: list[str], window_no: str, offset: str) -> DataFrame:
    """Of each commit window the last offset of each partition, plus one: the next to read."""
    return df.groupBy(*group, window_no).agg((F.max(offset) + 1).alias("position"))


def inactivity(df: DataFrame, keys: list[str], time: str, order: list[str], max_gap_s: float) -> DataFrame:
    """Rows that came more than ``max_gap_s`` after the one before them, with the gap in seconds."""
    gap = (micros(F.col(time)) - F.lag(micros(F.col(time))).over(Window.partitionBy(*keys).orderBy(*order))) / 1e6
    return df.withColumn("gap_s", gap).where(F.col("gap_s") > max_gap_s)
