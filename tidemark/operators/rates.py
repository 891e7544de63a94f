"""Throughput limits that change while data flow: token buckets whose rates come from a table.

A bucket of a key holds ``count`` tokens and refills evenly over ``duration``; a rate holds from its time to the next
rate's. A new rate inherits tokens in proportion, a zero rate holds rows until a later one (or for good), a null count is no
limit and leaves the bucket full. Rows leave in order; one that weighs more than the bucket waits for a full one and
leaves a debt.

Under one rate, release time r and the time z at which the bucket would have been empty go through a row (arrival a, weight
w, E = duration / count) as r' = max(a, r, z + min(w, count) E), z' = max(z, r' - duration) + w E. Such maps are closed under
composition: for a whole piece of rows r' = max(A, r + B, z + C), and likewise z'. So rows are cut in pieces, each piece
is composed for every rate that can apply to it, and the pieces of a key are applied one after another. A piece in which the
rate changes is the exception: its rows, which go along in packed form, are then scanned up to the change and from there on; there are no more
such pieces than rates. With each piece's state known, release times are filled in for all pieces at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.operators.scans import running
from tidemark.session import materialise, ship

#: Rows of a key that are scanned at once.
PIECE = 100_000
INF = float("inf")


@dataclass(frozen=True)
class Rates:
    """A key's rates in the order of their times; the first holds from ever."""

    start: tuple[float, ...]
    count: tuple[float | None, ...]
    duration: tuple[float, ...]

    @classmethod
    def of(cls, rows: list) -> Rates:
        """From (time, count, duration) rows; none is no limit."""
        rows = sorted(rows, key=lambda r: r[0]) or [(0.0, None, 1.0)]
        return cls(tuple(r[0] for r in rows), tuple(r[1] for r in rows), tuple(r[2] for r in rows))

    def end(self, k: int) -> float:
        return self.start[k + 1] if k + 1 < len(self.start) else INF

    def change(self, k: int, z: float) -> float:
        """z under rate k + 1, from its first moment."""
        count, at = self.count[k], self.start[k + 1]
        if count is None or z == -INF or self.count[k + 1] is None:
            return -INF  # unused, so full
        if count == 0:
            return at
        return at - min(1.0, (at - z) / self.duration[k]) * self.duration[k + 1]


def under_one_rate(a: np.ndarray, w: np.ndarray, count: float | None, duration: float, r: float, z: float) -> tuple[np.ndarray, np.ndarray]:
    """Release times, and z after each row, of rows under one rate that isn't zero."""
    a = np.maximum(a, r)
    if count is None:
        return np.maximum.accumulate(a), np.full(len(a), -INF)
    each = duration / count
    total = np.cumsum(w) * each
    before = np.concatenate([[0.0], total[:-1]])
    base = np.maximum(z, np.maximum.accumulate(a - duration - before))
    z_after = total + base
    z_before = before + np.concatenate([[z], base[:-1]])
    return np.maximum.accumulate(np.maximum(a, z_before + np.minimum(w, count) * each)), z_after


def through(rates: Rates, a: np.ndarray, w: np.ndarray, state: tuple[int, float, float]) -> tuple[np.ndarray, tuple[int, float, float]]:
    """Release times of rows from ``state`` (rate, r, z) on, and the state after them."""
    k, r, z = state
    out = np.full(len(a), INF)
    i = 0
    while i < len(a):
        left, n = 0 if rates.count[k] == 0 else len(a) - i, 0
        if left:
            release, after = under_one_rate(a[i:], w[i:], rates.count[k], rates.duration[k], r, z)
            n = int(np.searchsorted(release, rates.end(k)))  # release times never fall
            out[i : i + n] = release[:n]
            if n:
                r, z = float(release[n - 1]), float(after[n - 1])
        i += n
        if i < len(a):
            if rates.end(k) == INF:
                return out, (k, INF, z)
            z, k, r = rates.change(k, z), k + 1, rates.end(k)
    return out, (k, r, z)


def composed(a: np.ndarray, w: np.ndarray, count: float | None, duration: float) -> tuple[float, ...]:
    """(A, B, C) of r' and of z' for all rows under one rate."""
    nothing = np.full(len(a), -INF)
    runs = [under_one_rate(x, w, count, duration, r, z) for x, r, z in ((a, -INF, -INF), (nothing, 0.0, -INF), (nothing, -INF, 0.0))]
    return tuple(float(x[k][-1]) for k in (0, 1) for x in runs)


def apply(m: tuple[float, ...], r: float, z: float) -> tuple[float, float]:
    return max(m[0], r + m[1], z + m[2]), max(m[3], r + m[4], z + m[5])


_PIECE = pa.schema([("_k", pa.string()), ("_p", pa.int64()), ("a", pa.binary()), ("w", pa.binary())])
_PIECE_DDL = "_k string, _p long, a binary, w binary"
_MAPPED_DDL = _PIECE_DDL + ", rates array<struct<f:double,c:double,d:double>>, maps array<double>"
_STATE_DDL = "_k string, _p long, _rate long, _r double, _z double, _rates array<struct<f:double,c:double,d:double>>"


def _groups(batches, value) -> Iterator[tuple[tuple, list]]:
    """((_k, _p), slices) of sorted rows whose first two columns are these; a slice is ``value(batch, a, e)``."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        k, p = b.column(0).to_pylist(), b.column(1).to_pylist()
        edges = [0, *(i for i in range(1, len(k)) if p[i] != p[i - 1] or k[i] != k[i - 1]), len(k)]
        for s, e in zip(edges, edges[1:], strict=False):
            if key is not None and (k[s], p[s]) != key:
                yield key, held
                held = []
            key = (k[s], p[s])
            held.append(value(b, s, e))
    if held:
        yield key, held


def _rates(value) -> Rates:
    return Rates.of([(x["f"], x["c"], x["d"]) for x in value or []])


def _pack(batches) -> Iterator[pa.RecordBatch]:
    columns = lambda b, s, e: tuple(b.column(c).to_numpy(zero_copy_only=False)[s:e] for c in (2, 3))
    for (k, p), parts in _groups(batches, columns):
        a, w = (np.concatenate(x).astype("<f8").tobytes() for x in zip(*parts, strict=True))
        yield pa.RecordBatch.from_pydict({"_k": [k], "_p": [p], "a": [a], "w": [w]}, schema=_PIECE)


def _compose(batches) -> Iterator[pa.RecordBatch]:
    """Adds the piece's map under each different rate from the one at its last arrival on, in the order of the rates."""
    for b in batches:
        maps = []
        for row in b.to_pylist():
            rates, a, w = _rates(row["rates"]), np.frombuffer(row["a"]), np.frombuffer(row["w"])
            first = max(0, int(np.searchsorted(rates.start, a.max(), side="right")) - 1)
            known: dict = {}
            out = []
            for k in range(len(rates.start)):
                rate = rates.count[k], rates.duration[k]
                if k < first or rate[0] == 0:
                    out += [np.nan] * 6
                    continue
                if rate not in known:
                    known[rate] = composed(a, w, *rate)
                out += known[rate]
            maps.append(out)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(maps, pa.list_(pa.float64()))], names=[*b.schema.names, "maps"])


def _apply_in_turn(batches) -> Iterator[pa.RecordBatch]:
    """The state before each piece."""
    key, state = None, None
    for b in batches:
        rows = b.to_pylist()
        states = []
        for row in rows:
            if row["_k"] != key:
                key, state = row["_k"], (0, -INF, -INF)
            states.append(state)
            rates, (k, r, z) = _rates(row["rates"]), state
            m = row["maps"][6 * k : 6 * k + 6]
            after = apply(m, r, z) if m[0] == m[0] else (INF, z)
            if after[0] < rates.end(k):
                state = (k, *after)
            elif r < INF:
                _, state = through(rates, np.frombuffer(row["a"]), np.frombuffer(row["w"]), state)
        yield pa.RecordBatch.from_arrays(
            [b.column("_k"), b.column("_p"), *(pa.array([s[i] for s in states], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.float64()))), b.column("rates")],
            names=["_k", "_p", "_rate", "_r", "_z", "_rates"],
        )


def release_under_rates(df: DataFrame, keys: list[str], order: list[str], arrival_s: Column, rates: DataFrame, weight: Column | None = None, chunk: Column | None = None, piece: int = PIECE) -> DataFrame:
    """Adds ``release_s``, when each row leaves its key's bucket; null for those that never do.

    ``rates``: the ``keys``, ``from_s``, ``count`` (null: no limit) and ``duration_s``. A key without rates isn't limited. Arrivals
    aren't null. ``chunk`` never decreases along the order; rows are numbered in its parts.
    """
    ship(df.sparkSession)
    own = df.columns
    named = F.to_json(F.struct(*keys)) if keys else F.lit("")
    rows = df.withColumn("_k", named).withColumn("_a", arrival_s.cast("double")).withColumn("_w", F.lit(1.0) if weight is None else weight.cast("double"))
    numbered = running(rows, ["_k"], order, chunk, _g=("sum", F.lit(1)))
    placed = materialise(numbered.withColumn("_g", F.col("_g") - 1).withColumn("_p", F.floor((F.col("_g")) / piece)), "numbered")
    lists = rates.groupBy(named.alias("_k")).agg(F.collect_list(F.struct(F.col("from_s").cast("double").alias("f"), F.col("count").cast("double").alias("c"), F.col("duration_s").cast("double").alias("d"))).alias("rates"))

    dealt = placed.repartition("_k", "_p").sortWithinPartitions("_k", "_p", "_g")
    packed = dealt.select("_k", "_p", "_a", "_w").mapInArrow(_pack, _PIECE_DDL)
    mapped = packed.join(lists, "_k", "left").mapInArrow(_compose, _MAPPED_DDL)
    states = mapped.repartition("_k").sortWithinPartitions("_k", "_p").mapInArrow(_apply_in_turn, _STATE_DDL)

    # a piece's state goes before its rows
    head = states.select("_k", "_p", *[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields], F.lit(-1).cast("long").alias("_g"), F.lit(0.0).alias("_a"), F.lit(0.0).alias("_w"), F.struct("_rate", "_r", "_z", "_rates").alias("_s"))
    kind = head.schema["_s"].dataType
    tail = placed.select("_k", "_p", *own, "_g", "_a", "_w", F.lit(None).cast(kind).alias("_s"))
    together = head.unionAll(tail).repartition("_k", "_p").sortWithinPartitions("_k", "_p", "_g")
    n = len(own)

    def fill(batches):
        state = rates = None
        for b in batches:
            g = b.column(n + 2).to_numpy(zero_copy_only=False)
            a, w = b.column(n + 3).to_numpy(zero_copy_only=False), b.column(n + 4).to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(g < 0)
            if len(heads) == 0 or heads[0]:
                heads = np.concatenate([[-1], heads])
            release = np.full(len(g), INF)
            for s, e in zip(heads, [*heads[1:], len(g)], strict=True):
                if s >= 0:
                    at = b.column(n + 5)[int(s)].as_py()
                    state, rates = (at["_rate"], at["_r"], at["_z"]), _rates(at["_rates"])
                if s + 1 < e and state[1] < INF:
                    release[s + 1 : e], state = through(rates, a[s + 1 : e], w[s + 1 : e], state)
            rows = g >= 0
            kept = b.filter(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*kept.columns[2 : n + 2], pa.array(release[rows], mask=np.isinf(release[rows]))], names=[*own, "release_s"])

    return together.mapInArrow(fill, StructType([*df.schema.fields, StructField("release_s", DoubleType())]))
