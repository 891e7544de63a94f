"""Operator 12: nearest neighbours by inner product, with multi-probe p-stable hashing.

Hashing. Vectors are scaled by the largest norm and get one component more that makes all norms
one, so the largest inner product with a query of norm one is the smallest distance. Each of ``TABLES`` tables has K Gaussian
(2-stable) projections cut into slots of width W; a vector's slots are its bucket.

Probing. A neighbour at distance r differs from the query by r times a normal value in every projection, which
gives each bucket beside the query's own a chance to hold it. The buckets of all tables are visited in descending
chance until the chance that no table has it is below 1 - ``TARGET``. K, W and r are fitted on ``FIT_QUERIES`` queries, whose
neighbours are found exactly, and ``FIT_ROWS`` rows: the cheapest setting by rows compared and buckets visited.

Buckets are compared as blocks of matrices in numpy, and only a block's best leave it. The first ``TABLES`` buckets
of a query go first, which gives it a score that its last result has at least, and of the others only what
reaches it leaves a block. Candidates of all tables are merged by id and ranked by the inner product in double precision on the original vectors. No bucket is cut
short: one with many rows or many visits is dealt over a grid of blocks of rows and visits. Queries that
``PROBES`` buckets a table don't bring to the target, or that found fewer than they must return, are compared with every row.

Equal vectors are one class with its ``top`` + 1 smallest ids, which is all that any result needs, so copies cost nothing
in buckets; a class with many queries is searched once.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another
length than the most common one (the longest such) or without an id; rows of one vec_id stand for one vector, the least; ties go to
the smaller vec_id; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import arrow_map, only
from tidemark.session import materialise

TABLES = 8
#: Chance that a neighbour is met, by which visits end.
TARGET = 0.95
#: Buckets that are considered in a table.
PROBES = 256
#: Rows and queries on which the index is fitted.
FIT_ROWS, FIT_QUERIES = 2000, 64
#: Projections and widths (of the neighbours' distance) that are tried.
PROJECTIONS, WIDTHS = (1, 2, 3, 4, 6, 8, 10, 12, 16, 20), (1.5, 2.0, 3.0)
#: Rows that cost as much to compare as a bucket to visit.
VISIT = 100
#: Times all rows that a query counts which no setting's visits suffice for.
SHORT = 10 * TABLES
#: Rows of a block of a bucket.
BLOCK = 8192
#: Rows of results that a task gathers before it merges them.
GATHER = 200_000

_GRID = np.linspace(-9, 9, 7201)
_NORMAL = np.concatenate([[0], np.cumsum(np.exp(-((_GRID[1:] + _GRID[:-1]) ** 2) / 8))])
_NORMAL /= _NORMAL[-1]
#: Slots beside the query's own that are considered in a projection.
_STEPS = np.arange(-2, 3)


def below(x: np.ndarray) -> np.ndarray:
    """Chance that a standard normal value is below x."""
    return np.interp(x, _GRID, _NORMAL)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Hashing:
    """Projections of all tables; ``r`` is a neighbour's distance, in units of the largest norm."""

    a: np.ndarray  # (dimensions + 1, tables, projections)
    shift: np.ndarray
    mix: np.ndarray
    width: float
    r: float
    largest: float

    @classmethod
    def draw(cls, dims: int, projections: int, width: float, r: float, largest: float) -> Hashing:
        rng = np.random.default_rng(projections)
        return cls(
            rng.normal(size=(dims + 1, TABLES, projections)), rng.uniform(0, width, (TABLES, projections)),
            rng.integers(1 << 62, size=(TABLES, projections)) | 1, width, r, largest,
        )

    def _slots(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (np.tensordot(x, self.a[: x.shape[1]], 1) + self.shift) / self.width
        slot = np.floor(at)
        return slot.astype(np.int64), at - slot

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each row in each table."""
        x = x / self.largest
        more = np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))
        return (self._slots(np.hstack([x, more[:, None]]))[0] * self.mix).sum(2)

    def visits(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """For each query: tables and buckets in descending chance, and whether they suffice."""
        slots, within = self._slots(unit(q))
        probes = PROBES
        edges = np.append(_STEPS, _STEPS[-1] + 1)
        chance = np.diff(below((edges - within[..., None]) * (self.width / self.r)), axis=-1)
        chance = np.log(np.maximum(chance, 1e-30))  # (queries, tables, projections, steps)
        best, cell = np.zeros((*slots.shape[:2], 1)), np.zeros((*slots.shape[:2], 1), np.int64)
        for k in range(slots.shape[2]):  # the best sums of more projections extend the best of fewer
            to = (slots[:, :, k, None] + _STEPS) * self.mix[:, k, None]
            best = (best[..., None] + chance[:, :, k, None, :]).reshape(*best.shape[:2], -1)
            cell = (cell[..., None] + to[:, :, None, :]).reshape(best.shape)
            if best.shape[2] > probes:
                order = np.argpartition(-best, probes - 1, axis=2)[:, :, :probes]
                best, cell = np.take_along_axis(best, order, 2), np.take_along_axis(cell, order, 2)
        table = np.repeat(np.arange(TABLES), best.shape[2])
        for chances, cells in zip(np.exp(best).reshape(len(q), -1), cell.reshape(len(q), -1), strict=True):
            order = np.argsort(-chances, kind="stable")
            each = np.zeros((len(order), TABLES))
            each[np.arange(len(order)), table[order]] = chances[order]
            missed = np.prod(1 - np.minimum(np.cumsum(each, axis=0), 1), axis=1)
            enough = missed <= 1 - TARGET
            n = int(enough.argmax()) + 1 if enough.any() else len(order)
            yield table[order[:n]], cells[order[:n]], bool(enough.any())


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


# ------------------------------------------------------------------ rows


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v): the rows that take part."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = only(table, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & fine)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("v") == (length[0].n if length else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def classes(rows: DataFrame, top: int) -> DataFrame:
    """(cid, v, ids): different vectors with their ``top`` + 1 smallest ids, the smallest being cid."""
    least = rows.withColumn("_k", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_k") <= top + 1)
    return least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("cid"), "v", "ids")


_FOUND = pa.schema([("q", pa.int64()), ("c", pa.int64()), ("score", pa.float64())])
_FOUND_DDL = "q long, c long, score double"


def _best_of(q: np.ndarray, qv: np.ndarray, least: np.ndarray, c: np.ndarray, cv: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``top`` rows of a block for each query that reach its ``least``, by the inner product of the vectors as they are."""
    near = qv @ cv.T
    keep = min(len(c), top + 8)  # more than needed, as a matrix product rounds in another order
    at = np.argpartition(-near, keep - 1, axis=1)[:, :keep] if keep < len(c) else np.broadcast_to(np.arange(len(c)), near.shape)
    score = np.concatenate([np.einsum("ijk,ik->ij", cv[at[k : k + 512]], qv[k : k + 512]) for k in range(0, len(q), 512)])
    order = np.lexsort((c[at], -score))[:, :top]
    at, score = np.take_along_axis(at, order, 1), np.take_along_axis(score, order, 1)
    good = score >= least[:, None]
    return np.repeat(q, good.sum(1)), c[at][good], score[good]


def _merged(q: np.ndarray, c: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's ``top`` of what was found for it, each row once."""
    order = np.lexsort((-score, c, q))
    q, c, score = q[order], c[order], score[order]
    if not len(q):
        return q, c, score
    first = np.concatenate([[True], (q[1:] != q[:-1]) | (c[1:] != c[:-1])])
    q, c, score = q[first], c[first], score[first]
    order = np.lexsort((c, -score, q))
    q, c, score = q[order], c[order], score[order]
    starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    keep = np.arange(len(q)) - np.repeat(starts, np.diff([*starts, len(q)])) < top
    return q[keep], c[keep], score[keep]


def _compare(top: int):
    """Blocks, sorted by key and kind (rows before queries): each query's best of its blocks in this task."""

    def run(batches):
        out: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(*(np.concatenate(x) for x in zip(*out, strict=True)), top)], schema=_FOUND)
            out.clear()
            size = 0

        key, rows, ids = None, [], []
        for b in batches:
            keys = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(5)], axis=1)  # table, cell, i, j, kind
            who, v, least = b.column(5).to_numpy(), matrix(b.column(6)), b.column(7).to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e == s:
                    continue
                if key is None or (keys[s, :4] != key).any():
                    key, rows, ids = keys[s, :4], [], []
                if keys[s, 4] == 0:
                    rows.append(v[s:e])
                    ids.append(who[s:e])
                elif rows:
                    if len(rows) > 1:
                        rows, ids = [np.concatenate(rows)], [np.concatenate(ids)]
                    out.append(_best_of(who[s:e], v[s:e], least[s:e], ids[0], rows[0], top))
                    size += len(out[-1][0])
                    if size > GATHER:
                        yield from flush()
        yield from flush()

    return run


def _blocks(rows: DataFrame, visits: DataFrame, top: int, partitions: int, block: int) -> DataFrame:
    """(q, c, score) of rows (table, cell, cid, v) and visits (table, cell, cid, v, least) of the same buckets, in blocks of both."""
    of = ["table", "cell"]
    n_rows = rows.groupBy(*of).agg(F.ceil(F.count("*") / block).alias("nr"))
    n_visits = visits.groupBy(*of).agg(F.ceil(F.count("*") / block).alias("nv"))
    large = materialise(n_rows.join(n_visits, of).where((F.col("nr") > 1) | (F.col("nv") > 1)), "large")
    one, mine = F.lit(1).cast("long"), F.xxhash64("cid")

    def dealt(df: DataFrame, kind: int) -> DataFrame:
        nr, nv = F.coalesce("nr", one), F.coalesce("nv", one)
        i = F.pmod(mine, nr) if kind == 0 else F.explode(F.sequence(F.lit(0).cast("long"), nr - 1))
        both = df.join(large, of, "left").withColumn("i", i)
        j = F.pmod(mine, nv) if kind == 1 else F.explode(F.sequence(F.lit(0).cast("long"), nv - 1))
        return both.withColumn("j", j).select(F.col("table").cast("long").alias("table"), "cell", "i", "j", F.lit(kind).cast("long").alias("kind"), "cid", "v", "least")

    together = dealt(rows.withColumn("least", F.lit(0.0)), 0).unionAll(dealt(visits, 1)).repartition(partitions, "table", "cell", "i", "j").sortWithinPartitions("table", "cell", "i", "j", "kind")
    return arrow_map(together, _compare(top), _FOUND_DDL)


# ------------------------------------------------------------------ fit


def _sample(df: DataFrame, n: int) -> np.ndarray:
    """Vectors of the n rows whose ids have the least hashes."""
    rows = df.select("v", "cid").orderBy(F.xxhash64("cid"), "cid").limit(n).collect()
    return np.array([r.v for r in rows], np.float64)


def _distances(index: DataFrame, q: np.ndarray, largest: float, top: int) -> np.ndarray:
    """Distances of the sampled queries' exact neighbours, by one pass over all rows."""

    def run(batches):
        best = np.full((len(q), top + 1), -np.inf)
        for b in batches:
            near = unit(q) @ matrix(b.column(0)).T
            best = -np.sort(-np.hstack([best, near]), axis=1)[:, : top + 1]
        i, k = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(best[i, k])], schema=pa.schema([("q", pa.int64()), ("near", pa.float64())]))

    near = arrow_map(index.select("v"), run, "q long, near double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near")))
    rows = near.withColumn("k", rank).where(F.col("k").between(2, top + 1)).select("near").collect()  # the first is the query itself
    return np.sqrt(np.maximum(0, 2 - 2 * np.array([r.near for r in rows]) / largest))


def fit(index: DataFrame, queries: DataFrame, n: int, largest: float, top: int) -> Hashing:
    """The cheapest hashing by the samples."""
    rows, q = _sample(index, FIT_ROWS), _sample(queries, FIT_QUERIES)
    found = _distances(index, q, largest, top)
    r = max(float(np.quantile(found, 0.8)) if len(found) else 1.0, 1e-6)
    best, least = None, np.inf
    for k in PROJECTIONS:
        for w in WIDTHS:
            hashing = Hashing.draw(rows.shape[1], k, w * r, r, largest)
            cells = hashing.cells(rows)
            held = [dict(zip(*np.unique(cells[:, t], return_counts=True), strict=True)) for t in range(TABLES)]
            cost = 0.0
            for tables, at, enough in hashing.visits(q):
                met = sum(held[t].get(c, 0) for t, c in zip(tables.tolist(), at.tolist(), strict=True)) / len(rows)
                cost += met * n + VISIT * len(at) if enough else SHORT * n
            if cost < least:
                best, least = hashing, cost
    return best


# ------------------------------------------------------------------ search


def hashed(index: DataFrame, hashing: Hashing) -> DataFrame:
    """(cid, v, cells): every row with its buckets."""
    kind = index.schema["v"].dataType.simpleString()

    def run(batches):
        for b in batches:
            cells = hashing.cells(matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(cells), pa.list_(pa.int64()))], names=["cid", "v", "cells"])

    return arrow_map(index.select("cid", "v"), run, f"cid long, v {kind}, cells array<long>")


def visited(queries: DataFrame, hashing: Hashing) -> DataFrame:
    """(cid, v, tables, cells, enough): every query with the buckets that it visits."""
    kind = queries.schema["v"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 100):
                part = b.slice(k, 100)
                tables, cells, enough = zip(*hashing.visits(matrix(part.column(1))), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(list(tables), pa.list_(pa.int64())), pa.array(list(cells), pa.list_(pa.int64())), pa.array(list(enough), pa.bool_())],
                    names=["cid", "v", "tables", "cells", "enough"],
                )

    return arrow_map(queries.select("cid", "v"), run, f"cid long, v {kind}, tables array<long>, cells array<long>, enough boolean")


def _lists(found: DataFrame, index: DataFrame, top: int) -> DataFrame:
    """(q, vec_id, score): the ``top`` + 1 best ids for each class of queries."""
    score = found.groupBy("q", "c").agg(F.max("score").alias("score"))
    best = score.withColumn("_k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).where(F.col("_k") <= top + 1)
    copies = index.where(F.size("ids") > 1).select(F.col("cid").alias("c"), "ids")
    each = best.join(copies, "c", "left").select("q", "score", F.explode(F.coalesce("ids", F.array("c"))).alias("vec_id"))
    return each.withColumn("_k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("_k") <= top + 1).drop("_k")


def search(table: DataFrame, top: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): neighbours of the rows whose id is divisible by ``every`` among all rows."""
    spark = table.sparkSession
    rows = materialise(vectors(table), "vectors")
    index = materialise(classes(rows, top), "classes")
    asked = materialise(rows.where(F.col("vec_id") % every == 0).join(index.select("v", "cid"), "v").select(F.col("vec_id").alias("query_id"), F.col("cid").alias("q")), "asked")
    queries = index.join(asked.select(F.col("q").alias("cid")).distinct(), "cid", "left_semi")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n, largest = index.agg(F.count("*"), F.max(norm)).collect()[0]
    n_ids = rows.count()
    if not n or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hashing = fit(index, queries, n, largest, top)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(partitions, -(-n * TABLES // 100_000))
    block = BLOCK  # each block gives a query its best, so blocks don't become smaller with more partitions

    hashes = materialise(hashed(index, hashing), "hashed")
    visits = materialise(visited(queries, hashing), "visits")
    in_cells = hashes.select("cid", "v", F.posexplode("cells").alias("table", "cell"))
    of_query = visits.where("enough").select("cid", "v", F.posexplode(F.arrays_zip("tables", "cells")).alias("k", "e"))
    to_cells = of_query.select("cid", "v", "k", F.col("e.tables").alias("table"), F.col("e.cells").alias("cell"), F.lit(float("-inf")).alias("least"))
    first = materialise(_blocks(in_cells, to_cells.where(F.col("k") < TABLES), top + 1, partitions, block), "first")
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    last = first.groupBy("q", "c").agg(F.max("score").alias("score")).withColumn("_k", F.row_number().over(by_score)).where(F.col("_k") == top + 1).select(F.col("q").alias("cid"), F.col("score").alias("_last"))
    others = to_cells.where(F.col("k") >= TABLES).join(last, "cid", "left").withColumn("least", F.coalesce("_last", "least"))
    more = _blocks(in_cells, others, top + 1, partitions, block)
    found = materialise(_lists(first.unionAll(more), index, top), "found")

    # those without enough visits or ids are compared with every row
    got = found.groupBy("q").agg(F.count("*").alias("n"))
    rest = materialise(visits.join(got, visits.cid == got.q, "left").where(F.coalesce("n", F.lit(0)) < min(top + 1, n_ids)).select("cid", "v"), "rest")
    if not rest.isEmpty():
        whole, of = F.lit(-1).alias("table"), -(-n // block)
        every_row = hashes.select(whole, F.pmod(F.xxhash64(F.lit("block"), "cid"), F.lit(of)).alias("cell"), "cid", "v")
        to_all = rest.select(whole, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long"))).alias("cell"), "cid", "v", F.lit(float("-inf")).alias("least"))
        exact = _lists(_blocks(every_row, to_all, top + 1, partitions, block), index, top)
        found = found.join(rest.select(F.col("cid").alias("q")), "q", "left_anti").unionAll(exact)

    out = asked.join(found, "q").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
