"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ship

#: ASCII A-Z to a-z on UTF-8 bytes; other bytes stay.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch at most. The JVM and the worker both hold batches whole, besides what they are made of.
BATCH_ROWS = 1000


def _trim():
    """glibc's malloc_trim, or nothing where there is none."""
    import ctypes

    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def give_back() -> None:
    """Free memory to the system: workers are kept for later stages, and so is what they once took."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def bounded_batches(spark: SparkSession) -> None:
    """At most ``BATCH_ROWS`` rows in the session's Arrow batches; a smaller setting stays."""
    at = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(at)) <= BATCH_ROWS:
        spark.conf.set(at, str(BATCH_ROWS))


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with this package shipped to the executors, in bounded batches; a task's end gives memory back."""
    ship(df.sparkSession)
    bounded_batches(df.sparkSession)

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def spread(df: DataFrame, a_core: int = 2) -> DataFrame:
    """``df`` dealt over all cores if a scan gives it fewer than two splits a core, or as many as ``a_core`` says.

    Such a table is small, or has few and large row groups, which leave most splits empty. A larger
    one, or one that was shuffled before, stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    query = df._jdf.queryExecution()
    if "Exchange" in query.executedPlan().toString() or query.toRdd().getNumPartitions() >= a_core * cores:
        return df
    return df.repartition(2 * cores)


#: Sign bit of a long.
_SIGN = -(1 << 63)


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """``docs`` with _did and _th, which together tell documents apart, and ``more`` of their columns.

    With an id: the id and 63 bits of a hash of the text, _th negative. Without: 127 bits of hashes of the
    text, _th not negative. Order is by (_th >= 0, _did, _th): null ids last.
    """
    text = F.shiftrightunsigned(F.xxhash64("text"), 1)
    did = F.col("doc_id").cast("long")
    return docs.select(
        *[F.col(f"`{c}`") for c in more],
        F.coalesce(did, F.xxhash64(F.lit("no id"), F.col("text"))).alias("_did"),
        F.when(did.isNull(), text).otherwise(text.bitwiseOR(F.lit(_SIGN).cast("long"))).alias("_th"),
    )


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str | None]:
    """Texts of a column. Bytes that are no UTF-8 become U+FFFD; Arrow's own conversion would fail on them."""
    return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, to bound what a worker holds beside its input."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def no_clash(df: DataFrame, *names: str) -> str:
    """A column name that starts with the first free of ``names`` in ``df``."""
    taken = {c.lower() for c in df.columns}
    for n in names:
        if n.lower() not in taken:
            return n
    k = 0
    while f"{names[0]}_{k}".lower() in taken:
        k += 1
    return f"{names[0]}_{k}"


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Each name as it is, or with a number behind where ``df`` has it already."""
    return [no_clash(df, n) for n in names]


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just the named columns; extra ones never reach an operator's inner steps."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def arrow_filter(df: DataFrame, column: str, keep, *more: str) -> DataFrame:
    """Rows of ``df`` for which ``keep`` says so, with their columns as they are.

    ``keep`` gets the UTF-8 bytes of ``column``, and the values of ``more``, for a slice of rows
    and returns as many booleans. The verdict is taken beside the row, so no join is needed.
    """
    at = df.columns.index(column)
    also = [df.columns.index(c) for c in more]

    def run(batches):
        for b in slices(batches):
            yield b.filter(pa.array(keep(utf8(b.column(at)), *[b.column(k).to_pylist() for k in also]), pa.bool_()))

    return arrow_map(df, run, df.schema)
