"""Sets of offsets as bitmaps: a row holds which of 32,768 offsets of a queue are in the set.

A set is a table of the queue's columns, ``bucket`` (offset div 32,768) and ``bits`` (4,096 bytes, the
lowest bit first). It merges like a sum, so a queue's offsets are never listed anywhere: they
are added up before the shuffle, and what leaves a bucket is its runs. What continues
over the border of two buckets is joined from one or two rows a bucket, scanned in chunks.

Cases. Null offsets are in no set; repeated ones count once; negative ones are like any other. A queue
whose key is null is a queue of its own. A bucket takes 4 kB however few its offsets are. An
empty set has no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.functions import offset_codec
from tidemark.operators.scans import neighbour, running
from tidemark.session import ship

SHIFT = 15
WIDTH = 1 << SHIFT
#: Buckets whose border rows are scanned together; buckets that a worker unpacks at once (8 MB).
CHUNK_SHIFT, AT_ONCE = 12, 256
_ZEROS = bytes(WIDTH // 8)


def _bucket(offset: Column) -> Column:
    return F.shiftright(offset.cast("long"), SHIFT)


def _at(offset: Column) -> Column:
    return offset.cast("long").bitwiseAND(F.lit(WIDTH - 1))


def _byte(bits: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(bits, at + 1, F.lit(1))), 16, 10).cast("int")


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> tuple[DataFrame, Column]:
    """``b`` with its ``columns`` renamed, and the condition on which both agree in them, nulls included."""
    for c in columns:
        b = b.withColumnRenamed(c, f"_of_{c}")
    return b, reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"_of_{c}"]) for c in columns])


def offset_set(df: DataFrame, queue: list[str], offset: str) -> DataFrame:
    """The set of a table's offsets."""
    rows = df.where(F.col(offset).isNotNull()).select(*queue, _bucket(F.col(offset)).alias("bucket"), _at(F.col(offset)).alias("_at"))
    return rows.groupBy(*queue, "bucket").agg(F.bitmap_construct_agg("_at").alias("bits"))


def union(queue: list[str], *sets: DataFrame) -> DataFrame:
    both = reduce(lambda a, b: a.unionByName(b), [s.select(*queue, "bucket", "bits") for s in sets])
    return both.groupBy(*queue, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def at_least(sets: DataFrame, minimum: Column) -> DataFrame:
    """A set without what lies below ``minimum``, an expression over the set's columns; no row but the border's is rewritten."""
    low = minimum.cast("long") - F.shiftleft(F.col("bucket"), SHIFT)
    at = F.shiftright(low, 3).cast("int")
    kept = _byte(F.col("bits"), at).bitwiseAND(F.call_function("shiftleft", F.lit(0xFF), low.bitwiseAND(F.lit(7)).cast("int")))
    head = F.substring(F.lit(_ZEROS), F.lit(1), at)
    cut = F.concat(head, F.unhex(F.lpad(F.hex(kept), 2, "0")), F.substring(F.col("bits"), at + 2, F.lit(WIDTH)))
    return sets.where(low < WIDTH).withColumn("bits", F.when(low <= 0, F.col("bits")).otherwise(cut)).where(F.bitmap_count("bits") > 0)


def minimum_merged(left: DataFrame, right: DataFrame, queue: list[str], minimum: Column) -> DataFrame:
    """Union of two sets without what lies below the minimum, which is cut before the merge."""
    return union(queue, at_least(left, minimum), at_least(right, minimum))


def size(sets: DataFrame, queue: list[str]) -> DataFrame:
    return sets.groupBy(*queue).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def with_membership(rows: DataFrame, sets: DataFrame, queue: list[str], offset: str, name: str) -> DataFrame:
    """Adds whether each row's offset is in its queue's set. One join by queue and bucket; a null offset is in none."""
    keyed = rows.withColumn("bucket", _bucket(F.col(offset)))
    of, on = _same(keyed, sets.select(*queue, "bucket", "bits"), [*queue, "bucket"])
    at = _at(F.col(offset))
    bit = F.call_function("shiftright", _byte(F.col("bits"), F.shiftright(at, 3).cast("int")), at.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1))
    return keyed.join(of, on, "left").select(*rows.columns, F.coalesce(bit == 1, F.lit(False)).alias(name))


def _unpacked(sets: DataFrame, queue: list[str], fields: str, fn) -> DataFrame:
    """``fn`` gets buckets and their bits (a row of WIDTH bytes each) and gives (row of each result, columns)."""
    ship(sets.sparkSession)
    out = StructType([*sets.select(*queue).schema.fields, *StructType.fromDDL(fields).fields])
    schema = to_arrow_schema(out)

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, AT_ONCE):
                part = b.slice(k, AT_ONCE)
                buckets = part.column(len(queue)).to_numpy().astype(np.int64)
                packed = np.frombuffer(b"".join(part.column(len(queue) + 1).to_pylist()), np.uint8).reshape(-1, WIDTH // 8)
                rows, columns = fn(buckets, np.unpackbits(packed, axis=1, bitorder="little"))
                keys = [part.column(i).take(pa.array(rows)) for i in range(len(queue))]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip([*keys, *map(pa.array, columns)], schema, strict=True)], schema=schema)

    return sets.select(*queue, "bucket", "bits").mapInArrow(run, out)


def _islands(df: DataFrame, queue: list[str], order: list[str], starts: Column) -> DataFrame:
    """Adds ``_island``: how many rows so far start one."""
    chunk = F.shiftright("bucket", CHUNK_SHIFT)
    return running(df.withColumn("_starts", starts.cast("int")), queue, order, chunk, _island=("sum", F.col("_starts"))).drop("_starts")


def ranges(sets: DataFrame, queue: list[str]) -> DataFrame:
    """Inclusive ranges of consecutive offsets, as ``start`` and ``end``."""

    def runs(buckets, bits):
        n, wide = len(bits), np.zeros((len(bits), WIDTH + 2), np.int8)
        wide[:, 1:-1] = bits
        edges = np.diff(wide, axis=1)
        (rows, start), (_, stop) = np.nonzero(edges == 1), np.nonzero(edges == -1)
        base = buckets[rows] << SHIFT if n else buckets[:0]
        return rows, [buckets[rows], base + start, base + stop - 1, (start == 0) | (stop == WIDTH)]

    found = _unpacked(sets, queue, "bucket long, start long, end long, border boolean", runs)
    edges = neighbour(found.where("border"), queue, ["start"], F.shiftright("bucket", CHUNK_SHIFT), -1, _before=F.col("end"))
    joined = _islands(edges, queue, ["start"], F.coalesce(F.col("start") > F.col("_before") + 1, F.lit(True)))
    over = joined.groupBy(*queue, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return found.where("not border").select(*queue, "start", "end").unionByName(over.select(*queue, "start", "end"))


def steps(sets: DataFrame, queue: list[str], base: str) -> DataFrame:
    """Runs of equal distances: ``delta``, how many ``times``, in order of ``bucket`` and ``nth``. The first distance is to the column ``base``."""
    keys = [*queue, base]

    def deltas(buckets, bits):
        rows, at = np.nonzero(bits)
        offsets = (buckets[rows] << SHIFT) + at
        head = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
        delta = np.where(head, 0, np.diff(offsets, prepend=0))
        # a bucket's first offset is a run of its own, and so is what follows it
        first = head | np.r_[False, head[:-1]] | np.r_[True, delta[1:] != delta[:-1]] if len(rows) else head
        starts = np.flatnonzero(first)
        times = np.diff(np.r_[starts, len(rows)])
        last = np.append(np.flatnonzero(head)[1:] - 1, len(rows) - 1)
        of_row = np.cumsum(head) - 1 if len(rows) else rows
        ends = offsets[last[of_row[starts]]] if len(rows) else offsets
        heads = head[starts]
        return rows[starts], [buckets[rows[starts]], starts, np.where(heads, offsets[starts], delta[starts]), times, ends, heads]

    found = _unpacked(sets, keys, "bucket long, nth long, delta long, times long, last long, head boolean", deltas)
    chunk = F.shiftright("bucket", CHUNK_SHIFT)
    heads = neighbour(found.where("head"), queue, ["bucket"], chunk, -1, _before=F.col("last"))
    heads = heads.withColumn("delta", F.col("delta") - F.coalesce("_before", F.col(base))).drop("_before")
    every = heads.unionByName(found.where("not head")).select(*keys, "bucket", "nth", "delta", "times")
    order = ["bucket", "nth"]
    moved = neighbour(every, queue, order, chunk, -1, _before=F.col("delta"))
    joined = _islands(moved, queue, order, F.coalesce(F.col("delta") != F.col("_before"), F.lit(True)))
    place = F.min(F.struct(*order))
    merged = joined.groupBy(*keys, "_island").agg(place.alias("_place"), F.min("delta").alias("delta"), F.sum("times").alias("times"))
    return merged.select(*keys, "_place.bucket", "_place.nth", "delta", "times")


def _number(n: Column) -> Column:
    """Hex of 7-bit groups, low first."""
    groups = []
    for k in range(0, 63, 7):
        group = F.shiftrightunsigned(n, k).bitwiseAND(F.lit(0x7F))
        more = F.shiftrightunsigned(n, k + 7) > 0
        text = F.lpad(F.hex(F.when(more, group + 0x80).otherwise(group)), 2, "0")
        groups.append(text if k == 0 else F.when(F.shiftrightunsigned(n, k) > 0, text).otherwise(""))
    return F.concat(*groups)


def metadata(sets: DataFrame, bases: DataFrame, queue: list[str], max_chars: int | None = None) -> DataFrame:
    """The text of each queue's set behind its ``base`` (a column of ``bases``, one row for each queue), as ``offset_codec`` reads it.

    With ``max_chars`` it is the longest prefix of whole runs that fits, and no more than that is
    brought together. Without, a queue's runs are one value, as its text is. No set, no row.
    """
    of, on = _same(sets, bases.select(*queue, "base"), queue)
    based = at_least(sets.join(of, on).select(*queue, "base", "bucket", "bits"), F.col("base") + 1)
    delta, times = F.col("delta"), F.col("times")
    plain, run = F.repeat(_number(delta), times.cast("int")), F.concat(_number(F.lit(offset_codec.RUN_MARKER).cast("long")), _number(delta), _number(times))
    rows = steps(based, queue, "base").withColumn("hex", F.when(times < 3, plain).otherwise(run))
    if max_chars is not None:
        room = max_chars * 3 // 4 - 1 - offset_codec.CHECKSUM_BYTES - F.length(_number(F.col("_total"))) / 2
        upto = running(rows, queue, ["bucket", "nth"], F.shiftright("bucket", CHUNK_SHIFT), _upto=("sum", F.length("hex") / 2))
        total, same = _same(upto, rows.groupBy(*queue).agg(F.sum("times").alias("_total")), queue)
        rows = upto.join(total, same).where(F.col("_upto") <= room).select(*rows.columns)
    per = rows.groupBy(*queue, "base").agg(F.sum("times").alias("n"), F.sort_array(F.collect_list(F.struct("bucket", "nth", "hex"))).alias("runs"))
    body = F.concat(F.lit(f"{offset_codec.VERSION:02X}"), _number(F.col("n")), F.array_join(F.transform("runs", lambda r: r["hex"]), ""))
    whole = F.concat(F.lpad(F.hex("base"), 16, "0"), body)
    text = F.base64(F.unhex(F.concat(body, F.lpad(F.hex(F.crc32(F.unhex(whole))), 2 * offset_codec.CHECKSUM_BYTES, "0"))))
    return per.select(*queue, "base", F.col("n").alias("n_offsets"), F.regexp_replace(text, "[\r\n=]", "").alias("text"))


def from_metadata(texts: DataFrame, queue: list[str]) -> DataFrame:
    """The offsets in ``text`` behind ``base``. A worker reads runs, in pieces of a bucket's width; they become rows in Spark."""
    ship(texts.sparkSession)
    out = StructType([*texts.select(*queue).schema.fields, *StructType.fromDDL("start long, delta long, times long").fields])
    schema = to_arrow_schema(out)

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                base, text = b.column(len(queue))[k].as_py(), b.column(len(queue) + 1)[k].as_py()
                at, pieces = base, []
                for delta, times in offset_codec.decode_runs(base, text or ""):
                    for first in range(0, times, WIDTH):
                        n = min(WIDTH, times - first)
                        pieces.append((at + delta, delta, n))
                        at += delta * n
                columns = np.array(pieces, np.int64).reshape(-1, 3)
                keys = [b.column(i).take(pa.array([k] * len(pieces), pa.int64())) for i in range(len(queue))]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip([*keys, *map(pa.array, columns.T)], schema, strict=True)], schema=schema)

    runs = texts.select(*queue, "base", "text").mapInArrow(run, out)
    last = F.col("start") + F.col("delta") * (F.col("times") - 1)
    return runs.select(*queue, F.explode(F.sequence("start", last, "delta")).alias("offset"))
