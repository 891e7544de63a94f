"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprint: A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles are
``shingle`` consecutive words joined by a blank, repeats included (fewer words: the whole
sequence; none: fingerprint zero). A bit is 1 if over half of the shingles' XXH64 (seed 42)
have it. Documents link if their fingerprints differ in at most ``RADIUS`` = 2 bits; groups
are the connected components.

Only distinct fingerprints are compared. Of four 16-bit blocks at least two agree between
linked fingerprints, so each is sent to six buckets, one for each pair of blocks. A bucket
with more than ``HOT`` fingerprints is dealt again by the pairs of 8-bit blocks of its
other 32 bits, which is exact for the same reason; a second-level bucket agrees in 48 bits
and so holds at most 65,536. In each bucket the fingerprints are sorted by Gray rank, and
groups of consecutive ones factor the bits they share into an upper node (``GrayIndex``). A
search adds up differences from the top and drops a whole group once they exceed the radius.
A bucket returns a star for each of its components, never all pairs.

Cases. Null text has no words: fingerprint zero, linked like any other. Null ids stay; they
never name a component unless it has no other id, then component_id is null. Equal ids and
repeated rows each keep their row. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, arrow_map, batch, free_names, only, slices, spread, utf8
from tidemark.llm.components import components
from tidemark.session import materialise

SHINGLE, RADIUS, SEED = 3, 2, 42
HOT = 512
FAN = 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    import xxhash

    w = text.translate(LOWER).split()
    n = len(w)
    if n == 0:
        return 0
    if n <= shingle:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    else:
        runs = map(b" ".join, zip(*[w[k:] for k in range(shingle)], strict=False))
        h = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, n - shingle + 1)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 65280):
        bits = np.unpackbits(h[k : k + 65280].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        pad = -len(bits) % 255
        if pad and len(bits) > 255:
            bits = np.concatenate([bits, np.zeros((pad, 64), np.uint8)])
        bits = bits.reshape(-1, 255, 64) if len(bits) > 255 else bits[None]
        ones += np.add.reduce(bits, axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray code: the prefix xor of its bits."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Hierarchy over fingerprints in Gray order; ``search`` finds all within a radius.

    ``levels[0]`` are the fingerprints, each level above has a node for ``FAN`` consecutive
    nodes. A node keeps the bits that all below it share and that its parent doesn't
    already keep, as a mask and a value.
    """

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(gray_rank(values), kind="stable")
        ones = self.values = values[self.order]
        zeros = ~ones
        full = [(ones, zeros)]
        while len(ones) > FAN:
            at = np.arange(0, len(ones), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
            full.append((ones, zeros))
        self.levels = []
        for k, (one, zero) in enumerate(full):
            mask = one | zero
            if k + 1 < len(full):
                up = (full[k + 1][0] | full[k + 1][1])[np.arange(len(one)) // FAN]
                mask = mask & ~up
            self.levels.append((one & mask, mask))

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, place in ``order``) of all pairs within ``radius``."""
        top = len(self.levels) - 1
        value, _ = self.levels[top]
        q = np.repeat(np.arange(len(queries)), len(value))
        node = np.tile(np.arange(len(value)), len(queries))
        far = np.zeros(len(q), np.uint8)
        for k in range(top, -1, -1):
            value, mask = self.levels[k]
            if k < top:
                q, far = np.repeat(q, FAN), np.repeat(far, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).reshape(-1)
                there = node < len(value)
                q, far, node = q[there], far[there], node[there]
            far = far + np.bitwise_count((queries[q] ^ value[node]) & mask[node])
            near = far <= radius
            q, far, node = q[near], far[near], node[near]
        return q, node


def bucket_roots(values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each distinct fingerprint of a bucket the smallest of its component there."""
    index = GrayIndex(values)
    n = len(values)
    parent = np.arange(n)
    step = max(16, (1 << 20) // n)
    for k in range(0, n, step):
        q, j = index.search(index.values[k : k + step], radius)
        q = q + k
        later = q < j
        a, b = q[later], j[later]
        while len(a):
            a, b = parent[a], parent[b]
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    least = np.full(n, np.iinfo(np.int64).max)
    signed = index.values.view(np.int64)
    np.minimum.at(least, parent, signed)
    roots = np.empty(n, np.int64)
    roots[index.order] = least[parent]
    return roots


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and th, a hash of the text that tells rows of one id apart."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("th", pa.int64())])

    def run(batches):
        for b in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in utf8(b.column(1))], np.uint64)
            yield batch(schema, doc_id=b.column(0), fp=pa.array(fps.view(np.int64)), th=b.column(2))

    return arrow_map(spread(only(docs, "doc_id", "text")).withColumn("th", F.xxhash64("text")), run, "doc_id long, fp long, th long")


def _pair_keys(fp, width: int, shifts: list[int], prefix):
    """Array of bucket keys: which two blocks, and their bits."""
    mask = (1 << width) - 1
    block = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit(mask).cast("long")) for s in shifts]
    return F.array(*[
        F.struct(*prefix, F.lit(k).alias("pair"), F.shiftleft(block[a], width).bitwiseOR(block[b]).alias("bits"))
        for k, (a, b) in enumerate(combinations(range(len(shifts)), 2))
    ])


def buckets(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """fp and its bucket (k1, b1, k2, b2); k2 is -1 for buckets that aren't dealt again."""
    fp = F.col("fp")
    first = distinct.select("fp", F.explode(_pair_keys(fp, 16, [0, 16, 32, 48], [])).alias("k")).select("fp", F.col("k.pair").alias("k1"), F.col("k.bits").alias("b1"))
    sizes = first.groupBy("k1", "b1").count().where(F.col("count") > 1).select("k1", "b1", (F.col("count") > hot).alias("hot"))
    # a bucket with one fingerprint links nothing
    shared = first.join(sizes, ["k1", "b1"])
    cold = shared.where("not hot").select("fp", "k1", "b1", F.lit(-1).alias("k2"), F.lit(0).cast("long").alias("b2"))
    rest = F.lit(None).cast("array<struct<pair:int,bits:bigint>>")
    for k, pair in enumerate(combinations(range(4), 2)):
        free = [s * 16 + o for s in range(4) if s not in pair for o in (0, 8)]
        rest = F.when(F.col("k1") == k, _pair_keys(fp, 8, free, [])).otherwise(rest)
    again = shared.where("hot").select("fp", "k1", "b1", F.explode(rest).alias("k")).select("fp", "k1", "b1", F.col("k.pair").alias("k2"), F.col("k.bits").alias("b2"))
    return cold.unionByName(again)


def bucket_edges(keyed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Star edges (u, v) of each bucket's components."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    rows = keyed.repartition("k1", "b1", "k2", "b2").sortWithinPartitions("k1", "b1", "k2", "b2").select("k1", "b1", "k2", "b2", "fp")

    def run(batches):
        held = np.zeros((5, 0), np.int64)
        for b in batches:
            got = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)])
            rows = np.concatenate([held, got], axis=1)
            last = int(np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0))[-1]) + 1 if (rows[:4, 1:] != rows[:4, :-1]).any() else 0
            yield from edges(rows[:, :last])
            held = rows[:, last:]
        yield from edges(held)

    def edges(rows):
        if not rows.shape[1]:
            return
        at = np.concatenate([[0], np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0)) + 1, [rows.shape[1]]])
        us, vs = [], []
        for a, e in zip(at[:-1], at[1:], strict=True):
            if e - a > 1:
                fp = rows[4, a:e]
                root = bucket_roots(fp.view(np.uint64), radius)
                us.append(fp[root != fp])
                vs.append(root[root != fp])
        if us:
            yield batch(schema, u=pa.array(np.concatenate(us)), v=pa.array(np.concatenate(vs)))

    return arrow_map(rows, run, "u long, v long")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp and th of each row of ``docs``; fp and root, the smallest fingerprint of its component, of each distinct fp)."""
    if not 0 <= radius <= 2:
        raise ValueError("two of four blocks agree up to 2 differing bits only")
    prints = materialise(fingerprints(docs, shingle), "fingerprints")
    distinct = prints.select("fp").distinct()
    linked = components(bucket_edges(buckets(distinct), radius))
    roots = distinct.join(linked, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return prints, roots


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Ids are brought together by distinct fingerprint, then by component, both with partial minima.
    Rows get theirs by one join on the fingerprint, which can be split where very many rows have it.
    """
    prints, roots = near_groups(docs, shingle, radius)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp")
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = materialise(least.join(named, "root").select(F.col("fp").alias("f"), "component_id"), "component-ids")
    return prints.join(ids, F.col("fp") == F.col("f")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id (null ids last), then of the smallest text hash.

    Rows that repeat that row's id and text are dropped too.
    """
    prints, roots = near_groups(docs, shingle, radius)
    return first_of_groups(docs, prints.select("doc_id", "th", F.col("fp").alias("node")), roots.select(F.col("fp").alias("n"), "root"))


def first_of_groups(docs: DataFrame, rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``docs`` with the first row of each group.

    ``rows``: doc_id, th and node of the rows; ``roots``: n, root of nodes. Minima are taken by
    document, by node and then by group, so no task reads all rows of a node or group.
    """
    one, two = free_names(docs, "first_id", "first_th")
    times = rows.groupBy("node", "doc_id", "th").agg(F.count(F.lit(1)).alias("times"))
    by_node = times.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "times")).alias("k"))
    grouped = by_node.join(roots, F.col("node") == F.col("n"), "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("k").alias("k"))
    first = materialise(grouped.select(F.col("k.doc_id").alias(one), F.col("k.th").alias(two), "k.times"), "first-of-group")
    repeated = not first.where("times > 1").isEmpty()
    kept = docs.join(first.select(one, two), docs["doc_id"].eqNullSafe(F.col(one)) & (F.xxhash64(docs["text"]) == F.col(two)), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept
