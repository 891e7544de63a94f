"""Near-duplicates by the Jaccard similarity of five-word shingles, for the pipeline.

Words are those of ``simhash``; a text's set holds its distinct runs of ``SHINGLE`` words
(fewer words: the whole sequence; none: the empty set, equal to itself only). Documents link
if their sets have a similarity of at least ``SIMILARITY``; groups are the connected
components.

Candidates come from SimHash alone. The 64-bit fingerprint of ``simhash`` over the same shingles, linked at two bits
by its Gray-order index, gives copies with little changed. Two texts at a similarity of 0.8 differ in about 10 of
64 bits, beyond what two equal blocks of four can guarantee, so each set also gets ``PRINTS`` independent SimHash fingerprints
and is sent to a bucket for each of their 16-bit blocks. At 0.8 a bit agrees with
probability 1 - acos(8/9)/pi = 0.848, a block with 0.072, and none of the 104 with 0.0004, less above. In a bucket
the first two fingerprints are searched in Gray order: all within ``RADIUS_ONE`` bits of the
first, and of these all within ``RADIUS_TWO`` bits of both (23 and 36; at 0.8 the means are 9.7 and 19.4, with
deviations of 2.9 and 4.1). What is found is a candidate only: every link is checked on the two texts themselves.

Scale. Equal texts are one node. A bucket of at most ``FAN`` nodes is one leaf of the index, which is compared
at once with the others; a larger one is searched from the top. If either has more than ``HOT`` near pairs a node, it
is dense and first gives the pairs with leaders, each with the nodes near it that none before has; a node is checked with the
nearest of its leaders. What isn't one component then is compared without a row for each pair: a dense bucket gives stars
over its near pairs of different components that are within ``FAR`` bits of all fingerprints (at 0.8 the mean is 253 of 1,664, the
deviation 15; 313 and 16 for four shingles within five). The stars' components are dealt in parts of about ``BLOCK`` nodes, each
two parts meet in one block, and there all pairs within ``FAR`` are checked on their texts. Blocks give links only, and none
between what is linked already. Rows are nodes times parts, while the comparisons of a group that is near throughout
are as many as its pairs. No near pair of a bucket is dropped but those that are in one component already or
further apart than ``FAR``, as a similar pair is with probability 0.000001 at most.

Cases. Null, empty and blank texts are one group. Null ids come last in choosing a group's
row. An empty table gives no rows; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, arrow_map, batch, only, slices, spread, utf8
from tidemark.llm.components import components
from tidemark.llm.simhash import FAN, SEED, GrayIndex, bucket_edges, buckets, first_of_groups, majority
from tidemark.session import materialise

SHINGLE, SIMILARITY = 5, 0.8
#: Independent fingerprints, and their 16-bit blocks.
PRINTS = 26
BANDS = 4 * PRINTS
RADIUS_ONE, RADIUS_TWO = 23, 36
#: Of 64 * PRINTS bits.
FAR = 392
#: Rounds in which dense buckets give their leaders' pairs; later ones give every pair.
HOT, LEADERS = 2, 1
#: Leaders of a bucket in one round.
AT_ONCE = 64
#: Nodes of a candidate group that are dealt to one part.
BLOCK = 512
_RNG = np.random.default_rng(3)
_FACTORS, _MIX = _RNG.integers(1, 2**62, (2, PRINTS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _RNG.integers(0, 2**63, PRINTS, dtype=np.uint64)



def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(all_shingles(text, shingle))


def all_shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's shingles, repeats included."""
    import xxhash

    w = text.translate(LOWER).split()
    if len(w) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)] if w else [], np.uint64)
    runs = map(b" ".join, zip(*[w[k:] for k in range(shingle)], strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(w) - shingle + 1)


def prints_of(found: np.ndarray) -> np.ndarray:
    """The set's ``PRINTS`` SimHash fingerprints: bits that over half of its hashes have, hashed anew for each."""
    ones = np.zeros(64 * PRINTS, np.int64)
    for k in range(0, len(found), 255):
        h = found[k : k + 255]
        h = (h ^ (h >> np.uint64(32)))[:, None] * _FACTORS + _ADDED
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h ^= h >> np.uint64(29)
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)


def band_keys(found: np.ndarray) -> np.ndarray:
    """The bucket of each 16-bit block of the set's fingerprints."""
    return np.arange(BANDS) << 16 | prints_of(found).view(np.uint16).astype(np.int64)


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    if not len(a) or not len(b):
        return len(a) == len(b)
    small, large = sorted((len(a), len(b)))
    if small < similarity * large - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text), its SimHash fingerprint (0 without words) and the independent ones."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("fp", pa.int64()), ("prints", pa.list_(pa.int64()))])

    def run(batches):
        for b in slices(batches):
            found = [all_shingles(t) for t in utf8(b.column(1))]
            prints = np.concatenate([prints_of(np.unique(h)) for h in found]).view(np.int64)
            fp = np.array([majority(h) if len(h) else 0 for h in found], np.uint64).view(np.int64)
            yield batch(schema, doc_id=b.column(0), th=b.column(2), fp=pa.array(fp), prints=pa.ListArray.from_arrays(np.arange(0, len(prints) + 1, PRINTS, dtype=np.int32), pa.array(prints)))

    return arrow_map(spread(only(docs, "doc_id", "text")).withColumn("th", F.xxhash64("text")), run, "doc_id long, th long, fp long, prints array<long>")


def bucket_rows(prints: DataFrame) -> DataFrame:
    """node, its first two fingerprints (one, two) and the keys of its buckets, as of ``band_keys``."""
    nodes = prints.groupBy("th").agg(F.first("prints").alias("prints"))
    each = nodes.select(F.col("th").alias("node"), F.col("prints")[0].alias("one"), F.col("prints")[1].alias("two"), F.posexplode("prints").alias("k", "fp"))
    blocks = F.array(*[((F.col("k") * 4 + b).cast("long") * 65536).bitwiseOR(F.shiftrightunsigned("fp", 16 * b).bitwiseAND(F.lit(65535).cast("long"))) for b in range(4)])
    return each.select("node", "one", "two", F.explode(blocks).alias("key"))


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether nodes are near: ``a`` and ``b`` have their first two fingerprints as rows."""
    one = np.bitwise_count(a[0] ^ b[0])
    return (one <= RADIUS_ONE) & (one + np.bitwise_count(a[1] ^ b[1]) <= RADIUS_TWO)


def near_pairs(roots: np.ndarray, prints: np.ndarray):
    """Places of a bucket's near pairs in different components, some at a time."""
    index = GrayIndex(prints[0])
    step = max(16, (1 << 20) // len(roots))
    for k in range(0, len(roots), step):
        q, j = index.search(index.values[k : k + step], RADIUS_ONE)
        q = q + k
        i, j = index.order[q[q < j]], index.order[j[q < j]]
        keep = (roots[i] != roots[j]) & near(prints[:, i], prints[:, j])
        if keep.any():
            yield i[keep], j[keep]


def leader_pairs(nodes: np.ndarray, roots: np.ndarray, prints: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes with the leader near them, and their bits apart: in an order by hash, the first that no leader before has. The first leader is with itself, too."""
    order = np.argsort((nodes.view(np.uint64) ^ np.uint64(salt & (2**64 - 1))) * _FACTORS[0])
    us, vs, bits, left = [nodes[order[:1]]], [nodes[order[:1]]], [np.zeros(1, np.int64)], order
    for _ in range(AT_ONCE):
        if not len(left):
            break
        lead, left = left[0], left[1:]
        found = near(prints[:, lead][:, None], prints[:, left])
        other = left[found & (roots[left] != roots[lead])]
        us.append(np.full(len(other), nodes[lead]))
        vs.append(nodes[other])
        bits.append(np.bitwise_count(prints[:, lead][:, None] ^ prints[:, other]).sum(axis=0, dtype=np.int64))
        left = left[~found]
    return np.concatenate(us), np.concatenate(vs), np.concatenate(bits)


def bucket_pairs(rows: DataFrame, round_: int) -> DataFrame:
    """``rows``: key, node, root, one, two. Pairs u, v to check, with the key where a bucket has more to come and then the bits between them."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("key", pa.int64()), ("bits", pa.int64())])
    hot = HOT  # as it is here, not in the workers
    dealt = rows.repartition("key").sortWithinPartitions("key", "node").select("key", "node", "root", "one", "two")

    def out(u, v, bits=None, key=None):
        none = pa.nulls(len(u), pa.int64())
        return batch(schema, u=pa.array(u), v=pa.array(v), key=none if key is None else pa.array(np.full(len(u), key)), bits=none if key is None else pa.array(bits))

    def large(key: int, nodes: np.ndarray, roots: np.ndarray, prints: np.ndarray):
        found, n = [], 0
        for i, j in near_pairs(roots, prints):
            if round_ >= LEADERS:
                yield out(nodes[i], nodes[j])
                continue
            found.append((nodes[i], nodes[j]))
            n += len(i)
            if n > hot * len(nodes):
                yield out(*leader_pairs(nodes, roots, prints, round_), key)
                return
        if found:
            yield out(np.concatenate([u for u, _ in found]), np.concatenate([v for _, v in found]))

    def pairs(held: np.ndarray):
        key, nodes, roots, prints = held[0], held[1], held[2], held[3:].view(np.uint64)
        edge = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts = np.concatenate([[0], edge])
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        bucket = np.repeat(np.arange(len(sizes)), sizes)
        leaf = sizes <= (FAN if hot else 0)
        is_leaf, us, vs = leaf[bucket], [], []
        for k in range(1, FAN):
            at = np.flatnonzero((bucket[k:] == bucket[:-k]) & is_leaf[k:] & (roots[k:] != roots[:-k]))
            at = at[near(prints[:, at], prints[:, at + k])]
            us.append(at)
            vs.append(at + k)
        u, v = np.concatenate(us), np.concatenate(vs)
        dense = leaf & (np.bincount(bucket[u], minlength=len(sizes)) > hot * sizes) & (round_ < LEADERS)
        keep = ~dense[bucket[u]]
        if keep.any():
            yield out(nodes[u[keep]], nodes[v[keep]])
        some = (~leaf | dense) & (sizes > 1)
        for a, e in zip(starts[some].tolist(), (starts + sizes)[some].tolist(), strict=True):
            yield from large(int(key[a]), nodes[a:e], roots[a:e], prints[:, a:e])

    def run(batches):
        held = np.zeros((5, 0), np.int64)
        for b in batches:
            held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns])], axis=1)
            whole = int(np.searchsorted(held[0], held[0, -1])) if held.shape[1] else 0
            if whole:
                yield from pairs(held[:, :whole])
                held = held[:, whole:]
        if held.shape[1]:
            yield from pairs(held)

    return arrow_map(dealt, run, "u long, v long, key long, bits long")


def simhash_pairs(prints: DataFrame) -> DataFrame:
    """Pairs u, v of nodes in one star of a bucket of the SimHash index: each with its fingerprint's first, and those with their star's."""
    first = materialise(prints.groupBy("fp").agg(F.min("th").alias("first")), "simhash-nodes")
    same = prints.select("th", "fp").distinct().join(first, "fp").where(F.col("th") != F.col("first")).select(F.col("th").alias("u"), F.col("first").alias("v"))
    stars = bucket_edges(buckets(first.select("fp"))).distinct().withColumnsRenamed({"u": "node", "v": "star"})
    one, two = first.select(F.col("fp").alias("node"), F.col("first").alias("u")), first.select(F.col("fp").alias("star"), F.col("first").alias("v"))
    return same.unionByName(stars.join(one, "node").join(two, "star").select("u", "v"))


def nearest_leaders(pairs: DataFrame) -> DataFrame:
    """u, v of ``pairs``, of those with leaders only the nearest of each node."""
    led = pairs.where("key is not null and u <> v").groupBy("v").agg(F.min(F.struct("bits", "u")).alias("k"))
    return pairs.where("key is null").select("u", "v").unionByName(led.select("k.u", "v"))


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text of ``nodes``, one row each."""
    texts = only(docs, "text").withColumn("node", F.xxhash64("text")).join(nodes, "node", "left_semi")
    return materialise(texts.groupBy("node").agg(F.first("text").alias("text")), "candidate-texts")


def checked(docs: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs u, v (hashes of texts) that are similar, by their texts."""
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    asked = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    texts = texts_of(docs, asked)
    one = texts.select(F.col("node").alias("u"), F.col("text").alias("a"))
    two = texts.select(F.col("node").alias("v"), F.col("text").alias("b"))
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        kept: dict[int, np.ndarray] = {}

        def of(node: int, text: bytes) -> np.ndarray:
            if node not in kept:
                if len(kept) >= 256:
                    kept.clear()
                kept[node] = shingles(text)
            return kept[node]

        for b in slices(batches):
            u, v = b.column(0).to_pylist(), b.column(1).to_pylist()
            ok = [similar(of(i, s), of(j, t), similarity) for i, j, s, t in zip(u, v, utf8(b.column(2)), utf8(b.column(3)), strict=True)]
            yield batch(schema, u=b.column(0).filter(pa.array(ok, pa.bool_())), v=b.column(1).filter(pa.array(ok, pa.bool_())))

    return arrow_map(pairs.join(one, "u").join(two, "v").select("u", "v", "a", "b"), run, "u long, v long")


def runs_of(batches, keys: int):
    """The runs of equal values in the first ``keys`` columns of sorted batches."""
    held = None
    for b in batches:
        held = b if held is None else pa.concat_batches([held, b])
        key = np.stack([held.column(k).to_numpy(zero_copy_only=False) for k in range(keys)])
        edge = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()]
        for x, y in pairwise(edge):
            yield held.slice(x, y - x)
        held = held.slice(edge[-1])
    if held is not None and held.num_rows:
        yield held


def all_prints(column: pa.Array) -> np.ndarray:
    """Fingerprints of a column of lists, a row for each node."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, PRINTS)


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent``, each node's root, once each of ``a`` is with its one of ``b``."""
    while True:
        x, y = parent[a], parent[b]
        differ = x != y
        if not differ.any():
            return parent
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def bucket_stars(rows: DataFrame) -> DataFrame:
    """``rows``: key, node, root, prints. Stars u, v over what each bucket's near pairs of different roots, within ``FAR`` bits, connect."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    dealt = rows.repartition("key").sortWithinPartitions("key", "node").select("key", "node", "root", "prints")

    def run(batches):
        for b in runs_of(batches, 1):
            nodes, roots, prints = b.column(1).to_numpy(), b.column(2).to_numpy(), all_prints(b.column(3))
            parent = np.arange(len(nodes))
            for i, j in near_pairs(roots, np.ascontiguousarray(prints[:, :2].T)):
                for k in range(0, len(i), 1 << 16):
                    x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                    apart = parent[x] != parent[y]
                    x, y = x[apart], y[apart]
                    close = np.bitwise_count(prints[x] ^ prints[y]).sum(axis=1) <= FAR
                    parent = unite(parent, x[close], y[close])
            other = np.flatnonzero(parent != np.arange(len(nodes)))
            if len(other):
                yield batch(schema, u=pa.array(nodes[other]), v=pa.array(nodes[parent[other]]))

    return arrow_map(dealt, run, "u long, v long")


def block_rows(stars: DataFrame) -> DataFrame:
    """Nodes of the stars' components, each with its part and once for each block (a, b: its parts) it is in."""
    linked = materialise(components(stars), "candidate-groups")
    nodes = linked.select("node", F.col("root").alias("group")).unionByName(linked.select(F.col("root").alias("node"), F.col("root").alias("group")).distinct())
    # few rows: a group in it has more than BLOCK nodes
    large = nodes.groupBy("group").count().where(F.col("count") > BLOCK).select("group", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    placed = nodes.join(F.broadcast(large), "group", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "node"), "parts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    each = placed.select("node", "group", "part", other)
    return each.select("group", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "node")


def block_links(blocks: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``blocks``: group, a, b, part, root, node, prints, text. Links u, v of each block that connect its similar nodes of different roots."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    dealt = blocks.repartition("group", "a", "b").sortWithinPartitions("group", "a", "b", "node").select("group", "a", "b", "part", "root", "node", "prints", "text")

    def run(batches):
        for rows in runs_of(batches, 3):
            part, root, nodes = (rows.column(k).to_numpy() for k in (3, 4, 5))
            first, last = rows.column(1)[0].as_py(), rows.column(2)[0].as_py()
            prints, sets = all_prints(rows.column(6)), [shingles(t) for t in utf8(rows.column(7))]
            _, root = np.unique(root, return_inverse=True)
            here = np.flatnonzero(part == last)
            i, j, far = [], [], []
            for x in np.flatnonzero(part == first):
                y = here[(root[here] != root[x]) & ((here > x) | (first != last))]
                bits = np.bitwise_count(prints[x] ^ prints[y]).sum(axis=1)
                y, bits = y[bits <= FAR], bits[bits <= FAR]
                i.append(np.full(len(y), x))
                j.append(y)
                far.append(bits)
            if not i:
                continue
            order = np.argsort(np.concatenate(far), kind="stable")
            us, vs = [], []
            for x, y in zip(np.concatenate(i)[order].tolist(), np.concatenate(j)[order].tolist(), strict=True):
                if root[x] != root[y] and similar(sets[x], sets[y], similarity):
                    us.append(nodes[x])
                    vs.append(nodes[y])
                    root[root == root[y]] = root[x]
            yield batch(schema, u=pa.array(us, pa.int64()), v=pa.array(vs, pa.int64()))

    return arrow_map(dealt, run, "u long, v long")


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th and node of each row of ``docs``; n and root, the smallest th of its component, of linked nodes)."""
    prints = materialise(sketches(docs), "sketches")
    rows = bucket_rows(prints)
    pairs = bucket_pairs(rows.withColumn("root", F.col("node")), 0)  # nothing is joined yet
    pairs = materialise(pairs.unionByName(simhash_pairs(prints), allowMissingColumns=True), "pairs")
    edges = materialise(checked(docs, nearest_leaders(pairs), similarity), "links")
    roots = components(edges)
    dense = pairs.where("key is not null").select("key").distinct()
    if not dense.isEmpty():
        # all nodes of such a bucket, those of a leader's component too
        nodes = prints.groupBy(F.col("th").alias("node")).agg(F.first("prints").alias("prints"))
        nodes = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "prints")
        stars = materialise(bucket_stars(rows.join(dense, "key", "left_semi").select("key", "node").join(nodes, "node")), "stars")
        blocks = materialise(block_rows(stars), "blocks")
        of = nodes.join(texts_of(docs, blocks.select("node").distinct()), "node")
        edges = edges.unionByName(materialise(block_links(blocks.join(of, "node"), similarity), "links"))
        roots = components(edges)
    return prints.select("doc_id", "th", F.col("th").alias("node")), roots.select(F.col("node").alias("n"), "root")


def one_of_each_similar(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group, chosen as by ``simhash.one_of_each_group``."""
    return first_of_groups(docs, *similar_groups(docs, similarity))
