"""Exact substring dedup: bytes covered by a string of ``LENGTH`` bytes that starts earlier.

Texts are UTF-8 bytes. A start p is *later* if its next 100 bytes also start earlier (a
smaller doc_id, or the same document before p). Every byte under a later window goes; this
is judged on the input. Equal windows are found by suffix sorting with common prefixes
(``induced``); the rest only brings the suffixes that can share 100 bytes to one shard:

1. Each window belongs to the least hash among its 40-byte strings. Consecutive windows of
   one such hash make a segment. Equal windows have equal least hashes, so they meet by it.
2. Segments equal as a whole need no sorting: all but the first are later in every window. That
   is a pre-aggregation by 128 bits, the least hash and a hash of the segment; on the tables of
   sf0.1 it settles 57 % of the removed bytes, most of them in exact copies of documents.
   Each worker settles this among ``BUFFER`` segments before anything is shuffled, then it is
   settled for all, in one pass over sorted rows that holds a single row.
3. Segments whose hash has no other content, and its first string in all windows, repeat nothing.
   The others get their bytes and go to a shard by the hash; there the suffixes of
   ``SHARD`` bytes or more of whole groups are sorted, and runs of common prefixes of 100
   or more are equal windows. Equal windows have the string of the least hash at equal places, so
   a segment's bytes further from it than those that another segment shares are left out
   before; a segment without enough shared bytes has no equal window.
4. A group of over ``HOT`` different segments (the borders of a passage in very many
   documents) is dealt more finely before it is sorted: its windows by where the string of
   the least hash lies in them, to within 16, then 4, then 1 byte, and by the bytes that all windows of
   such a class have in common. Equal windows stay together, steps 2 and 3 are the same.

Hashes that are common (by a sample of a 64th of the documents, which changes no result) are dealt
by content from the start, so no task reads all segments of such a hash.

Cases. Null and empty texts have no bytes; texts below 100 bytes have no window. Rows with
equal id and text are one document and don't remove each other; rows of one id with other
texts are ordered by a hash of the text. Null ids come last, ordered by 127 bits of their texts' hashes. Kept bytes may cut a character
in two; the kept text is what decodes, its hash is that of the bytes. An empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, batch, keyed, only, slices, spread, utf8
from tidemark.llm.induced import falling_suffixes
from tidemark.session import materialise

LENGTH, KEY = 100, 40
WIDTH = LENGTH - KEY + 1
BUFFER, HOT, SHARD = 100_000, 2000, 3 << 20
#: Bytes of texts that are hashed at once.
PORTION = 1 << 17
#: Widths of the classes that hot groups are dealt by, one after another.
CLASSES = (16, 4, 1)
#: A hash is common if it has so many segments in a sample of this part; at most so many hashes are treated so.
SAMPLE, COMMON, MOST_COMMON = 1 / 64, 32, 10_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

# multi: bit 0, the first string of the least hash is not in all windows; bit 1, the group is known to have other
# contents; above, one more than the place of that string, if it is in all windows; -1: later as a whole
SEGMENTS = "part long, mh long, ch long, did long, th long, start int, len int, multi int"
STATES = "kind int, mh long, did long, th long, start int, len int, multi int"
PIECES = "part long, did long, th long, start int, at int, bytes binary"
CUTS = "did long, th long, start int, len int"


def key_hashes(x: np.ndarray) -> np.ndarray:
    """A hash of the ``KEY`` bytes from each place on, eight bytes at a time."""
    n = len(x) - KEY + 1
    x = np.ascontiguousarray(x)
    u = np.ndarray(len(x) - 7, "<u8", x.data, 0, (1,)).astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for at in range(0, KEY, 8):
        h ^= u[at : at + n]
        h *= _A
        h ^= h >> np.uint64(31)
    h *= _B
    return h ^ (h >> np.uint64(29))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    m, p = h, 1
    while p * 2 <= width:
        m = np.minimum(m[:-p], m[p:])
        p *= 2
    rest = width - p
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def portions(texts: list[bytes]) -> Iterator[list[int]]:
    """Numbers of the texts that have a window, some ``PORTION`` bytes at a time."""
    at, size = [], 0
    for k, t in enumerate(texts):
        if len(t) >= LENGTH:
            at.append(k)
            size += len(t)
            if size >= PORTION:
                yield at
                at, size = [], 0
    if at:
        yield at


def segments_of(texts: list[bytes], contents: bool = True) -> Iterator[np.ndarray]:
    """Columns least hash, content hash, number of the text, start, length and multi of the segments; many texts at once."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    for which in portions(texts):
        sizes = np.array([len(texts[k]) for k in which], np.int64)
        begin = np.cumsum(sizes) - sizes
        joined = b"".join([texts[k] for k in which])
        h = key_hashes(np.frombuffer(joined, np.uint8))
        m = sliding_min(h, WIDTH)
        # windows over two texts are left out below, so their hashes don't matter
        new = np.concatenate([[True], m[1:] != m[:-1]])
        new[begin] = True
        past = begin + sizes - LENGTH + 1
        new[past[:-1]] = True
        first = np.flatnonzero(new)
        end = np.append(first[1:], len(m))
        of = np.searchsorted(begin, first, side="right") - 1
        inside = first < past[of]
        first, end, of = first[inside], end[inside], of[inside]
        mh = m[first]
        # the first place of the least hash: where it came in, the last of the first window, else looked for
        place = first + WIDTH - 1
        look = np.flatnonzero((first == begin[of]) | (mh > m[first - 1]))
        place[look] = first[look] + (np.lib.stride_tricks.sliding_window_view(h, WIDTH)[first[look]] == mh[look, None]).argmax(axis=1)
        # windows past that place have the hash from another one
        again = place < end - 1
        size = end - first + LENGTH - 1
        ch = np.array([digest(joined[a:e]) for a, e in zip(first.tolist(), (first + size).tolist(), strict=True)] if contents else np.zeros(len(first)), np.uint64)
        yield np.stack([mh.view(np.int64), ch.view(np.int64), np.array(which, np.int64)[of], first - begin[of], size, np.where(again, 1, (place - first + 1) << 2)])


def segments(text: bytes) -> list[tuple[int, int, int, int, int]]:
    """(least hash, content hash, start, length, multi) of one text's segments."""
    return [tuple(s) for found in segments_of([text]) for s in found[[0, 1, 3, 4, 5]].T.tolist()]


def finer(piece: bytes, start: int, key: int, at: int, width: int) -> list[tuple[int, int, int, int, int]]:
    """(key, content hash, start, length, multi) of a segment's parts whose windows have the string of the least hash in one class of places.

    ``at``: the place of that string in the piece, or -1 where ``key`` is its hash.
    """
    import xxhash

    n = len(piece) - LENGTH + 1
    starts = np.arange(n)
    if at < 0:
        places = np.flatnonzero(key_hashes(np.frombuffer(piece, np.uint8)).view(np.int64) == key)
        place = places[np.searchsorted(places, starts)]
    else:
        place = np.full(n, at)
    ahead = place - starts
    cls = ahead // width
    cut = np.concatenate([[0], np.flatnonzero((place[1:] != place[:-1]) | (cls[1:] != cls[:-1])) + 1, [n]])
    sign = 1 << 63
    out = []
    for a, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        p, c = int(place[a]), int(cls[a])
        core = piece[p - c * width : p - min(WIDTH - 1, c * width + width - 1) + LENGTH]
        fine = xxhash.xxh3_64_intdigest(core, 64 * width + c)
        content = xxhash.xxh3_64_intdigest(piece[a : e + LENGTH - 1])
        out.append(((fine ^ sign) - sign, (content ^ sign) - sign, start + a, e - a + LENGTH - 1, 2 | (p - a + 1) << 2))
    return out


def _later(rows: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by ``keys`` columns, then place (three columns); which are at another place than their key's first."""
    did, th, start = rows[keys : keys + 3]
    rows = rows[:, np.lexsort((start, th, did, th >= 0, *rows[:keys][::-1]))]
    new = np.concatenate([[True], (rows[:keys, 1:] != rows[:keys, :-1]).any(axis=0)])
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return rows, (rows[keys : keys + 3] != rows[keys : keys + 3, first]).any(axis=0)


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in text.split(", "))])


def _numpy(b: pa.RecordBatch, columns: int) -> np.ndarray:
    return np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(columns)])


def common_hashes(rows: DataFrame) -> np.ndarray:
    """Least hashes of very many segments, by a sample; they are only dealt otherwise."""
    schema = pa.schema([("mh", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for b in slices(batches):
            found = [s[0] for s in segments_of(utf8(b.column(0)), False)]
            if found:
                mh, n = np.unique(np.concatenate(found), return_counts=True)
                yield batch(schema, mh=pa.array(mh), n=pa.array(n))

    counted = arrow_map(rows.sample(SAMPLE, seed=11).select("text"), run, "mh long, n long").groupBy("mh").agg(F.sum("n").alias("n"))
    most = counted.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "mh").limit(MOST_COMMON)
    return np.sort(np.array([r.mh for r in most.collect()], np.int64))


def _settled(held: list[np.ndarray], schema: pa.Schema, common: np.ndarray | None) -> pa.RecordBatch:
    """Segments with what is known to be later marked; ``common``: hashes dealt by content, None for all."""
    got = np.concatenate(held, axis=1)
    got = got[:, np.argsort(got[1], kind="stable")]
    twice = np.concatenate([[False], got[1, 1:] == got[1, :-1], [False]])
    some = np.flatnonzero(twice[1:] | twice[:-1])
    later = np.zeros(got.shape[1], bool)
    if len(some):
        got[:, some], later[some] = _later(got[:, some], 2)
    by_content = np.ones(got.shape[1], bool) if common is None else np.isin(got[0], common)
    got[6, by_content] |= 2
    got[6, later] = -1
    # later ones are dealt by document, not by the hash they share
    part = np.where(later, got[2] * 0x9E3779B1 + got[4], np.where(by_content, got[0] + got[1] * 0x9E3779B1, got[0]))
    return batch(schema, **{n: pa.array(c.astype(np.int32) if k > 4 else c) for k, (n, c) in enumerate(zip(schema.names, [part, *got], strict=True))})


def segment_rows(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """Segments that may be first, and those that a worker knows to be later (multi = -1)."""
    schema = _schema(SEGMENTS)

    def run(batches):
        held: list[np.ndarray] = []
        n = 0
        for b in slices(batches):
            place = _numpy(b, 2)
            for mh, ch, of, *more in segments_of(utf8(b.column(2))):
                held.append(np.stack([mh, ch, *place[:, of], *more]))
                n += len(mh)
                if n >= BUFFER:
                    yield _settled(held, schema, common)
                    held, n = [], 0
        if held:
            yield _settled(held, schema, common)

    return arrow_map(rows.select("_did", "_th", "text"), run, SEGMENTS)


def with_bytes(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """_did, _th, text and the array ``asked`` of (mh, start, len, multi) of each document that has some."""
    per = asked.groupBy(F.col("did").alias("a_did"), F.col("th").alias("a_th")).agg(F.collect_list(F.struct("mh", "start", "len", "multi")).alias("asked"))
    return rows.join(per, (F.col("_did") == F.col("a_did")) & (F.col("_th") == F.col("a_th"))).select("_did", "_th", "text", "asked")


def finer_rows(rows: DataFrame, hot: DataFrame, width: int) -> DataFrame:
    """The segments of hot groups, cut and dealt by finer keys."""
    schema = _schema(SEGMENTS)

    def run(batches):
        held: list[tuple] = []
        for b in slices(batches, 200):
            for did, th, t, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), b.column(3).to_pylist(), strict=True):
                for x in asked:
                    a = x["start"]
                    held.extend((k, c, did, th, p, n, m) for k, c, p, n, m in finer(t[a : a + x["len"]], a, x["mh"], (x["multi"] >> 2) - 1, width))
                if len(held) >= BUFFER:
                    yield _settled([np.array(held, np.int64).T], schema, None)
                    held = []
        if held:
            yield _settled([np.array(held, np.int64).T], schema, None)

    return arrow_map(with_bytes(rows, hot), run, SEGMENTS)


def segment_states(segment: DataFrame) -> DataFrame:
    """kind 0: later as a whole; kind 1: first of its content, in a group that may need sorting."""
    schema = _schema(STATES)
    order = ["mh", "ch", F.col("th") >= 0, "did", "th", "start"]
    dealt = segment.repartition("part").sortWithinPartitions(*order).select("mh", "ch", "did", "th", "start", "len", "multi")
    kept = [0, 2, 3, 4, 5, 6]

    def run(batches):
        lead = None  # first row of the content at hand: mh, ch, did, th, start, len, multi
        told = False  # whether that row was given out
        for b in batches:
            got = _numpy(b, 7)
            done = got[6] == -1
            out = [np.stack([np.zeros(done.sum(), np.int64), *got[kept][:, done]])]
            rows = got[:, ~done]
            if lead is not None:
                rows = np.concatenate([lead[:, None], rows], axis=1)
            n = rows.shape[1]
            if n:
                group = np.concatenate([[True], rows[0, 1:] != rows[0, :-1]])
                content = group | np.concatenate([[True], rows[1, 1:] != rows[1, :-1]])
                first = np.maximum.accumulate(np.where(content, np.arange(n), 0))
                later = (rows[2:5] != rows[2:5, first]).any(axis=0)
                out.append(np.stack([np.zeros(later.sum(), np.int64), *rows[kept][:, later]]))
                # contents of a group: its number tells whether there is a second one
                number = np.cumsum(content)
                base = np.maximum.accumulate(np.where(group, number, 0))
                nth = number - base + np.where((np.cumsum(group) == 1) & told, 1, 0)
                firsts = np.flatnonzero(content)
                group_of = np.cumsum(group)
                most = np.zeros(group_of[-1] + 1, np.int64)
                np.maximum.at(most, group_of, nth)
                needed = (most[group_of[firsts]] > 0) | (rows[6, firsts] & 3 > 0)
                fresh = firsts[needed & ~(told & (firsts == 0))]
                out.append(np.stack([np.ones(len(fresh), np.int64), *rows[kept][:, fresh]]))
                lead = rows[:, first[-1]].copy()
                told = bool(needed[-1]) or (bool(first[-1] == 0) and told)
            res = np.concatenate(out, axis=1)
            if res.shape[1]:
                yield batch(schema, **{name: pa.array(res[k].astype(np.int64 if k in (1, 2, 3) else np.int32)) for k, name in enumerate(schema.names)})

    return arrow_map(dealt, run, STATES)


def sort_groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments that are later as a whole, segments to be sorted, no group of which is hot)."""
    states = materialise(segment_states(segment_rows(spread(rows), common_hashes(rows))), "segments")
    settled, asked = states.where("kind = 0").drop("kind"), states.where("kind = 1").drop("kind")
    cold = None
    for width in (*CLASSES, 0):
        sizes = materialise(asked.groupBy(F.col("mh").alias("g")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > (1 if cold is not None else HOT)), "group-sizes")
        hot = sizes.where(F.col("n") > HOT)
        if cold is None:
            less = asked.join(hot, F.col("mh") == F.col("g"), "left_anti")
        else:
            # a content that is alone in its class repeats nothing
            less = asked.join(sizes.where(F.col("n") <= HOT), F.col("mh") == F.col("g"), "left_semi")
        cold = less if cold is None else cold.unionByName(less)
        if hot.isEmpty():
            break
        # of one byte all windows of a class are equal, so none is hot
        states = materialise(segment_states(finer_rows(rows, asked.join(hot, F.col("mh") == F.col("g"), "left_semi"), width)), "finer-segments")
        settled, asked = settled.unionByName(states.where("kind = 0").drop("kind")), states.where("kind = 1").drop("kind")
    return settled, cold


def piece_rows(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Bytes of the segments to be sorted."""
    schema = _schema(PIECES)

    def run(batches):
        for b in slices(batches, 200):
            out = [(x["mh"], did, th, x["start"], (x["multi"] >> 2) - 1, t[x["start"] : x["start"] + x["len"]]) for did, th, t, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), b.column(3).to_pylist(), strict=True) for x in asked]
            if out:
                yield batch(schema, **dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)))

    return arrow_map(with_bytes(rows, asked), run, PIECES)


def sort_shard(pieces: list[tuple[int, int, int, bytes]], memory: int | None = None) -> Iterator[np.ndarray]:
    """Later windows (did, th, start) among segments, by their suffixes."""
    sizes = np.array([len(p[3]) for p in pieces], np.int64)
    # 0 ends the text, 1 ends a segment, bytes follow
    text = np.ones(int(sizes.sum()) + len(pieces) + 1, np.uint16)
    begin = np.cumsum(sizes + 1) - sizes - 1
    inside = np.ones(len(text), bool)
    inside[begin + sizes] = False
    inside[-1] = False
    text[inside] = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8).astype(np.uint16) + 2
    text[-1] = 0
    place = np.array([[p[0], p[1], p[2]] for p in pieces], np.int64).T

    def later(at: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        # equal windows stand side by side with prefixes of LENGTH
        same = lcp >= LENGTH
        member = np.flatnonzero(same | np.concatenate([same[1:], [False]]))
        cls, at = np.cumsum(~same)[member], at[member]
        of = np.searchsorted(begin, at, side="right") - 1
        fits = at + LENGTH <= begin[of] + sizes[of]
        cls, at, of = cls[fits], at[fits], of[fits]
        if not len(at):
            return np.zeros((3, 0), np.int64)
        where = place[:, of]
        where[2] += at - begin[of]
        rows, gone = _later(np.concatenate([cls[None], where]), 1)
        return rows[1:, gone]

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for at, lcp in falling_suffixes(text, 258, LENGTH, *([memory] if memory else [])):
        new = np.flatnonzero(lcp < LENGTH)
        if not len(new):
            held.append((at, lcp))
            continue
        # the last class may go on in the next block
        k = int(new[-1])
        yield later(*(np.concatenate(c) for c in zip(*held, (at[:k], lcp[:k]), strict=True)))
        held = [(at[k:], lcp[k:])]
    yield later(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _shared(group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The most leading bytes that each row shares with another one of its group."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    order = np.lexsort((*wide.view(">u8").T[::-1], group))
    wide, group = wide[order], group[order]
    other = np.ones((len(rows) - 1, wide.shape[1] + 1), bool)
    other[:, :-1] = wide[1:] != wide[:-1]
    same = np.where(group[1:] == group[:-1], other.argmax(axis=1), 0)
    out = np.empty(len(rows), np.int64)
    out[order] = np.maximum(np.append(0, same), np.append(same, 0))
    return out


def shared_parts(pieces: list[tuple[int, int, int, int, int, bytes]]) -> list[tuple[int, int, int, bytes]]:
    """(did, th, start, bytes) of what has to be sorted of whole groups of (part, did, th, start, at, bytes).

    ``at``: the place of the string of the least hash, the first in all windows of the piece, or -1 if there is
    no such place. Equal windows have that string at equal places, so they reach no further from it than
    the bytes before it, and those after it, are shared with another piece of the group.
    """
    part = np.array([p[0] for p in pieces], np.int64)
    at = np.array([p[4] for p in pieces], np.int64)
    size = np.array([len(p[5]) for p in pieces], np.int64)
    text = np.frombuffer(b"".join(p[5] for p in pieces), np.uint8)
    begin = np.cumsum(size) - size
    # a piece without such a place may share any of its windows with any other of its group
    fixed = ~np.isin(part, part[at < 0])
    low, high = np.zeros(len(pieces), np.int64), size.copy()
    k = np.flatnonzero(fixed)
    if len(k):
        step = np.arange(WIDTH - 1)
        before, behind = at[k, None] - 1 - step, at[k, None] + KEY + step
        back = np.where(before >= 0, text[begin[k, None] + np.maximum(before, 0)], 0)
        ahead = np.where(behind < size[k, None], text[begin[k, None] + np.minimum(behind, size[k, None] - 1)], 0)
        # what lies beyond a piece is 0, which only makes more of it be kept
        low[k] = np.maximum(0, at[k] - _shared(part[k], back).clip(max=WIDTH - 1))
        high[k] = np.minimum(size[k], at[k] + KEY + _shared(part[k], ahead).clip(max=WIDTH - 1))
    some = np.flatnonzero(high - low >= LENGTH)
    return [(did, th, start + a, piece[a:e]) for (_, did, th, start, _, piece), a, e in zip((pieces[i] for i in some.tolist()), low[some].tolist(), high[some].tolist(), strict=True)]


def window_cuts(pieces: DataFrame) -> DataFrame:
    """Runs of later windows (did, th, start, len in bytes) among the pieces."""
    schema = _schema(CUTS)
    dealt = pieces.repartition("part").sortWithinPartitions("part")

    def out(places: np.ndarray):
        """Consecutive starts make one run."""
        if not places.shape[1]:
            return
        p = places[:, np.lexsort(places[::-1])]
        new = np.concatenate([[True], (p[:2, 1:] != p[:2, :-1]).any(axis=0) | (p[2, 1:] > p[2, :-1] + LENGTH)])
        at = np.flatnonzero(new)
        last = np.concatenate([at[1:], [p.shape[1]]]) - 1
        yield batch(schema, did=pa.array(p[0, at]), th=pa.array(p[1, at]), start=pa.array(p[2, at].astype(np.int32)), len=pa.array((p[2, last] - p[2, at] + LENGTH).astype(np.int32)))

    def cuts(shard: list[tuple]):
        shared = shared_parts(shard)
        for found in sort_shard(shared) if shared else ():
            yield from out(found)

    def run(batches):
        shard: list[tuple[int, int, int, int, int, bytes]] = []
        size, part = 0, None
        for b in batches:
            for piece in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if size >= SHARD and piece[0] != part:
                    yield from cuts(shard)
                    shard, size = [], 0
                part = piece[0]
                shard.append(piece)
                size += len(piece[-1])
        if shard:
            yield from cuts(shard)

    return arrow_map(dealt, run, CUTS)


def byte_cuts(docs: DataFrame) -> DataFrame:
    """did, th, start, len: byte ranges to remove; they may overlap."""
    rows = keyed(docs, "text")
    settled, asked = sort_groups(rows)
    cuts = window_cuts(materialise(piece_rows(rows, asked), "pieces"))
    return settled.select("did", "th", "start", "len").unionByName(cuts)


def removed_runs(cuts: pa.ListArray) -> list[list[tuple[int, int]]]:
    """The maximal removed runs (start, end) of each row's list of cuts (start, len); null is none."""
    counts = pc.fill_null(pc.list_value_length(cuts), 0).to_numpy()
    flat = cuts.flatten()
    start, size = (flat.field(n).to_numpy().astype(np.int64) for n in ("start", "len"))
    # a row's places are all below the next row's
    row = np.repeat(np.arange(len(counts), dtype=np.int64), counts) << 32
    begin, end = row + start, row + start + size
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(begin)), bool), begin[1:] > end[:-1]]))
    begin, end = begin[new], end[np.append(new[1:], len(end)) - 1] if len(new) else end
    edges = np.searchsorted(begin, np.arange(len(counts) + 1, dtype=np.int64) << 32)
    runs = list(zip((begin & 0xFFFFFFFF).tolist(), (end & 0xFFFFFFFF).tolist(), strict=True))
    return [runs[a:e] for a, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def cut_bytes(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What is left of a text without the runs."""
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
    cuts = byte_cuts(only(docs, "doc_id", "text")).groupBy(F.col("did").alias("c_did"), F.col("th").alias("c_th")).agg(F.collect_set(F.struct("start", "len")).alias("cuts"))
    joined = keyed(docs, "doc_id", "text").join(cuts, (F.col("_did") == F.col("c_did")) & (F.col("_th") == F.col("c_th")), "left").select("doc_id", "text", "cuts")

    def run(batches):
        for b in slices(batches):
            texts = utf8(b.column(1))
            runs = removed_runs(b.column(2))
            kept = [cut_bytes(t, r) for t, r in zip(texts, runs, strict=True)]
            yield batch(schema, doc_id=b.column(0), n_bytes=list(map(len, texts)), n_removed=[len(t) - len(k) for t, k in zip(texts, kept, strict=True)], n_spans=list(map(len, runs)), kept_sha256=[hashlib.sha256(k).hexdigest() for k in kept], kept=kept)

    return arrow_map(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).drop("kept")
