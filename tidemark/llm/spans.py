"""Substring dedup over sliding sentence spans.

Words are what stands between ASCII white space. A text is cut into sentences at ``.``, ``!`` or ``?`` before white space and at line feeds, and
sentences into pieces after each word whose hash is the least of the ``NEAR`` words on either
side. So a passage is cut alike wherever it stands, but for a few words at its ends. A piece of
over ``LONG`` words, as repetition makes, is cut on after every ``LONG``. Below, sentences are
these pieces. A span is a run of consecutive sentences, the shortest from each
sentence on, and the shortest up to each, of at least ``SENTENCES`` sentences and ``WORDS``
words. Every span is hashed (96 bits, from sums of its words' XXH3 times powers, A-Z lower-cased) and
joined globally. The first occurrence, by doc_id and then place, stays; sentences covered by
any other are removed. What is removed is judged on the input.

Scale. Each worker pre-aggregates: of equal spans among ``BUFFER`` that it holds, only the
first goes on to the join, the others are known not to be first. So a passage in a third of
all documents sends one row for each buffer to its task, not one for each document. Rows
meet sorted by hash and are read in one pass; no group is gathered. Removals return to their
documents by a join.

Cases. Null or empty text has no sentences; null stays null. Texts with too few sentences or
words have no spans and stay whole. Rows with equal id and text are one document: none of
them loses to the other. Rows of one id with other texts are told apart by 63 bits of a hash of the
text and ordered by it. Null ids come last, told apart and ordered by 127 bits of their texts' hashes. An empty table gives no rows. Extra columns are
kept by ``deduplicated``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, arrow_map, batch, free_names, keyed, only, slices, spread, utf8

SENTENCES, WORDS, LONG, NEAR = 3, 25, 16, 2
BUFFER = 300_000
#: Bytes of documents that are cut at once.
CHUNK = 1 << 18
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\v\f"))
_STOP = np.isin(np.arange(256), list(b".!?"))


class _Powers:
    """Powers of the bases and of their inverses, modulo 2^64, as far as they were needed."""

    def __init__(self):
        self.tables = [np.ones(1, np.uint64)] * 4

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) <= n:
            size = max(n + 1, 2 * len(self.tables[0]), 1 << 16)
            bases = (*_BASES, *(pow(b, -1, 1 << 64) for b in _BASES))
            self.tables = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in bases]
        return self.tables


_POWERS = _Powers()


class Pieces:
    """Several texts (UTF-8) cut into sentences and these into pieces, all at once."""

    def __init__(self, texts: list[bytes]):
        import xxhash

        joined = b"\n".join(texts)
        low = joined.translate(LOWER)
        #: where each text begins in ``joined``
        self.begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        x = np.frombuffer(b"\n" + low + b"\n", np.uint8)
        space = _SPACE[x]
        self.starts = np.flatnonzero(space[:-1] & ~space[1:])
        self.ends = np.flatnonzero(~space[:-1] & space[1:])
        n = len(self.starts)
        self.marks = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, low.split())), "<u8").reshape(-1, 2)
        if n:
            end = _STOP[x[self.ends]]
            lines = np.cumsum(x == 10)
            end[:-1] |= lines[self.ends[:-1]] != lines[self.starts[1:]]
            end[-1] = True
            if n > 2 * NEAR:
                h = self.marks[:, 0]
                mid = h[NEAR : n - NEAR]
                least = np.ones(len(mid), bool)
                for k in range(1, NEAR + 1):
                    least &= (mid < h[NEAR - k : n - NEAR - k]) & (mid <= h[NEAR + k : n - NEAR + k])
                sentence = np.cumsum(end) - end
                end[NEAR : n - NEAR] |= least & (sentence[: n - 2 * NEAR] == sentence[2 * NEAR :])
            cut = np.concatenate([[0], np.flatnonzero(end) + 1])
            size = np.diff(cut)
            if (size > LONG).any():
                parts = -(-size // LONG)
                within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                cut = np.append(np.repeat(cut[:-1], parts) + LONG * within, n)
        else:
            cut = np.zeros(1, np.int64)
        #: word numbers at which pieces begin, and the last ends
        self.cut = cut
        # a text's pieces: first[t] to first[t + 1]
        self.first = np.searchsorted(self.starts[cut[:-1]] if n else cut[:0], self.begin)

    def span_rows(self) -> np.ndarray:
        """Columns high and low part of the hash, text, its first piece and number of pieces of every span."""
        m = len(self.cut) - 1
        if m < SENTENCES:
            return np.zeros((5, 0), np.int64)
        i = np.arange(m + 1)
        at = self.cut
        text = np.searchsorted(self.first, i[:-1], side="right") - 1
        ahead = np.maximum(np.searchsorted(at, at[:-1] + WORDS), i[:-1] + SENTENCES)
        back = np.minimum(np.searchsorted(at, at[1:] - WORDS, side="right") - 1, i[1:] - SENTENCES)
        fits, reaches = ahead <= self.first[text + 1], back >= self.first[text]
        pairs = np.unique(np.concatenate([i[:-1][fits] * (m + 1) + ahead[fits], back[reaches] * (m + 1) + i[1:][reaches]]))
        a, b = pairs // (m + 1), pairs % (m + 1)
        tables = _POWERS.upto(len(self.starts))
        out = []
        for k in range(2):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.marks[:, k] * tables[k][: len(self.starts)])])
            h = (total[at[b]] - total[at[a]]) * tables[2 + k][at[a]]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(_BASES[1 - k])
            out.append(h ^ (h >> np.uint64(29)))
        t = text[a]
        return np.stack([out[0].view(np.int64), out[1].view(np.int64) >> 32, t, a - self.first[t], b - a])

    def places(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of a text begin and end in it, in bytes."""
        a, e = int(self.first[t]), int(self.first[t + 1])
        return self.starts[self.cut[a:e]] - self.begin[t], self.ends[self.cut[a + 1 : e + 1] - 1] - self.begin[t]


def chunks(texts: list[bytes]) -> Iterator[tuple[int, Pieces]]:
    """(number of the first text, its pieces and those of the next ones)."""
    a = size = 0
    for k, t in enumerate(texts):
        size += len(t) + 1
        if size >= CHUNK or k + 1 == len(texts):
            yield a, Pieces(texts[a : k + 1])
            a, size = k + 1, 0


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each piece, in code points; ends don't include white space."""
    data = text.encode()
    starts, ends = Pieces([data]).places(0)
    return [(len(data[:a].decode()), len(data[:e].decode()), [w.decode() for w in data[a:e].split()]) for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def spans(text: str) -> list[tuple[int, int, int, int]]:
    """(high and low part of the hash, first sentence, number of sentences) of every span."""
    return list(map(tuple, Pieces([text.encode()]).span_rows()[[0, 1, 3, 4]].T.tolist()))


# Columns of the rows below: high, low, did, th, first, n
_KEYS = 2


def later_ones(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts rows by hash and place; (sorted rows, which of them aren't at their hash's first place)."""
    high, low, did, th, first = rows[:5]
    rows = rows[:, np.lexsort((first, th, did, th >= 0, low, high))]
    if not rows.shape[1]:
        return rows, np.zeros(0, bool)
    new = np.concatenate([[True], (rows[:_KEYS, 1:] != rows[:_KEYS, :-1]).any(axis=0)])
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return rows, (rows[_KEYS:5] != rows[_KEYS:5, first]).any(axis=0)


ROWS = "high long, low int, did long, th long, first int, n int"


def span_rows(docs: DataFrame) -> DataFrame:
    """Spans that may be first, and pre-aggregated removals (low = null)."""
    schema = pa.schema([("high", pa.int64()), ("low", pa.int32()), ("did", pa.int64()), ("th", pa.int64()), ("first", pa.int32()), ("n", pa.int32())])

    def settle(held: list[np.ndarray]):
        rows, later = later_ones(np.concatenate(held, axis=1))
        keep, drop = rows[:, ~later], rows[:, later]
        yield batch(schema, high=pa.array(keep[0]), low=pa.array(keep[1].astype(np.int32)), did=pa.array(keep[2]), th=pa.array(keep[3]), first=pa.array(keep[4].astype(np.int32)), n=pa.array(keep[5].astype(np.int32)))
        if drop.shape[1]:
            # dealt by document and sentence, not by the hash
            part = (drop[2] * 0x9E3779B1 + drop[4] * 0x85EBCA77).astype(np.int64)
            yield batch(schema, high=pa.array(part), low=pa.nulls(len(part), pa.int32()), did=pa.array(drop[2]), th=pa.array(drop[3]), first=pa.array(drop[4].astype(np.int32)), n=pa.array(drop[5].astype(np.int32)))

    def run(batches):
        held: list[np.ndarray] = []
        size = 0
        for b in slices(batches):
            ids = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(2)])
            for first, pieces in chunks(utf8(b.column(2))):
                found = pieces.span_rows()
                held.append(np.concatenate([found[:2], ids[:, first + found[2]], found[3:]]))
                size += found.shape[1]
                if size >= BUFFER:
                    yield from settle(held)
                    held, size = [], 0
        if held:
            yield from settle(held)

    return arrow_map(keyed(spread(docs), "text").select("_did", "_th", "text"), run, ROWS)


def removals(docs: DataFrame) -> DataFrame:
    """did, th, first, n: sentences covered by spans that aren't first."""
    schema = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("first", pa.int32()), ("n", pa.int32())])
    dealt = span_rows(docs).repartition("high").sortWithinPartitions("high").select("high", "low", "did", "th", "first", "n")

    def out(rows: np.ndarray):
        if rows.shape[1]:
            yield batch(schema, did=pa.array(rows[2]), th=pa.array(rows[3]), first=pa.array(rows[4].astype(np.int32)), n=pa.array(rows[5].astype(np.int32)))

    def run(batches):
        held = np.zeros((6, 0), np.int64)
        for b in batches:
            known = b.column(1).is_null().to_numpy(zero_copy_only=False)
            got = np.stack([(c.fill_null(0) if k == 1 else c).to_numpy(zero_copy_only=False).astype(np.int64) for k, c in enumerate(b.columns)])
            yield from out(got[:, known])
            rows = np.concatenate([held, got[:, ~known]], axis=1)
            # rows of the last hash wait for the next batch: at most one for each buffer of the input
            whole = int(np.searchsorted(rows[0], rows[0, -1])) if rows.shape[1] else 0
            rows, held = rows[:, :whole], rows[:, whole:]
            rows, later = later_ones(rows)
            yield from out(rows[:, later])
        rows, later = later_ones(held)
        yield from out(rows[:, later])

    return arrow_map(dealt, run, "did long, th long, first int, n int")


def removed_spans(docs: DataFrame) -> DataFrame:
    """_did, _th and the removed sentence runs of each document that loses any; a document's own runs only."""
    return removals(docs).groupBy(F.col("did").alias("r_did"), F.col("th").alias("r_th")).agg(F.collect_set(F.struct("first", "n")).alias("r_runs"))


def apply_runs(text: bytes, starts: np.ndarray, cut: list[dict]) -> tuple[int, bytes, list[dict]]:
    """(removed sentences, text left, removed spans in code points) of a text whose pieces begin at ``starts``."""
    gone = np.zeros(len(starts) + 1, np.int64)
    for r in cut:
        gone[r["first"]] += 1
        gone[r["first"] + r["n"]] -= 1
    mask = np.cumsum(gone[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    places, kept, at, points = [], [], 0, 0
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        # up to the next sentence, so its white space goes with it
        start, end = int(starts[a]), int(starts[b]) if b < len(starts) else len(text)
        points += len(text[at:start].decode("utf-8", "replace"))
        begin, points = points, points + len(text[start:end].decode("utf-8", "replace"))
        places.append({"start": begin, "end": points})
        kept.append(text[at:start])
        at = end
    kept.append(text[at:])
    return int(mask.sum()), b"".join(kept), places


def applied(texts: list[bytes], cuts: list[list[dict] | None]) -> list[tuple[int, int, bytes, list[dict]]]:
    """(sentences, removed sentences, text left, removed spans) of each text."""
    out = []
    for first, pieces in chunks(texts):
        sizes = np.diff(pieces.first).tolist()
        for t, n in enumerate(sizes):
            cut, text = cuts[first + t], texts[first + t]
            out.append((n, *apply_runs(text, pieces.places(t)[0], cut)) if cut else (n, 0, text, []))
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with n_sentences, n_removed, kept_text and removed_spans beside their own columns.

    Own columns of those names come first and the new ones get a number behind.
    """
    new = dict(zip(names := ("n_sentences", "n_removed", "kept_text", "removed_spans"), free_names(docs, *names), strict=True))
    # inner names by place, so no column of ``docs`` can be taken for one of ours
    inner = docs.select(*[F.col(f"`{c}`").alias({"doc_id": "doc_id", "text": "text"}.get(c, f"c{k}")) for k, c in enumerate(docs.columns)])
    cut = removed_spans(only(docs, "doc_id", "text"))
    joined = keyed(inner, *inner.columns).join(cut, (F.col("_did") == F.col("r_did")) & (F.col("_th") == F.col("r_th")), "left").select(*inner.columns, "r_runs")
    at = docs.columns.index("text")
    columns = docs.columns
    own = len(columns)
    added = pa.schema([("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches):
        for b in slices(batches):
            rows = applied(utf8(b.column(at)), b.column(own).to_pylist())
            null = b.column(at).is_null().to_pylist()
            rows = [(n, gone, None if no else kept.decode("utf-8", "replace"), found) for (n, gone, kept, found), no in zip(rows, null, strict=True)]
            more = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), added, strict=True)] if rows else [pa.nulls(0, f.type) for f in added]
            yield pa.RecordBatch.from_arrays([*b.columns[:own], *more], names=[*columns, *new.values()])

    from pyspark.sql import types as T

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kinds = (T.LongType(), T.LongType(), T.StringType(), span)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(new.values(), kinds, strict=True))])
    return arrow_map(joined, run, schema)


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, sentences, removed sentences, length and SHA-256 of the text left, removed spans."""
    done = deduplicated(only(docs, "doc_id", "text"))
    left = F.coalesce("kept_text", F.lit(""))
    return done.select("doc_id", "n_sentences", "n_removed", F.length(left).cast("long").alias("kept_chars"), F.sha2(left, 256).alias("kept_sha256"), "removed_spans")
