"""Benchmark decontamination with one Aho-Corasick automaton.

Words of a text are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are
lower-cased: digits, a-z and everything beyond ASCII. A benchmark item gives its windows of
``window`` consecutive words, an item of fewer words (but not none) one window of all of
them. The windows of all items, single-blanked and with a blank at either end, are the
patterns of one automaton; each document's words, written the same way, are scanned once.
A hit's place is mapped to word numbers and from there to the original text.

The benchmark is the broadcast side, and measured before any of it reaches the driver: with up to
``max_pattern_bytes`` of patterns it is one automaton and the documents are scanned once. A larger
one is a query set in blocks: its items are dealt by hash to blocks of about half that size, and
for one block after another the driver builds and broadcasts the patterns, a pass over the
documents writes the occurrences, and the broadcast is dropped. So driver and workers hold one
automaton at a time, and each worker builds it once a pass.

Cases. Null text or no words: no words, no hits, not contaminated. Items with null or
wordless text give no window; items with null ids mark words and documents like any other, but
aren't among the items found, since they can't be named. Equal
windows of several items count for each of them; repeated rows of an item count once. An
empty benchmark leaves every document clean, an empty documents table gives no rows.
Documents with equal ids are each judged alone. Extra columns are ignored here.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, arrow_filter, arrow_map, batch, free_names, only, slices, spread, utf8
from tidemark.session import materialise

WINDOW = 10
MAX_PATTERN_BYTES = 64 << 20
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:long,end:long>>"
HITS = "array<struct<first:long,stop:long,items:array<string>>>"
_HIT = pa.struct([("first", pa.int64()), ("stop", pa.int64()), ("items", pa.list_(pa.string()))])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

#: UTF-8 bytes to normalised bytes: separators become blanks, A-Z become a-z.
NORMAL = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in LOWER)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def patterns(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> dict[bytes, list[str]]:
    """Window, blank at either end -> ids of the items that have it, without null."""
    out: dict[bytes, set[str | None]] = {}
    for item, text in items:
        w = words_of(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            out.setdefault(b" " + b" ".join(w[k : k + window]) + b" ", set()).add(item)
    return {k: sorted(v - {None}) for k, v in out.items()}


class Scanner:
    """Hits of a pattern table in texts. Patterns and texts are held as Latin-1 strings of UTF-8 bytes."""

    def __init__(self, table: dict[bytes, list[str]]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for p, items in table.items():
            s = p.decode("latin-1")
            self.machine.add_word(s, (len(s), tuple(items)))
        if len(self.machine):
            self.machine.make_automaton()
        self.empty = not table

    def scan(self, words: list[bytes]) -> list[tuple[int, int, tuple[str, ...]]]:
        """(first word, word after the last, items) of each occurrence."""
        if self.empty or not words:
            return []
        found = list(self.machine.iter((b" " + b" ".join(words) + b" ").decode("latin-1")))
        if not found:
            return []
        # place of the blank behind each word
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        last = np.searchsorted(ends, [at for at, _ in found])
        first = np.searchsorted(ends, [at - n + 1 for at, (n, _) in found], side="right")
        return [(int(a), int(b) + 1, items) for a, b, (_, (_, items)) in zip(first, last, found, strict=True)]


_SCANNERS: dict[str, Scanner] = {}


def scanner(shared, key: str) -> Scanner:
    """This worker's automaton for a broadcast pattern table; one pass has one table, so one is kept."""
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = Scanner(shared.value)
    return _SCANNERS[key]


def word_places(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character spans of the original text under runs of hit words."""
    runs = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(NORMAL))]
    spans = [(places[a][0], places[b - 1][1]) for a, b in zip(runs[::2], runs[1::2], strict=True)]
    return [(len(text[:a].decode()), len(text[:b].decode())) for a, b in spans]


def item_blocks(benchmark: DataFrame, window: int, max_pattern_bytes: int) -> list[DataFrame]:
    """The benchmark's distinct items, in blocks whose patterns are bounded."""
    items = only(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item"), F.encode("text", "UTF-8").alias("text")).where("text is not null").distinct()
    size, n = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count(F.lit(1))).first()
    if size * window <= max_pattern_bytes or n < 2:
        return [items]
    items = materialise(items, "benchmark-items")
    blocks = min(n, -(-2 * size * window // max_pattern_bytes))
    return [items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k) for k in range(blocks)]


def pattern_table(block: DataFrame, window: int):
    """(broadcast patterns, key for the workers' cache) of a block of items."""
    table = patterns([(r.item, bytes(r.text)) for r in block.collect()], window)  # bounded by item_blocks
    return block.sparkSession.sparkContext.broadcast(table), uuid.uuid4().hex


def block_hits(rows: DataFrame, shared, key: str) -> DataFrame:
    """_row and the occurrences of a pattern table, of the rows (_row, text) that have some."""
    schema = pa.schema([("_row", pa.int64()), ("hits", pa.list_(_HIT))])

    def run(batches):
        for b in slices(batches):
            s = scanner(shared, key)
            found = [(r, [{"first": f, "stop": e, "items": list(i)} for f, e, i in s.scan(words_of(t))]) for r, t in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True)]
            found = [x for x in found if x[1]]
            if found:
                yield batch(schema, _row=[r for r, _ in found], hits=[h for _, h in found])

    return arrow_map(rows.select("_row", "text"), run, f"_row long, hits {HITS}")


def all_hits(rows: DataFrame, blocks: list[DataFrame], window: int) -> DataFrame:
    """_row and the occurrences of all blocks, a pass over the documents for each block."""
    out = None
    for block in blocks:
        shared, key = pattern_table(block, window)
        found = materialise(block_hits(rows, shared, key), "benchmark-hits")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out.groupBy("_row").agg(F.flatten(F.collect_list("hits")).alias("hits"))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` written with _row, which tells rows apart in several passes."""
    return materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered-documents")


def _described(doc_ids: pa.Array, texts: list[bytes], found: list[list[tuple[int, int, tuple[str, ...]]]], words: list[list[bytes]]) -> pa.RecordBatch:
    n_hit, names, spans = [], [], []
    for t, w, hits in zip(texts, words, found, strict=True):
        hit = np.zeros(len(w), bool)
        for first, end, _ in hits:
            hit[first:end] = True
        n_hit.append(int(hit.sum()))
        names.append(sorted({i for _, _, items in hits for i in items}))
        spans.append([{"start": s, "end": e} for s, e in word_places(t, hit)] if hits else [])
    return batch(_RESULT, doc_id=doc_ids, n_words=list(map(len, words)), n_hit=n_hit, n_items=list(map(len, names)), items=names, spans=spans)


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_pattern_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """Per document: words, hit words, items found (sorted) and the hit spans of the text in code points."""
    docs = only(docs, "doc_id", "text")
    blocks = item_blocks(benchmark, window, max_pattern_bytes)
    if len(blocks) == 1:
        shared, key = pattern_table(blocks[0], window)

        def scan(batches):
            for b in slices(batches):
                texts = utf8(b.column(1))
                words = [words_of(t) for t in texts]
                s = scanner(shared, key)
                yield _described(b.column(0), texts, [s.scan(w) for w in words], words)

        return arrow_map(spread(docs), scan, RESULT)
    rows = numbered(docs)
    joined = rows.join(all_hits(rows, blocks, window), "_row", "left").select("doc_id", "text", "hits")

    def describe(batches):
        for b in slices(batches):
            texts = utf8(b.column(1))
            found = [[(h["first"], h["stop"], tuple(h["items"])) for h in hits or ()] for hits in b.column(2).to_pylist()]
            yield _described(b.column(0), texts, found, [words_of(t) for t in texts])

    return arrow_map(joined, describe, RESULT)


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_pattern_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """``docs`` without the rows in which a window of the benchmark occurs."""
    blocks = item_blocks(benchmark, window, max_pattern_bytes)
    if len(blocks) == 1:
        shared, key = pattern_table(blocks[0], window)
        return arrow_filter(spread(docs), "text", lambda texts: [not scanner(shared, key).scan(words_of(t)) for t in texts])
    (own,) = free_names(docs, "_row")
    rows = materialise(docs.withColumn(own, F.monotonically_increasing_id()), "numbered-documents")
    hit = all_hits(rows.select(F.col(f"`{own}`").alias("_row"), "text"), blocks, window).select(F.col("_row").alias("hit_row"))
    kept = rows.join(hit, F.col(own) == F.col("hit_row"), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(scanned: DataFrame) -> DataFrame:
    """The scan's counts, with the items as the SHA-256 of their comma-joined ids."""
    return scanned.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
