"""Token-id output in a binary file format, packed with Simple-8b.

``write_tokens`` tokenizes documents in ascending order of id and writes one file for each
range of ids; ``read_tokens`` reads files back, block by block. File layout, all integers
little-endian::

    b"TDTK\\x02\\0\\0\\0"
    words        uint64 each, Simple-8b, blocks of 1024 ids
    offsets      int64, first word of each block and the end
    escapes_at   int64, first escape of each block and the end
    escapes      uint8, high bits of escaped ids
    ranks        uint32, ids by falling frequency; what is packed is an id's rank
    documents    int64 doc_id, int64 number of ids, uint8 null flag (three arrays)
    footer       uint64 n_words, n_blocks, n_escapes, n_ranks, n_documents, n_ids, b"TDTKEND\\0"

Frequent ids have small ranks, which need few bits. The ranks are those of a file's first
``FLUSH`` ids; an id that isn't among them is packed as itself plus the number of ranks.

Cases. A null text is empty and has only the end id. Documents with equal ids are all
kept, ordered by their text; null ids come last and read back as null. An empty table gives
no files and no rows. Extra columns are ignored. Very long texts are one document; the
writer holds at most ``FLUSH`` ids beside the document at hand, the reader as many.

A task writes under a name of its own and its manifest row names that file, so a repeated
or speculative task leaves only an unread file behind. Files go to the folder in
spark.checkpoint.dir (or ``out_dir``), which executors share.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import simple8b
from tidemark.llm.common import arrow_map, batch, only, strings
from tidemark.llm.tokenizing import encoder
from tidemark.session import materialise, new_dir

MAGIC, END = b"TDTK\x02\0\0\0", b"TDTKEND\0"
#: Ids packed at a time, a multiple of the block.
FLUSH = 1 << 19
MANIFEST = "part int, path string, n_docs long, n_ids long"
TOKENS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Ranks:
    """Ids to ranks and back, from the ids by falling frequency."""

    #: Ids below this are looked up in an array, others searched for.
    DENSE = 1 << 20

    def __init__(self, by_rank: np.ndarray):
        self.by_rank = by_rank.astype(np.uint64)
        self.n = np.uint64(len(by_rank))
        self.order = np.argsort(self.by_rank, kind="stable").astype(np.uint64)
        self.sorted = self.by_rank[self.order.astype(np.int64)]
        self.table = np.arange(self.DENSE, dtype=np.uint64) + self.n
        small = self.by_rank < self.DENSE
        self.table[self.by_rank[small].astype(np.int64)] = np.flatnonzero(small)

    @classmethod
    def of(cls, ids: np.ndarray) -> Ranks:
        found, n = np.unique(ids, return_counts=True)
        return cls(found[np.lexsort((found, -n))])

    def encode(self, ids: np.ndarray) -> np.ndarray:
        if not len(ids) or ids.max() < self.DENSE:
            return self.table[ids.astype(np.int64)]
        at = np.minimum(np.searchsorted(self.sorted, ids), max(0, len(self.sorted) - 1))
        return np.where(self.sorted[at] == ids, self.order[at], ids + self.n)

    def decode(self, ranks: np.ndarray) -> np.ndarray:
        known = ranks < self.n
        if known.all():
            return self.by_rank[ranks.astype(np.int64)]
        return np.where(known, self.by_rank[np.where(known, ranks, 0).astype(np.int64)], ranks - self.n) if len(self.by_rank) else ranks


class TokenFileWriter:
    """Appends documents to one file; ``close`` writes the tables behind the words."""

    def __init__(self, uri: str):
        self.fs, path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(path)
        self.out.write(MAGIC)
        self.docs, self.counts, self.nulls = [], [], []
        self.offsets, self.escapes_at, self.escapes = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], []
        self.words = self.n_ids = self.waiting_ids = 0
        self.waiting: list[bytes] = []
        self.ranks: Ranks | None = None

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids``: little-endian unsigned 32-bit."""
        n = len(ids) // 4
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(n)
        self.n_ids += n
        self.waiting.append(ids)
        self.waiting_ids += n
        if self.waiting_ids >= FLUSH:
            self.flush()

    def flush(self, last: bool = False) -> None:
        ids = np.frombuffer(b"".join(self.waiting), dtype="<u4").astype(np.uint64)
        whole = len(ids) if last else len(ids) // simple8b.BLOCK * simple8b.BLOCK
        if self.ranks is None:
            self.ranks = Ranks.of(ids[:FLUSH])
        for k in range(0, whole, FLUSH):
            words, offsets, high = simple8b.encode(self.ranks.encode(ids[k : min(k + FLUSH, whole)]))
            if len(words):
                self.out.write(words.astype("<u8").tobytes())
                self.offsets.append(offsets[1:] + self.words)
                escapes = np.concatenate([[0], np.cumsum((words >> np.uint64(60)) == 0)])
                self.escapes_at.append(escapes[offsets[1:]] + sum(map(len, self.escapes)))
                self.escapes.append(high)
                self.words += len(words)
        self.waiting = [ids[whole:].astype("<u4").tobytes()]
        self.waiting_ids = len(ids) - whole

    def close(self) -> None:
        self.flush(last=True)
        offsets, escapes_at = np.concatenate(self.offsets), np.concatenate(self.escapes_at)
        escapes = np.concatenate(self.escapes) if self.escapes else np.zeros(0, np.uint8)
        for part in (offsets.astype("<i8"), escapes_at.astype("<i8"), escapes, self.ranks.by_rank.astype("<u4"), np.array(self.docs, "<i8"), np.array(self.counts, "<i8"), np.array(self.nulls, np.uint8)):
            self.out.write(part.tobytes())
        self.out.write(np.array([self.words, len(offsets) - 1, len(escapes), len(self.ranks.by_rank), len(self.docs), self.n_ids], "<u8").tobytes() + END)
        self.out.close()


class TokenFileReader:
    """Range-reads one file: its tables first, then the blocks that are asked for."""

    def __init__(self, uri: str):
        self.fs, path = pafs.FileSystem.from_uri(uri)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(56, size - 56)
        if tail[48:] != END or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        words, blocks, escapes, ranks, docs, self.n_ids = map(int, np.frombuffer(tail[:48], "<u8"))
        at = 8 + 8 * words
        self.offsets, at = self._array("<i8", blocks + 1, at)
        self.escapes_at, at = self._array("<i8", blocks + 1, at)
        self.escapes, at = self._array("u1", escapes, at)
        by_rank, at = self._array("<u4", ranks, at)
        self.ranks = Ranks(by_rank)
        self.docs, at = self._array("<i8", docs, at)
        self.counts, at = self._array("<i8", docs, at)
        self.nulls, at = self._array("u1", docs, at)

    def _array(self, kind: str, n: int, at: int) -> tuple[np.ndarray, int]:
        a = np.frombuffer(self.file.read_at(n * np.dtype(kind).itemsize, at), dtype=kind)
        return a, at + a.nbytes

    def ids(self, first: int, end: int) -> np.ndarray:
        """Ids ``first`` to ``end`` (exclusive) of the file."""
        a, b = first // simple8b.BLOCK, -(-end // simple8b.BLOCK)
        if end <= first:
            return np.zeros(0, np.uint64)
        lo, hi = int(self.offsets[a]), int(self.offsets[b])
        words = np.frombuffer(self.file.read_at(8 * (hi - lo), 8 + 8 * lo), "<u8")
        got = self.ranks.decode(simple8b.decode(words, self.escapes[self.escapes_at[a] : self.escapes_at[b]]))
        return got[first - a * simple8b.BLOCK : end - a * simple8b.BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id's place in the file, ids), FLUSH ids or one document at a time."""
        ends = np.cumsum(self.counts)
        k = 0
        while k < len(ends):
            first = int(ends[k] - self.counts[k])
            stop = max(k + 1, int(np.searchsorted(ends, first + FLUSH, side="right")))
            chunk = self.ids(first, int(ends[stop - 1]))
            for i in range(k, stop):
                a = int(ends[i] - self.counts[i])
                yield None if self.nulls[i] else int(self.docs[i]), a, chunk[a - first : int(ends[i]) - first]
            k = stop


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, out_dir: str | None = None, order: Column | None = None) -> DataFrame:
    """Writes the files and returns their manifest, one row for each file, in order of ``part``.

    Documents are in ascending order of id, or of ``order``, an expression over the columns of ``docs``.
    """
    spark = docs.sparkSession
    out_dir = out_dir or new_dir(spark, "tokens")
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    tail = np.array([end_id], "<u4").tobytes()

    def write(batches):
        part, enc, writer = TaskContext.get().partitionId(), encoder(tokenizer), None
        uri = f"{out_dir}/part-{part:06d}-{uuid.uuid4().hex[:8]}.tdtk"
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                writer = writer or TokenFileWriter(uri)
                writer.add(doc_id, (enc.ids(text) if text else b"") + tail)
        if writer:
            writer.close()
            yield batch(schema, part=[part], path=[uri], n_docs=[len(writer.docs)], n_ids=[writer.n_ids])

    if order is None:
        rows, first = only(docs, "doc_id", "text"), F.col("doc_id").asc_nulls_last()
    else:
        rows, first = docs.select("doc_id", "text", order.alias("_order")), F.col("_order").asc()
    dealt = rows.repartitionByRange(first).sortWithinPartitions(first, "text").select("doc_id", "text")
    return materialise(arrow_map(dealt, write, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Decodes every file. Per document ``start`` (the ids of all documents before it), number of ids and their CRC-32.

    What stands before a file is a running sum over the manifest, one row for each file.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def read(batches):
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for doc_id, at, ids in TokenFileReader(uri).documents():
                    rows.append((doc_id, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 10_000:
                        yield batch(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))
                        rows = []
                if rows:
                    yield batch(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))

    files = manifest.select("path", before.alias("before"))
    return arrow_map(files.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2), "path"), read, TOKENS)


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 2, order: Column | None = None) -> DataFrame:
    """Write, read back, and place every document."""
    manifest = write_tokens(docs, tokenizer, end_id, order=order)
    return read_tokens(manifest)
