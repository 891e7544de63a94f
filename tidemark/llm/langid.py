"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter has one slot array for all languages: slot s holds a mask with bit
l set if an n-gram of language l hashes there. One lookup (the AND of ``HASHES`` slots) thus
returns all languages that contain an n-gram. Per language the n-grams of a text that have
its bit are counted; of n n-grams about n * f_l hit by chance, f_l being the share of set
slots to the power of the hashes, so the count is corrected to (count - n f_l) / (1 - f_l).
The language with the largest corrected count wins; its share of n is the score.

N-grams are windows of ``GRAM`` bytes of the lower-cased text with everything ASCII but
letters as single blanks. A language's set is its ``TOP`` most frequent n-grams in the rows
it is learned from: a sample of at most about ``FIT_ROWS`` labelled rows, picked by a hash
of doc_id, and never more than twice a language's share of that. Languages beyond 64 take further mask columns.

Cases. Null text, or text without a letter, is ``und`` with score 0. If nothing was learned
every text is ``und``. A text none of whose n-grams is known gets the language of the most
labelled rows, score 0. Ties go to the name that sorts first. Null ids are never learned
from and aren't held out. Equal rows get equal results; an empty table gives no rows; extra
columns are ignored. Texts are read whole, ``CHUNK`` bytes of them at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import arrow_map, batch, only, slices, spread, strings
from tidemark.session import materialise

GRAM, HASHES, SLOT_BITS = 4, 3, 18
#: Bounds of the fit: rows it is made on, and n-grams a language.
FIT_ROWS, TOP = 6000, 20_000
CHUNK = 4 << 20
UNKNOWN = "und"
_LETTERS = bytes(b if b >= 0x80 or 97 <= b <= 122 else 0x20 for b in range(256))
_FACTORS = np.random.default_rng(10).integers(1, 2**62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def has_letter(text: str, norm: bytes) -> bool:
    return bool(norm.translate(None, delete=bytes(range(0x80, 0x100)) + b" ")) or any(c.isalpha() for c in text)


def grams(norm: bytes) -> np.ndarray:
    """Windows of ``GRAM`` bytes, with a blank at either end, as integers."""
    x = np.frombuffer(b" " + norm + b" ", np.uint8)
    n = len(x) - GRAM + 1
    if n <= 0:
        return np.array([int.from_bytes(x.tobytes(), "little")], np.uint32)
    out = np.zeros(n, np.uint32)
    for k in range(GRAM):
        out |= x[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    return out


def slots(g: np.ndarray, k: int) -> np.ndarray:
    return ((g.astype(np.uint64) + np.uint64(1)) * _FACTORS[k]) >> np.uint64(64 - SLOT_BITS)


class LanguageFilters:
    """The filters of all languages, and the decision for a text."""

    def __init__(self, sets: dict[str, np.ndarray], rows: dict[str, int]):
        self.langs = sorted(sets)
        self.fallback = min(self.langs, key=lambda x: (-rows.get(x, 0), x)) if self.langs else UNKNOWN
        self.table = np.zeros((max(1, -(-len(self.langs) // 64)), 1 << SLOT_BITS), np.uint64)
        for i, lang in enumerate(self.langs):
            for k in range(HASHES):
                self.table[i // 64, slots(sets[lang], k)] |= np.uint64(1) << np.uint64(i % 64)
        fill = [np.count_nonzero(self.table[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / (1 << SLOT_BITS) for i in range(len(self.langs))]
        self.chance = np.array(fill) ** HASHES

    def counts(self, g: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """N-grams of each language in each run of ``g`` that begins at ``starts``."""
        out = np.zeros((len(starts), len(self.langs)), np.int64)
        places = [slots(g, k) for k in range(HASHES)]
        for column, table in enumerate(self.table):
            mask = table[places[0]]
            for p in places[1:]:
                mask &= table[p]
            for bit, i in enumerate(range(column * 64, min(len(self.langs), column * 64 + 64))):
                out[:, i] = np.add.reduceat((mask >> np.uint64(bit) & np.uint64(1)).astype(np.int64), starts)
        return out

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return names, scores
        waiting: list[tuple[int, np.ndarray]] = []
        size = 0

        def settle():
            if not waiting:
                return
            lengths = np.array([len(g) for _, g in waiting])
            starts = np.cumsum(lengths) - lengths
            raw = self.counts(np.concatenate([g for _, g in waiting]), starts)
            fixed = np.maximum(0.0, (raw - lengths[:, None] * self.chance) / np.maximum(1e-9, 1 - self.chance))
            best = fixed.argmax(axis=1)
            for (i, g), row, b in zip(waiting, fixed, best, strict=True):
                names[i] = self.langs[b] if row[b] > 0 else self.fallback
                scores[i] = float(min(1.0, row[b] / len(g)))
            waiting.clear()

        for i, t in enumerate(texts):
            if not t:
                continue
            norm = normal(t)
            if not has_letter(t, norm):
                continue
            waiting.append((i, grams(norm)))
            size += len(norm)
            if size >= CHUNK:
                settle()
                size = 0
        settle()
        return names, scores


def held_out() -> Column:
    """crc32(doc_id as text) mod 3 = 1; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_filters(docs: DataFrame, fit_rows: int = FIT_ROWS, top: int = TOP) -> LanguageFilters:
    """Learns from rows with an id, text and language that aren't held out."""
    usable = (F.col("lang").isNotNull()) & F.col("doc_id").isNotNull() & ~held_out()
    sizes = {r.lang: r.n for r in only(docs, "doc_id", "lang").where(usable).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = only(docs, "doc_id", "lang", "text").where(usable & F.col("text").isNotNull())
    # as many rows of each language as of the others, where it has them
    share = fit_rows / max(1, len(sizes))
    pick = F.lit(False)
    for lang, n in sorted(sizes.items()):
        pick = pick | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id"), F.lit(max(1, int(-(-n // share))))) == 0))
    # rows of one id, which share a hash, can't make the sample larger than that
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"), "text"))
    bounded = rows.where(pick).withColumn("rank", rank).where(F.col("rank") <= int(2 * share) + 1)
    sample = materialise(bounded.select("lang", "text"), "langid-sample") if sizes else rows.select("lang", "text").limit(0)
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches):
        for b in slices(batches):
            by: dict[str, list[bytes]] = {}
            for lang, t in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                by.setdefault(lang, []).append(normal(t))
            for lang, texts in by.items():
                g, n = np.unique(np.concatenate([grams(t) for t in texts]), return_counts=True)
                yield batch(schema, lang=[lang] * len(g), gram=pa.array(g.astype(np.int64)), n=pa.array(n.astype(np.int64)))

    per = arrow_map(sample, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = per.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= top)
    got = best.select("lang", "gram").toPandas()  # at most ``top`` a language
    return LanguageFilters({lang: own["gram"].to_numpy().astype(np.uint32) for lang, own in got.groupby("lang")}, sizes)


def identify(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; only its text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for b in slices(batches):
            names, scores = shared.value.decide(strings(b.column(2)))
            yield batch(schema, doc_id=b.column(0), held_out=b.column(1), lang_pred=names, score=scores)

    rows = spread(only(docs, "doc_id", "text")).select("doc_id", held_out().alias("held_out"), "text")
    return arrow_map(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")
