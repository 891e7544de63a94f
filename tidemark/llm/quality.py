"""Quality rules: base counts, then divergence from language references.

Base counts (words are ``[^\\x20\\x09-\\x0D]+``): words, code points in words, characters of
``[#*$%&|<>]``, lines with a word that equal an earlier line, and words inside an 8-word
window that the text has twice or more. A document of under 20 words, or with over 30 % of
its words in repeated windows, fails the base rules.

The others are compared with references of each language: a histogram of classes of code points
and one of the language's most common words. The distance is Jensen-Shannon's (base 2, its
root), the smallest over the languages. A document is rejected if either distance exceeds
its threshold; short texts have noisy histograms, so a threshold is a floor plus a slack
that falls with the root of the length, and below a minimum length that histogram isn't
judged at all.

References are fitted on all rows with a language; a bound on their number can be asked for, and is off.
Distances of a text whose language has under ``FEW_ROWS`` such rows aren't judged, since its
reference would rest on too little. The fit starts from each language's median histogram (to a 4,096th)
and leaves out rows far from it, so junk doesn't move the references. Every step of it is a pass
with counts and whole-number sums, which no dealing of the rows changes. Every
other number is computed over every whole text.

Cases. Null or empty text has no words and fails the base rules. Equal rows get equal
verdicts. With no labelled row there are no references, and the base rules decide alone.
Bytes that are no UTF-8 count as one code point (U+FFFD) for each malformed part. An empty table
gives no rows; null ids stay null; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import arrow_filter, arrow_map, batch, only, slices, spread, utf8
from tidemark.llm.decontaminate import words_of
from tidemark.session import materialise

#: Rows of a language in a bounded fit, if it has them; and under how many its texts aren't judged by distance.
LEAST_ROWS, FEW_ROWS = 50, 20
COMMON_WORDS = 64
#: Steps of a share or distance in medians, of a share in means; words that a worker counts before it hands them on.
BINS, UNIT, HELD_WORDS = 4096, float(1 << 31), 200_000
MIN_WORDS, MAX_REPEAT = 20, 30
SPAN = 8
#: Threshold = floor + slack / sqrt(length); lengths are code points for characters, words for words.
CHAR_FLOOR, CHAR_SLACK, CHAR_MIN_CHARS = 0.11, 2.4, 120
WORD_FLOOR, WORD_SLACK, WORD_MIN_WORDS = 0.38, 1.0, 40
SYMBOLS = b"#*$%&|<>"

#: Classes of ASCII, of letters beyond it by script (first and last code point), and of all else by its kind.
ASCII = ("lower", "upper", "digit", "blank", "sentence", "shout", "symbol", "other")
SCRIPTS = {"latin": (0x80, 0x24F), "greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x52F), "semitic": (0x590, 0x8FF), "indic": (0x900, 0x109F), "east": (0x1100, 0xD7FF)}
KINDS = {"L": "letter", "M": "mark", "N": "number", "P": "punctuation", "S": "sign", "Z": "space"}
CLASSES = (*ASCII, *SCRIPTS, *KINDS.values(), "rest")


def _ascii_class(b: int) -> str:
    c = chr(b)
    return "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "blank" if c in " \t\n\r\v\f" else "sentence" if c in ".,;:?'\"()-" else "shout" if c == "!" else "symbol" if b in SYMBOLS else "other"


def _class_of(point: int) -> str:
    if point < 0x80:
        return _ascii_class(point)
    kind = unicodedata.category(chr(point))[0]
    if kind == "L":
        return next((k for k, (a, e) in SCRIPTS.items() if a <= point <= e), "letter")
    return KINDS.get(kind, "rest")


ASCII_TABLE = bytes(CLASSES.index(_ascii_class(min(b, 127))) for b in range(256))


@cache
def class_table() -> np.ndarray:
    """Class of each code point of the first plane; the others are told by a sample of each 256."""
    first = [CLASSES.index(_class_of(p)) for p in range(1 << 16)]
    return np.array(first + [CLASSES.index(_class_of(p << 8)) for p in range(1 << 8, 0x1100)], np.uint8)


_MIX = np.random.default_rng(8).integers(1, 2**63, SPAN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeat_words(words: list[bytes]) -> int:
    """Words inside an 8-word window that occurs twice or more, the first occurrence included."""
    n = len(words)
    if n <= SPAN:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, n)
    if len(seen) == n:
        return 0
    spread = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(29)
    windows = n - SPAN + 1
    h = np.zeros(windows, np.uint64)
    for k in range(SPAN):
        h += spread[k : k + windows] * _MIX[k]
    s = np.sort(h)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return 0
    # equal windows have equal hashes; the words themselves decide
    at = np.flatnonzero(np.isin(h, twice))
    rows = np.lib.stride_tricks.sliding_window_view(ids, SPAN)[at]
    _, back, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    hit = np.zeros(n + 1, np.int64)
    starts = at[count[back.reshape(-1)] >= 2]
    np.add.at(hit, starts, 1)
    np.add.at(hit, starts + SPAN, -1)
    return int((np.cumsum(hit[:-1]) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, duplicate lines, repeated words)."""
    words = text.split()
    size = sum(map(len, words))
    chars = len(text.decode("utf-8", "replace")) - (len(text) - size)
    symbols = sum(text.count(bytes((c,))) for c in SYMBOLS)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT * n_words


def char_histogram(text: bytes) -> np.ndarray:
    """Code points of each class."""
    if text.isascii():
        found = np.frombuffer(text.translate(ASCII_TABLE), np.uint8)
    else:
        points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        # planes beyond the first follow it, 256 code points an entry
        found = class_table()[np.where(points < 1 << 16, points, (1 << 16) - (1 << 8) + (points >> 8))]
    return np.bincount(found, minlength=len(CLASSES))


def word_histogram(words: list[bytes], common: dict[bytes, int]) -> np.ndarray:
    other = len(common)
    return np.bincount([common.get(w, other) for w in words] or [other], minlength=other + 1)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root, base 2) between the last axes; 0 to 1."""
    p = p / np.maximum(p.sum(-1, keepdims=True), 1e-12)
    q = q / np.maximum(q.sum(-1, keepdims=True), 1e-12)
    m = (p + q) / 2

    def kl(a):
        return np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.maximum(m, 1e-300)), 0).sum(-1)

    return np.sqrt(np.maximum(0, (kl(p) + kl(q)) / 2))


class References:
    """Histograms of each language, and the verdict on a text."""

    def __init__(self, langs: list[str], common: list[bytes], chars: np.ndarray, words: np.ndarray, few: frozenset[str] = frozenset()):
        self.langs, self.chars, self.words, self.few = langs, chars, words, few
        self.common = {w: k for k, w in enumerate(common)}

    def judge(self, text: bytes, lang: str | None = None) -> tuple[bool, float, float]:
        """(passes, character distance, word distance); a distance that isn't judged is 0."""
        char = word = 0.0
        if not self.langs or lang in self.few:
            return True, char, word
        ok = True
        found = char_histogram(text)
        n = int(found.sum())
        if n >= CHAR_MIN_CHARS:
            char = float(distance(found[None], self.chars).min())
            ok = char <= CHAR_FLOOR + CHAR_SLACK / n**0.5
        words = words_of(text)
        if len(words) >= WORD_MIN_WORDS:
            word = float(distance(word_histogram(words, self.common)[None], self.words).min())
            ok = ok and word <= WORD_FLOOR + WORD_SLACK / len(words) ** 0.5
        return ok, char, word


def _medians(counts: DataFrame, totals: dict[str, int]) -> dict[tuple[str, int], int]:
    """Median bin of each lang and col; ``counts``: lang, col, bin, n without bin 0, in which are the others of ``totals``."""
    if not totals:
        return {}
    own = Window.partitionBy("lang", "col")
    total = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(n)) for lang, n in totals.items()])
    summed = counts.groupBy("lang", "col", "bin").agg(F.sum("n").alias("n"))
    upto = summed.withColumn("upto", total - F.sum("n").over(own) + F.sum("n").over(own.orderBy("bin")))
    middle = upto.where((2 * F.col("upto") >= total) & (2 * (F.col("upto") - F.col("n")) < total))
    return {(r.lang, r.col): r.bin for r in middle.select("lang", "col", "bin").collect()}


class _Fit:
    """Passes over the histograms of labelled rows: lang, chars, words."""

    def __init__(self, features: DataFrame, totals: dict[str, int], every: set[str], n_words: int):
        self.features, self.totals, self.every = features, totals, every
        self.langs, self.widths = sorted(totals), (len(CLASSES), n_words)
        self.parts = (slice(0, len(CLASSES)), slice(len(CLASSES), len(CLASSES) + n_words))

    def _map(self, fn, names: str) -> DataFrame:
        """``fn`` gets a language and its rows' shares, and gives columns."""
        schema = pa.schema([(n, pa.string() if n == "lang" else pa.int64()) for n in names.split()])
        known, every, widths = set(self.langs), self.every, self.widths

        def run(batches):
            for b in slices(batches):
                langs = np.array(b.column(0).to_pylist(), object)
                counts = [b.column(k + 1).flatten().to_numpy().reshape(-1, w).astype(float) for k, w in enumerate(widths)]
                judged = counts[0].sum(axis=1) >= CHAR_MIN_CHARS
                shares = np.concatenate([c / np.maximum(c.sum(axis=1, keepdims=True), 1) for c in counts], axis=1)
                for lang in sorted(set(langs.tolist()) & known):
                    own = shares[(langs == lang) & (judged | (lang in every))]
                    if len(own):
                        columns = fn(lang, own)
                        n = len(next(iter(columns.values())))
                        yield batch(schema, lang=[lang] * n, **{k: pa.array(v) for k, v in columns.items()})

        return arrow_map(self.features, run, ", ".join(f"{n} {'string' if n == 'lang' else 'long'}" for n in names.split()))

    def medians(self) -> np.ndarray:
        def binned(_, shares):
            bins = np.rint(shares * BINS).astype(np.int64) + np.arange(shares.shape[1]) * (BINS + 1)
            found, n = np.unique(bins, return_counts=True)
            some = found % (BINS + 1) > 0
            return {"col": found[some] // (BINS + 1), "bin": found[some] % (BINS + 1), "n": n[some]}

        found = _medians(self._map(binned, "lang col bin n"), self.totals)
        return np.array([[found.get((lang, c), 0) for c in range(sum(self.widths))] for lang in self.langs], float) / BINS

    def _far(self, centre: np.ndarray):
        at, parts = {lang: k for k, lang in enumerate(self.langs)}, self.parts
        return lambda lang, shares: np.stack([distance(shares[:, p], centre[at[lang], p][None]) for p in parts])

    def limits(self, centre: np.ndarray) -> np.ndarray:
        """One and a half of the median distance, for each language and kind of histogram."""
        far = self._far(centre)

        def binned(lang, shares):
            bins = np.ceil(far(lang, shares) * BINS).astype(np.int64) + np.arange(2)[:, None] * (BINS + 1)
            found, n = np.unique(bins, return_counts=True)
            some = found % (BINS + 1) > 0
            return {"col": found[some] // (BINS + 1), "bin": found[some] % (BINS + 1), "n": n[some]}

        found = _medians(self._map(binned, "lang col bin n"), self.totals)
        return np.array([[found.get((lang, k), 0) for k in range(2)] for lang in self.langs], float) * 1.5 / BINS + 1e-9

    def means(self, centre: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """Mean shares of the rows within the limits."""
        far, parts = self._far(centre), self.parts
        at = {lang: k for k, lang in enumerate(self.langs)}

        def summed(lang, shares):
            near = far(lang, shares) <= limits[at[lang]][:, None]
            whole = np.rint(shares * UNIT).astype(np.int64)
            s = np.concatenate([whole[near[k], p].sum(axis=0) for k, p in enumerate(parts)])
            n = np.concatenate([np.full(p.stop - p.start, int(near[k].sum())) for k, p in enumerate(parts)])
            return {"col": np.arange(len(s)), "s": s, "n": n}

        out = np.zeros(centre.shape)
        for r in self._map(summed, "lang col s n").groupBy("lang", "col").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
            out[at[r.lang], r.col] = r.s / (max(1, r.n) * UNIT)
        return out

    def trimmed(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean histograms of the rows near the median histogram."""
        centre = self.medians()
        none = [[centre[k, p].sum() <= 0 for p in self.parts] for k in range(len(self.langs))]
        if np.any(none):
            every = self.means(centre, np.full((len(self.langs), 2), np.inf))
            for k, p in ((k, self.parts[i]) for k, row in enumerate(none) for i, x in enumerate(row) if x):
                centre[k, p] = every[k, p]
        for _ in range(2):
            centre = self.means(centre, self.limits(centre))
        return centre[:, self.parts[0]], centre[:, self.parts[1]]


def _bounded(labelled: DataFrame, sizes: dict[str, int], fitted: list[str], sample_rows: int) -> DataFrame:
    """About ``sample_rows`` rows, as many of each language as of the others where it has them, by a hash of doc_id."""
    share = max(LEAST_ROWS, sample_rows / max(1, len(fitted)))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    pick = F.lit(False)
    for lang in fitted:
        # all rows of a language that has no more than its share, null ids too
        pick = pick | ((F.col("lang") == lang) & ((at < min(1.0, share / sizes[lang])) if sizes[lang] > share else F.lit(True)))
    # rows of one id, which share a hash, can't make the sample larger than twice the share
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"), "text"))
    bounded = labelled.where(pick).withColumn("rank", rank).where(F.col("rank") <= int(2 * share) + 1)
    return materialise(bounded.select("lang", "text"), "quality-sample")


def fit_references(docs: DataFrame, sample_rows: int | None = None, common_words: int = COMMON_WORDS) -> References:
    """Fits on all labelled rows; on about ``sample_rows`` of them where that is given."""
    labelled = only(docs, "doc_id", "text", "lang").where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = frozenset(lang for lang, n in sizes.items() if n < FEW_ROWS)
    fitted = sorted(lang for lang in sizes if lang not in few)
    if not fitted:
        return References([], [], np.zeros((0, len(CLASSES))), np.zeros((0, 1)), few)
    if sample_rows is None:
        taken = labelled.where(F.col("lang").isin(fitted)).select("lang", "text")
    else:
        taken = _bounded(labelled, sizes, fitted, sample_rows)
    taken = spread(taken, 1)
    counts = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])

    def count_words(batches):
        from collections import Counter

        def out():
            return batch(counts, lang=[k[0] for k in total], word=[k[1] for k in total], n=list(total.values()))

        total: dict[tuple, int] = Counter()
        for b in slices(batches):
            for lang, t in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                for w, n in Counter(words_of(t)).items():
                    total[lang, w] += n
            if len(total) > HELD_WORDS:
                yield out()
                total.clear()
        yield out()

    per_word = arrow_map(taken, count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = per_word.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= common_words)
    common = sorted({bytes(r.word) for r in top.select("word").collect()})  # at most common_words a language
    table = {w: k for k, w in enumerate(common)}
    features = pa.schema([("lang", pa.string()), ("chars", pa.list_(pa.int32())), ("words", pa.list_(pa.int32()))])

    def histograms(batches):
        for b in slices(batches):
            texts = utf8(b.column(1))
            yield batch(features, lang=b.column(0), chars=[char_histogram(t).tolist() for t in texts], words=[word_histogram(words_of(t), table).tolist() for t in texts])

    got = materialise(arrow_map(taken, histograms, "lang string, chars array<int>, words array<int>"), "quality-features")
    long_enough = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x) >= CHAR_MIN_CHARS
    ns = got.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(long_enough, 1)).alias("judged")).collect()
    # a language without a text that is long enough rests on all of its texts
    fit = _Fit(got, {r.lang: r.judged or r.n for r in ns}, {r.lang for r in ns if not r.judged}, len(common) + 1)
    return References(fit.langs, common, *fit.trimmed(), few)


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def score(docs: DataFrame, references: References) -> DataFrame:
    """Counts, distances and verdict of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(references)
    types = {"base_failed": pa.bool_(), "kept": pa.bool_(), "char_distance": pa.float64(), "word_distance": pa.float64()}
    schema = pa.schema([(n, types.get(n, pa.int64())) for n in (x.split()[0] for x in RESULT.split(", "))])

    def run(batches):
        ref = shared.value
        for b in slices(batches):
            rows = []
            for t, lang in zip(utf8(b.column(1)), b.column(2).to_pylist(), strict=True):
                counts = base_counts(t)
                failed = base_failed(counts[0], counts[4])
                ok, char, word = ref.judge(t, lang)
                rows.append((*counts, failed, ok and not failed, char, word))
            yield batch(schema, doc_id=b.column(0), **dict(zip(schema.names[1:], map(list, zip(*rows, strict=True)), strict=True)))

    return arrow_map(spread(only(docs, "doc_id", "text", "lang")), run, RESULT)


def passing_documents(docs: DataFrame, references: References) -> DataFrame:
    """``docs`` without the rows that the base rules or the references reject."""
    shared = docs.sparkSession.sparkContext.broadcast(references)

    def keep(texts: list[bytes], langs: list[str | None]) -> list[bool]:
        out = []
        for t, lang in zip(texts, langs, strict=True):
            words = t.split()
            out.append(not base_failed(len(words), repeat_words(words)) and shared.value.judge(t, lang)[0])
        return out

    return arrow_filter(spread(docs), "text", keep, "lang")
