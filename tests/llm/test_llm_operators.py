"""Each operator against brute force on a small table with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, exact_substrings, langid, mixing, quality, simhash, spans, token_output, warc
from tidemark.llm.common import keyed
from tidemark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, _did string, first_id int, kept_text string, mix_key string"


def texts() -> list[tuple]:
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(400)]

    def prose(n):
        return " ".join(w + rng.choice(["", "", "", "", ".", ",\n", "!"]) for w in rng.choices(vocabulary, k=n))

    passage = prose(90)
    rows: list = [None, "", "   \n ", "one", "one two three", passage, prose(60) + "\n" + passage + "\n" + prose(50), "Ab " * 400, prose(4000), passage.upper()]
    for _ in range(12):
        t = prose(rng.randint(30, 150))
        rows += [t, t] if rng.random() < 0.4 else [t]
        near = t.split(" ")
        near[len(near) // 2] = "changed"
        rows.append(" ".join(near))
    rows += [prose(40) + "\n" + passage + "\n" + prose(rng.randint(5, 40)) for _ in range(6)]
    out = [(i, t, None if i % 11 == 0 else "ab"[i % 2], None if i % 13 == 0 else f"s{i % 3}") for i, t in enumerate(rows)]
    out += [out[5], (5, "another text of that id " * 9, "a", "s1"), (None, passage, "a", "s0"), (None, None, None, None)]
    rng.shuffle(out)
    return [(*r, None if r[1] is None else len(r[1]), 1, "x", 2, "y", "z") for r in out]


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return (r[0] is None, r[0] or 0)


def places(spark, rows):
    """(id, text) -> what orders documents: null ids last, then id, then a hash of the text."""
    df = keyed(spark.createDataFrame(list({r[:2] for r in rows}), "doc_id long, text string"), "doc_id", "text")
    return {(r.doc_id, r.text): (r._th >= 0, r._did, r._th) for r in df.collect()}


def test_spans(spark, docs, rows, empty):
    order = places(spark, rows)
    place = lambda r: order[r[:2]]
    first: dict = {}
    for r in rows:
        for h, low, a, _ in spans.spans(r[1] or ""):
            first[h, low] = min(first.get((h, low), (True,) * 9), (*place(r), a))
    want = []
    for r in rows:
        cut = [{"first": a, "n": n} for h, low, a, n in spans.spans(r[1] or "") if first[h, low] != (*place(r), a)]
        found = spans.sentences(r[1] or "")
        removed = {k for c in cut for k in range(c["first"], c["first"] + c["n"])}
        ends = [x[0] for x in found[1:]] + [len(r[1] or "")] * bool(found)
        # a sentence goes with the white space behind it
        kept = r[1] and r[1][: found[0][0] if found else len(r[1])] + "".join(r[1][x[0] : e] for k, (x, e) in enumerate(zip(found, ends, strict=True)) if k not in removed)
        want.append((r[0], len(found), len(removed), kept))
    done = spans.deduplicated(docs)
    assert done.columns[: len(docs.columns)] == docs.columns
    got = [(r.doc_id, r.n_sentences, r.n_removed, r.kept_text_0) for r in done.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(g[2] for g in got) > 0
    assert spans.summary(empty).count() == 0


@pytest.fixture(scope="module")
def clash(spark):
    """Two texts with the same 32-bit hash: (one that repeats a passage, one that repeats nothing), both without an id."""
    passage = "".join(f"Clause {k} of this passage says what nobody else says. " for k in range(8))
    made = spark.range(300_000).select(F.concat(F.lit("first sort "), "id", F.lit(" " + passage)).alias("a"), F.concat(F.lit("second sort "), "id", F.lit(" ".join(f" alone{k} with{k * k}" for k in range(20)))).alias("b"))
    ones, twos = (made.select(F.hash(c).alias("h"), F.col(c)) for c in "ab")
    hit = ones.join(twos, "h").orderBy("h").first()
    return spark.createDataFrame([(1, passage), (None, hit.a), (None, hit.b)], "doc_id long, text string"), hit.b


def test_texts_without_ids_dont_clash(clash):
    docs, alone = clash
    spared = {r.kept_text: r.n_removed for r in spans.deduplicated(docs).collect()}
    assert spared[alone] == 0
    assert sum(spared.values()) > 0
    gone = {r.kept: r.n_removed for r in exact_substrings.deduplicated(docs).collect()}
    assert gone[alone.encode()] == 0
    assert sum(gone.values()) > 300


def test_pieces_by_definition(rows):
    """Cuts and spans of each text, one after another and all at once, against their definitions."""
    import xxhash

    texts = [r[1] or "" for r in rows]
    together = spans.Pieces([t.encode() for t in texts])
    spanned = together.span_rows()
    seen: dict = {}
    for t, text in enumerate(texts):
        words = [(m.start(), m.end()) for m in re.finditer("[^\x20\x09-\x0d]+", text)]
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), text[a:b]).encode() for a, b in words]
        h = [int.from_bytes(xxhash.xxh3_128_digest(w)[:8], "little") for w in low]
        n = len(words)
        stop = [low[i][-1:] in (b".", b"!", b"?") or i + 1 == n or "\n" in text[words[i][1] : words[i + 1][0]] for i in range(n)]
        cut = list(stop)
        for i in range(2, n - 2):
            if not any(stop[i - 2 : i + 2]) and h[i] < min(h[i - 2 : i]) and h[i] <= min(h[i + 1 : i + 3]):
                cut[i] = True
        pieces, begin = [], 0
        for i in range(n):
            if cut[i] or i + 1 - begin == spans.LONG:
                pieces.append((begin, i + 1))
                begin = i + 1
        assert [(a, b) for a, b, _ in spans.sentences(text)] == [(words[a][0], words[b - 1][1]) for a, b in pieces]
        want = set()
        for i in range(len(pieces)):
            for j in range(i + spans.SENTENCES, len(pieces) + 1):
                if pieces[j - 1][1] - pieces[i][0] >= spans.WORDS:
                    want.add((i, j - i))
                    break
        for j in range(len(pieces), 0, -1):
            for i in range(j - spans.SENTENCES, -1, -1):
                if pieces[j - 1][1] - pieces[i][0] >= spans.WORDS:
                    want.add((i, j - i))
                    break
        mine = spanned[:, spanned[2] == t]
        assert set(zip(mine[3].tolist(), mine[4].tolist(), strict=True)) == want
        assert sorted(map(tuple, mine[[0, 1, 3, 4]].T.tolist())) == sorted(spans.spans(text))
        for high, lo, _, a, k in mine.T.tolist():
            content = b" ".join(low[pieces[a][0] : pieces[a + k - 1][1]])
            assert seen.setdefault(content, (high, lo)) == (high, lo)
    assert len(set(seen.values())) == len(seen)


def test_spans_catch_long_passages():
    rng = random.Random(5)
    for _ in range(200):
        words = ["w%d" % rng.randint(0, 10**6) for _ in range(51)]
        line = " ".join(w + rng.choice(["", "", "", "."]) for w in words)
        n = len(spans.sentences(line))
        covered = np.zeros(n, bool)
        for _, _, a, k in spans.spans(line):
            covered[a : a + k] = True
        assert covered.all()


def window_starts(text: bytes, n: int):
    return [text[k : k + n] for k in range(len(text) - n + 1)]


@pytest.mark.parametrize("hot", [exact_substrings.HOT, 1])
def test_exact_substrings(spark, docs, rows, empty, hot, monkeypatch):
    monkeypatch.setattr(exact_substrings, "HOT", hot)
    if hot == 1:
        # every hash that is seen is treated as common
        monkeypatch.setattr(exact_substrings, "SAMPLE", 1.0)
        monkeypatch.setattr(exact_substrings, "COMMON", 1)
    n = exact_substrings.LENGTH
    order = places(spark, rows)
    first: dict = {}
    for r in rows:
        for k, w in enumerate(window_starts((r[1] or "").encode(), n)):
            at = (*order[r[:2]], k)
            first[w] = min(first.get(w, at), at)
    want = []
    for r in rows:
        t = (r[1] or "").encode()
        gone = np.zeros(len(t) + 1, bool)
        for k, w in enumerate(window_starts(t, n)):
            if first[w] != (*order[r[:2]], k):
                gone[k : k + n] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((r[0], len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in exact_substrings.digest(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(w[2] for w in want) > 0
    assert exact_substrings.digest(empty).count() == 0


def brute_fingerprint(text, k=3):
    import xxhash

    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("hot", [simhash.HOT, 1])
def test_simhash(docs, rows, empty, hot, monkeypatch):
    monkeypatch.setattr(simhash.buckets, "__defaults__", (hot,))
    fps = np.array([brute_fingerprint(r[1]) for r in rows], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 2
    label = np.arange(len(rows))
    while True:
        new = np.where(near, label[None], len(rows)).min(axis=1)
        if (new == label).all():
            break
        label = new
    least = {c: min((r[0] for r, x in zip(rows, label, strict=True) if x == c and r[0] is not None), default=None) for c in set(label.tolist())}
    want = [(r[0], f"{int(f):016x}", least[c]) for r, f, c in zip(rows, fps, label.tolist(), strict=True)]
    got = [tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(label.tolist()))


def test_gray_index():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    flips = [base ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for _ in range(40)]
    v = np.unique(np.concatenate([base, *flips]))
    index = simhash.GrayIndex(v)
    assert len(index.levels) > 2
    for radius in (0, 1, 2, 5):
        q, j = index.search(v, radius)
        want = np.argwhere(np.bitwise_count(v[:, None] ^ index.values[None]) <= radius)
        assert sorted(zip(q.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


def test_decontamination(spark, docs, rows, empty):
    passage = next(r[1] for r in rows if r[0] == 5 and not r[1].startswith("another"))
    items = [(1, " ".join(passage.split()[10:40])), (2, "one"), (3, None), (4, " .. "), (None, "one"), (None, " ".join(passage.split()[50:70])), (1, " ".join(passage.split()[10:40])), (12, "ONE")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, spans string")

    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows: dict = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            # an item without an id marks words, but can't be named
            windows.setdefault(tuple(w[k : k + 10]), set()).update(() if i is None else (str(i),))
    want = []
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        want.append((r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    for room in (decontaminate.MAX_PATTERN_BYTES, 1):
        scanned = decontaminate.scan_documents(docs, bench, max_pattern_bytes=room)
        assert sorted(map(repr, map(tuple, decontaminate.digest(scanned).collect()))) == sorted(map(repr, want))
    texts_of = {(r[0], r[1]) for r in rows}
    for r in scanned.where("n_hit > 0").collect():
        hits = [" ".join(words(t[s.start : s.end])) for i, t in texts_of if i == r.doc_id and t for s in r.spans]
        assert any(len(h.split()) == r.n_hit for h in hits) or sum(len(h.split()) for h in hits) >= r.n_hit
    for room in (decontaminate.MAX_PATTERN_BYTES, 1):
        clean = decontaminate.clean_documents(docs, bench, max_pattern_bytes=room)
        assert clean.columns == docs.columns
        assert clean.count() == sum(not w[-1] for w in want)
    assert decontaminate.scan_documents(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.scan_documents(empty, bench).count() == 0


def test_tokens(docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    order = sorted(rows, key=lambda r: (*key(r), r[1] is not None, r[1] or ""))
    at, want = 0, []
    for r in order:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_output.token_table(docs, tokenizer_path(), 2).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert token_output.token_table(empty, tokenizer_path(), 2).count() == 0


def test_tokenizing_odd_texts():
    from tokenizers import Tokenizer

    from tidemark.llm.tokenizing import TextEncoder

    t, e = Tokenizer.from_file(tokenizer_path()), TextEncoder(tokenizer_path(), limit=5)
    for x in ["it's DON'T we'LL “q”", "x² ¼a ǅ İ ΣΑΣ ς", "<|endoftext|>a <|STARTOFTEXT|>", "a\tb\x0bc\x85d\xa0e\x1cf", "é ́x", "日本 🙂", "", " \n\n", "ªºµß 10,000.5"]:
        assert e.ids(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def test_token_files_keep_large_ids(tmp_path):
    w = token_output.TokenFileWriter(f"file://{tmp_path}/a/x.tdtk")
    docs = [(None, [1]), (3, []), (4, [2**32 - 1, 0, 7] * 5000)]
    for i, ids in docs:
        w.add(i, np.array(ids, "<u4").tobytes())
    w.close()
    r = token_output.TokenFileReader(f"file://{tmp_path}/a/x.tdtk")
    assert [(i, ids.tolist()) for i, _, ids in r.documents()] == docs
    with pytest.raises(ValueError, match="not a token file"):
        (tmp_path / "bad").write_bytes(b"x" * 99)
        token_output.TokenFileReader(f"file://{tmp_path}/bad")


def test_quality(docs, rows, empty, spark):
    def repeats(w):
        seen: dict = {}
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        return len({i for ks in seen.values() if len(ks) > 1 for k in ks for i in range(k, k + 8)})

    want = {}
    for r in rows:
        t = r[1] or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        n = repeats(w)
        want[repr((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), n, len(w) < 20 or 100 * n > 30 * len(w)))] = 1
    references = quality.fit_references(docs)
    got = quality.score(docs, references).collect()
    assert {repr(tuple(r)[:7]) for r in got} == set(want)
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.passing_documents(docs, references).count() == sum(r.kept for r in got)
    none = quality.fit_references(docs.withColumn("lang", F.lit(None).cast("string")))
    assert all(r.kept != r.base_failed for r in quality.score(docs, none).collect())
    assert quality.score(empty, quality.fit_references(empty)).count() == 0
    assert float(quality.distance(np.array([1.0, 0]), np.array([0, 1.0]))) == 1.0


def test_quality_on_labelled_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = quality.score(d, quality.fit_references(d)).join(labels, "doc_id").where("n_words >= 20").toPandas()
    good, junk = got[got.quality == 1], got[got.quality == 0]
    assert good.kept.mean() > 0.97
    assert junk.kept.mean() < 0.2


def test_language_id(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d, langid.fit_filters(d)).join(d, "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()
    filters = langid.fit_filters(docs)
    out = langid.identify(docs, filters).collect()
    assert len(out) == docs.count()
    names, scores = filters.decide([None, "", " 12 !", "abc"])
    assert names[:3] == ["und"] * 3
    assert names[3] in filters.langs
    assert scores[:3] == [0.0] * 3
    assert all(not r.held_out for r in out if r.doc_id is None)
    assert langid.fit_filters(empty).decide(["abc"]) == (["und"], [0.0])
    assert langid.identify(empty, filters).count() == 0


def test_language_filters_beyond_64():
    sets = {f"l{k:03d}": np.arange(k * 50, k * 50 + 50, dtype=np.uint32) for k in range(70)}
    f = langid.LanguageFilters(sets, {})
    counts = f.counts(np.concatenate([sets["l003"], sets["l069"]]), np.array([0, 50]))
    assert counts[0].argmax() == 3
    assert counts[1].argmax() == 69
    assert counts[0, 3] == counts[1, 69] == 50


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 1200
    data = [(1, "http://b.a/x", big), (2, None, big), (9, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", big), (None, "u", "solo" * 400), (9, "again", big), (7, "ü", "é" * 500)]
    pages = spark.createDataFrame([(*r, "z") for r in data], "page_id long, url string, html string, sha1 string").repartition(3)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()]
    want = []
    for i, _, h in data:
        p = (h or "").encode()
        last = max((j for j, _, x in data if x == h and j is not None), default=None)
        revisit = len(p) >= 1000 and last is not None and i != last
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_mixing(spark, docs, empty):
    w = mixing.mix_weights(docs).toPandas()
    assert abs(w.weight.sum() - 1) < 1e-9
    assert (w.budget >= w.tokens - 1).all()
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.select("doc_id", "text").distinct().count() == docs.select("doc_id", "text").distinct().count()
    assert mixing.mixture(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0
    skewed = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 10)").alias("text"), F.when(F.col("id") < 2500, "hot").when(F.col("id") < 2950, "mid").otherwise("rare").alias("source"))
    shares = mixing.source_shares(skewed)
    flat = mixing.exponent(shares, 0.9, None)
    p = np.array([2500, 450, 50]) / 3000

    def entropy(a):
        q = p**a / (p**a).sum()
        return -(q * np.log(q)).sum()

    assert abs(entropy(flat) - 0.9 * np.log(3)) < 1e-6
    limited = mixing.exponent(shares, None, 3.0)
    assert abs((p[0] / p[2]) ** (1 - limited) - 3.0) < 1e-6
    assert mixing.exponent(shares, None, None) == 1.0
    budgeted = mixing.mixture(skewed, target_entropy=0.9, max_epochs=None, budget_tokens=30_000).groupBy("source").agg(F.sum("n_words").alias("n"), F.max("budget").alias("b"), F.max("epoch").alias("e")).collect()
    assert all(r.b <= r.n < r.b + 10 for r in budgeted)
    assert {r.source: r.e for r in budgeted}["rare"] > 2


def test_code_points_have_classes():
    table = quality.class_table()
    for point in (*range(0x80), 0xE9, 0x3B1, 0x44F, 0x5D0, 0x628, 0x905, 0x4E2D, 0xAC00, 0x301, 0x2014, 0x20AC, 0x200B, 0x2003):
        found = np.flatnonzero(quality.char_histogram(chr(point).encode())).tolist()
        assert found == [quality.CLASSES.index(quality._class_of(point))] == [int(table[point])]
    assert quality.char_histogram("𝒳🙂漢".encode()).sum() == 3
    assert quality.char_histogram(b"\xff\xfe a").sum() == 4
    cyrillic, greek = "слово и дело ".encode() * 20, "λόγος και έργο ".encode() * 20
    assert float(quality.distance(quality.char_histogram(cyrillic), quality.char_histogram(greek))) > 0.7


def brute_distance(a: dict, b: dict) -> float:
    """Jensen-Shannon distance by its definition, from counts by name."""
    import math

    x, y = sum(a.values()), sum(b.values())
    out = 0.0
    for k in {*a, *b}:
        p, q = a.get(k, 0) / x, b.get(k, 0) / y
        m = (p + q) / 2
        out += (p * math.log2(p / m) if p else 0) / 2 + (q * math.log2(q / m) if q else 0) / 2
    return math.sqrt(max(0.0, out))


def test_quality_distances_and_verdicts(spark):
    """Distances and verdicts of every document by their definitions, from the references alone."""
    from collections import Counter

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ref = quality.fit_references(d)
    chars = [{c: n for c, n in zip(quality.CLASSES, row, strict=True) if n} for row in ref.chars.tolist()]
    names = [*ref.common, None]
    order = sorted(ref.common, key=ref.common.get)
    words = [{w: n for w, n in zip([*order, None], row, strict=True) if n} for row in ref.words.tolist()]
    assert len(names) == ref.words.shape[1]
    texts = {r.doc_id: r for r in d.collect()}
    for r in quality.score(d, ref).collect():
        t, ok = texts[r.doc_id].text or "", True
        char = word = 0.0
        if texts[r.doc_id].lang not in ref.few and len(t) >= quality.CHAR_MIN_CHARS:
            char = min(brute_distance(Counter(quality._class_of(ord(c)) for c in t), c) for c in chars)
            ok = char <= quality.CHAR_FLOOR + quality.CHAR_SLACK / len(t) ** 0.5
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        if texts[r.doc_id].lang not in ref.few and len(w) >= quality.WORD_MIN_WORDS:
            word = min(brute_distance(Counter(x.encode() if x.encode() in ref.common else None for x in w), c) for c in words)
            ok = ok and word <= quality.WORD_FLOOR + quality.WORD_SLACK / len(w) ** 0.5
        assert (r.char_distance, r.word_distance) == (pytest.approx(char, abs=1e-6), pytest.approx(word, abs=1e-6))
        assert r.kept == (ok and not r.base_failed)


def test_malformed_bytes(spark):
    """Bytes that are no UTF-8 stop no operator."""
    bad = spark.range(4).select(F.col("id").alias("doc_id"), F.expr("cast(unhex('61FF62208020C3') as string)").alias("text"), F.lit("a").alias("lang"), F.lit("s").alias("source"))
    bench = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert {r.n_words for r in quality.score(bad, quality.fit_references(bad)).collect()} == {3}
    assert langid.identify(bad, langid.fit_filters(bad)).count() == 4
    assert spans.deduplicated(bad).count() == 4
    assert {r.n_bytes for r in exact_substrings.digest(bad).collect()} == {7}
    assert decontaminate.scan_documents(bad, bench).count() == 4
    assert simhash.near_duplicates(bad).select("component_id").distinct().count() == 1
    assert token_output.token_table(bad, tokenizer_path()).count() == 4
    assert mixing.mixture(bad).count() >= 4


def test_mixture_positions(docs):
    got = mixing.mixture(docs).toPandas()
    assert sorted(got.position) == list(range(len(got)))
    # blocks of a pass stand together
    for _, g in got.groupby(["source", "epoch", "block"], dropna=False):
        assert g.position.max() - g.position.min() == len(g) - 1
